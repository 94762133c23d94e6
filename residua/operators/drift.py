"""Schemas that drift between dumps: a change report and one consistent table.

Each dump gets a profile of its fields (counts of types, value ranges, shapes
of text, inner names of objects), aggregated on the map side.  Consecutive
dumps of a campaign are compared by similarity flooding.  The schema graph of a
dump has the record, its fields and, per field, a domain (what its values look
like), a type and the inner fields of objects; fields whose values lie close to
each other are linked.  Pairs of nodes that hang on edges of one kind make the
pair graph.  Names score pairs of fields, values score pairs of domains; the
scores are then passed along the edges until they settle, and consistent pairs
are selected by their settled scores.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache, reduce
from math import log2
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.session import checkpointed, spread

TYPES = ("number", "string", "boolean", "object", "array")
_NUMBER = r"^\s*([+-]?[0-9][0-9,]*(?:\.[0-9]*)?(?:[eEdD][+-]?[0-9]+)?)\s*[A-Za-z%]*\s*$"
_IN_OBJECT = r"[:\[]\s*([+-]?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)"


@dataclass(frozen=True)
class DriftConfig:
    #: least settled score of a pair of fields, and of their domains, for a rename
    accept: float = 0.52
    domain_floor: float = 0.4
    #: share of a field pair's score that comes in over the edges, by kind of edge; the rest is its name
    over_values: float = 0.6
    over_type: float = 0.08
    over_nesting: float = 0.05
    over_neighbours: float = 0.1
    over_record: float = 0.02
    #: share of a leaf pair's score that comes back from the fields
    back: float = 0.2
    #: fields are neighbours if their middle values differ by no more than this share
    near: float = 0.05
    #: rounds of flooding at most, and the change at which it has settled
    rounds: int = 60
    settled: float = 1e-4


def numeric_value(text: Column, kind: Column) -> Column:
    """Number held by a JSON value: a number, numeric text with or without unit, or the first number in an object."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, _NUMBER, 1), ",", ""), "[dD]", "e")
    inner = F.regexp_extract(text, _IN_OBJECT, 1)
    first = F.ascii(F.ltrim(text))  # most texts are told from numbers by it
    signed = first.isin(43, 45, 9, 10, 13) | first.between(48, 57)
    return F.when(kind == "number", text).when((kind == "string") & signed, plain).when(kind == "object", inner).try_cast("double")


def json_fields(df: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """keys, name, kind (JSON type or null), text of all but numbers, num and inner (schema of an object) of each field; a record without fields has one row of null name.

    A record that is no JSON object, or has one name twice, has no fields.
    """
    spark = df.sparkSession
    src = spread(df.select(*keys, F.col(record).alias("_r"))).select(*keys, F.try_parse_json("_r").alias("_v"))
    each = src.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer()), how="left")
    raw = F.schema_of_variant("value")
    kind = (
        F.when(raw.isNull() | (raw == "VOID"), None)
        .when(raw.isin("STRING", "BOOLEAN"), F.lower(raw))
        .when(raw.startswith("OBJECT"), "object")
        .when(raw.startswith("ARRAY"), "array")
        .otherwise("number")
    )
    out = each.select(*keys, F.col("key").alias("name"), kind.alias("kind"), F.when(kind == "object", raw).alias("inner"), "value")
    # a number is taken as it is; only other values are read as text
    out = out.withColumns({"text": F.when(F.col("kind") != "number", F.col("value").cast("string")), "_plain": F.when(F.col("kind") == "number", F.try_variant_get("value", "$", "double"))})
    return out.select(*keys, "name", "kind", "text", F.coalesce("_plain", numeric_value(F.col("text"), F.col("kind"))).alias("num"), "inner")


def field_profiles(df: DataFrame, *, record: str, campaign: str, dump_no: str, dump_id: str) -> DataFrame:
    """One row per dump and field name; dumps without fields keep a row of null name."""
    keys = [campaign, dump_no, dump_id]
    each = json_fields(df, record, keys)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "9")
    worded = F.col("num").isNull() & (F.col("kind") == "string")
    # the most telling keys first, as what does not fit the hash map is sorted by them
    return each.groupBy(dump_id, "name", dump_no, campaign).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("kind") == t).alias(f"n_{t}") for t in TYPES],
        F.count("num").alias("n_num"),
        F.min("num").alias("lo"),
        F.max("num").alias("hi"),
        F.percentile_approx("num", [0.25, 0.5, 0.75], 500).alias("q"),
        F.max("inner").alias("inner"),
        F.mode(F.when(worded, shape), True).alias("shape"),
        F.min(F.when(worded, F.col("text"))).alias("text_min"),
        F.max(F.when(worded, F.col("text"))).alias("text_max"),
    )


# --- comparison of two dumps ------------------------------------------------


def _letters(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.casefold())


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


@lru_cache(100_000)
def name_score(a: str, b: str) -> float:
    x, y = _letters(a), _letters(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    short, long = sorted((x, y), key=len)
    pairs = lambda s: Counter(s[i : i + 2] for i in range(len(s) - 1))
    p, q = pairs(x), pairs(y)
    dice = 2 * sum((p & q).values()) / max(1, sum(p.values()) + sum(q.values()))
    if long.startswith(short) or long.endswith(short):
        return max(dice, 0.8)
    return max(dice, 0.6) if short[0] == long[0] and _within(short, long) else dice


def main_type(f: dict) -> str | None:
    """JSON type of most non-null values; the order of TYPES settles ties."""
    best = max(TYPES, key=lambda t: f[f"n_{t}"])
    return best if f[f"n_{best}"] else None


def _overlap(l1: float, h1: float, l2: float, h2: float) -> float:
    """Share that two middle ranges have in common; samples of one quantity rarely have all."""
    span = max(h1, h2) - min(l1, l2)
    return min(1.0, 1.6 * max(0.0, min(h1, h2) - max(l1, l2)) / span) if span > 0 else 1.0


def _one_value(f: dict) -> bool:
    """Whether a field holds one value throughout, but for strays."""
    if f["q"] is not None and f["n_num"] * 2 > _known(f):
        return f["q"][0] == f["q"][2]
    return f["text_min"] == f["text_max"] and not f["n_num"]


def _decimals(f: dict) -> int:
    """Digits after the point of the finest of the quartiles."""
    return max(0, *(-Decimal(repr(float(v))).normalize().as_tuple().exponent for v in f["q"]))


def _known(f: dict) -> int:
    return sum(f[f"n_{t}"] for t in TYPES)


def domain_score(a: dict, b: dict) -> float:
    """Agreement of two fields' values, whatever their JSON types, 0 to 1; 0.5 where one has none."""
    ta, tb = main_type(a), main_type(b)
    if ta is None or tb is None:
        return 0.5
    if (ta == "boolean") != (tb == "boolean"):
        return 0.0
    if ta == "boolean":
        return 1.0
    na, nb = a["n_num"] / _known(a) > 0.5, b["n_num"] / _known(b) > 0.5
    if na != nb:
        return 0.0
    one_a, one_b = _one_value(a), _one_value(b)
    steady = 1.0 if one_a == one_b else 0.5
    if na:
        (l1, m1, h1), (l2, m2, h2) = a["q"], b["q"]
        size = max(abs(m1), abs(m2))
        if one_a and one_b:
            agree = 1.0 if abs(m1 - m2) <= 1e-6 * size else (0.2 if size and abs(m1 - m2) <= 0.01 * size else 0.0)
        elif size and abs(m1 - m2) <= 0.01 * size + 1e-9 and max(h1 - l1, h2 - l2) <= 0.05 * size:
            agree = 1.0
        else:
            agree = _overlap(l1, h1, l2, h2)
            if l1 > 0 and l2 > 0:
                agree = max(agree, _overlap(log2(l1), log2(h1), log2(l2), log2(h2)))
            # whole ranges vary less than middle ones, but stray values widen them
            span = max(a["hi"], b["hi"]) - min(a["lo"], b["lo"])
            if span > 0:
                agree = max(agree, 0.95 * max(0.0, min(a["hi"], b["hi"]) - max(a["lo"], b["lo"])) / span)
        if not (one_a and one_b):
            p, q = _decimals(a), _decimals(b)
            agree *= 0.4 if (p == 0) != (q == 0) else 0.6 if abs(p - q) > 1 else 1.0
        return agree * steady
    if a["shape"] != b["shape"]:
        return 0.1
    if a["text_min"] == b["text_min"] and a["text_max"] == b["text_max"]:
        return 1.0
    return (0.75 if not (one_a and one_b) else 0.3) * steady


def _leaves(f: dict) -> list[tuple[str, str]]:
    """(inner name, type) of what a field holds; a plain value is one leaf without a name."""
    kind = main_type(f) or ""
    if kind == "object" and f["inner"]:
        return [(n, "string" if t == "STRING" else "boolean" if t == "BOOLEAN" else "number") for n, t in re.findall(r"[<,]\s*`?([^:<>`]+)`?: *([A-Z]+)", f["inner"])]
    return [("", kind)]


def _leaf_score(a: tuple[str, str], b: tuple[str, str]) -> float:
    if not a[1] or not b[1]:
        return 0.5
    named = name_score(a[0], b[0]) if a[0] and b[0] else 1.0
    return named * (1.0 if a[1] == b[1] else 0.75 if "boolean" not in (a[1], b[1]) else 0.0)


def _nest_score(a: dict, b: dict) -> float:
    """How well the leaves of the field with fewer of them are found in the other."""
    few, many = sorted((_leaves(a), _leaves(b)), key=len)
    return sum(max(_leaf_score(p, q) for q in many) for p in few) / len(few)


def flood(old: dict[str, dict], new: dict[str, dict], cfg: DriftConfig) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(vanished fields, new fields, settled scores of their pairs, settled scores of their domains).

    A field that stays is paired with itself only, with score 1; it passes that
    on to its neighbours.  Every pair takes the mean of what comes in over each
    kind of edge, so that scores stay between 0 and 1 and the passing is a
    contraction: it settles, and to the same scores from wherever it starts.
    """
    a, b = [x for x in old if x not in new], [y for y in new if y not in old]
    stay = [x for x in old if x in new]
    name = np.array([[name_score(x, y) for y in b] for x in a])
    domain0 = np.array([[domain_score(old[x], new[y]) for y in b] for x in a])
    nest = np.array([[_nest_score(old[x], new[y]) for y in b] for x in a])
    ta, tb = [main_type(old[x]) or "" for x in a], [main_type(new[y]) or "" for y in b]
    kinds = sorted(set(ta) | set(tb))
    ia, ib = (np.array([[1.0 if t == k else 0.0 for k in kinds] for t in ts]) for ts in (ta, tb))
    type0 = np.array([[1.0 if p == q else 0.5 if not p or not q else 0.0 if "boolean" in (p, q) else 0.75 for q in kinds] for p in kinds])
    fan = np.maximum(np.outer(ia.sum(0), ib.sum(0)), 1.0)
    # neighbours of equal size, among the fields that stay and among the others
    mid = lambda f: f["q"][1] if f["q"] is not None else np.nan
    near = lambda p, q: np.array([[abs(u - v) <= cfg.near * max(abs(u), abs(v)) and u != 0 for v in q] for u in p], float).reshape(len(p), len(q))
    qa, qb, sa, sb = [mid(old[x]) for x in a], [mid(new[y]) for y in b], [mid(old[x]) for x in stay], [mid(new[x]) for x in stay]
    na, nb, ga, gb = near(qa, sa), near(qb, sb), near(qa, qa), near(qb, qb)
    np.fill_diagonal(ga, 0), np.fill_diagonal(gb, 0)
    degree = np.maximum.outer(na.sum(1) + ga.sum(1), nb.sum(1) + gb.sum(1))
    by_stay = na @ nb.T
    weights = cfg.over_values, cfg.over_type, cfg.over_nesting, cfg.over_record
    wn = np.where(degree > 0, cfg.over_neighbours, 0.0)
    own = 1.0 - sum(weights) - cfg.over_neighbours
    total = sum(weights) + wn + own
    field, domain, types, record = own * name / total, domain0, type0, 1.0
    for _ in range(cfg.rounds):
        paired = (by_stay + ga @ field @ gb.T) / np.maximum(degree, 1)
        inflow = cfg.over_values * domain + cfg.over_type * (ia @ types @ ib.T) + cfg.over_nesting * nest + wn * np.minimum(paired, 1.0) + cfg.over_record * record
        nxt = (own * name + inflow) / total
        domain = (1 - cfg.back) * domain0 + cfg.back * field
        types = (1 - cfg.back) * type0 + cfg.back * (ia.T @ field @ ib) / fan
        record = (len(stay) + float(field.max(1).sum())) / (len(stay) + len(a))
        moved = float(np.abs(nxt - field).max())
        field = nxt
        if moved < cfg.settled:
            break
    return a, b, field, domain


def compare(old: dict[str, dict], new: dict[str, dict], cfg: DriftConfig) -> list[tuple[str, str, str]]:
    """(field_old, field_new, drift) from one dump to the next."""
    out = []
    gone, come = [x for x in old if x not in new], [y for y in new if y not in old]
    matched: set[str] = set()
    if gone and come:
        a, b, score, domain = flood(old, new, cfg)
        ranked = sorted(((-score[i, j], x, y, domain[i, j]) for i, x in enumerate(a) for j, y in enumerate(b)), key=lambda r: r[:3])
        for s, x, y, d in ranked:
            if -s >= cfg.accept and d >= cfg.domain_floor and x not in matched and y not in matched:
                matched |= {x, y}
                out.append((x, y, "renamed"))
    out += [(x, "", "removed") for x in gone if x not in matched]
    out += [("", y, "added") for y in come if y not in matched]
    for x in old:
        if x in new:
            t, u = main_type(old[x]), main_type(new[x])
            if t and u and t != u:
                out.append((x, x, "retyped"))
    return out


class _Profile:
    """A field's profile in an Arrow batch; what is not asked for is not read."""

    __slots__ = ("cols", "at", "kept")

    def __init__(self, cols: dict, at: int):
        self.cols, self.at, self.kept = cols, at, {}

    def __getitem__(self, key: str):
        if key not in self.kept:
            c = self.cols[key]
            self.kept[key] = c[self.at] if isinstance(c, list) else c[self.at].as_py()
        return self.kept[key]


def schema_drift(
    df: DataFrame,
    *,
    record: str = "record",
    campaign: str = "campaign",
    dump_no: str = "dump_no",
    dump_id: str = "dump_id",
    cfg: DriftConfig = DriftConfig(),
    profiles: DataFrame | None = None,
) -> DataFrame:
    """(dump_id, field_old, field_new, drift) of each dump against the one before it in its campaign.

    drift is added, removed, renamed or retyped.  Dumps are told apart by
    (campaign, dump_no); gaps in dump_no are skipped.

    Defined cases: a field is there if any record names it, be its value null;
    a field of nulls only has no type and is never retyped; records that are no
    JSON object have no fields; repeated records change nothing but counts; a
    campaign's first dump has no row; rows with a null campaign or dump_no are
    left out; an empty table gives an empty result; other columns are ignored.
    """
    known = df.where(F.col(campaign).isNotNull() & F.col(dump_no).isNotNull())
    each = profiles if profiles is not None else field_profiles(known, record=record, campaign=campaign, dump_no=dump_no, dump_id=dump_id)
    # the order of dumps, on key columns only: one small row per dump
    order = known.groupBy(F.col(campaign).alias("_c"), F.col(dump_no).alias("_no")).agg(F.lit(1).alias("_1"))
    w = Window.partitionBy("_c").orderBy("_no")
    order = order.select("_c", "_no", F.lead("_no").over(w).alias("_next"), F.lag("_no").over(w).isNotNull().alias("_has"))
    stats = [c for c in each.columns if c not in (campaign, dump_no, dump_id)]
    at = each.join(order, (each[campaign] == order["_c"]) & (each[dump_no] == order["_no"]))
    sides = F.array(
        F.when(F.col("_has"), F.struct(F.col("_no").alias("pair"), F.lit(True).alias("new"))),
        F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("pair"), F.lit(False).alias("new"))),
    )
    pairs = (
        at.withColumn("_s", F.explode(F.array_compact(sides)))
        .groupBy("_c", F.col("_s.pair").alias("_pair"))
        .agg(
            F.min(F.when(F.col("_s.new"), F.col(dump_id))).alias("_id"),
            F.collect_list(F.struct(F.col("_s.new").alias("new"), *stats)).alias("_f"),
        )
        .select("_id", "_f")
    )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = df.schema[dump_id].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            lists = b.column(1)
            flat, ends = lists.flatten(), pc.list_value_length(lists).to_pylist()
            cols = dict(zip([f.name for f in flat.type], flat.flatten()))
            for c in ("name", "new", *(f"n_{t}" for t in TYPES)):
                cols[c] = cols[c].to_pylist()
            names, is_new, ids, k = cols["name"], cols["new"], b.column(0).to_pylist(), 0
            for i, n in enumerate(ends):
                old, new = {}, {}
                for at in sorted((at for at in range(k, k + n) if names[at] is not None), key=names.__getitem__):
                    (new if is_new[at] else old)[names[at]] = _Profile(cols, at)
                k += n
                for row in compare(old, new, cfg):
                    for col, v in zip(out, (ids[i], *row)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], arrow_id), *[pa.array(c, pa.string()) for c in out[1:]]], names=["dump_id", "field_old", "field_new", "drift"]
            )

    return pairs.mapInArrow(run, f"dump_id {id_type.simpleString()}, field_old string, field_new string, drift string").withColumnRenamed("dump_id", dump_id)


# --- one consistent table ----------------------------------------------------


@dataclass(frozen=True)
class Field:
    """A field of the unified table: its name, type (double, boolean, string) and the names it was seen under."""

    name: str
    type: str
    sources: tuple[str, ...]


def consistent_fields(profiles: DataFrame, drift: DataFrame, *, campaign: str = "campaign", dump_no: str = "dump_no", max_names: int = 10_000) -> list[Field]:
    """Classes of names that renames connect, each under its most frequent name (of equals the older) and main type.

    Renames are taken by falling number of dumps that show them.  Names that
    stand in one dump are two fields there, so a rename that would bring them
    into one class is refused.  Works on schema data only: one row per distinct
    name, rename and pair of renamed names in one dump; more than ``max_names``
    of any is an error, not a cut.
    """
    known = sum((F.col(f"n_{t}") for t in TYPES[1:]), F.col("n_number"))
    named = profiles.where(F.col("name").isNotNull())
    names = (
        named.groupBy("name")
        .agg(F.sum("n").alias("n"), F.sum("n_num").alias("num"), F.sum("n_boolean").alias("bool"), F.sum(known).alias("known"))
        .limit(max_names + 1)
        .collect()
    )
    links = drift.where(F.col("drift") == "renamed").groupBy("field_old", "field_new").agg(F.count("*").alias("n")).limit(max_names + 1).collect()
    renamed = sorted({x for r in links for x in (r["field_old"], r["field_new"])})
    left = named.where(F.col("name").isin(renamed)).select(F.col(campaign).alias("_c"), F.col(dump_no).alias("_d"), "name")
    both = left.join(left.withColumnRenamed("name", "other"), ["_c", "_d"]).where("name < other").select("name", "other").distinct()
    together = both.limit(max_names + 1).collect() if links else []
    if max(len(names), len(links), len(together)) > max_names:
        raise ValueError(f"more than {max_names} field names, renames or pairs of renamed names in one dump")
    root = {r["name"]: r["name"] for r in names}
    apart: dict[str, set[str]] = {}
    for r in together:
        apart.setdefault(r["name"], set()).add(r["other"])
        apart.setdefault(r["other"], set()).add(r["name"])
    members = {x: {x} for x in root}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    weight = {r["name"]: r["n"] for r in names}
    for _, a, b in sorted((-r["n"], r["field_old"], r["field_new"]) for r in links):
        x, y = find(a), find(b)
        if x != y and not any(apart.get(m, set()) & members[y] for m in members[x]):
            keep, lose = (x, y) if weight[x] >= weight[y] else (y, x)
            root[lose] = keep
            members[keep] |= members.pop(lose)
    by: dict[str, list] = {}
    for r in names:
        by.setdefault(find(r["name"]), []).append(r)
    fields, taken = [], set()
    for top, rows in sorted(by.items()):
        total = sum(r["known"] for r in rows) or 1
        kind = "double" if sum(r["num"] for r in rows) > 0.8 * total else "boolean" if sum(r["bool"] for r in rows) > 0.5 * total else "string"
        name = top
        while name.lower() in taken:  # column names do not tell case apart
            name += "_"
        taken.add(name.lower())
        fields.append(Field(name, kind, tuple(r["name"] for r in sorted(rows, key=lambda r: (-r["n"], r["name"])))))
    return fields


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def unify(df: DataFrame, fields: list[Field], *, record: str = "record") -> DataFrame:
    """Every record as one row of typed fields; only scans of less partitions than cores are dealt out first.

    Fields are taken from the first of their names that holds a value.  What
    further names of the field hold is listed in ``_others`` (field, source,
    value as text), so no value is lost; values that do not cast become null
    and their field is listed in ``_uncast``.  Input columns that share a name
    with a field are carried as ``in_<name>``.  Records that are no JSON object
    have null fields.
    """
    taken = {f.name.lower() for f in fields}
    carried = [F.col(f"`{c}`").alias(f"in_{c}" if c.lower() in taken else c) for c in df.columns if c != record]
    # step by step, so that no step's expressions are evaluated once per use
    names = [F.col(f"`in_{c}`" if c.lower() in taken else f"`{c}`") for c in df.columns if c != record]
    src = spread(df.select(*carried, F.col(record).alias("_r"))).select(*names, F.try_parse_json("_r").alias("_v"))
    at = [(i, k, x) for i, f in enumerate(fields) for k, x in enumerate(f.sources)]
    src = src.select(*names, *[F.try_variant_get(F.col("_v"), _path(x), "variant").alias(f"_g{i}_{k}") for i, k, x in at])
    src = src.select(*names, *[F.when(F.schema_of_variant(F.col(f"_g{i}_{k}")) != "VOID", F.col(f"_g{i}_{k}")).alias(f"_h{i}_{k}") for i, k, _ in at])
    of = [[F.col(f"_h{i}_{k}") for k in range(len(f.sources))] for i, f in enumerate(fields)]
    others = [
        F.when(reduce(or_, [e.isNotNull() for e in of[i][:k]]) & of[i][k].isNotNull(), F.struct(F.lit(fields[i].name).alias("field"), F.lit(x).alias("source"), of[i][k].cast("string").alias("value")))
        for i, k, x in at
        if k
    ]
    src = src.select(*names, *[F.coalesce(*of[i]).alias(f"_one{i}") for i in range(len(fields))], *[o.alias(f"_o{n}") for n, o in enumerate(others)])
    others = [F.col(f"_o{n}") for n in range(len(others))]
    each = [F.col(f"_one{i}") for i in range(len(fields))]
    src = src.select(*names, *others, *[F.schema_of_variant(c).alias(f"_raw{i}") for i, c in enumerate(each)], *[c.cast("string").alias(f"_text{i}") for i, c in enumerate(each)])
    made = []
    for i, f in enumerate(fields):
        raw, text = F.col(f"_raw{i}"), F.col(f"_text{i}")
        kind = F.when(raw == "STRING", "string").when(raw == "BOOLEAN", "boolean").when(raw.startswith("OBJECT"), "object").when(raw.startswith("ARRAY"), "array").otherwise("number")
        value = numeric_value(text, kind) if f.type == "double" else F.when(kind != "number", text).try_cast("boolean") if f.type == "boolean" else text
        made.append(value.alias(f"_value{i}"))
    src = src.select(*names, *others, *[F.col(f"_text{i}") for i in range(len(fields))], *made)
    cols = [F.col(f"_value{i}").alias(f.name) for i, f in enumerate(fields)]
    uncast = [F.when(F.col(f"_text{i}").isNotNull() & F.col(f"_value{i}").isNull(), F.lit(f.name)) for i, f in enumerate(fields)]
    listed = lambda parts, kind: F.array_compact(F.array(*parts)) if parts else F.array().cast(f"array<{kind}>")
    return src.select(
        *names, *cols, listed(uncast, "string").alias("_uncast"), listed(others, "struct<field:string,source:string,value:string>").alias("_others")
    )


def unified_table(df: DataFrame, *, record: str = "record", campaign: str = "campaign", dump_no: str = "dump_no", dump_id: str = "dump_id", cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Profiles, drift and ``unify`` in one call; profiles are written once to the checkpoint folder."""
    where = dict(record=record, campaign=campaign, dump_no=dump_no, dump_id=dump_id)
    profiles = checkpointed(field_profiles(df, **where))
    return unify(df, consistent_fields(profiles, schema_drift(df, **where, cfg=cfg, profiles=profiles), campaign=campaign, dump_no=dump_no), record=record)
