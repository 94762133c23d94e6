"""Error-recovering reader of timing files.

A recursive-descent parser over one record.  Broken quotes do not stop it: the
error is located, and parsing resumes at an anchor that has been validated.
Within a line that is the next white space whose following token reads as a
whole token.  In the text of a file, where a quoted value may run over line
ends, it is the next record start: a line that reads as a complete record by
itself.  A quote that is still open when such a line is met was broken, so it
costs its own line only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.session import spread

# --- fixed values of the format -------------------------------------------
COMMENT_HEADS = frozenset(("C", "#"))
CONTROL_HEADS = frozenset(("MODE", "FORMAT", "EFAC", "EQUAD", "JUMP"))
ARGUMENT_HEADS = frozenset(("TIME", "INCLUDE"))
FREQ_MAX, MJD_MIN, MJD_MAX, ERR_MAX = 100000.0, 40000.0, 70000.0, 10000.0
# ---------------------------------------------------------------------------

NUMBER = re.compile(r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?(?:[eEdD][+-]?\d+)?|[+-]?\.\d+(?:[eEdD][+-]?\d+)?")
PLAIN = re.compile(r'[^\s"]+')
BLANK = re.compile(r"\s*")
QUOTED = re.compile(r'"((?:[^"]|"")*)"(?=\s|$)')
#: a whole token, and the quote that opens a value which its line does not close
TOKEN = re.compile(r'(?:"(?:[^"]|"")*"|[^\s"]+)(?=\s|$)')
OPEN = re.compile(r'(?:\s*(?:"(?:[^"]|"")*"|[^\s"]+)(?=\s|$))*\s*"(?:[^"]|"")*$')


def number(token: str) -> float | None:
    """Value of a numeric token (sign, thousands commas, e or d exponent), else None."""
    if NUMBER.fullmatch(token) is None:
        return None
    v = float(token.replace(",", "").replace("D", "e").replace("d", "e"))
    return v if v - v == 0 else None


@dataclass
class Record:
    """One parsed line.  ``kind``: blank, comment, control, time, include, toa or error."""

    kind: str = "blank"
    reason: str | None = None
    errors: list[tuple[str, int]] = field(default_factory=list)
    values: dict = field(default_factory=dict)
    flags: dict[str, str] = field(default_factory=dict)

    def fail(self, reason: str, at: int) -> None:
        self.errors.append((reason, at))


class LineParser:
    """Grammar: record := head-only | head argument | [sat] name freq mjd err tel flag*.

    Tokens are (text, quoted, position).  The methods descend from record to
    token; each notes errors and returns what could still be read.
    """

    def __init__(self, line: str):
        self.line, self.pos, self.end = line, 0, len(line)
        self.out = Record()

    # token := quoted | plain; recovers at the next white space after a broken quote
    def token(self) -> tuple[str, bool, int] | None:
        at = BLANK.match(self.line, self.pos).end()
        if at >= self.end:
            self.pos = self.end
            return None
        if self.line[at] == '"':
            if m := QUOTED.match(self.line, at):
                self.pos = m.end()
                return m.group(1).replace('""', '"'), True, at
            self.out.fail("quoting", at)
            return self.recover(at)
        m = PLAIN.match(self.line, at)
        self.pos = m.end()
        if self.pos < self.end and self.line[self.pos] == '"':
            self.out.fail("quoting", self.pos)
            return self.recover(at)
        return m.group(), False, at

    def recover(self, at: int) -> tuple[str, bool, int]:
        """Skips to the next white space after which a whole token can be read, or to the end."""
        nxt = at
        while True:
            while nxt < self.end and not self.line[nxt].isspace():
                nxt += 1
            begin = BLANK.match(self.line, nxt).end()
            if begin >= self.end or TOKEN.match(self.line, begin):
                break
            nxt = begin
        self.pos = nxt
        return self.line[at:nxt].replace('"', ""), True, at

    def parse(self) -> Record:
        out, first = self.out, self.token()
        if first is None:
            return out
        head = "" if first[1] else first[0]
        if head in COMMENT_HEADS or head in CONTROL_HEADS:
            out.kind = "comment" if head in COMMENT_HEADS else "control"
            return out
        # the whole line is lexed, so that every broken quote is located
        tokens = [first]
        while (t := self.token()) is not None:
            tokens.append(t)
        if head.upper() in ARGUMENT_HEADS:
            self.directive(head.upper(), tokens[1:])
        else:
            self.toa(tokens)
        if out.errors:
            rank = ("quoting", "columns", "value")
            out.reason = min((r for r, _ in out.errors), key=rank.index)
            out.kind = "error"
        return out

    def directive(self, name: str, args: list) -> None:
        out = self.out
        out.kind = name.lower()
        if len(args) != 1:
            out.fail("columns", args[1][2] if args else self.end)
        elif name == "TIME":
            out.values["offset"] = self.numeric(args[0], None, None)
        else:
            out.values["file"] = args[0][0]

    def toa(self, tokens: list) -> None:
        out = self.out
        out.kind = "toa"
        is_flag = [not q and t[0] == "-" and number(t) is None for t, q, _ in tokens]
        split = is_flag.index(True) if True in is_flag else len(tokens)
        head = tokens[:split]
        sat = number(head[0][0]) if head else None
        names = ("sat", "filename", "freq", "mjd", "toaerr", "tel") if sat is not None else ("filename", "freq", "mjd", "toaerr", "tel")
        if len(head) != len(names):
            out.fail("columns", head[min(len(head), len(names)) - 1][2] if head else tokens[0][2])
        else:
            got = dict(zip(names, head))
            v = out.values
            v["filename"], v["tel"] = got["filename"][0], got["tel"][0]
            v["freq"] = self.numeric(got["freq"], 0.0, FREQ_MAX, open_low=True)
            v["mjd"] = self.numeric(got["mjd"], MJD_MIN, MJD_MAX)
            v["toaerr"] = self.numeric(got["toaerr"], 0.0, ERR_MAX, open_low=True)
            if sat is not None:
                v["sat"] = self.numeric(got["sat"], MJD_MIN, MJD_MAX)
        name = None
        for (text, _, at), flag in zip(tokens[split:], is_flag[split:]):
            if flag:
                name = text[1:]
                out.flags[name] = "true"
                free = True
            elif free:
                out.flags[name] = text
                free = False
            else:
                out.fail("columns", at)

    def numeric(self, token, low, high, open_low: bool = False) -> float | None:
        v = number(token[0])
        if v is None or (low is not None and (v <= low if open_low else v < low)) or (high is not None and v > high):
            self.out.fail("value", token[2])
        return v


def parse_line(line: str) -> Record:
    return LineParser(line).parse()


def is_record_start(line: str) -> bool:
    """Whether a line reads as a complete record by itself."""
    r = parse_line(line)
    return r.reason is None and r.kind != "blank"


def records(lines: list[str], reach: int = 32) -> Iterator[tuple[int, int, Record]]:
    """(place of the first line, number of lines, record) of consecutive lines of one file.

    A line that leaves a quote open is joined with the following ones, at most
    ``reach`` of them, until the quote is closed and the whole reads without a
    broken quote.  A line on the way that is a record start is the anchor: then
    the quote was broken, and parsing resumes there.
    """
    i, n = 0, len(lines)
    while i < n:
        r, used = parse_line(lines[i]), 1
        if r.reason == "quoting" and OPEN.fullmatch(lines[i]):
            text = lines[i]
            for k in range(i + 1, min(n, i + 1 + reach)):
                if is_record_start(lines[k]):
                    break
                text = f"{text}\n{lines[k]}"
                if OPEN.fullmatch(text):
                    continue
                joined = parse_line(text)
                if not any(why == "quoting" for why, _ in joined.errors):
                    r, used = joined, k + 1 - i
                break
        yield i, used, r
        i += used


def parse_text(text: str, reach: int = 32) -> Iterator[tuple[int, Record]]:
    """Records of a whole file with the number of their first line (from 1)."""
    for at, _, r in records(re.split(r"\r\n|\n|\r", text), reach):
        yield at + 1, r


OUTPUT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("error_at", T.IntegerType()),
    T.StructField("sat", T.DoubleType()), T.StructField("filename", T.StringType()), T.StructField("freq", T.DoubleType()),
    T.StructField("mjd", T.DoubleType()), T.StructField("toaerr", T.DoubleType()), T.StructField("tel", T.StringType()),
    T.StructField("argument", T.StringType()), T.StructField("offset_sec", T.DoubleType()), T.StructField("flags", T.MapType(T.StringType(), T.StringType())),
])
_ARROW = pa.struct([
    ("kind", pa.string()), ("reason", pa.string()), ("error_at", pa.int32()), ("sat", pa.float64()), ("filename", pa.string()), ("freq", pa.float64()),
    ("mjd", pa.float64()), ("toaerr", pa.float64()), ("tel", pa.string()), ("argument", pa.string()), ("offset_sec", pa.float64()), ("flags", pa.map_(pa.string(), pa.string())),
])


def _row(line: str | None) -> dict:
    return {"kind": "blank"} if line is None else _as_row(parse_line(line))


def _as_row(r: Record) -> dict:
    v = r.values
    at = None
    if r.reason:
        at = min(a for why, a in r.errors if why == r.reason) + 1
    return {
        "kind": r.kind, "reason": r.reason, "error_at": at, "sat": v.get("sat"), "filename": v.get("filename"), "freq": v.get("freq"),
        "mjd": v.get("mjd"), "toaerr": v.get("toaerr"), "tel": v.get("tel"), "argument": v.get("file"), "offset_sec": v.get("offset"),
        "flags": list(r.flags.items()) if r.kind == "toa" else None,
    }


def parse_lines(df: DataFrame, *, line: str = "line", keep: list[str] | None = None, only: str | None = None) -> DataFrame:
    """Typed records and located errors of a table of lines, one output row per line.

    Adds kind, reason (quoting, columns, value), error_at (1-based character),
    the TOA columns, the directive's argument and the flag map.  ``keep`` names
    the input columns to carry (default all but the line).  ``only`` restricts
    the output to 'toa' or 'error' rows inside the worker.

    Defined cases: a null line counts as blank; an empty table gives an empty
    result; repeated lines are parsed each by itself; an input column that is
    called like an output column is carried as ``in_<name>``.
    """
    carried = [c for c in (keep if keep is not None else df.columns) if c != line]
    made = {f.name.lower() for f in OUTPUT.fields}
    names = [f"in_{c}" if c.lower() in made else c for c in carried]
    src = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carried, names)], F.col(f"`{line}`").cast("string").alias("_line"))
    schema = T.StructType([*src.schema.fields[:-1], *OUTPUT.fields])

    def run(batches):
        for b in batches:
            rows = [_row(x) for x in b.column(b.num_columns - 1).to_pylist()]
            if only is not None:
                at = [i for i, r in enumerate(rows) if r["kind"] == only]
                b, rows = b.take(pa.array(at, pa.int64())), [rows[i] for i in at]
            made_cols = pa.array(rows, _ARROW)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *made_cols.flatten()], names=[*b.schema.names[:-1], *[f.name for f in _ARROW]]
            )

    return spread(src).mapInArrow(run, schema)


def rejected_lines(df: DataFrame, *, line: str = "line", keep: list[str] | None = None) -> DataFrame:
    """The lines that are no valid record, with the reason and its place."""
    out = parse_lines(df, line=line, keep=keep, only="error")
    drop = [f.name for f in OUTPUT.fields if f.name not in ("reason", "error_at")]
    return out.drop(*drop)


def loaded_toas(df: DataFrame, *, line: str = "line", keep: list[str] | None = None) -> DataFrame:
    """The valid TOA lines as typed rows with their flags."""
    return parse_lines(df, line=line, keep=keep, only="toa").drop("kind", "reason", "error_at", "argument", "offset_sec")


def file_records(df: DataFrame, *, file: str = "_timfile", line_no: str = "line_no", line: str = "line", block_lines: int = 20_000, reach: int = 32) -> DataFrame:
    """Typed records and located errors of whole files given as numbered lines, one output row per record.

    Columns: file, line_no (of the first line), n_lines and those of
    ``parse_lines``.  A quoted value may run over at most ``reach`` line ends.
    Files are read in blocks of lines, each with twice ``reach`` lines before
    and ``reach`` after it: parsing that begins within a value finds its place
    at the first record start, so a file of any length spreads over tasks.

    Defined cases: a null line is blank; rows with a null file or number are
    left out; equal numbers of a file are ordered by their text; gaps in the
    numbers count as no line; an empty table gives an empty result; other
    columns are ignored.
    """
    f_type, n_type = df.schema[file].dataType, df.schema[line_no].dataType
    src = df.select(F.col(f"`{file}`").alias("_f"), F.col(f"`{line_no}`").cast("long").alias("_n"), F.coalesce(F.col(f"`{line}`").cast("string"), F.lit("")).alias("_l"))
    src = src.where(F.col("_f").isNotNull() & F.col("_n").isNotNull())
    block = F.floor(F.col("_n") / block_lines)
    place = F.pmod(F.col("_n"), F.lit(block_lines))
    to = F.array_compact(F.array(block, F.when(place >= block_lines - 2 * reach, block + 1), F.when(place < reach, block - 1)))
    src = src.withColumn("_b", F.explode(to))
    made = T.StructType([T.StructField(file, f_type), T.StructField(line_no, n_type), T.StructField("n_lines", T.IntegerType()), *OUTPUT.fields])
    arrow = [("_f", None), ("_n", pa.int64()), ("n_lines", pa.int32()), *[(x.name, x.type) for x in _ARROW]]

    def one(key, t):
        order = sorted(zip(t.column("_n").to_pylist(), t.column("_l").to_pylist()))
        numbers = [n for n, _ in order]
        low, high = key[1].as_py() * block_lines, (key[1].as_py() + 1) * block_lines
        rows = [{"_n": numbers[i], "n_lines": k, **_as_row(r)} for i, k, r in records([x for _, x in order], reach) if low <= numbers[i] < high]
        cols = [pa.array([r[name] for r in rows], kind) for name, kind in arrow[1:]]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(rows), t.schema.field("_f").type), *cols], names=made.names)

    cast = T.StructType([*made.fields[:1], T.StructField(line_no, T.LongType()), *made.fields[2:]])
    out = src.groupBy("_f", "_b").applyInArrow(one, cast)
    return out.withColumn(line_no, F.col(f"`{line_no}`").cast(n_type))
