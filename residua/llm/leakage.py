"""Held-out passages inside a corpus, found with a generalised suffix automaton.

The automaton of the normalised items is built once per block of items and sent
to the executors as bytes, whose number is checked: a block that takes more is
halved.  Each document
is streamed through it word by word, keeping the longest match that ends there.
Stretches of fewer than ``min_words`` consecutive item words cannot match, so
they are skipped before the automaton sees them.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.operators.blocks import small
from residua.session import spread

#: a word; a hyphen before a line break joins two halves
WORD = re.compile(r"[^\W_]+(?:-\r?\n[^\W_]+)*")
BREAK = re.compile(r"-\r?\n")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits without case, hyphenated line ends joined."""
    found = WORD.findall(text.casefold())
    if "-\n" in text or "-\r\n" in text:
        return [BREAK.sub("", w) if "\n" in w else w for w in found]
    return found


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items of each long match.

    Items are joined by separators that occur nowhere else, so no match spans
    two of them.  ``items_at[state]`` holds the items that contain the last
    ``min_words`` words of a match of at least that length ending in ``state``.
    """

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.min_words = min_words
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []
        last = 0
        for k, (item, text) in enumerate(items):
            for w in words_of(text or ""):
                last = self._extend(last, self.number.setdefault(w, len(self.number)))
                ends.append((last, item))
            last = self._extend(last, -1 - k)
        top: dict[int, int] = {}
        sets: dict[int, set[int]] = {}
        for state, item in ends:
            if self.length[state] >= min_words:
                sets.setdefault(self._top(state, top), set()).add(item)
        every: dict[tuple, tuple] = {}
        self.items_at: list[tuple[int, ...]] = []
        for state in range(len(self.next)):
            found = tuple(sorted(sets.get(self._top(state, top), ()))) if self.length[state] >= min_words else ()
            self.items_at.append(every.setdefault(found, found))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            return cur
        q = nxt[p][c]
        if length[q] == length[p] + 1:
            link[cur] = q
            return cur
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = link[cur] = clone
        return cur

    def _top(self, state: int, known: dict[int, int]) -> int:
        """The ancestor that holds the suffix of exactly ``min_words`` words."""
        path = []
        while state not in known:
            parent = self.link[state]
            if parent < 0 or self.length[parent] < self.min_words:
                known[state] = state
                break
            path.append(state)
            state = parent
        for s in path:
            known[s] = known[state]
        return known[state]

    def matches(self, words: list[str]) -> dict[int, list[list[int]]]:
        """Item -> merged word spans [from, to) of the document that the item holds."""
        need, n = self.min_words, len(words)
        found: dict[int, list[list[int]]] = {}
        if n < need:
            return found
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, n)
        edge = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
        nxt, link, length, items_at = self.next, self.link, self.length, self.items_at
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < need:
                continue
            v = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while v and c not in nxt[v]:
                    v = link[v]
                    size = length[v]
                if c in nxt[v]:
                    v = nxt[v][c]
                    size += 1
                if size >= need:
                    # a match may end inside the state's shortest strings; its top ancestor is the same
                    for item in items_at[v]:
                        spans = found.setdefault(item, [])
                        if spans and spans[-1][1] >= i + 1 - need:
                            spans[-1][1] = i + 1
                        else:
                            spans.append([i + 1 - need, i + 1])
        return found


def _blocks(items: DataFrame, item_id: str, passage: str, block_chars: int) -> Iterator[list[tuple]]:
    """Items in blocks of bounded total length."""
    src = items.select(F.col(item_id).alias("i"), F.col(passage).alias("p")).where(F.col("i").isNotNull() & F.col("p").isNotNull())
    total = src.agg(F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(total) // block_chars))
    for k in range(parts):
        block = src if parts == 1 else src.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k)
        yield [(r["i"], r["p"]) for r in block.orderBy("i").toLocalIterator()]


def packed_automata(block: list[tuple], min_words: int, most_bytes: int) -> Iterator[bytes]:
    """The pickled automata of a block, halved until each takes at most ``most_bytes``; only a single item may take more."""
    made = pickle.dumps(SuffixAutomaton(block, min_words), protocol=pickle.HIGHEST_PROTOCOL)
    if len(made) <= most_bytes or len(block) < 2:
        yield made
        return
    del made
    for half in (block[: len(block) // 2], block[len(block) // 2 :]):
        yield from packed_automata(half, min_words, most_bytes)


def leak_spans(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    min_words: int = 13,
    block_chars: int = 2_000_000,
    most_bytes: int = 64_000_000,
) -> DataFrame:
    """One row per document and item that share ``min_words`` consecutive words.

    Columns: item_id, doc_id, spans (array of word ranges from, to), n_shared
    (words in them) and n_words (of the document).

    Items are taken in blocks of ``block_chars`` characters, halved where the
    automaton takes more than ``most_bytes``: each block's automaton is
    broadcast and the corpus is streamed once per block, so any number of items
    is covered.

    Defined cases: null ids are left out; null and empty texts or passages hold
    no words; passages of fewer than ``min_words`` words never match; copies of
    an item are reported each; an empty side gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    d_type, i_type = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    span = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))
    schema = T.StructType([
        T.StructField(item_id, i_type), T.StructField(doc_id, d_type), T.StructField("spans", span),
        T.StructField("n_shared", T.LongType()), T.StructField("n_words", T.LongType()),
    ])
    src = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.col("d").isNotNull() & F.col("t").isNotNull())
    result = None
    for packed in (p for block in _blocks(items, item_id, passage, block_chars) for p in packed_automata(block, min_words, most_bytes)):
        sent = spark.sparkContext.broadcast(packed)

        def run(batches, sent=sent):
            automaton, arrow = pickle.loads(sent.value), None
            for b in batches:
                ids, texts = b.column(0), b.column(1)
                out: list[list] = [[], [], [], [], []]
                for k in range(b.num_rows):
                    words = words_of(texts[k].as_py())
                    for item, spans in sorted(automaton.matches(words).items()):
                        row = (item, ids[k].as_py(), [{"from": x, "to": y} for x, y in spans], sum(y - x for x, y in spans), len(words))
                        for col, v in zip(out, row):
                            col.append(v)
                if arrow is None:
                    from pyspark.sql.pandas.types import to_arrow_type

                    arrow = [to_arrow_type(f.dataType) for f in schema.fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow)], names=schema.names)

        one = spread(src).mapInArrow(run, schema)
        result = one if result is None else result.unionByName(one)
    return result


def without_leaks(docs: DataFrame, leaks: DataFrame, *, doc_id: str = "doc_id", text: str = "text", drop_share: float = 0.5) -> DataFrame:
    """Documents with leaked spans cut out; those with a leaked share above ``drop_share`` are left out.

    ``leaks`` is the result of ``leak_spans``.  Text outside the spans is kept
    byte for byte; documents without a leak are unchanged.  The spans are sent
    to the documents if they are small as stored; beyond that both are shuffled.
    """
    per = small(leaks.groupBy(F.col(doc_id).alias("_d")).agg(F.flatten(F.collect_list("spans")).alias("_s")))
    both = docs.join(per, docs[doc_id] == per["_d"], "left").drop("_d")

    @F.pandas_udf("struct<text:string,share:double>")
    def cut(texts, spans):
        import pandas as pd

        rows = []
        for t, s in zip(texts, spans):
            if s is None or t is None:
                rows.append((t, 0.0))
                continue
            at = [m.span() for m in WORD.finditer(t)]
            gone = np.zeros(len(at), bool)
            for x in s:
                gone[x["from"] : x["to"]] = True
            parts, pos, i = [], 0, 0
            while i < len(at):
                if gone[i]:
                    j = i
                    while j + 1 < len(at) and gone[j + 1]:
                        j += 1
                    parts.append(t[pos : at[i][0]])
                    pos, i = at[j][1], j
                i += 1
            rows.append(("".join([*parts, t[pos:]]), float(gone.mean()) if len(at) else 0.0))
        return pd.DataFrame(rows, columns=["text", "share"])

    done = both.withColumn("_c", F.when(F.col("_s").isNotNull(), cut(F.col(text), F.col("_s"))))
    kept = done.where(F.coalesce(F.col("_c.share") <= drop_share, F.lit(True)))
    return kept.withColumn(text, F.coalesce(F.col("_c.text"), F.col(text))).drop("_c", "_s")
