"""Items of varying length packed into containers of a few permitted capacities.

Variable-capacity best fit: items in falling order of size go to the open bin
with the least room that still takes them.  If none does, a bin is opened.  Its
capacity is chosen among all permitted ones by the least cost per token that it
is expected to hold.  A sequence of c tokens costs c + c*c/balance, as the work
of attention grows with its square and all other work with its length; what the
bin will hold is the item and its share of the items still to come that fit
into the rest, as all open bins compete for these.  In the end every bin is cut
down to the least permitted capacity that holds it.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.session import spread

CAPACITIES = (256, 512, 1024, 2048)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: length at which the quadratic part of a sequence's cost equals the linear one
BALANCE = 8192.0
#: the splitting pattern of the byte-level vocabulary (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoder(path: str):
    """The tokenizer of this worker process; loaded once per process."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_residua_encoders", {})
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        kept[path] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null and empty texts have 0 tokens."""
    src = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType())])

    # the file goes to every executor with the job; it need not be there
    if os.path.exists(vocabulary):
        docs.sparkSession.sparkContext.addFile(vocabulary)

    def run(batches):
        shipped = SparkFiles.get(os.path.basename(vocabulary))
        enc = _encoder(shipped if os.path.exists(shipped) else vocabulary)
        for b in batches:
            texts = b.column(1)
            n = [len(enc.encode_ordinary(s)) if (s := texts[i].as_py()) else 0 for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=schema.names)

    return spread(src).mapInArrow(run, schema)


def sequence_cost(capacity: int, balance: float = BALANCE) -> float:
    return capacity + capacity * capacity / balance


def pack_opened(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, balance: float = BALANCE) -> tuple[list[int], list[int], list[int], list[int]]:
    """(bin of each item, offset of each item in its bin, final capacity of each bin, capacity at which it was opened).

    No size may exceed the largest capacity.  ``balance`` may be infinite: then
    only unused room counts.
    """
    caps = sorted(capacities)
    price = {c: sequence_cost(c, balance) for c in caps}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    # tokens of the items from a place of the order on; those of size r at most begin where falling sizes pass r
    falling = [-sizes[i] for i in order]
    after = [0] * (len(order) + 1)
    for k in range(len(order) - 1, -1, -1):
        after[k] = after[k + 1] - falling[k]
    bin_of, offset = [0] * len(sizes), [0] * len(sizes)
    used: list[int] = []
    opened: list[int] = []
    rooms: list[int] = []  # distinct rooms of open bins, rising
    open_at: dict[int, list[int]] = {}
    open_room = 0
    for k, i in enumerate(order):
        s = sizes[i]
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            stack = open_at[room]
            b = stack.pop()
            if not stack:
                del open_at[room]
                rooms.pop(at)
            open_room -= s
        else:
            best = None
            for c in caps:
                if c >= s:
                    rest = c - s
                    to_come = after[max(k + 1, bisect_left(falling, -rest))]
                    held = s + rest * min(1.0, to_come / (open_room + rest)) if rest else s
                    cost = price[c] / max(held, 1e-9)
                    if best is None or cost <= best[0]:
                        best = cost, c
            room = best[1]
            b = len(used)
            used.append(0)
            opened.append(room)
            open_room += room - s
        bin_of[i], offset[i] = b, used[b]
        used[b] += s
        left = room - s
        if left in open_at:
            open_at[left].append(b)
        else:
            open_at[left] = [b]
            insort(rooms, left)
    final = [next(c for c in caps if c >= u) for u in used]
    return bin_of, offset, final, opened


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, balance: float = BALANCE) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, offset of each item in its bin, capacity of each bin)."""
    return pack_opened(sizes, capacities, balance)[:3]


def pack_items(
    items: DataFrame, *, item_id: str, size: str, capacities: tuple[int, ...] = CAPACITIES, group_items: int = 50_000, balance: float = BALANCE, expected: int | None = None
) -> DataFrame:
    """One row per piece: item_id, piece (from 0), start and n_tokens in the item, bin_id, bin_offset, bin_capacity, bin_opened.

    ``bin_opened`` is the capacity at which the bin was opened, ``bin_capacity``
    the one that it was cut down to.

    An item longer than the largest capacity is cut at multiples of it and only
    then; every other item stays whole.  Items are spread by a hash over groups
    of about ``group_items`` that are packed apart, so no task grows with the
    table; what a group leaves open at its end is cut down to its contents.
    ``expected`` is the number of items where it is known more cheaply than by
    counting ``items``.

    Defined cases: a null size counts as 0; items of size 0 get a bin, too, and
    take no room; negative sizes raise an error in the worker; null ids are
    items; an empty table gives an empty result; other columns are ignored.
    """
    top = max(capacities)
    n = expected if expected is not None else items.count()
    groups = max(1, -(-n // group_items))
    id_type = items.schema[item_id].dataType.simpleString()
    src = items.select(F.col(item_id).alias("i"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")).withColumn(
        "g", F.pmod(F.xxhash64("i"), F.lit(groups)).cast("int")
    )

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "i"], ascending=[False, True], kind="stable")
        size_of = pdf["n"].to_numpy(np.int64)
        if len(size_of) and size_of.min() < 0:
            raise ValueError("an item has a negative size")
        pieces = np.maximum(1, -(-size_of // top))
        at = np.repeat(np.arange(len(pdf)), pieces)
        no = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = no * top
        length = np.minimum(size_of[at] - start, top)
        bins, offset, caps, opened = pack_opened(length.tolist(), capacities, balance)
        return pd.DataFrame({
            "i": pdf["i"].to_numpy()[at], "piece": no, "start": start, "n_tokens": length,
            "bin_id": [f"{key[0]}-{b}" for b in bins], "bin_offset": offset, "bin_capacity": [caps[b] for b in bins], "bin_opened": [opened[b] for b in bins],
        })

    out = f"i {id_type}, piece int, start long, n_tokens long, bin_id string, bin_offset long, bin_capacity int, bin_opened int"
    return src.groupBy("g").applyInPandas(one, out).withColumnRenamed("i", item_id)


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, **how) -> DataFrame:
    """``pack_items`` of the documents' token counts."""
    counts = token_counts(docs, doc_id=doc_id, text=text, vocabulary=vocabulary)
    return pack_items(counts, item_id=doc_id, size="n_tokens", expected=docs.count(), **how)
