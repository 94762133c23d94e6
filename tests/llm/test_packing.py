import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from residua.llm.packing import CAPACITIES, VOCABULARY, pack, pack_documents, pack_items, pack_opened, sequence_cost, token_counts

CAPS = (8, 16, 32)


@given(st.lists(st.integers(0, 32), max_size=80))
def test_pack_is_a_packing(sizes):
    bins, offset, caps = pack(sizes, CAPS)
    for b, cap in enumerate(caps):
        own = sorted((offset[i], sizes[i]) for i in range(len(sizes)) if bins[i] == b)
        end = 0
        for o, s in own:
            assert o == end
            end = o + s
        assert cap in CAPS and end <= cap
        assert cap == min(c for c in CAPS if c >= end)
    assert set(bins) == set(range(len(caps)))


def test_little_room_is_left():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 33, 5000).tolist()
    _, _, caps = pack(sizes, CAPS)
    assert sum(sizes) / sum(caps) > 0.98


def test_capacities_are_chosen_jointly():
    """Several capacities are opened, and they cost less than the largest alone, at next to no unused room."""
    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.lognormal(6.2, 0.9, 20_000).astype(int), 2048).tolist()
    cost = lambda caps: sum(map(sequence_cost, caps)) / sum(sizes)
    _, _, alone, _ = pack_opened(sizes, (2048,))
    _, _, final, opened = pack_opened(sizes, CAPACITIES)
    assert len({c for c in opened if opened.count(c) > 20}) >= 3
    assert cost(final) < cost(alone) * 0.99 and sum(sizes) / sum(final) > 0.995
    # where only unused room counts, as little is left as by the largest capacity alone
    assert sum(pack(sizes, CAPACITIES, float("inf"))[2]) <= sum(alone) * 1.001


def test_pieces_cover_every_item_once(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(700), "size": rng.integers(0, 100, 700), "piece": "clash", "bin_id": 1})
    out = pack_items(spark.createDataFrame(pdf), item_id="id", size="size", capacities=CAPS, group_items=100).toPandas()
    whole = out.sort_values(["id", "piece"]).groupby("id").agg(n=("n_tokens", "sum"), k=("piece", "size"), last=("start", "last"))
    assert (whole["n"].reindex(pdf["id"]).to_numpy() == pdf["size"].to_numpy()).all()
    assert (whole["k"].to_numpy() == np.maximum(1, -(-pdf["size"].to_numpy() // 32))).all()
    bins = out.groupby("bin_id").agg(used=("n_tokens", "sum"), cap=("bin_capacity", "first"))
    assert (bins["used"] <= bins["cap"]).all()


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (None, 5), (2, 0)], "id long, size long")
    assert pack_items(df, item_id="id", size="size", capacities=CAPS).count() == 4
    assert pack_items(df.where("false"), item_id="id", size="size").count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_documents(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None), (4, "word " * 40_000), (1, "one two three"), (5, "x" * 20_000)], "doc_id long, text string")
    n = [(r["doc_id"], r["n_tokens"]) for r in token_counts(df).collect()]
    assert sorted(n)[0] == (1, 3) and len(n) == 6 and dict(n)[2] == 0 and dict(n)[3] == 0 and dict(n)[4] >= 40_000
    out = pack_documents(df).toPandas()
    assert out.groupby("doc_id")["n_tokens"].sum()[4] == dict(n)[4] and out["n_tokens"].max() <= 2048
