import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from residua.llm.leakage import packed_automata, SuffixAutomaton, leak_spans, without_leaks, words_of

WORDS = [f"w{i}" for i in range(60)]
PASSAGE = " ".join(WORDS[:30])


def brute(items, words, need):
    out = {}
    for item, text in items:
        w = words_of(text)
        grams = {tuple(w[i : i + need]) for i in range(len(w) - need + 1)}
        hit = [i for i in range(len(words) - need + 1) if tuple(words[i : i + need]) in grams]
        covered = np.zeros(len(words) + 1, bool)
        for i in hit:
            covered[i : i + need] = True
        if hit:
            out[item] = int(covered.sum())
    return out


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text("ab ", max_size=60), max_size=5), st.text("abc ", max_size=120), st.integers(1, 5))
def test_automaton_against_brute_force(texts, doc, need):
    items = list(enumerate(" ".join(t.replace(" ", "")) for t in texts))
    words = list(doc.replace(" ", ""))
    got = {i: sum(b - a for a, b in s) for i, s in SuffixAutomaton(items, need).matches(words).items()}
    assert got == brute(items, words, need)


def test_words():
    assert words_of("The Judg-\nment, the JUDG-\r\nMENT; a_b ok-\n- Straße") == ["the", "judgment", "the", "judgment", "a", "b", "ok", "strasse"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_found_in_any_shape(spark):
    part = WORDS[8:21]
    d = docs(spark, "before " + PASSAGE + " after", "x " + ", ".join(w.upper() for w in part) + " y", " ".join(part[:-1]), None, "", "“A” " + "\n".join(part).replace("w10", "w1-\n0"), PASSAGE)
    items = spark.createDataFrame([(7, PASSAGE, "s"), (8, " ".join(WORDS[:12]), "s"), (9, None, "s"), (10, PASSAGE, "s")], "item_id long, passage string, text string")
    got = {(r["item_id"], r["doc_id"]) for r in leak_spans(d, items).collect()}
    assert got == {(i, k) for i in (7, 10) for k in (1, 2, 6, 7)}
    assert got == {(r["item_id"], r["doc_id"]) for r in leak_spans(d, items, block_chars=60).collect()}
    assert leak_spans(d.where("false"), items).count() == 0 and leak_spans(d, items.where("false")).count() == 0


def test_spans_are_cut_out(spark):
    text = "Keep this. " + PASSAGE + " And this, too: " + " ".join(f"z{i}" for i in range(40))
    d = docs(spark, text, PASSAGE, "clean text", None)
    items = spark.createDataFrame([(7, PASSAGE)], "item_id long, passage string")
    left = {r["doc_id"]: r["text"] for r in without_leaks(d, leak_spans(d, items)).collect()}
    assert left[1] == text.replace(PASSAGE, "") and left[3] == "clean text" and left[4] is None and 2 not in left


def test_very_long_text(spark):
    d = docs(spark, "filler " * 200_000 + PASSAGE)
    items = spark.createDataFrame([(7, PASSAGE)], "item_id long, passage string")
    r = leak_spans(d, items).first()
    assert r["n_shared"] == 30 and r["spans"][0]["from"] == 200_000


def test_blocks_are_halved_to_the_byte_limit(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(16)]
    whole = next(packed_automata(items, 13, 10**9))
    parts = list(packed_automata(items, 13, len(whole) // 3))
    assert len(parts) >= 4 and all(len(p) <= len(whole) // 3 for p in parts)
    assert len(list(packed_automata(items[:1], 13, 1))) == 1
    docs = spark.createDataFrame([(1, items[3][1] + " and " + items[11][1]), (2, "nothing of the kind")], "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, passage string")
    got = {(r["item_id"], r["doc_id"], r["n_shared"]) for r in leak_spans(docs, frame, most_bytes=len(whole) // 3).collect()}
    assert got == {(3, 1, 30), (11, 1, 30)}
