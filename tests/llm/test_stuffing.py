import random

import pytest

from residua.llm import stuffing
from residua.llm.stuffing import spam_counts, spam_shares, spam_words

PROSE = (
    "The court held that the notice served on the tenant was of no effect, because it had not been signed by the landlord in the manner that the lease required. "
    "It was argued for the appellant that the defect had been waived, but there is nothing in the letters of the parties to show that either of them had that in mind. "
)
PHRASES = ["cheap flights", "garden furniture", "loan advice", "car insurance", "hotel deals"]
PLACES = ["Aston", "Bergen", "Calder", "Dorne", "Elm"]


def listed(sep, n=60):
    return sep.join(f"{PHRASES[(i * 7) % 5]} {PLACES[(i * 3) % 5]}" for i in range(n))


SPAM = {
    "phrases": " ".join(PHRASES[(i * i) % 3] for i in range(80)),
    "upper and lower": " ".join(PHRASES[i % 2].upper() if i % 3 else PHRASES[i % 2] for i in range(80)),
    "commas": listed(", "),
    "lines": listed("\n"),
    "slogans": " ".join(f"Best {PHRASES[i % 3]} in {PLACES[i % 5]}. Call {PHRASES[(i + 1) % 3]} {PLACES[i % 4]} now!" for i in range(30)),
    "links": "\n".join(f"https://www.shop{i}.test/{PHRASES[i % 5].replace(' ', '-')}/{i}" for i in range(40)),
    "hosts": "\n".join(f"deal{i}.example" for i in range(40)),
    "markdown": "\n".join(f"* [{PHRASES[i % 5]} {PLACES[i % 5]}](https://deal{i}.test/{i})" for i in range(40)),
    "anchors": "\n".join(f'<li><a href="//deal{i}.test/x">{PHRASES[i % 5]}</a></li>' for i in range(40)),
    "tags": " ".join(f"#{PHRASES[i % 5].title().replace(' ', '')}{i % 3}" for i in range(50)),
    "key phrase with a function word": PROSE + "\n" + " | ".join(["will writing"] * 350),
    "catalogue": "\n".join(f"SKU-{1000 + i} oak {PHRASES[i % 5]}, EUR {i + 3}.99 in stock" for i in range(30)),
}
HEADS, TAILS = ["Al", "Bar", "Cor", "Den", "Est", "Fal", "Gil", "Har", "Ist", "Jor"], ["ander", "bury", "cott", "dale", "ell", "ford", "gate", "ham", "isch", "ley"]
COURTS = ["K.C.R.", "W.H.R.", "Ost. Rep.", "App. Dec.", "C.B.D.", "Nov. R."]
WARES = "flour gloves honey rice books harness coffee soaps toys candles tents umbrellas belts games shirts scarves tea beers lamps nets hats inks saddles papers ropes".split()


def party(i):
    """Names of parties, a hundred of them in no fixed order."""
    return HEADS[i * 7 % 10] + TAILS[(i * i + i // 10) % 10]


FINE = {
    "prose": PROSE * 10,
    "citations": PROSE * 2 + "Authorities cited:\n" + "\n".join(f"{party(i)} v. {party(3 * i + 1)} [{1960 + i}] {i % 9 + 1} {COURTS[i * 5 % 6]} {100 + 7 * i}" for i in range(60)),
    "hearings": PROSE * 2 + "List:\n" + "\n".join(f"{party(i)} v {party(3 * i + 1)} Holdings, courtroom {i * 3 % 19}, {9 + i * 5 % 7}.30" for i in range(60)),
    "parties": PROSE * 2 + "Appellants:\n" + "\n".join(f"({i}) {party(i)} & {party(3 * i + 1)} Ltd" for i in range(60)),
    "pleadings": PROSE + "Pleadings:\n" + "\n".join(f"The allegation in paragraph {i} is denied." for i in range(60)),
    "goods": PROSE * 2 + "Class 25:\n" + "; ".join(", ".join(WARES[(i * i + 7 * k + i * k) % 25] for k in range(3)) for i in range(20)),
    "short": "Appeal dismissed.",
    "empty": "",
    "signs": "?! -- ...",
}


@pytest.mark.parametrize("kind", SPAM)
def test_spam(kind):
    a, n = spam_words(SPAM[kind])
    assert a > 0.5 * n


@pytest.mark.parametrize("kind", FINE)
def test_not_spam(kind):
    a, n = spam_words(FINE[kind])
    assert a <= 0.5 * n


def test_nothing_hides_a_list():
    """Marks of case names in every line, or a heading of goods, change nothing."""
    lines = [f"{PHRASES[(i * 7) % 5]} {PLACES[(i * 3) % 5]}" for i in range(60)]
    a, n = spam_words("\n".join(lines))
    b, m = spam_words("\n".join(f"{x} v. {y}" for x, y in zip(lines, lines[1:] + lines[:1])))
    assert a > 0.9 * n and b > 0.9 * m
    a, n = spam_words("Class 25:\n" + ", ".join(lines))
    assert a > 0.9 * n


def test_autocorrelation_decides(monkeypatch):
    """Keywords that come back at one lag, too far apart for the gaps and never in equal pairs; and stuffed pages need their echo."""
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "sto", "ven", "dal", "bri")]
    regular = " ".join(f"{words[i % 20]} {party(i)}{i}" for i in range(400))
    a, n = spam_words(regular)
    assert a > 0.9 * n
    rng = random.Random(3)
    irregular = " ".join(f"{words[rng.randrange(20)]} {party(i)}{i}" for i in range(400))
    assert spam_words(irregular)[0] < 0.1 * n
    monkeypatch.setattr(stuffing, "LAGS", range(0))
    assert spam_words(regular)[0] == 0 and spam_words(SPAM["phrases"])[0] == 0


def test_texts_of_one_batch_do_not_touch(monkeypatch):
    texts = [t for pair in zip(SPAM.values(), list(FINE.values()) * 2) for t in pair] + [None, "", PROSE]
    alone = [spam_words(t) for t in texts]
    assert spam_counts(texts) == alone
    monkeypatch.setattr(stuffing, "BATCH_CHARS", 1000)
    assert spam_counts(texts) == alone
    assert spam_counts([]) == []


def test_share_follows_the_mixture():
    spam = listed(", ", 200)
    some, n = spam_words(PROSE * 12 + "\n" + listed(", ", 60))
    assert some / n < 0.5
    much, m = spam_words(PROSE * 2 + "\n" + spam)
    assert 0.6 < much / m < 0.95


def test_table(spark):
    rows = [(1, SPAM["commas"]), (2, None), (3, ""), (4, FINE["prose"]), (1, SPAM["commas"]), (5, "spam words " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as d")
    assert sorted(r["doc_id"] for r in spam_shares(df, above=0.5).collect()) == [1, 1, 5]
    every = spam_shares(df)
    assert every.count() == 6 and every.where("doc_id = 2").first()["spam_share"] == 0.0
    assert spam_shares(df.where("false")).count() == 0
