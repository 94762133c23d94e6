"""Pages made of repeated keywords, links or tags instead of sentences.

Three signs are taken for every word of a text, in windows of lags around it:

- recurrence gaps: terms, pairs and key phrases that come back often and at
  short gaps are keywords;
- positional autocorrelation: the share of words that are met again exactly k
  words on, for every lag k of the window.  Prose has next to none at any lag,
  lists and stuffed lines have much, and regular ones have it at one lag;
- function words: prose has many, lists have none.  Long lists of short,
  distinct entries without function words count even if no term recurs.

Words of links, markup and tags are known by their form.  A batch of texts is
analysed at once, in arrays over all its words; every text is read whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.session import spread

# --- fixed values: function words of the corpus languages, currency codes --------------------
FUNCTION_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it its
    may might more must my not of on or our shall she should so such than that the their them there these they this those to under upon was we were what when
    where whether which who whom will with would you your
    aber als am an auch auf aus bei bis das dass dem den der des die dies diese dieser doch durch ein eine einem einen einer eines er es für gegen hat hatte
    haben ich ihm ihr im in ist kann kein keine mit nach nicht noch nur ob oder sei sein seine sich sie sind so soweit über um und unter vom von vor war waren
    wäre wegen weil wenn werden wie wird wurde zu zum zur zwischen
    à au aucun aucune aux avec ce ces cette comme dans de des du elle en entre est et était être il ils je l la le les leur lieu lui mais n ne ni nous on ont
    ou où par pas pour qu que qui sa sans se ses si son soit sont sous sur tout un une vous y a ait d c s
    """.split()
)
CURRENCIES = frozenset("aud cad chf dkk eur gbp jpy nok nzd pln sek usd".split())
# -----------------------------------------------------------------------------

#: words on either side of a position
REACH = 12
#: lags of the autocorrelation
LAGS = range(1, 65)
#: share of keywords, links and tags that makes a window a list, and the share of function words that it may have
MARKED, FUNCTION = 0.28, 0.2
#: autocorrelation over all lags that a window of keywords has at least, and at one lag where it is a list by itself
ECHO, BEAT = 0.15, 0.3
#: share of plain numbers that a list of keywords may have; registers and citations have more
NUMBERS = 0.2
PAIR_COUNT, PAIR_GAP = 4, 150
TERM_COUNT, TERM_GAP = 6, 14
#: words an entry, entries a line, words an entry on average and function words of a list whose terms do not recur; single words may be goods
LIST_ENTRY, DISTINCT_ENTRIES, DISTINCT_WORDS, DISTINCT_FUNCTION = 4, 12, 1.4, 0.04
#: a line of a catalogue holds a price and is no longer than this; so many lines make a catalogue
CATALOGUE_WORDS, CATALOGUE_LINES = 16, 3
#: lines of more words are judged word by word
LONG_LINE = 80
#: characters analysed at once; a longer text is a batch of its own
BATCH_CHARS = 1_000_000

ALNUM, DIGIT, SPACE, BREAK, ENTRY, STOP, CURRENCY = 1, 2, 4, 8, 16, 32, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class bits of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        out[i] = ALNUM * c.isalnum() | DIGIT * c.isdigit() | SPACE * c.isspace() | BREAK * (c in "\n\r") | ENTRY * (c in ",;|·•>\t") | STOP * (c in ".!?:") | CURRENCY * (c in "$€£¥")
    return out


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, inverse))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _hashes(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit number of each word, equal for equal words."""
    n = 1 << max(10, int(len(chars)).bit_length())
    up, down = _powers(n)
    run = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(_mixed(chars.astype(np.uint64)) * up[: len(chars)], out=run[1:])
    return (run[end] - run[start]) * down[start]


@lru_cache(2)
def _word_hashes(words: frozenset[str]) -> np.ndarray:
    text = " ".join(sorted(words))
    ends = np.cumsum([len(w) + 1 for w in sorted(words)]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return np.sort(_hashes(np.frombuffer(text.encode("utf-32-le"), "<u4"), starts, ends))


def _one_of(code: np.ndarray, words: frozenset[str]) -> np.ndarray:
    known = _word_hashes(words)
    return known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code


def _window_sum(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, np.int32)
    np.cumsum(x, out=c[1:])
    return c[right] - c[left]


def _recurrent(key: np.ndarray, valid: np.ndarray, count: int, gap: float) -> np.ndarray:
    """Positions whose key recurs at least ``count`` times with a median gap of at most ``gap``."""
    hit = np.zeros(len(key), bool)
    at = np.flatnonzero(valid)
    if len(at) < count:
        return hit
    order = at[np.argsort(key[at], kind="stable")]
    k = key[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[first, len(k)])
    often = size >= count
    order = order[np.repeat(often, size)]
    size = size[often]
    if not len(size):
        return hit
    group = np.repeat(np.arange(len(size)), size)
    last = np.cumsum(size) - 1
    gaps = np.delete(np.diff(order, append=0), last)  # within a group; size - 1 of each
    of = np.delete(group, last)
    gaps = gaps[np.lexsort((gaps, of))]
    middle = np.cumsum(size - 1) - (size - 1) + (size - 2) // 2
    upper = np.cumsum(size - 1) - (size - 1) + (size - 1) // 2
    hit[order[((gaps[middle] + gaps[upper]) / 2 <= gap)[group]]] = True
    return hit


def _spam_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words that belong to keyword, link or tag lists, all words) of each text."""
    docs = len(texts)
    lowered = [t.lower() for t in texts]
    joined = "\n".join(lowered)
    chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    cls = _classes()[chars]
    alnum = np.zeros(len(chars) + 2, np.int8)
    alnum[1:-1] = cls & ALNUM
    edge = np.diff(alnum)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(start)
    if not n:
        return np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), start, side="right")
    words = np.bincount(doc, minlength=docs)
    code = _hashes(chars, start, end)
    is_function = _one_of(code, FUNCTION_WORDS)
    upto = lambda bits: np.r_[np.int32(0), np.cumsum(bits, dtype=np.int32)]
    digits = upto(cls & DIGIT != 0)
    is_digit = digits[end] - digits[start] == end - start
    # what stands between a word and the next: breaks, spaces, list marks
    nxt = np.r_[start[1:], len(chars)]
    between = lambda c: c[nxt] - c[end]
    broken, spaced, entry = between(upto(cls & BREAK != 0)) > 0, between(upto(cls & SPACE != 0)), between(upto(cls & ENTRY != 0)) > 0
    line = np.r_[0, np.cumsum(broken[:-1])]
    chunk = np.r_[0, np.cumsum(spaced[:-1] > 0)]
    lines = int(line[-1]) + 1

    # links, markup and tags by their form: a chunk without spaces that holds a host name, two slashes or a bracket, or begins with a number sign
    long_word = end - start > 1
    dotted = np.zeros(n, bool)
    dotted[1:] = (nxt[:-1] - end[:-1] == 1) & (chars[np.minimum(end[:-1], len(chars) - 1)] == ord(".")) & long_word[:-1] & long_word[1:] & (digits[end[1:]] == digits[start[1:]])
    slashes = np.zeros(len(chars), bool)
    slashes[1:] = (chars[1:] == ord("/")) & (chars[:-1] == ord("/"))
    before = np.r_[0, end[:-1]]
    marks = upto(slashes | (chars == ord("<")))
    before_char = chars[np.maximum(start - 1, 0)]
    letter = ~(cls[start] & DIGIT).astype(bool)
    sign = (start > 0) & (marks[start] > marks[before]) & (cls[np.maximum(start - 1, 0)] & SPACE == 0)
    tag = (start > 0) & (before_char == ord("#")) & letter
    formed = np.bincount(chunk, dotted | sign | tag)[chunk] > 0
    # prices: a number with two decimals next to a currency; enough short lines that hold one make a catalogue
    count = np.bincount(line, minlength=lines)
    decimals = np.zeros(n, bool)
    decimals[1:] = is_digit[1:] & is_digit[:-1] & (end[1:] - start[1:] == 2) & (nxt[:-1] - end[:-1] == 1)
    money = _one_of(code, CURRENCIES)
    coin = between(upto(cls & CURRENCY != 0)) > 0
    near = np.zeros(n, bool)
    near[2:] |= money[:-2] | coin[:-2]
    near[:-1] |= money[1:]
    near |= coin
    priced = (np.bincount(line, decimals & near, lines) > 0) & (count <= CATALOGUE_WORDS)
    line_doc = np.zeros(lines, np.int64)
    line_doc[line] = doc
    catalogue = priced & (np.bincount(line_doc, priced, docs) >= CATALOGUE_LINES)[line_doc]
    formed |= catalogue[line]

    # recurrence gaps of terms, pairs and phrases, each within its text
    own = code ^ _mixed(doc.astype(np.uint64) + np.uint64(1))
    usable = ~is_function & ~is_digit
    same = doc[:-1] == doc[1:]
    marked = formed | _recurrent(own, usable, TERM_COUNT, TERM_GAP)
    if n > 1:
        pair = _mixed(own[:-1]) + code[1:]
        hit = _recurrent(pair, usable[:-1] & usable[1:] & same, PAIR_COUNT, PAIR_GAP)
        marked[:-1] |= hit
        marked[1:] |= hit
    if n > 2:  # key phrases around a function word
        three = _mixed(pair[:-1]) + code[2:]
        hit = _recurrent(three, usable[:-2] & is_function[1:-1] & usable[2:] & same[:-1] & same[1:] & ~broken[:-2] & ~broken[1:-1], PAIR_COUNT, PAIR_GAP)
        for k in range(3):
            marked[k : n - 2 + k] |= hit

    # short entries that recur as a whole, function words included
    cut = broken | entry | (between(upto(cls & STOP != 0)) > 0)
    cut[:-1] |= ~same
    opens = np.flatnonzero(np.r_[True, cut[:-1]])
    size = np.diff(np.r_[opens, n])
    place = np.arange(n) - np.repeat(opens, size)
    whole = np.add.reduceat(_mixed(own + place.astype(np.uint64) * _BASE), opens)
    key = np.zeros(n, np.uint64)
    key[opens] = whole
    fits = np.zeros(n, bool)
    fits[opens] = (size <= LIST_ENTRY) & (np.add.reduceat(usable.astype(np.int64), opens) > 0)
    marked |= np.repeat(_recurrent(key, fits, PAIR_COUNT, PAIR_GAP)[opens], size)

    # windows end at the text's ends
    first = np.cumsum(words) - words
    at = np.arange(n)
    left = np.maximum(at - REACH, first[doc])
    right = np.minimum(at + REACH + 1, (first + words)[doc])
    width = right - left
    echo, beat = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for k in LAGS:
        if k >= n:
            break
        met = np.zeros(n, bool)
        met[:-k] = (own[k:] == own[:-k]) & usable[:-k]
        if met.any():
            s = _window_sum(met, left, right)
            echo += s
            np.maximum(beat, s, out=beat)
    speaks = is_function & ~marked
    function_share = _window_sum(speaks, left, right) / np.maximum(_window_sum(~is_digit | marked, left, right), 1)
    share, linked = _window_sum(marked, left, right) / width, _window_sum(formed, left, right) / width
    echo, beat = echo / width, beat / width
    numbers = _window_sum(is_digit & ~marked, left, right) / width
    worded = ((share >= MARKED) & (echo >= ECHO) | (beat >= BEAT)) & (numbers <= NUMBERS)
    spam = (worded | (linked >= MARKED)) & (function_share <= FUNCTION)

    # whole lines by the majority of their words; long lists of short, distinct entries without function words
    of_line = np.bincount(line, spam, lines) / count
    of_line[np.bincount(line, marked | (beat >= BEAT), lines) < MARKED / 2 * count] = 0.0  # a sentence between lists
    entries = np.bincount(line, entry & ~broken, lines) + 1
    bare = np.bincount(line, speaks, lines) <= DISTINCT_FUNCTION * count
    distinct = bare & (entries >= DISTINCT_ENTRIES) & (count <= LIST_ENTRY * entries) & (count >= DISTINCT_WORDS * entries)
    of_line[distinct] = 1.0
    taken = np.where((count <= LONG_LINE)[line], of_line[line] >= 0.5, spam | (of_line[line] >= 0.9))
    return np.bincount(doc, taken, docs).astype(np.int64), words


def spam_counts(texts: list[str | None]) -> list[tuple[int, int]]:
    """(words that belong to keyword, link or tag lists, all words) of each text."""
    out: list[tuple[int, int]] = []
    batch: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        batch.append(t or "")
        size += len(batch[-1])
        if size >= BATCH_CHARS or i == len(texts) - 1:
            out += zip(*(a.tolist() for a in _spam_batch(batch)))
            batch, size = [], 0
    return out


def spam_words(text: str) -> tuple[int, int]:
    return spam_counts([text])[0]


def spam_shares(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", above: float | None = None) -> DataFrame:
    """(doc_id, spam_words, n_words, spam_share), of all documents or of those with a share above ``above``.

    Defined cases: null and empty texts and texts without words have 0 words
    and share 0; copies are judged each; an empty table gives an empty result;
    other columns are ignored; texts of any length are read whole.
    """
    src = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    schema = T.StructType([
        T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("spam_words", T.LongType()),
        T.StructField("n_words", T.LongType()), T.StructField("spam_share", T.DoubleType()),
    ])

    def run(batches):
        for b in batches:
            got = spam_counts(b.column(1).to_pylist())
            share = [a / n if n else 0.0 for a, n in got]
            out = pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([a for a, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64()), pa.array(share, pa.float64())],
                names=schema.names,
            )
            if above is not None:
                out = out.take(pa.array([i for i, s in enumerate(share) if s > above], pa.int64()))
            yield out

    return spread(src).mapInArrow(run, schema)
