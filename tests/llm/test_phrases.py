"""Collocations against plain counting; the summary's guarantee; exact scores of large counts."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilia.llm import collocations as co

SCHEMA = "lang string, text string, phrase string, n int"


def slow_counts(docs, longest):
    out, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                out.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    return out, total


def slow(docs, longest=3, threshold=10, contained=50, top=2000):
    f, total = slow_counts(docs, longest)
    phrases = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= threshold}
    rows = []
    for (lang, words), a in phrases.items():
        if any(l2 == lang and len(w2) > len(words) and 100 * a2 >= contained * a and any(w2[i : i + len(words)] == words for i in range(len(w2))) for (l2, w2), a2 in phrases.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        rows.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], total[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return sorted(out)


def odd_docs(seed, rows=400):
    rnd = random.Random(seed)
    words = ["a", "B", "b", "É", "é", "漢字", "don't", "x-y", "\x00", "🙂", "LONG" * 50] + [f"w{i}" for i in range(12)]
    gap = lambda: rnd.choice([" "] * 12 + ["  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "\x0b", "\x0c", "! ", " "])
    docs = [(rnd.choice([None, "en", "en", "und", "", "fr"]), "".join(rnd.choice(words) + gap() for _ in range(rnd.randint(0, 40)))) for _ in range(rows)]
    return docs + [("en", None), ("en", ""), (None, None), ("xx", "..."), ("en", "same words here again")] + [("de", "the very same row")] * 15


def columns(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("longest,threshold,contained,top", [(3, 10, 50, 2000), (4, 3, 30, 7), (2, 1, 50, 50)])
def test_against_plain_counting(spark, longest, threshold, contained, top):
    docs = odd_docs(longest)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(6)
    assert columns(co.collocations(df, longest, threshold, contained, top)) == slow(docs, longest, threshold, contained, top)


def test_many_partitions(spark):
    docs = odd_docs(9, 900)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(7)
    got = {(r["lang"], r["phrase"]): r["count"] for r in co.phrase_counts(df, part_mass=500).collect() if r["words"]}
    want, _ = slow_counts(docs, 3)
    assert got == {(lang, " ".join(w)): n for (lang, w), n in want.items() if n >= 10}


def test_nothing(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert co.collocations(spark.createDataFrame([("en", None, "", 1), ("en", ". ,", "", 1)], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=40), max_size=12), st.integers(1, 12))
def test_frequent_prints_survive(blocks, threshold):
    """Whatever the order of blocks, all that reach the threshold stay, and the counters never exceed the capacity."""
    cut = [{p: min(c, threshold) for p, c in b} for b in blocks]
    summary = co.Summary(sum(sum(b.values()) for b in cut) // threshold + 1)
    for b in cut:
        prints = np.array(sorted(b), np.uint32)
        summary.merge(prints, np.array([b[int(p)] for p in prints], np.int64))
        assert len(summary.prints) <= summary.capacity
    total = Counter()
    for b in cut:
        total.update(b)
    reach = set(summary.reaching(threshold).tolist())
    assert {p for p, c in total.items() if c >= threshold} <= reach
    assert summary.taken < threshold
    assert all(total[p] + summary.taken >= threshold for p in reach)


def test_capacity_bounds_hapaxes():
    """A partition of a million prints that occur once, with a few frequent ones among them."""
    rng, threshold, often = np.random.default_rng(1), 10, np.arange(7, 70, 9, dtype=np.uint32)
    prints = rng.integers(100, 2**32, 1_000_000, dtype=np.uint32)
    blocks = [np.unique(np.concatenate([p, often])) for p in np.split(prints, 20)]
    summary = co.Summary(sum(map(len, blocks)) // threshold + 1)
    for b in blocks:
        summary.merge(b, np.ones(len(b)))
    assert summary.taken > 0 and len(summary.prints) <= summary.capacity < 101_000
    assert set(often.tolist()) <= set(summary.reaching(threshold).tolist()) and len(summary.reaching(threshold)) < 1000


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**32 - 1), max_size=50))
def test_packed_prints(prints):
    array = np.array(sorted(prints), np.uint32)
    counts = np.arange(len(array)) % 65536
    back = co.unpacked(co.packed(array, counts))
    assert back[0].tolist() == array.tolist() and back[1].tolist() == counts.tolist()


def test_pieces_cut_only_where_a_piece_ends():
    for data in (b"ab cd. ef gh, ij" * 50, b"x" * 300, b"", b"...", b"no end " * 30 + b"." + b"more " * 30):
        parts = list(co.pieces(data, 64))
        assert b"".join(parts) == data and all(p[-1:] in b".,;:!?\n" for p in parts[:-1])


def test_scores_beyond_64_bits(spark):
    a, left, right = 3 * 10**14 + 7, 5 * 10**14 + 11, 4 * 10**14 + 1
    rows = [("en", 2, "p q", a), ("en", 1, "p", left), ("en", 1, "q", right), ("en", 0, "", 10**15), ("en", 2, "p p", left - 1), ("en", 2, "q q", right)]
    out = {r["phrase"]: r for r in co.ranked(spark.createDataFrame(rows, "lang string, words int, phrase string, count long")).collect()}
    exact = lambda x, l, r: int(Fraction(1000000 * x * x, l * r))
    assert out["p q"]["score"] == exact(a, left, right) and out["p p"]["score"] == exact(left - 1, left, left) == 999999
    assert out["q q"]["score"] == 1000000 and out["q q"]["rank"] == 1 and out["p q"]["n"] == 10**15


def test_ties_by_bytes(spark):
    docs = [("en", f"{w} {w}") for w in ("Z", "z", "é", "~", "🙂", "￮") for _ in range(10)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    assert columns(co.collocations(df)) == slow(docs)


def test_long_text_without_an_end(spark):
    text = " ".join(f"w{i % 500}" for i in range(400_000))
    got = {(r["words"], r["phrase"]): r["count"] for r in co.phrase_counts(spark.createDataFrame([("en", text, "", 1)], SCHEMA)).collect()}
    assert got[0, ""] == 400_000 and got[3, "w0 w1 w2"] == 800 and len(got) == 1501
