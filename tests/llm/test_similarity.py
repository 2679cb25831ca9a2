"""Fingerprints, the Jaccard join and the pipeline against brute force."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
import corpus_pipeline
from tests.harness import compare, connect
from vigilia.llm import chunk_prints, jaccard_join, queries
from vigilia.llm.components import components

from .conftest import pairs


def in_order(docs):
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))


def test_fingerprints(odd_docs, some_docs):
    for docs in (odd_docs, some_docs):
        rows = in_order(pairs(docs))
        want, prints = [], {}
        for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
            t, after = t or "", after or ""
            half = len(t) // 2
            changed = t[: len(t) - half] + after[:half]
            own, other, edited = (chunk_prints.chunk_prints([x.encode()])[0] for x in (t, after, changed))
            prints[t] = chunk_prints.rendered(own)
            want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), chunk_prints.rendered(own), chunk_prints.rendered(edited),
                         chunk_prints.likeness(own, edited), chunk_prints.likeness(own, other)))
        got = [tuple(r)[:7] for r in chunk_prints.fingerprints(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def slow_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(chunk_prints.GEAR[b])) % 2**64
        out.append(h)
    return out


def slow_chunks(data):
    ends, at, h = [], 0, slow_gear(data)
    for i in range(len(data)):
        size = i + 1 - at
        mask = int(chunk_prints.STRICT) if size < chunk_prints.NORMAL else int(chunk_prints.LOOSE)
        if size >= chunk_prints.SHORTEST and (h[i] & mask == 0 or size == chunk_prints.LONGEST) and i + 1 < len(data):
            ends.append(i + 1)
            at = i + 1
    return [*ends, len(data)] if data else []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1500), st.integers(0, 3))
def test_chunks(data, repeat):
    data = data * (repeat + 1)
    assert chunk_prints.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == slow_gear(data)
    ends = slow_chunks(data)
    digests = {}
    import xxhash

    for a, b in zip([0, *ends], ends):
        d = xxhash.xxh3_64_intdigest(data[a:b])
        digests[d] = digests.get(d, 0) + b - a
    assert chunk_prints.chunk_prints([b"before", data, b"x" * 70])[1] == digests
    assert chunk_prints.parsed(chunk_prints.rendered(digests)) == digests


def test_likeness():
    a, b = {1: 60, 2: 40}, {1: 60, 3: 240}
    assert chunk_prints.contained(a, b) == 0.6 and chunk_prints.likeness(a, b) == 0.2 == chunk_prints.likeness(b, a)
    assert chunk_prints.likeness({}, {}) == 1 and chunk_prints.likeness({}, a) == 0


def test_shift_changes_few_chunks(some_docs):
    text = max((t for _, t in pairs(some_docs) if t), key=len)
    one, other = chunk_prints.chunk_prints([text.encode(), ("inserted words " + text).encode()])
    assert chunk_prints.likeness(one, other) > 0.9


def grouped(docs):
    sets = []
    for _, t in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(docs, sets))]


def test_components(odd_docs, some_docs):
    for docs in (odd_docs, some_docs):
        got = list(map(tuple, jaccard_join.jaccard_components(docs).collect()))
        assert sorted(got, key=str) == sorted(grouped(pairs(docs)), key=str)


def mutated(seed, n, copies, vocabulary):
    """A base text and copies with a growing number of changed words, so that some link to the base and some do not."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, vocabulary, n)]
    out = [" ".join(base)]
    for k in range(copies):
        words = list(base)
        for at in rng.integers(0, n, 1 + k % 8):
            words[at] = f"x{rng.integers(0, vocabulary)}"
        out.append(" ".join(words[: n - k % 3]))
    return out


@pytest.mark.parametrize("boundary", [None, 0, 9, 14])
def test_components_of_mutations(spark, monkeypatch, boundary):
    """Groups of near copies of every size, light and heavy, whatever the boundary between them."""
    texts = [t for n in (*range(5, 24), 60, 200) for t in mutated(n, n, 14, 4000)]
    texts += ["common words in all of them " * 3 + t for t in mutated(99, 30, 20, 50)]
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "choose_boundary", lambda counts: boundary)
    docs = spark.createDataFrame([(i * 7 % 1009, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = list(map(tuple, jaccard_join.jaccard_components(docs).collect()))
    assert sorted(got) == sorted(grouped(pairs(docs)))


def test_frequent_shingles_change_nothing(spark, monkeypatch):
    texts = [f"one passage that all the documents share as a whole {t}" for t in mutated(5, 40, 30, 3000)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    for share in (10**9, 2):
        monkeypatch.setattr(jaccard_join, "HOT_SHARE", share)
        found.append(sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())))
    assert found[0] == found[1] == sorted(grouped(pairs(docs)))


def test_need():
    for a in range(1, 40):
        for b in range(1, 40):
            x = jaccard_join.need(a, b)
            assert 100 * x >= 80 * (a + b - x) and 100 * (x - 1) < 80 * (a + b - x + 1)


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}


def test_empty_tables(no_docs):
    assert chunk_prints.fingerprints(no_docs).collect() == []
    assert jaccard_join.jaccard_components(no_docs).collect() == []


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, con, name):
    assert compare(queries.queries()[name](spark, sf_dir), con, queries.oracle_sql()[name]) == []


def test_registered():
    assert {n.split("_")[0] for n in queries.MODULES} == {f"op{k}" for k in range(1, 14)}
    assert {*queries.MODULES, "pipeline"} <= set(entry.queries())


def test_one_row_of_each_component(spark, odd_docs, no_docs):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text), (2, text), (None, text), (None, text), (3, text + " x"), (None, "other " * 9), (None, "other " * 9), (None, "other " * 9),
            (7, ""), (7, ""), (None, None), (9, "alone in the world of words"), (9, "quite another text under one id")]
    df = spark.createDataFrame([(i, t, k, "h") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _gone_id int, _place string").repartition(4)
    kept = jaccard_join.one_per_component(df)
    assert kept.columns == df.columns
    want = [(1, text), (None, "other " * 9), (7, ""), (7, ""), (None, None), (9, rows[13][1]), (9, rows[14][1])]
    assert sorted(pairs(kept), key=str) == sorted(want, key=str)
    assert jaccard_join.one_per_component(no_docs).count() == 0
    got, given = pairs(jaccard_join.one_per_component(odd_docs)), pairs(odd_docs)
    ids = {}
    for place, (_, _, component) in enumerate(grouped([(k, t) for k, (_, t) in enumerate(given)])):
        ids.setdefault(component, []).append(given[place])
    best = [min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in ids.values()]
    assert sorted(map(str, best)) == sorted(str(i) for i, _ in got)


def test_pipeline_stages(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            before = kept
            kept = stage(spark, before, "")
            if name == "packing":
                assert kept.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                break
            kept = spark.createDataFrame(kept.collect(), kept.schema)
            assert kept.columns == docs.columns


def test_pipeline(spark, sf_dir, some_docs):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    from tests.llm.test_cleaning import deduped

    from vigilia.llm import personal_data, quality_rules

    kept = pairs(quality_rules.clean(some_docs, "n_chars"))
    lines = [(i, t) for i, _, dropped, t in deduped(kept, 40, 5) if not dropped or t.strip()]
    least = [(i, t) for (i, t), (_, _, c) in zip(lines, grouped(lines)) if c == i]
    field = personal_data.train(spark.createDataFrame(least, "doc_id long, text string"))
    masked = dict(pairs(personal_data.redacted(spark.createDataFrame(least, "doc_id long, text string"), field)))
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    lengths = {}
    for r in rows:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in masked.items()}
