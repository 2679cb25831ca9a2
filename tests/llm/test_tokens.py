"""Token counts, distinct-word encoding and packing against the tokenizer library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vigilia.llm import packing, token_counts, word_table
from vigilia.llm.bpe import ByteBpe

from .conftest import pairs

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def by_bytes():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def by_words():
    return Tokenizer.from_file(WORDS)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'sretvmld.12é  <|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_equal_library(text):
    encoder = test_ids_equal_library.__dict__.setdefault("encoder", ByteBpe(BYTES))
    library = test_ids_equal_library.__dict__.setdefault("library", Tokenizer.from_file(BYTES))
    for t in (text, f"a {text} b", f"<|endoftext|>{text}"):
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == ids_of(library, t)
        assert encoder.piece_counts(t)[1][-1] == len(ids_of(library, t))


def test_counts(odd_docs, some_docs, by_bytes):
    for docs in (odd_docs, some_docs):
        got = sorted(map(tuple, token_counts.token_counts(docs, BYTES).collect()), key=str)
        want = [(i, len((t or "").encode()), len(ids_of(by_bytes, t))) for i, t in pairs(docs)]
        assert got == sorted(want, key=str)


def test_small_chunks_splice_and_widen(odd_docs, by_bytes):
    got = sorted(map(tuple, token_counts.token_counts(odd_docs, BYTES, chunk=64, overlap=24).collect()), key=str)
    want = [(i, len((t or "").encode()), len(ids_of(by_bytes, t))) for i, t in pairs(odd_docs)]
    assert got == sorted(want, key=str)


def test_encoding(odd_docs, some_docs, by_words):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for docs in (odd_docs, some_docs):
        want = []
        for i, t in pairs(docs):
            ids = ids_of(by_words, t)
            want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(by_words.decode(ids, skip_special_tokens=False))))
        assert sorted(map(tuple, word_table.encoded(docs, WORDS).collect()), key=str) == sorted(want, key=str)


def test_word_ids(odd_docs, by_words):
    for row in word_table.word_ids(odd_docs, WORDS).collect():
        assert row["ids"] == ids_of(by_words, row["word"])


def check_packing(rows, docs, tokenizer, capacity):
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for i, t in docs:
        ids = [*ids_of(tokenizer, t), 0]
        first = len(ids) % capacity if len(ids) > capacity else len(ids)
        edges = [0, *range(first or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    return len(bins), sum(w[3] for w in want)


def test_packing(odd_docs, some_docs, by_bytes):
    for docs, capacity in ((odd_docs, 2048), (odd_docs, 16), (some_docs, 2048)):
        bins, tokens = check_packing(packing.pack_documents(docs, BYTES, capacity).collect(), pairs(docs), by_bytes, capacity)
        assert bins <= 1.05 * tokens / capacity + 2


def test_sequences_hold_the_ids(spark, by_bytes):
    docs = spark.createDataFrame([(i, "word " * (3 * i)) for i in range(40)], "doc_id long, text string")
    cut = packing.pieces(docs, BYTES, 32, with_ids=True)
    rows = packing.sequences(cut, packing.pack(cut.drop("ids"), 32)).collect()
    assert all(len(r["ids"]) <= 32 for r in rows)
    assert sorted(i for r in rows for i in r["ids"]) == sorted(i for _, t in pairs(docs) for i in [*ids_of(by_bytes, t), 0])


def test_two_documents_replace_the_smallest():
    # Greedy gives 60+30 and leaves a gap of 10; 30 gives way to 21+19, which fills the bin.
    patterns = packing.best_two_fit({60: 1, 30: 1, 21: 1, 19: 1}, 100)
    assert ([60, 21, 19], 1) in patterns
    assert sum(n for _, n in patterns) == 2


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20))
def test_every_document_is_placed_once(counts):
    made = packing.plan(counts, 50)
    taken = set()
    for length, n in counts.items():
        for rank in range(n):
            sequence, offset = made.place(length, rank)
            assert 0 <= sequence < made.bins and offset + length <= 50
            places = {(sequence, offset + k) for k in range(length)}
            assert not taken & places
            taken |= places


def test_length_over_capacity():
    with pytest.raises(ValueError, match="does not fit"):
        packing.best_two_fit({51: 1}, 50)


def test_empty_table(no_docs):
    assert token_counts.token_counts(no_docs, BYTES).collect() == []
    assert word_table.encoded(no_docs, WORDS).collect() == []
    assert packing.pack_documents(no_docs, BYTES).collect() == []
