"""BPE encoding and decoding through a distinct-word table.

Tokens never reach over white space, so a text is a sequence of words and its ids are those of its words. Tasks split
their texts into words, block by block, and send each distinct word of a block to the partition of its hash; there every
distinct word is encoded once, whatever the number of blocks that have it. The ids go back to their block, where they are
joined to the words' positions, and the text is decoded by a join of ids with the vocabulary's pieces (a table of fixed size).

Positions travel as numbers of the block's words, frequent words first, so that they pack well; a word that a third of all
texts contain is one row a block.

Null texts are empty; empty texts have no ids; every row is encoded on its own, with a null or repeated id too; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .textvec import LOWER, Spans, hashes, slices, words

BLOCK_BYTES = 16 << 20
TEXTS = -1
ROW = "part int, block long, bucket int, body binary, docs binary, sizes binary"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
LEVEL = 3


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[list[str], list[str]]:
    """Decimal form and piece of each id."""
    known = tokenizer(path)
    n = known.get_vocab_size(with_added_tokens=True)
    return [str(i) for i in range(n)], [known.id_to_token(i) or "" for i in range(n)]


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, byte plane by byte plane, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def folded(word: Spans) -> Spans:
    """A-Z lower-cased where that cannot change the ids: in words of ASCII without ``<``, which may begin a special string."""
    fixed = np.concatenate([[0], np.cumsum((word.data >= 0x80) | (word.data == ord("<")))])
    plain = fixed[word.end] == fixed[word.begin]
    change = np.zeros(len(word.data) + 1, np.int32)
    change[word.begin[plain]] += 1
    np.subtract.at(change, word.end[plain], 1)
    return word._replace(data=np.where(np.cumsum(change[:-1]) > 0, LOWER[word.data], word.data))


def _block_rows(block: int, group: list[tuple[pa.Array, Spans]], parts: int) -> Iterator[tuple]:
    docs = np.concatenate([np.array([-1 if d is None else d for d in ids.to_pylist()], "<i8") for ids, _ in group])
    null = np.concatenate([ids.is_null().to_numpy(zero_copy_only=False) for ids, _ in group])
    sizes = np.concatenate([word.per_text() for _, word in group])
    hashed = np.concatenate([hashes(word) for _, word in group])
    values, first, inverse, count = np.unique(hashed, return_index=True, return_inverse=True, return_counts=True)
    bucket = ((values >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((-count, bucket))
    edges = np.searchsorted(bucket[order], np.arange(parts + 1))
    number = np.empty(len(values), np.int64)
    number[order] = (np.arange(len(values)) - edges[bucket[order]]) * parts + bucket[order]
    yield block % parts, block, TEXTS, packed(number[inverse]), np.concatenate([docs, null.astype("<i8")]).tobytes(), sizes.astype("<u4").tobytes()
    begins = np.concatenate([[0], np.cumsum([len(word.begin) for _, word in group])])
    texts = [word.data.tobytes() for _, word in group]
    spelled = []
    for at in first[order].tolist():
        k = int(np.searchsorted(begins, at, "right")) - 1
        word = group[k][1]
        spelled.append(texts[k][word.begin[at - begins[k]] : word.end[at - begins[k]]])
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, block, b, zstandard.ZstdCompressor(level=LEVEL).compress(b"\n".join(spelled[edges[b] : edges[b + 1]])), None, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in ROW.split(", ")])


def _split_task(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, group, size = TaskContext.get().partitionId() << 32, [], 0
        for rows, texts in slices(batches):
            group.append((rows.column("doc_id"), folded(words(texts))))
            size += len(group[-1][1].data)
            if size >= BLOCK_BYTES:
                yield _batch(list(_block_rows(block, group, parts)))
                block, group, size = block + 1, [], 0
        if group:
            yield _batch(list(_block_rows(block, group, parts)))

    return run


def _encode_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = tokenizer(path).encode_batch, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bucket"] != TEXTS:
                    asked = zstandard.ZstdDecompressor().decompress(row["body"]).decode().split("\n")
                    new = [w for w in asked if w not in known]
                    for w, found in zip(new, encode(new, add_special_tokens=False)):
                        known[w] = np.array(found.ids, "<u4")
                    ids = [known[w] for w in asked]
                    row |= {"body": packed(np.concatenate(ids)), "sizes": packed(np.array([len(i) for i in ids]))}
                out.append(tuple(row.values()))
            if out:
                yield _batch(out)

    return run


def _join_task(path: str, parts: int):
    def run(table: pa.Table) -> pa.Table:
        decimal, piece = pieces(path)
        rows = table.select(["bucket", "body", "docs", "sizes"]).to_pylist()
        texts = next(r for r in rows if r["bucket"] == TEXTS)
        numbers = unpacked(texts["body"])
        most = int(numbers.max()) + 1 if len(numbers) else 0
        count, as_ids, as_pieces = np.zeros(most, np.int64), [""] * most, [""] * most
        for row in rows:
            if row["bucket"] != TEXTS:
                sizes, ids = unpacked(row["sizes"]), unpacked(row["body"]).tolist()
                count[row["bucket"] :: parts][: len(sizes)] = sizes
                at = 0
                for number, n in zip(range(row["bucket"], most, parts), sizes.tolist()):
                    own = ids[at : at + n]
                    at += n
                    as_ids[number] = " ".join([decimal[i] for i in own])
                    as_pieces[number] = " ".join([piece[i] for i in own])
        docs, null = np.frombuffer(texts["docs"], "<i8").reshape(2, -1)
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(texts["sizes"], "<u4").astype(np.int64))])
        before = np.concatenate([[0], np.cumsum(count[numbers])])
        hashed = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own = numbers[a:b].tolist()
            hashed.append([hashlib.sha256(" ".join(filter(None, [said[i] for i in own])).encode()).hexdigest() for said in (as_ids, as_pieces)])
        return pa.table({
            "doc_id": pa.array(docs, pa.int64(), mask=null.astype(bool)), "n_tokens": pa.array(before[ends[1:]] - before[ends[:-1]], pa.int64()),
            "ids_sha256": pa.array([h[0] for h in hashed], pa.string()), "decoded_sha256": pa.array([h[1] for h in hashed], pa.string())})

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Of every row of ``docs`` (``doc_id``, ``text``): number of ids, and hashes of the ids and of the decoded text, for the file at ``path``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = docs.select("doc_id", "text").mapInArrow(_split_task(parts), ROW).repartitionById(parts, "part")
    return split.mapInArrow(_encode_task(path), ROW).groupBy("block").applyInArrow(_join_task(path, parts), SCHEMA)


def word_ids(docs: DataFrame, path: str) -> DataFrame:
    """The distinct-word table itself: every distinct word of ``docs`` and its ids."""
    listed = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tokenizer(path).encode_batch(batch.column("word").to_pylist(), add_special_tokens=False)
            yield pa.record_batch([batch.column("word"), pa.array([f.ids for f in found], pa.list_(pa.int32()))], ["word", "ids"])

    return listed.mapInArrow(run, "word string, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as hashes."""
    import public_tokenizers

    return encoded(configure(spark).read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
