"""Best-two-fit packing of documents into sequences of bounded length.

Tokens are cut and counted where the texts are; what is packed are lengths. There are at most ``capacity`` different
lengths, so the plan is made from a histogram: each bin is filled greedily with the longest lengths that still fit, then
its smallest document gives way to the two unpacked documents that fill the widened gap most tightly, as long as that
helps. A bin's pattern is repeated while the histogram allows, so the plan has a few thousand patterns whatever the
number of documents. Documents of one length are interchangeable: each gets a rank among its equals (numbered within
salted groups, so that a frequent length is not one task's work) and the rank says which copy of which pattern takes it.

Null and empty texts have the end-of-text id alone; null ids, repeated rows and ties are packed like any others; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import configure, materialize
from .bpe import byte_bpe, packed
from .textvec import slices

CAPACITY, END_ID = 2048, 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Begin and end of the pieces of ``n`` ids: whole, or a remainder first and then full pieces."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, at + capacity) for at in range(first, n, capacity))]


def _piece_task(path: str, capacity: int, end_id: int, with_ids: bool):
    tail = packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path).ids
        for rows, texts in slices(batches):
            out = []
            for doc, text in zip(rows.column("doc_id").to_pylist(), texts.to_pylist()):
                ids = encode(text) + tail
                for k, (a, b) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * a : 4 * b]
                    out.append((doc, k, a, b - a, zlib.crc32(part), np.frombuffer(part, "<u4") if with_ids else None))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 if with_ids else 5]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names[: len(kinds)])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: ids of the BPE file at ``path`` and ``end_id``, cut to ``capacity``."""
    schema = PIECE + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_piece_task(path, capacity, end_id, with_ids), schema)


class Plan(NamedTuple):
    """For each length, the ranks at which a pattern begins, and the pattern's first bin and offsets of that length."""

    first_rank: dict[int, list[int]]
    first_bin: dict[int, list[int]]
    offsets: dict[int, list[tuple[int, ...]]]
    bins: int

    def place(self, length: int, rank: int) -> tuple[int, int]:
        k = bisect_right(self.first_rank[length], rank) - 1
        copy, slot = divmod(rank - self.first_rank[length][k], len(self.offsets[length][k]))
        return self.first_bin[length][k] + copy, self.offsets[length][k][slot]


def _tightest_pair(left: np.ndarray, room: int, above: int) -> tuple[int, int] | None:
    """The two available lengths with the largest sum within ``room``, if it is larger than ``above``."""
    have = np.flatnonzero(left[: room + 1])
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, "right") - 1
    other = np.where(at >= 0, have[np.maximum(at, 0)], 0)
    alone = (other == have) & (left[have] < 2)
    other = np.where(alone, np.where(at > 0, have[np.maximum(at - 1, 0)], 0), other)
    total = np.where(other > 0, have + other, 0)
    best = int(np.argmax(total))
    return (int(have[best]), int(other[best])) if total[best] > above else None


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin) and how often each is used; all of ``counts`` (documents by length) is used up."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        left[length] += n
    found = []
    while left.any():
        bin_, free, room = [], left.copy(), capacity
        while len(fit := np.flatnonzero(free[: room + 1])):
            bin_.append(int(fit[-1]))
            free[fit[-1]] -= 1
            room -= int(fit[-1])
        while room and len(bin_) > 1 and (pair := _tightest_pair(free, room + bin_[-1], bin_[-1])):
            smallest = bin_.pop()
            free[smallest] += 1
            room += smallest - sum(pair)
            for length in pair:
                free[length] -= 1
            bin_ = sorted([*bin_, *pair], reverse=True)
        used = Counter(bin_)
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
        found.append((bin_, times))
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    first_rank, first_bin, offsets, used, bins = {}, {}, {}, Counter(), 0
    for lengths, times in best_two_fit(counts, capacity):
        places: dict[int, list[int]] = {}
        at = 0
        for length in lengths:
            places.setdefault(length, []).append(at)
            at += length
        for length, own in places.items():
            first_rank.setdefault(length, []).append(used[length])
            first_bin.setdefault(length, []).append(bins)
            offsets.setdefault(length, []).append(tuple(own))
            used[length] += len(own) * times
        bins += times
    return Plan(first_rank, first_bin, offsets, bins)


def _place_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.place
        for batch in batches:
            got = [place(n, r) for n, r in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist())]
            where = [pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)]
            yield pa.record_batch([*batch.columns[:5], *where], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (columns of ``PIECE``)."""
    spark = cut.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    bases = groups.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("within", within).join(bases, ["length", "salt"])
    ranked = ranked.select(*[c.split()[0] for c in PIECE.split(", ")], (F.col("base") + F.col("within")).alias("rank"))
    return ranked.mapInArrow(_place_task(spark.sparkContext.broadcast(plan(counts, capacity))), PACKED)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of ``docs`` (``doc_id``, ``text``) with its place in a sequence."""
    return pack(materialize(pieces(docs, path, capacity, end_id), "pieces"), capacity)


def sequences(with_ids: DataFrame, placed: DataFrame) -> DataFrame:
    """The ids of each sequence in order; ``with_ids``: pieces with their ids, of documents with distinct ``doc_id``."""
    rows = placed.join(with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` ids
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    import public_tokenizers

    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
