"""Fingerprints by content-defined chunking.

A gear hash (shift by one bit and add a value per byte) runs over the text's UTF-8 bytes; a chunk ends where its high
bits are zero. Chunking is normalised: below ``NORMAL`` bytes a stricter mask decides, above it a looser one, so lengths
stay close together; no chunk is shorter than ``SHORTEST`` or longer than ``LONGEST``. Boundaries depend on nearby bytes
only, so an insertion changes the chunks around it and none further on. A fingerprint is the set of chunk digests with
their lengths; its likeness to another is the share of its length that the other contains.

The gear hash of a place is a weighted sum over the 64 bytes before it, computed for all places at once by doubling.
The next document is found after dealing the rows out by ranges of ``doc_id``: the first row of each range is also sent
to the range before it.

Null and empty texts have an empty fingerprint, which is like another empty one (1) and unlike any other (0). Rows with
equal ``doc_id`` follow each other by text; null ids come first. One row alone is its own next document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .textvec import SLICE_BYTES

SHORTEST, NORMAL, LONGEST = 24, 64, 256
#: Buckets of ids a partition, of which ranges with about equal rows are made.
BUCKETS = 64
STRICT, LOOSE = np.uint64(0x7F << 57), np.uint64(0x0F << 60)
#: A fixed value per byte; equal in every task.
GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
          "n_chunks long")
#: Digest -> bytes of the text in chunks with it.
Print = dict[int, int]


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: ``sum(GEAR[data[i - k]] << k for k in range(64))``."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16, 32):
        h[shift:] += h[:-shift] << np.uint64(shift)
    return h


def boundaries(n: int, loose: list[int], strict: list[int]) -> list[int]:
    """Ends of the chunks of ``n`` bytes, given the places after which either mask allows an end."""
    ends, at = [], 0
    while n - at > SHORTEST:
        normal, most = min(at + NORMAL, n), min(at + LONGEST, n)
        k = bisect_left(strict, at + SHORTEST)
        if k < len(strict) and strict[k] < normal:
            at = strict[k]
        else:
            k = bisect_left(loose, normal)
            at = loose[k] if k < len(loose) and loose[k] < most else most
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunk_prints(texts: list[bytes]) -> list[Print]:
    """The fingerprint of each text; all are hashed in one array, with no text's bytes reaching into the next."""
    out = []
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > SLICE_BYTES:
            out += _prints(group)
            group, size = [], 0
        group.append(text)
        size += len(text)
    return out + _prints(group)


def _prints(texts: list[bytes]) -> list[Print]:
    # A chunk cannot end before SHORTEST bytes, so only hashes whose window may reach over the text's start need care:
    # they are those of its first 63 bytes, and are made from the text alone.
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = gear_hashes(data)
    found, at = [], 0
    for text in texts:
        n = len(text)
        own = h[at : at + n]
        head = min(63, n)
        own[:head] = gear_hashes(data[at : at + head])
        places = np.flatnonzero((own & LOOSE) == 0)
        strict = places[(own[places] & STRICT) == 0]
        prints: Print = {}
        begin = 0
        for end in boundaries(n, (places + 1).tolist(), (strict + 1).tolist()):
            digest = xxhash.xxh3_64_intdigest(text[begin:end])
            prints[digest] = prints.get(digest, 0) + end - begin
            begin = end
        found.append(prints)
        at += n
    return found


def rendered(prints: Print) -> str:
    """Digests in order, each with its bytes."""
    return " ".join(f"{d:016x}:{n}" for d, n in sorted(prints.items()))


def parsed(fingerprint: str) -> Print:
    return {int(d, 16): int(n) for d, n in (x.split(":") for x in fingerprint.split())}


def contained(one: Print, other: Print) -> float:
    """The share of ``one``'s bytes in chunks that ``other`` has too, at most as often."""
    total = sum(one.values())
    if not total:
        return float(not other)
    return sum(min(n, other.get(d, 0)) for d, n in one.items()) / total


def likeness(one: Print, other: Print) -> float:
    """The smaller of both containments, so that a small part of a large text is not like it."""
    return min(contained(one, other), contained(other, one))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the first as many code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in groups of bounded size, each row with the text after it; rows come ordered by range, id and text."""
    before, group, size = None, [], 0
    for batch in batches:
        for part, guest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
            if before and before[0] == part:
                group.append((before[1], before[2], text))
                size += len(before[2])
            before = None if guest else (part, doc, text)
            if size > SLICE_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def _print_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _followed(batches):
        changed = [edited(text, following).encode() for _, text, following in group]
        own = chunk_prints([text.encode() for _, text, _ in group] + [group[-1][2].encode()])
        again = chunk_prints(changed)
        # The next document is mostly the next of the group; else (at the end of a range) it is hashed on its own.
        beside = [text for _, text, _ in group[1:]] + [group[-1][2]]
        after = [p if f == b else chunk_prints([f.encode()])[0] for (_, _, f), b, p in zip(group, beside, own[1:])]
        columns = {
            "doc_id": [doc for doc, _, _ in group], "n_chars": [len(t) for _, t, _ in group],
            "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed], "fingerprint": [rendered(p) for p in own[:-1]],
            "edited_fingerprint": [rendered(p) for p in again], "near_edited": [likeness(p, e) for p, e in zip(own, again)],
            "near_next": [likeness(p, a) for p, a in zip(own, after)], "n_chunks": [len(p) for p in own[:-1]],
        }
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns.values(), kinds)], list(columns))


def _ranges(docs: DataFrame, parts: int) -> DataFrame:
    """``bucket`` (of equal width over ``place``) -> ``part`` of about equal rows, the part's first ``place`` and the part before it."""
    spark, width = docs.sparkSession, BUCKETS * parts
    counts = docs.groupBy("bucket").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy("bucket").collect()  # at most `width` rows
    share, rows, part, seen = sum(r["n"] for r in counts) / parts, [], -1, 0
    firsts: list[int] = []
    for r in counts:
        if part < 0 or seen >= share * (part + 1):
            part += 1
            firsts.append(r["first"])
        rows.append((r["bucket"], part))
        seen += r["n"]
    assert len(rows) <= width + 2 and part < parts
    return spark.createDataFrame([(b, p, firsts[p], (p - 1) % len(firsts)) for b, p in rows], "bucket long, part int, first long, prior int")


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows dealt out by ranges of ``doc_id`` and ordered, each range ended by the first row of the next one."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("place"))
    low, high = (docs.approxQuantile("doc_id", [0.001, 0.999], 0.0005) or [0.0, 0.0])
    width = max(1.0, (high - low) / (BUCKETS * parts))
    bucket = F.greatest(F.lit(-1), F.least(F.lit(BUCKETS * parts), F.floor((F.coalesce("doc_id", F.lit(-(2**63))) - F.lit(low)) / F.lit(width)))).cast("long")
    docs = docs.withColumn("bucket", bucket)
    docs = docs.join(F.broadcast(_ranges(docs.select("bucket", "place"), parts)), "bucket")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("prior").alias("part"), F.lit(True).alias("guest"))
    sent = F.when(F.col("place") == F.col("first"), F.array(own, guest)).otherwise(F.array(own))
    dealt = docs.withColumn("sent", F.explode(sent)).select("sent.*", "place", "doc_id", "text")
    return dealt.repartitionById(parts, "part").sortWithinPartitions("part", "guest", "place", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (``doc_id``, ``text``) and of its edited text, with likenesses."""
    return _in_order(docs).select("part", "guest", "doc_id", "text").mapInArrow(_print_task, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(configure(spark).read.parquet(f"{sf_dir}/documents.parquet"))
