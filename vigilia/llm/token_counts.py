"""Token counts of texts of any length, by overlap resynchronisation.

A text of at most ``chunk`` code points is encoded in one go. A longer one is cut into chunks that overlap; Spark deals
the chunks out, each is encoded on its own with the offsets of its pre-tokens, and neighbours are spliced at a common
boundary. Such a boundary is proven stable: pre-tokens are found from left to right without looking back, so two scans
that both begin a pre-token at one place agree from there on, up to ``MARGIN`` characters before the end of the earlier
chunk, whose missing continuation could change what stands there. Merges never cross pre-tokens. Texts where some
overlap holds no common boundary (one endless word, say) are encoded again with a wider overlap, until it spans them.

Null and empty texts have no tokens; a null ``doc_id`` is kept; repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import configure, materialize
from .bpe import byte_bpe
from .textvec import slices, strings

CHUNK, OVERLAP, WIDEN, LIMIT = 32_768, 512, 8, 1024


def _margin(encoder) -> int:
    """Characters before a chunk's end that its missing continuation may change: contractions, white space, special strings."""
    return max([4, *(len(s) + 1 for s in encoder.special)])


def _count_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = byte_bpe(path).ids
        for rows, texts in slices(batches):
            counts = [len(ids(t)) // 4 for t in texts.to_pylist()]
            yield pa.record_batch([rows.column("doc_id"), rows.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut_task(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), strings(batch.column("text"))):
                whole = text.as_py()
                places = range(0, len(whole), chunk)
                for at in range(0, len(places), 16):
                    some = list(enumerate(places))[at : at + 16]
                    yield pa.record_batch(
                        [pa.array([key.as_py()] * len(some)), pa.array([k for k, _ in some], pa.int32()), pa.array([p for _, p in some], pa.int64()),
                         pa.array([p + chunk >= len(whole) for _, p in some]), pa.array([whole[p : p + chunk + overlap] for _, p in some])],
                        ["key", "chunk", "start", "last", "text"])

    return run


def _offsets_task(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        for batch in batches:
            out = []
            for start, last, text in zip(batch.column("start").to_pylist(), batch.column("last").to_pylist(), batch.column("text").to_pylist()):
                places, before = encoder.piece_counts(text)
                ends = len(text) - _margin(encoder)
                head = [(start + p, n) for p, n in zip(places, before) if p < overlap]
                tail = [] if last else [(start + p, n) for p, n in zip(places, before) if chunk <= p <= ends]
                out.append((*map(list, zip(*head)),) + ((*map(list, zip(*tail)),) if tail else ([], [])) + (before[-1],))
            cols = list(zip(*out)) if out else [[]] * 5
            longs = pa.list_(pa.int64())
            yield pa.record_batch(
                [batch.column("key"), batch.column("chunk"), batch.column("last"), *(pa.array(c, longs) for c in cols[:4]), pa.array(cols[4], pa.int64())],
                ["key", "chunk", "last", "head", "head_before", "tail", "tail_before", "total"])

    return run


def _spliced(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Tokens of each ``key``; null where neighbours have no common boundary."""
    cut = texts.mapInArrow(_cut_task(chunk, overlap), "key string, chunk int, start long, last boolean, text string").repartition("key", "chunk")
    found = cut.mapInArrow(
        _offsets_task(path, chunk, overlap),
        "key string, chunk int, last boolean, head array<long>, head_before array<long>, tail array<long>, tail_before array<long>, total long")
    by_chunk = Window.partitionBy("key").orderBy("chunk")
    common = F.array_intersect("tail", F.lead("head").over(by_chunk))
    spliced = found.withColumn("joint", F.when(~F.col("last"), F.try_element_at(common, F.lit(1))))
    spliced = spliced.withColumn("prior", F.lag("joint").over(by_chunk))

    def before(place: str, places: str, counts: str):
        return F.when(F.col(place).isNotNull(), F.try_element_at(counts, F.array_position(places, F.col(place)).cast("int")))

    until = F.when(F.col("last"), F.col("total")).otherwise(before("joint", "tail", "tail_before"))
    since = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(before("prior", "head", "head_before"))
    tokens = until - since
    return spliced.groupBy("key").agg(F.when(F.count_if(tokens.isNull()) == 0, F.sum(tokens)).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row of ``docs`` (``doc_id``, ``text``) for the BPE file at ``path``."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    short = docs.where(F.char_length("text") <= chunk).mapInArrow(_count_task(path), "doc_id long, n_bytes long, n_tokens long")
    long = docs.where(F.char_length("text") > chunk)
    key = F.sha2("text", 256)
    left = long.select(key.alias("key"), "text").dropDuplicates(["key"])
    counted, wide = [], overlap
    while True:
        tried = materialize(_spliced(left, path, max(chunk, wide), wide), "token-counts")
        counted.append(tried.where("n_tokens IS NOT NULL"))
        failed = tried.where("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            break
        wide *= WIDEN
        left = left.join(failed, "key", "left_semi")
    known = counted[0]
    for more in counted[1:]:
        known = known.unionByName(more)
    rows = long.select("doc_id", "n_bytes", key.alias("key")).join(known, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than ``LIMIT`` tokens."""
    import public_tokenizers

    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    counts = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
