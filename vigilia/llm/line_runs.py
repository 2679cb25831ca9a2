"""Line deduplication over levelled sorted runs of line hashes.

Batches of documents are taken in descending order of ``doc_id``. A batch's lines are hashed to 128-bit keys and reduced
to one row per key; a merge-anti-join against the runs finds the keys that no earlier batch had, and these become a run of
their own at level 0, each with its keeper, the largest document that holds the line (no later batch can have a larger
one). Keys that are in a run already only add to the tally of documents. When ``fanout`` runs of a level have come
together they are compacted into one run of the next level. Runs are bucketed tables sorted by key, so a batch is joined
with them bucket by bucket and only the batch is shuffled. At the end the runs say which lines are found in at least
``min_docs`` documents and where each of them stays; the documents are rejoined by these lines alone.

Only DataFrame functions are used. A line that a third of the documents share is counted before it is shuffled, and in the
joins it is a hot key of a plain sort-merge join, which adaptive execution splits.

Null or empty texts are one empty line, which is never dropped. Rows without ``doc_id`` keep all their lines and are not
counted; rows with equal ``doc_id`` count as one document and lose the same lines. Other columns are untouched.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, materialize, shared_dir

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 3
#: Fixed value: white space stripped from a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The stripped line with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id``, hash of the text, place of the line and its key's hashes, for lines with keys of at least ``min_chars``."""
    split = docs.where("doc_id IS NOT NULL").select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.posexplode(text_lines(F.col("text"))).alias("place", "line"))
    keyed = split.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "text_hash", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x5EED), "key", F.lit(7)).alias("h2"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class LineRuns:
    """Levels of sorted runs, and the tallies of keys met again; all tables of one instance, dropped by ``release``."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.folder = f"{shared_dir(spark)}/vigilia/{self.name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.tallies: list[DataFrame] = []
        self.tables = 0

    def _write(self, run: DataFrame) -> str:
        """A run: sorted by key in buckets of the key, a file each."""
        table = f"{self.name}_{self.tables}"
        self.tables += 1
        dealt = run.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{table}").format("parquet").saveAsTable(table)
        return table

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Takes in the next batch: lines (``doc_id`` and key) of documents below all earlier ones."""
        batch = lines.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        if not self.levels:
            self._push(self._write(batch))
            return
        batch = materialize(batch, "line-batch")
        fresh = self._write(reduce(lambda left, run: left.join(run.hint("merge"), KEY, "left_anti"), self.runs(), batch))
        again = batch.join(self.spark.table(fresh).hint("merge"), KEY, "left_anti")
        self.tallies.append(materialize(again.select(*KEY, "n_docs"), "line-tally"))
        self._push(fresh)

    def _push(self, table: str, level: int = 0) -> None:
        """Adds a run to a level; a full level is merged (its runs have no key in common) into one run of the next."""
        while len(self.levels) <= level:
            self.levels.append([])
        names = self.levels[level]
        names.append(table)
        if len(names) == self.fanout:
            self.levels[level] = []
            self._push(self._write(reduce(DataFrame.unionByName, map(self.spark.table, names))), level + 1)
            self._drop(names)

    def repeated(self, min_docs: int) -> DataFrame:
        """Keys found in at least ``min_docs`` documents, with the document that keeps the line."""
        runs = self.runs()
        if not self.tallies:
            return reduce(DataFrame.unionByName, runs).where(F.col("n_docs") >= min_docs).select(*KEY, "keeper")
        more = reduce(DataFrame.unionByName, self.tallies).groupBy(*KEY).agg(F.sum("n_docs").alias("more"))
        more = materialize(more, "line-tallies")
        counted = [run.join(more, KEY, "left").where(F.col("n_docs") + F.coalesce("more", F.lit(0)) >= min_docs) for run in runs]
        return reduce(DataFrame.unionByName, counted).select(*KEY, "keeper")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def release(self) -> None:
        """Forgets the tables; their files go with the folder they lie in."""
        self._drop([name for level in self.levels for name in level])


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """``doc_id``, ``text_hash`` and the places of the lines that leave the document."""
    spark = docs.sparkSession
    bounds = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = reduce(lambda n, b: n + F.when(F.col("doc_id") <= F.lit(int(b)), 1).otherwise(0), sorted(set(bounds)), F.lit(0))
    lines = materialize(line_hashes(docs, min_chars).withColumn("batch", batch), "lines", ["batch"])
    runs = LineRuns(spark)
    try:
        for k in range(len(set(bounds)) + 1):
            runs.add(lines.where(F.col("batch") == k))
        repeated = materialize(runs.repeated(min_docs), "repeated-lines")
    finally:
        runs.release()
    gone = lines.join(repeated, KEY).where(F.col("doc_id") != F.col("keeper"))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("_gone_places"))  # the lines of one document


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``text`` reduced to the kept lines, and the counts ``n_lines`` and ``n_dropped`` (they replace columns of that name)."""
    gone = dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs, batches)
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"), "_gone_places")
    joined = docs.join(gone, (docs["doc_id"] == gone["_gone_id"]) & (text_hash(docs["text"]) == gone["_gone_hash"]), "left")
    lines = text_lines(docs["text"])
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone_places"))
    kept = F.when(F.col("_gone_places").isNull(), F.coalesce(docs["text"], F.lit(""))).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("_line_list", i)), "\n"))
    others = [docs[c] for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    counted = joined.withColumn("_line_list", lines).select(
        *others, kept.alias("text"), F.size("_line_list").cast("long").alias("n_lines"), F.coalesce(F.size("_gone_places"), F.lit(0)).cast("long").alias("n_dropped"))
    return counted


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps of its lines."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM texts),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM line),
often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT k.doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (o.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key AND k.doc_id <> o.keeper GROUP BY k.r, k.doc_id
"""
