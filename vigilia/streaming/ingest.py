"""Incremental load of arriving outage files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import schema as S
from ..plans.ingest import new_rows, table_or_none
from ..session import materialize
from ..sources import files as src
from ..sources.sinks import append_log, append_rows


# The listing's columns, of which only the path is read.
LISTING = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Paths of files as they arrive; their content is not read."""
    files = spark.readStream.schema(LISTING).format("binaryFile").options(maxFilesPerTrigger=max_files, recursiveFileLookup=True).load(folder)
    return files.select(F.col("path").alias("arquivo_path"))


def arrived_rows(spark: SparkSession, paths: list[str], schema: StructType = S.RAW_SCHEMA, month: Column | None = None) -> DataFrame:
    """Rows of arrived files as the batch load reads them (own header, encoding, bad-line mark), with the columns of ``schema``.

    ``month`` replaces the month of the file name where the rows state it themselves.
    """
    rows = src.read_outage_files(spark, paths)
    named = [(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    tagged = rows.select(*named, *[c for c in ("REGIONAL_ORIGEM", "anomes") if c not in schema.names], src.BAD, "arquivo_path")
    return tagged if month is None else tagged.withColumn("anomes", month)


def load_arriving(spark: SparkSession, folder: str, table: str, checkpoint: str, key: list[str] | None = None,
                  schema: StructType = S.RAW_SCHEMA, max_files: int = 100, month: Column | None = None,
                  tiebreak: list[str] | None = None) -> StreamingQuery:
    """Append rows with a new record key to ``table`` (by month) until the files present are read.

    The checkpoint remembers which files were read; the table itself is the memory of keys, so no state grows
    with it. Only months the batch touches are looked at. Bad lines go to ``<table>_rejeitadas`` with their file. A
    batch that is replayed after a failure finds its rows, and the rejects of its files, already there and adds nothing.
    """
    key = key or S.RECORD_KEY

    def add(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        paths = [r.arquivo_path for r in batch.collect()]  # at most max_files
        if not paths:
            return
        rows = materialize(arrived_rows(own, paths, schema, month), "chegadas")  # read for its months, its rows and its bad lines
        append_rows(new_rows(src.good_rows(rows).drop("arquivo_path"), table_or_none(own, table), key, tiebreak), table)
        bad, known = src.bad_rows(rows), table_or_none(own, table + "_rejeitadas")
        if known is not None:
            bad = bad.join(known.select("arquivo_path").distinct(), "arquivo_path", "left_anti")
        append_log(bad, table + "_rejeitadas")

    return (
        file_stream(spark, folder, max_files).writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
