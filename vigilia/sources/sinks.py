"""Writers: month tables, logs, exports, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import blank_to_null, text
from ..operators.relational import require


def write_month(df: DataFrame, path: str, month: str = "anomes") -> None:
    """Replace exactly the months ``df`` holds; a rerun gives the same table."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy(month).parquet(path))


def append_rows(df: DataFrame, path: str, month: str | None = "anomes") -> None:
    writer = df.write.mode("append").option("compression", "zstd")
    (writer.partitionBy(month) if month else writer).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_log(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def current_month(df: DataFrame, month: str = "anomes") -> DataFrame:
    """Rows of the newest month: a view, not a copy. Reads the month column only to find it."""
    newest = df.agg(F.max(month)).first()[0]
    return df.where(F.col(month) == newest)


def snapshot_once(df: DataFrame, path: str) -> None:
    """Keep the state before a change; an existing snapshot stays."""
    df.write.mode("ignore").parquet(path)


def regional_part(col: str = "REGIONAL_ORIGEM") -> Column:
    return F.coalesce(blank_to_null(col), F.lit(S.NO_REGION))


def export_layout(df: DataFrame) -> DataFrame:
    """The export columns in order plus the region they go out under."""
    require(df, S.EXPORT_LAYOUT)
    return df.select(*S.EXPORT_LAYOUT, F.regexp_replace(regional_part(), "[^\\p{L}\\p{N}_-]", "_").alias("regional_part"))


def export_regional(df: DataFrame, path: str, region: str | None = None, compression: str = "none") -> None:
    """Delimited files per region, one folder each; which regions there are is up to the data.

    No region is squeezed into one task: a folder holds as many part files as tasks wrote to it. The text is some ten times what the
    rows take in storage; ``compression`` (``gzip``, say) writes the same lines packed, which readers here take by the file's name.
    """
    rows = export_layout(df)
    if region is not None:
        rows = rows.where(F.col("regional_part") == region)
    rows.write.mode("overwrite").partitionBy("regional_part").options(
        sep=S.CSV_SEPARATOR, header=True, emptyValue="", nullValue="", compression=compression
    ).csv(path)


def export_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(regional_part().alias("regional")).agg(F.count("*").alias("linhas"))


def manifest(rows: DataFrame, year: int, month: int, run_ts: str) -> DataFrame:
    """One row per source file: region, file, stamp."""
    stamp = F.col("snapshot_ts")
    shown = F.regexp_replace(stamp, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6")
    return rows.select("arquivo_origem", "arquivo_csv", "snapshot_ts").distinct().select(
        F.lit(year).alias("ano"), F.lit(month).alias("mes"), F.col("arquivo_origem").alias("regional"), "arquivo_csv",
        shown.alias("timestamp_arquivo"), F.lit(run_ts).alias("atualizado_em"),
    )


def as_text_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[text(c).alias(c) for c in names])
