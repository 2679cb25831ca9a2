"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every stage relies on. Sizes of partitions, executors and memory are the cluster's business.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # No sorting for a join whose partitions on one side are all small, as found at run time.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # The JVM compiles no method of more bytes than this: a stage with one (the text columns give such) runs in smaller ones instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``ENGINE_CONF`` to a running session (all are runtime settings)."""
    for name, value in ENGINE_CONF.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "12g", folder: str | None = None) -> SparkSession:
    """A session for tests and benches on one machine; ``folder`` takes its intermediate tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vigilia")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    )
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder).config("spark.sql.warehouse.dir", f"{folder}/warehouse")
    for name, value in ENGINE_CONF.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where a local master leaves it unset, one below the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/vigilia/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
