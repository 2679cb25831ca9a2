"""The corpus pipeline: quality rules, line dedup, near duplicates, personal data, packing; each stage is stored and reread.

Each stage keeps the columns of documents, others included, whatever their names; an empty table stays empty. Null and empty texts fail
the quality rules; repeated rows are judged alike and count as copies for near duplicates; rows without ``doc_id`` pass line dedup as they
are and come last where a copy is chosen. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilia.llm import jaccard_join, line_runs, packing, personal_data, quality_rules
from vigilia.session import configure, materialize

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    return quality_rules.clean(docs, "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another one keeps; those that lose all their words with them go."""
    kept = line_runs.dedup_lines(docs)
    length = F.char_length("text").cast("long")
    changed = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return changed.where((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(line_runs.BLANKS)) != "")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, repeated rows and rows without ``doc_id`` included: the one with the smallest ``doc_id``,
    none coming last. Rows without words link with nothing and stay."""
    return jaccard_join.one_per_component(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked."""
    return personal_data.redacted(docs, personal_data.train(docs), "n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the remaining documents with its sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", private),
    ("packing", packed),
]

#: The field of the personal-data stage and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and reread as the next stage's documents."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
