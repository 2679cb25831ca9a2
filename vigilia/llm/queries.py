"""The registered queries of this subpackage and, where SQL can say them, their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this package; each has ``query`` and may have ``ORACLE_SQL``.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_line_runs": "line_runs",
    "op3_quality_rules": "quality_rules",
    "op4_chunk_fingerprints": "chunk_prints",
    "op5_word_table": "word_table",
    "op6_best_fit_packing": "packing",
    "op7_html_text": "html_text",
    "op8_skip_chain_pii": "personal_data",
    "op9_token_counts": "token_counts",
    "op10_jaccard_join": "jaccard_join",
    "op11_phrase_collocations": "collocations",
    "op12_url_rules": "url_rules",
    "op13_turn_repair": "turn_repair",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name in MODULES if (sql := getattr(_module(name), "ORACLE_SQL", None))}
