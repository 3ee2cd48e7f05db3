"""The queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "op1_secrets",
    "op2_lines",
    "op3_chunks",
    "op4_decontaminate",
    "op5_quality",
    "op6_sharding",
    "op7_pii",
    "op8_bpe",
    "op9_minhash",
    "op10_suffix",
)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"loomframe.llm.{name}").QUERIES
    return found | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"loomframe.llm.{name}").SQL
    return found
