"""From documents to training tokens in five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import op2_lines, op4_decontaminate, op5_quality, op8_bpe, op9_minhash
from loomframe.llm.common import documents, materialize, sweep, tables

STAGES = [
    ("quality rules", op5_quality.stage),
    ("line dedup", op2_lines.stage),
    ("near-dedup", op9_minhash.stage),
    ("decontamination", op4_decontaminate.stage),
    ("byte-level BPE", op8_bpe.stage),
]

#: Hashes, components and merges of byte pairs are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of the documents that the stages leave: doc_id, n_tokens and ids, see the stages for nulls, empty and
    very long texts, ties, repeated rows, empty tables and other columns.

    Of the tables in the shared folder only the last stage's is left; the others go as soon as the next stage is written.
    """
    before, docs = tables(), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, [*before, tables()[-1]])
    return docs
