"""A training-data pipeline over `documents`: quality rules, line dedup, near-duplicate removal, mixing, tokens.

Each stage works on all that its predecessor kept, written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import _exchange, bpe, lines, minhash, mixing, quality

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", lines.stage),
    ("minhash_near_dedup", minhash.stage),
    ("source_mixing", mixing.stage),
    ("byte_bpe", bpe.stage),
]

#: The last two stages' tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _exchange.materialise(stage(spark, docs, sf_dir), name)
    return docs
