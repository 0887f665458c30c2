"""A corpus pipeline of five stages over the table ``documents``.

Each stage reads all rows its predecessor kept and returns the columns of
documents, the last the packed pieces:

1. ``quality``: documents that break a quality rule go
2. ``near_dedup``: one document of each group of near copies stays
3. ``secrets``: live-looking credentials are masked in the text
4. ``mixing``: documents appear as often as the source mix takes them, so sources reach their targets
5. ``packing``: pieces of documents packed into token sequences

Between stages the rows are written as Parquet to the shared folder and read
again, so a lost executor costs the tasks it held, not the stages before.
No SQL expresses the last stage (it needs the tokenizer library).
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventfold.llm import mixing, near_dup, packing, quality, secret_scan  # noqa: E402
from eventfold.llm.common import materialize, ship_package  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_dup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.op10(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{i + 1}")
    return docs
