"""The registered queries of the package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import ship_package
from . import alignment, balltree, mixing, near_dup, ngram_lm, packing, quality, recompression, secret_scan, syncmers, tokenfile, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return operator(_table(spark, sf_dir, "documents"))
    return query


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.op1(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return warc.op11(_table(spark, sf_dir, "pages"))


def _ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return balltree.op13(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nnpu_toxicity": _toxicity,
    "op2_near_duplicates": _docs(near_dup.op2),
    "op3_elias_fano_lm": _docs(lambda docs: ngram_lm.op3(docs, min_count=ngram_lm.QUERY_MIN_COUNT)),
    "op4_source_mix": _docs(mixing.op4),
    "op5_recompression": _docs(recompression.op5),
    "op6_closed_syncmers": _docs(syncmers.op6),
    "op7_quality_rules": _docs(quality.op7),
    "op8_token_files": _docs(tokenfile.op8),
    "op9_secret_ownership": _docs(secret_scan.op9),
    "op10_harmonic_packing": _docs(packing.op10),
    "op11_warc_reader": _warc,
    "op12_token_alignment": _docs(alignment.op12),
    "op13_ball_tree_search": _ranked_search,
}

ORACLES: dict[str, str] = {
    "op4_source_mix": mixing.OP4_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op9_secret_ownership": secret_scan.OP9_SQL,
    "op13_ball_tree_search": balltree.OP13_SQL,
}
