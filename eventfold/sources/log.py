"""Event-log sources for batch and streaming (OP-01..04); the sinks are in eventfold.streaming.

The original reads Kafka topics with Avro values; here the log is a table of
files with the declared ``EVENT_LOG`` schema (no inference). The Kafka
connector is not bundled in this environment, so ``format`` is a parameter:
any Spark source with the same schema works, ``parquet`` is the default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.schema import DERIVED as STORED_LOG

SNAPSHOT_SUFFIX = "-snapshot"


@dataclass(frozen=True)
class StreamPolicy:
    """OP-03: consumer policy as Structured Streaming options. The original's 50
    rows per poll bound one consumer's fetch, not the job, so no limit is the default."""
    max_files_per_trigger: int | None = None
    trigger_ms: int | None = None     # None: as fast as possible
    checkpoint: str | None = None     # shared folder; required on a cluster
    from_seq: int | None = None       # starting position: rows from this place on; None: the whole log


def _stored(df: DataFrame) -> DataFrame:
    return df.withColumn("hop", F.coalesce(F.col("hop"), F.lit(0)))


def read_event_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """OP-01 (batch): the log as a DataFrame with the declared schema. Derived
    rows written back by the engine keep their ``hop``; external rows have 0."""
    return _stored(spark.read.format(fmt).schema(STORED_LOG).load(path))


def read_snapshot_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """OP-02 (batch): the snapshot table written by the snapshot sink."""
    return read_event_log(spark, path + SNAPSHOT_SUFFIX, fmt)


def stream_event_log(spark: SparkSession, path: str, policy: StreamPolicy = StreamPolicy(),
                     fmt: str = "parquet") -> DataFrame:
    """OP-01/03 (stream): the log as a streaming DataFrame."""
    r = spark.readStream.format(fmt).schema(STORED_LOG)
    if policy.max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", policy.max_files_per_trigger)
    log = _stored(r.load(path))
    return log if policy.from_seq is None else log.where(F.col("seq") >= policy.from_seq)


def stream_snapshot_log(spark: SparkSession, path: str, policy: StreamPolicy = StreamPolicy(),
                        fmt: str = "parquet") -> DataFrame:
    """OP-02 (stream)."""
    return stream_event_log(spark, path + SNAPSHOT_SUFFIX, policy, fmt)


def split_malformed(df: DataFrame, text_col: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """OP-04: decode ``text_col`` with ``schema``; undecodable rows go to a
    quarantine frame instead of failing the job (log-and-continue)."""
    corrupt = "_corrupt_record"
    full = T.StructType(schema.fields + [T.StructField(corrupt, T.StringType())])
    parsed = df.withColumn("_decoded", F.from_json(F.col(text_col), full,
                                                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    bad_row: Column = F.col("_decoded").isNull() | F.col(f"_decoded.{corrupt}").isNotNull() | F.col(text_col).isNull()
    good = parsed.where(~bad_row).select(*df.columns, *[F.col(f"_decoded.{f.name}").alias(f.name) for f in schema])
    bad = parsed.where(bad_row).select(*df.columns)
    return good, bad
