"""Latest-by-key tables of a stream with delete markers (the streaming form of ``tombstone_tables``).

The state of a key is its last row's order and, as a string, its payload. A marker removes
the key's payload under ``"delete"`` (and the state itself keeps only the order, so a late older
row cannot bring the key back); under ``"ignore"`` it is skipped. Each batch gives one row per changed key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventfold.session import ship_package
from eventfold.streaming.asof_state import STATE_PROVIDER

CHANGE = T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.LongType()),
                       T.StructField("present", T.BooleanType()), T.StructField("payload", T.StringType())])


class TableProcessor(StatefulProcessor):
    def __init__(self, semantics: str):
        if semantics not in ("delete", "ignore"):
            raise ValueError(f"unknown semantics {semantics!r}")
        self.deletes = semantics == "delete"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, present boolean, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:  # one row is kept of each piece, however many a hot key has in the batch
            if not self.deletes:
                pdf = pdf[~pdf["gone"]]
            if len(pdf):
                r = pdf.loc[pdf["at"].idxmax()]
                if best is None or r["at"] > best["at"]:
                    best = r
        if best is None or (self.last.exists() and self.last.get()[0] >= best["at"]):
            return
        present = not bool(best["gone"])
        payload = best["payload"] if present else None
        self.last.update((int(best["at"]), present, payload))
        yield pd.DataFrame({"key": [key[0]], "at": [int(best["at"])], "present": [present], "payload": [payload]})

    def close(self) -> None:
        pass


def stream_table(log: DataFrame, deleted: Column, payload: Column, semantics: str, key: str = "aggregate_id", order: str = "seq") -> DataFrame:
    """Changes (key, at, present, payload) of the table kept over a stream; ``present`` is false when a key is removed."""
    spark = log.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    rows = log.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"),
                                                    F.coalesce(deleted, F.lit(False)).alias("gone"), payload.cast("string").alias("payload"))
    return rows.groupBy("key").transformWithStateInPandas(TableProcessor(semantics), CHANGE, "Update", "none")


def read_table(spark: SparkSession, checkpoint: str, keys: Sequence[str] | None = None, batch_id: int | None = None) -> DataFrame:
    """OP-09 on a stream: the table (key, at, payload) that a running or stopped ``stream_table`` query keeps, read from
    its checkpoint as of its last (or ``batch_id``'s) commit; with ``keys`` only theirs. Removed keys are absent."""
    r = spark.read.format("statestore").option("stateVarName", "last")
    if batch_id is not None:
        r = r.option("batchId", batch_id)
    rows = r.load(checkpoint).select(F.col("key.key").alias("key"), "value.*").where("present")
    return (rows if keys is None else rows.where(F.col("key").isin(list(keys)))).select("key", "at", "payload")
