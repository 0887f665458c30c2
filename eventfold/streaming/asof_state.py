"""Streaming form of the as-of scan: keyed state, one value per table.

Row-frame windows are not allowed on streaming frames, so the latest table
value of each key is kept in a ``ValueState`` (RocksDB-backed, checkpointed)
by a ``transformWithStateInPandas`` processor. Per micro-batch a key's new
rows are sorted by ``(order, *tiebreak)`` and the nearest earlier table value
is a vectorised forward fill seeded from the state; the state then keeps the
last value. Values cross the Python boundary as JSON text, so any nested
schema works; O(1) state per key and table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

JSON_OPTS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AsOfProcessor(StatefulProcessor):
    """Emits every input row with, per table, the JSON of the last table row
    of the same key strictly before it (across micro-batches)."""

    def __init__(self, names: Sequence[str], order: str, tiebreak: Sequence[str]):
        self.names = list(names)
        self.order = order
        self.tiebreak = list(tiebreak)

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("v", T.StringType())])
        self.states = {n: handle.getValueState(f"last{i}", schema) for i, n in enumerate(self.names)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf.sort_values([self.order, *self.tiebreak], kind="stable").reset_index(drop=True)
        out = {}
        for i, n in enumerate(self.names):
            st = self.states[n]
            seed = st.get()[0] if st.exists() else None
            own = pdf[f"asof_v{i}"].where(pdf[f"asof_is{i}"].fillna(False).astype(bool))
            seen = own.ffill()
            before = seen.shift(1)
            if seed is not None:
                before = before.where(before.notna(), seed)
            out[f"asof_t{i}"] = before.astype(object).where(before.notna(), None)
            last = seen.iloc[-1] if len(seen) else None
            if last is not None and not pd.isna(last):
                st.update((last,))
        res = pdf[["asof_row"]].assign(**out)
        yield res

    def close(self) -> None:
        pass


def stream_attach_last_before(df: DataFrame, key: str, order: str, tables: Mapping[str, tuple[Column, Column]],
                              tiebreak: Sequence[str] = (), want: Column | None = None) -> DataFrame:
    """Streaming counterpart of :func:`eventfold.operators.asof.attach_last_before`
    (same arguments and result columns; every row gets its lookups, ``want`` is
    accepted for the same call shape)."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    names = list(tables)
    row_type = df.schema
    value_types = {n: df.select(v.alias("x")).schema["x"].dataType for n, (_, v) in tables.items()}
    keyed = F.col(key).isNotNull()
    packed = df.where(keyed).select(
        F.col(key), F.col(order), *[F.col(c) for c in tiebreak],
        F.to_json(F.struct(*df.columns), JSON_OPTS).alias("asof_row"),
        *[F.coalesce(c, F.lit(False)).alias(f"asof_is{i}") for i, (c, _) in enumerate(tables.values())],
        *[F.to_json(F.struct(v.alias("x")), JSON_OPTS).alias(f"asof_v{i}") for i, (_, v) in enumerate(tables.values())])
    # names without a leading underscore: such names do not survive the trip to pandas
    out_schema = T.StructType([T.StructField("asof_row", T.StringType())]
                              + [T.StructField(f"asof_t{i}", T.StringType()) for i in range(len(names))])
    attached = packed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=AsOfProcessor(names, order, tiebreak), outputStructType=out_schema,
        outputMode="Append", timeMode="None")
    rows = attached.select(
        F.from_json("asof_row", row_type, JSON_OPTS).alias("_r"),
        *[F.from_json(f"asof_t{i}", T.StructType([T.StructField("x", value_types[n])]), JSON_OPTS)["x"].alias(n)
          for i, n in enumerate(names)])
    return rows.select("_r.*", *names)
