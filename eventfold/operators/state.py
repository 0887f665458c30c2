"""Latest-by-key tables and lookups (OP-05, 08, 09, 10, 39).

``max_by`` is a declarative aggregate with a partial (map-side) phase, so a key
holding many rows is reduced before the shuffle; only one row per key and
partition crosses the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.schema import SNAPSHOT_TYPES, log_order


def latest_by_key(df: DataFrame, key: str = "aggregate_id", order: str = "seq",
                  types: Sequence[str] | None = None) -> DataFrame:
    """OP-39: the last row of each key (optionally among ``types``), whole rows.
    Null keys are dropped; a later row always replaces an earlier one. In a log
    with derived rows a row comes right after its cause: order is (seq, hop)."""
    src = df.where(F.col(key).isNotNull())
    if types is not None:
        src = src.where(F.col("type").isin(list(types)))
    cols = [c for c in df.columns]
    latest = src.groupBy(key).agg(F.max_by(F.struct(*cols), log_order(df, order)).alias("_last"))
    return latest.select("_last.*")


def latest_state(log: DataFrame) -> DataFrame:
    """OP-08: the global state table, the latest event of any type per item."""
    return latest_by_key(log, "aggregate_id", "seq")


def snapshot_table(log: DataFrame, snapshot_types: Sequence[str] = SNAPSHOT_TYPES) -> DataFrame:
    """The snapshot table: latest final event per item."""
    return latest_by_key(log, "aggregate_id", "seq", snapshot_types)


def state_get(state: DataFrame, ids: DataFrame | Column | Sequence[str], id_col: str = "aggregate_id") -> DataFrame:
    """OP-09 ``get``: state rows of the wanted ids (a semi-join, so repeated
    wanted ids never duplicate a state row)."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias(id_col)).where(F.col(id_col).isNotNull())
        return state.join(wanted, id_col, "left_semi")
    if isinstance(ids, Column):
        return state.where(ids)
    return state.where(F.col(id_col).isin(list(ids)))


def state_all(state: DataFrame) -> DataFrame:
    """OP-09 ``all``: the whole state table."""
    return state


def snapshot_events(log: DataFrame, snapshot_types: Sequence[str] = SNAPSHOT_TYPES) -> DataFrame:
    """OP-05: the final events forwarded to the snapshot sink."""
    return log.where(F.col("type").isin(list(snapshot_types)))


def filter_type(log: DataFrame, event_type: str) -> DataFrame:
    """OP-10: rows of one type (a plain predicate, pushed into the scan)."""
    return log.where(F.col("type") == F.lit(event_type))


def tombstone_tables(log: DataFrame, deleted: Column, key: str = "aggregate_id", order: str = "seq") -> DataFrame:
    """Both reductions of a log with delete markers, in one aggregate: one row per key with ``table``, its last
    row that is no marker (a reduce that ignores nulls), and ``store``, its last row, null if that is a marker
    (a store that deletes on null). A key that holds markers only is in neither and gives no row."""
    cols = F.struct(*[F.col(c) for c in log.columns])
    gone, at = F.coalesce(deleted, F.lit(False)), log_order(log, order)
    return (log.where(F.col(key).isNotNull()).select(cols.alias("_row"), gone.alias("_gone"), at.alias("_at"), F.col(key).alias("_key"))
            .groupBy("_key").agg(F.max_by("_row", F.when(~F.col("_gone"), F.col("_at"))).alias("table"),
                                 F.max(F.when(~F.col("_gone"), F.col("_at"))).alias("_kept"), F.max("_at").alias("_last"))
            .where(F.col("_kept").isNotNull())
            .select(F.col("_key").alias(key), "table", F.when(F.col("_kept") == F.col("_last"), F.col("table")).alias("store")))
