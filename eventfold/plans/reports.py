"""Flat projections of nested results, so that a value hash computed by
another engine (DuckDB) over the same rows agrees: arrays are joined with
``,`` and timestamps become epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def us(c: Column) -> Column:
    return F.unix_micros(c)


def settings_columns(s: Column, prefix: str = "s_") -> list[Column]:
    return [
        s["id"].alias(f"{prefix}id"),
        s["name"].alias(f"{prefix}name"),
        s["service"].alias(f"{prefix}service"),
        s["user_id"].alias(f"{prefix}user_id"),
        s["shared"].alias(f"{prefix}shared"),
        F.array_join(s["selection"], ",").alias(f"{prefix}selection"),
        us(s["inserted"]).alias(f"{prefix}inserted_us"),
        us(s["updated"]).alias(f"{prefix}updated_us"),
        us(s["accessed"]).alias(f"{prefix}accessed_us"),
    ]


def flatten_events(df: DataFrame) -> DataFrame:
    """Derived or log events: identity, type, error fields and the payload
    (``settings``, or ``last_snapshot_item`` for a rollback)."""
    payload = F.coalesce(F.col("settings"), F.col("last_snapshot_item"))
    hop = [F.col("hop").cast("int").alias("hop")] if "hop" in df.columns else []
    return df.select(
        F.col("seq").cast("long").alias("seq"), *hop, "type", "aggregate_id",
        F.col("version").cast("int").alias("version"), "user_id", "session_id",
        us(F.col("date")).alias("date_us"), "exception_type", "fail_event_type",
        *settings_columns(payload),
    )
