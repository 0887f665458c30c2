"""Payload transforms on the settings struct (OP-21..24) and versions (OP-44)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_new_selection(selection: Column) -> Column:
    """OP-21: a new item from a selection request; unshared, unnamed."""
    return F.when(selection.isNotNull(), F.struct(
        selection["id"].alias("id"),
        F.lit(None).cast("string").alias("name"),
        selection["service"].alias("service"),
        selection["user_id"].alias("user_id"),
        F.lit(False).alias("shared"),
        selection["selection"].alias("selection"),
        selection["inserted"].alias("inserted"),
        selection["updated"].alias("updated"),
        F.lit(None).cast("timestamp").alias("accessed"),
    ))


def set_fields_save(source: Column, persistence: Column) -> Column:
    """OP-22: id, name and shared come from the persistence request."""
    return (source.withField("id", persistence["id"])
            .withField("name", persistence["name"])
            .withField("shared", persistence["shared"]))


def set_fields_clone(source: Column, persistence: Column, cloner: Column, as_of: Column) -> Column:
    """OP-23: a private, unnamed copy owned by the cloner, stamped ``as_of``."""
    return (source.withField("id", persistence["id"])
            .withField("name", F.lit(None).cast("string"))
            .withField("shared", F.lit(False))
            .withField("user_id", cloner)
            .withField("inserted", as_of)
            .withField("updated", as_of)
            .withField("accessed", F.lit(None).cast("timestamp")))


def set_fields_accessed(source: Column, as_of: Column) -> Column:
    """OP-24: the accessed date becomes ``as_of``."""
    return source.withField("accessed", as_of)


def version_next(command: Column, state_version: Column) -> Column:
    """OP-44: select/save/clone restart at 1 (quirk Q5); the rest are state + 1."""
    return (F.when(command.isin("select", "save", "clone"), F.lit(1))
            .otherwise(state_version + F.lit(1))).cast("int")
