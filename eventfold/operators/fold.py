"""Fold of an item's history into its aggregate state (OP-33, OP-19).

The original applies events one by one and throws on the first type its
family does not accept, so nothing after that row counts. Set-based form:
one as-of pass marks rows that have a locking row before them, then one
aggregate (partial + final) takes, over the rows before the first lock, the
last version, the last settings-carrying payload and the deleted flag.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.operators.asof import attach_last_before, default_chunk
from eventfold.schema import (
    PERSISTENCE_ACCEPTS, PERSISTENCE_SETS_SETTINGS, SELECTION_ACCEPTS, SELECTION_SETS_SETTINGS, Types,
    hop_tiebreak, log_order,
)

FAMILIES = {
    "persistence": (PERSISTENCE_ACCEPTS, PERSISTENCE_SETS_SETTINGS),
    "selection": (SELECTION_ACCEPTS, SELECTION_SETS_SETTINGS),
}


def _folded(rows: DataFrame, named: Mapping[str, tuple[Sequence[str], Sequence[str]]], chunk: int | None) -> DataFrame:
    """One as-of pass and one aggregate for all of ``named`` families; a struct per family."""
    t, at, tie = F.col("type"), log_order(rows), hop_tiebreak(rows)
    accepted = {f: t.isin(list(acc)) for f, (acc, _) in named.items()}
    # a family's first lock is looked up on rows that it accepts; a row it does not accept is a lock itself
    marked = attach_last_before(rows, "aggregate_id", "seq", {f"_lock_{f}": (~ok, F.lit(True)) for f, ok in accepted.items()},
                                tiebreak=tie, chunk=chunk, want=reduce(lambda a, b: a | b, accepted.values()))

    def folded(f: str, sets: Sequence[str]):
        ok = accepted[f]
        live = ok & F.col(f"_lock_{f}").isNull()
        return [F.max_by("version", F.when(live, at)).alias(f"{f}_version"),
                F.max_by("settings", F.when(live & t.isin(list(sets)), at)).alias(f"{f}_settings"),
                F.coalesce(F.max(F.when(live, t == Types.DELETED)), F.lit(False)).alias(f"{f}_deleted"),
                F.min(F.when(~ok, F.col("seq"))).alias(f"{f}_lock_seq"),
                F.min_by(t, F.when(~ok, at)).alias(f"{f}_lock_type"),
                F.count(F.when(live, 1)).alias(f"{f}_applied")]

    wide = marked.groupBy("aggregate_id").agg(*[c for f, (_, sets) in named.items() for c in folded(f, sets)])
    per_family = [F.struct(F.lit(f).alias("family"), F.col(f"{f}_version").alias("version"), F.col(f"{f}_settings").alias("settings"),
                           F.col(f"{f}_deleted").alias("deleted"), F.col(f"{f}_lock_seq").isNotNull().alias("locked"),
                           F.col(f"{f}_lock_type").alias("lock_type"), F.col(f"{f}_lock_seq").alias("lock_seq"),
                           F.col(f"{f}_applied").alias("applied")) for f in named]
    return wide.select("aggregate_id", F.explode(F.array(*per_family)).alias("_f")).select("aggregate_id", "_f.*")


def _history(log: DataFrame) -> DataFrame:
    return log.where(F.col("aggregate_id").isNotNull()).select("aggregate_id", "seq", *hop_tiebreak(log), "type", "version", "settings")


def fold_history(log: DataFrame, family: str = "persistence", accepts: Sequence[str] | None = None,
                 sets_settings: Sequence[str] | None = None, chunk: int | None = None) -> DataFrame:
    """One row per item: ``aggregate_id, family, version, settings, deleted, locked,
    lock_type, lock_seq, applied`` (events folded before the first lock)."""
    acc, sets = FAMILIES[family]
    return _folded(_history(log), {family: (accepts or acc, sets_settings or sets)}, chunk)


def fold_families(log: DataFrame, chunk: int | None = None) -> DataFrame:
    """:func:`fold_history` of every family, a row per item and family, in one pass over the log."""
    return _folded(_history(log), FAMILIES, chunk)


# --- mergeable fold: states of stretches of history ---------------------------

_KEY = ["aggregate_id", "family"]


def _at(df: DataFrame) -> Column:
    return F.struct(F.col("seq").alias("seq"), (F.coalesce(F.col("hop"), F.lit(0)) if "hop" in df.columns else F.lit(0)).cast("int").alias("hop"))


def fold_stretch(log: DataFrame, chunk: int | None = None) -> DataFrame:
    """The fold state of a stretch of history, per item and family, as if nothing came before it: its first lock
    (``lock_at``, ``lock_type``), and over its rows before that the last version and payload with their places,
    whether one deletes, and their number. States of consecutive stretches merge (:func:`merge_folds`).

    Rows are reduced within (item, chunk) after one exchange; chunk states, one small row each, merge per item."""
    chunk = default_chunk(log.sparkSession) if chunk is None else chunk
    ck = F.floor(F.col("seq") / F.lit(chunk)).cast("long") if chunk else F.lit(0).cast("long")
    t, rows = F.col("type"), _history(log)
    rows = rows.withColumn("_at", _at(rows)).withColumn("_chunk", ck)
    here = Window.partitionBy("aggregate_id", "_chunk")
    for f, (acc, _) in FAMILIES.items():
        rows = rows.withColumn(f"_lock_{f}", F.min(F.when(~t.isin(*acc), F.col("_at"))).over(here))

    def state(f: str):
        acc, sets = FAMILIES[f]
        live = t.isin(*acc) & (F.col(f"_lock_{f}").isNull() | (F.col("_at") < F.col(f"_lock_{f}")))
        paid = live & t.isin(*sets)
        return [F.max_by("version", F.when(live, F.col("_at"))).alias(f"{f}_version"), F.max(F.when(live, F.col("_at"))).alias(f"{f}_version_at"),
                F.max_by("settings", F.when(paid, F.col("_at"))).alias(f"{f}_settings"), F.max(F.when(paid, F.col("_at"))).alias(f"{f}_settings_at"),
                F.coalesce(F.max(F.when(live, t == Types.DELETED)), F.lit(False)).alias(f"{f}_deleted"), F.first(f"_lock_{f}").alias(f"{f}_lock_at"),
                F.min_by(t, F.when(~t.isin(*acc), F.col("_at"))).alias(f"{f}_lock_type"), F.count(F.when(live, 1)).alias(f"{f}_applied")]

    wide = rows.groupBy("aggregate_id", "_chunk").agg(*[c for f in FAMILIES for c in state(f)])
    fields = ("version", "version_at", "settings", "settings_at", "deleted", "lock_at", "lock_type", "applied")
    per_family = [F.struct(F.lit(f).alias("family"), *[F.col(f"{f}_{c}").alias(c) for c in fields]) for f in FAMILIES]
    states = wide.select("aggregate_id", "_chunk", F.explode(F.array(*per_family)).alias("_f")).select("aggregate_id", "_chunk", "_f.*")
    return _merged(states, "_chunk")


def _merged(states: DataFrame, stretch: str) -> DataFrame:
    """One state per item and family of those of its stretches, in the order of ``stretch``: stretches after the first
    that locks count for nothing, of the others the last value of each kind stands."""
    w = Window.partitionBy(*_KEY)
    kept = (states.withColumn("_locks", F.min(F.when(F.col("lock_at").isNotNull(), F.col(stretch))).over(w))
            .where(F.col("_locks").isNull() | (F.col(stretch) <= F.col("_locks"))))
    return kept.groupBy(*_KEY).agg(
        F.max_by("version", "version_at").alias("version"), F.max("version_at").alias("version_at"),
        F.max_by("settings", "settings_at").alias("settings"), F.max("settings_at").alias("settings_at"), F.max("deleted").alias("deleted"),
        F.min("lock_at").alias("lock_at"), F.min_by("lock_type", "lock_at").alias("lock_type"), F.sum("applied").alias("applied"))


def merge_folds(earlier: DataFrame, *later: DataFrame) -> DataFrame:
    """The fold state of consecutive stretches, given in order: a stored state resumes with the state of new rows."""
    out = earlier.withColumn("_stretch", F.lit(0))
    for i, state in enumerate(later, 1):
        out = out.unionByName(state.withColumn("_stretch", F.lit(i)))
    return _merged(out, "_stretch")


def folded(state: DataFrame) -> DataFrame:
    """A fold state as the rows of :func:`fold_families`."""
    return state.select("aggregate_id", "family", "version", "settings", "deleted", F.col("lock_at").isNotNull().alias("locked"), "lock_type",
                        F.col("lock_at.seq").alias("lock_seq"), "applied")
