"""Reference hooks of the generic lifecycle (OP-35, OP-38)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.operators.asof import attach_last_before, running_totals
from eventfold.schema import Errors


@dataclass(frozen=True)
class Lookup:
    """A related-item table joined by ``fk`` (on the events) = ``pk`` (on the
    table), adding ``columns``. How it is joined is left to the optimizer's
    measured sizes."""
    table: DataFrame
    fk: str
    pk: str
    columns: Sequence[str]


def enrich_reference(events: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """OP-35: left-join each event with the related items it points at; the
    lookups apply in order, so a later one may use columns an earlier added."""
    out = events
    for lk in lookups:
        dim = lk.table.select(F.col(lk.pk).alias(f"_pk_{lk.pk}"), *lk.columns)
        out = out.join(dim, F.col(lk.fk) == F.col(f"_pk_{lk.pk}"), "left").drop(f"_pk_{lk.pk}")
    return out


def delete_reference_check(requests: DataFrame, key: str, references: DataFrame, ref_key: str) -> DataFrame:
    """OP-38: a delete request whose item is still referenced is refused with
    ``ItemReferenced(field, value)``; others are allowed. References are first
    reduced to distinct keys (partial aggregate, so a much-referenced item is
    collapsed map-side), then joined once."""
    refs = references.where(F.col(ref_key).isNotNull()).select(F.col(ref_key).alias("_ref")).distinct()
    x = requests.join(refs, F.col(key) == F.col("_ref"), "left")
    referenced = F.col("_ref").isNotNull()
    return x.select(
        *requests.columns,
        F.when(referenced, "REFUSED").otherwise("ALLOWED").alias("decision"),
        F.when(referenced, F.lit(Errors.ITEM_REFERENCED)).alias("error_type"),
        F.when(referenced, F.lit(ref_key)).alias("ref_field"),
        F.when(referenced, F.col(key).cast("string")).alias("ref_value"),
    )


def reference_changes(references: DataFrame, referrer: str, item: str, order: str, chunk: int | None = None) -> DataFrame:
    """References that come and go, as signed changes: ``references`` says at each ``order`` which item a referrer
    now points at (null: none). A row that changes this retracts the old reference (-1) and adds the new one (+1)."""
    now = references.select(F.col(referrer).alias("referrer"), F.col(item).alias("_new"), F.col(order).alias("seq")).where("referrer is not null")
    seen = attach_last_before(now, "referrer", "seq", {"_last": (F.lit(True), F.struct(F.col("_new").alias("item")))}, chunk=chunk)
    old, new = F.col("_last.item"), F.col("_new")
    changes = F.array(F.struct(old.alias("item"), F.lit(-1).alias("delta")), F.struct(new.alias("item"), F.lit(1).alias("delta")))
    return (seen.where(~old.eqNullSafe(new)).select("seq", "referrer", F.explode(changes).alias("_c"))
            .select("seq", "referrer", "_c.item", "_c.delta").where("item is not null"))


def live_reference_check(requests: DataFrame, key: str, changes: DataFrame, order: str = "seq", chunk: int | None = None) -> DataFrame:
    """OP-38 at its place: a delete request is refused while references to its item that were made before it have
    not gone. Adds ``references`` (their number), ``decision`` and ``error_type``."""
    # a request is placed before a change of equal order: it sees only what came strictly before
    asked = requests.select(F.col(key).alias("item"), F.col(order).alias("seq"), F.lit(0).alias("_rank"), F.lit(0).alias("delta"),
                            F.struct(*requests.columns).alias("_request"))
    rows = asked.unionByName(changes.select("item", "seq", F.lit(1).alias("_rank"), "delta"), allowMissingColumns=True)
    total = running_totals(rows, "item", "seq", {"references": F.col("delta")}, tiebreak=("_rank",), chunk=chunk)
    refused = F.coalesce(F.col("references"), F.lit(0)) > 0
    return (total.where("_rank = 0")
            .select("_request.*", F.coalesce("references", F.lit(0).cast("long")).alias("references"),
                    F.when(refused, "REFUSED").otherwise("ALLOWED").alias("decision"), F.when(refused, F.lit(Errors.ITEM_REFERENCED)).alias("error_type")))


def valid_runs(dimension: DataFrame, key: str, order: str, fields: Sequence[str], chunk: int | None = None) -> DataFrame:
    """A versioned dimension: the rows at which a related item's ``fields`` change, each valid from its ``order`` on."""
    values = F.struct(*[F.col(f) for f in fields])
    seen = attach_last_before(dimension.where(F.col(key).isNotNull()).select(key, order, *fields), key, order, {"_before": (F.lit(True), values)}, chunk=chunk)
    return seen.where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(values)).drop("_before")


def enrich_changing(events: DataFrame, dimension: DataFrame, fk: str, pk: str, order: str, fields: Sequence[str],
                    chunk: int | None = None) -> DataFrame:
    """OP-35 against a related item that changes: each event with the ``fields`` that its item had just before it.
    Events and versions meet in one as-of scan, so an item that very many events point at is split like any key.
    Events without related item, or before its first version, keep nulls."""
    version = F.struct(*[F.col(f) for f in fields])
    rows = (events.select(F.col(fk).alias("_k"), F.col(order).alias("_o"), F.struct(*events.columns).alias("_event"))
            .unionByName(dimension.select(F.col(pk).alias("_k"), F.col(order).alias("_o"), version.alias("_version")), allowMissingColumns=True))
    seen = attach_last_before(rows, "_k", "_o", {"_seen": (F.col("_version").isNotNull(), F.col("_version"))}, chunk=chunk, want=F.col("_event").isNotNull())
    return seen.where(F.col("_event").isNotNull()).select("_event.*", *[F.col(f"_seen.{f}").alias(f) for f in fields])
