"""OP-52: the reusable event-sourcing lifecycle, as a spec of Column callbacks.

A service describes its item lifecycle once - which types are final
(snapshots), how a confirmation and its request make the confirmed event,
how a failure and the last snapshot make the cancellation, how a rollback
reads the last snapshot - plus optional DataFrame hooks (enrichment before
create/update, reference check before delete, extra rules). ``build_lifecycle``
turns it into one derivation over the log: all own-key rules share one as-of
pass, exactly as the settings lifecycle does.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions.predicates import same_session
from eventfold.operators.derive import REQUEST_FIELDS, SNAP, Rule, derive
from eventfold.schema import SETTINGS, Types

Build = Callable[..., dict[str, Column]]


def confirmed(out_type: str) -> Build:
    """Default create/update confirmation: the request's payload, same session only."""
    def build(req: Column, as_of: Column) -> dict[str, Column]:
        ok = req.isNotNull() & same_session(F.col("session_id"), req["session_id"])
        return {"type": F.when(ok, F.lit(out_type)), "settings": F.when(ok, req["settings"])}
    return build


def cancelled(out_type: str) -> Build:
    """Default cancellation: the last snapshot's payload and the failure's error."""
    def build(snap: Column, as_of: Column) -> dict[str, Column]:
        return {"type": F.when(snap.isNotNull(), F.lit(out_type)), "settings": snap["settings"],
                "exception_type": F.col("exception_type"), "arguments": F.col("arguments")}
    return build


def rolled_back(snap: Column, as_of: Column) -> dict[str, Column]:
    """Default rollback: the last snapshot (or null) with the failed type kept."""
    return {"type": F.lit(Types.ROLLBACK), "last_snapshot_item": snap["settings"],
            "fail_event_type": F.col("fail_event_type")}


def merged_update(req: Column, snap: Column, as_of: Column) -> dict[str, Column]:
    """OP-53 default: edited fields over the last good snapshot's fields."""
    ok = req.isNotNull() & same_session(F.col("session_id"), req["session_id"])
    edit, last = req["settings"], snap["settings"]
    merged = F.struct(*[F.coalesce(edit[f.name], last[f.name]).alias(f.name) for f in SETTINGS.fields])
    return {"type": F.when(ok, F.lit(Types.UPDATED)), "settings": F.when(ok, merged)}


#: Request tables of the generic lifecycle: name to request type.
REQUESTS = {"_req_create": Types.CREATE, "_req_update": Types.UPDATE}


@dataclass
class LifecycleSpec:
    """``requests`` names the request tables (the two built-in ones can be given other types, and extra rules read
    further ones by name); ``request_fields`` are the columns of a request event that the callbacks see."""

    snapshot_types: Sequence[str] = (Types.SAVED, Types.CREATED, Types.UPDATED)
    created: Build = field(default_factory=lambda: confirmed(Types.CREATED))
    updated: Build = field(default_factory=lambda: confirmed(Types.UPDATED))
    update_cancelled: Build = field(default_factory=lambda: cancelled(Types.UPDATE_CANCELLED))
    delete_cancelled: Build = field(default_factory=lambda: cancelled(Types.DELETE_CANCELLED))
    rollback: Build = rolled_back
    extra_rules: Sequence[Rule] = ()
    enrich_create: Callable[[DataFrame], DataFrame] | None = None
    enrich_update: Callable[[DataFrame], DataFrame] | None = None
    delete_check: Callable[[DataFrame], DataFrame] | None = None
    requests: Mapping[str, str] = field(default_factory=lambda: dict(REQUESTS))
    request_fields: Sequence[str] = REQUEST_FIELDS

    def rules(self) -> list[Rule]:
        return [
            Rule("create_confirm", Types.CREATE_CONFIRMED, "_req_create", self.created),
            Rule("update_confirm", Types.UPDATE_CONFIRMED, "_req_update", self.updated),
            Rule("update_cancel", Types.UPDATE_FAILED, SNAP, self.update_cancelled),
            Rule("delete_cancel", Types.DELETE_FAILED, SNAP, self.delete_cancelled),
            Rule("rollback", Types.PREPARE_ROLLBACK, SNAP, self.rollback),
            *self.extra_rules,
        ]


def build_lifecycle(log: DataFrame, spec: LifecycleSpec | None = None, only: Sequence[str] | None = None,
                    as_of: Column | None = None, chunk: int | None = None) -> DataFrame:
    """Derived events of the generic lifecycle over ``log`` (hooks applied to
    the log first: enrichment of create/update requests)."""
    spec = spec or LifecycleSpec()
    if spec.enrich_create is not None:
        log = spec.enrich_create(log)
    if spec.enrich_update is not None:
        log = spec.enrich_update(log)
    rules = [r for r in spec.rules() if only is None or r.name in only]
    out = derive(log, rules, spec.snapshot_types, as_of, chunk, requests=dict(spec.requests),
                 request_fields=spec.request_fields)
    if spec.delete_check is not None and (only is None or "delete_check" in only):
        out = out.unionByName(spec.delete_check(log))
    return out


def referenced_delete_hook(references: DataFrame, ref_key: str, ref_field: str | None = None):
    """OP-38 as the spec's delete hook: a DELETE request whose item is still
    referenced yields DELETE_FAILED with ``ItemReferenced`` and the referencing
    field and value as arguments (the failed-delete rule then cancels it)."""
    from eventfold.operators.references import delete_reference_check
    from eventfold.schema import EVENT_COLUMNS, Errors

    field_name = ref_field or ref_key

    def hook(log: DataFrame) -> DataFrame:
        deletes = log.where(F.col("type") == Types.DELETE)
        checked = delete_reference_check(deletes, "aggregate_id", references, ref_key)
        failed = checked.where(F.col("decision") == "REFUSED")
        cols = {c: F.col(c) for c in EVENT_COLUMNS}
        cols.update({
            "event_id": F.concat(F.col("event_id"), F.lit("#1")),
            "type": F.lit(Types.DELETE_FAILED),
            "exception_type": F.lit(Errors.ITEM_REFERENCED),
            "arguments": F.create_map(F.lit(field_name), F.col("aggregate_id")),
        })
        for c in ("settings", "selection_req", "persistence", "fail_event_type", "last_snapshot_item"):
            cols[c] = F.lit(None).cast(log.schema[c].dataType)
        return failed.select(F.lit(1).alias("hop"), *[v.alias(k) for k, v in cols.items()])
    return hook


def partial_update(log: DataFrame, snapshot_types: Sequence[str] = (Types.SAVED, Types.CREATED, Types.UPDATED),
                   merge: Build = merged_update, chunk: int | None = None) -> DataFrame:
    """OP-53: UPDATE_CONFIRMED x last partial edit x last good snapshot, in one
    as-of pass: an UPDATED event with the edited fields over the old ones."""
    rule = Rule("partial_update", Types.UPDATE_CONFIRMED, ("_req_update", SNAP), merge)
    return derive(log, [rule], snapshot_types, None, chunk, requests=REQUESTS)
