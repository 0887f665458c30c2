"""Registered queries: name -> (spark callable, DuckDB oracle SQL or None).

Each callable takes ``(spark, sf_dir)``, reads the driver's tables there and
returns a flat DataFrame whose column names equal the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventfold.operators.derive import derive_once, RULES, derive
from eventfold.plans import oracle_sql as osql
from eventfold.plans.reports import flatten_events
from eventfold.sources.fixtures import lifecycle_log

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _rule_query(rule: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten_events(derive(lifecycle_log(spark, sf_dir), [rule]))
    q.__name__ = rule
    q.__doc__ = f"Derived events of the {rule} rule over the fixture log."
    return q


for _r in RULES:
    register(_r.name, osql.derive_sql([_r.name]))(_rule_query(_r.name))


@register("derive_once", osql.derive_sql())
def derive_once_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-46a: every derived event of the seventeen rules in one pass per key."""
    return flatten_events(derive(lifecycle_log(spark, sf_dir)))


# --- state, fold, decisions ---------------------------------------------------

from pyspark.sql import functions as F  # noqa: E402

from eventfold.operators import decisions as dec  # noqa: E402
from eventfold.operators import outcomes as oc  # noqa: E402
from eventfold.operators import state as stt  # noqa: E402
from eventfold.operators.derive import derive_once, session_mismatch_report  # noqa: E402
from eventfold.operators.fold import fold_families, fold_stretch, folded, merge_folds  # noqa: E402
from eventfold.plans import oracle_state_sql as ssql  # noqa: E402
from eventfold.plans.reports import settings_columns, us  # noqa: E402
from eventfold.schema import Types  # noqa: E402
from eventfold.sources.fixtures import (  # noqa: E402
    changing_items, decision_log, handler_log, history_log, outcome_log, reference_log, tombstone_log,
)

TIMEOUT_MS = ssql.TIMEOUT_MS


@register("latest_state", ssql.latest_state_sql())
def latest_state_q(spark, sf_dir):
    """OP-08: latest event of any type per item."""
    return flatten_events(stt.latest_state(lifecycle_log(spark, sf_dir)))


@register("latest_by_key", ssql.latest_by_key_sql())
def latest_by_key_q(spark, sf_dir):
    """OP-39: the snapshot table, latest final event per item."""
    return flatten_events(stt.snapshot_table(lifecycle_log(spark, sf_dir)))


@register("state_get", ssql.state_get_sql())
def state_get_q(spark, sf_dir):
    """OP-09: state of every item named as a save/clone source."""
    log = lifecycle_log(spark, sf_dir)
    wanted = log.where(F.col("type").isin(Types.PARTIAL_SAVE, Types.CLONE)).select("persistence.settings_id")
    return flatten_events(stt.state_get(stt.latest_state(log), wanted))


@register("sink_snapshot", ssql.filter_sql(["SAVED", "SELECTED", "DESELECTED", "SELECTION_CLEARED"]))
def sink_snapshot_q(spark, sf_dir):
    """OP-05: the rows forwarded to the snapshot sink."""
    return flatten_events(stt.snapshot_events(lifecycle_log(spark, sf_dir)))


@register("filter_type", ssql.filter_sql(["PARTIAL_SELECT"]))
def filter_type_q(spark, sf_dir):
    """OP-10: one event type."""
    return flatten_events(stt.filter_type(lifecycle_log(spark, sf_dir), Types.PARTIAL_SELECT))


@register("delete_relay", ssql.delete_relay_sql())
def delete_relay_q(spark, sf_dir):
    """OP-47: delete checks and confirmations relayed as DELETE / DELETED."""
    return flatten_events(oc.delete_relay(lifecycle_log(spark, sf_dir)))


@register("event_router", ssql.event_router_sql())
def event_router_q(spark, sf_dir):
    """OP-51: handler action per event; unrouted types discarded."""
    return oc.event_router(handler_log(spark, sf_dir))


@register("session_mismatch_report", ssql.session_mismatch_sql())
def session_mismatch_q(spark, sf_dir):
    """OP-45: confirmations from another session than their request."""
    r = session_mismatch_report(lifecycle_log(spark, sf_dir))
    return r.select("seq", "aggregate_id", "kind", "type", "session_id", "request_session_id",
                    us(F.col("date")).alias("date_us"))


@register("fold_history", ssql.fold_history_sql())
def fold_history_q(spark, sf_dir):
    """OP-33/19: each item's history folded per aggregate family."""
    st = history_log(spark, sf_dir)
    f = fold_families(st)
    return f.select("aggregate_id", "family", "version", "deleted", "locked", "lock_type", "lock_seq", "applied",
                    *settings_columns(F.col("settings")))


def _decided(spark, sf_dir):
    state, cmds = decision_log(spark, sf_dir)
    return dec.decide(cmds, dec.decision_state(state))


@register("command_decisions", ssql.decisions_sql())
def command_decisions_q(spark, sf_dir):
    """OP-34/44: every command accepted, rejected or ignored against the latest state."""
    d = _decided(spark, sf_dir)
    return d.select("cmd_seq", "command", "decision", "out_type", "version", "error_type",
                    F.array_join("error_args", ",").alias("error_args"))


@register("command_events", ssql.command_events_sql())
def command_events_q(spark, sf_dir):
    """OP-07: accepted commands as log events (plus a clone's access-date event)."""
    e = dec.command_events(_decided(spark, sf_dir))
    return e.select("seq", "hop", "event_id", "aggregate_id", "type", "version", "user_id", "session_id",
                    us(F.col("date")).alias("date_us"))


@register("stuck_rollback", ssql.stuck_rollback_sql())
def stuck_rollback_q(spark, sf_dir):
    """OP-40/20: rollbacks for lock rejections whose blocking event passes the timeout test."""
    r = dec.stuck_rollback(_decided(spark, sf_dir), TIMEOUT_MS)
    return r.select(F.col("seq").alias("cmd_seq"), "event_id", "aggregate_id", "type", "version", "user_id", "session_id",
                    us(F.col("date")).alias("date_us"), "fail_event_type")


def _outcomes(spark, sf_dir):
    ev = outcome_log(spark, sf_dir)
    return oc.command_outcome(ev, F.col("type") == "COMMAND", TIMEOUT_MS)


@register("command_outcome", ssql.command_outcome_sql())
def command_outcome_q(spark, sf_dir):
    """OP-48: first terminal event of each command's session, or TIMEOUT."""
    o = _outcomes(spark, sf_dir)
    return o.select("seq", "session_id", "aggregate_id", "type", us(F.col("date")).alias("date_us"), "status",
                    "terminal_seq", "error_type")


@register("command_timeout", ssql.command_timeout_sql())
def command_timeout_q(spark, sf_dir):
    """OP-49: timed-out commands with their compensating rollback."""
    t = oc.command_timeout(_outcomes(spark, sf_dir))
    return t.select("seq", "session_id", "aggregate_id", "error_type", "rollback_type", "fail_event_type",
                    us(F.col("date")).alias("date_us"))


# --- generic lifecycle, references, sources ----------------------------------

from pyspark.sql import types as T  # noqa: E402

from eventfold.operators.references import (  # noqa: E402
    Lookup, delete_reference_check, enrich_changing, enrich_reference, live_reference_check, reference_changes, valid_runs,
)
from eventfold.plans.lifecycle import LifecycleSpec, build_lifecycle, partial_update  # noqa: E402
from eventfold.sources.fixtures import damaged_events, generic_log, read_table  # noqa: E402
from eventfold.sources.log import split_malformed  # noqa: E402


@register("generic_lifecycle", osql.generic_sql())
def generic_lifecycle_q(spark, sf_dir):
    """OP-52: the generic lifecycle spec (create/update confirm, update/delete cancel, rollback)."""
    return flatten_events(build_lifecycle(generic_log(spark, sf_dir), LifecycleSpec()))


def _generic_rule_query(rule: str):
    def q(spark, sf_dir):
        return flatten_events(build_lifecycle(generic_log(spark, sf_dir), LifecycleSpec(), only=[rule]))
    q.__doc__ = f"Generic lifecycle rule {rule}."
    return q


for _g in ("create_confirm", "update_confirm", "update_cancel"):
    register(_g, osql.generic_sql([_g]))(_generic_rule_query(_g))


@register("partial_update", osql.generic_sql(["partial_update"]))
def partial_update_q(spark, sf_dir):
    """OP-53: confirmed partial edits merged over the last good snapshot."""
    return flatten_events(partial_update(generic_log(spark, sf_dir)))


@register("enrich_reference", osql.enrich_reference_sql())
def enrich_reference_q(spark, sf_dir):
    """OP-35: orders enriched with their customer and the customer's nation."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    out = enrich_reference(orders, [
        Lookup(read_table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", ["c_name", "c_nationkey"]),
        Lookup(read_table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", ["n_name"]),
    ])
    return out


@register("delete_reference_check", osql.delete_reference_check_sql())
def delete_reference_check_q(spark, sf_dir):
    """OP-38: every part, and as many keys past the last part, as a delete request, refused while a line item
    references it."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey")
    last = parts.agg(F.max("p_partkey")).scalar()
    requests = parts.unionByName(parts.select((F.col("p_partkey") + last).alias("p_partkey")))
    return delete_reference_check(requests, "p_partkey", read_table(spark, sf_dir, "lineitem"), "l_partkey")


@register("src_malformed_skip", osql.malformed_sql())
def src_malformed_skip_q(spark, sf_dir):
    """OP-04: decode each event's JSON properties; undecodable rows are quarantined."""
    good, _bad = split_malformed(damaged_events(spark, sf_dir), "props", T.StructType([T.StructField("k", T.IntegerType())]))
    return good.select("event_id", "k")


@register("quarantine", osql.quarantine_sql())
def quarantine_q(spark, sf_dir):
    """OP-04: the rows that cannot be decoded."""
    _good, bad = split_malformed(damaged_events(spark, sf_dir), "props", T.StructType([T.StructField("k", T.IntegerType())]))
    return bad


# --- closure (no SQL oracle: a fixpoint over derived rows) -------------------

from eventfold.operators.closure import lifecycle_closure  # noqa: E402


@register("lifecycle_closure")
def lifecycle_closure_q(spark, sf_dir):
    """OP-46b: the fixture log closed under every rule (derived events re-enter the log)."""
    return flatten_events(lifecycle_closure(lifecycle_log(spark, sf_dir)))


@register("alerts", ssql.alerts_sql())
def alerts_q(spark, sf_dir):
    """OP-45 + OP-50: the alert frame: session mismatches, failed rollbacks, timeouts and locked items."""
    log = handler_log(spark, sf_dir)
    a = oc.alerts(session_mismatch_report(log), log, oc.timeout_alerts(_outcomes(spark, sf_dir)),
                  dec.locked_alerts(_decided(spark, sf_dir), TIMEOUT_MS))
    return a.select("seq", "aggregate_id", "kind", "type", "session_id", us(F.col("date")).alias("date_us"))


@register("closed_log_state", ssql.closed_log_state_sql())
def closed_log_state_q(spark, sf_dir):
    """OP-08 over a log that holds derived rows: the latest event per item in (seq, hop) order."""
    log = lifecycle_log(spark, sf_dir)
    both = log.withColumn("hop", F.lit(0)).unionByName(derive_once(log))
    last = flatten_events(stt.latest_state(both))
    return last.select("aggregate_id", *[c for c in last.columns if c not in ("aggregate_id", "hop")], "hop")


@register("command_decisions_as_of", ssql.decisions_as_of_sql())
def command_decisions_as_of_q(spark, sf_dir):
    """OP-34 point-in-time: commands among the state rows, each against its items' latest events before it, in
    the log's as-of scan."""
    state, cmds = decision_log(spark, sf_dir, interleaved=True)
    d = dec.decide_as_of(cmds, state)
    return d.select("cmd_seq", "command", "decision", "out_type", "version", "error_type",
                    F.array_join("error_args", ",").alias("error_args"))


from eventfold.operators.loop import command_loop, command_path  # noqa: E402
from eventfold.sources.fixtures import command_path_log  # noqa: E402


@register("command_path")
def command_path_q(spark, sf_dir):
    """OP-34/07/40/46b/48: every command decided on the log that the commands before it led to, with its outcome (a
    fixpoint of decisions and log; held against rounds of the set-based operators in the tests)."""
    external, commands = command_path_log(spark, sf_dir)
    path = command_loop(commands, external, TIMEOUT_MS)
    return command_path(path, commands, TIMEOUT_MS).withColumn("error_args", F.array_join("error_args", ","))


@register("timeout_rollbacks", ssql.timeout_rollbacks_sql())
def timeout_rollbacks_q(spark, sf_dir):
    """OP-49: the rollbacks of timed-out commands as rows of the stored log."""
    r = oc.timeout_rollbacks(_outcomes(spark, sf_dir))
    return r.select("seq", "hop", "event_id", "aggregate_id", "type", "version", "user_id", "session_id", us(F.col("date")).alias("date_us"),
                    "exception_type", "fail_event_type")


@register("tombstone_tables", ssql.tombstone_sql())
def tombstone_tables_q(spark, sf_dir):
    """OP-08/39 with delete markers: the table that ignores them beside the store that deletes on them."""
    log, gone = tombstone_log(spark, sf_dir)
    t = stt.tombstone_tables(log, gone)
    return t.select("aggregate_id", F.col("table.seq").alias("table_seq"), F.col("table.type").alias("table_type"),
                    F.col("store.seq").alias("store_seq"), F.col("store.type").alias("store_type"))


@register("fold_resumed", ssql.fold_history_sql())
def fold_resumed_q(spark, sf_dir):
    """OP-33: the fold of three stretches of history, merged; equal to the fold of the whole."""
    log = history_log(spark, sf_dir)
    edge = log.agg(F.struct(F.min("seq").alias("lo"), (F.max("seq") + 1).alias("hi"))).scalar()
    part = F.floor((F.col("seq") - edge["lo"]) * 3 / (edge["hi"] - edge["lo"]))  # thirds of the axis; any cut does
    parts = [fold_stretch(log.where(part == i)) for i in range(3)]
    f = folded(merge_folds(*parts))
    return f.select("aggregate_id", "family", "version", "deleted", "locked", "lock_type", "lock_seq", "applied",
                    *settings_columns(F.col("settings")))


@register("live_references", ssql.live_references_sql())
def live_references_q(spark, sf_dir):
    """OP-38 at its place: delete requests against references that come and go."""
    refs, requests = reference_log(spark, sf_dir)
    return live_reference_check(requests, "item", reference_changes(refs, "referrer", "item", "seq"))


@register("enrich_changing", ssql.enrich_changing_sql())
def enrich_changing_q(spark, sf_dir):
    """OP-35: events enriched with what their related item was just before them."""
    events, versions = changing_items(spark, sf_dir)
    return enrich_changing(events, valid_runs(versions, "item_id", "seq", ["level", "team"]), "related_id", "item_id", "seq", ["level", "team"])


@register("valid_runs", ssql.valid_runs_sql())
def valid_runs_q(spark, sf_dir):
    """The versions of the related items: rows at which a value changes."""
    return valid_runs(changing_items(spark, sf_dir)[1], "item_id", "seq", ["level", "team"])
