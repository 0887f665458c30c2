"""Command validation against the latest state (OP-34, 40, 44, 07).

Each command row is checked against the latest event of its target item (and,
for a clone, of its source item) in the order the original aggregate does:
history, lock, deletion, authorship. The state table has one row per item;
it is joined by key (Spark broadcasts it when its measured size is under the
session threshold, and splits skewed target keys under AQE otherwise).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions.predicates import author_differs, clone_visible, is_locked, within_timeout
from eventfold.functions.settings import version_next
from eventfold.operators.asof import attach_last_before
from eventfold.operators.state import latest_state
from eventfold.schema import (
    DERIVED, HISTORY_NOT_FOUND_ARG, PERSISTENCE_ACCEPTS, SELECTION_ACCEPTS, Errors, Types,
)

OUT_TYPE = {
    "select": Types.PARTIAL_SELECT, "deselect": Types.PARTIAL_DESELECT, "clear": Types.PARTIAL_CLEAR_SELECTION,
    "save": Types.PARTIAL_SAVE, "update": Types.PARTIAL_SAVE, "delete": Types.CHECK_DELETE,
    "clone": Types.CLONE, "update_accessed_date": Types.UPDATE_ACCESSED_DATE,
}
SELECTION_COMMANDS = ("select", "deselect", "clear")


def _state_view(state: DataFrame, alias: str) -> DataFrame:
    return state.select(F.col("aggregate_id").alias(f"{alias}_key"),
                        F.struct("aggregate_id", "type", "version", "user_id", "session_id", "date",
                                 F.col("settings.shared").alias("shared"), "fail_event_type").alias(alias))


def decision_state(log: DataFrame) -> DataFrame:
    """The latest state of every item, of the columns that decisions and their events read."""
    narrow = [c for c in ("seq", "hop", "aggregate_id", "type", "version", "user_id", "session_id", "date", "fail_event_type") if c in log.columns]
    return latest_state(log.select(*narrow, F.struct(F.col("settings.shared").alias("shared")).alias("settings")))


def decide(commands: DataFrame, state: DataFrame, selection_accepts: Sequence[str] = SELECTION_ACCEPTS,
           persistence_accepts: Sequence[str] = PERSISTENCE_ACCEPTS) -> DataFrame:
    """Commands plus ``decision`` (ACCEPTED / REJECTED / IGNORED), ``out_type``,
    ``version``, ``error_type``, ``error_args`` and the looked-up states
    ``_st`` (target) and ``_src`` (clone source), every command against the
    same state table. A state whose type its family does not accept (the
    ``*_accepts`` sets) locks the item."""
    # Only clones have a source; the other commands get a key that can match
    # nothing - (false, their own cmd_seq) - instead of null, so they spread
    # over the shuffle instead of all hashing into the one null-key partition.
    src_state = _state_view(state, "_src").withColumn("_src_has", F.lit(True))
    cmds = commands.select(
        "*", F.col("source_id").isNotNull().alias("_has_src"),
        F.coalesce(F.col("source_id"), F.col("cmd_seq").cast("string")).alias("_src_probe"))
    x = (cmds
         .join(_state_view(state, "_st"), F.col("target_id") == F.col("_st_key"), "left")
         .join(src_state, (F.col("_has_src") == F.col("_src_has")) & (F.col("_src_probe") == F.col("_src_key")),
               "left")
         .drop("_st_key", "_src_key", "_src_has", "_has_src", "_src_probe"))
    return _decide_looked_up(x, selection_accepts, persistence_accepts)


def decide_as_of(commands: DataFrame, log: DataFrame, chunk: int | None = None,
                 selection_accepts: Sequence[str] = SELECTION_ACCEPTS,
                 persistence_accepts: Sequence[str] = PERSISTENCE_ACCEPTS) -> DataFrame:
    """Point-in-time decisions: each command (ordered by ``cmd_seq`` on the
    log's ``seq`` axis) against the latest event of its target - and of its
    clone source - strictly before it in (seq, hop) order; one row per command. Commands enter the log's as-of scan as
    rows keyed by the item they read (a clone twice), so there is no state
    table and no join; a hot item is split like any other key."""
    state_val = F.struct("aggregate_id", "type", "version", "user_id", "session_id", "date",
                         F.col("settings.shared").alias("shared"), "fail_event_type")
    cols = commands.columns
    events = log.where(F.col("aggregate_id").isNotNull()).select(
        F.struct(F.lit(True).alias("item"), F.col("aggregate_id").alias("id")).alias("_k"), F.col("seq").alias("_ord"), F.lit(3).alias("_role"),
        (F.coalesce(F.col("hop"), F.lit(0)) if "hop" in log.columns else F.lit(0)).alias("_hop"), F.lit(None).cast("long").alias("_row"),
        state_val.alias("_state"), F.lit(None).cast(commands.select(F.struct(*cols).alias("c")).schema["c"].dataType)
        .alias("_cmd"))
    # every command once per item it reads (role 1: target, 2: source), and once (role 0) under a key that is no
    # item's, so one without any still has its row and all its rows come from one computation of the row numbers.
    # At equal seq commands come before events, so a command never sees an event at its own place.
    reads = F.array(F.struct(F.lit(1).alias("role"), F.lit(True).alias("item"), F.col("target_id").alias("id")),
                    F.struct(F.lit(2).alias("role"), F.lit(True).alias("item"), F.col("source_id").alias("id")),
                    F.struct(F.lit(0).alias("role"), F.lit(False).alias("item"), F.col("_row").cast("string").alias("id")))
    asks = (commands.withColumn("_row", F.monotonically_increasing_id())
            .select("_row", F.struct(*cols).alias("_cmd"), F.col("cmd_seq").alias("_ord"),
                    F.explode(F.filter(reads, lambda r: r["id"].isNotNull())).alias("_r"))
            .select(F.struct("_r.item", "_r.id").alias("_k"), "_ord", F.col("_r.role").alias("_role"), F.lit(0).alias("_hop"), "_row",
                    F.lit(None).cast(events.schema["_state"].dataType).alias("_state"), "_cmd"))
    seen = attach_last_before(events.unionByName(asks), "_k", "_ord",
                              {"_seen": (F.col("_role") == 3, F.col("_state"))},
                              tiebreak=("_role", "_hop"), chunk=chunk, want=F.col("_role") < 3)
    # target and source states meet per command (at most three rows each)
    per_cmd = (seen.where(F.col("_role") < 3).select("_row", "_role", "_cmd", "_seen")
               .groupBy("_row")
               .agg(F.first("_cmd").alias("_cmd"),
                    F.max_by("_seen", F.when(F.col("_role") == 1, F.lit(1))).alias("_st"),
                    F.max_by("_seen", F.when(F.col("_role") == 2, F.lit(1))).alias("_src")))
    x = per_cmd.select("_cmd.*", "_st", "_src")
    return _decide_looked_up(x, selection_accepts, persistence_accepts)


def _decide_looked_up(x: DataFrame, selection_accepts: Sequence[str] = SELECTION_ACCEPTS,
                      persistence_accepts: Sequence[str] = PERSISTENCE_ACCEPTS) -> DataFrame:
    """The decision rules of the original aggregates, on commands that carry
    their looked-up target (``_st``) and clone-source (``_src``) states."""
    cmd, st, src = F.col("command"), F.col("_st"), F.col("_src")
    sel_family = cmd.isin(*SELECTION_COMMANDS)

    def locked(s: Column) -> Column:
        return s.isNotNull() & F.when(sel_family, is_locked(s["type"], selection_accepts)) \
            .otherwise(is_locked(s["type"], persistence_accepts))

    def deleted(s: Column) -> Column:
        return s.isNotNull() & (s["type"] == Types.DELETED)

    no_state, st_locked, st_deleted = st.isNull(), locked(st), deleted(st)
    differs = author_differs(st["user_id"], F.col("user_id"))

    history = (F.lit(Errors.HISTORY_NOT_FOUND), F.array(F.lit(HISTORY_NOT_FOUND_ARG), F.col("target_id")))
    locked_err = (F.lit(Errors.ITEM_LOCKED), F.array(F.lit("id"), st["aggregate_id"]))
    not_found = (F.lit(Errors.ITEM_NOT_FOUND), F.array(F.lit("id"), F.col("target_id")))
    forbidden = (F.lit(Errors.CHANGE_FORBIDDEN), F.lit(None).cast("array<string>"))
    ok = (None, None)
    ignored = ("IGNORED", None)

    # (condition, outcome) in evaluation order, per command
    def rules(c: str) -> list[tuple[Column, tuple]]:
        if c == "select":
            return [(no_state, ok), (st_locked, locked_err), (differs, forbidden)]
        if c in ("deselect", "clear", "update", "delete"):
            r = [(no_state, history), (st_locked, locked_err)]
            if c in ("update", "delete"):
                r.append((st_deleted, not_found))
            return r + [(differs, forbidden)]
        if c == "save":
            return [(no_state, ok), (st_locked, locked_err), (st_deleted, ok), (differs, forbidden)]
        if c == "update_accessed_date":
            return [(no_state, history), (st_locked, locked_err), (st_deleted, not_found)]
        if c == "clone":
            src_history = (F.lit(Errors.HISTORY_NOT_FOUND), F.array(F.lit(HISTORY_NOT_FOUND_ARG), F.col("source_id")))
            src_locked = (F.lit(Errors.ITEM_LOCKED), F.array(F.lit("id"), src["aggregate_id"]))
            src_missing = (F.lit(Errors.ITEM_NOT_FOUND), F.array(F.lit("id"), F.col("source_id")))
            return [
                (st_locked, locked_err),
                (st.isNotNull() & ~st_deleted, ignored),
                (src.isNull(), src_history),
                (locked(src), src_locked),
                # a deleted new id leaves the deleted flag set (quirk Q9)
                (deleted(src) | st_deleted, src_missing),
                (~clone_visible(src["user_id"], F.struct(src["shared"].alias("shared")), F.col("user_id")),
                 forbidden),
            ]
        raise KeyError(c)

    err_type, err_args, status = None, None, None
    for c in OUT_TYPE:
        for cond, (etype, eargs) in rules(c):
            guard = (cmd == c) & cond
            if isinstance(etype, str):  # IGNORED
                s_val, t_val, a_val = F.lit("IGNORED"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
            elif etype is None:
                s_val, t_val, a_val = F.lit("ACCEPTED"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
            else:
                s_val, t_val, a_val = F.lit("REJECTED"), etype, eargs
            status = F.when(guard, s_val) if status is None else status.when(guard, s_val)
            err_type = F.when(guard, t_val) if err_type is None else err_type.when(guard, t_val)
            err_args = F.when(guard, a_val) if err_args is None else err_args.when(guard, a_val)
    known = cmd.isin(*OUT_TYPE)
    status = status.when(known, F.lit("ACCEPTED")).otherwise(F.lit("IGNORED"))
    out_type = F.create_map(*[x for k, v in OUT_TYPE.items() for x in (F.lit(k), F.lit(v))])[cmd]
    accepted = status == "ACCEPTED"
    return x.select(
        "*",
        status.alias("decision"),
        F.when(accepted, out_type).alias("out_type"),
        F.when(accepted, version_next(cmd, st["version"])).alias("version"),
        err_type.alias("error_type"),
        err_args.alias("error_args"),
    )


def command_decisions(commands: DataFrame, log: DataFrame) -> DataFrame:
    """OP-34 over an event log: decisions against its latest state (OP-08)."""
    d = decide(commands, decision_state(log))
    return d.select("cmd_seq", "decision", "out_type", "version", "error_type", "error_args")


def _log_shaped(rows: DataFrame) -> DataFrame:
    """The rows with every column of a stored log (``hop`` and ``EVENT_LOG``), null where they have none."""
    kinds = {f.name: f.dataType for f in DERIVED.fields}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in kinds])


def command_events(decided: DataFrame) -> DataFrame:
    """OP-07: accepted commands as rows of the stored log, keyed by the item id,
    with event id ``c<cmd_seq>``. A clone also emits an access-date event on its
    source item (version = source version + 1, event id ``c<cmd_seq>#1``)."""
    acc = decided.where(F.col("decision") == "ACCEPTED")
    cause = F.concat(F.lit("c"), F.col("cmd_seq").cast("string"))
    main = acc.select(
        F.col("cmd_seq").alias("seq"), F.lit(0).alias("hop"), cause.alias("event_id"),
        F.col("target_id").alias("aggregate_id"), F.col("out_type").alias("type"),
        "version", "user_id", "session_id", F.col("as_of").alias("date"), "selection_req", "persistence")
    side = acc.where(F.col("command") == "clone").select(
        F.col("cmd_seq").alias("seq"), F.lit(1).alias("hop"), F.concat(cause, F.lit("#1")).alias("event_id"),
        F.col("source_id").alias("aggregate_id"), F.lit(Types.UPDATE_ACCESSED_DATE).alias("type"),
        (F.col("_src.version") + 1).cast("int").alias("version"), "user_id", "session_id", F.col("as_of").alias("date"))
    return _log_shaped(main).unionByName(_log_shaped(side))


def stuck_rollback(decided: DataFrame, timeout_ms: int, mode: str = "reference") -> DataFrame:
    """OP-40: after an ItemLocked rejection, a PREPARE_ROLLBACK for the item's
    latest event when that event passes the timeout test (OP-20), as a row of the
    stored log at the command's place (event id ``c<cmd_seq>#rollback``). The
    state looked at is the command's target (for a clone: the new id, as in the
    original). A rollback-failed event passes on the type it carries."""
    st = F.col("_st")
    locked = (F.col("decision") == "REJECTED") & (F.col("error_type") == Errors.ITEM_LOCKED)
    fires = locked & st.isNotNull() & within_timeout(st["date"], F.col("as_of"), timeout_ms, mode)
    fail_type = F.when(st["type"] == Types.ROLLBACK_FAILED, st["fail_event_type"]).otherwise(st["type"])
    return _log_shaped(decided.where(fires).select(
        F.col("cmd_seq").alias("seq"), F.lit(1).alias("hop"),
        F.concat(F.lit("c"), F.col("cmd_seq").cast("string"), F.lit("#rollback")).alias("event_id"),
        st["aggregate_id"].alias("aggregate_id"), F.lit(Types.PREPARE_ROLLBACK).alias("type"),
        st["version"].alias("version"), st["user_id"].alias("user_id"), st["session_id"].alias("session_id"),
        st["date"].alias("date"), fail_type.alias("fail_event_type")))


def locked_alerts(decided: DataFrame, timeout_ms: int, mode: str = "reference") -> DataFrame:
    """OP-50: an alert for every rollback that a locked item sets off."""
    return stuck_rollback(decided, timeout_ms, mode).select(
        "seq", "aggregate_id", F.lit("ITEM_LOCKED").alias("kind"), F.col("fail_event_type").alias("type"), "session_id", "date")
