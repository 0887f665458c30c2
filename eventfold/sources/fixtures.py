"""Stand-in inputs built from the driver's test tables.

These projections only shape rows of the driver's ``events`` table into the
schemas the operators expect (``EVENT_LOG``, ``COMMANDS``); they do none of the
operators' work. The same projections are written in SQL in
:mod:`eventfold.plans.oracle_sql` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.schema import COMMANDS, SETTINGS

# --- fixed values: event type of a driver row by (k % 5, event_type) ---
TYPE_BY_K5 = {
    0: {"view": "PARTIAL_SELECT", "click": "SELECT_CONFIRMED", "error": "SELECT_FAILED",
        "purchase": "SELECTED", "signup": "PREPARE_ROLLBACK"},
    1: {"view": "PARTIAL_DESELECT", "click": "DESELECT_CONFIRMED", "error": "DESELECT_FAILED",
        "purchase": "DESELECTED", "signup": "CHECK_DELETE"},
    2: {"view": "PARTIAL_CLEAR_SELECTION", "click": "CLEAR_SELECTION_CONFIRMED",
        "error": "CLEAR_SELECTION_FAILED", "purchase": "SELECTION_CLEARED", "signup": "UPDATE_ACCESSED_DATE"},
    3: {"view": "PARTIAL_SAVE", "click": "SAVE_CONFIRMED", "error": "SAVE_FAILED", "purchase": "SAVED",
        "signup": "CLONE"},
    4: {"view": None, "click": "DELETE_CONFIRMED", "error": "DELETE_FAILED", "purchase": "SAVED",
        "signup": "DELETE_CHECKED"},
}
# k % 5 == 4 and view: request type by k range
REQUEST_BY_K = [(25, "SELECT"), (50, "DESELECT"), (75, "CLEAR_SELECTION"), (None, "SAVE")]

# generic (create/update) profile, by (event_type, k % 2); None = either parity
GENERIC_BY_PARITY = {
    ("view", 0): "CREATE", ("view", 1): "UPDATE",
    ("click", 0): "CREATE_CONFIRMED", ("click", 1): "UPDATE_CONFIRMED",
    ("error", 0): "DELETE_FAILED", ("error", 1): "UPDATE_FAILED",
    ("purchase", None): "SAVED", ("signup", None): "PREPARE_ROLLBACK",
}

# profile D (decisions): state type by k % 10
PROFILE_D_TYPES = ["SAVED", "SAVED", "DELETED", "SAVE", "SAVE_CANCELLED", "SELECTED", "DESELECTED", "SELECT",
                   "SELECT_CANCELLED", "DELETE_CANCELLED"]
# profile D commands by k % 8
PROFILE_D_COMMANDS = ["select", "deselect", "clear", "save", "update", "delete", "clone", "update_accessed_date"]

# profile O (outcomes): event type by driver event_type; signup rows settle nothing
PROFILE_O_TYPES = {"view": "COMMAND", "click": "SELECTED", "error": "SELECT_CANCELLED", "purchase": "SAVED",
                   "signup": "NO_TERMINAL"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz_to_timestamp(c: Column) -> Column:
    """``timestamp_ntz`` wall clock read as UTC, independent of the session zone."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})"))


#: Rows of the driver's events that one task widens to log rows: its sorts hold some hundred MB.
TASK_ROWS = 200_000


def _with_k(events: DataFrame, *cols: str) -> DataFrame:
    """Driver columns plus ``k`` parsed from ``props``. ``json_tuple`` is a
    generator: filters on columns derived from ``k`` stay above it, so the JSON
    text is parsed once per row instead of once per reference after pushdown.

    The narrow raw columns are exchanged before that: the driver's table may be a single split, whose
    rows one task would parse, and operators that read the log in several branches (chunk summaries and
    rows) share this exchange and its one read of the table. Its tasks grow in number with the table: narrow rows
    compress well, so joining partitions by their bytes would give a task millions of rows, which it then widens."""
    tasks = max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // TASK_ROWS))
    raw = events.select(*cols, "props").repartition(tasks, "event_id")
    return (raw.select(*cols, F.json_tuple("props", "k").alias("_k_text"))
            .withColumn("k", F.col("_k_text").cast("int")).drop("_k_text"))


def _settings_id_modulus(events: DataFrame) -> Column:
    """Scalar subquery: ``m`` about 10% above the number of users (max id + 1)."""
    return events.agg((((F.max("user_id") + 1) * 11 + 9) / 10).cast("long")).scalar()


def _type_column(event_type: Column, k: Column) -> Column:
    r = k % 5
    out = None
    for k5, by_type in TYPE_BY_K5.items():
        for et, t in by_type.items():
            if t is None:
                continue
            cond = (r == k5) & (event_type == et)
            out = F.when(cond, F.lit(t)) if out is None else out.when(cond, F.lit(t))
    req = None
    for bound, t in REQUEST_BY_K:
        cond = (r == 4) & (event_type == "view") & (k < bound if bound is not None else F.lit(True))
        req = F.when(cond, F.lit(t)) if req is None else req.when(cond, F.lit(t))
    return F.coalesce(out, req)


def _payload(events: DataFrame, with_modulus: bool, raw: DataFrame | None = None) -> DataFrame:
    """Common columns of every fixture: key, k, date and the payload fields.
    Scalars are aggregated over ``raw`` (the plain scan: a partial aggregate
    needs no rebalancing)."""
    e = _with_k(events, "event_id", "ts", "user_id", "event_type")
    m = _settings_id_modulus(raw if raw is not None else events) if with_modulus else F.lit(None).cast("long")
    e = e.withColumn("_m", m)
    date = ntz_to_timestamp("ts")
    k = F.col("k")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("aggregate_id"),
        F.col("user_id").alias("_uid"),
        "event_type", "k", "_m",
        date.alias("date"),
        (F.lit(1) + k % 3).cast("int").alias("version"),
        (k % 2).cast("string").alias("session_id"),
        F.when(k % 9 == 0, "u1").otherwise("u0").alias("user_id"),
        F.array((k % 10).cast("string"), (F.lit(10) + k % 7).cast("string")).alias("_sel"),
        F.when(k % 8 == 0, "s1").otherwise("s0").alias("_service"),
        (k % 4 == 0).alias("_shared"),
        F.when(k % 3 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("_name"),
    )


def _structs(p: DataFrame) -> list[Column]:
    aid, date = F.col("aggregate_id"), F.col("date")
    no_ts = F.lit(None).cast("timestamp")
    settings = F.struct(aid.alias("id"), F.col("_name").alias("name"), F.col("_service").alias("service"),
                        F.col("user_id").alias("user_id"), F.col("_shared").alias("shared"),
                        F.col("_sel").alias("selection"), date.alias("inserted"), date.alias("updated"),
                        no_ts.alias("accessed"))
    selection = F.struct(aid.alias("id"), F.col("_service").alias("service"), F.col("user_id").alias("user_id"),
                         F.col("_sel").alias("selection"), date.alias("inserted"), date.alias("updated"))
    settings_id = ((F.col("_uid") * 7 + F.col("k")) % F.col("_m")).cast("string")
    persistence = F.struct(aid.alias("id"), settings_id.alias("settings_id"), F.col("_name").alias("name"),
                           F.col("_service").alias("service"), F.col("user_id").alias("user_id"),
                           F.col("_shared").alias("shared"), date.alias("inserted"), date.alias("updated"),
                           no_ts.alias("accessed"))
    return [settings.alias("settings"), selection.alias("selection_req"), persistence.alias("persistence")]


def _finish(p: DataFrame, type_col: Column, fail_type: Column) -> DataFrame:
    k = F.col("k")
    t = type_col
    return p.select(
        "seq", "event_id", "aggregate_id", t.alias("type"), "version", "user_id", "session_id", "date",
        *_structs(p),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (k % 3).cast("string")))
         .alias("exception_type"),
        F.lit(None).cast("map<string,string>").alias("arguments"),
        fail_type.alias("fail_event_type"),
        F.lit(None).cast(SETTINGS).alias("last_snapshot_item"),
    ).where(F.col("type").isNotNull())


def lifecycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings event log (``EVENT_LOG`` schema) over the driver's events."""
    events = read_table(spark, sf_dir, "events")
    p = _payload(events, with_modulus=True, raw=events)
    t = _type_column(F.col("event_type"), F.col("k"))
    fail = F.when(t == "PREPARE_ROLLBACK", F.when(F.col("k") % 2 == 0, "SAVE").otherwise("PARTIAL_SELECT"))
    return _finish(p, t, fail)


def generic_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create/update log for the generic lifecycle (``GENERIC_BY_PARITY``): even
    ``k`` drives create/delete, odd ``k`` update; purchase rows are SAVED
    snapshots, signup rows PREPARE_ROLLBACK. Update requests with ``k % 4 == 3``
    carry no selection (a partial edit)."""
    events = read_table(spark, sf_dir, "events")
    p = _payload(events, with_modulus=False)
    k, et = F.col("k"), F.col("event_type")
    partial = (et == "view") & (k % 4 == 3)
    p = p.withColumn("_sel", F.when(partial, F.lit(None).cast("array<string>")).otherwise(F.col("_sel")))
    t = None
    for (src, parity), dst in GENERIC_BY_PARITY.items():
        cond = (et == src) & ((k % 2 == parity) if parity is not None else F.lit(True))
        t = F.when(cond, F.lit(dst)) if t is None else t.when(cond, F.lit(dst))
    fail = F.when(t == "PREPARE_ROLLBACK", "UPDATE")
    return _finish(p, t, fail)


def decision_log(spark: SparkSession, sf_dir: str, interleaved: bool = False) -> tuple[DataFrame, DataFrame]:
    """Profile D: ``(state_log, commands)``. The state log holds the first two
    thirds of ``seq`` with types from ``PROFILE_D_TYPES``; the commands are the
    last third, targeting ``(user_id * 7 + k) % m`` so some targets have no state.
    ``interleaved``: every row gives both a state event and a command of equal ``seq``."""
    events = read_table(spark, sf_dir, "events")
    p = _payload(events, with_modulus=True, raw=events)
    bounds = events.agg(F.struct(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))).scalar()
    cut = bounds["lo"] + (bounds["hi"] - bounds["lo"] + 1) * 2 / 3
    k = F.col("k")
    state_type = F.element_at(F.array(*[F.lit(x) for x in PROFILE_D_TYPES]), (k % 10 + 1).cast("int"))
    is_state = F.lit(True) if interleaved else F.col("seq") < cut
    state = _finish(p.where(is_state), state_type, F.lit(None).cast("string"))

    target = ((F.col("_uid") * 7 + k) % F.col("_m")).cast("string")
    command = F.element_at(F.array(*[F.lit(x) for x in PROFILE_D_COMMANDS]), (k % 8 + 1).cast("int"))
    new_id = F.when(k % 4 == 0, F.col("aggregate_id")).otherwise(F.concat(F.lit("new"), F.col("seq").cast("string")))
    cp = p if interleaved else p.where(F.col("seq") >= cut)
    structs = _structs(cp)
    cmds = cp.select(
        F.col("seq").alias("cmd_seq"),
        command.alias("command"),
        F.when(command == "clone", new_id).otherwise(target).alias("target_id"),
        F.when(command == "clone", target).alias("source_id"),
        "user_id", "session_id",
        F.col("date").alias("as_of"),
        structs[1].withField("id", F.when(command == "clone", new_id).otherwise(target)).alias("selection_req"),
        structs[2].withField("id", F.when(command == "clone", new_id).otherwise(target))
                  .withField("settings_id", F.when(command == "clone", target)).alias("persistence"),
    )
    return state, cmds.select(*[f.name for f in COMMANDS.fields])


def command_path_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(external events, commands)`` on one axis: the commands of profile D at even places, and at odd ones the
    confirmations, failures and snapshots of the lifecycle log (what services besides the command handler send)."""
    _, commands = decision_log(spark, sf_dir, interleaved=True)
    sent = ("SELECT_CONFIRMED", "DESELECT_CONFIRMED", "CLEAR_SELECTION_CONFIRMED", "SAVE_CONFIRMED", "DELETE_CONFIRMED",
            "SELECT_FAILED", "DESELECT_FAILED", "CLEAR_SELECTION_FAILED", "SAVE_FAILED", "DELETE_FAILED", "SAVED")
    external = lifecycle_log(spark, sf_dir).where(F.col("type").isin(*sent))
    return external.withColumn("seq", F.col("seq") * 2 + 1), commands.withColumn("cmd_seq", F.col("cmd_seq") * 2)


def history_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as a state event with types from ``PROFILE_D_TYPES``; items of
    even users see SAVED and SELECTED in place of the locking SAVE and SELECT."""
    events = read_table(spark, sf_dir, "events")
    p = _payload(events, with_modulus=True, raw=events)
    t = F.element_at(F.array(*[F.lit(x) for x in PROFILE_D_TYPES]), (F.col("k") % 10 + 1).cast("int"))
    free = F.col("_uid") % 2 == 0
    t = F.when(free & (t == "SAVE"), F.lit("SAVED")).when(free & (t == "SELECT"), F.lit("SELECTED")).otherwise(t)
    return _finish(p, t, F.lit(None).cast("string"))


def outcome_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile O: one row per driver event, ``kind`` = COMMAND, a terminal type
    or NO_TERMINAL; ``session_id = user_id || ':' || (k % 3)``."""
    events = _with_k(read_table(spark, sf_dir, "events"), "event_id", "ts", "user_id", "event_type")
    k = F.col("k")
    kind = None
    for src, dst in PROFILE_O_TYPES.items():
        kind = F.when(F.col("event_type") == src, dst) if kind is None else kind.when(F.col("event_type") == src, dst)
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.col("user_id").cast("string"), F.lit(":"), (k % 3).cast("string")).alias("session_id"),
        F.col("user_id").cast("string").alias("aggregate_id"),
        kind.alias("type"),
        ntz_to_timestamp("ts").alias("date"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (k % 3).cast("string"))).alias("exception_type"),
        F.col("event_id").cast("string").alias("event_id"), (F.lit(1) + k % 3).cast("int").alias("version"),
        F.when(k % 9 == 0, "u1").otherwise("u0").alias("user_id"),
    )


def tombstone_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """The settings log, and which of its rows are delete markers: rows of errors with an odd place."""
    return lifecycle_log(spark, sf_dir), F.col("exception_type").isNotNull() & (F.col("seq") % 2 == 1)


def reference_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(references, delete requests)``: a user points at item ``k`` with views, clicks and purchases and at nothing
    after an error; a signup asks to delete item ``k``."""
    e = _with_k(read_table(spark, sf_dir, "events"), "event_id", "user_id", "event_type")
    refs = e.where("event_type <> 'signup'").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("referrer"),
                                                    F.when(F.col("event_type") != "error", F.col("k")).alias("item"))
    return refs, e.where("event_type = 'signup'").select(F.col("event_id").alias("seq"), F.col("k").alias("item"))


def changing_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(events, versions)``: purchases set a user's level ``k % 3`` and group ``k % 7``; views and clicks point at the
    user ``user_id + k % 2``."""
    e = _with_k(read_table(spark, sf_dir, "events"), "event_id", "user_id", "event_type")
    events = e.where("event_type in ('view', 'click')").select(F.col("event_id").alias("seq"), "event_type", (F.col("user_id") + F.col("k") % 2).alias("related_id"))
    return events, e.where("event_type = 'purchase'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("item_id"),
                                                             (F.col("k") % 3).alias("level"), (F.col("k") % 7).alias("team"))


#: fixed values: types that the handler's rows take at even places (what other services send back)
HANDLED = {"PREPARE_ROLLBACK": "ROLLBACK_FAILED", "DELETE_CONFIRMED": "DELETED", "SELECT_FAILED": "SELECT_CANCELLED",
           "DESELECT_FAILED": "DESELECT_CANCELLED", "CLEAR_SELECTION_FAILED": "CLEAR_SELECTION_CANCELLED",
           "SAVE_FAILED": "SAVE_CANCELLED", "DELETE_FAILED": "DELETE_CANCELLED"}


def handler_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings log with rows of every type that the handler acts on (``HANDLED``)."""
    t = F.col("type")
    for old, new in HANDLED.items():
        t = F.when((F.col("seq") % 2 == 0) & (F.col("type") == old), F.lit(new)).otherwise(t)
    return lifecycle_log(spark, sf_dir).withColumn("type", t)


def damaged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, props)`` of the driver's events, some of them damaged: cut JSON at every thirteenth place, none at
    every seventeenth."""
    props = (F.when(F.col("event_id") % 17 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, F.expr("left(props, length(props) - 1)"))
             .otherwise(F.col("props")))
    return read_table(spark, sf_dir, "events").select("event_id", props.alias("props"))
