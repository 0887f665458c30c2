"""Declared schemas and the event-type vocabulary.

One wide nullable struct carries every record type of the log; absent fields
are null and dispatch is on the string ``type`` column. Nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TS = T.TimestampType()
_STR = T.StringType()
_SEL = T.ArrayType(T.StringType())

SETTINGS = T.StructType([
    T.StructField("id", _STR),
    T.StructField("name", _STR),
    T.StructField("service", _STR),
    T.StructField("user_id", _STR),
    T.StructField("shared", T.BooleanType()),
    T.StructField("selection", _SEL),
    T.StructField("inserted", _TS),
    T.StructField("updated", _TS),
    T.StructField("accessed", _TS),
])

SELECTION_REQ = T.StructType([
    T.StructField("id", _STR),
    T.StructField("service", _STR),
    T.StructField("user_id", _STR),
    T.StructField("selection", _SEL),
    T.StructField("inserted", _TS),
    T.StructField("updated", _TS),
])

PERSISTENCE = T.StructType([
    T.StructField("id", _STR),
    T.StructField("settings_id", _STR),
    T.StructField("name", _STR),
    T.StructField("service", _STR),
    T.StructField("user_id", _STR),
    T.StructField("shared", T.BooleanType()),
    T.StructField("inserted", _TS),
    T.StructField("updated", _TS),
    T.StructField("accessed", _TS),
])

EVENT_LOG = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("event_id", _STR),
    T.StructField("aggregate_id", _STR),
    T.StructField("type", _STR),
    T.StructField("version", T.IntegerType()),
    T.StructField("user_id", _STR),
    T.StructField("session_id", _STR),
    T.StructField("date", _TS),
    T.StructField("settings", SETTINGS),
    T.StructField("selection_req", SELECTION_REQ),
    T.StructField("persistence", PERSISTENCE),
    T.StructField("exception_type", _STR),
    T.StructField("arguments", T.MapType(_STR, _STR)),
    T.StructField("fail_event_type", _STR),
    T.StructField("last_snapshot_item", SETTINGS),
])

EVENT_COLUMNS = [f.name for f in EVENT_LOG.fields]

def log_order(df, order: str = "seq"):
    """The one order of a log: ``seq``, and after it ``hop`` where the log has
    derived rows (they share their cause's ``seq``)."""
    from pyspark.sql import functions as F

    return F.struct(F.col(order), F.coalesce(F.col("hop"), F.lit(0)).alias("hop")) if "hop" in df.columns else F.col(order)


def hop_tiebreak(df) -> tuple[str, ...]:
    return ("hop",) if "hop" in df.columns else ()


DERIVED = T.StructType([T.StructField("hop", T.IntegerType())] + EVENT_LOG.fields)

COMMANDS = T.StructType([
    T.StructField("cmd_seq", T.LongType()),
    T.StructField("command", _STR),
    T.StructField("target_id", _STR),
    T.StructField("source_id", _STR),
    T.StructField("user_id", _STR),
    T.StructField("session_id", _STR),
    T.StructField("as_of", _TS),
    T.StructField("selection_req", SELECTION_REQ),
    T.StructField("persistence", PERSISTENCE),
])


# --- fixed values: the event-type vocabulary, error codes and command names ---
# These names must equal the reference's for results to match.
class Types:
    PARTIAL_SELECT = "PARTIAL_SELECT"
    SELECT = "SELECT"
    SELECT_CONFIRMED = "SELECT_CONFIRMED"
    SELECTED = "SELECTED"
    SELECT_FAILED = "SELECT_FAILED"
    SELECT_CANCELLED = "SELECT_CANCELLED"

    PARTIAL_DESELECT = "PARTIAL_DESELECT"
    DESELECT = "DESELECT"
    DESELECT_CONFIRMED = "DESELECT_CONFIRMED"
    DESELECTED = "DESELECTED"
    DESELECT_FAILED = "DESELECT_FAILED"
    DESELECT_CANCELLED = "DESELECT_CANCELLED"

    PARTIAL_CLEAR_SELECTION = "PARTIAL_CLEAR_SELECTION"
    CLEAR_SELECTION = "CLEAR_SELECTION"
    CLEAR_SELECTION_CONFIRMED = "CLEAR_SELECTION_CONFIRMED"
    SELECTION_CLEARED = "SELECTION_CLEARED"
    CLEAR_SELECTION_FAILED = "CLEAR_SELECTION_FAILED"
    CLEAR_SELECTION_CANCELLED = "CLEAR_SELECTION_CANCELLED"

    PARTIAL_SAVE = "PARTIAL_SAVE"
    CLONE = "CLONE"
    UPDATE_ACCESSED_DATE = "UPDATE_ACCESSED_DATE"
    SAVE = "SAVE"
    SAVE_CONFIRMED = "SAVE_CONFIRMED"
    SAVED = "SAVED"
    SAVE_FAILED = "SAVE_FAILED"
    SAVE_CANCELLED = "SAVE_CANCELLED"

    CHECK_DELETE = "CHECK_DELETE"
    DELETE_CHECKED = "DELETE_CHECKED"
    CHECK_DELETE_FAILED = "CHECK_DELETE_FAILED"
    DELETE = "DELETE"
    DELETE_CONFIRMED = "DELETE_CONFIRMED"
    DELETED = "DELETED"
    DELETE_FAILED = "DELETE_FAILED"
    DELETE_CANCELLED = "DELETE_CANCELLED"

    PREPARE_ROLLBACK = "PREPARE_ROLLBACK"
    ROLLBACK = "ROLLBACK"
    ROLLBACK_FAILED = "ROLLBACK_FAILED"

    CREATE = "CREATE"
    CREATE_CONFIRMED = "CREATE_CONFIRMED"
    CREATED = "CREATED"
    UPDATE = "UPDATE"
    UPDATE_CONFIRMED = "UPDATE_CONFIRMED"
    UPDATED = "UPDATED"
    UPDATE_FAILED = "UPDATE_FAILED"
    UPDATE_CANCELLED = "UPDATE_CANCELLED"


# SettingsChangeForbidden, ItemNotFound and ROLLBACK_FAILED are assumed names: the reference's tree does not hold them.
class Errors:
    SELECTION_CHANGE_NOT_ALLOWED = "SELECTION_CHANGE_NOT_ALLOWED"
    SETTINGS_TO_SAVE_NOT_FOUND = "SETTINGS_TO_SAVE_NOT_FOUND_EXCEPTION"
    SETTINGS_TO_CLONE_NOT_FOUND = "SETTINGS_TO_CLONE_NOT_FOUND_EXCEPTION"
    DELETE_SETTINGS_NOT_ALLOWED = "DELETE_SETTINGS_NOT_ALLOWED"
    HISTORY_NOT_FOUND = "HistoryNotFound"
    CONFIRMATION_TIMEOUT = "ConfirmationTimeout"
    ITEM_LOCKED = "ItemLocked"
    ITEM_REFERENCED = "ItemReferenced"
    ITEM_NOT_FOUND = "ItemNotFound"
    CHANGE_FORBIDDEN = "SettingsChangeForbidden"


# The argument text that a HistoryNotFound rejection carries.
HISTORY_NOT_FOUND_ARG = "UPDATE | DELETE"

# Snapshot ("final") types forwarded to the snapshot table.
SNAPSHOT_TYPES = (Types.SAVED, Types.SELECTED, Types.DESELECTED, Types.SELECTION_CLEARED)

# Types each aggregate family's fold accepts; anything else locks the item.
PERSISTENCE_ACCEPTS = (Types.SAVED, Types.DELETED, Types.SAVE_CANCELLED, Types.DELETE_CANCELLED)
SELECTION_ACCEPTS = (Types.SAVED, Types.SELECTED, Types.DESELECTED, Types.SELECTION_CLEARED,
                     Types.SAVE_CANCELLED, Types.DELETE_CANCELLED, Types.SELECT_CANCELLED,
                     Types.DESELECT_CANCELLED, Types.CLEAR_SELECTION_CANCELLED)
# Types whose payload replaces the folded settings (DELETED keeps the old ones).
PERSISTENCE_SETS_SETTINGS = (Types.SAVED, Types.SAVE_CANCELLED, Types.DELETE_CANCELLED)
SELECTION_SETS_SETTINGS = SELECTION_ACCEPTS

# Terminal events that settle a pending command, by outcome.
SUCCESS_TYPES = (Types.SELECTED, Types.DESELECTED, Types.SELECTION_CLEARED, Types.SAVED, Types.DELETED)
CANCELLED_TYPES = (Types.SELECT_CANCELLED, Types.DESELECT_CANCELLED, Types.CLEAR_SELECTION_CANCELLED,
                   Types.SAVE_CANCELLED, Types.DELETE_CANCELLED)
