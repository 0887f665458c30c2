"""Derived events of the settings lifecycle (OP-25..32, 36, 37, 46a).

Every rule is a stream-table join in the original: a trigger row of one type
meets the latest snapshot, or the latest request of one type, of its key, and
a payload transform decides the derived event (or none). Here all rules share
**one** as-of pass (one exchange of the log): triggers are keyed by the item
whose tables they read - their own id, or for save and clone the *source*
item's id - and the derived event is chosen by a ``when`` chain on the
trigger's type - no per-rule scan of the log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions.predicates import change_granted, deletable, same_session
from eventfold.functions.selection import sel_clear, sel_remove, sel_union
from eventfold.functions.settings import (
    map_new_selection, set_fields_accessed, set_fields_clone, set_fields_save,
)
from eventfold.operators.asof import attach_last_before
from eventfold.schema import EVENT_COLUMNS, SETTINGS, SNAPSHOT_TYPES, Errors, Types, hop_tiebreak

# Output fields a rule may set; anything not set keeps the trigger's value
# (identity fields) or is null (payload fields).
_KEPT = ("aggregate_id", "version", "user_id", "session_id", "date")
_PAYLOAD = ("settings", "exception_type", "arguments", "fail_event_type", "last_snapshot_item")

SNAP = "_snap"
REQUEST_TABLES = {
    Types.SELECT_CONFIRMED: ("_req_select", Types.SELECT),
    Types.DESELECT_CONFIRMED: ("_req_deselect", Types.DESELECT),
    Types.CLEAR_SELECTION_CONFIRMED: ("_req_clear", Types.CLEAR_SELECTION),
    Types.SAVE_CONFIRMED: ("_req_save", Types.SAVE),
}


@dataclass(frozen=True)
class Rule:
    """One derivation: ``trigger`` type, looked-up ``table`` column(s) and the
    function ``(*tables, as_of) -> {field: Column}``; a null ``type`` drops the
    row. ``table`` names a snapshot (``_snap``) or request table, or a tuple of
    them for a rule that reads several."""
    name: str
    trigger: str
    table: str | tuple[str, ...]
    build: Callable[..., dict[str, Column]]
    source_keyed: bool = False

    @property
    def tables(self) -> tuple[str, ...]:
        return self.table if isinstance(self.table, tuple) else (self.table,)


def _lit(s: str) -> Column:
    return F.lit(s)


def _col(name: str) -> Column:
    return F.col(name)


# -- rule bodies -------------------------------------------------------------

def _select_request(snap: Column, as_of: Column) -> dict[str, Column]:
    req, s = _col("selection_req"), snap["settings"]
    granted = change_granted(s, req)
    return {
        "type": F.when(snap.isNull() | granted, _lit(Types.SELECT)).otherwise(_lit(Types.SELECT_FAILED)),
        "settings": F.when(snap.isNull(), map_new_selection(req))
                     .when(granted, s.withField("selection", sel_union(req["selection"], s["selection"]))),
        "exception_type": F.when(snap.isNotNull() & ~granted, _lit(Errors.SELECTION_CHANGE_NOT_ALLOWED)),
    }


def _change_request(ok_type: str, failed_type: str, new_selection: Callable[[Column, Column], Column]):
    def build(snap: Column, as_of: Column) -> dict[str, Column]:
        req, s = _col("selection_req"), snap["settings"]
        granted = change_granted(s, req)
        return {
            "type": F.when(snap.isNotNull(), F.when(granted, _lit(ok_type)).otherwise(_lit(failed_type))),
            "settings": F.when(granted, s.withField("selection", new_selection(s["selection"], req["selection"]))),
            "exception_type": F.when(snap.isNotNull() & ~granted, _lit(Errors.SELECTION_CHANGE_NOT_ALLOWED)),
        }
    return build


def _confirm(out_type: str):
    def build(req: Column, as_of: Column) -> dict[str, Column]:
        ok = req.isNotNull() & same_session(_col("session_id"), req["session_id"])
        return {"type": F.when(ok, _lit(out_type)), "settings": F.when(ok, req["settings"])}
    return build


def _cancel(out_type: str, inner: bool):
    def build(snap: Column, as_of: Column) -> dict[str, Column]:
        return {
            "type": F.when(snap.isNotNull(), _lit(out_type)) if inner else _lit(out_type),
            "settings": snap["settings"],
            "exception_type": _col("exception_type"),
            "arguments": _col("arguments"),
        }
    return build


def _from_source(error: str, transform: Callable[[Column, Column], Column]):
    def build(src: Column, as_of: Column) -> dict[str, Column]:
        found = src.isNotNull()
        return {
            "type": F.when(found, _lit(Types.SAVE)).otherwise(_lit(Types.SAVE_FAILED)),
            "settings": F.when(found, transform(src["settings"], as_of)),
            "exception_type": F.when(~found, _lit(error)),
        }
    return build


def _accessed_request(snap: Column, as_of: Column) -> dict[str, Column]:
    found = snap.isNotNull()
    return {
        "type": F.when(found, _lit(Types.SAVE)).otherwise(_lit(Types.SAVE_FAILED)),
        "settings": F.when(found, set_fields_accessed(snap["settings"], as_of)),
        "exception_type": F.when(~found, _lit(Errors.SETTINGS_TO_SAVE_NOT_FOUND)),
        "user_id": F.when(found, snap["user_id"]).otherwise(_col("user_id")),
    }


def _delete_check(snap: Column, as_of: Column) -> dict[str, Column]:
    ok = deletable(snap["settings"], _col("user_id"))
    return {
        "type": F.when(snap.isNotNull(), F.when(ok, _lit(Types.DELETE_CHECKED))
                       .otherwise(_lit(Types.CHECK_DELETE_FAILED))),
        "exception_type": F.when(snap.isNotNull() & ~ok, _lit(Errors.DELETE_SETTINGS_NOT_ALLOWED)),
    }


def _rollback(snap: Column, as_of: Column) -> dict[str, Column]:
    return {
        "type": _lit(Types.ROLLBACK),
        "last_snapshot_item": snap["settings"],
        "fail_event_type": _col("fail_event_type"),
    }


RULES: list[Rule] = [
    Rule("select_request", Types.PARTIAL_SELECT, SNAP, _select_request),
    Rule("deselect_request", Types.PARTIAL_DESELECT, SNAP,
         _change_request(Types.DESELECT, Types.DESELECT_FAILED, sel_remove)),
    Rule("clear_request", Types.PARTIAL_CLEAR_SELECTION, SNAP,
         _change_request(Types.CLEAR_SELECTION, Types.CLEAR_SELECTION_FAILED, lambda old, new: sel_clear())),
    Rule("save_request", Types.PARTIAL_SAVE, SNAP,
         _from_source(Errors.SETTINGS_TO_SAVE_NOT_FOUND,
                      lambda s, as_of: set_fields_save(s, _col("persistence"))), source_keyed=True),
    Rule("clone_request", Types.CLONE, SNAP,
         _from_source(Errors.SETTINGS_TO_CLONE_NOT_FOUND,
                      lambda s, as_of: set_fields_clone(s, _col("persistence"), _col("user_id"), as_of)),
         source_keyed=True),
    Rule("accessed_request", Types.UPDATE_ACCESSED_DATE, SNAP, _accessed_request),
    Rule("select_confirm", Types.SELECT_CONFIRMED, "_req_select", _confirm(Types.SELECTED)),
    Rule("deselect_confirm", Types.DESELECT_CONFIRMED, "_req_deselect", _confirm(Types.DESELECTED)),
    Rule("clear_confirm", Types.CLEAR_SELECTION_CONFIRMED, "_req_clear", _confirm(Types.SELECTION_CLEARED)),
    Rule("save_confirm", Types.SAVE_CONFIRMED, "_req_save", _confirm(Types.SAVED)),
    Rule("select_cancel", Types.SELECT_FAILED, SNAP, _cancel(Types.SELECT_CANCELLED, inner=False)),
    Rule("deselect_cancel", Types.DESELECT_FAILED, SNAP, _cancel(Types.DESELECT_CANCELLED, inner=True)),
    Rule("clear_cancel", Types.CLEAR_SELECTION_FAILED, SNAP, _cancel(Types.CLEAR_SELECTION_CANCELLED, inner=True)),
    Rule("save_cancel", Types.SAVE_FAILED, SNAP, _cancel(Types.SAVE_CANCELLED, inner=False)),
    Rule("delete_cancel", Types.DELETE_FAILED, SNAP, _cancel(Types.DELETE_CANCELLED, inner=True)),
    Rule("delete_check", Types.CHECK_DELETE, SNAP, _delete_check),
    Rule("rollback", Types.PREPARE_ROLLBACK, SNAP, _rollback),
]
RULES_BY_NAME = {r.name: r for r in RULES}


SETTINGS_REQUESTS = {name: req for name, req in REQUEST_TABLES.values()}
#: What the built-in rules read of a request; few columns keep the as-of scan narrow.
REQUEST_FIELDS = ("session_id", "settings")


def _table_specs(snapshot_types: Sequence[str], needed: Iterable[str],
                 requests: dict[str, str] | None = None,
                 request_fields: Sequence[str] = REQUEST_FIELDS) -> dict[str, tuple[Column, Column]]:
    t = _col("type")
    specs = {SNAP: (t.isin(list(snapshot_types)), F.struct("seq", "user_id", "settings"))}
    for name, req_type in (requests or SETTINGS_REQUESTS).items():
        specs[name] = (t == req_type, F.struct(*request_fields))
    return {k: v for k, v in specs.items() if k in set(needed)}


def _table_types(snapshot_types: Sequence[str], needed: Iterable[str],
                 requests: dict[str, str] | None = None) -> list[str]:
    needed = set(needed)
    out = list(snapshot_types) if SNAP in needed else []
    out += [req for name, req in (requests or SETTINGS_REQUESTS).items() if name in needed]
    return out


def _assemble(rows: DataFrame, rules: Sequence[Rule], as_of: Column | None) -> DataFrame:
    """Apply the rules' ``when`` chain to trigger rows carrying their table columns."""
    t = _col("type")
    at = as_of if as_of is not None else _col("date")
    built = [(r.trigger, r.build(*[_col(n) for n in r.tables], at)) for r in rules]

    def chain(field: str, default: Column) -> Column:
        expr = None
        for trig, out in built:
            if field not in out:
                continue
            expr = F.when(t == trig, out[field]) if expr is None else expr.when(t == trig, out[field])
        return default if expr is None else expr.otherwise(default)

    defaults = {f: _col(f) for f in _KEPT}
    defaults.update({
        "settings": F.lit(None).cast(SETTINGS),
        "exception_type": F.lit(None).cast("string"),
        "arguments": F.lit(None).cast("map<string,string>"),
        "fail_event_type": F.lit(None).cast("string"),
        "last_snapshot_item": F.lit(None).cast(SETTINGS),
    })
    out_type = chain("type", F.lit(None).cast("string"))
    hop = (_col("hop") + 1).cast("int") if "hop" in rows.columns else F.lit(1)
    cols = {
        "hop": hop,
        "seq": _col("seq"),
        "event_id": F.concat(_col("event_id"), F.lit("#"), hop.cast("string")),
        "type": out_type,
        "selection_req": F.lit(None).cast(rows.schema["selection_req"].dataType),
        "persistence": F.lit(None).cast(rows.schema["persistence"].dataType),
    }
    for f in (*_KEPT, *_PAYLOAD):
        cols[f] = chain(f, defaults[f])
    # temp names first: an output alias equal to an input column name (e.g.
    # ``selection_req``) would otherwise be picked up inside lambda functions
    return (rows.select(*[c.alias(f"_o_{n}") for n, c in cols.items()])
            .where(_col("_o_type").isNotNull())
            .select(*[_col(f"_o_{n}").alias(n) for n in ("hop", *EVENT_COLUMNS)]))


def derive(log: DataFrame, ops: Iterable[str | Rule] | None = None,
           snapshot_types: Sequence[str] = SNAPSHOT_TYPES, as_of: Column | None = None, chunk: int | None = None,
           requests: dict[str, str] | None = None, attach: Callable | None = None,
           request_fields: Sequence[str] = REQUEST_FIELDS) -> DataFrame:
    """Derived events (``hop`` + event-log columns) of the chosen rules over a
    log that already holds its earlier derived events (OP-46a when ``ops`` is
    None). ``ops`` holds rule names or :class:`Rule` objects; ``requests`` maps
    request-table names to their request type (default: the settings ones), ``request_fields`` are the
    columns of the request that a rule is given.
    ``as_of`` stamps clone and access dates; default: the trigger's date.
    ``attach`` replaces the batch as-of scan (the streaming form passes its
    keyed-state version); the rules are the same Column expressions.
    """
    if attach is None:
        def attach(df, key, order, tables, tiebreak=(), want=None):
            return attach_last_before(df, key, order, tables, tiebreak=tiebreak, chunk=chunk, want=want)
    rules = ([RULES_BY_NAME[o] if isinstance(o, str) else o for o in ops] if ops is not None else list(RULES))
    return _keyed_pass(log, rules, snapshot_types, as_of, attach, requests, request_fields)


KEY = "_k"


def _keyed_pass(log: DataFrame, rules: Sequence[Rule], snapshot_types: Sequence[str],
                as_of: Column | None, attach: Callable, requests: dict[str, str] | None = None,
                request_fields: Sequence[str] = REQUEST_FIELDS) -> DataFrame:
    """One as-of pass for every rule. Rows are keyed by the item they look up:
    table rows and own-key triggers by their own ``aggregate_id``; save/clone
    triggers by ``persistence.settings_id`` (the item whose snapshot they read,
    a null source never matches and is dropped). The two trigger sets have
    distinct types, so one exchange of the log and one ``when`` chain serve all
    rules."""
    own = [r for r in rules if not r.source_keyed]
    src = [r for r in rules if r.source_keyed]
    needed = {n for r in rules for n in r.tables}
    own_triggers = [r.trigger for r in own]
    src_triggers = [r.trigger for r in src]
    t = _col("type")
    table_types = _table_types(snapshot_types, needed, requests)
    key = _col("aggregate_id")
    if src:
        key = F.when(t.isin(src_triggers), _col("persistence.settings_id")).otherwise(key)
    keyed = log.where(t.isin(own_triggers + src_triggers + table_types)).withColumn(KEY, key).where(_col(KEY).isNotNull())
    triggers = own_triggers + src_triggers
    tiebreak = ("hop",) if "hop" in log.columns else ()
    x = attach(keyed, KEY, "seq", _table_specs(snapshot_types, needed, requests, request_fields), tiebreak=tiebreak,
               want=t.isin(triggers))
    return _assemble(x.where(t.isin(triggers)), rules, as_of)


def derive_once(log: DataFrame, snapshot_types: Sequence[str] = SNAPSHOT_TYPES, as_of: Column | None = None,
                chunk: int | None = None) -> DataFrame:
    """OP-46a: all seventeen rules over a complete log; one derived event at most per row."""
    return derive(log, None, snapshot_types, as_of, chunk)


def session_mismatch_report(log: DataFrame, chunk: int | None = None) -> DataFrame:
    """OP-45: confirmations whose latest request came from another session,
    as alert rows (``aggregate_id, kind, type, session_id, date``)."""
    triggers = list(REQUEST_TABLES)
    needed = [name for name, _ in REQUEST_TABLES.values()]
    x = log.where(_col("type").isin(triggers + [req for _, req in REQUEST_TABLES.values()])
                  & _col("aggregate_id").isNotNull())
    x = attach_last_before(x, "aggregate_id", "seq", _table_specs((), needed), tiebreak=hop_tiebreak(log), chunk=chunk,
                           want=_col("type").isin(triggers))
    req = None
    for trig, (name, _) in REQUEST_TABLES.items():
        req = F.when(_col("type") == trig, _col(name)) if req is None else req.when(_col("type") == trig, _col(name))
    x = x.where(_col("type").isin(triggers)).withColumn("_req", req)
    return (x.where(_col("_req").isNotNull() & ~same_session(_col("session_id"), _col("_req.session_id")))
            .select("seq", "aggregate_id", F.lit("SESSION_MISMATCH").alias("kind"), "type", "session_id",
                    _col("_req.session_id").alias("request_session_id"), "date"))
