"""Independent DuckDB formulations of the registered queries.

They use plain window functions (``last_value ... IGNORE NULLS``) and self
joins on ``seq`` - a different route from the Spark operators - over the same
fixture projections, written here again in SQL.
"""

from __future__ import annotations

from eventfold.schema import SNAPSHOT_TYPES, Errors, Types
from eventfold.sources.fixtures import (
    GENERIC_BY_PARITY, REQUEST_BY_K, TYPE_BY_K5,
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _type_case() -> str:
    parts = []
    for k5, by_type in TYPE_BY_K5.items():
        for et, t in by_type.items():
            if t is not None:
                parts.append(f"WHEN k % 5 = {k5} AND event_type = {_q(et)} THEN {_q(t)}")
    for bound, t in REQUEST_BY_K:
        cond = f" AND k < {bound}" if bound is not None else ""
        parts.append(f"WHEN k % 5 = 4 AND event_type = 'view'{cond} THEN {_q(t)}")
    return "CASE " + " ".join(parts) + " END"


def _payload_cols() -> str:
    return """
      event_id AS seq, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS aggregate_id,
      user_id AS uid, event_type, k,
      CAST(1 + k % 3 AS INTEGER) AS version, CAST(k % 2 AS VARCHAR) AS session_id,
      CASE WHEN k % 9 = 0 THEN 'u1' ELSE 'u0' END AS user_id, ts AS date,
      [CAST(k % 10 AS VARCHAR), CAST(10 + k % 7 AS VARCHAR)] AS sel,
      CASE WHEN k % 8 = 0 THEN 's1' ELSE 's0' END AS service, (k % 4 = 0) AS shared,
      CASE WHEN k % 3 = 0 THEN 'n' || CAST(k AS VARCHAR) END AS name,
      CASE WHEN event_type = 'error' THEN 'E' || CAST(k % 3 AS VARCHAR) END AS exception_type"""


def fixture_ctes() -> str:
    """``ev`` (events with k), ``m`` (settings-id modulus) and ``log``."""
    return f"""
ev AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
       FROM events),
mm AS (SELECT ((max(user_id) + 1) * 11 + 9) // 10 AS m FROM events),
p AS (SELECT {_payload_cols()}, CAST((user_id * 7 + k) % mm.m AS VARCHAR) AS settings_id FROM ev, mm),
log0 AS (SELECT *, {_type_case()} AS type FROM p),
log AS (SELECT *, CASE WHEN type = 'PREPARE_ROLLBACK' THEN CASE WHEN k % 2 = 0 THEN 'SAVE'
                  ELSE 'PARTIAL_SELECT' END END AS fail_event_type
        FROM log0 WHERE type IS NOT NULL)"""


# --- flattened settings -----------------------------------------------------

_S_FIELDS = ["id", "name", "service", "user_id", "shared", "selection", "inserted", "updated", "accessed"]
_NULLS = {"id": "CAST(NULL AS VARCHAR)", "name": "CAST(NULL AS VARCHAR)", "service": "CAST(NULL AS VARCHAR)",
          "user_id": "CAST(NULL AS VARCHAR)", "shared": "CAST(NULL AS BOOLEAN)",
          "selection": "CAST(NULL AS VARCHAR[])", "inserted": "CAST(NULL AS TIMESTAMP)",
          "updated": "CAST(NULL AS TIMESTAMP)", "accessed": "CAST(NULL AS TIMESTAMP)"}


def row_settings(a: str) -> dict[str, str]:
    """Settings carried by fixture row ``a`` (every row carries them)."""
    return {"id": f"{a}.aggregate_id", "name": f"{a}.name", "service": f"{a}.service", "user_id": f"{a}.user_id",
            "shared": f"{a}.shared", "selection": f"{a}.sel", "inserted": f"{a}.date", "updated": f"{a}.date",
            "accessed": "CAST(NULL AS TIMESTAMP)"}


def _settings_case(branches: list[tuple[str, dict[str, str]]]) -> str:
    out = []
    for f in _S_FIELDS:
        whens = " ".join(f"WHEN {c} THEN {v[f]}" for c, v in branches)
        expr = f"CASE {whens} ELSE {_NULLS[f]} END" if branches else _NULLS[f]
        if f == "selection":
            out.append(f"array_to_string({expr}, ',') AS s_selection")
        elif f in ("inserted", "updated", "accessed"):
            out.append(f"epoch_us({expr}) AS s_{f}_us")
        else:
            out.append(f"{expr} AS s_{f}")
    return ",\n       ".join(out)


def _event_select(type_expr: str, settings: list[tuple[str, dict[str, str]]], exc: str = "CAST(NULL AS VARCHAR)",
                  fail: str = "CAST(NULL AS VARCHAR)", user: str = "o.user_id") -> str:
    return f"""o.seq, CAST(1 AS INTEGER) AS hop, {type_expr} AS type, o.aggregate_id, o.version,
       {user} AS user_id, o.session_id, epoch_us(o.date) AS date_us, {exc} AS exception_type,
       {fail} AS fail_event_type,
       {_settings_case(settings)}"""


def _granted(s: str = "s", o: str = "o") -> str:
    return (f"(coalesce({s}.service = {o}.service, false) AND coalesce({s}.user_id = {o}.user_id, false) "
            f"AND NOT coalesce({s}.shared, true) AND {s}.name IS NULL)")


def _union(new: str, old: str) -> str:
    return f"list_concat({new}, list_filter({old}, lambda x: NOT list_contains({new}, x)))"


def _remove(old: str, rm: str) -> str:
    return f"list_filter({old}, lambda x: NOT coalesce(list_contains({rm}, x), false))"


def _with(base: dict[str, str], **kw) -> dict[str, str]:
    d = dict(base)
    d.update(kw)
    return d


_REQ_SEQ = {"select_confirm": ("r_select", Types.SELECT, Types.SELECT_CONFIRMED, Types.SELECTED),
            "deselect_confirm": ("r_deselect", Types.DESELECT, Types.DESELECT_CONFIRMED, Types.DESELECTED),
            "clear_confirm": ("r_clear", Types.CLEAR_SELECTION, Types.CLEAR_SELECTION_CONFIRMED,
                              Types.SELECTION_CLEARED),
            "save_confirm": ("r_save", Types.SAVE, Types.SAVE_CONFIRMED, Types.SAVED)}
_CANCELS = {"select_cancel": (Types.SELECT_FAILED, Types.SELECT_CANCELLED, False),
            "deselect_cancel": (Types.DESELECT_FAILED, Types.DESELECT_CANCELLED, True),
            "clear_cancel": (Types.CLEAR_SELECTION_FAILED, Types.CLEAR_SELECTION_CANCELLED, True),
            "save_cancel": (Types.SAVE_FAILED, Types.SAVE_CANCELLED, False),
            "delete_cancel": (Types.DELETE_FAILED, Types.DELETE_CANCELLED, True)}


def _rule_sql(name: str) -> str:
    S = row_settings("s")
    O = row_settings("o")
    own = "FROM own o LEFT JOIN log s ON s.seq = o.snap_seq"
    if name == "select_request":
        g = _granted()
        new = _with(O, name="CAST(NULL AS VARCHAR)", shared="false")
        return f"""SELECT {_event_select(
            f"CASE WHEN s.seq IS NULL OR {g} THEN 'SELECT' ELSE 'SELECT_FAILED' END",
            [("s.seq IS NULL", new), (g, _with(S, selection=_union('o.sel', 's.sel')))],
            exc=f"CASE WHEN s.seq IS NOT NULL AND NOT {g} THEN {_q(Errors.SELECTION_CHANGE_NOT_ALLOWED)} END")}
{own} WHERE o.type = 'PARTIAL_SELECT'"""
    if name in ("deselect_request", "clear_request"):
        trig, ok, failed = (("PARTIAL_DESELECT", "DESELECT", "DESELECT_FAILED") if name == "deselect_request"
                            else ("PARTIAL_CLEAR_SELECTION", "CLEAR_SELECTION", "CLEAR_SELECTION_FAILED"))
        g = _granted()
        sel = _remove("s.sel", "o.sel") if name == "deselect_request" else "CAST([] AS VARCHAR[])"
        return f"""SELECT {_event_select(
            f"CASE WHEN {g} THEN {_q(ok)} ELSE {_q(failed)} END",
            [(g, _with(S, selection=sel))],
            exc=f"CASE WHEN NOT {g} THEN {_q(Errors.SELECTION_CHANGE_NOT_ALLOWED)} END")}
{own} WHERE o.type = {_q(trig)} AND s.seq IS NOT NULL"""
    if name in _REQ_SEQ:
        col, _, trig, out = _REQ_SEQ[name]
        return f"""SELECT {_event_select(_q(out), [("true", row_settings("r"))])}
FROM own o JOIN log r ON r.seq = o.{col}_seq
WHERE o.type = {_q(trig)} AND r.session_id = o.session_id"""
    if name in _CANCELS:
        trig, out, inner = _CANCELS[name]
        return f"""SELECT {_event_select(_q(out), [("s.seq IS NOT NULL", S)], exc="o.exception_type")}
{own} WHERE o.type = {_q(trig)}{" AND s.seq IS NOT NULL" if inner else ""}"""
    if name == "accessed_request":
        return f"""SELECT {_event_select(
            "CASE WHEN s.seq IS NULL THEN 'SAVE_FAILED' ELSE 'SAVE' END",
            [("s.seq IS NOT NULL", _with(S, accessed="o.date"))],
            exc=f"CASE WHEN s.seq IS NULL THEN {_q(Errors.SETTINGS_TO_SAVE_NOT_FOUND)} END",
            user="CASE WHEN s.seq IS NULL THEN o.user_id ELSE s.user_id END")}
{own} WHERE o.type = 'UPDATE_ACCESSED_DATE'"""
    if name == "delete_check":
        d = "(NOT coalesce(s.shared, true) AND coalesce(o.user_id = s.user_id, false))"
        return f"""SELECT {_event_select(
            f"CASE WHEN {d} THEN 'DELETE_CHECKED' ELSE 'CHECK_DELETE_FAILED' END", [],
            exc=f"CASE WHEN NOT {d} THEN {_q(Errors.DELETE_SETTINGS_NOT_ALLOWED)} END")}
{own} WHERE o.type = 'CHECK_DELETE' AND s.seq IS NOT NULL"""
    if name == "rollback":
        return f"""SELECT {_event_select("'ROLLBACK'", [("s.seq IS NOT NULL", S)], fail="o.fail_event_type")}
{own} WHERE o.type = 'PREPARE_ROLLBACK'"""
    if name in ("save_request", "clone_request"):
        trig = "PARTIAL_SAVE" if name == "save_request" else "CLONE"
        if name == "save_request":
            st = _with(S, id="o.aggregate_id", name="o.name", shared="o.shared")
            err = Errors.SETTINGS_TO_SAVE_NOT_FOUND
        else:
            st = _with(S, id="o.aggregate_id", name="CAST(NULL AS VARCHAR)", shared="false", user_id="o.user_id",
                       inserted="o.date", updated="o.date")
            err = Errors.SETTINGS_TO_CLONE_NOT_FOUND
        return f"""SELECT {_event_select(
            "CASE WHEN s.seq IS NULL THEN 'SAVE_FAILED' ELSE 'SAVE' END", [("s.seq IS NOT NULL", st)],
            exc=f"CASE WHEN s.seq IS NULL THEN {_q(err)} END")}
FROM srcw w JOIN log o ON o.seq = w.seq LEFT JOIN log s ON s.seq = w.src_seq
WHERE NOT w.is_table AND o.type = {_q(trig)}"""
    raise KeyError(name)


ALL_RULES = ["select_request", "deselect_request", "clear_request", "save_request", "clone_request",
             "accessed_request", "select_confirm", "deselect_confirm", "clear_confirm", "save_confirm",
             "select_cancel", "deselect_cancel", "clear_cancel", "save_cancel", "delete_cancel", "delete_check",
             "rollback"]


def _asof_ctes(snapshot_types=SNAPSHOT_TYPES) -> str:
    snaps = _in(snapshot_types)
    w = "(PARTITION BY aggregate_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    reqs = ",\n  ".join(
        f"last_value(CASE WHEN type = {_q(req)} THEN seq END IGNORE NULLS) OVER {w} AS {col}_seq"
        for col, req, _, _ in _REQ_SEQ.values())
    return f"""
own AS (SELECT l.*, last_value(CASE WHEN type IN {snaps} THEN seq END IGNORE NULLS) OVER {w} AS snap_seq,
  {reqs}
  FROM log l WHERE aggregate_id IS NOT NULL),
keyed AS (SELECT aggregate_id AS k2, seq, true AS is_table FROM log WHERE type IN {snaps} AND aggregate_id IS NOT NULL
          UNION ALL
          SELECT settings_id AS k2, seq, false AS is_table FROM log
          WHERE type IN ('PARTIAL_SAVE', 'CLONE') AND settings_id IS NOT NULL),
srcw AS (SELECT seq, is_table, last_value(CASE WHEN is_table THEN seq END IGNORE NULLS)
         OVER (PARTITION BY k2 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src_seq
         FROM keyed)"""


def derive_sql(rules: list[str] | None = None) -> str:
    rules = rules or ALL_RULES
    body = "\nUNION ALL\n".join(_rule_sql(r) for r in rules)
    return f"WITH {fixture_ctes()},{_asof_ctes()}\n{body}"


# --- generic lifecycle --------------------------------------------------------

def generic_ctes() -> str:
    """``log`` for the generic lifecycle profile."""
    parts = []
    for (src, parity), dst in GENERIC_BY_PARITY.items():
        par = f" AND k % 2 = {parity}" if parity is not None else ""
        parts.append(f"WHEN event_type = {_q(src)}{par} THEN {_q(dst)}")
    case = "CASE " + " ".join(parts) + " END"
    return f"""
ev AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
       FROM events),
p0 AS (SELECT {_payload_cols()}, CAST(NULL AS VARCHAR) AS settings_id FROM ev),
p AS (SELECT * REPLACE (CASE WHEN event_type = 'view' AND k % 4 = 3 THEN CAST(NULL AS VARCHAR[]) ELSE sel END
                        AS sel) FROM p0),
log0 AS (SELECT *, {case} AS type FROM p),
log AS (SELECT *, CASE WHEN type = 'PREPARE_ROLLBACK' THEN 'UPDATE' END AS fail_event_type FROM log0)"""


GENERIC_SNAPSHOTS = ("SAVED", "CREATED", "UPDATED")
_GENERIC_REQ = {"create_confirm": ("r_create", "CREATE", "CREATE_CONFIRMED", "CREATED"),
                "update_confirm": ("r_update", "UPDATE", "UPDATE_CONFIRMED", "UPDATED")}


def _generic_rule_sql(name: str) -> str:
    S = row_settings("s")
    own = "FROM own o LEFT JOIN log s ON s.seq = o.snap_seq"
    if name in _GENERIC_REQ:
        col, _, trig, out = _GENERIC_REQ[name]
        return f"""SELECT {_event_select(_q(out), [("true", row_settings("r"))])}
FROM own o JOIN log r ON r.seq = o.{col}_seq
WHERE o.type = {_q(trig)} AND r.session_id = o.session_id"""
    if name in ("update_cancel", "delete_cancel"):
        trig, out = (("UPDATE_FAILED", "UPDATE_CANCELLED") if name == "update_cancel"
                     else ("DELETE_FAILED", "DELETE_CANCELLED"))
        return f"""SELECT {_event_select(_q(out), [("true", S)], exc="o.exception_type")}
{own} WHERE o.type = {_q(trig)} AND s.seq IS NOT NULL"""
    if name == "rollback":
        return f"""SELECT {_event_select("'ROLLBACK'", [("s.seq IS NOT NULL", S)], fail="o.fail_event_type")}
{own} WHERE o.type = 'PREPARE_ROLLBACK'"""
    if name == "partial_update":
        R = row_settings("r")
        merged = {f: f"coalesce({R[f]}, {S[f]})" for f in R}
        return f"""SELECT {_event_select("'UPDATED'", [("true", merged)])}
FROM own o JOIN log r ON r.seq = o.r_update_seq LEFT JOIN log s ON s.seq = o.snap_seq
WHERE o.type = 'UPDATE_CONFIRMED' AND r.session_id = o.session_id"""
    raise KeyError(name)


GENERIC_RULES = ["create_confirm", "update_confirm", "update_cancel", "delete_cancel", "rollback"]


def generic_sql(rules: list[str] | None = None) -> str:
    w = "(PARTITION BY aggregate_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    reqs = ",\n  ".join(
        f"last_value(CASE WHEN type = {_q(req)} THEN seq END IGNORE NULLS) OVER {w} AS {col}_seq"
        for col, req, _, _ in _GENERIC_REQ.values())
    body = "\nUNION ALL\n".join(_generic_rule_sql(r) for r in (rules or GENERIC_RULES))
    return f"""WITH {generic_ctes()},
own AS (SELECT l.*, last_value(CASE WHEN type IN {_in(GENERIC_SNAPSHOTS)} THEN seq END IGNORE NULLS) OVER {w}
               AS snap_seq, {reqs}
        FROM log l WHERE aggregate_id IS NOT NULL)
{body}"""


def enrich_reference_sql() -> str:
    return """SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, c.c_name, c.c_nationkey, n.n_name
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"""


def delete_reference_check_sql() -> str:
    return """WITH r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL),
q AS (SELECT p_partkey FROM part UNION ALL SELECT p_partkey + (SELECT max(p_partkey) FROM part) FROM part)
SELECT p.p_partkey, CASE WHEN r.l_partkey IS NOT NULL THEN 'REFUSED' ELSE 'ALLOWED' END AS decision,
       CASE WHEN r.l_partkey IS NOT NULL THEN 'ItemReferenced' END AS error_type,
       CASE WHEN r.l_partkey IS NOT NULL THEN 'l_partkey' END AS ref_field,
       CASE WHEN r.l_partkey IS NOT NULL THEN CAST(p.p_partkey AS VARCHAR) END AS ref_value
FROM q p LEFT JOIN r ON r.l_partkey = p.p_partkey"""


_DAMAGED = """damaged AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN left(props, length(props) - 1)
                           ELSE props END AS props FROM events)"""


def malformed_sql() -> str:
    return f"""WITH {_DAMAGED}
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM damaged
WHERE props IS NOT NULL AND json_valid(props)"""


def quarantine_sql() -> str:
    return f"""WITH {_DAMAGED}
SELECT event_id, props FROM damaged WHERE props IS NULL OR NOT json_valid(props)"""
