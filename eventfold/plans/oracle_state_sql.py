"""DuckDB oracles for state, fold, decisions, outcomes, relays and alerts."""

from __future__ import annotations

from eventfold.plans.oracle_sql import _in, _q, _settings_case, derive_sql, fixture_ctes, row_settings
from eventfold.schema import (
    CANCELLED_TYPES, HISTORY_NOT_FOUND_ARG, PERSISTENCE_ACCEPTS, PERSISTENCE_SETS_SETTINGS, SELECTION_ACCEPTS,
    SELECTION_SETS_SETTINGS, SNAPSHOT_TYPES, SUCCESS_TYPES, Errors, Types,
)
from eventfold.sources.fixtures import HANDLED, PROFILE_D_COMMANDS, PROFILE_D_TYPES, PROFILE_O_TYPES

TIMEOUT_MS = 12 * 3600 * 1000


def _flat_log_select(a: str = "l") -> str:
    """Flattened event row, as ``flatten_events`` projects a log row."""
    return f"""{a}.seq, {a}.type, {a}.aggregate_id, {a}.version, {a}.user_id, {a}.session_id,
       epoch_us({a}.date) AS date_us, {a}.exception_type, {a}.fail_event_type,
       {_settings_case([("true", row_settings(a))])}"""


def latest_state_sql() -> str:
    return f"""WITH {fixture_ctes()}
SELECT {_flat_log_select()} FROM log l
QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY seq DESC) = 1"""


def closed_log_state_sql() -> str:
    return f"""WITH rows AS (
  SELECT 0 AS hop, * FROM (WITH {fixture_ctes()} SELECT {_flat_log_select()} FROM log l)
  UNION ALL BY NAME SELECT * FROM ({derive_sql()}))
SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY seq DESC, hop DESC) = 1"""


def latest_by_key_sql() -> str:
    return f"""WITH {fixture_ctes()}
SELECT {_flat_log_select()} FROM log l WHERE type IN {_in(SNAPSHOT_TYPES)}
QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY seq DESC) = 1"""


def state_get_sql() -> str:
    return f"""WITH {fixture_ctes()}
SELECT {_flat_log_select()} FROM log l
WHERE aggregate_id IN (SELECT settings_id FROM log WHERE type IN ('PARTIAL_SAVE', 'CLONE'))
QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY seq DESC) = 1"""


def filter_sql(types) -> str:
    return f"""WITH {fixture_ctes()}
SELECT {_flat_log_select()} FROM log l WHERE type IN {_in(types)}"""


def delete_relay_sql() -> str:
    return f"""WITH {fixture_ctes()}
SELECT l.seq, CASE l.type WHEN 'DELETE_CHECKED' THEN 'DELETE' ELSE 'DELETED' END AS type, l.aggregate_id,
       l.version, l.user_id, l.session_id, epoch_us(l.date) AS date_us,
       CAST(NULL AS VARCHAR) AS exception_type, CAST(NULL AS VARCHAR) AS fail_event_type,
       {_settings_case([])}
FROM log l WHERE l.type IN ('DELETE_CHECKED', 'DELETE_CONFIRMED')"""


def _handler_cte() -> str:
    case = "CASE " + " ".join(f"WHEN seq % 2 = 0 AND type = {_q(a)} THEN {_q(b)}" for a, b in HANDLED.items()) + " ELSE type END"
    return f"""{fixture_ctes()},
handled AS (SELECT * REPLACE ({case} AS type) FROM log)"""


def event_router_sql() -> str:
    routes = ([(t, "RESOLVE_SUCCESS") for t in SUCCESS_TYPES] + [(t, "RESOLVE_ERROR") for t in CANCELLED_TYPES]
              + [(Types.DELETE_CHECKED, "PUBLISH_DELETE"), (Types.DELETE_CONFIRMED, "PUBLISH_DELETED"),
                 (Types.ROLLBACK_FAILED, "ALERT")])
    case = "CASE " + " ".join(f"WHEN type = {_q(t)} THEN {_q(a)}" for t, a in routes) + " END"
    return f"""WITH {_handler_cte()}
SELECT seq, aggregate_id, session_id, type, {case} AS action, exception_type
FROM handled WHERE type IN {_in([t for t, _ in routes])}"""


def session_mismatch_sql(ctes: str | None = None, table: str = "log") -> str:
    pairs = [(Types.SELECT_CONFIRMED, Types.SELECT), (Types.DESELECT_CONFIRMED, Types.DESELECT),
             (Types.CLEAR_SELECTION_CONFIRMED, Types.CLEAR_SELECTION), (Types.SAVE_CONFIRMED, Types.SAVE)]
    w = "(PARTITION BY aggregate_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    req = "CASE " + " ".join(
        f"WHEN type = {_q(c)} THEN last_value(CASE WHEN type = {_q(r)} THEN seq END IGNORE NULLS) OVER {w}"
        for c, r in pairs) + " END"
    return f"""WITH {ctes or fixture_ctes()},
x AS (SELECT l.*, {req} AS req_seq FROM {table} l WHERE aggregate_id IS NOT NULL)
SELECT x.seq, x.aggregate_id, 'SESSION_MISMATCH' AS kind, x.type, x.session_id,
       r.session_id AS request_session_id, epoch_us(x.date) AS date_us
FROM x JOIN {table} r ON r.seq = x.req_seq
WHERE x.type IN {_in([c for c, _ in pairs])} AND NOT coalesce(r.session_id = x.session_id, false)"""


# --- profile D --------------------------------------------------------------

def profile_d_ctes(interleaved: bool = False) -> str:
    """Profile D; ``interleaved``: every row is a state event and a command,
    which sees the state strictly before it."""
    types = "[" + ", ".join(_q(t) for t in PROFILE_D_TYPES) + "]"
    cmds = "[" + ", ".join(_q(c) for c in PROFILE_D_COMMANDS) + "]"
    return f"""{fixture_ctes()},
bounds AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events),
pd AS (SELECT p.*, p.seq < b.lo + (b.hi - b.lo + 1) * 2 / 3 AS is_state FROM p, bounds b),
dstate AS (SELECT pd.*, {types}[k % 10 + 1] AS type, CAST(NULL AS VARCHAR) AS fail_event_type
           FROM pd WHERE {'true' if interleaved else 'is_state'}),
c0 AS (SELECT pd.*, {cmds}[k % 8 + 1] AS command,
              CASE WHEN k % 4 = 0 THEN aggregate_id ELSE 'new' || CAST(seq AS VARCHAR) END AS new_id
       FROM pd WHERE {'true' if interleaved else 'NOT is_state'}),
cmds AS (SELECT seq AS cmd_seq, command,
                CASE WHEN command = 'clone' THEN new_id ELSE settings_id END AS target_id,
                CASE WHEN command = 'clone' THEN settings_id END AS source_id,
                user_id, session_id, date AS as_of FROM c0),
st AS (SELECT aggregate_id, seq, type, version, user_id, session_id, date, shared, fail_event_type FROM dstate
       {'' if interleaved else 'QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY seq DESC) = 1'}),
j AS (SELECT c.*, t.aggregate_id AS t_id, t.type AS t_type, t.version AS t_version, t.user_id AS t_user,
             t.session_id AS t_session, t.date AS t_date, t.fail_event_type AS t_fail,
             s.aggregate_id AS s_id, s.type AS s_type, s.version AS s_version, s.user_id AS s_user,
             s.shared AS s_shared
      FROM cmds c {'ASOF' if interleaved else ''} LEFT JOIN st t ON t.aggregate_id = c.target_id {'AND c.cmd_seq > t.seq' if interleaved else ''}
      {'ASOF' if interleaved else ''} LEFT JOIN st s ON s.aggregate_id = c.source_id {'AND c.cmd_seq > s.seq' if interleaved else ''})"""


def _decision_case() -> tuple[str, str, str]:
    """(decision, error_type, error_args) CASE expressions over ``j``."""
    sel = _in(SELECTION_ACCEPTS)
    per = _in(PERSISTENCE_ACCEPTS)
    no_state = "t_id IS NULL"

    def locked(p: str, fam: str) -> str:
        return f"({p}_id IS NOT NULL AND {p}_type NOT IN {fam})"

    def deleted(p: str) -> str:
        return f"({p}_id IS NOT NULL AND {p}_type = 'DELETED')"

    differs = "(t_user IS NOT NULL AND NOT coalesce(t_user = user_id, false))"
    hist = ("REJECTED", _q(Errors.HISTORY_NOT_FOUND), f"{_q(HISTORY_NOT_FOUND_ARG)} || ',' || target_id")
    lock_t = ("REJECTED", _q(Errors.ITEM_LOCKED), "'id,' || t_id")
    nf = ("REJECTED", _q(Errors.ITEM_NOT_FOUND), "'id,' || target_id")
    forb = ("REJECTED", _q(Errors.CHANGE_FORBIDDEN), "CAST(NULL AS VARCHAR)")
    ok = ("ACCEPTED", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)")
    rules = {
        "select": [(no_state, ok), (locked("t", sel), lock_t), (differs, forb)],
        "deselect": [(no_state, hist), (locked("t", sel), lock_t), (differs, forb)],
        "clear": [(no_state, hist), (locked("t", sel), lock_t), (differs, forb)],
        "save": [(no_state, ok), (locked("t", per), lock_t), (deleted("t"), ok), (differs, forb)],
        "update": [(no_state, hist), (locked("t", per), lock_t), (deleted("t"), nf), (differs, forb)],
        "delete": [(no_state, hist), (locked("t", per), lock_t), (deleted("t"), nf), (differs, forb)],
        "update_accessed_date": [(no_state, hist), (locked("t", per), lock_t), (deleted("t"), nf)],
        "clone": [
            (locked("t", per), lock_t),
            (f"(t_id IS NOT NULL AND NOT {deleted('t')})", ("IGNORED", "CAST(NULL AS VARCHAR)",
                                                              "CAST(NULL AS VARCHAR)")),
            ("s_id IS NULL", ("REJECTED", _q(Errors.HISTORY_NOT_FOUND),
                              f"{_q(HISTORY_NOT_FOUND_ARG)} || ',' || source_id")),
            (locked("s", per), ("REJECTED", _q(Errors.ITEM_LOCKED), "'id,' || s_id")),
            (f"({deleted('s')} OR {deleted('t')})", ("REJECTED", _q(Errors.ITEM_NOT_FOUND), "'id,' || source_id")),
            ("NOT (coalesce(s_user = user_id, false) OR coalesce(s_shared, false))", forb),
        ],
    }
    parts = {0: [], 1: [], 2: []}
    for c, rs in rules.items():
        for cond, out in rs:
            for i in range(3):
                val = _q(out[i]) if i == 0 else out[i]
                parts[i].append(f"WHEN command = {_q(c)} AND {cond} THEN {val}")
    dec = "CASE " + " ".join(parts[0]) + " ELSE 'ACCEPTED' END"
    et = "CASE " + " ".join(parts[1]) + " ELSE CAST(NULL AS VARCHAR) END"
    ea = "CASE " + " ".join(parts[2]) + " ELSE CAST(NULL AS VARCHAR) END"
    return dec, et, ea


_OUT = {"select": "PARTIAL_SELECT", "deselect": "PARTIAL_DESELECT", "clear": "PARTIAL_CLEAR_SELECTION",
        "save": "PARTIAL_SAVE", "update": "PARTIAL_SAVE", "delete": "CHECK_DELETE", "clone": "CLONE",
        "update_accessed_date": "UPDATE_ACCESSED_DATE"}


def _decided_cte(interleaved: bool = False) -> str:
    dec, et, ea = _decision_case()
    out = "CASE command " + " ".join(f"WHEN {_q(c)} THEN {_q(t)}" for c, t in _OUT.items()) + " END"
    return f"""{profile_d_ctes(interleaved)},
d AS (SELECT j.*, {dec} AS decision, {et} AS error_type, {ea} AS error_args, {out} AS out_name FROM j)"""


def decisions_sql(interleaved: bool = False) -> str:
    return f"""WITH {_decided_cte(interleaved)}
SELECT cmd_seq, command, decision, CASE WHEN decision = 'ACCEPTED' THEN out_name END AS out_type,
       CASE WHEN decision = 'ACCEPTED' THEN CAST(CASE WHEN command IN ('select', 'save', 'clone') THEN 1
            ELSE t_version + 1 END AS INTEGER) END AS version, error_type, error_args
FROM d"""


def decisions_as_of_sql() -> str:
    return decisions_sql(interleaved=True)


def command_events_sql() -> str:
    return f"""WITH {_decided_cte()}
SELECT cmd_seq AS seq, CAST(0 AS INTEGER) AS hop, 'c' || cmd_seq AS event_id, target_id AS aggregate_id, out_name AS type,
       CAST(CASE WHEN command IN ('select', 'save', 'clone') THEN 1 ELSE t_version + 1 END AS INTEGER) AS version,
       user_id, session_id, epoch_us(as_of) AS date_us
FROM d WHERE decision = 'ACCEPTED'
UNION ALL
SELECT cmd_seq, CAST(1 AS INTEGER), 'c' || cmd_seq || '#1', source_id, 'UPDATE_ACCESSED_DATE', CAST(s_version + 1 AS INTEGER), user_id,
       session_id, epoch_us(as_of)
FROM d WHERE decision = 'ACCEPTED' AND command = 'clone'"""


def stuck_rollback_sql(timeout_ms: int = TIMEOUT_MS) -> str:
    return f"""WITH {_decided_cte()}
SELECT cmd_seq, 'c' || cmd_seq || '#rollback' AS event_id, t_id AS aggregate_id, 'PREPARE_ROLLBACK' AS type, t_version AS version, t_user AS user_id,
       t_session AS session_id, epoch_us(t_date) AS date_us,
       CASE WHEN t_type = 'ROLLBACK_FAILED' THEN t_fail ELSE t_type END AS fail_event_type
FROM d WHERE decision = 'REJECTED' AND error_type = {_q(Errors.ITEM_LOCKED)} AND t_id IS NOT NULL
  AND t_date + to_milliseconds({timeout_ms}) > as_of"""


def fold_history_sql() -> str:
    return f"""WITH {profile_d_ctes(interleaved=True)},
fs AS (SELECT * REPLACE (CASE WHEN uid % 2 = 0 AND type = 'SAVE' THEN 'SAVED' WHEN uid % 2 = 0 AND type = 'SELECT' THEN 'SELECTED'
                         ELSE type END AS type) FROM dstate),
fam AS (SELECT 'persistence' AS family UNION ALL SELECT 'selection'),
x AS (SELECT f.seq, f.aggregate_id, f.type, fam.family,
             CASE WHEN fam.family = 'persistence' THEN f.type IN {_in(PERSISTENCE_ACCEPTS)}
                  ELSE f.type IN {_in(SELECTION_ACCEPTS)} END AS acc,
             CASE WHEN fam.family = 'persistence' THEN f.type IN {_in(PERSISTENCE_SETS_SETTINGS)}
                  ELSE f.type IN {_in(SELECTION_SETS_SETTINGS)} END AS sets
      FROM fs f, fam),
y AS (SELECT *, min(CASE WHEN NOT acc THEN seq END) OVER (PARTITION BY family, aggregate_id) AS lock_seq FROM x),
z AS (SELECT *, acc AND (lock_seq IS NULL OR seq < lock_seq) AS live FROM y),
a AS (SELECT family, aggregate_id, max(CASE WHEN live THEN seq END) AS vseq,
             max(CASE WHEN live AND sets THEN seq END) AS sseq,
             coalesce(bool_or(CASE WHEN live THEN type = 'DELETED' END), false) AS deleted,
             min(lock_seq) AS lock_seq, count(CASE WHEN live THEN 1 END) AS applied
      FROM z GROUP BY family, aggregate_id)
SELECT a.aggregate_id, a.family, v.version, a.deleted, a.lock_seq IS NOT NULL AS locked, lk.type AS lock_type,
       a.lock_seq, a.applied, {_settings_case([("s.seq IS NOT NULL", row_settings("s"))])}
FROM a LEFT JOIN fs v ON v.seq = a.vseq LEFT JOIN fs s ON s.seq = a.sseq LEFT JOIN fs lk ON lk.seq = a.lock_seq"""


# --- profile O --------------------------------------------------------------

def profile_o_ctes() -> str:
    kind = "CASE event_type " + " ".join(f"WHEN {_q(s)} THEN {_q(d)}" for s, d in PROFILE_O_TYPES.items()) + " END"
    return f"""ev AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
       FROM events),
po AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) || ':' || CAST(k % 3 AS VARCHAR) AS session_id,
              CAST(user_id AS VARCHAR) AS aggregate_id, {kind} AS type, ts AS date,
              CASE WHEN event_type = 'error' THEN 'E' || CAST(k % 3 AS VARCHAR) END AS exception_type FROM ev)"""


def _outcome_cte(timeout_ms: int) -> str:
    term = _in(list(SUCCESS_TYPES) + list(CANCELLED_TYPES))
    return f"""{profile_o_ctes()},
x AS (SELECT *, first_value(CASE WHEN type IN {term} THEN seq END IGNORE NULLS)
                OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS tseq
      FROM po WHERE type = 'COMMAND' OR type IN {term}),
o AS (SELECT x.*, t.type AS t_type, t.exception_type AS t_exc,
             t.seq IS NOT NULL AND t.date <= x.date + to_milliseconds({timeout_ms}) AS in_time, t.seq AS t_seq
      FROM x LEFT JOIN po t ON t.seq = x.tseq WHERE x.type = 'COMMAND'),
oc AS (SELECT o.*, CASE WHEN in_time AND t_type IN {_in(SUCCESS_TYPES)} THEN 'SUCCESS'
                        WHEN in_time THEN 'CANCELLED' ELSE 'TIMEOUT' END AS status FROM o)"""


def command_outcome_sql(timeout_ms: int = TIMEOUT_MS) -> str:
    return f"""WITH {_outcome_cte(timeout_ms)}
SELECT seq, session_id, aggregate_id, type, epoch_us(date) AS date_us, status,
       CASE WHEN in_time THEN t_seq END AS terminal_seq,
       CASE WHEN status = 'CANCELLED' THEN t_exc WHEN status = 'TIMEOUT' THEN {_q(Errors.CONFIRMATION_TIMEOUT)}
       END AS error_type
FROM oc"""


def command_timeout_sql(timeout_ms: int = TIMEOUT_MS) -> str:
    return f"""WITH {_outcome_cte(timeout_ms)}
SELECT seq, session_id, aggregate_id, {_q(Errors.CONFIRMATION_TIMEOUT)} AS error_type,
       'PREPARE_ROLLBACK' AS rollback_type, type AS fail_event_type, epoch_us(date) AS date_us
FROM oc WHERE status = 'TIMEOUT'"""


def alerts_sql(timeout_ms: int = TIMEOUT_MS) -> str:
    return f"""SELECT seq, aggregate_id, kind, type, session_id, date_us FROM ({session_mismatch_sql(_handler_cte(), "handled")})
UNION ALL
SELECT seq, aggregate_id, 'ROLLBACK_FAILED' AS kind, fail_event_type AS type, session_id, epoch_us(date) AS date_us
FROM (WITH {_handler_cte()} SELECT * FROM handled) WHERE type = 'ROLLBACK_FAILED'
UNION ALL
SELECT seq, aggregate_id, 'CONFIRMATION_TIMEOUT', fail_event_type, session_id, date_us FROM ({command_timeout_sql(timeout_ms)})
UNION ALL
SELECT cmd_seq, aggregate_id, 'ITEM_LOCKED', fail_event_type, session_id, date_us FROM ({stuck_rollback_sql(timeout_ms)})"""


def timeout_rollbacks_sql(timeout_ms: int = TIMEOUT_MS) -> str:
    return f"""WITH {_outcome_cte(timeout_ms)}
SELECT o.seq, CAST(1 AS INTEGER) AS hop, CAST(o.seq AS VARCHAR) || '#timeout' AS event_id, o.aggregate_id, 'PREPARE_ROLLBACK' AS type,
       CAST(1 + e.k % 3 AS INTEGER) AS version, CASE WHEN e.k % 9 = 0 THEN 'u1' ELSE 'u0' END AS user_id, o.session_id,
       epoch_us(o.date) AS date_us, {_q(Errors.CONFIRMATION_TIMEOUT)} AS exception_type, o.type AS fail_event_type
FROM oc o JOIN ev e ON e.event_id = o.seq WHERE status = 'TIMEOUT'"""


def tombstone_sql() -> str:
    return f"""WITH {fixture_ctes()},
m AS (SELECT seq, aggregate_id, type, coalesce(exception_type IS NOT NULL AND seq % 2 = 1, false) AS gone FROM log WHERE aggregate_id IS NOT NULL),
a AS (SELECT aggregate_id, max(CASE WHEN NOT gone THEN seq END) AS kept, max(seq) AS last FROM m GROUP BY aggregate_id)
SELECT a.aggregate_id, m.seq AS table_seq, m.type AS table_type, CASE WHEN kept = last THEN m.seq END AS store_seq,
       CASE WHEN kept = last THEN m.type END AS store_type
FROM a JOIN m ON m.seq = a.kept"""


_EV = "ev AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def live_references_sql() -> str:
    return f"""WITH {_EV},
r AS (SELECT event_id AS seq, user_id AS referrer, CASE WHEN event_type <> 'error' THEN k END AS item FROM ev WHERE event_type <> 'signup'),
l AS (SELECT *, lag(item) OVER (PARTITION BY referrer ORDER BY seq) AS old FROM r),
c AS (SELECT seq, old AS item, -1 AS delta FROM l WHERE old IS DISTINCT FROM item AND old IS NOT NULL
      UNION ALL SELECT seq, item, 1 FROM l WHERE old IS DISTINCT FROM item AND item IS NOT NULL),
q AS (SELECT event_id AS seq, k AS item FROM ev WHERE event_type = 'signup'),
n AS (SELECT q.seq, q.item, coalesce(sum(c.delta), 0)::BIGINT AS refs FROM q LEFT JOIN c ON c.item = q.item AND c.seq < q.seq GROUP BY q.seq, q.item)
SELECT seq, item, refs AS "references", CASE WHEN refs > 0 THEN 'REFUSED' ELSE 'ALLOWED' END AS decision,
       CASE WHEN refs > 0 THEN {_q(Errors.ITEM_REFERENCED)} END AS error_type FROM n"""


def enrich_changing_sql() -> str:
    return f"""WITH {_EV},
f AS (SELECT event_id AS seq, event_type, user_id + k % 2 AS related_id FROM ev WHERE event_type IN ('view', 'click')),
d AS (SELECT event_id AS seq, user_id AS item_id, k % 3 AS level, k % 7 AS team FROM ev WHERE event_type = 'purchase')
SELECT f.seq, f.event_type, f.related_id, d.level, d.team FROM f ASOF LEFT JOIN d ON d.item_id = f.related_id AND f.seq > d.seq"""


def valid_runs_sql() -> str:
    return f"""WITH {_EV},
d AS (SELECT event_id AS seq, user_id AS item_id, k % 3 AS level, k % 7 AS team FROM ev WHERE event_type = 'purchase' AND user_id IS NOT NULL),
x AS (SELECT *, lag(seq) OVER w AS before, lag(level) OVER w AS l, lag(team) OVER w AS t FROM d WINDOW w AS (PARTITION BY item_id ORDER BY seq))
SELECT item_id, seq, level, team FROM x WHERE before IS NULL OR l IS DISTINCT FROM level OR t IS DISTINCT FROM team"""
