"""Sequential reference model of the lifecycle closure, for tests only.

Rows are processed one at a time in (seq, hop) order; the tables (snapshot and
last request per key) hold what came strictly before, and every derived row is
processed right after its cause. Small inputs only.
"""

from __future__ import annotations

SNAP = {"SAVED", "SELECTED", "DESELECTED", "SELECTION_CLEARED"}
REQ = {"SELECT_CONFIRMED": ("SELECT", "SELECTED"), "DESELECT_CONFIRMED": ("DESELECT", "DESELECTED"),
       "CLEAR_SELECTION_CONFIRMED": ("CLEAR_SELECTION", "SELECTION_CLEARED"),
       "SAVE_CONFIRMED": ("SAVE", "SAVED")}
CANCEL = {"SELECT_FAILED": ("SELECT_CANCELLED", False), "DESELECT_FAILED": ("DESELECT_CANCELLED", True),
          "CLEAR_SELECTION_FAILED": ("CLEAR_SELECTION_CANCELLED", True), "SAVE_FAILED": ("SAVE_CANCELLED", False),
          "DELETE_FAILED": ("DELETE_CANCELLED", True)}


def _granted(s, req):
    return (s is not None and s["service"] == req["service"] and s["user_id"] == req["user_id"]
            and s["shared"] is False and s["name"] is None)


def _derive(row, snap, reqs, source_snap):
    t, out = row["type"], None
    s = snap["settings"] if snap else None

    def ev(typ, settings=None, exc=None, **kw):
        d = {"type": typ, "settings": settings, "exception_type": exc, "user_id": row["user_id"],
             "last_snapshot_item": None, "fail_event_type": None}
        d.update(kw)
        return d

    if t == "PARTIAL_SELECT":
        req = row["selection_req"]
        if snap is None:
            out = ev("SELECT", dict(id=req["id"], name=None, service=req["service"], user_id=req["user_id"],
                                    shared=False, selection=list(req["selection"])))
        elif not _granted(s, req):
            out = ev("SELECT_FAILED", exc="SELECTION_CHANGE_NOT_ALLOWED")
        else:
            merged = list(dict.fromkeys(list(req["selection"] or []) + list(s["selection"] or [])))
            out = ev("SELECT", dict(s, selection=merged))
    elif t in ("PARTIAL_DESELECT", "PARTIAL_CLEAR_SELECTION") and snap is not None:
        req = row["selection_req"]
        ok, bad = (("DESELECT", "DESELECT_FAILED") if t == "PARTIAL_DESELECT"
                   else ("CLEAR_SELECTION", "CLEAR_SELECTION_FAILED"))
        if not _granted(s, req):
            out = ev(bad, exc="SELECTION_CHANGE_NOT_ALLOWED")
        else:
            rm = set(req["selection"] or [])
            sel = [x for x in (s["selection"] or []) if x not in rm] if t == "PARTIAL_DESELECT" else []
            out = ev(ok, dict(s, selection=sel))
    elif t in REQ:
        r = reqs.get(REQ[t][0])
        if r is not None and r["session_id"] == row["session_id"]:
            out = ev(REQ[t][1], r["settings"])
    elif t in CANCEL:
        typ, inner = CANCEL[t]
        if snap is not None or not inner:
            out = ev(typ, s, row["exception_type"])
    elif t in ("PARTIAL_SAVE", "CLONE") and row["persistence"]["settings_id"] is not None:
        src = source_snap
        p = row["persistence"]
        if src is None:
            err = "SETTINGS_TO_SAVE_NOT_FOUND_EXCEPTION" if t == "PARTIAL_SAVE" else \
                "SETTINGS_TO_CLONE_NOT_FOUND_EXCEPTION"
            out = ev("SAVE_FAILED", exc=err)
        elif t == "PARTIAL_SAVE":
            out = ev("SAVE", dict(src["settings"], id=p["id"], name=p["name"], shared=p["shared"]))
        else:
            out = ev("SAVE", dict(src["settings"], id=p["id"], name=None, shared=False, user_id=row["user_id"]))
    elif t == "UPDATE_ACCESSED_DATE":
        if snap is None:
            out = ev("SAVE_FAILED", exc="SETTINGS_TO_SAVE_NOT_FOUND_EXCEPTION")
        else:
            out = ev("SAVE", dict(s), user_id=snap["user_id"])
    elif t == "CHECK_DELETE" and snap is not None:
        ok = s is not None and s["shared"] is False and row["user_id"] == s["user_id"]
        out = ev("DELETE_CHECKED") if ok else ev("CHECK_DELETE_FAILED", exc="DELETE_SETTINGS_NOT_ALLOWED")
    elif t == "PREPARE_ROLLBACK":
        out = ev("ROLLBACK", last_snapshot_item=s, fail_event_type=row["fail_event_type"])
    elif t == "DELETE_CHECKED":
        out = ev("DELETE")
    elif t == "DELETE_CONFIRMED":
        out = ev("DELETED")
    return out


def closure(rows):
    """rows: dicts of the event-log columns (external, hop 0). Returns all rows with ``hop``."""
    snap, reqs, out = {}, {}, []
    for r in sorted(rows, key=lambda r: r["seq"]):
        cur = dict(r, hop=0)
        while cur is not None:
            out.append(cur)
            key = cur["aggregate_id"]
            src = None
            if cur["type"] in ("PARTIAL_SAVE", "CLONE") and cur["persistence"]:
                src = snap.get(cur["persistence"]["settings_id"])
            d = _derive(cur, snap.get(key), reqs.get(key, {}), src) if key is not None else None
            # the row itself now enters the tables
            if key is not None and cur["type"] in SNAP:
                snap[key] = {"user_id": cur["user_id"], "settings": cur["settings"]}
            if key is not None and cur["type"] in {"SELECT", "DESELECT", "CLEAR_SELECTION", "SAVE"}:
                reqs.setdefault(key, {})[cur["type"]] = {"session_id": cur["session_id"], "settings": cur["settings"]}
            if d is None:
                break
            nxt = dict(cur, hop=cur["hop"] + 1, selection_req=None, persistence=None, arguments=None)
            nxt.update(d)
            cur = nxt
    return out
