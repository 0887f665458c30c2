"""Tiny hand-made event logs and commands."""

from __future__ import annotations

import datetime as dt

from eventfold.schema import COMMANDS, EVENT_LOG

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def settings(id="a", name=None, service="s0", user_id="u0", shared=False, selection=("1",), inserted=None,
             updated=None, accessed=None):
    return {"id": id, "name": name, "service": service, "user_id": user_id, "shared": shared,
            "selection": list(selection) if selection is not None else None,
            "inserted": inserted or T0, "updated": updated or T0, "accessed": accessed}


def selection_req(id="a", service="s0", user_id="u0", selection=("2",)):
    return {"id": id, "service": service, "user_id": user_id, "selection": list(selection),
            "inserted": T0, "updated": T0}


def persistence(id="a", settings_id=None, name=None, service="s0", user_id="u0", shared=False):
    return {"id": id, "settings_id": settings_id, "name": name, "service": service, "user_id": user_id,
            "shared": shared, "inserted": T0, "updated": T0, "accessed": None}


def event(seq, type, key="a", version=1, user_id="u0", session_id="s1", minutes=None, **kw):
    row = {f.name: None for f in EVENT_LOG.fields}
    row.update(seq=seq, event_id=f"e{seq}", aggregate_id=key, type=type, version=version, user_id=user_id,
               session_id=session_id, date=T0 + dt.timedelta(minutes=seq if minutes is None else minutes))
    row.update(kw)
    return row


def log_df(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in EVENT_LOG.fields) for r in rows], EVENT_LOG)


def command(cmd_seq, command, target_id, user_id="u0", source_id=None, session_id="c", minutes=0, **kw):
    row = {f.name: None for f in COMMANDS.fields}
    row.update(cmd_seq=cmd_seq, command=command, target_id=target_id, source_id=source_id, user_id=user_id,
               session_id=session_id, as_of=T0 + dt.timedelta(minutes=minutes))
    row.update(kw)
    return row


def commands_df(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in COMMANDS.fields) for r in rows], COMMANDS)
