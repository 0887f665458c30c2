"""Command decisions against the latest state, and the history fold."""

import pytest

from eventfold.operators.decisions import command_events, decide, stuck_rollback
from eventfold.operators.fold import fold_history
from eventfold.operators.state import latest_state
from helpers import command, commands_df, event, log_df, persistence, settings


def decide_rows(spark, log_rows, cmd_rows):
    state = latest_state(log_df(spark, log_rows)) if log_rows else log_df(spark, [event(0, "X", key="zz")])
    d = decide(commands_df(spark, cmd_rows), state).orderBy("cmd_seq").collect()
    return [(r["decision"], r["out_type"], r["version"], r["error_type"], r["error_args"]) for r in d]


@pytest.mark.parametrize("cmd,expected", [
    ("select", ("ACCEPTED", "PARTIAL_SELECT", 1, None, None)),
    ("deselect", ("REJECTED", None, None, "HistoryNotFound", ["UPDATE | DELETE", "a"])),
    ("clear", ("REJECTED", None, None, "HistoryNotFound", ["UPDATE | DELETE", "a"])),
    ("save", ("ACCEPTED", "PARTIAL_SAVE", 1, None, None)),
    ("update", ("REJECTED", None, None, "HistoryNotFound", ["UPDATE | DELETE", "a"])),
    ("delete", ("REJECTED", None, None, "HistoryNotFound", ["UPDATE | DELETE", "a"])),
    ("update_accessed_date", ("REJECTED", None, None, "HistoryNotFound", ["UPDATE | DELETE", "a"])),
])
def test_no_state(spark, cmd, expected):
    assert decide_rows(spark, [], [command(1, cmd, "a")]) == [expected]


@pytest.mark.parametrize("cmd,expected", [
    ("select", ("ACCEPTED", "PARTIAL_SELECT", 1, None, None)),
    ("save", ("ACCEPTED", "PARTIAL_SAVE", 1, None, None)),
    ("update", ("ACCEPTED", "PARTIAL_SAVE", 4, None, None)),
    ("delete", ("ACCEPTED", "CHECK_DELETE", 4, None, None)),
    ("update_accessed_date", ("ACCEPTED", "UPDATE_ACCESSED_DATE", 4, None, None)),
])
def test_saved_state(spark, cmd, expected):
    log = [event(1, "SAVED", version=3, settings=settings())]
    assert decide_rows(spark, log, [command(1, cmd, "a")]) == [expected]


def test_locked_and_deleted(spark):
    locked = [event(1, "SAVE", version=2)]
    for cmd in ("select", "deselect", "save", "update", "delete", "update_accessed_date"):
        assert decide_rows(spark, locked, [command(1, cmd, "a")])[0][3] == "ItemLocked"
    deleted = [event(1, "DELETED", version=5)]
    assert decide_rows(spark, deleted, [command(1, "update", "a")])[0][3:] == ("ItemNotFound", ["id", "a"])
    assert decide_rows(spark, deleted, [command(1, "save", "a")])[0][:3] == ("ACCEPTED", "PARTIAL_SAVE", 1)
    # the selection fold has no DELETED branch: locked for selection commands
    assert decide_rows(spark, deleted, [command(1, "select", "a")])[0][3] == "ItemLocked"
    # the persistence fold does not accept a working selection
    assert decide_rows(spark, [event(1, "SELECTED")], [command(1, "update", "a")])[0][3] == "ItemLocked"


def test_ownership(spark):
    log = [event(1, "SELECTED", user_id="15", settings=settings(user_id="15"))]
    assert decide_rows(spark, log, [command(1, "select", "a", user_id="13")])[0][3] == "SettingsChangeForbidden"
    assert decide_rows(spark, log, [command(1, "select", "a", user_id="15")])[0][0] == "ACCEPTED"
    log = [event(1, "SAVED", user_id="15", settings=settings(user_id="15"))]
    assert decide_rows(spark, log, [command(1, "update_accessed_date", "a", user_id="13")])[0][0] == "ACCEPTED"


def test_clone_visibility_and_new_id(spark):
    own = [event(1, "SAVED", key="src", user_id="other", settings=settings(id="src", shared=False))]
    shared = [event(1, "SAVED", key="src", user_id="other", settings=settings(id="src", shared=True))]
    cmd = [command(1, "clone", "new", source_id="src", user_id="me",
                   persistence=persistence(id="new", settings_id="src"))]
    assert decide_rows(spark, own, cmd)[0][3] == "SettingsChangeForbidden"
    assert decide_rows(spark, shared, cmd)[0][:3] == ("ACCEPTED", "CLONE", 1)
    live = shared + [event(2, "SAVED", key="new", settings=settings(id="new"))]
    assert decide_rows(spark, live, cmd)[0][0] == "IGNORED"
    gone = shared + [event(2, "DELETED", key="new")]
    assert decide_rows(spark, gone, cmd)[0][3:] == ("ItemNotFound", ["id", "src"])
    assert decide_rows(spark, [], cmd)[0][3:] == ("HistoryNotFound", ["UPDATE | DELETE", "src"])


def test_clone_emits_access_date_on_source(spark):
    log = [event(1, "SAVED", key="src", version=4, settings=settings(id="src", shared=True))]
    cmds = commands_df(spark, [command(9, "clone", "new", source_id="src", user_id="me")])
    ev = command_events(decide(cmds, latest_state(log_df(spark, log)))).orderBy("hop").collect()
    assert [(e["aggregate_id"], e["type"], e["version"]) for e in ev] == \
        [("new", "CLONE", 1), ("src", "UPDATE_ACCESSED_DATE", 5)]


def test_stuck_rollback(spark):
    log = [event(1, "SAVE", version=2, minutes=0), event(1, "SAVE", key="b", version=2, minutes=0)]
    log[1]["seq"] = 2
    cmds = [command(1, "update", "a", minutes=30), command(2, "update", "b", minutes=600)]
    d = decide(commands_df(spark, cmds), latest_state(log_df(spark, log)))
    rb = stuck_rollback(d, timeout_ms=60 * 60 * 1000).collect()
    # reference rule: only the event younger than the timeout is rolled back
    assert [(r["aggregate_id"], r["type"], r["fail_event_type"]) for r in rb] == [("a", "PREPARE_ROLLBACK", "SAVE")]
    older = stuck_rollback(d, timeout_ms=60 * 60 * 1000, mode="older").collect()
    assert [r["aggregate_id"] for r in older] == ["b"]


def test_fold(spark):
    def fold(types, family="persistence"):
        rows = [event(i + 1, t, version=i + 1, settings=settings(name=f"v{i + 1}")) for i, t in enumerate(types)]
        return fold_history(log_df(spark, rows), family, chunk=0).collect()[0]

    f = fold(["SAVED", "SAVE_CANCELLED"])
    assert (f["version"], f["deleted"], f["locked"], f["settings"]["name"]) == (2, False, False, "v2")
    f = fold(["SAVED", "DELETED"])
    assert (f["version"], f["deleted"], f["settings"]["name"]) == (2, True, "v1")
    f = fold(["SAVED", "SAVE", "SAVED"])
    assert (f["version"], f["locked"], f["lock_type"], f["applied"]) == (1, True, "SAVE", 1)
    f = fold(["SELECTED", "SELECT_CANCELLED"], "selection")
    assert (f["version"], f["locked"], f["settings"]["name"]) == (2, False, "v2")
    assert fold(["SELECTED"], "persistence")["locked"]


def test_decide_as_of_sees_only_earlier_events(spark):
    from eventfold.operators.decisions import decide_as_of
    log = log_df(spark, [event(10, "SAVED", version=1, settings=settings()),
                         event(30, "SAVE", version=2),                      # locks the item from seq 30 on
                         event(40, "SAVED", key="src", settings=settings(id="src", shared=True))])
    cmds = commands_df(spark, [command(20, "update", "a"), command(35, "update", "a"),
                               command(5, "update", "a"),
                               command(36, "clone", "new", source_id="src", user_id="me"),
                               command(45, "clone", "new", source_id="src", user_id="me")])
    got = {r["cmd_seq"]: (r["decision"], r["error_type"], r["version"])
           for r in decide_as_of(cmds, log, chunk=8).collect()}
    assert got == {5: ("REJECTED", "HistoryNotFound", None), 20: ("ACCEPTED", None, 2),
                   35: ("REJECTED", "ItemLocked", None), 36: ("REJECTED", "HistoryNotFound", None),
                   45: ("ACCEPTED", None, 1)}


def test_decide_as_of_equals_decide_when_commands_follow_the_state(spark):
    from eventfold.operators.decisions import decide_as_of
    from eventfold.sources.fixtures import decision_log
    state, cmds = decision_log(spark, "/root/testdata/sf0.001")
    cols = ["cmd_seq", "decision", "out_type", "version", "error_type", "error_args"]
    a = sorted(map(tuple, decide(cmds, latest_state(state)).select(cols).collect()), key=str)
    b = sorted(map(tuple, decide_as_of(cmds, state).select(cols).collect()), key=str)
    assert a == b and len(a) > 100


def test_lock_sets_are_parameters(spark):
    log = log_df(spark, [event(1, "SAVE", version=2)])
    cmds = commands_df(spark, [command(1, "update", "a")])
    default = decide(cmds, latest_state(log)).first()
    assert default["error_type"] == "ItemLocked"
    relaxed = decide(cmds, latest_state(log), persistence_accepts=("SAVED", "SAVE", "DELETED")).first()
    assert (relaxed["decision"], relaxed["version"]) == ("ACCEPTED", 3)
