"""Hand-made logs, one per lifecycle case of the original integration tests."""

import pytest
from pyspark.sql import functions as F

from eventfold.operators.derive import derive, derive_once, session_mismatch_report
from eventfold.operators.outcomes import delete_relay
from helpers import T0, event, log_df, persistence, selection_req, settings


def run(spark, rows, chunk=0, **kw):
    out = derive_once(log_df(spark, rows), chunk=chunk, **kw).orderBy("seq").collect()
    return [r.asDict(recursive=True) for r in out]


@pytest.fixture(params=[0, 2])
def chunk(request):
    return request.param


def test_new_selection(spark, chunk):
    [d] = run(spark, [event(1, "PARTIAL_SELECT", selection_req=selection_req(selection=("2", "3")))], chunk)
    assert d["type"] == "SELECT"
    s = d["settings"]
    assert (s["id"], s["service"], s["user_id"], s["selection"], s["shared"], s["name"]) == \
        ("a", "s0", "u0", ["2", "3"], False, None)


def test_union_new_first(spark, chunk):
    rows = [event(1, "SELECTED", settings=settings(selection=("1", "2"))),
            event(2, "PARTIAL_SELECT", selection_req=selection_req(selection=("3", "2")))]
    d = run(spark, rows, chunk)[-1]
    assert d["type"] == "SELECT" and d["settings"]["selection"] == ["3", "2", "1"]


def test_not_granted(spark, chunk):
    rows = [event(1, "SELECTED", settings=settings(name="mine")),
            event(2, "PARTIAL_SELECT", selection_req=selection_req())]
    d = run(spark, rows, chunk)[-1]
    assert d["type"] == "SELECT_FAILED" and d["exception_type"] == "SELECTION_CHANGE_NOT_ALLOWED"
    assert d["settings"] is None


@pytest.mark.parametrize("field,value", [("service", "other"), ("user_id", "u9"), ("shared", True)])
def test_not_granted_other_reasons(spark, field, value):
    s = settings(**{field: value})
    rows = [event(1, "SELECTED", settings=s), event(2, "PARTIAL_SELECT", selection_req=selection_req())]
    assert run(spark, rows)[-1]["type"] == "SELECT_FAILED"


def test_confirm_same_session(spark, chunk):
    rows = [event(1, "SELECT", settings=settings(selection=("7",)), session_id="x"),
            event(2, "SELECT_CONFIRMED", session_id="x")]
    d = run(spark, rows, chunk)[-1]
    assert d["seq"] == 2 and d["type"] == "SELECTED" and d["settings"]["selection"] == ["7"]


def test_confirm_other_session_is_dropped_and_reported(spark):
    rows = [event(1, "SELECT", settings=settings(), session_id="x"), event(2, "SELECT_CONFIRMED", session_id="y")]
    assert [d for d in run(spark, rows) if d["seq"] == 2] == []
    [alert] = session_mismatch_report(log_df(spark, rows), chunk=0).collect()
    assert (alert["seq"], alert["session_id"], alert["request_session_id"]) == (2, "y", "x")


def test_cancel_without_and_with_snapshot(spark, chunk):
    [d] = run(spark, [event(1, "SELECT_FAILED", exception_type="E1")], chunk)
    assert d["type"] == "SELECT_CANCELLED" and d["settings"] is None and d["exception_type"] == "E1"
    rows = [event(1, "SELECTED", settings=settings(selection=("5",))), event(2, "SELECT_FAILED", exception_type="E")]
    d = run(spark, rows, chunk)[-1]
    assert d["type"] == "SELECT_CANCELLED" and d["settings"]["selection"] == ["5"]


def test_deselect_keeps_other_repeats(spark, chunk):
    rows = [event(1, "SELECTED", settings=settings(selection=("1", "2", "2", "3"))),
            event(2, "PARTIAL_DESELECT", selection_req=selection_req(selection=("1", "3")))]
    d = run(spark, rows, chunk)[-1]
    assert d["type"] == "DESELECT" and d["settings"]["selection"] == ["2", "2"]


def test_deselect_needs_snapshot_and_grant(spark):
    assert run(spark, [event(1, "PARTIAL_DESELECT", selection_req=selection_req())]) == []
    rows = [event(1, "SELECTED", settings=settings(shared=True)),
            event(2, "PARTIAL_DESELECT", selection_req=selection_req())]
    assert run(spark, rows)[-1]["type"] == "DESELECT_FAILED"


def test_clear(spark, chunk):
    rows = [event(1, "SELECTED", settings=settings(selection=("1", "2"))),
            event(2, "PARTIAL_CLEAR_SELECTION", selection_req=selection_req())]
    d = run(spark, rows, chunk)[-1]
    assert d["type"] == "CLEAR_SELECTION" and d["settings"]["selection"] == []


def test_save_across_keys(spark, chunk):
    rows = [event(1, "SELECTED", key="A", settings=settings(id="A", selection=("9",))),
            event(2, "PARTIAL_SAVE", key="B",
                  persistence=persistence(id="B", settings_id="A", name="saved", shared=True))]
    d = [x for x in run(spark, rows, chunk) if x["seq"] == 2][0]
    assert d["type"] == "SAVE" and d["aggregate_id"] == "B"
    s = d["settings"]
    assert (s["id"], s["name"], s["shared"], s["selection"]) == ("B", "saved", True, ["9"])


def test_save_without_source(spark):
    rows = [event(1, "PARTIAL_SAVE", key="B", persistence=persistence(id="B", settings_id="notExists"))]
    [d] = run(spark, rows)
    assert d["type"] == "SAVE_FAILED" and d["exception_type"] == "SETTINGS_TO_SAVE_NOT_FOUND_EXCEPTION"


def test_null_source_id_is_dropped(spark):
    assert run(spark, [event(1, "PARTIAL_SAVE", persistence=persistence(settings_id=None))]) == []


def test_save_confirm_and_cancel(spark):
    rows = [event(1, "SAVE", settings=settings(name="n")), event(2, "SAVE_CONFIRMED")]
    assert run(spark, rows)[-1]["type"] == "SAVED"
    rows = [event(1, "SAVED", settings=settings(name="n")), event(2, "SAVE_FAILED", exception_type="E")]
    d = run(spark, rows)[-1]
    assert d["type"] == "SAVE_CANCELLED" and d["settings"]["name"] == "n"


def test_delete_check(spark):
    rows = [event(1, "SAVED", settings=settings(shared=False)), event(2, "CHECK_DELETE", version=2, session_id="q")]
    d = run(spark, rows)[-1]
    assert (d["type"], d["aggregate_id"], d["user_id"], d["session_id"], d["version"]) == \
        ("DELETE_CHECKED", "a", "u0", "q", 2)
    rows = [event(1, "SAVED", settings=settings(shared=True)), event(2, "CHECK_DELETE")]
    d = run(spark, rows)[-1]
    assert d["type"] == "CHECK_DELETE_FAILED" and d["exception_type"] == "DELETE_SETTINGS_NOT_ALLOWED"


def test_delete_relay_and_cancel(spark):
    relayed = delete_relay(log_df(spark, [event(1, "DELETE_CONFIRMED"), event(2, "DELETE_CHECKED")])).collect()
    assert sorted((r["seq"], r["type"]) for r in relayed) == [(1, "DELETED"), (2, "DELETE")]
    rows = [event(1, "SAVED", settings=settings()), event(2, "DELETE_FAILED", exception_type="E")]
    assert run(spark, rows)[-1]["type"] == "DELETE_CANCELLED"


def test_clone_across_keys(spark, chunk):
    rows = [event(1, "SAVED", key="A", settings=settings(id="A", name="src", shared=True, user_id="u0")),
            event(2, "CLONE", key="B", user_id="u7", persistence=persistence(id="B", settings_id="A"))]
    d = [x for x in run(spark, rows, chunk) if x["seq"] == 2][0]
    s = d["settings"]
    assert d["type"] == "SAVE" and (s["id"], s["name"], s["shared"], s["user_id"], s["accessed"]) == \
        ("B", None, False, "u7", None)
    assert s["inserted"] == s["updated"] == d["date"]


def test_clone_without_source(spark):
    [d] = run(spark, [event(1, "CLONE", key="B", persistence=persistence(id="B", settings_id="notExists"))])
    assert d["type"] == "SAVE_FAILED" and d["exception_type"] == "SETTINGS_TO_CLONE_NOT_FOUND_EXCEPTION"


def test_accessed_date(spark):
    as_of = F.lit(T0).cast("timestamp") + F.expr("INTERVAL 1 DAY")
    rows = [event(1, "SELECTED", user_id="owner", settings=settings()),
            event(2, "UPDATE_ACCESSED_DATE", user_id="caller", version=2)]
    d = [r.asDict(recursive=True) for r in derive(log_df(spark, rows), ["accessed_request"], as_of=as_of,
                                                  chunk=0).collect()][0]
    assert d["type"] == "SAVE" and d["user_id"] == "owner" and d["version"] == 2
    assert d["settings"]["accessed"].date().isoformat() == "2024-01-02"


def test_rollback(spark):
    rows = [event(1, "SAVE"), event(2, "PREPARE_ROLLBACK", fail_event_type="SAVE")]
    d = run(spark, rows)[-1]
    assert d["type"] == "ROLLBACK" and d["last_snapshot_item"] is None and d["fail_event_type"] == "SAVE"
    rows = [event(1, "SAVED", settings=settings(name="good")), event(2, "SAVE"),
            event(3, "PREPARE_ROLLBACK", fail_event_type="SAVE")]
    d = run(spark, rows)[-1]
    assert d["last_snapshot_item"]["name"] == "good"


def test_table_rows_never_refire(spark):
    # a snapshot after the trigger is not seen by it (strict seq order)
    rows = [event(1, "PARTIAL_DESELECT", selection_req=selection_req()), event(2, "SELECTED", settings=settings())]
    assert run(spark, rows) == []


def test_keys_are_independent(spark):
    rows = [event(1, "SELECTED", key="A", settings=settings(id="A")),
            event(2, "PARTIAL_DESELECT", key="B", selection_req=selection_req(id="B"))]
    assert run(spark, rows) == []
