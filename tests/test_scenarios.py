"""End-to-end compensation scenarios: a command without confirmation times
out and is rolled back; a command on a locked item rolls the lock back."""


from pyspark.sql import functions as F

from eventfold.operators.decisions import decide, stuck_rollback
from eventfold.operators.derive import derive_once
from eventfold.operators.outcomes import command_outcome, command_timeout
from eventfold.operators.state import latest_state
from eventfold.streaming.jobs import start_command_events_sink
from eventfold.sources.log import StreamPolicy
from eventfold.schema import COMMANDS
from helpers import command, commands_df, event, log_df, selection_req, settings

HOUR = 3600 * 1000


def test_timeout_then_rollback(spark):
    log = [event(1, "SAVED", settings=settings(name="kept")),
           event(2, "PARTIAL_SELECT", session_id="s", selection_req=selection_req())]
    df = log_df(spark, log)
    out = command_outcome(df, F.col("type") == "PARTIAL_SELECT", HOUR, chunk=0)
    [rb] = command_timeout(out).collect()
    assert (rb["error_type"], rb["rollback_type"], rb["fail_event_type"]) == \
        ("ConfirmationTimeout", "PREPARE_ROLLBACK", "PARTIAL_SELECT")
    # the compensating event enters the log and the rollback rule restores the snapshot
    prep = event(3, "PREPARE_ROLLBACK", fail_event_type=rb["fail_event_type"])
    [d] = [r for r in derive_once(log_df(spark, [log[0], prep]), chunk=0).collect() if r["seq"] == 3]
    assert d["type"] == "ROLLBACK" and d["last_snapshot_item"]["name"] == "kept"
    assert d["fail_event_type"] == "PARTIAL_SELECT"


def test_locked_command_rolls_back(spark):
    state = [event(1, "SAVED", settings=settings(name="good")),
             event(2, "ROLLBACK_FAILED", fail_event_type="SAVE", minutes=10)]
    cmds = commands_df(spark, [command(1, "save", "a", minutes=20)])
    d = decide(cmds, latest_state(log_df(spark, state)))
    assert d.first()["error_type"] == "ItemLocked"
    [rb] = stuck_rollback(d, timeout_ms=HOUR).collect()
    assert (rb["type"], rb["fail_event_type"]) == ("PREPARE_ROLLBACK", "SAVE")


def test_command_events_stream(spark, tmp_path):
    src, ckpt = str(tmp_path / "cmds"), str(tmp_path / "ckpt")
    state = latest_state(log_df(spark, [event(1, "SAVED", version=2, settings=settings())]))
    cmds = [command(1, "update", "a"), command(2, "delete", "zz"), command(3, "select", "new")]
    commands_df(spark, cmds).write.parquet(src)
    stream = spark.readStream.schema(COMMANDS).parquet(src)
    q = start_command_events_sink(stream, state, None, fmt="memory", policy=StreamPolicy(checkpoint=ckpt),
                                  name="cmd_events")
    q.processAllAvailable()
    q.stop()
    got = sorted((r["seq"], r["aggregate_id"], r["type"], r["version"]) for r in spark.table("cmd_events").collect())
    assert got == [(1, "a", "PARTIAL_SAVE", 3), (3, "new", "PARTIAL_SELECT", 1)]


def test_rollback_after_rollback_failure_keeps_inner_type(spark):
    # SAVE, then a failed rollback of it that carries SAVE_FAILED, then a command hits the lock
    state = [event(1, "SAVE", version=1), event(2, "ROLLBACK_FAILED", fail_event_type="SAVE_FAILED", minutes=5)]
    d = decide(commands_df(spark, [command(1, "update", "a", minutes=10)]), latest_state(log_df(spark, state)))
    [prep] = stuck_rollback(d, timeout_ms=HOUR).collect()
    assert prep["fail_event_type"] == "SAVE_FAILED"
    log = state + [event(3, "PREPARE_ROLLBACK", fail_event_type=prep["fail_event_type"])]
    [rb] = [r for r in derive_once(log_df(spark, log), chunk=0).collect() if r["seq"] == 3]
    assert (rb["type"], rb["fail_event_type"], rb["last_snapshot_item"]) == ("ROLLBACK", "SAVE_FAILED", None)
