"""Plan shape on a stored log: pushdown, pruning, exchanges, no cartesian joins;
and results that do not depend on input order or on a hot key."""

import contextlib
import io
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from eventfold.operators.derive import derive_once
from eventfold.operators.fold import fold_history
from eventfold.operators.state import filter_type, latest_state
from eventfold.plans.reports import flatten_events
from eventfold.sources.fixtures import lifecycle_log
from eventfold.sources.log import read_event_log

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def stored(spark):
    path = tempfile.mkdtemp(prefix="run-log-", dir="/tmp") + "/log"
    lifecycle_log(spark, SF).write.parquet(path)
    return read_event_log(spark, path)


def test_type_filter_reaches_the_scan(spark, stored):
    p = plan(filter_type(stored, "PARTIAL_SELECT"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(type,PARTIAL_SELECT\)", p), p
    p = plan(derive_once(stored))
    assert re.search(r"PushedFilters: \[[^\]]*In\(type,", p), p


def test_fold_reads_only_the_columns_it_needs(spark, stored):
    p = plan(fold_history(stored))
    schemas = re.findall(r"ReadSchema: (struct<.*>)", p)
    assert schemas and all("selection_req" not in s and "persistence" not in s and "session_id" not in s
                           for s in schemas), schemas


def test_derive_once_has_no_cartesian_or_nested_loop_join(spark, stored):
    p = plan(derive_once(stored))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    # one keyed pass: the log is shuffled by (lookup key, chunk) for all rules
    big = re.findall(r"hashpartitioning\((\w+)#\d+L?, _asof_chunk", p)
    assert sorted(set(big)) == ["_k"], big


def test_latest_state_uses_a_partial_aggregate(spark, stored):
    p = plan(latest_state(stored))
    assert "partial_max_by" in p


def test_input_order_does_not_matter(spark, stored):
    a = flatten_events(derive_once(stored)).collect()
    b = flatten_events(derive_once(stored.repartition(7).orderBy(F.rand(3)))).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_hot_key_same_result_any_chunk(spark, stored):
    # fold every third row onto one key: that key holds about a third of the log
    hot = stored.withColumn("aggregate_id", F.when(F.col("seq") % 3 == 0, F.lit("HOT"))
                            .otherwise(F.col("aggregate_id")))
    a = sorted(map(tuple, flatten_events(derive_once(hot, chunk=0)).collect()))
    b = sorted(map(tuple, flatten_events(derive_once(hot, chunk=8)).collect()))
    assert a == b and len(a) > 0


def test_hot_key_fold_and_outcome(spark, stored):
    from eventfold.operators.outcomes import command_outcome
    from eventfold.sources.fixtures import outcome_log

    hot = stored.withColumn("aggregate_id", F.when(F.col("seq") % 3 == 0, F.lit("HOT"))
                            .otherwise(F.col("aggregate_id")))
    a = sorted(map(tuple, fold_history(hot, chunk=0).drop("settings").collect()))
    b = sorted(map(tuple, fold_history(hot, chunk=16).drop("settings").collect()))
    assert a == b and len(a) > 1
    ev = outcome_log(spark, SF).withColumn(
        "session_id", F.when(F.col("seq") % 3 == 0, F.lit("HOT")).otherwise(F.col("session_id")))
    cmd = F.col("type") == "COMMAND"
    a = sorted(map(tuple, command_outcome(ev, cmd, 3600 * 1000, chunk=0).collect()))
    b = sorted(map(tuple, command_outcome(ev, cmd, 3600 * 1000, chunk=16).collect()))
    assert a == b and len(a) > 10


def test_tasks_that_widen_rows_grow_with_the_table(spark, monkeypatch):
    """The narrow rows of the driver's events are dealt to more tasks as the table grows; the state is computed once."""
    from eventfold.plans.catalog import QUERIES
    from eventfold.sources import fixtures

    monkeypatch.setattr(fixtures, "TASK_ROWS", 50)
    events = fixtures.read_table(spark, "/root/testdata/sf0.001", "events")
    assert fixtures._with_k(events, "event_id").rdd.getNumPartitions() == 20
    plan = QUERIES["closed_log_state"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
