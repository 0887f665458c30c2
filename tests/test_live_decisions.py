"""Decisions on a stream against live state equal the point-in-time decisions of the batch."""

import json
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventfold.operators.decisions import decide_as_of
from eventfold.sources.fixtures import decision_log
from eventfold.streaming.live_decisions import CommandProcessor, stream_decide

SF = "/root/testdata/sf0.001"
COLUMNS = ("cmd_seq", "command", "target_id", "source_id", "decision", "out_type", "version", "error_type", "error_args")


def rows(df):
    return sorted(((json.dumps([r[c] for c in COLUMNS], default=str), str(r["_st"]), str(r["_src"]))) for r in df.collect())


@pytest.fixture(scope="module")
def inputs(spark):
    log, cmds = decision_log(spark, SF, interleaved=True)
    # one item holds a third of the rows; some commands ask nothing
    hot = log.agg(F.min("aggregate_id")).first()[0]
    log = log.withColumn("aggregate_id", F.when(F.col("seq") % 3 == 0, F.lit(hot)).otherwise(F.col("aggregate_id")))
    cmds = cmds.withColumn("target_id", F.when(F.col("cmd_seq") % 50 != 7, F.when(F.col("cmd_seq") % 3 == 0, F.lit(hot)).otherwise(F.col("target_id"))))
    return log.cache(), cmds.cache()


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_stream_equals_point_in_time(spark, inputs, cuts):
    log, cmds = inputs
    at, ckpt = tempfile.mkdtemp(prefix="run-src-", dir="/tmp"), tempfile.mkdtemp(prefix="run-ckpt-", dir="/tmp")
    lo, hi = log.select("seq").union(cmds.select("cmd_seq")).agg(F.min("seq"), F.max("seq")).first()
    step = (hi - lo) // cuts + 1
    for i in range(cuts):
        for name, df, order in (("log", log, "seq"), ("cmds", cmds, "cmd_seq")):
            df.where((F.col(order) >= lo + i * step) & (F.col(order) < lo + (i + 1) * step)).coalesce(1).write.mode("append").parquet(f"{at}/{name}")
    read = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/{name}")
    q = (stream_decide(read("cmds", cmds), read("log", log)).writeStream.format("memory").queryName(f"live_{cuts}")
         .outputMode("append").option("checkpointLocation", ckpt).start())
    q.processAllAvailable()
    q.stop()
    got, want = rows(spark.table(f"live_{cuts}")), rows(decide_as_of(cmds, log))
    assert len(want) == cmds.count() and got == want


class _List:
    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class _Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, name, schema):
        return _List()

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_answers_meet_across_batches_or_time_out():
    handle, p = _Handle(), CommandProcessor(500)
    p.init(handle)
    piece = lambda *r: iter([pd.DataFrame(list(r), columns=["role", "asked", "seen"])])
    give = lambda it: [tuple(r) for f in it for r in f.itertuples(index=False)]
    assert give(p.handleInputRows(("c",), piece((1, 2, "t"), (1, 2, "t")), handle)) == [] and handle.timers == [1500]
    assert give(p.handleInputRows(("c",), piece((2, 2, None)), handle)) == [("c", "t", None, True)]
    assert give(p.handleExpiredTimer(("c",), handle, None)) == [("c", "t", None, False)] and p.waiting.rows == []
    assert give(p.handleInputRows(("d",), piece((0, 0, None), (1, 1, "x")), handle)) == [("d", None, None, True), ("d", "x", None, True)]
