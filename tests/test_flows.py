"""Delete markers, running totals, references that come and go, changing related items, mergeable folds, alerts of every kind."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from eventfold.operators.asof import running_totals
from eventfold.operators.fold import fold_families, fold_stretch, folded, merge_folds
from eventfold.operators.references import enrich_changing, live_reference_check, reference_changes, valid_runs
from eventfold.operators.state import tombstone_tables
from eventfold.plans.catalog import QUERIES
from eventfold.sources.fixtures import handler_log, history_log, tombstone_log
from test_closure import as_rows, flat

SF = "/root/testdata/sf0.001"


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_tables_with_delete_markers(spark):
    log = spark.createDataFrame([(1, "a", "x", False), (2, "a", "y", True), (1, "b", "x", True), (2, "b", "y", False), (1, "c", "x", True),
                                 (5, None, "z", False), (1, "d", "x", None), (3, "a", "w", True)], "seq long, id string, v string, gone boolean")
    t = tombstone_tables(log, F.col("gone"), key="id")
    assert rows_of(t, "id", "table.v", "store.v") == [("a", "x", None), ("b", "y", "y"), ("d", "x", "x")]
    assert tombstone_tables(log.limit(0), F.col("gone"), key="id").count() == 0
    got = QUERIES["tombstone_tables"](spark, "/root/testdata/sf0.01").collect()
    assert any(r["store_seq"] is None for r in got) and any(r["store_seq"] is not None for r in got)


@pytest.mark.parametrize("semantics", ["delete", "ignore"])
@pytest.mark.parametrize("batches", [1, 4])
def test_stream_table_equals_batch(spark, semantics, batches):
    from eventfold.streaming.table_state import read_table, stream_table

    log, gone = tombstone_log(spark, SF)
    flat_log = log.select("seq", "aggregate_id", "type", gone.alias("gone"))
    src = tempfile.mkdtemp(prefix="run-src-", dir="/tmp")
    for i in range(batches):
        flat_log.where(F.pmod(F.xxhash64("seq"), F.lit(batches)) == i).coalesce(1).write.parquet(f"{src}/b{i}")
    stream = spark.readStream.schema(flat_log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    changes = stream_table(stream, F.col("gone"), F.col("type"), semantics)
    name = f"changes_{semantics}_{batches}"
    ckpt = tempfile.mkdtemp(prefix="run-ckpt-", dir="/tmp")
    q = (changes.writeStream.format("memory").queryName(name).outputMode("update")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    last = spark.table(name).groupBy("key").agg(F.max_by(F.struct("present", "at", "payload"), "at").alias("l"))
    got = rows_of(last.where("l.present"), "key", "l.at", "l.payload")
    t = tombstone_tables(flat_log, F.col("gone"))
    side = "store" if semantics == "delete" else "table"
    assert got == rows_of(t.where(F.col(side).isNotNull()), "aggregate_id", f"{side}.seq", f"{side}.type")
    # the same table from the query's checkpoint, whole and for wanted keys, after the last and after each batch
    assert rows_of(read_table(spark, ckpt), "key", "at", "payload") == got
    wanted = [got[0][0], got[-1][0], "nobody"]
    assert rows_of(read_table(spark, ckpt, wanted), "key", "at", "payload") == [r for r in got if r[0] in wanted]
    for b in range(batches):
        seen = spark.table(name)  # changes up to a batch: those of the files read by then are at most as new
        part = read_table(spark, ckpt, batch_id=b)
        assert part.join(seen, ["key", "at"], "left_anti").count() == 0 and part.count() <= flat_log.select("aggregate_id").distinct().count()


@pytest.mark.parametrize("chunk", [0, 1, 7, 1 << 20])
def test_running_totals_against_brute_force(spark, chunk):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), i, rng.randint(-3, 3), rng.randint(0, 1)) for i in rng.sample(range(200), 120)]
    rows = [(k, i, rng.choice([d, None]), r) for k, i, d, r in rows]
    df = spark.createDataFrame(rows, "k string, seq long, d long, r int")
    got = rows_of(running_totals(df, "k", "seq", {"t": F.col("d"), "n": F.lit(1)}, chunk=chunk), "k", "seq", "t", "n")
    want = [(k, i, None if k is None else sum(d or 0 for j, s, d, _ in rows if j == k and s < i),
             None if k is None else sum(1 for j, s, _, _ in rows if j == k and s < i)) for k, i, _, _ in rows]
    assert got == sorted(want, key=repr)


def test_references_come_and_go(spark):
    refs = spark.createDataFrame([(1, "r", 7), (3, "s", 7), (5, "r", 8), (6, "s", 7), (8, "s", None), (9, None, 7), (9, "t", None)],
                                 "seq long, referrer string, item long")
    changes = reference_changes(refs, "referrer", "item", "seq")
    assert rows_of(changes, "seq", "item", "delta") == [(1, 7, 1), (3, 7, 1), (5, 7, -1), (5, 8, 1), (8, 7, -1)]
    asked = spark.createDataFrame([(1, 7), (2, 7), (4, 7), (8, 7), (9, 7), (10, 8), (10, 99), (10, None)], "seq long, item long")
    got = live_reference_check(asked, "item", changes, chunk=3)
    assert rows_of(got, "seq", "item", "references", "decision") == sorted([
        (1, 7, 0, "ALLOWED"), (2, 7, 1, "REFUSED"), (4, 7, 2, "REFUSED"), (8, 7, 1, "REFUSED"), (9, 7, 0, "ALLOWED"), (10, 8, 1, "REFUSED"),
        (10, 99, 0, "ALLOWED"), (10, None, 0, "ALLOWED")], key=repr)
    assert {r["decision"] for r in QUERIES["live_references"](spark, "/root/testdata/sf0.01").collect()} == {"ALLOWED", "REFUSED"}


def test_related_item_changes_between_two_events(spark):
    versions = spark.createDataFrame([(1, "p", 10, None), (4, "p", 10, None), (6, "p", 11, 2), (2, None, 5, 5), (7, "p", None, None)],
                                     "seq long, item string, a int, b int")
    assert rows_of(valid_runs(versions, "item", "seq", ["a", "b"]), "seq", "a", "b") == [(1, 10, None), (6, 11, 2), (7, None, None)]
    events = spark.createDataFrame([(1, "p"), (2, "p"), (5, "p"), (7, "p"), (8, "p"), (8, "q"), (9, None)], "seq long, fk string")
    for chunk in (0, 2):
        got = enrich_changing(events, versions, "fk", "item", "seq", ["a", "b"], chunk=chunk)
        assert rows_of(got, "seq", "fk", "a", "b") == sorted([(1, "p", None, None), (2, "p", 10, None), (5, "p", 10, None), (7, "p", 11, 2),
                                                              (8, "p", None, None), (8, "q", None, None), (9, None, None, None)], key=repr)


@pytest.mark.parametrize("cuts,chunk", [([], 0), ([400], 16), ([1, 2, 333, 700, 990], 64), ([500, 500, 5000], 1 << 20)])
def test_fold_resumes_at_any_cut(spark, cuts, chunk):
    log = history_log(spark, SF).withColumn("aggregate_id", F.when(F.col("seq") % 3 == 0, F.lit("HOT")).otherwise(F.col("aggregate_id")))
    edges = [-1, *cuts, 10**9]
    state = fold_stretch(log.where("seq < -5"), chunk)
    for lo, hi in zip(edges, edges[1:]):
        state = merge_folds(state, fold_stretch(log.where((F.col("seq") >= lo) & (F.col("seq") < hi)), chunk))
    assert flat(as_rows(folded(state))) == flat(as_rows(fold_families(log, chunk=0)))


def test_every_branch_has_rows(spark):
    sf = "/root/testdata/sf0.01"
    assert {r["kind"] for r in QUERIES["alerts"](spark, sf).select("kind").distinct().collect()} == {
        "SESSION_MISMATCH", "ROLLBACK_FAILED", "CONFIRMATION_TIMEOUT", "ITEM_LOCKED"}
    assert {r["action"] for r in QUERIES["event_router"](spark, sf).select("action").distinct().collect()} == {
        "RESOLVE_SUCCESS", "RESOLVE_ERROR", "PUBLISH_DELETE", "PUBLISH_DELETED", "ALERT"}
    types = {r["type"] for r in handler_log(spark, sf).select("type").distinct().collect()}
    assert {"DELETED", "ROLLBACK_FAILED", "SAVE_CANCELLED", "DELETE_CANCELLED"} <= types


def test_quarantine_is_a_second_sink_of_the_stream(spark):
    """The query dies between the two writes, and after both but before the commit: no row is lost or doubled."""
    from pyspark.sql import types as T

    from eventfold.sources.log import StreamPolicy
    from eventfold.streaming.jobs import start_split_sink

    at = tempfile.mkdtemp(prefix="run-split-", dir="/tmp")
    rows = [(i, '{"k": %d}' % i if i % 3 else ("{cut" if i % 2 else None)) for i in range(60)]
    for b in range(3):
        spark.createDataFrame(rows[20 * b:20 * b + 20], "id long, props string").coalesce(1).write.parquet(f"{at}/in/b{b}")
    left = {("good", 1), ("quarantine", 2)}

    def fail_once(kind, batch):
        if (kind, batch) in left:
            left.discard((kind, batch))
            raise RuntimeError("killed")

    for _ in range(3):
        stream = (spark.readStream.schema("id long, props string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
                  .parquet(f"{at}/in"))
        q = start_split_sink(stream, "props", T.StructType([T.StructField("k", T.IntegerType())]), f"{at}/good", f"{at}/bad",
                             StreamPolicy(checkpoint=f"{at}/ckpt"), wrote=fail_once)
        try:
            q.processAllAvailable()
        except Exception:
            pass
        q.stop()
    assert not left
    assert rows_of(spark.read.parquet(f"{at}/good"), "id", "k") == sorted(((i, i) for i, _ in rows if i % 3), key=repr)
    assert rows_of(spark.read.parquet(f"{at}/bad"), "id", "props") == sorted(((i, t) for i, t in rows if i % 3 == 0), key=repr)


def test_stream_from_a_starting_position(spark):
    from eventfold.sources.log import StreamPolicy, stream_event_log
    from helpers import event, log_df

    at = tempfile.mkdtemp(prefix="run-from-", dir="/tmp")
    log_df(spark, [event(i, "SAVE") for i in range(10)]).withColumn("hop", F.lit(0)).write.parquet(f"{at}/log")
    q = (stream_event_log(spark, f"{at}/log", StreamPolicy(from_seq=7)).writeStream.format("memory").queryName("from_seven")
         .trigger(availableNow=True).option("checkpointLocation", f"{at}/ckpt").start())
    q.awaitTermination()
    assert [r[0] for r in spark.sql("select seq from from_seven order by seq").collect()] == [7, 8, 9]
