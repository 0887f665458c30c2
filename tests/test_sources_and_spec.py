"""Sources (declared schema, malformed split) and the generic lifecycle spec."""

import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.operators.references import Lookup, delete_reference_check, enrich_reference
from eventfold.plans.lifecycle import LifecycleSpec, build_lifecycle, partial_update
from eventfold.sources.log import read_event_log, read_snapshot_log, split_malformed
from helpers import event, log_df, settings


def test_split_malformed(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "{not json"), (3, None), (4, '{"k": 7}')],
                               "id long, props string")
    good, bad = split_malformed(df, "props", T.StructType([T.StructField("k", T.IntegerType())]))
    assert sorted((r["id"], r["k"]) for r in good.collect()) == [(1, 3), (4, 7)]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_read_log_with_declared_schema(spark):
    path = tempfile.mkdtemp(prefix="run-log-", dir="/tmp")
    log = log_df(spark, [event(1, "SAVED", settings=settings()), event(2, "SAVE")])
    log.write.mode("append").parquet(path + "/log")
    log.where("type = 'SAVED'").write.mode("append").parquet(path + "/log-snapshot")
    got = read_event_log(spark, path + "/log")
    assert got.drop("hop").schema == log.schema and {r.hop for r in got.collect()} == {0}
    assert read_snapshot_log(spark, path + "/log").count() == 1


def test_spec_callbacks_and_hooks(spark):
    rows = [event(1, "CREATE", session_id="x", settings=settings(name="draft")),
            event(2, "CREATE_CONFIRMED", session_id="x"),
            event(3, "SAVED", settings=settings(name="good")),
            event(4, "UPDATE_FAILED", exception_type="E"),
            event(5, "PREPARE_ROLLBACK", fail_event_type="UPDATE")]

    def created(req, as_of):  # a service's own callback: always accept, rename
        return {"type": F.lit("CREATED"), "settings": req["settings"].withField("name", F.lit("final"))}

    def tag(df):  # enrichment hook applied before the rules
        return df.withColumn("user_id", F.upper("user_id"))

    spec = LifecycleSpec(created=created, enrich_create=tag)
    out = {r["seq"]: r for r in build_lifecycle(log_df(spark, rows), spec, chunk=0).collect()}
    assert out[2]["type"] == "CREATED" and out[2]["settings"]["name"] == "final" and out[2]["user_id"] == "U0"
    assert out[4]["type"] == "UPDATE_CANCELLED" and out[4]["settings"]["name"] == "good"
    assert out[5]["type"] == "ROLLBACK" and out[5]["last_snapshot_item"]["name"] == "good"


def test_spec_with_its_own_requests_and_request_fields(spark):
    from eventfold.operators.derive import Rule

    rows = [event(1, "OPEN", version=7, user_id="ann", session_id="x", settings=settings(name="new")),
            event(2, "CREATE_CONFIRMED", session_id="x"),
            event(3, "APPROVE", version=9, user_id="bob", session_id="y", settings=settings(name="ok")),
            event(4, "APPROVE_CONFIRMED", session_id="y")]

    def by_requester(out_type):
        def build(req, at):
            return {"type": F.when(req.isNotNull(), F.lit(out_type)), "arguments": F.create_map(
                F.lit("by"), req["user_id"], F.lit("version"), req["version"].cast("string"))}
        return build

    spec = LifecycleSpec(created=by_requester("CREATED"), requests={"_req_create": "OPEN", "_req_update": "UPDATE", "_req_approve": "APPROVE"},
                         request_fields=("session_id", "settings", "user_id", "version"),
                         extra_rules=[Rule("approve_confirm", "APPROVE_CONFIRMED", "_req_approve", by_requester("APPROVED"))])
    out = {r["seq"]: (r["type"], r["arguments"]) for r in build_lifecycle(log_df(spark, rows), spec, chunk=0).collect()}
    assert out == {2: ("CREATED", {"by": "ann", "version": "7"}), 4: ("APPROVED", {"by": "bob", "version": "9"})}


def test_partial_update_merges_fields(spark):
    rows = [event(1, "SAVED", settings=settings(name="old", selection=("1",))),
            event(2, "UPDATE", session_id="x", settings=settings(name=None, selection=("2",))),
            event(3, "UPDATE_CONFIRMED", session_id="x")]
    [d] = partial_update(log_df(spark, rows), chunk=0).collect()
    assert d["type"] == "UPDATED" and d["settings"]["name"] == "old" and d["settings"]["selection"] == ["2"]


def test_enrich_and_reference_check(spark):
    ev = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id long, cust long")
    cust = spark.createDataFrame([(10, "ann", 1), (20, "bob", 2)], "c_id long, c_name string, c_nat int")
    nat = spark.createDataFrame([(1, "ES")], "n_id int, n_name string")
    out = enrich_reference(ev, [Lookup(cust, "cust", "c_id", ["c_name", "c_nat"]),
                                Lookup(nat, "c_nat", "n_id", ["n_name"])])
    got = {r["id"]: (r["c_name"], r["n_name"]) for r in out.collect()}
    assert got == {1: ("ann", "ES"), 2: ("bob", None), 3: (None, None)}
    req = spark.createDataFrame([(1,), (2,)], "item long")
    refs = spark.createDataFrame([(1,), (1,), (None,)], "ref long")
    chk = {r["item"]: (r["decision"], r["error_type"]) for r in
           delete_reference_check(req, "item", refs, "ref").collect()}
    assert chk == {1: ("REFUSED", "ItemReferenced"), 2: ("ALLOWED", None)}


def test_spec_delete_hook(spark):
    from eventfold.plans.lifecycle import referenced_delete_hook
    rows = [event(1, "DELETE", key="a"), event(2, "DELETE", key="b")]
    refs = spark.createDataFrame([("a",), ("a",)], "item_ref string")
    spec = LifecycleSpec(delete_check=referenced_delete_hook(refs, "item_ref", "vessel"))
    out = build_lifecycle(log_df(spark, rows), spec, chunk=0).collect()
    assert [(r["aggregate_id"], r["type"], r["exception_type"], r["arguments"]) for r in out] == \
        [("a", "DELETE_FAILED", "ItemReferenced", {"vessel": "a"})]
