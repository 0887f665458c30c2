"""OP-46b closure from external rows only."""

from pyspark.sql import functions as F

from eventfold.operators.closure import lifecycle_closure
from eventfold.operators.derive import derive_once
from helpers import event, log_df, persistence, selection_req, settings


def closed(spark, rows, **kw):
    out = lifecycle_closure(log_df(spark, rows), chunk=kw.pop("chunk", 0), **kw)
    return [(r["seq"], r["hop"], r["aggregate_id"], r["type"]) for r in out.orderBy("seq", "hop", "aggregate_id").collect()]


def test_failed_request_is_cancelled(spark):
    rows = [event(1, "SELECTED", settings=settings(name="named")),
            event(2, "PARTIAL_SELECT", selection_req=selection_req())]
    assert closed(spark, rows) == [(1, 0, "a", "SELECTED"), (2, 0, "a", "PARTIAL_SELECT"),
                                   (2, 1, "a", "SELECT_FAILED"), (2, 2, "a", "SELECT_CANCELLED")]


def test_derived_request_is_confirmed_and_becomes_snapshot(spark):
    rows = [event(1, "PARTIAL_SELECT", session_id="x", selection_req=selection_req(selection=("1",))),
            event(2, "SELECT_CONFIRMED", session_id="x"),
            event(3, "PARTIAL_SELECT", session_id="x", selection_req=selection_req(selection=("2",)))]
    out = lifecycle_closure(log_df(spark, rows), chunk=0)
    got = {(r["seq"], r["hop"]): r for r in out.collect()}
    assert got[(1, 1)]["type"] == "SELECT"
    assert got[(2, 1)]["type"] == "SELECTED"
    # the derived SELECTED is the snapshot the later request unions with
    assert got[(3, 1)]["type"] == "SELECT" and got[(3, 1)]["settings"]["selection"] == ["2", "1"]


def test_clone_chain_across_keys(spark):
    rows = [event(1, "CLONE", key="B", persistence=persistence(id="B", settings_id="missing"))]
    assert closed(spark, rows) == [(1, 0, "B", "CLONE"), (1, 1, "B", "SAVE_FAILED"), (1, 2, "B", "SAVE_CANCELLED")]


def test_delete_relay_in_closure(spark):
    rows = [event(1, "SAVED", settings=settings()), event(2, "CHECK_DELETE")]
    assert closed(spark, rows)[2:] == [(2, 1, "a", "DELETE_CHECKED"), (2, 2, "a", "DELETE")]


def test_closure_is_a_fixpoint_of_derive_once(spark):
    rows = [event(1, "PARTIAL_SELECT", session_id="x", selection_req=selection_req()),
            event(2, "SELECT_CONFIRMED", session_id="x"),
            event(3, "PARTIAL_DESELECT", selection_req=selection_req(selection=("2",))),
            event(4, "DESELECT_FAILED", exception_type="E"),
            event(5, "PARTIAL_SAVE", key="b", persistence=persistence(id="b", settings_id="a"))]
    full = lifecycle_closure(log_df(spark, rows), chunk=2)
    again = derive_once(full.drop("hop"), chunk=0).select("seq", "aggregate_id", "type")
    have = full.where("hop > 0").select("seq", "aggregate_id", "type")
    # every event derived from a closed log is already in it
    assert again.exceptAll(have).count() == 0
    assert full.where(F.col("hop") > 0).count() > 0


def flat(rows):
    """Whole rows, comparable: nested values as sorted text."""
    def value(v):
        return sorted((k, value(x)) for k, x in v.items()) if isinstance(v, dict) else v
    return sorted(repr(sorted((k, value(v)) for k, v in r.items())) for r in rows)


def as_rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_replay_equals_the_set_based_fixpoint_on_all_columns(spark):
    """Two independent engines: the rules as Columns in rounds, and the replay, in one piece and in chunks."""
    from eventfold.operators.closure import RELAY_RULES
    from eventfold.operators.derive import RULES
    from eventfold.sources.fixtures import lifecycle_log

    log = lifecycle_log(spark, "/root/testdata/sf0.001")
    log = log.withColumn("arguments", F.when(F.col("exception_type").isNotNull(), F.create_map(F.lit("why"), F.col("exception_type"))))
    want = flat(as_rows(lifecycle_closure(log, list(RULES) + RELAY_RULES, chunk=64)))
    rounds = []
    assert flat(as_rows(lifecycle_closure(log, chunk=64, rounds=rounds))) == want
    assert flat(as_rows(lifecycle_closure(log, chunk=64, chunk_rows=5, rounds=rounds))) == want
    assert len(want) > log.count() and max(rounds) <= 8


def test_hot_key_in_chunks(spark):
    """A third of the log on one key, replayed in many chunks; null keys and null reads among the rows."""
    from eventfold.sources.fixtures import lifecycle_log

    log = lifecycle_log(spark, "/root/testdata/sf0.001")
    log = log.withColumn("aggregate_id", F.when(F.col("seq") % 3 == 0, F.lit("HOT")).when(F.col("seq") % 31 == 0, F.lit(None)).otherwise(F.col("aggregate_id")))
    log = log.withColumn("persistence", F.when(F.col("seq") % 7 == 0, F.col("persistence").withField("settings_id", F.lit("HOT")))
                         .otherwise(F.col("persistence")))
    from eventfold.operators.closure import RELAY_RULES
    from eventfold.operators.derive import RULES
    want = flat(as_rows(lifecycle_closure(log, chunk_rows=10**9)))
    assert flat(as_rows(lifecycle_closure(log, chunk_rows=16))) == want
    assert flat(as_rows(lifecycle_closure(log, list(RULES) + RELAY_RULES))) == want


def cycles(n, key="a", start=1):
    rows = []
    for i in range(n):
        rows += [event(start + 2 * i, "PARTIAL_SELECT", key=key, session_id=f"s{i}", selection_req=selection_req(selection=(str(i), str(i % 7)))),
                 event(start + 2 * i + 1, "SELECT_CONFIRMED", key=key, session_id=f"s{i}")]
    return rows


def test_rounds_do_not_grow_with_history(spark):
    """A thousand select and confirm cycles on one key close in as many rounds as three, in one piece or in forty chunks."""
    counts = []
    for n, chunk_rows in ((3, 10**9), (1000, 10**9), (1000, 50)):
        rounds = []
        out = lifecycle_closure(log_df(spark, cycles(n)), chunk=0, chunk_rows=chunk_rows, rounds=rounds).collect()
        last = max((r for r in out if r["type"] == "SELECTED"), key=lambda r: r["seq"])
        assert len(out) == 4 * n and set(last["settings"]["selection"]) == {str(i) for i in range(n)} | {str(i) for i in range(min(n, 7))}
        counts.append(rounds)
    assert counts == [counts[0]] * 3


def test_rounds_follow_the_depth_of_reads(spark):
    """Each key is saved from the one before it: a chain of d reads takes d + 1 rounds, however long the histories are."""
    def chain(depth, n):
        rows = cycles(n, key="k0")
        for d in range(1, depth + 1):
            at = 10_000 * d
            rows += [event(at, "PARTIAL_SAVE", key=f"k{d}", session_id="x", persistence=persistence(id=f"k{d}", settings_id=f"k{d - 1}")),
                     event(at + 1, "SAVE_CONFIRMED", key=f"k{d}", session_id="x")]
        return rows
    seen = []
    for depth, n in ((1, 2), (1, 100), (4, 2), (4, 100)):
        rounds = []
        out = lifecycle_closure(log_df(spark, chain(depth, n)), chunk=0, rounds=rounds).collect()
        saved = {r["aggregate_id"]: len(r["settings"]["selection"]) for r in out if r["type"] == "SAVED"}
        assert saved == {f"k{d}": n if n > 7 else 2 for d in range(1, depth + 1)}
        seen.append(rounds[0])
    assert seen == [2, 2, 5, 5]


def test_transfers_compose(spark):
    """Random histories: a chunk's transfer on the state before it gives the state after it, wherever the cuts are."""
    import random

    from eventfold.operators.replay import EMPTY, carry_through, control, replay, transfer
    rng = random.Random(4)
    kinds = ["PARTIAL_SELECT", "SELECT_CONFIRMED", "PARTIAL_DESELECT", "DESELECT_CONFIRMED", "PARTIAL_CLEAR_SELECTION",
             "CLEAR_SELECTION_CONFIRMED", "UPDATE_ACCESSED_DATE", "SAVE_CONFIRMED", "SELECT_FAILED", "CHECK_DELETE", "PREPARE_ROLLBACK", "SELECTED", "SAVED"]
    for case in range(150):
        rows = []
        for i in range(rng.randint(1, 40)):
            t = rng.choice(kinds[:9] * 3 + kinds)
            sel = tuple(rng.choice("abcdef") for _ in range(rng.randint(0, 4)))
            made = log_row(event(i, t, session_id=rng.choice(["x", "y"]), selection_req=selection_req(selection=sel), settings=settings(
                selection=sel, name=rng.choice([None, None, "n"])) if t in ("SELECTED", "SAVED") else None))
            rows.append({**made, "_src": None, "_at": i})
        cuts = sorted({0, len(rows), *(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 6)))})
        pieces = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        assumed = [control(EMPTY)] * len(pieces)
        for turn in range(len(pieces) + 1):
            transfers = [transfer(iter(p), a) for p, a in zip(pieces, assumed)]
            carried = carry_through(transfers)
            again = [control(s) for s, _ in carried]
            if again == assumed:
                break
            assumed = again
        state = EMPTY
        for piece, (start, settled) in zip(pieces, carried):
            assert settled and start == state
            state = replay(iter(piece), state)


def log_row(e):
    from eventfold.schema import EVENT_COLUMNS
    return {c: e.get(c) for c in EVENT_COLUMNS}


def test_closure_matches_sequential_model(spark):
    from brute_closure import closure as brute
    from eventfold.sources.fixtures import lifecycle_log

    log = lifecycle_log(spark, "/root/testdata/sf0.001")
    rows = [r.asDict(recursive=True) for r in log.collect()]

    def known(r):
        """Every column that the model holds."""
        r = {k: v for k, v in r.items() if k not in ("event_id", "arguments")}
        s = r["settings"]
        if r["hop"] and s is not None:  # the model has no dates in payloads
            r["settings"] = {k: v for k, v in s.items() if k not in ("inserted", "updated", "accessed")}
        item = r["last_snapshot_item"]
        r["last_snapshot_item"] = item and {k: v for k, v in item.items() if k not in ("inserted", "updated", "accessed")}
        return r
    want, got = flat(map(known, brute(rows))), flat(map(known, as_rows(lifecycle_closure(log, chunk=64))))
    assert len(want) > len(rows) and got == want


def test_rounds_handle_narrow_rows(spark, monkeypatch):
    """A replay hands over only the columns that derived rows fill, and items that are not long are looked up in one window, without chunks."""
    from eventfold.operators import closure
    from eventfold.sources.fixtures import lifecycle_log

    seen, stored, scan = [], closure.stored, closure.attach_last_before
    monkeypatch.setattr(closure, "stored", lambda df, label: seen.append((label, set(df.columns))) or stored(df, label))
    monkeypatch.setattr(closure, "attach_last_before", lambda *a, **kw: seen.append(("chunk", kw["chunk"])) or scan(*a, **kw))
    log, rounds = lifecycle_log(spark, "/root/testdata/sf0.001"), []
    out = closure.lifecycle_closure(log, rounds=rounds)
    made = [columns for label, columns in seen if label == "replayed"]
    assert len(made) == rounds[0] >= 2 and not any(c & {"selection_req", "persistence", "last_snapshot_item"} for c in made)
    assert {c for label, c in seen if label == "chunk"} == {0}
    assert out.where("type = 'ROLLBACK' and last_snapshot_item is not null").count() > 0
    assert out.where("type = 'ROLLBACK' and settings is not null").isEmpty()


def test_long_items_are_looked_up_in_chunks(spark):
    """An item that is long by its own rows, and one that is long by what reads it: beside the others, the same rows."""
    rows = cycles(40, key="hot") + [event(1000, "SAVED", key="read", settings=settings(id="read")), event(1500, "SAVED", key="read", settings=settings(id="read", name="later"))]
    for i in range(60):
        at = 1001 + 10 * i
        rows += [event(at, "PARTIAL_SAVE", key=f"k{i}", session_id="x", persistence=persistence(id=f"k{i}", settings_id=("read", "hot", "k0", None)[i % 4])),
                 event(at + 1, "SAVE_CONFIRMED", key=f"k{i}", session_id="x")]
    want = flat(as_rows(lifecycle_closure(log_df(spark, rows), chunk=0)))
    spark.conf.set("eventfold.asof.chunk", "16")
    try:
        assert flat(as_rows(lifecycle_closure(log_df(spark, rows), chunk_rows=10))) == want
    finally:
        spark.conf.unset("eventfold.asof.chunk")


def test_bulk_jobs_leave_the_session_as_it_was(spark):
    from eventfold.session import BULK_CONF

    key, own = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "777")
    try:
        before = {k: spark.conf.get(k) for k in BULK_CONF}
        lifecycle_closure(log_df(spark, cycles(3)), chunk=0).collect()
        assert {k: spark.conf.get(k) for k in BULK_CONF} == before and before[key] == "777"
    finally:
        spark.conf.set(key, own)
