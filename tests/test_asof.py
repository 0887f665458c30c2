"""The chunked as-of scan equals a brute-force nearest-row search."""

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from eventfold.operators.asof import attach_first_after, attach_last_before


def _brute(rows, forward):
    out = {}
    for seq, key, is_table, val in rows:
        cands = [(s, v) for s, k, t, v in rows if k == key and t and k is not None
                 and ((s > seq) if forward else (s < seq))]
        if not cands or key is None:
            out[seq] = None
        else:
            out[seq] = (min(cands) if forward else max(cands))[1]
    return out


@pytest.mark.parametrize("chunk", [0, 1, 3, 16, 1 << 20])
@pytest.mark.parametrize("forward", [False, True])
def test_matches_brute_force(spark, chunk, forward):
    rnd = random.Random(chunk * 2 + forward)
    rows = []
    for seq in range(400):
        # one hot key holding about a third of the rows, plus cold and null keys
        key = "hot" if rnd.random() < 0.35 else (None if rnd.random() < 0.03 else f"k{rnd.randrange(20)}")
        rows.append((seq * 3 + rnd.randrange(3), key, rnd.random() < 0.3, rnd.randrange(1000)))
    df = spark.createDataFrame(rows, "seq long, key string, is_table boolean, val int")
    fn = attach_first_after if forward else attach_last_before
    got = fn(df, "key", "seq", {"t": (F.col("is_table"), F.struct("val"))}, chunk=chunk)
    res = {r["seq"]: (r["t"]["val"] if r["t"] is not None else None) for r in got.collect()}
    assert res == _brute(rows, forward)
    assert got.count() == len(rows)


def test_several_tables_one_pass(spark):
    rows = [(1, "a", "X", 10), (2, "a", "Y", 20), (3, "a", "Z", 30), (4, "a", "X", 40), (5, "a", "Z", 50)]
    df = spark.createDataFrame(rows, "seq long, key string, type string, val int")
    got = attach_last_before(df, "key", "seq", {
        "x": (F.col("type") == "X", F.struct("val")),
        "y": (F.col("type") == "Y", F.struct("val"))}, chunk=2)
    res = {r["seq"]: (r["x"] and r["x"]["val"], r["y"] and r["y"]["val"]) for r in got.collect()}
    assert res == {1: (None, None), 2: (10, None), 3: (10, 20), 4: (10, 20), 5: (40, 20)}


@pytest.mark.parametrize("chunk", [0, 1, 5, 64])
@pytest.mark.parametrize("forward", [False, True])
def test_wanted_rows_only(spark, chunk, forward):
    rnd = random.Random(100 + chunk + forward)
    rows = []
    for seq in range(300):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(8)}"
        rows.append((seq * 5 + rnd.randrange(5), key, rnd.random() < 0.3, rnd.randrange(1000)))
    df = spark.createDataFrame(rows, "seq long, key string, is_table boolean, val int")
    fn = attach_first_after if forward else attach_last_before
    got = fn(df, "key", "seq", {"t": (F.col("is_table"), F.struct("val"))}, chunk=chunk,
             want=F.col("seq") % 2 == 0)
    brute = _brute(rows, forward)
    res = {r["seq"]: (r["t"]["val"] if r["t"] is not None else None) for r in got.collect()}
    assert res == {s: (v if s % 2 == 0 else None) for s, v in brute.items()}


@pytest.mark.parametrize("forward", [False, True])
def test_multi_level_summaries(spark, monkeypatch, forward):
    from eventfold.operators import asof
    monkeypatch.setattr(asof, "SUMMARY_FANOUT", 4)
    spark.conf.set(asof.LEVELS_CONF, "3")
    rnd = random.Random(11 + forward)
    rows = [(seq * 2 + rnd.randrange(2), "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(4)}",
             rnd.random() < 0.08, rnd.randrange(1000)) for seq in range(500)]
    df = spark.createDataFrame(rows, "seq long, key string, is_table boolean, val int")
    fn = attach_first_after if forward else attach_last_before
    try:
        got = fn(df, "key", "seq", {"t": (F.col("is_table"), F.struct("val"))}, chunk=2)
        res = {r["seq"]: (r["t"]["val"] if r["t"] is not None else None) for r in got.collect()}
    finally:
        spark.conf.unset(asof.LEVELS_CONF)
    assert res == _brute(rows, forward)


@pytest.mark.parametrize("chunk", [0, 5000])
def test_forward_scan_goes_once_through_a_key(spark, chunk):
    """No frame reaches from each row to its key's end: such a frame is read anew for every row."""
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("seq"), F.lit("hot").alias("key"), (F.col("id") % 997 == 5).alias("is_table"))
    got = attach_first_after(df, "key", "seq", {"t": (F.col("is_table"), F.struct("seq"))}, chunk=chunk)
    assert "unboundedfollowing" not in got._jdf.queryExecution().analyzed().toString().lower()
    found = [r.s for r in got.orderBy("seq").select(F.col("t.seq").alias("s")).collect()]
    places = list(range(5, n, 997))
    assert found == [places[bisect_right(places, s)] if s < places[-1] else None for s in range(n)]
