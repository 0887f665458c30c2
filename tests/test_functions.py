"""Column functions against their plain-Python meaning, many random cases per job."""

import random

from pyspark.sql import functions as F

from eventfold.functions.predicates import author_differs, change_granted, deletable
from eventfold.functions.selection import sel_clear, sel_remove, sel_union


def _lists(rnd, n):
    out = []
    for _ in range(n):
        if rnd.random() < 0.1:
            out.append(None)
        else:
            out.append([str(rnd.randrange(6)) for _ in range(rnd.randrange(6))])
    return out


def test_selection_ops_match_python(spark):
    rnd = random.Random(7)
    a, b = _lists(rnd, 300), _lists(rnd, 300)
    df = spark.createDataFrame(list(zip(range(300), a, b)), "i int, new array<string>, old array<string>")
    got = {r["i"]: (r["u"], r["r"], r["c"]) for r in df.select(
        "i", sel_union(F.col("new"), F.col("old")).alias("u"), sel_remove(F.col("old"), F.col("new")).alias("r"),
        sel_clear().alias("c")).collect()}
    for i in range(300):
        new, old = a[i] or [], b[i] or []
        union = list(dict.fromkeys(new + old))          # insertion-ordered set, new items first
        removed = [x for x in old if x not in set(new)]  # removeAll keeps other repeats
        assert got[i] == (union, removed, []), (i, a[i], b[i], got[i])


def test_predicates_treat_nulls_as_refusal(spark):
    rows = [("s", "u", False, None, "s", "u", True),
            ("s", "u", None, None, "s", "u", False),     # unknown sharing: refused
            (None, "u", False, None, "s", "u", False),   # unknown service: refused
            ("s", "u", False, "n", "s", "u", False),
            ("s", None, False, None, "s", "u", False)]
    df = spark.createDataFrame(rows, "service string, user_id string, shared boolean, name string, "
                                     "r_service string, r_user string, want boolean")
    st = F.struct("service", "user_id", "shared", "name")
    rq = F.struct(F.col("r_service").alias("service"), F.col("r_user").alias("user_id"))
    for r in df.select(change_granted(st, rq).alias("g"), "want").collect():
        assert r["g"] == r["want"]
    d = df.select(deletable(st, F.col("r_user")).alias("d"), author_differs(F.col("user_id"), F.lit("x")).alias("a"))
    assert [(r["d"], r["a"]) for r in d.collect()] == \
        [(True, True), (False, True), (True, True), (True, True), (False, False)]
