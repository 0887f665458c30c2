"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for base spans (assignments, access keys, long hex) and
for candidates (long mixed tokens). The value of each span is hashed; the
hashes are counted over the whole corpus by distinct repositories and owners.
A value that many owners hold is a widely copied example; one that few owners
hold looks like a live credential. Live candidates become ``live`` spans; base
spans always stay and carry the same verdict in ``n_live`` and ``n_example``.

Positions come from the gaps between matches (``split``) and the matches
themselves, in code points; no Python runs on the executors. Guards that are
cheap and never wrong (a text without the keyword cannot match) keep most
texts off the expensive patterns.

A hash is first reduced to its distinct (owner, repository) pairs on the map
side, so a value copied into a third of the corpus costs a few rows per task;
the join that brings verdicts back is a plain equi-join, which adaptive
execution splits where one value is frequent.

Defined cases: null text is scanned as an empty one and gives a row without
spans; a null owner or repository is an owner or repository of its own; null
ids are kept; repeated rows are scanned and returned each; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = ("password", "passwd", "secret", "token")
ASSIGN = ("(" + "|".join(_either_case(k) for k in _KEYS) + "|" + _either_case("api") + "_?" + _either_case("key") + ")"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A run is maximal, so a minimum length in the pattern equals dropping short runs afterwards.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIXED = "[A-Za-z0-9_-]{20,}"

KINDS = ("assign", "access", "hex", "live")
#: A value held by this many owners or more is a widely copied example.
EXAMPLE_OWNERS = 5

_SPAN = "array<struct<start:bigint,rank:int,end:bigint,hash:string,size:bigint>>"


def _spans(text: Column, pattern: str, rank: int, value_group: int, keep) -> Column:
    """Structs (start, rank, end, hash, size of the value) of the matches that ``keep(value)``."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("v"),
                     F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long")).alias("g"))

    def fold(x: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(_SPAN).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + x["g"][i]
            end = start + F.length(x["m"][i])
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
                            F.md5(x["v"][i]).alias("hash"), F.length(x["v"][i]).cast("long").alias("size"))
            so_far = F.coalesce(acc["out"], F.array().cast(_SPAN))
            return F.struct(end.alias("at"), F.when(keep(x["v"][i]), F.concat(so_far, F.array(span))).otherwise(so_far).alias("out"))

        return F.when(F.size(x["m"]) > 0,
                      F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), zero, step)["out"])

    return F.coalesce(let(found, fold), F.array().cast(_SPAN))


def _guarded(guard: Column, spans: Column) -> Column:
    return F.when(guard, spans).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
         repository: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, owner, repository, base and candidate spans."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    text = F.col("_t")
    low = F.lower(text)
    every = lambda v: F.lit(True)
    has_key = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(owner, F.lit("")).alias("owner"),
                    F.coalesce(repository, F.lit("")).alias("repository"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    t = t.select(
        "doc_id", "owner", "repository",
        _guarded(has_key, _spans(text, ASSIGN, 0, 2, lambda v: F.length(v) >= 6)).alias("assign"),
        _guarded(text.contains("AKIA"), _spans(text, ACCESS, 1, 0, every)).alias("access"),
        _guarded(text.rlike("[0-9a-f]{24}"), _spans(text, HEX, 2, 0, every)).alias("hex"),
        _guarded(text.rlike("[A-Za-z0-9_-]{20}"), _spans(text, MIXED, 3, 0, mixed)).alias("mixed"))
    base = F.sort_array(F.concat("assign", "access", "hex"))
    apart = lambda b: F.filter("mixed", lambda c: ~F.exists(
        b, lambda s: (c["start"] < s["end"]) & (c["end"] > s["start"])))
    return t.select("doc_id", "owner", "repository", F.size("assign").cast("long").alias("n_assign"),
                    F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
                    base.alias("base"), let(base, apart).alias("candidates"))


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) over all spans and candidates."""
    held = (scanned.select("owner", "repository", F.explode(F.concat("base", "candidates")).alias("s"))
            .select(F.col("s.hash").alias("hash"), "owner", "repository").distinct())
    return held.groupBy("hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))


def judge(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, **columns) -> DataFrame:
    """One row per row of docs: the scan, and ``found``: all base spans and the
    live candidates with their owners, in order of start, then kind."""
    scanned = materialize(scan(docs, **columns).withColumn("_row", F.monotonically_increasing_id()), "secret-scan")
    spans = scanned.select("_row", F.explode(F.concat("base", "candidates")).alias("s"))
    seen = (spans.alias("s").join(ownership(scanned).alias("o"), F.col("s.s.hash") == F.col("o.hash"))
            .filter((F.col("s.s.rank") < 3) | (F.col("o.n_owners") < example_owners))
            .groupBy("s._row")
            .agg(F.sort_array(F.collect_list(F.struct("s.s.start", "s.s.rank", "s.s.end", "s.s.size", "o.n_owners", "o.n_repositories"))).alias("found")))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,size:bigint,n_owners:bigint,n_repositories:bigint>>")
    return (scanned.alias("d").join(seen.alias("f"), F.col("d._row") == F.col("f._row"), "left")
            .select("d.*", F.coalesce(F.col("f.found"), empty).alias("found")))


def _listed(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", kind[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    live = lambda s: s["n_owners"] < example_owners
    return judge(docs, example_owners).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", live)).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~live(s))).cast("long").alias("n_example"))


def mask(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, mark: str = "<secret>") -> DataFrame:
    """Pipeline stage: docs with every live-looking value replaced by ``mark``
    (the value only, so ``token = "..."`` keeps its key). Rows and columns stay."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_r"))  # clashing names stay inside
    judged = judge(whole.select("_r", *[F.col("_r")[c].alias(c) for c in ("text", "source", "lang")]), example_owners,
                   id_col="_r").withColumnRenamed("doc_id", "_r")
    text = F.col("_r")["text"]

    def cover(spans: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            start = F.when(s["rank"] == 0, s["end"] - s["size"]).otherwise(s["start"])
            piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int")), F.lit(mark))
            # a span inside one already masked only extends it
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                            F.when(start >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

        return let(F.aggregate(spans, zero, step), lambda acc: F.concat(
            acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))

    live = F.filter("found", lambda s: s["n_owners"] < example_owners)
    new = F.when(F.size(live) > 0, let(live, cover)).otherwise(text)
    return judged.select(*[(new if c == "text" else F.col("_r")[c]).alias(c) for c in docs.columns])


def _sql_kind(kind: str, rank: int, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
{kind} AS (
  SELECT rid, {rank} AS rank, lo + len0 AS start, lo + len0 + length(m) AS stop, v FROM (
    SELECT rid, m[i] AS m, v[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) AS lo,
           coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS len0
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v,
             regexp_split_to_array(t, '{p}') AS g FROM d))) WHERE {keep})"""


OP9_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner,
         concat_ws('/', source, lang) AS repository, coalesce(text, '') AS t FROM documents),
{_sql_kind("a", 0, ASSIGN, 2, "length(v) >= 6")},
{_sql_kind("k", 1, ACCESS, 0, "true")},
{_sql_kind("h", 2, HEX, 0, "true")},
{_sql_kind("c", 3, MIXED, 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")},
base AS (SELECT * FROM a UNION ALL SELECT * FROM k UNION ALL SELECT * FROM h),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND c.start < b.stop AND c.stop > b.start)),
own AS (SELECT md5(v) AS h, count(DISTINCT owner) AS n_owners FROM spans JOIN d USING (rid) GROUP BY 1),
found AS (
  SELECT rid, rank, start, stop, n_owners < {EXAMPLE_OWNERS} AS live,
         ['assign', 'access', 'hex', 'live'][rank + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS s
  FROM spans JOIN own ON md5(v) = h WHERE rank < 3 OR n_owners < {EXAMPLE_OWNERS}),
per AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM found GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN per USING (rid)"""
