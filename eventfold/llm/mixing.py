"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is a fixed number of equal-token blocks. Sources get blocks one at a
time, each going to the highest quotient ``target / (2 * seats + 1)``; within a
source its quota goes to its shards by the same rule over shard sizes; within a
shard the quota picks blocks by a seeded permutation, whole epochs first. A document's
``taken`` is the number of its words inside picked blocks, repeats counted.

Highest quotients are found without walking through seats one by one: with S
parties and N seats, a divisor shrunk by S/N gives every party seats it surely
wins and one grown by S/N the seats it can win at most, which leaves about 3 S
contested seats to be ranked. Ties go to the party first in order. A party
never gets more than ``max_repeats`` times its own blocks.

Parties of one contest meet in one window: the sources (their number does not
grow with the rows) and the shards of one source (one row for about
``shard_words`` words, 2^20 by default). Rows of documents are only ever
grouped by (source, shard), so a source that holds a third of the corpus is
spread over many groups.

Defined cases: null text has size 0 and takes 0; a null source is a source of
its own, last in order; null ids sort first and share a shard; repeated rows
are separate documents that share a place in the order; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, n_words

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
MAX_REPEATS = 3
SEED = "mix-1"
STEP = 2_147_483_647


def _seeded(*cols: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def _number(*cols: Column) -> Column:
    """A seeded 32-bit number."""
    return F.conv(F.substring(_seeded(*cols), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size): weights
    repeat over the sources in code point order; a target stops at
    ``max_repeats`` times its source, the excess goes to the others by weight.

    Sorted by cap per weight, the stopped sources come first, so one running
    sum finds the level at which the rest share what remains."""
    by_order = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    src = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("rank", F.row_number().over(by_order) - 1)
           .withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[F.col("rank") % n])
           .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))))
    every = W.partitionBy()
    tight = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    src = (src.withColumn("total", F.sum("source_size").over(every).cast("double"))
           .withColumn("cap_before", F.coalesce(F.sum("cap").over(tight.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("weight_left", F.sum("weight").over(tight.rowsBetween(0, W.unboundedFollowing)))
           .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
           .withColumn("stopped", F.col("weight") * F.col("level") > F.col("cap")))
    # past the first one that is not stopped the level only falls
    final = F.coalesce(F.max(F.when(~F.col("stopped"), F.col("level"))).over(every), F.lit(0.0))
    return (src.withColumn("final", final)
            .select("source", "source_size", "rank", "weight",
                    F.when(F.col("stopped"), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target")))


def sainte_lague(parties: DataFrame, group: list[str], share: str, seats: str, limit: str, order: str) -> DataFrame:
    """Adds ``quota``: the seats of each party in its group's contest for
    ``seats`` seats, by highest ``share / (2 k - 1)``, at most ``limit``."""
    g = W.partitionBy(*group)
    total, n = F.sum(share).over(g), F.count(F.lit(1)).over(g)
    p = (parties.withColumn("_total", total.cast("double")).withColumn("_n", n.cast("double"))
         .withColumn("_q", F.when(F.col("_total") > 0, F.col(share) * F.col(seats) / F.col("_total")).otherwise(0.0))
         .withColumn("_d", F.col("_n") / F.greatest(F.col(seats), F.lit(1)))
         .withColumn("_base", F.least(F.col(limit), F.greatest(F.lit(0), F.floor(F.col("_q") * (1 - F.col("_d")) + 0.5))).cast("long"))
         .withColumn("_top", F.least(F.col(limit), F.floor(F.col("_q") * (1 + 2 * F.col("_d")) + 1.5)).cast("long"))
         .withColumn("_top", F.when(F.col(share) > 0, F.greatest("_top", "_base")).otherwise(F.col("_base")))
         .withColumn("_open", F.col(seats) - F.sum("_base").over(g)))
    ks = F.when(F.col("_top") > F.col("_base"), F.sequence(F.col("_base") + 1, F.col("_top")))
    seat = (p.select(*group, order, share, "_open", F.explode(ks).alias("k"))
            .withColumn("r", F.row_number().over(g.orderBy(F.desc(F.col(share) / (F.col("k") * 2 - 1)), order, "k")))
            .filter(F.col("r") <= F.col("_open"))
            .groupBy(*group, order).agg(F.count(F.lit(1)).alias("_won")))
    on = F.lit(True)
    for c in [*group, order]:
        on = on & F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}"))
    return (p.alias("p").join(seat.alias("w"), on, "left")
            .select(*[F.col(f"p.{c}") for c in parties.columns],
                    (F.col("p._base") + F.coalesce(F.col("w._won"), F.lit(0))).alias("quota")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
        max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, source) for every row of docs."""
    return (_mixed(docs, id_col, text_col, source_col, weights, block_words, shard_words, max_repeats)
            .select("doc_id", "size", "source_size", "target", "taken", "source"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, block_words: int, shard_words: int,
           max_repeats: int) -> DataFrame:
    """The rows of ``mix`` with their shard and a hash of their text."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                        F.xxhash64(F.col(text_col)).alias("text_hash"))
    sized = materialize(sized, "mix-sizes")  # the texts are read once; what follows works on ids and sizes
    b = float(block_words)
    targets = source_targets(sized, weights, max_repeats)
    whole = W.partitionBy()
    targets = (targets.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(shard_words)))).cast("long"))
               .withColumn("seats", F.round(F.sum("target").over(whole) / b).cast("long"))
               .withColumn("limit", F.greatest(F.lit(1), F.round(F.lit(float(max_repeats)) * F.col("source_size") / b)).cast("long"))
               .withColumn("one", F.lit(1)))
    quotas = (sainte_lague(targets, ["one"], "target", "seats", "limit", "rank")
              .select("source", "source_size", "target", "n_shards", F.col("quota").alias("source_quota")))

    # every document to a shard of its source, then its place in the shard's stream of words
    placed = (sized.alias("s").join(quotas.alias("q"), F.col("s.source").eqNullSafe(F.col("q.source")))
              .select("s.doc_id", "s.source", "s.size", "s.text_hash", "q.source_size", "q.target", "q.source_quota",
                      (_number(F.col("s.doc_id")) % F.col("q.n_shards")).alias("shard")))
    stream = W.partitionBy("source", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "size")
    at = (placed.withColumn("end", F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0)))
          .withColumn("start", F.col("end") - F.col("size")))

    shards = (placed.groupBy("source", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
              .withColumn("n_blocks", F.ceil(F.col("shard_size") / b).cast("long"))
              .withColumn("limit", (F.col("n_blocks") * max_repeats).cast("long")))
    shards = (sainte_lague(shards, ["source"], "shard_size", "source_quota", "limit", "shard")
              .filter("n_blocks > 0")
              .withColumn("epochs", F.floor(F.col("quota") / F.col("n_blocks")).cast("long"))
              .withColumn("extra", F.col("quota") - F.col("epochs") * F.col("n_blocks")))

    # seeded block selection: of a shard's n blocks, those whose place ``(STEP * block + offset) mod n`` is below
    # ``extra`` are taken once more; STEP is a prime above n, so the places are a permutation of the blocks
    s = shards.select("source", "shard", "n_blocks", "epochs", "extra",
                      (_number(F.col("source"), F.col("shard")) % F.col("n_blocks")).alias("offset"))
    at = (at.alias("a").join(s.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source")) & (F.col("a.shard") == F.col("s.shard")), "left")
          .select("a.*", "s.n_blocks", "s.epochs", "s.extra", "s.offset"))
    start, end = F.col("start"), F.col("end")
    blocks = F.sequence(F.floor(start / b).cast("long"), F.floor((end - 1) / b).cast("long"))

    def inside(block: Column) -> Column:
        return F.least(end, (block + 1) * block_words) - F.greatest(start, block * block_words)

    def picked(block: Column) -> Column:
        return (block * F.lit(STEP).cast("long") + F.col("offset")) % F.col("n_blocks") < F.col("extra")

    more = F.aggregate(blocks, F.lit(0).cast("long"), lambda n, x: n + F.when(picked(x), inside(x)).otherwise(F.lit(0).cast("long")))
    taken = F.when(F.col("size") > 0, F.col("epochs") * F.col("size") + more).otherwise(F.lit(0))
    return at.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard", "text_hash")


def copies(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
           max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Rows (doc_id, source, text_hash, n): how often the mix gives each distinct
    document whole.

    A document of ``size`` words gets ``taken / size`` copies, rounded up or
    down by a seeded systematic draw over its shard in order of size: the drawn
    fractions run along the sum of the fractions, so the words emitted for a shard
    differ from those taken by less than its largest document (repeated rows, which
    are drawn together, counting as one). Empty documents stay once."""
    m = _mixed(docs, "doc_id", "text", "source", weights, block_words, shard_words, max_repeats)
    units = (m.groupBy("source", "shard", "doc_id", "text_hash").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
             .withColumn("part", F.when(F.col("size") > 0, F.col("taken") % F.col("size") / F.col("size")).otherwise(0.0)))
    shard = W.partitionBy("source", "shard").orderBy("size", "doc_id", "text_hash")
    first = _number(F.lit("copies"), F.col("source"), F.col("shard")) / 2.0 ** 32
    before = F.coalesce(F.sum("part").over(shard.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    upto = F.sum("part").over(shard.rowsBetween(W.unboundedPreceding, 0))
    drawn = F.floor(upto + first) - F.floor(before + first)
    n = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size")) + drawn).otherwise(1)
    return units.select("doc_id", "source", "text_hash", n.cast("int").alias("n"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it (``copies``),
    so the emitted words of each source reach its target. A source above its
    target gives a part of its documents only."""
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    same = (F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source"))
            & (F.xxhash64(F.col("d.text")) == F.col("m.text_hash")))
    return (docs.alias("d").join(copies(docs).filter("n > 0").alias("m"), same)
            .select(*cols, F.explode(F.array_repeat(F.lit(0), F.col("m.n"))).alias("__copy")).drop("__copy"))


def op4(docs: DataFrame) -> DataFrame:
    return mix(docs)


OP4_SQL = f"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s GROUP BY source),
src1 AS (
  SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE AS total FROM src0),
src2 AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM src1),
src3 AS (
  SELECT *, (total - cap_before) / weight_left AS level, weight * ((total - cap_before) / weight_left) > cap AS stopped FROM src2),
src AS (
  SELECT source, source_size, rank,
         CASE WHEN stopped THEN cap ELSE weight * coalesce(max(level) FILTER (NOT stopped) OVER (), 0) END AS target,
         greatest(1, ceil(source_size / {SHARD_WORDS}.0))::BIGINT AS n_shards,
         greatest(1, round(3.0 * source_size / {BLOCK_WORDS}.0))::BIGINT AS lim FROM src3),
seats AS (
  SELECT source, rank, target / (2 * k - 1) AS quotient, k
  FROM (SELECT source, rank, target, unnest(range(1, lim + 1)) AS k FROM src WHERE target > 0)),
won AS (
  SELECT source, count(*)::BIGINT AS quota FROM (
    SELECT source, row_number() OVER (ORDER BY quotient DESC, rank, k) AS r FROM seats)
  WHERE r <= (SELECT round(sum(target) / {BLOCK_WORDS}.0) FROM src) GROUP BY source),
placed AS (
  SELECT s.doc_id, s.source, s.size, src.source_size, src.target, coalesce(won.quota, 0) AS source_quota,
         ('0x' || substr(md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT % src.n_shards AS shard
  FROM s JOIN src ON s.source IS NOT DISTINCT FROM src.source LEFT JOIN won ON s.source IS NOT DISTINCT FROM won.source),
placed_at AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS hi FROM placed),
shard0 AS (
  SELECT source, shard, source_quota, sum(size) AS shard_size, ceil(sum(size) / {BLOCK_WORDS}.0)::BIGINT AS n_blocks
  FROM placed GROUP BY ALL),
shard_seats AS (
  SELECT source, shard, source_quota, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k - 1) DESC, shard, k) AS r
  FROM (SELECT *, unnest(range(1, 3 * n_blocks + 1)) AS k FROM shard0 WHERE n_blocks > 0)),
shard_won AS (
  SELECT source, shard, count(*) AS quota FROM shard_seats WHERE r <= source_quota GROUP BY ALL),
shard1 AS (
  SELECT a.source, a.shard, n_blocks, coalesce(quota, 0) // n_blocks AS epochs, coalesce(quota, 0) % n_blocks AS extra
  FROM shard0 a LEFT JOIN shard_won b ON a.source IS NOT DISTINCT FROM b.source AND a.shard = b.shard WHERE n_blocks > 0),
blocks AS (
  SELECT source, shard, epochs, block,
         ({STEP} * block + ('0x' || substr(md5('{SEED}:' || coalesce(source, '') || ':' || shard), 1, 8))::BIGINT % n_blocks) % n_blocks < extra AS picked
  FROM (SELECT *, unnest(range(0, n_blocks)) AS block FROM shard1)),
words AS (
  SELECT a.source, a.shard, a.doc_id, a.size, a.hi,
         sum(b.epochs * (least(a.hi, (b.block + 1) * {BLOCK_WORDS}) - greatest(a.hi - a.size, b.block * {BLOCK_WORDS}))
             + CASE WHEN b.picked THEN least(a.hi, (b.block + 1) * {BLOCK_WORDS}) - greatest(a.hi - a.size, b.block * {BLOCK_WORDS}) ELSE 0 END) AS taken
  FROM (SELECT *, unnest(range(((hi - size) // {BLOCK_WORDS})::BIGINT, ((hi - 1) // {BLOCK_WORDS})::BIGINT + 1)) AS block FROM placed_at WHERE size > 0) a
  JOIN blocks b ON a.source IS NOT DISTINCT FROM b.source AND a.shard = b.shard AND a.block = b.block GROUP BY ALL)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(w.taken, 0)::BIGINT AS taken, c.source
FROM placed_at c LEFT JOIN words w ON c.size > 0 AND c.source IS NOT DISTINCT FROM w.source AND c.shard = w.shard
  AND c.doc_id IS NOT DISTINCT FROM w.doc_id AND c.hi = w.hi AND c.size = w.size"""
