"""Point-in-time lookups: for every row, the nearest earlier (or later) row of
the same key that belongs to a "table" (a type set), in ``order``.

This is the batch form of a stream-table join where the table is "latest value
by key" and a table update never re-fires earlier stream rows.

Layout on a cluster
-------------------
A plain ``Window.partitionBy(key)`` would put every row of a key into one
task, and one key may hold a large share of the log. The scan is therefore
split into *chunks* of ``order`` (``floor(order / chunk)``):

1. each ``(key, chunk)`` is reduced to its last (or first) table value by a
   partial aggregate (map-side combine, so a hot key is reduced before the
   shuffle);
2. the carry-in of a chunk is the nearest non-null summary of the chunks
   before (after) it: a window per key over one row per chunk, i.e. a key's
   order range / chunk width rows (2^20 for a range of 2^40 at the default
   width, the same bound as a chunk's rows). For longer ranges the summaries
   can be scanned the same way one level up, in groups of 1024 chunks
   (``eventfold.asof.summaryLevels``; each level costs two small exchanges). When
   the caller needs lookups only for some rows (``want``, e.g. triggers), it
   is kept only where such a row precedes (follows) the chunk's own table
   rows, so a sparse key spread over many chunks adds few sentinels;
3. the carry enters the row stream as one sentinel row per chunk, ordered
   before (after) the chunk's real rows; rows are then windowed within
   ``(key, chunk)`` - one hash exchange on both columns, so a hot key is
   spread over as many tasks as it has chunks - and the nearest value is
   either in the chunk or the sentinel's. No join.

The result is exact for any chunk size; ``chunk=0`` skips steps 2-4 and uses
a single window, which is cheaper when no key is large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_CONF = "eventfold.asof.chunk"
DEFAULT_CHUNK = 1 << 20
# With summary levels > 0 the chunk summaries are scanned the same way, in
# groups of SUMMARY_FANOUT chunks (session conf ``eventfold.asof.summaryLevels``).
SUMMARY_FANOUT = 1 << 10
LEVELS_CONF = "eventfold.asof.summaryLevels"
SUMMARY_LEVELS = 1

Tables = Mapping[str, tuple[Column, Column]]


def default_chunk(spark: SparkSession) -> int:
    """Chunk width in ``order`` units, from the session (``0`` disables chunking)."""
    return int(spark.conf.get(CHUNK_CONF, str(DEFAULT_CHUNK)))


def summary_levels(spark: SparkSession) -> int:
    return int(spark.conf.get(LEVELS_CONF, str(SUMMARY_LEVELS)))


def attach_last_before(df: DataFrame, key: str, order: str, tables: Tables,
                       tiebreak: Sequence[str] = (), chunk: int | None = None,
                       want: Column | None = None) -> DataFrame:
    """Add one column per table: the ``value`` of the last row with the same
    ``key``, strictly before this row in ``(order, *tiebreak)``, where the table's
    condition holds. ``value`` must be non-null on table rows (use a struct).
    Rows with a null key see nothing. With ``want``, only rows where it holds
    get their lookups (others get null), which lets the scan skip carry-ins no
    wanted row needs."""
    return _scan(df, key, order, tables, tiebreak, chunk, forward=False, want=want)


def attach_first_after(df: DataFrame, key: str, order: str, tables: Tables,
                       tiebreak: Sequence[str] = (), chunk: int | None = None,
                       want: Column | None = None) -> DataFrame:
    """Mirror of :func:`attach_last_before`: the first table row strictly after."""
    return _scan(df, key, order, tables, tiebreak, chunk, forward=True, want=want)


def _scan(df: DataFrame, key: str, order: str, tables: Tables, tiebreak: Sequence[str],
          chunk: int | None, forward: bool, want: Column | None = None, level: int = 0,
          levels: int | None = None) -> DataFrame:
    if chunk is None:
        chunk = default_chunk(df.sparkSession)
    if levels is None:
        levels = summary_levels(df.sparkSession)
    names = list(tables)
    keyed = F.col(key).isNotNull()
    picks = {n: F.when(keyed & F.coalesce(cond, F.lit(False)), value) for n, (cond, value) in tables.items()}
    sort_cols = [F.col(order), *[F.col(c) for c in tiebreak]]

    def near(c: str, w: WindowSpec) -> Column:
        """The nearest value of a column before (after) a row, in one pass either way: the first of a frame that reaches
        to the end would be sought anew from each row, a lead goes on from the last one found."""
        if forward:
            return F.expr(f"lead(`{c}`, 1) ignore nulls").over(w)
        return F.last(F.col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))

    wanted = F.coalesce(want, F.lit(False)) if want is not None else F.lit(True)
    if not chunk:
        w = Window.partitionBy(key).orderBy(*sort_cols)
        rows = df.select("*", *[picks[n].alias(f"_v_{n}") for n in names])
        return rows.select(*df.columns, *[F.when(wanted, near(f"_v_{n}", w)).alias(n) for n in names])

    ck, ordk = f"_asof_chunk{level}", f"_asof_ord{level}"
    base = df.withColumn(ck, F.floor(F.col(order) / F.lit(chunk)).cast("long"))

    # 1. per (key, chunk) the chunk's last (first) table value - a partial
    #    aggregate, so a hot key is reduced map-side before the shuffle. With
    #    ``want``, also where the chunk's wanted rows and its table rows start
    #    (end), to tell which chunks need a carry-in at all.
    rank = F.struct(*sort_cols) if tiebreak else F.col(order)
    pick_by = F.min_by if forward else F.max_by
    edge_of = F.max if forward else F.min
    extra = []
    if want is not None:
        extra = [edge_of(F.when(wanted, rank)).alias("_edge"),
                 *[edge_of(F.when(picks[n].isNotNull(), rank)).alias(f"_e_{n}") for n in names]]
    summary = (base.where(keyed)
               .groupBy(key, ck)
               .agg(*[pick_by(picks[n], F.when(picks[n].isNotNull(), rank)).alias(f"_s_{n}") for n in names],
                    *extra))

    # 2. carry-in of each chunk: nearest non-null summary of the chunks before
    #    (after) it - the same scan one level up, over one row per chunk. With
    #    ``want`` a chunk gets it for a table only if a wanted row of it comes
    #    before (after) the chunk's own rows of that table.
    def needed(n: str) -> Column:
        if want is None:
            return F.lit(True)
        own, edge = F.col(f"_e_{n}"), F.col("_edge")
        # a wanted row that is itself the first (last) table row still looks
        # strictly before (after) itself, hence <= (>=)
        return edge.isNotNull() & (own.isNull() | ((edge >= own) if forward else (edge <= own)))

    if level < levels:
        # the summaries of a hot key grow with its order range: scan them the
        # same way, in groups of SUMMARY_FANOUT chunks, instead of one window
        # per key
        near_s = _scan(summary, key, ck, {n: (F.col(f"_s_{n}").isNotNull(), F.col(f"_s_{n}")) for n in names},
                       (), SUMMARY_FANOUT, forward, None, level + 1, levels)
        carry = near_s.select(key, ck, *[F.when(needed(n), F.col(n)).alias(f"_v_{n}") for n in names])
    else:
        w_c = Window.partitionBy(key).orderBy(ck)
        carry = summary.select(key, ck, *[F.when(needed(n), near(f"_s_{n}", w_c)).alias(f"_v_{n}") for n in names])
    carry = carry.where(F.greatest(*[F.col(f"_v_{n}").isNotNull() for n in names]) if len(names) > 1
                        else F.col(f"_v_{names[0]}").isNotNull())

    # 3. carry rows enter the row stream as sentinels ordered before (after)
    #    every real row of their (key, chunk); one exchange, one window, no join
    real = base.select(*df.columns, ck, F.lit(1).alias(ordk), *[picks[n].alias(f"_v_{n}") for n in names])
    sentinel_rank = 0 if not forward else 2
    sentinels = carry.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != key],
        key, ck, F.lit(sentinel_rank).alias(ordk), *[f"_v_{n}" for n in names])
    rows = real.unionByName(sentinels)
    w_in = Window.partitionBy(key, ck).orderBy(F.col(ordk), *sort_cols)
    out = rows.select("*", *[near(f"_v_{n}", w_in).alias(f"_r_{n}") for n in names])
    return out.where(F.col(ordk) == 1).select(
        *df.columns, *[F.when(wanted, F.col(f"_r_{n}")).alias(n) for n in names])


def running_totals(df: DataFrame, key: str, order: str, deltas: Mapping[str, Column], tiebreak: Sequence[str] = (),
                   chunk: int | None = None) -> DataFrame:
    """Add one column per delta: its sum over the rows of the same ``key`` strictly before this row in
    ``(order, *tiebreak)``. Rows with a null key get null.

    Laid out like the as-of scan: each ``(key, chunk)`` is reduced to its sums (map-side), a window over
    those gives the sum that a chunk starts from, which enters the rows as a sentinel in front of the chunk."""
    if chunk is None:
        chunk = default_chunk(df.sparkSession)
    names, keyed = list(deltas), F.col(key).isNotNull()
    sort_cols = [F.col(order), *[F.col(c) for c in tiebreak]]
    ck = F.floor(F.col(order) / F.lit(chunk)).cast("long") if chunk else F.lit(0).cast("long")
    base = df.select("*", *[F.coalesce(d.cast("long"), F.lit(0)).alias(f"_d_{n}") for n, d in deltas.items()], ck.alias("_total_chunk"))
    sums = base.where(keyed).groupBy(key, "_total_chunk").agg(*[F.sum(f"_d_{n}").alias(f"_d_{n}") for n in names])
    before = Window.partitionBy(key).orderBy("_total_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(key, "_total_chunk", *[F.sum(f"_d_{n}").over(before).alias(f"_d_{n}") for n in names]).where(F.col(f"_d_{names[0]}").isNotNull())
    sentinels = carry.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != key], key, "_total_chunk",
                             *[f"_d_{n}" for n in names], F.lit(0).alias("_total_rank"))
    rows = base.withColumn("_total_rank", F.lit(1)).unionByName(sentinels)
    w = (Window.partitionBy(key, "_total_chunk").orderBy(F.col("_total_rank"), *sort_cols).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.select("*", *[F.when(keyed, F.coalesce(F.sum(f"_d_{n}").over(w), F.lit(0))).alias(f"_t_{n}") for n in names])
    return out.where("_total_rank = 1").select(*df.columns, *[F.col(f"_t_{n}").alias(n) for n in names])
