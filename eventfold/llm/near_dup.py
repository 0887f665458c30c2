"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct 3-word shingles (5-word in the pipeline). Documents with equal sets
collapse to one representative first (the smallest id). Each representative
gets ``BANDS x ROWS`` minima; bands of ROWS minima make bucket keys, and the
lowest ``BITS`` bits of every minimum are packed into a short signature. The
share of equal b-bit values, corrected for chance collisions
(``(p - 2^-b) / (1 - 2^-b)``), estimates the similarity of two signatures
from bit counts alone. Only pairs whose estimate is within a margin of the
threshold are confirmed on the full sets.

Copies are never expanded into all pairs. Round one emits, per bucket, a
spanning forest of the most similar pairs (at most one pair per member);
confirmed links give components. Round two looks again at buckets of three and
more whose members ended in different components: estimates tell which members
have a plausible partner across components, and only those meet again, with
their full sets, so that no link between components is lost. The members
outside a bucket's largest component are cut into blocks and meet the whole
bucket part by part; a task gives as many links as join the components it sees,
never all pairs. A bucket of any size runs in bounded memory, without caps.

A pair at similarity 0.85 shares no bucket with probability
``(1 - 0.85^5)^24 < 1e-6`` (the pipeline's stage: ``(1 - 0.8^5)^36`` at 0.8) and falls below the estimate's margin (5 standard
deviations) about as rarely; all else is exact.

Defined cases: null, empty and blank texts have the empty set and are linked
with nothing; rows with a null id take part (numbered by a hash of their text), their
component is the smallest real id reachable, null if there is none, and they
are kept only in the latter case; rows of one id are each judged by their own
text; repeated rows are returned each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .wordtable import mix, slices, window_rows, windows, words

SHINGLE, PERCENT = 3, 85
BANDS, ROWS, BITS = 24, 5, 2
#: The pipeline's stage: a pair at its threshold shares no bucket as rarely as one at op2's.
STAGE_SHINGLE, STAGE_PERCENT, STAGE_BANDS = 5, 80, 36
LEFT_BLOCK, RIGHT_PART, CHUNK = 1024, 16384, 2048


def shingle_sets(texts: pa.Array, n: int):
    """(row bounds, shingle hashes): the sorted distinct n-word shingles of each
    row; a row of 1 to n-1 words has the whole sequence as its one shingle."""
    w = words(texts, True)
    start, row = window_rows(w.rows, n)
    shingle = windows(w.hashes, n)[start] if len(start) else np.zeros(0, np.uint64)
    counts = np.diff(w.rows)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        lone = np.array([int(windows(w.hashes[w.rows[i]:w.rows[i + 1]], int(counts[i]), 5 + int(counts[i]))[0]) for i in short], np.uint64)
        row, shingle = np.concatenate([row, short]), np.concatenate([shingle, lone])
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    row, shingle = row[new], shingle[new]
    return np.searchsorted(row, np.arange(len(texts) + 1)), shingle


def _signatures(shingle: int, bands: int, rows: int, bits: int):
    k = bands * rows
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lanes = -(-k * bits // 64)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, texts in slices(part.column(1), 1 << 21):
                bounds, sets = shingle_sets(texts, shingle)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                at = bounds[:-1][full]
                n = len(full)
                least = np.empty((n, k), np.uint64)
                for j in range(k if n else 0):
                    # the high half is the better mixed one; ties across shingles are as rare as 64-bit collisions
                    least[:, j] = np.minimum.reduceat((sets ^ seeds[j]) * (seeds[k + j] | np.uint64(1)), at)
                low = mix(least) & np.uint64((1 << bits) - 1)
                per = 64 // bits
                packed = np.zeros((n, lanes), np.uint64)
                for j in range(k):
                    packed[:, j // per] |= low[:, j] << np.uint64(bits * (j % per))
                keys = np.empty((n, bands), np.uint64)
                for b in range(bands):
                    keys[:, b] = windows(least[:, b * rows:(b + 1) * rows].reshape(-1), rows, b + 1)[::rows] if n else 0
                mixed = mix(sets)
                k1 = np.add.reduceat(mixed, at) if n else np.zeros(0, np.uint64)
                k2 = np.add.reduceat(mix(mixed), at) if n else np.zeros(0, np.uint64)

                def spread(values, default):
                    out = np.full((len(texts), *values.shape[1:]), default, values.dtype)
                    out[full] = values
                    return out

                def listed(values, width):
                    flat = pa.array(spread(values, 0).reshape(-1).view(np.int64))
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width), flat)

                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(first, len(texts)), pa.array(size.astype(np.int64)),
                     pa.array(spread(k1, 0).view(np.int64)), pa.array(spread(k2, 0).view(np.int64)),
                     listed(packed, lanes), listed(keys, bands)],
                    names=["node", "n_shingles", "k1", "k2", "signature", "bands"])
    return run


class Estimator:
    """Similarity estimates from packed b-bit signatures of ``k`` minima."""

    def __init__(self, k: int, bits: int) -> None:
        assert 64 % bits == 0
        self.k, self.bits = k, bits
        self.low = np.uint64(sum(1 << (bits * i) for i in range(64 // bits)))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = y = a ^ b
        for i in range(1, self.bits):
            x = x | (y >> np.uint64(i))
        differ = np.bitwise_count(x & self.low).sum(axis=-1, dtype=np.int64)
        chance = 2.0 ** -self.bits
        return ((1 - differ / self.k) - chance) / (1 - chance)

    def margin(self, threshold: float, deviations: float = 5.0) -> float:
        chance = 2.0 ** -self.bits
        p = threshold * (1 - chance) + chance
        return threshold - deviations * (p * (1 - p) / self.k) ** 0.5 / (1 - chance)


def _matrix(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        flat = np.asarray(column.flatten()).view(np.uint64)
        return flat.reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _runs(parts: Iterator[pa.RecordBatch], keys: int, most: int):
    """(columns, bounds): complete groups of sorted rows. A group longer than
    ``most`` rows is handed out in pieces."""
    held: list[np.ndarray] | None = None
    for part in parts:
        if not len(part):
            continue
        cols = [_matrix(c) for c in part.columns]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
        cut = np.zeros(len(cols[0]), bool)
        cut[0] = True
        for c in cols[:keys]:
            cut[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(cut)
        last = starts[-1]
        if len(cut) - last > most:  # long group: hand out what is there
            pieces = np.arange(last, len(cut), most)[1:]
            starts = np.concatenate([starts, pieces])
            last = starts[-1]
        if last:
            inner = np.concatenate([np.arange(a, b, most) for a, b in zip(starts[:-1], starts[1:])])
            yield [c[:last] for c in cols], np.append(inner, last)
        held = [c[last:] for c in cols]
    if held is not None:
        yield held, np.append(np.arange(0, len(held[0]), most), len(held[0]))


def _forest(estimate: Estimator, least: float):
    """Round one on rows (key, node, signature) sorted by key. Out: kind 0 rows
    are pairs (a, b) of a forest; kind 1 rows are members (key, node, signature)
    of groups of three and more, for round two."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # first member of the group that the last piece belonged to
        for (key, node, sig), bounds in _runs(parts, 1, CHUNK):
            size = np.diff(bounds)
            at = bounds[:-1]
            a, b, members = [], [], []
            # pieces of a group that began in an earlier piece, of this call or of the last one
            further = np.zeros(len(at), bool)
            further[1:] = key[at[1:]] == key[at[:-1]]
            further[:1] = before is not None and key[at[0]] == before[0]
            two = at[(size == 2) & ~further]
            good = estimate(sig[two], sig[two + 1]) >= least
            a.append(node[two[good]])
            b.append(node[two[good] + 1])
            for i in np.flatnonzero((size != 2) | further).tolist():
                lo, n = int(at[i]), int(size[i])
                if further[i]:
                    # a further piece of a long group: tie it to the group's first member
                    a.append(np.full(n, before[1]))
                    b.append(node[lo:lo + n])
                    members.append(np.arange(lo, lo + n))
                elif n > 2:
                    members.append(np.arange(lo, lo + n))
                if not further[i]:
                    before = (key[lo], node[lo])  # the group may go on
                if n < 3 and not further[i]:
                    continue
                # Prim's algorithm, one vector of estimates per member
                s, ids = sig[lo:lo + n], node[lo:lo + n]
                best, source, out = np.full(n, -9.0), np.zeros(n, np.int64), np.ones(n, bool)
                now = 0
                for _ in range(n - 1):
                    out[now] = False
                    e = estimate(s, s[now])
                    nearer = out & (e > best)
                    best[nearer], source[nearer] = e[nearer], now
                    now = int(np.argmax(np.where(out, best, -99.0)))
                    if best[now] >= least:
                        a.append(ids[[source[now]]])
                        b.append(ids[[now]])
            yield _emit(a, b, key, sig, node, np.concatenate(members) if members else np.zeros(0, np.int64))

    def _emit(a, b, key, sig, node, m) -> pa.RecordBatch:
        a, b = np.concatenate(a), np.concatenate(b)
        k = np.concatenate([np.zeros(len(a), np.int64), key[m]])
        lanes = sig.shape[1]
        flat = np.concatenate([np.zeros(len(a) * lanes, np.int64), sig[m].reshape(-1).view(np.int64)])
        total = len(a) + len(m)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], [len(a), len(m)]).astype(np.int64)), pa.array(np.concatenate([np.minimum(a, b), node[m]])),
             pa.array(np.concatenate([np.maximum(a, b), node[m]])), pa.array(k),
             pa.ListArray.from_arrays(pa.array(np.arange(total + 1, dtype=np.int32) * lanes), pa.array(flat))],
            names=["kind", "a", "b", "key", "signature"])
    return run


def _plausible(estimate: Estimator, least: float):
    """Round two, first step, on rows (key, block, part, role, node, comp,
    signature, bands) sorted by the first four: role 0 are a block's own members,
    role 1 those to meet them. Out: the (key, block, part, role, node) of members
    that have a partner in another component whose estimate is near the threshold
    and whose first common bucket is this one (so a pair counts in one bucket)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for (key, block, part, role, node, comp, sig, bands), bounds in _runs(parts, 4, CHUNK):
            found: list[tuple] = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                group = (key[lo], block[lo], part[lo])
                here = (node[lo:hi], comp[lo:hi], sig[lo:hi], bands[lo:hi])
                if role[lo] == 0:
                    if own is None or own[0] != group:
                        own = (group, *here)
                    else:
                        own = (group, *[np.concatenate([x, y]) for x, y in zip(own[1:], here)])
                    here = own[1:]
                if own is None or own[0] != group:
                    continue
                band = (own[4] == key[lo].astype(np.uint64)).argmax(axis=1)
                met = np.zeros(len(here[0]), bool)
                meets = np.zeros(len(own[1]), bool)
                for i in range(len(own[1])):
                    near = np.flatnonzero((here[1] != own[2][i]) & (estimate(here[2], own[3][i]) >= least))
                    near = near[(here[3][near] == own[4][i]).argmax(axis=1) == band[i]]
                    met[near] = True
                    meets[i] = len(near) > 0
                found += [(*group, 0, n) for n in own[1][meets].tolist()]
                found += [(*group, int(role[lo]), n) for n in here[0][met].tolist()]
            columns = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns],
                                             names=["key", "block", "part", "role", "node"])
    return run


def _sets(shingle: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, texts in slices(part.column(1), 1 << 21):
                bounds, sets = shingle_sets(texts, shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(first, len(texts)),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["node", "shingles"])
    return run


def _linked(percent: int):
    """Round two, second step, on rows (key, block, part, role, node, comp, full
    set) sorted by the first four: confirmed links, enough of them to join the
    components that a group links (never all its pairs)."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, left, others, links = None, [], [], []
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        def meet(right: list[tuple]) -> None:
            if not left or not right:
                return
            known = np.unique(np.concatenate([x[2] for x in left]))
            flat = np.concatenate([x[2] for x in right])
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            at = np.where(known[at] == flat, at, len(known))
            size = np.array([len(x[2]) for x in right])
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            for node, comp, own in left:
                mine = np.zeros(len(known) + 1, np.int64)
                mine[np.searchsorted(known, own)] = 1
                both = np.add.reduceat(mine[at], starts)
                for j in np.flatnonzero(100 * both >= percent * (size + len(own) - both)).tolist():
                    x, y = find(comp), find(right[j][1])
                    if x != y:
                        root[x] = y
                        links.append((node, right[j][0]))

        for batch in rows:
            if not len(batch):
                continue
            heads = list(zip(*[batch.column(i).to_pylist() for i in range(6)]))
            offsets = np.asarray(batch.column(6).offsets)
            flat = np.asarray(batch.column(6).values)
            for i, (key, block, part, role, node, comp) in enumerate(heads):
                if (key, block, part) != group:
                    meet(left)
                    meet(others)
                    group, left, others, root = (key, block, part), [], [], {}
                (others if role else left).append((node, comp, flat[offsets[i]:offsets[i + 1]]))
                if len(others) >= CHUNK:
                    meet(others)
                    others = []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
                links = []
        meet(left)
        meet(others)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return run


def _confirm(shingle: int, percent: int):
    """Rows (a, b, text a, text b): those whose sets meet the threshold."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good = []
            for first, left in slices(part.column(2), 1 << 21):
                bl, sl = shingle_sets(left, shingle)
                br, sr = shingle_sets(part.column(3).slice(first, len(left)), shingle)
                for i in range(len(left)):
                    x, y = sl[bl[i]:bl[i + 1]], sr[br[i]:br[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))
    return run


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold; texts: (node, text)."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    return (left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
            .select("a", "b", "left", "right").mapInArrow(_confirm(shingle, percent), "a bigint, b bigint"))


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of an edge list (a, b): the smallest node of
    its component. Alternates large-star and small-star steps until the edges
    no longer change; each step is a minimum per node and a join, so a node
    with very many links is aggregated before it is shuffled."""
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        u = both(e)
        m = u.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return u.join(m, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        u = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        m = u.groupBy("a").agg(F.min("b").alias("m"))
        star = u.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return star.unionByName(m.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    def state(e: DataFrame):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") / 2.0 ** 32).alias("h"),
                  F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return r["n"], r["x"]

    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    seen = state(edges)
    while True:
        edges = materialize(small(large(edges)), "stars")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of docs."""
    estimate = Estimator(bands * rows, bits)
    least = estimate.margin(percent / 100)
    doc_id = F.col(id_col).cast("long")
    # rows without id are numbered by a hash of their text
    node = F.coalesce(doc_id, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit("no id")))
    keyed = docs.select(node.alias("node"), F.col(text_col).alias("text"))
    signed = materialize(docs.select(F.struct(node.alias("node"), doc_id.isNotNull().alias("has_id")).alias("node"), F.col(text_col).alias("text"))
                         .mapInArrow(_signatures(shingle, bands, rows, bits),
                                     "node struct<node: bigint, has_id: boolean>, n_shingles bigint, k1 bigint, k2 bigint, "
                                     "signature array<bigint>, bands array<bigint>")
                         .select("node.node", "node.has_id", "n_shingles", "k1", "k2", "signature", "bands"), "signatures")
    real = F.min(F.when(F.col("has_id"), F.col("node")))
    reps = (signed.filter("n_shingles > 0").groupBy("k1", "k2")
            .agg(F.min_by(F.struct("signature", "bands"), "node").alias("s"), real.alias("real"), F.min("node").alias("any")))
    reps = materialize(reps.select("k1", "k2", F.coalesce("real", "any").alias("rep"), "real", "s.signature", "s.bands"), "representatives")

    buckets = reps.select(F.col("rep").alias("node"), "signature", F.explode("bands").alias("key")).select("key", "node", "signature")
    forest = materialize(buckets.repartition("key").sortWithinPartitions("key").mapInArrow(
        _forest(estimate, least), "kind bigint, a bigint, b bigint, key bigint, signature array<bigint>"), "buckets")
    nodes = forest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = materialize(keyed.join(nodes, "node").distinct(), "candidate-texts")
    pairs = forest.filter("kind = 0").select("a", "b").distinct()
    links = materialize(confirmed(pairs, texts, shingle, percent), "links-1")
    labels = components(links)

    # round two: buckets whose members stand in several components
    members = (forest.filter("kind = 1").select(F.col("a").alias("node"), "key", "signature").alias("m")
               .join(labels.alias("l"), F.col("m.node") == F.col("l.node"), "left")
               .select("m.*", F.coalesce("l.comp", "m.node").alias("comp")))
    members = materialize(members, "members")
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = (sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"))
             .filter(F.col("n") > F.col("top.n"))
             .select("key", F.col("top.comp").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / LEFT_BLOCK).cast("int").alias("blocks"),
                     F.ceil(F.col("n") / RIGHT_PART).cast("int").alias("parts")))
    m = members.join(split, "key").join(reps.select(F.col("rep").alias("node"), "bands"), "node")
    own = F.when(F.col("comp") != F.col("top"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).otherwise(F.col("blocks"))
    met = (m.withColumn("own", own)
           .withColumn("block", F.explode(F.sequence(F.lit(0), F.least(F.col("own"), F.col("blocks") - 1))))
           .withColumn("role", F.when(F.col("own") == F.col("block"), 0).otherwise(1))
           # a block's own members go to every part, the others to one
           .withColumn("part", F.explode(F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("parts") - 1))
                                         .otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")))))
           .select("key", *[F.col(c).cast("long").alias(c) for c in ("block", "part", "role")], "node", "comp", "signature", "bands"))
    order = ["key", "block", "part", "role"]
    near = (met.repartition(*order[:3]).sortWithinPartitions(*order)
            .mapInArrow(_plausible(estimate, least), "key bigint, block bigint, part bigint, role bigint, node bigint").distinct())
    near = materialize(near, "plausible")
    sets = texts.join(near.select("node").distinct(), "node").mapInArrow(_sets(shingle), "node bigint, shingles array<bigint>")
    comp_of = members.select("node", "comp").distinct()
    late = (near.join(comp_of, "node").join(sets, "node").select(*order, "node", "comp", "shingles")
            .repartition(*order[:3]).sortWithinPartitions(*order).mapInArrow(_linked(percent), "a bigint, b bigint"))
    labels = components(links.unionByName(late))

    groups = (reps.select("k1", "k2", "rep", "real").alias("r").join(labels.alias("l"), F.col("r.rep") == F.col("l.node"), "left")
              .select("k1", "k2", "real", F.coalesce("l.comp", "r.rep").alias("comp")))
    least_id = groups.groupBy("comp").agg(F.min("real").alias("component"))  # null where no row has an id
    comp = groups.join(least_id, "comp").select("k1", "k2", "component")
    out = (signed.select("node", "has_id", "n_shingles", "k1", "k2").alias("s")
           .join(comp.alias("c"), (F.col("s.k1") == F.col("c.k1")) & (F.col("s.k2") == F.col("c.k2")) & (F.col("s.n_shingles") > 0), "left")
           .select(F.when(F.col("s.has_id"), F.col("s.node")).alias("doc_id"), "s.n_shingles", "c.component"))
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage, on 5-word shingles at 0.8: of each group one row stays, the one of the smallest id
    (null ids last; of several rows of that id one). Rows without words belong to no group and stay.

    Rows are numbered as they are written, so repeated and null ids are told apart."""
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, row, shingle=STAGE_SHINGLE, percent=STAGE_PERCENT, bands=STAGE_BANDS)
    ids = numbered.select(F.col(row).alias("n"), F.col("doc_id").cast("long").alias("id"))
    grouped = found.filter("n_shingles > 0").select(F.col("doc_id").alias("n"), F.col("component_id").alias("c")).join(ids, "n")
    first = grouped.groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "n")).alias("first"), F.count(F.lit(1)).alias("size"))
    lost = grouped.join(first.filter("size > 1"), "c").filter(F.col("n") != F.col("first.n")).select(F.col("n").alias(row))
    return numbered.join(lost, row, "left_anti").select(*docs.columns)


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
