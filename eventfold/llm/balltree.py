"""Ranked lexical search by a sparse ball tree, exact.

A document is the sparse vector of its integer term values
``(10^9 tf) div (1000 tf + 8 m)``, a query that of its term weights times their
repeats, and the score their inner product. Only terms of the queries matter,
so vectors are kept in that space.

Index: documents are ranged by their heaviest terms and a hash (so a term or
text that a third of them share is spread) and cut into subtrees of at most
``SUBTREE`` documents. A subtree is a ball tree: a node holds the centroid of
its documents and a radius, the greatest distance from it; it is split between
two far documents, by halves, down to ``LEAF``. A subtree is one row of a table
in the shared folder: bounded, whatever the corpus.

Search: ``q.x <= q.c + |q'| r`` for every document of a node, q' being the query on the
centroid's terms (the node's documents have no others). All float steps
are rounded up by more than their error (``_up``), leaves are scored in 64-bit
integers, and a node is left out only if its bound is below the tenth score
known so far; a node that may tie is opened. Wave one opens, for each query,
the one subtree with the highest bound, which gives a first threshold; wave
two opens every subtree whose root may still reach it, best node first. A task
keeps ten documents a query over all its subtrees, so candidates are ten a task at
most, however many documents tie.

Queries are taken in blocks of ``BLOCK``, each against all documents, so
the driver and a task hold one block's vectors.

Terms are told apart by 64-bit hashes. Defined cases: null and blank texts
have no terms, and a document without terms is not counted and not found;
repeated rows are documents each, of equal scores the smaller doc_id comes
first, null ids last; each row of the query table is a query, null and repeated ids included; an
empty table or a query without known terms gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .wordtable import slices, words

TOP, BLOCK, SUBTREE, LEAF = 10, 1024, 4096, 64
#: Bytes of a term: 0-9, A-Z, a-z and those of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: A null id is ordered after all others.
NULL_LAST = (1 << 63) - 1


def _up(x):
    """At least ``x`` as an exact sum of up to 10^9 products would be."""
    return x * (1 + 2.0 ** -20) + 2.0 ** -20


def _bound(query: np.ndarray, centre: np.ndarray, radius: float) -> float:
    """No document of the ball scores more; ``query`` on the terms of ``centre``."""
    return _up(float(query @ centre) + math.sqrt(_up(float(query @ query))) * radius)


class Queries:
    """One block of queries: its terms (hashes, ascending), and per query the term numbers and their repeats."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        w = words(pa.array([t for _, t in items], pa.string()), True, TERM)
        self.items = [i for i, _ in items]
        self.terms, at = np.unique(w.hashes, return_inverse=True)
        self.terms_of, self.repeats = [], []
        for lo, hi in zip(w.rows[:-1].tolist(), w.rows[1:].tolist()):
            t, n = np.unique(at[lo:hi], return_counts=True)
            self.terms_of.append(t)
            self.repeats.append(n)


def _counter(terms: np.ndarray):
    """Rows (doc_id, text) to (doc_id, n, terms, tf): all terms counted, those of the block listed."""
    gate = np.zeros(1 << 16, bool)
    gate[(terms >> np.uint64(48)).astype(np.int64)] = True

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, texts in slices(part.column(1), 1 << 20):
                w = words(texts, True, TERM)
                some = np.flatnonzero(gate[(w.hashes >> np.uint64(48)).astype(np.int64)])
                h, row = w.hashes[some], np.searchsorted(w.rows, some, "right") - 1
                at = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
                ok = terms[at] == h if len(terms) else np.zeros(0, bool)
                code, tf = np.unique(row[ok] * (len(terms) + 1) + at[ok], return_counts=True)
                bounds = pa.array(np.searchsorted(code // (len(terms) + 1), np.arange(len(texts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(first, len(texts)), pa.array(np.diff(w.rows).astype(np.int64)),
                     pa.ListArray.from_arrays(bounds, pa.array((code % (len(terms) + 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int64)))], names=["doc_id", "n", "terms", "tf"])
    return run


def _placer(weight: np.ndarray):
    """Adds the two terms with the greatest weighted values to rows (doc_id, terms, vals)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            terms, vals = part.column(1), part.column(2)
            size = np.diff(np.asarray(terms.offsets))
            cols, row = np.asarray(terms.flatten()), np.repeat(np.arange(len(size)), size)
            order = np.lexsort((cols, -weight[cols] * np.asarray(vals.flatten()), row))
            at = np.concatenate([[0], np.cumsum(size)])[:-1]
            first, second = order[at] if len(size) else at, order[at + np.minimum(1, size - 1)] if len(size) else at
            yield pa.RecordBatch.from_arrays([part.column(0), terms, vals, pa.array(cols[first], pa.int32()), pa.array(cols[second], pa.int32())],
                                             names=["doc_id", "terms", "vals", "t1", "t2"])
    return run


class Sparse:
    """Rows of a sparse integer matrix."""

    def __init__(self, bounds: np.ndarray, cols: np.ndarray, values: np.ndarray) -> None:
        self.bounds, self.cols, self.values = bounds, cols, values

    def take(self, rows: np.ndarray) -> "Sparse":
        size = np.diff(self.bounds)[rows]
        bounds = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.bounds[rows] - bounds[:-1], size) + np.arange(bounds[-1])
        return Sparse(bounds, self.cols[at], self.values[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Inner product of every row with a dense vector (rows are not empty)."""
        return np.add.reduceat(self.values * dense[self.cols], self.bounds[:-1]) if len(self.cols) else np.zeros(0, dense.dtype)


def build(x: Sparse, width: int, leaf: int = LEAF):
    """(order of the rows, nodes): a ball tree over the rows of ``x``. A node is
    (left child or -1, right child, first row, end row, centroid columns, centroid values, radius)."""
    n = len(x.bounds) - 1
    square = np.add.reduceat(x.values.astype(float) ** 2, x.bounds[:-1])
    order, nodes, dense = np.arange(n), [], np.zeros(width)
    todo = [(0, n, -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        rows = order[lo:hi]
        part = x.take(rows)
        cols, inverse = np.unique(part.cols, return_inverse=True)
        centre = np.bincount(inverse, part.values, len(cols)) / (hi - lo)

        def distances(c, v):
            dense[c] = v
            d = square[rows] - 2 * part.dot(dense) + float(v @ v)
            dense[c] = 0
            return d

        far = distances(cols, centre)
        # the squares' float error is far below 2^-30 of the greatest term
        size = float(np.max(square[rows]) + centre @ centre)
        radius = _up(math.sqrt(max(0.0, float(far.max())) + size * 2.0 ** -30))
        here = len(nodes)
        nodes.append([-1, -1, lo, hi, cols, centre, radius])
        if parent >= 0:
            nodes[parent][side] = here
        if hi - lo > leaf:
            def row(i):
                s = slice(part.bounds[i], part.bounds[i + 1])
                return part.cols[s], part.values[s].astype(float)

            a = int(far.argmax())
            from_a = distances(*row(a))
            from_b = distances(*row(int(from_a.argmax())))
            split = np.argsort(from_a - from_b, kind="stable")
            order[lo:hi] = rows[split]
            middle = (lo + hi) // 2
            todo += [(middle, hi, here, 1), (lo, middle, here, 0)]
    return order, nodes


_TREE = ("subtree string, root_cols array<int>, root_values array<double>, root_radius double, doc_ids array<bigint>, has_id array<boolean>, "
         "bounds array<int>, cols array<int>, vals array<bigint>, left array<int>, right array<int>, first array<int>, end array<int>, "
         "radius array<double>, c_bounds array<int>, c_cols array<int>, c_values array<double>")
_KINDS = {"string": pa.string(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
          "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
_FIELDS = [tuple(c.split(" ")) for c in _TREE.split(", ")]


def _indexer(width: int, subtree: int, leaf: int):
    """Rows (doc_id, terms, values) to subtrees."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held = TaskContext.get(), 0, []
        for part in parts:
            held.append(part.combine_chunks() if hasattr(part, "combine_chunks") else part)
            while sum(map(len, held)) >= subtree:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield tree(rows.slice(0, subtree), f"{task.partitionId()}-{made}")
                made, held = made + 1, [rows.slice(subtree)] if len(rows) > subtree else []
        if sum(map(len, held)):
            yield tree(pa.Table.from_batches(held).combine_chunks().to_batches()[0], f"{task.partitionId()}-{made}")

    def tree(rows: pa.RecordBatch, name: str) -> pa.RecordBatch:
        size = np.array([len(v) for v in rows.column(1)], np.int64)
        x = Sparse(np.concatenate([[0], np.cumsum(size)]), np.asarray(rows.column(1).flatten()).astype(np.int64),
                   np.asarray(rows.column(2).flatten()).astype(np.int64))
        order, nodes = build(x, width, leaf)
        x = x.take(order)
        ids = rows.column(0).take(pa.array(order))
        left, right, first, end, cols, values, radius = zip(*nodes)
        out = {"subtree": name, "root_cols": cols[0], "root_values": values[0], "root_radius": radius[0],
               "doc_ids": ids.fill_null(0).to_numpy(zero_copy_only=False), "has_id": ids.is_valid().to_numpy(zero_copy_only=False),
               "bounds": x.bounds, "cols": x.cols, "vals": x.values, "left": left, "right": right, "first": first, "end": end,
               "radius": radius, "c_bounds": np.concatenate([[0], np.cumsum([len(c) for c in cols])]),
               "c_cols": np.concatenate(cols), "c_values": np.concatenate(values)}
        return pa.RecordBatch.from_arrays([pa.array([out[n]], _KINDS[k]) for n, k in _FIELDS], names=[n for n, _ in _FIELDS])
    return run


class Block:
    """Query vectors of a block: shipped to the tasks."""

    def __init__(self, queries: Queries, weight: np.ndarray) -> None:
        self.width = len(weight)
        self.cols, self.values = [], []
        for t, n in zip(queries.terms_of, queries.repeats):
            q = weight[t] * n
            self.cols.append(t[q > 0])
            self.values.append(q[q > 0])

    def loaded(self, i: int, dense: np.ndarray):
        dense[self.cols[i]] = self.values[i]

    def unloaded(self, i: int, dense: np.ndarray):
        dense[self.cols[i]] = 0


def _roots(block: Block):
    """Per task and query, the subtree with the highest bound: rows (item, subtree, bound)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, str]] = {}
        for part in parts:
            for r in range(len(part)):
                name, radius = part.column(0)[r].as_py(), part.column(3)[r].as_py()
                cols, values = np.asarray(part.column(1)[r].values), np.asarray(part.column(2)[r].values)
                for i, (c, v) in enumerate(zip(block.cols, block.values)):
                    at = np.minimum(np.searchsorted(cols, c), len(cols) - 1)
                    here = cols[at] == c
                    if here.any():
                        bound = _bound(v[here].astype(float), values[at[here]], radius)
                        best[i] = max(best.get(i, (-1.0, "")), (bound, name))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([n for _, n in best.values()], pa.string()),
                                          pa.array([b for b, _ in best.values()], pa.float64())], names=["item", "subtree", "bound"])
    return run


def search(tree: dict, block: Block, items: list[int], floors: dict[int, int], tops: dict[int, list], top: int = TOP) -> int:
    """Best-first search of one subtree for each of ``items``. ``tops`` holds, per
    query, a heap of the best (score, -id order, row) so far, ``floors`` scores that the
    tenth is known to reach. Returns the number of documents scored."""
    x = Sparse(tree["bounds"].astype(np.int64), tree["cols"], tree["vals"])
    ids = np.where(tree["has_id"], tree["doc_ids"], NULL_LAST)
    c_bounds, radius, left, right = tree["c_bounds"], tree["radius"], tree["left"], tree["right"]
    centre, whole, scored = np.zeros(block.width), np.zeros(block.width, np.int64), 0
    for i in items:
        if not len(block.cols[i]):
            continue
        heap = tops.setdefault(i, [])
        block.loaded(i, centre)
        block.loaded(i, whole)

        def bound(node):
            s = slice(c_bounds[node], c_bounds[node + 1])
            return _bound(centre[tree["c_cols"][s]], tree["c_values"][s], float(radius[node]))

        def least():
            return max(floors.get(i, 1), heap[0][0] if len(heap) == top else 1)

        open_ = [(-bound(0), 0)]
        while open_ and -open_[0][0] >= least():
            _, node = heapq.heappop(open_)
            if left[node] >= 0:
                for child in (int(left[node]), int(right[node])):
                    b = bound(child)
                    if b >= least():
                        heapq.heappush(open_, (-b, child))
                continue
            lo, hi = int(tree["first"][node]), int(tree["end"][node])
            a, z = int(x.bounds[lo]), int(x.bounds[hi])
            scores = np.add.reduceat(x.values[a:z] * whole[x.cols[a:z]], x.bounds[lo:hi] - a)
            scored += hi - lo
            for j in np.flatnonzero(scores >= least()).tolist():
                entry = (int(scores[j]), -int(ids[lo + j]), bool(tree["has_id"][lo + j]))
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        block.unloaded(i, centre)
        block.unloaded(i, whole)
    return scored


def _trees(part: pa.RecordBatch) -> Iterator[dict]:
    for r in range(len(part)):
        yield {n: np.asarray(part.column(n)[r].values) if k.startswith("array") else part.column(n)[r].as_py() for n, k in _FIELDS}


def _emit(tops: dict[int, list]) -> pa.RecordBatch:
    rows = [(i, None if not has else -order, score) for i, heap in tops.items() for score, order, has in heap]
    item, doc, score = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                      names=["item", "doc_id", "score"])


def _searcher(block: Block, floors: dict[int, int], chosen: bool):
    """Subtrees to the ten best documents of a task per query; if ``chosen``, a column names the queries to search for."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, list] = {}
        everyone = list(range(len(block.cols)))
        for part in parts:
            for r, tree in enumerate(_trees(part)):
                search(tree, block, part.column("items")[r].as_py() if chosen else everyone, floors, tops)
        yield _emit(tops)
    return run


_FOUND = "item bigint, doc_id bigint, score bigint"


def _best(found: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search_block(docs: DataFrame, items: list[tuple[int | None, str | None]], id_col: str, text_col: str, subtree: int,
                  leaf: int) -> DataFrame | None:
    spark, queries = docs.sparkSession, Queries(items)
    counted = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                          .mapInArrow(_counter(queries.terms), "doc_id bigint, n bigint, terms array<int>, tf array<bigint>"), "term-counts")
    n_docs, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    weight = np.zeros(len(queries.terms), np.int64)  # of a term that no document holds: it adds nothing
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most one row per term of the block
        weight[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    block = Block(queries, weight)

    # values and, as a document's place, its two heaviest terms, a hash and (for rows equal in all) its row
    value = f"transform(tf, x -> (1000000000L * x) div (1000L * x + 8L * (25L + (75L * n * {n_docs}L) div {total}L)))"
    vectors = (counted.filter(F.size("terms") > 0).select("doc_id", "terms", F.expr(value).alias("vals"))
               .mapInArrow(_placer(weight), "doc_id bigint, terms array<int>, vals array<bigint>, t1 int, t2 int")
               .withColumn("h", F.xxhash64("doc_id", "terms", "vals")).withColumn("salt", F.monotonically_increasing_id()))
    place = ["t1", "t2", "h", "salt"]
    trees = materialize(vectors.repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "terms", "vals")
                        .mapInArrow(_indexer(block.width, subtree, leaf), _TREE), "ball-trees")

    start = (trees.select("subtree", "root_cols", "root_values", "root_radius")
             .mapInArrow(_roots(block), "item bigint, subtree string, bound double")
             .groupBy("item").agg(F.max_by("subtree", F.struct("bound", "subtree")).alias("subtree"))
             .groupBy("subtree").agg(F.collect_list("item").alias("items")))  # at most BLOCK items
    first = trees.join(start, "subtree").mapInArrow(_searcher(block, {}, True), _FOUND)
    floors = {r["item"]: r["score"] for r in _best(first, TOP).filter(F.col("rank") == TOP).select("item", "score").collect()}
    found = materialize(trees.mapInArrow(_searcher(block, floors, False), _FOUND), "found")
    names = spark.createDataFrame([(i, v) for i, v in enumerate(queries.items)], "item bigint, item_id bigint")
    return _best(found, TOP).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   query_col: str = "text", block: int = BLOCK, subtree: int = SUBTREE, leaf: int = LEAF) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ten best documents of every row of ``items``."""
    spark, out, held = docs.sparkSession, None, []

    def flush(out):
        found = _search_block(docs, held, id_col, text_col, subtree, leaf)
        return found if out is None else out if found is None else out.unionByName(found)

    for r in items.select(F.col(item_col).cast("long").alias("i"), F.col(query_col).alias("t")).toLocalIterator():
        held.append((r["i"], r["t"]))
        if len(held) == block:
            out, held = flush(out), []
    if held:
        out = flush(out)
    return out if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


def op13(docs: DataFrame, items: DataFrame) -> DataFrame:
    return rank_documents(docs, items)


OP13_SQL = r"""
WITH terms AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS list
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, row_id, list, len(list)::BIGINT AS n FROM terms WHERE len(list) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM docs),
queries AS (
  SELECT item_id, row_number() OVER () AS item_row,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS list
  FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT item_id, item_row, term, count(*)::BIGINT AS repeats
          FROM (SELECT item_id, item_row, unnest(list) AS term FROM queries) GROUP BY ALL),
held AS (SELECT row_id, term, count(*)::BIGINT AS tf FROM (SELECT row_id, unnest(list) AS term FROM docs)
         WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM held, totals GROUP BY term),
scored AS (
  SELECT item_id, item_row, row_id,
         sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN docs USING (row_id), totals
  GROUP BY ALL),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored JOIN docs USING (row_id) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
