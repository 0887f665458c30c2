"""Toxicity scores by non-negative positive-unlabelled learning.

Linear classifiers are trained in numpy from confirmed toxic examples (P) and
documents of the learning folds that have no label (U). With class prior ``pi`` the risk is
``pi R+_P + max(0, R-_U - pi R-_P)``, R+ and R- being mean logistic losses
towards the toxic and the clean side: U stands in for clean examples once the
toxic share hidden in it is taken out, and the bracket is kept from turning
negative (when it would, the step goes against it, which stops the classifier
from fitting single positives). ``pi`` is the share of toxic labels among the
labelled learning rows: labels are taken to cover the documents at random.

Features are presence of words and of word beginnings of 4 to 8 bytes, letters
only, A-Z lower-cased; nothing but the text enters a score. The features kept
are those far more frequent in P than in U (by z-score). ``models``
classifiers, each on its own share of the sample, train in separate tasks; their
weights are averaged.

Fitting uses a bounded sample (``max_positive``, ``max_unlabelled`` rows,
drawn by a hash of the id); scoring reads every whole text. The
model sent to the tasks has at most ``max_features`` weights.

Defined cases: null and empty texts get the score of no feature, below 0.5;
null ids count as text '' in the fold; repeated rows are scored each; of
several labels of one document the largest counts; where every learning document has a label, U is the
labelled ones with the label withheld; without any positive label
every score is 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize
from .wordtable import LETTERS, slices, words

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES, MODELS = 10_000, 30_000, 4096, 3
PREFIXES = (4, 5, 6, 7, 8)
#: A feature is kept if so many positives hold it and its z-score is at least this.
MIN_POSITIVE, MIN_Z = 3, 4.0
FOLDS = 5
#: Bytes of text that a worker turns into features at a time.
SLICE = 1 << 19


def features(texts: pa.Array):
    """(rows, feature hashes), with repeats."""
    w = words(texts, True, LETTERS, PREFIXES)
    row = w.row_of()
    rows, found = [row], [w.hashes]
    for h in w.prefixes:
        some = np.flatnonzero(h)
        rows.append(row[some])
        found.append(h[some])
    return np.concatenate(rows), np.concatenate(found)


def _featurize(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (example, positive, text) to (example, positive, distinct features)."""
    for part in parts:
        for first, texts in slices(part.column(2), SLICE):
            row, h = features(texts)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            row, h = row[new], h[new]
            bounds = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).slice(first, len(texts)), part.column(1).slice(first, len(texts)),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64)))], names=["example", "positive", "features"])


def train(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, n_columns: int, prior: float,
          steps: int = 300, rate: float = 0.1, decay: float = 1e-4):
    """Weights and bias of one classifier: full-batch Adam on the non-negative
    PU risk. (rows, columns) are the ones of the example x feature matrix."""
    w, m, v = np.zeros(n_columns + 1), np.zeros(n_columns + 1), np.zeros(n_columns + 1)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    p, u = positive, ~positive
    n_p, n_u, n = max(1, p.sum()), max(1, u.sum()), len(positive)
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[columns], n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        soft = np.logaddexp(0, z)  # loss towards clean; its slope is s
        bracket = soft[u].sum() / n_u - prior * soft[p].sum() / n_p
        g_clean = np.where(u, s / n_u, -prior * s / n_p)
        g_toxic = np.where(p, prior * (s - 1) / n_p, 0.0)
        g = g_toxic + g_clean if bracket >= 0 else -g_clean
        grad = np.append(np.bincount(columns, g[rows], n_columns), g.sum())
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], w[-1]


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_positive: int = MAX_POSITIVE,
        max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, models: int = MODELS):
    """(feature hashes ascending, weights, bias), from learning rows only."""
    learn = (labels.filter(fold(F.col("doc_id"), folds) != 0).filter("toxic is not null")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    prior = learn.agg(F.avg("toxic")).first()[0] or 0.0
    nothing = np.zeros(0, np.uint64), np.zeros(0), -30.0
    if prior <= 0:
        return nothing
    p = learn.filter("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(max_positive).select("doc_id", F.lit(True).alias("positive"))

    def drawn(ids: DataFrame) -> DataFrame:
        return ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_unlabelled).select("doc_id", F.lit(False).alias("positive"))

    u = materialize(drawn(docs.filter((fold(F.col("doc_id"), folds) != 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
                          .join(learn, "doc_id", "left_anti")), "unlabelled")
    if u.isEmpty():
        u = drawn(learn)
    chosen = F.broadcast(p.unionByName(u))  # at most max_positive + max_unlabelled ids
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("doc_id").alias("example"), "positive", "text")
    sample = materialize(rows.mapInArrow(_featurize, "example bigint, positive boolean, features array<bigint>"), "toxic-sample")
    counts = sample.groupBy("positive").count().collect()  # two rows
    n_p, n_u = (max(1, sum(r["count"] for r in counts if r["positive"] is side)) for side in (True, False))
    in_p, in_u = F.col("p") / F.lit(float(n_p)), (F.col("u") + 1) / F.lit(float(n_u + 1))
    z = (in_p - in_u) / F.sqrt(in_u * (1 - in_u) * (1 / n_p + 1 / n_u) + F.lit(1e-12))
    kept = (sample.select("positive", F.explode("features").alias("feature")).groupBy("feature")
            .agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
            .withColumn("z", z).filter((F.col("p") >= MIN_POSITIVE) & (F.col("z") >= MIN_Z)).orderBy(F.desc("z"), "feature").limit(max_features)
            .select("feature").collect())  # at most max_features
    if not kept:
        return nothing
    known = np.sort(np.array([r["feature"] for r in kept], np.int64).view(np.uint64))

    def prepare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column(2)
            n = np.diff(np.asarray(lists.offsets))
            h = np.asarray(lists.flatten()).view(np.uint64)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            ok = known[at] == h
            row = np.repeat(np.arange(len(n)), n)[ok]
            bounds = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(bounds), pa.array(at[ok].astype(np.int64)))],
                names=["example", "positive", "columns"])

    def one(rows):
        import pandas as pd

        n = rows["columns"].map(len).to_numpy()
        cols = np.concatenate(rows["columns"].tolist()).astype(np.int64) if n.sum() else np.zeros(0, np.int64)
        w, bias = train(np.repeat(np.arange(len(rows)), n), cols, rows["positive"].to_numpy(bool), len(known), prior)
        return pd.DataFrame({"column": np.arange(len(w) + 1), "weight": np.append(w, bias)})

    share = F.pmod(F.xxhash64("example", "positive", F.col("model")), F.lit(10)) < 8
    trained = (sample.mapInArrow(prepare, "example bigint, positive boolean, columns array<bigint>")
               .withColumn("model", F.explode(F.sequence(F.lit(1), F.lit(models)))).filter(share)
               .groupBy("model").applyInPandas(one, "column bigint, weight double")
               .groupBy("column").agg((F.sum("weight") / F.lit(float(models))).alias("weight")).collect())  # max_features + 1
    weights = np.zeros(len(known) + 1)
    for r in trained:
        weights[r["column"]] = r["weight"]
    return known, weights[:-1], float(weights[-1])


def _scorer(known: np.ndarray, weights: np.ndarray, bias: float):
    gate = np.zeros(1 << 16, bool)
    gate[(known >> np.uint64(48)).astype(np.int64)] = True

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, texts in slices(part.column(1), SLICE):
                z = np.full(len(texts), bias)
                if len(known):
                    row, h = features(texts)
                    some = np.flatnonzero(gate[(h >> np.uint64(48)).astype(np.int64)])
                    row, h = row[some], h[some]
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    ok = known[at] == h
                    pairs = np.unique(row[ok] * len(known) + at[ok])
                    z += np.bincount(pairs // len(known), weights[pairs % len(known)], len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(first, len(texts)), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model) -> DataFrame:
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_scorer(*model), "doc_id bigint, score double"))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
