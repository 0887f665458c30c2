"""Substring dedup by recompression.

Round 0 names runs of equal words, each later round names pairs: a symbol
whose name hashes to the left class merges with a right-class symbol that
follows it, until a document is one symbol or two that do not meet. A name is
a hash of what it replaces, so the same words get the same name in every
document, on any machine, and equal names stand for equal words.

Spark then resolves names over all documents, in two rounds.

1. *Symbols.* Every symbol of ``LONG`` words or more and the anchors of the
   windows (below) go with their document; a partial aggregate finds the least
   and greatest document of each name. A long symbol that a document with a
   smaller id also has covers its whole span: all windows inside it repeat,
   and none of them is looked at again. Since symbols nest, a copied passage is
   covered by a few symbols and a copied document by one.
2. *Edges.* Windows that no such symbol covers and whose anchor another document
   shares are named by two hashes of their 13 words and resolved to
   the least document that has them. A covered window need not be offered to
   others either: the symbol's least document offers it.

The anchor of a window is the symbol of smallest name among those of the highest of
the first ``ROUNDS`` rounds whose contexts lie in the window. A symbol's context
is the words that decided it (its own and those of neighbours that decided where
it begins and ends), so a window that holds a symbol's context holds that symbol
wherever it occurs; a window that holds none (long runs of one word) is its own
anchor. Equal windows have equal anchors, and equal words in their contexts, which the anchor's name takes in.

Scale: names are counted by partial aggregates, and the joins that bring shared
names and repeated windows back to documents are plain equi-joins, which
adaptive execution splits where one passage is in a third of all documents.
Lists are collected per document text only, and are never longer than it. Each
round's names are written to the shared folder, and its shuffles let go.

Defined cases: null and blank texts have no words and the digest of the empty
string; texts under 13 words keep all; rows of one id are one document, so
they do not remove each other's words; rows with a null id count as the last
document (any id is smaller); repeated rows are returned each; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .wordtable import Words, mix, slices, window_rows, windows, words

WINDOW = 13
#: Rounds whose symbols serve as anchors; their contexts fit into a window.
#: More of them make rarer anchors of more words, but a window then holds fewer to choose among.
ROUNDS = 2
#: Words of the shortest symbols that cover what they span.
LONG = 2 * WINDOW
#: Rounds at most; a document of a million words is mostly one symbol after 50.
MOST_ROUNDS = 64


class Symbols:
    """The symbols of one round over a slice: name, words [lo, hi), context [clo, chi), row."""

    def __init__(self, name, lo, hi, clo, chi, row) -> None:
        self.name, self.lo, self.hi, self.clo, self.chi, self.row = name, lo, hi, clo, chi, row

    @staticmethod
    def runs(w: Words) -> "Symbols":
        """Round 0. A run is decided by its words and one more on each side; at
        a text's edge that word is missing, and the context reaches outside."""
        n, row = len(w.hashes), w.row_of()
        first = np.ones(n, bool)
        first[1:] = (w.hashes[1:] != w.hashes[:-1]) | (row[1:] != row[:-1])
        lo = np.flatnonzero(first)
        hi = np.append(lo[1:], n)
        name = mix(w.hashes[lo] + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return Symbols(name, lo, hi, lo - 1, hi + 1, row[lo])

    def _meet(self, round_: int):
        """Which symbols are right ones, which stand in one row with the next, and first and last of each merged one."""
        n = len(self.name)
        right = (mix(self.name ^ np.uint64(round_ * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)).astype(bool)
        together = self.row[1:] == self.row[:-1]
        join = np.zeros(n, bool)  # merges with the next
        join[:-1] = together & ~right[:-1] & right[1:]
        joined = np.zeros(n, bool)  # merged into the one before
        joined[1:] = join[:-1]
        head = np.flatnonzero(~joined)
        return right, together, head, head + join[head]

    def _pair(self, head, tail, round_: int):
        return mix(self.name[head] * np.uint64(0xE7037ED1A0B428DB) + self.name[tail] + np.uint64(round_))

    def pairs(self, round_: int) -> "Symbols":
        """The next round with its contexts."""
        n = len(self.name)
        if n < 2:
            return self
        right, together, head, tail = self._meet(round_)
        # a left symbol that stays alone depends on what follows, a right one on what precedes
        clo, chi = self.clo.copy(), self.chi.copy()
        prev_lo, next_hi = self.lo - 1, self.hi + 1
        prev_lo[1:][together] = self.clo[:-1][together]
        next_hi[:-1][together] = self.chi[1:][together]
        clo = np.where(right, np.minimum(clo, prev_lo), clo)
        chi = np.where(~right, np.maximum(chi, next_hi), chi)
        alone = tail == head
        return Symbols(
            np.where(alone, self.name[head], self._pair(head, tail, round_)), self.lo[head], self.hi[tail],
            np.where(alone, clo[head], np.minimum(self.clo[head], self.clo[tail])),
            np.where(alone, chi[head], np.maximum(self.chi[head], self.chi[tail])), self.row[head])


def first_rounds(w: Words, rounds: int = ROUNDS) -> list[Symbols]:
    levels = [Symbols.runs(w)]
    for r in range(1, rounds + 1):
        levels.append(levels[-1].pairs(r))
    return levels


def long_symbols(levels: list[Symbols], long: int):
    """(name, lo, hi, row) of the runs and pairs of ``long`` words or more, of
    the given rounds and all that follow, until nothing is left to merge."""
    found = []

    def add(s: Symbols, new) -> None:
        at = np.flatnonzero(new & (s.hi - s.lo >= long))
        if len(at):
            found.append((mix(s.name[at] ^ np.uint64(0x9E3779B97F4A7C15)), s.lo[at], s.hi[at], s.row[at]))

    add(levels[0], np.ones(len(levels[0].name), bool))
    for before, s in zip(levels, levels[1:]):
        if len(s.name) < len(before.name):
            add(s, s.hi != before.hi[np.searchsorted(before.lo, s.lo)])
    s, r = levels[-1], len(levels)
    while r <= MOST_ROUNDS and len(s.name) > 1 and (s.row[1:] == s.row[:-1]).any():
        _, _, head, tail = s._meet(r)
        new = tail != head
        s = Symbols(np.where(new, s._pair(head, tail, r), s.name[head]), s.lo[head], s.hi[tail], None, None, s.row[head])
        add(s, new)
        r += 1
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def _range_hashes(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> np.ndarray:
    """A hash of the words of each [lo, hi), of ``most`` words at most."""
    out = (hi - lo).astype(np.uint64)
    for i in range(most):
        at = lo + i
        out = np.where(at < hi, out * np.uint64(0xD1B54A32D192ED03) + hashes[np.minimum(at, len(hashes) - 1)], out)
    return out


def window_anchors(w: Words, window: int = WINDOW, rounds: int = ROUNDS, levels: list[Symbols] | None = None):
    """(starts, rows, anchors) of all windows of the slice."""
    start, row = window_rows(w.rows, window)
    if not len(start):
        return start, row, np.zeros(0, np.uint64)
    levels = levels or first_rounds(w, rounds)
    anchor = windows(w.hashes, window, 7)[start]
    todo = np.arange(len(start))
    for level in range(rounds, -1, -1):
        s = levels[level]
        at = start[todo]
        a = np.searchsorted(np.maximum.accumulate(s.clo), at, "left")  # contexts that begin in the window
        b = np.searchsorted(np.maximum.accumulate(s.chi), at + window, "right")  # and end in it
        some = a < b
        a, b = a[some], b[some]
        best = a.copy()
        step = 1
        while True:
            more = a + step < b
            if not more.any():
                break
            other = np.minimum(a + step, len(s.name) - 1)
            best = np.where(more & (s.name[other] < s.name[best]), other, best)
            step += 1
        if len(best):  # neighbouring windows mostly have the same anchor
            new = np.ones(len(best), bool)
            new[1:] = best[1:] != best[:-1]
            key = mix(_range_hashes(w.hashes, s.clo[best[new]], s.chi[best[new]], window) ^ mix(s.name[best[new]] + np.uint64(level + 1)))
            anchor[todo[some]] = key[np.cumsum(new) - 1]
        todo = todo[~some]
        if not len(todo):
            break
    return start, row, anchor


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _changes(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a (row, key) differs from the one before."""
    new = np.ones(len(row), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return new


def _names(window: int, rounds: int, long: int):
    """(name, covers, id, text key) of the long symbols and the anchors of each row."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, texts in slices(part.column(2)):
                w = words(texts, False)
                if not len(w.hashes):
                    continue
                levels = first_rounds(w, rounds)
                name, _, _, row = long_symbols(levels, long)
                _, wrow, anchor = window_anchors(w, window, rounds, levels)
                at = _changes(wrow, anchor)
                rows = pa.array(first + np.concatenate([row, wrow[at]]))
                covers = np.zeros(len(rows), bool)
                covers[:len(row)] = True
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate([name, anchor[at]])), pa.array(covers), part.column(0).take(rows), part.column(1).take(rows)],
                    names=["name", "covers", "d", "h"])
    return run


def _in_lists(row: np.ndarray, key: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each (row, key) is in the row's list of int64."""
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    have = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
    salt = mix(np.arange(1, len(lists) + 1, dtype=np.uint64))
    return np.isin(key ^ salt[row], have ^ np.repeat(salt, n))


def _window_keys(w: Words, window: int, start: np.ndarray):
    return windows(w.hashes, window, 0)[start], windows(w.hashes, window, 1)[start]


def _joined(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """One 64-bit key of both hashes; a document's own windows are few, so it tells them apart by itself."""
    return mix(k1 * np.uint64(0xA0761D6478BD642F) + k2)


def _edges(window: int, rounds: int, long: int):
    """Per row with shared names: one row with the spans [from, to) of its covered words (``at`` counted
    from its first word), and one per window to check."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, texts in slices(part.column(2)):
                w = words(texts, False)
                if not len(w.hashes):
                    continue
                lists = part.column(3).slice(first, len(texts))
                levels = first_rounds(w, rounds)
                name, lo, hi, srow = long_symbols(levels, long)
                hit = _in_lists(srow, name, lists)
                lo, hi, srow = lo[hit], hi[hit], srow[hit]
                start, row, anchor = window_anchors(w, window, rounds, levels)
                # a window is covered if one symbol holds it: it starts in [lo, hi - window]
                inside = np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(inside, lo, 1)
                np.add.at(inside, hi - window + 1, -1)
                open_ = (np.cumsum(inside)[:-1] == 0)[start]
                start, row, anchor = start[open_], row[open_], anchor[open_]
                new = _changes(row, anchor)
                check = _in_lists(row[new], anchor[new], lists)[np.cumsum(new) - 1] if len(new) else new
                start, row = start[check], row[check]
                k1, k2 = _window_keys(w, window, start) if len(start) else (np.zeros(0, np.uint64),) * 2
                # of nested spans the outermost are enough
                by = np.lexsort((-hi, lo))
                lo, hi, srow = lo[by], hi[by], srow[by]
                outer = np.ones(len(lo), bool)
                outer[1:] = hi[1:] > np.maximum.accumulate(hi)[:-1]
                lo, hi, srow = lo[outer] - w.rows[srow[outer]], hi[outer] - w.rows[srow[outer]], srow[outer]
                rows = pa.array(first + np.concatenate([srow, row]))
                covers = np.zeros(len(rows), bool)
                covers[:len(lo)] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([lo.astype(np.int64), k1.view(np.int64)])),
                     pa.array(np.concatenate([hi.astype(np.int64), _joined(k1, k2).view(np.int64)])), pa.array(covers),
                     part.column(0).take(rows), part.column(1).take(rows)], names=["a", "b", "covers", "d", "h"])
    return run


def _keep(window: int):
    """Drops the words under the row's spans (from, to in turn) and under its windows of the listed keys."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, texts in slices(part.column(1)):
                w = words(texts, False)
                n = np.diff(w.rows)
                gone = np.zeros(len(w.hashes) + 1, np.int64)
                spans, keys = (part.column(i).slice(first, len(texts)) for i in (2, 3))
                if spans.null_count < len(spans):
                    size = pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False)
                    flat = spans.flatten()
                    base = np.repeat(w.rows[:-1], size)
                    np.add.at(gone, base + np.asarray(flat.field(0)).astype(np.int64), 1)
                    np.add.at(gone, base + np.asarray(flat.field(1)).astype(np.int64), -1)
                if keys.null_count < len(keys):
                    start, row = window_rows(w.rows, window)
                    has = keys.is_valid().to_numpy(zero_copy_only=False)[row]
                    start, row = start[has], row[has]
                    if len(start):
                        k1, k2 = _window_keys(w, window, start)
                        hit = start[_in_lists(row, _joined(k1, k2), keys)]
                        np.add.at(gone, hit, 1)
                        np.add.at(gone, hit + window, -1)
                keep = np.cumsum(gone)[:-1] == 0
                removed = n - np.add.reduceat(np.append(keep, 0), w.rows[:-1]) * (n > 0) if len(n) else n
                digests = []
                raw = w.raw.tobytes()
                for i, lost in enumerate(removed.tolist()):
                    ws = raw[w.texts[i]:w.texts[i + 1]].split()
                    if lost:
                        ws = compress(ws, keep[w.rows[i]:w.rows[i + 1]].tolist())
                    digests.append(hashlib.sha256(b" ".join(ws)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(first, len(texts)), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)),
                     pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
    return run


def _owned(rows: DataFrame, by: list[str]) -> DataFrame:
    """Names that two documents share: ``lo``, the least id that has one. A null id is greater than any."""
    return (rows.groupBy(*by).agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max(F.col("d").isNull()).alias("last"))
            .filter((F.col("lo") < F.col("hi")) | (F.col("last") & F.col("lo").isNotNull())).select(*by, "lo"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS,
          long: int = LONG) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one per row of docs."""
    long = max(window, long)
    text = F.col(text_col)
    # rows are met again by id and text: rows of one id, or without any, are not gathered under one key
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text, F.length(text)).alias("h"), text.alias("text"))
    smaller = F.col("d").isNull() | (F.col("lo") < F.col("d"))

    names = materialize(rows.mapInArrow(_names(window, rounds, long), "name bigint, covers boolean, d bigint, h bigint"), "names")
    # owners are tables of their own: a name in a third of all documents is then a skewed join, which is split
    owners = materialize(_owned(names, ["name"]), "owners", release=True)
    shared = materialize(names.join(owners, "name").filter(~F.col("covers") | smaller)
                         .groupBy("d", "h").agg(F.collect_set("name").alias("names")), "shared", release=True)
    discard(names)
    discard(owners)

    def meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed({"d": "_d", "h": "_h"})
        return left.join(right, F.col("h").eqNullSafe(F.col("_h")) & F.col("d").eqNullSafe(F.col("_d")), how).drop("_d", "_h")

    edges = materialize(meet(rows, shared, "inner").select("d", "h", "text", "names")
                        .mapInArrow(_edges(window, rounds, long), "a bigint, b bigint, covers boolean, d bigint, h bigint"), "edges", release=True)
    discard(shared)
    spans, seen = edges.filter("covers"), edges.filter("not covers")
    first = materialize(_owned(seen, ["a", "b"]), "owners", release=True)
    again = seen.join(first, ["a", "b"]).filter(smaller)
    gone = materialize(
        spans.select("d", "h", F.struct("a", "b").alias("span"), F.lit(None).cast("long").alias("key"))
        .unionByName(again.select("d", "h", F.lit(None).cast("struct<a: bigint, b: bigint>").alias("span"), F.col("b").alias("key")))
        .groupBy("d", "h").agg(F.collect_set("span").alias("spans"), F.collect_set("key").alias("keys")), "gone", release=True)
    discard(edges)
    discard(first)
    none = F.size("keys") == 0
    return (meet(rows, gone, "left").select(F.col("d").alias("doc_id"), "text", "spans", F.when(~none, F.col("keys")).alias("keys"))
            .mapInArrow(_keep(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"))


def op5(docs: DataFrame) -> DataFrame:
    return dedup(docs)
