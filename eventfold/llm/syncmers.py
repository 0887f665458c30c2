"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor (a closed syncmer) when the smallest of
its inner s-mers, by hash, stands first or last in it. Whether a k-mer is an
anchor depends on nothing outside it, so equal passages have equal anchors
wherever they stand, and two anchors at most k - s code points apart follow
each other in any text.

A fingerprint holds every anchor of a text, told apart by 32 bits of its hash,
at its first position and in the order of the text. Two fingerprints are matched
by position: the anchors that both texts hold are strung into the longest chain
that runs forward in both (``aligned``). ``likeness`` is the chain's share of the
anchors of either text: 1 for equal texts, the Jaccard similarity of the anchor
sets where shared passages keep their order, less where they are shuffled.

The edited text of a document joins its front to the front of the next one in
descending id order. Documents fall into ranges of that order (rows of one id, or
without one, by a hash of their text, so that they too fall into several ranges).
The first document of a range also goes, as its end, to the range before; the first
range's to the last. Each task then walks its range and meets every pair; nothing
but the texts is shuffled, and the fingerprints, larger than the texts, go straight
to the output.

Defined cases: null text is empty; an empty text has no anchors and its
likeness is 1 to an empty text, 0 to any other; a text shorter than k is one
anchor, itself; null ids come after all others, repeated ids follow each other
by text hash, and a table of one row has itself as next. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, S = 16, 9
#: Anchors in a fingerprint: all.
KEPT = sys.maxsize


def _mix(h):
    """A finalizer of 64-bit values (splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _windows(values, n: int, odd: int):
    """Hashes of all runs of n values."""
    out = np.zeros(len(values) - n + 1, np.uint64)
    for i in range(n):
        out *= np.uint64(odd)
        out += values[i:len(values) - n + 1 + i]
    return _mix(out)


def anchors(text: str, k: int = K, s: int = S):
    """(hashes, positions) of the closed syncmers of a text, as numpy arrays."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(points) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = _mix(points + np.uint64(0x9E3779B97F4A7C15))
    if len(points) < k:
        return _windows(points, len(points), 0xD1B54A32D192ED03), np.zeros(1, np.int64)
    inner = _windows(points, s, 0xD1B54A32D192ED03)
    w, n = k - s + 1, len(points) - k + 1  # s-mers in a k-mer, k-mers
    least, span = inner, 1  # running minimum, doubling its span
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[w - span:w - span + n])
    at = np.flatnonzero((inner[:n] == least) | (inner[w - 1:w - 1 + n] == least))
    # the k-mer's hash from its two outer and a middle s-mer covers all its code points when 2 s >= k
    whole = _mix(inner[at] * np.uint64(0x9E3779B97F4A7C15) + inner[at + w - 1])
    return whole, at.astype(np.int64)


class Fingerprint(NamedTuple):
    """The anchors of a text in the order of their positions; ``full`` if it has more than were kept."""

    hashes: np.ndarray
    positions: np.ndarray
    full: bool

    def pack(self) -> bytes:
        """The hashes, then the gaps between positions byte by byte, lowest bytes first, then a byte for ``full``."""
        gaps = np.diff(self.positions, prepend=0).astype("<u4")
        return self.hashes.astype("<u4").tobytes() + gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + bytes([self.full])


def sample(hashes: np.ndarray, positions: np.ndarray, kept: int = KEPT) -> Fingerprint:
    """The anchors, each at its first position; with ``kept`` so many of least hash."""
    values, first = np.unique((hashes >> np.uint64(32)).astype(np.uint32), return_index=True)
    full = len(values) > kept
    order = np.argsort(first[:kept])
    return Fingerprint(values[:kept][order], positions[first[:kept][order]], full)


def fingerprint(text: str) -> Fingerprint:
    return sample(*anchors(text))


def _common(a: Fingerprint, b: Fingerprint):
    """(places in a, places in b, anchors of either) under the threshold of both, places in a's order."""
    limit = min([int(f.hashes.max()) for f in (a, b) if f.full], default=None)
    if limit is None:
        n = len(a.hashes) + len(b.hashes)
    else:
        n = np.count_nonzero(a.hashes <= limit) + np.count_nonzero(b.hashes <= limit)
    _, at_a, at_b = np.intersect1d(a.hashes, b.hashes, assume_unique=True, return_indices=True)
    order = np.argsort(at_a)
    return at_a[order], at_b[order], int(n) - len(order)


def _forward(places: np.ndarray) -> bool:
    """Whether all places stand in order: they are one chain then."""
    return bool((places[1:] > places[:-1]).all())


def aligned(a: Fingerprint, b: Fingerprint) -> list[tuple[int, int]]:
    """The longest chain of shared anchors that runs forward in both texts, as (position in a, position in b)."""
    at_a, at_b, _ = _common(a, b)
    if _forward(at_b):
        return list(zip(a.positions[at_a].tolist(), b.positions[at_b].tolist()))
    ends, last, before = [], [], []  # per chain length: least place in b, its match; per match: the one before
    for i, x in enumerate(at_b.tolist()):
        n = bisect_left(ends, x)
        ends[n:n + 1], last[n:n + 1] = [x], [i]
        before.append(last[n - 1] if n else -1)
    chain, i = [], last[-1] if last else -1
    while i >= 0:
        chain.append((int(a.positions[at_a[i]]), int(b.positions[at_b[i]])))
        i = before[i]
    return chain[::-1]


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    _, at_b, either = _common(a, b)
    if not either:
        return 1.0
    if _forward(at_b):
        return len(at_b) / either
    ends: list[int] = []  # the length of the longest chain alone
    for x in at_b.tolist():
        n = bisect_left(ends, x)
        ends[n:n + 1] = [x]
    return len(ends) / either


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
           "near_edited double, near_next double")
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
_ARROW = [_TYPES[c.split()[1]] for c in _SCHEMA.split(", ")]
#: Bytes of texts in a range, and of fingerprints in a batch of rows.
RANGE_BYTES, BATCH_BYTES = 1 << 24, 1 << 23


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _ARROW)], names=_NAMES)


def _compare(doc_id, text: str, own: Fingerprint, following: str, following_print: Fingerprint) -> tuple:
    new = edited(text, following)
    new_print = fingerprint(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.pack(), new_print.pack(),
            likeness(own, new_print), likeness(own, following_print))


def _walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each document with the next of its range. The range's end (``end``) is the first of another; of several
    equal ones the first counts."""
    last, out, size = None, [], 0
    for part in parts:
        for doc_id, text, end in zip(*(c.to_pylist() for c in part.columns)):
            if end and last is None:
                continue
            own = fingerprint(text)
            if last is not None:
                out.append(_compare(*last, text, own))
                size += len(out[-1][3]) + len(out[-1][4])
                if size >= BATCH_BYTES:
                    yield _batch(out)
                    out, size = [], 0
            last = None if end else (doc_id, text, own)
    if out:
        yield _batch(out)


class _Ranges:
    """Ranges of the order (id falling, those without id last, then text hash). Ids are cut at ``cuts``, which fall; an id that
    is there n times is cut n times more, at even steps of the hash, and so are the rows without id, into ``blank`` ranges."""

    def __init__(self, cuts: list[int], blank: int) -> None:
        self.cuts, self.blank = np.array(cuts[::-1], np.int64), blank

    def __len__(self) -> int:
        return len(self.cuts) + 1 + self.blank

    def __call__(self, there: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        above = len(self.cuts) - np.searchsorted(self.cuts, ids, "right")
        same = len(self.cuts) - np.searchsorted(self.cuts, ids, "left") - above
        share = ((hashes >> 33) + (1 << 30)).astype(np.int64)  # 31 bits of the hash, in its order
        return np.where(there, above + (share * (same + 1) >> 31), len(self.cuts) + 1 + (share * self.blank >> 31))


def _ranges(rows: DataFrame) -> _Ranges:
    """Ranges of about ``RANGE_BYTES`` of text, if rows are alike, and not fewer than tasks run at a time."""
    size = rows.agg(F.count(F.lit(1)).alias("all"), F.count("doc_id").alias("there"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(size["bytes"] or 0) // RANGE_BYTES))
    with_id = min(n * size["there"] // max(size["all"], 1) + 1, size["there"])
    cuts = []
    if with_id > 1:
        at = [i / with_id for i in range(1, with_id)]
        cuts = rows.agg(F.percentile_approx("doc_id", at, max(10_000, 10 * with_id))).first()[0]
    return _Ranges(sorted(cuts, reverse=True), n - n * size["there"] // max(size["all"], 1) or 1)


def _numbered(ranges: _Ranges, of) -> Column:
    """``of`` (range numbers, ids there, ids, hashes) of each row, as a column of long integers."""
    @F.arrow_udf("bigint")
    def number(there: pa.Array, ids: pa.Array, hashes: pa.Array) -> pa.Array:
        found = [c.to_numpy(zero_copy_only=False) for c in (there, ids, hashes)]
        return pa.array(of(ranges(*found), *found), pa.int64())

    return number(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("text_hash"))


def _in_range(at, *_):
    return at


class _EndOf:
    """The range that a row is also the end of, or -1; ``firsts`` are the first rows' keys (id there, id, hash)."""

    def __init__(self, firsts: dict[tuple[bool, int, int], int]) -> None:
        self.firsts, self.hashes = firsts, np.array(sorted(h for _, _, h in firsts), np.int64)

    def __call__(self, _, there, ids, hashes):
        out = np.full(len(hashes), -1, np.int64)
        for i in np.flatnonzero(np.isin(hashes, self.hashes)).tolist():
            out[i] = self.firsts.get((bool(there[i]), int(ids[i]), int(hashes[i])), -1)
        return out


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    ranges = _ranges(rows)
    place = F.struct(F.col("doc_id").isNull().alias("blank"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("id"), "text_hash")
    first = (rows.select("doc_id", "text_hash").withColumn("range", _numbered(ranges, _in_range))
             .groupBy("range").agg(F.min(place).alias("key")).orderBy("range").collect())
    ends = _EndOf({(not r["key"]["blank"], ~r["key"]["id"], r["key"]["text_hash"]): first[i - 1]["range"] for i, r in enumerate(first)})
    own, other = (F.struct(F.col(c).cast("int").alias("range"), F.lit(end).alias("end")) for c, end in (("range", False), ("end_of", True)))
    met = (rows.withColumn("range", _numbered(ranges, _in_range)).withColumn("end_of", _numbered(ranges, ends))
           .select("doc_id", "text", "text_hash", F.explode(F.when(F.col("end_of") < 0, F.array(own)).otherwise(F.array(own, other))).alias("at"))
           .select("doc_id", "text", "text_hash", "at.*")
           .repartitionById(len(ranges), "range").sortWithinPartitions("end", F.desc_nulls_last("doc_id"), "text_hash", "text"))
    return (met.select("doc_id", "text", "end").mapInArrow(_walk, _SCHEMA)
            .withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}))


def op6(docs: DataFrame) -> DataFrame:
    return compare_neighbours(docs)
