"""Language-model scores from Elias-Fano n-gram tries.

Counting and smoothing run as Spark jobs, one per order; each writes its level
of the trie as files in the shared folder, which every worker maps into
memory. Level 1 is the vocabulary: sorted 64-bit word hashes in Elias-Fano
code with exact counts; a word's id is its rank. Level k+1 holds, for each
node of level k (an n-gram), the words that follow it: monotone pointers
(Elias-Fano) to each parent's run of successors, and the successors' ids,
turned into one monotone sequence by adding to each run the last value of the
run before, again in Elias-Fano code. A lookup takes the parent's run from the
pointers and searches its word relative to that run. Probabilities and back-off
weights are quantised to 8 bits per entry.

The model is interpolated absolute discounting over the add-one unigram:
``P(w|u) = (c(uw) - D) / c(u) + L(u) P(w|u')`` for kept n-grams and
``L(u) P(w|u')`` for others, ``L(u)`` being what the kept ones leave. N-grams
seen fewer than ``min_count`` times are not kept (standard pruning of higher
orders; their mass goes to ``L``). The end token doubles as the context of a
text's first word.

Counts are summed over a few slices of text, then by key; files are ranges of
parents, so the build is bounded per task. The n-grams of a range travel as
compressed columns of sorted values, in one shuffle per level, whose files are
released before the next level. Lookups run once per distinct n-gram of a slice.

Defined cases: null and empty texts are the end token alone; repeated rows
count and are scored each; null ids count as text '' in the fold; an empty
training set gives the uniform unigram; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold, local_filesystem, materialize, release_shuffles, shared_path
from .wordtable import slices, words

ORDER, MIN_COUNT, DISCOUNT, FOLDS, HELD_OUT = 3, 2, 0.75, 7, 2
#: The registered query keeps every n-gram.
QUERY_MIN_COUNT = 1
#: N-grams a task sums before it hands them on.
HELD_GRAMS = 1 << 21
#: Tokens per range of parents, which one task turns into a file; the session's shuffle partitions are the least number of ranges.
RANGE_TOKENS = 1 << 21
#: The end token; a word hashes to this value as rarely as two words collide.
END = np.uint64(0x5851F42D4C957F2D)
ONE = np.uint64(1)


_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _places() -> np.ndarray:
    """Per byte value and k: the place of its k-th one (from 0)."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.argsort(1 - bits.astype(np.int8), axis=1, kind="stable").astype(np.uint8).ravel()


_PLACE = _places()


def _trailing(x: np.ndarray) -> np.ndarray:
    """Number of trailing zeros per word, 64 for 0."""
    return np.bitwise_count((x & (~x + ONE)) - ONE).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit values: low bits packed,
    high bits in unary, with running counts of ones and zeros per word."""

    def __init__(self, n: int, low_bits: int, lows, highs, ones, zeros) -> None:
        self.n, self.low_bits, self.lows, self.highs, self.ones, self.zeros = n, low_bits, lows, highs, ones, zeros

    @staticmethod
    def encode(values: np.ndarray) -> "EliasFano":
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low)).astype(np.int64) if low else values.astype(np.int64)
        bits = np.zeros(-(-((universe >> low) + n + 2) // 64) * 64, bool)
        bits[high + np.arange(n)] = True
        highs = np.packbits(bits, bitorder="little").view(np.uint64)
        lows = np.zeros(n * low // 64 + 2, np.uint64)
        if low:
            part = values & np.uint64((1 << low) - 1)
            at = np.arange(n, dtype=np.int64) * low
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(lows, word, part << shift)
            over = shift.astype(np.int64) + low > 64
            np.bitwise_or.at(lows, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(highs), dtype=np.int64)])
        zeros = 64 * np.arange(len(ones), dtype=np.int64) - ones
        return EliasFano(n, low, lows, highs, ones, zeros)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"lows": self.lows, "highs": self.highs, "ones": self.ones, "zeros": self.zeros}

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero."""
        counts = self.ones if ones else self.zeros
        word = np.searchsorted(counts, k, "right") - 1
        x = self.highs[word]
        x = x if ones else ~x
        left = (k - counts[word]).astype(np.uint64)
        # byte i of ``upto`` counts the ones in bytes 0..i
        upto = x - ((x >> ONE) & np.uint64(0x5555555555555555))
        upto = (upto & np.uint64(0x3333333333333333)) + ((upto >> np.uint64(2)) & np.uint64(0x3333333333333333))
        upto = ((upto + (upto >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES
        # a byte that the place lies behind keeps its top bit
        shift = np.bitwise_count(((left * _ONES) | _TOPS) - upto & _TOPS).astype(np.uint64) << np.uint64(3)
        left -= ((upto << np.uint64(8)) >> shift) & np.uint64(0xFF)
        place = _PLACE[(((x >> shift) & np.uint64(0xFF)) << np.uint64(3)) | left]
        return word * 64 + shift.astype(np.int64) + place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.lows[word] >> shift
        spill = np.where(shift > 0, self.lows[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (value | spill) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return self._value(i, self._select(i, True))

    def _value(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries i and i + 1: the next one mostly stands in the same word."""
        at = self._select(i, True)
        rest = self.highs[at >> 6] & ~((np.uint64(2) << (at & 63).astype(np.uint64)) - ONE)
        after = (at & ~63) + _trailing(rest)
        far = np.flatnonzero(rest == 0)
        after[far] = self._select(i[far] + 1, True)
        return self._value(i, at), self._value(i + 1, after)

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of each x among the entries [lo, hi), or -1."""
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        out = np.full(len(x), -1, np.int64)
        some = np.flatnonzero((high < self.zeros[-1]) & (lo < hi))
        high, x, a, b = high[some], x[some], lo[some], hi[some]
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1, 0)
        shift = (start & 63).astype(np.uint64)
        run = _trailing(~(self.highs[start >> 6] >> shift))  # entries with these high bits
        far = np.flatnonzero(run >= 64 - (start & 63))  # as far as the word goes, or farther
        run[far] = self._select(high[far], False) - start[far]
        a, b = np.maximum(a, start - high), np.minimum(b, start - high + run)
        want = x & np.uint64((1 << self.low_bits) - 1)
        end = b.copy()
        while True:  # lower bound of the low bits among entries with equal high bits
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < want[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        ok = np.flatnonzero(a < end)
        ok = ok[self._low(a[ok]) == want[ok]]
        out[some[ok]] = a[ok]
        return out


def _write(folder: str, name: str, header: dict, arrays: dict[str, np.ndarray]) -> None:
    """One level file: a JSON header line padded to 8 bytes, then the arrays."""
    at = 0
    table = {}
    for key, a in arrays.items():
        table[key] = [at, a.dtype.str, len(a)]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({**header, "arrays": table}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    fs, path = local_filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def _open(folder: str, name: str) -> dict:
    """The header and arrays of a level file, mapped into memory. A file in a
    folder that machines do not mount is copied first, to a file without a name that ends with its mapping."""
    fs, path = local_filesystem(folder)
    path = f"{path}/{name}"
    if fs.type_name == "local":
        data = np.memmap(path, np.uint8, "r").view(np.ndarray)
    else:
        import tempfile
        with fs.open_input_stream(path, compression=None) as source, tempfile.TemporaryFile() as held:
            while block := source.read(1 << 24):
                held.write(block)
            held.flush()
            data = np.memmap(held, np.uint8, "r").view(np.ndarray)
    size = int.from_bytes(data[:8].tobytes(), "little")
    header = json.loads(data[8:8 + size].tobytes())
    start = 8 + size
    for key, (at, kind, n) in header.pop("arrays").items():
        width = np.dtype(kind).itemsize
        header[key] = data[start + at:start + at + n * width].view(kind)
    return header


def _sequence(header: dict, name: str) -> EliasFano:
    return EliasFano(header[f"{name}_n"], header[f"{name}_l"], *[header[f"{name}_{x}"] for x in ("lows", "highs", "ones", "zeros")])


def _quantise(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    lo, hi = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (hi - lo) / 255 or 1.0
    return np.round((x - lo) / step).astype(np.uint8), lo, step


_cache: dict[tuple[str, str], dict] = {}


class Trie:
    """The levels written so far, opened on first use by each worker."""

    def __init__(self, folder: str, levels: list[list[tuple]], total: int, distinct: int) -> None:
        self.folder, self.levels = folder, levels  # per level: (file, first key or parent, last, node of its first entry)
        self.total = total
        self.rest = float(np.log10(total + distinct + 1))

    def _file(self, name: str) -> dict:
        key = (self.folder, name)
        if key not in _cache:
            for old in [k for k in _cache if k[0] != self.folder]:
                del _cache[old]
            f = _open(self.folder, name)
            for part in ("key", "ptr", "succ"):
                if f"{part}_n" in f:
                    f[part] = _sequence(f, part)
            _cache[key] = f
        return _cache[key]

    def _route(self, level: int, sorted_values: np.ndarray):
        """(file, its entry, slice) for ascending values."""
        for name, first, last, base in self.levels[level]:
            lo = np.searchsorted(sorted_values, np.asarray(first, sorted_values.dtype), "left")
            hi = np.searchsorted(sorted_values, np.asarray(last, sorted_values.dtype), "right")
            if lo < hi:
                yield self._file(name), first, base, slice(int(lo), int(hi))

    def vocabulary(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of ascending distinct word hashes; -1 and 0 for unknown ones."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for f, _, base, s in self._route(0, hashes):
            part = hashes[s]
            at = f["key"].find(part, np.zeros(len(part), np.int64), np.full(len(part), f["key"].n))
            known = np.flatnonzero(at >= 0)
            ids[s][known] = base + at[known]
            counts[s][known] = f["count"][at[known]]
        return ids, counts

    def counts(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Counts of ascending nodes of a level (0: words)."""
        out = np.zeros(len(nodes), np.int64)
        for name, _, _, base in self.levels[level]:
            lo = np.searchsorted(nodes, base)
            f = self._file(name) if lo < len(nodes) else None
            hi = np.searchsorted(nodes, base + len(f["count"])) if f is not None else lo
            if lo < hi:
                out[lo:hi] = f["count"][nodes[lo:hi] - base]
        return out

    def follow(self, level: int, parent: np.ndarray, word: np.ndarray):
        """(nodes, log10 probabilities, log10 back-off weights of the parents) at
        ``level`` for pairs sorted by parent; node -1 where not kept, or where the word is -1."""
        node = np.full(len(parent), -1, np.int64)
        prob, weight = np.zeros(len(parent)), np.zeros(len(parent))
        for f, first, base, s in self._route(level, parent):
            new = np.ones(s.stop - s.start, bool)
            new[1:] = parent[s][1:] != parent[s][:-1]
            p_of = np.cumsum(new) - 1
            at = parent[s][new] - first
            lo, hi = (x.astype(np.int64) for x in f["ptr"].get_two(at))
            weight[s] = np.where(hi > lo, f["weight_lo"] + f["weight_step"] * f["weight"][at], 0.0)[p_of]
            before = np.zeros(len(lo), np.uint64)
            some = np.flatnonzero((lo > 0) & (hi > lo))
            before[some] = f["succ"].get(lo[some] - 1)
            # a run starts one above the last value of the run before
            known = np.flatnonzero(word[s] >= 0)
            of = p_of[known]
            got = f["succ"].find(before[of] + word[s][known].astype(np.uint64) + ONE, lo[of], hi[of])
            some = np.flatnonzero(got >= 0)
            known, got = known[some], got[some]
            node[s][known] = base + got
            prob[s][known] = f["prob_lo"] + f["prob_step"] * f["prob"][got]
        return node, prob, weight

    def walk(self, texts: pa.Array, up_to: int):
        """Of the slice's tokens: rows' bounds, ids, counts, the node of the
        ``up_to`` tokens before each (-1: not kept), and log10 P by the levels
        up to ``up_to``.

        Words and n-grams are numbered within the slice in the order of their
        ids and nodes, so that a pair is one number and is looked up once."""
        w = words(texts, True)
        bounds = w.rows + np.arange(len(w.rows))
        distinct, of = np.unique(np.insert(w.hashes, w.rows[1:], END), return_inverse=True)
        del w
        ids, counts = self.vocabulary(distinct)
        first, size = bounds[:-1], max(len(distinct), 1)
        log_p = (np.log10(counts + 1) - self.rest)[of]

        def shifted(numbers: np.ndarray, start) -> np.ndarray:
            before = np.empty_like(numbers)
            before[1:], before[first] = numbers[:-1], start
            return before

        # every row ends with the end token, the context of its first word
        nodes, before = ids, shifted(of, of[bounds[1:] - 1]) if len(first) else of
        for level in range(1, up_to):
            some = np.flatnonzero((before >= 0) & (nodes[before] >= 0)) if len(nodes) else np.zeros(0, np.int64)
            pair, which = np.unique(before[some] * size + of[some], return_inverse=True)
            nodes, prob, weight = self.follow(level, nodes[pair // size], ids[pair % size])
            log_p[some] = np.where((nodes >= 0)[which], prob[which], log_p[some] + weight[which])
            numbers = np.full(len(of), -1, np.int64)
            numbers[some] = which
            before = shifted(numbers, -1)  # longer contexts do not reach over a text's start
        context = np.full(len(of), -1, np.int64)
        some = np.flatnonzero(before >= 0)
        context[some] = nodes[before[some]]
        return bounds, ids[of], counts[of], context, log_p


def _unigrams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for _, texts in slices(part.column(0)):
            h, n = np.unique(words(texts, True).hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(h, END).view(np.int64)), pa.array(np.append(n, len(texts)))], names=["h", "n"])


def _level_one(folder: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [(np.asarray(p.column(0)).view(np.uint64), np.asarray(p.column(1))) for p in parts if len(p)]
        if not got:
            return
        h, n = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(h)
        h, n = h[order], n[order]
        key = EliasFano.encode(h)
        t = TaskContext.get()
        name = f"words-{t.partitionId():05d}-{t.taskAttemptId()}"
        _write(folder, name, {"key_n": key.n, "key_l": key.low_bits},
               {**{f"key_{k}": v for k, v in key.arrays().items()}, "count": n.astype(np.int64)})
        yield pa.RecordBatch.from_pydict({"part": [t.partitionId()], "name": [name], "first": [int(h[0].view(np.int64))],
                                          "last": [int(h[-1].view(np.int64))], "n": [len(h)], "total": [int(n.sum())]})
    return run


def _pack(a: np.ndarray) -> bytes:
    """Bytes of an array by place, compressed; integers in as few bytes as they need."""
    if a.dtype.kind != "f":
        a = a.astype(np.min_scalar_type(int(a.max())))
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return a.dtype.char.encode() + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    raw = pa.decompress(data[1:], n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)


def _summed(p: np.ndarray, i: np.ndarray, n: np.ndarray, lower: np.ndarray):
    """Rows (parent, word, n, lower) sorted, with the counts of equal pairs summed."""
    span = int(i.max()) + 1 if len(i) else 1
    # one number for a pair where it fits
    order = np.argsort(p * span + i) if len(p) and int(p.max()) < (1 << 62) // span else np.lexsort((i, p))
    p, i = p[order], i[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1])
    at = np.flatnonzero(new)
    return p[at], i[at], np.add.reduceat(n[order], at) if len(at) else n[order], lower[order][at]


def _grams(trie: Trie, level: int, nodes: int, ranges: int):
    """Counts of (parent node, word id) pairs of some slices, with log10 P of the
    shorter context: one row per range of parents, which holds packed columns."""
    def packed(held: list[tuple]) -> pa.RecordBatch:
        p, i, n, lower = _summed(*map(np.concatenate, zip(*held))) if len(held) > 1 else held[0]
        to = p * ranges // nodes
        starts = np.flatnonzero(np.diff(to, prepend=-1)) if len(p) else np.zeros(0, np.int64)
        rows = [(int(to[a]), int(b - a), int(p[a]), _pack(np.diff(p[a:b], prepend=p[a])), _pack(i[a:b]), _pack(n[a:b]), _pack(lower[a:b]))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(p)])]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                          names=["to", "rows", "first", "parent", "word", "n", "lower"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in parts:
            for _, texts in slices(part.column(0)):
                _, ids, _, parent, log_p = trie.walk(texts, level)
                some = np.flatnonzero((parent >= 0) & (ids >= 0))
                held.append(_summed(parent[some], ids[some], np.ones(len(some), np.int64), log_p[some].astype(np.float32)))
                if sum(len(x[0]) for x in held) >= HELD_GRAMS:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)
    return run


def _next_level(trie: Trie, level: int, min_count: int, discount: float, last_level: bool):
    """Writes one file of ``level`` from the packed n-grams of a range. Every occurrence of a context has a next token (the end
    token stands before the first), so its count is that of its own node."""
    folder = trie.folder
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = []
        for part in parts:
            for row in part.to_pylist():
                p, i, n, lower = (_unpack(row[k], row["rows"]) for k in ("parent", "word", "n", "lower"))
                got.append((np.cumsum(p, dtype=np.int64) + row["first"], i.astype(np.int64), n.astype(np.int64), lower))
        if not got:
            return
        parent, word, n, lower = _summed(*map(np.concatenate, zip(*got)))
        often = n >= min_count
        parent, word, n, lower = parent[often], word[often], n[often], lower[often].astype(np.float64)
        if not len(n):
            return
        distinct, of = np.unique(parent, return_inverse=True)
        context = trie.counts(level - 2, distinct)[of]
        first, last = int(parent[0]), int(parent[-1])
        ptr = np.searchsorted(parent, np.arange(first, last + 2))
        share = (n - discount) / context
        left = np.maximum(1 - np.bincount(parent - first, share, last - first + 1), 1e-9)
        prob = np.log10(share + left[parent - first] * 10.0 ** lower)
        # successors of a run, one above the last value of the run before: one rising sequence
        closing = np.zeros(last - first + 1, np.uint64)
        full = np.flatnonzero(np.diff(ptr))
        closing[full] = word[ptr[full + 1] - 1].astype(np.uint64) + ONE
        offset = np.concatenate([[0], np.cumsum(closing)[:-1]]).astype(np.uint64)
        succ = EliasFano.encode(offset[parent - first] + word.astype(np.uint64) + ONE)
        ptr = EliasFano.encode(ptr.astype(np.uint64))
        codes, lo, step = _quantise(prob)
        weights, w_lo, w_step = _quantise(np.log10(left))
        t = TaskContext.get()
        name = f"level{level}-{t.partitionId():05d}-{t.taskAttemptId()}"
        _write(folder, name,
               {"ptr_n": ptr.n, "ptr_l": ptr.low_bits, "succ_n": succ.n, "succ_l": succ.low_bits,
                "prob_lo": lo, "prob_step": step, "weight_lo": w_lo, "weight_step": w_step},
               {**{f"ptr_{k}": v for k, v in ptr.arrays().items()}, **{f"succ_{k}": v for k, v in succ.arrays().items()},
                "prob": codes, "weight": weights,
                # only the next level asks for counts
                **({} if last_level else {"count": n.astype(np.min_scalar_type(int(n.max())))})})
        yield pa.RecordBatch.from_pydict({"part": [t.partitionId()], "name": [name], "first": [first], "last": [last], "n": [len(n)]})
    return run


def build(texts: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT) -> Trie:
    """The trie of a frame (text) of training texts. What comes back to the
    driver is the list of files, one row each."""
    folder = shared_path(texts.sparkSession, "trie")
    vocabulary = (texts.mapInArrow(_unigrams, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
                  # ranges of the unsigned order
                  .withColumn("u", F.col("h").bitwiseXOR(F.lit(-(1 << 63)))))
    files = materialize(vocabulary.repartitionByRange("u").sortWithinPartitions("u").select("h", "n").mapInArrow(
        _level_one(folder), "part bigint, name string, first bigint, last bigint, n bigint, total bigint"), "trie-files")
    del vocabulary
    rows = files.withColumn("base", F.sum("n").over(W.orderBy("part")) - F.col("n")).orderBy("part").collect()
    unsigned = lambda x: x & 0xFFFFFFFFFFFFFFFF
    trie = Trie(folder, [[(r["name"], unsigned(r["first"]), unsigned(r["last"]), r["base"]) for r in rows]],
                sum(r["total"] for r in rows), sum(r["n"] for r in rows))
    nodes = sum(r["n"] for r in rows)
    ranges = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-trie.total // RANGE_TOKENS))
    for level in range(1, order):
        if not nodes:
            trie.levels.append([])
            continue
        del files
        release_shuffles(texts.sparkSession)
        files = materialize(texts.mapInArrow(_grams(trie, level, nodes, ranges), "to int, rows bigint, first bigint, parent binary, word binary, n binary, lower binary")
                            .repartitionById(ranges, "to")
                            .mapInArrow(_next_level(trie, level + 1, min_count, discount, level + 1 == order),
                                        "part bigint, name string, first bigint, last bigint, n bigint"), "trie-files")
        rows = files.withColumn("base", F.sum("n").over(W.orderBy("part")) - F.col("n")).orderBy("part").collect()
        trie.levels.append([(r["name"], r["first"], r["last"], r["base"]) for r in rows])
        nodes = sum(r["n"] for r in rows)
    del files
    release_shuffles(texts.sparkSession)
    return trie


def _scorer(trie: Trie, order: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, texts in slices(part.column(1)):
                bounds, ids, counts, _, log_p = trie.walk(texts, order)
                at = bounds[:-1]
                base = np.log10(counts + 1) - trie.rest
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(first, len(texts)), pa.array(np.diff(bounds)),
                     pa.array(np.add.reduceat((ids >= 0).astype(np.int64), at)),
                     pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(log_p, at))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
    return run


def op3(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    trie = build(docs.filter(~held_out).select("text"), order, min_count)
    total = trie.total
    scored = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .mapInArrow(_scorer(trie, order), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                         F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
