"""Alignment of two tokenizers' tokens over a corpus, each distinct text once.

Texts are shuffled by their full text and counted; each distinct text is
tokenised by A (byte-level BPE) and B (sentencepiece BPE) and aligned once. Byte
offsets at which a token of A and a token of B both end cut the tokens into
groups; the two tokens that end there are linked. The corpus-wide count of an
id pair weights the links of a text by the number of its copies; measures then
go back to the documents by the SHA-256 of the text.

Both tokenizers never join what stands before a run of spaces with the run, so
a text is cut there into units (a word with the spaces in front of it), and a
worker remembers groups and links of the units it has met, up to a bounded
number, then starts anew. At a unit's end both tokenizers end a token, so
the groups of a text are those of its units in a row. That B has no piece with a space after
another character, which the cut needs, is asserted when the file is loaded;
tests hold the units against whole texts.

A pair table of at most ``MAX_BROADCAST`` rows is broadcast to the links, a
larger one is joined by a shuffle.

Defined cases: null and empty texts, and texts whose tokens' joined bytes (of A
or of B) are not a space and the text, have no tokens: zeros and ''. Null and
repeated ids are returned each with the measures of their text; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import _BLANK_SPACE, _CUT, byte_alphabet, byte_level_encoder
from .wordtable import slices

MAX_BROADCAST = 1 << 20
MEMORY_UNITS, LEARN_UNITS = 400_000, 20_000
#: Links are numbered a * 2^20 + b.
B_BITS = 20

class Vocabulary:
    """The bytes of a tokenizer's tokens by id, in one array."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        end = np.cumsum(size)
        at = np.repeat(self.start[ids] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
        return self.flat[at].tobytes()


class Pair:
    """Both tokenizers, the bytes of their tokens, and a memory of aligned units."""

    _by_paths: dict[tuple[str, str], "Pair"] = {}

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        vocab = Tokenizer.from_file(path_a).get_vocab()
        self.encode_a = byte_level_encoder(path_a)
        b = SentencePieceProcessor(model_file=path_b)
        self.encode_b = lambda texts: b.encode(texts, num_threads=1)
        alphabet, names = byte_alphabet(), [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            names[i] = t
        self.a = Vocabulary([bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in names])
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("units cannot be cut: a piece of B has a space after another character")
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # decimal ids with what follows them: another id or the other side, and for B another id or the next group
        self.text_a = [f"{i}," for i in range(len(names))] + [f"{i}|" for i in range(len(names))]
        self.text_b = [f"{i}," for i in range(len(pieces))] + [f"{i};" for i in range(len(pieces))]
        self.forget()

    @classmethod
    def of(cls, path_a: str, path_b: str) -> "Pair":
        """One per Python worker, kept between tasks."""
        key = (path_a, path_b)
        if key not in cls._by_paths:
            cls._by_paths[key] = cls(path_a, path_b)
        return cls._by_paths[key]

    def forget(self) -> None:
        #: unit to its number; by number: tokens of A and B (-1: other bytes), groups as text, links as 64-bit integers
        self.number: dict[str, int] = {}
        self.n_a, self.n_b = array("q"), array("q")
        self.groups: list[str] = []
        self.links: list[bytes] = []

    @staticmethod
    def cut(text: str) -> list[str]:
        """Units of a text without their first space: ' '.join of the units gives the text."""
        parts = text.split(" ")
        if "" in parts or _BLANK_SPACE.search(text):
            return [u[1:] for u in _CUT.split(" " + text)]
        return parts

    def align(self, units: list[str]) -> list[tuple[int, int, str, bytes]]:
        """(tokens of A, tokens of B, groups, links) of each unit; -1 tokens if its bytes differ."""
        ids_a, ids_b = self.encode_a([" " + u for u in units]), self.encode_b(units)
        want = [(" " + u).encode() for u in units]

        def flat(ids):
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum())), np.concatenate([[0], np.cumsum(size)])

        (a, from_a), (b, from_b) = flat(ids_a), flat(ids_b)
        all_bytes = b"".join(want)
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        ends = np.cumsum([len(w) for w in want])
        whole = [np.array_equal(end[at[1:] - 1], ends) for end, at in ((end_a, from_a), (end_b, from_b)) if len(end)]
        if len(whole) < 2 or not all(whole) or self.a.joined(a) != all_bytes or self.b.joined(b) != all_bytes:
            if len(units) == 1:
                return [(-1, -1, "", b"")]
            middle = len(units) // 2  # some unit's bytes differ: find it by halves
            return self.align(units[:middle]) + self.align(units[middle:])
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        links = (a[last_a] << B_BITS) | b[last_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        names = list(map(self.text_a.__getitem__, (a + last_a * len(self.a.size)).tolist()))
        names += map(self.text_b.__getitem__, (b + last_b * len(self.b.size)).tolist())
        names = list(map(names.__getitem__, order.tolist()))
        to = np.concatenate([[0], np.cumsum(last_a)])[from_a].tolist()
        both = (from_a + from_b).tolist()
        packed = links.astype("<i8").tobytes()
        n_a, n_b = np.diff(from_a).tolist(), np.diff(from_b).tolist()
        return [(n_a[k], n_b[k], "".join(names[both[k]:both[k + 1]])[:-1], packed[8 * to[k]:8 * to[k + 1]]) for k in range(len(units))]

    def learn(self, units: list[str]) -> None:
        for k in range(0, len(units), LEARN_UNITS):
            part = units[k:k + LEARN_UNITS]
            for u, (n_a, n_b, groups, links) in zip(part, self.align(part)):
                self.number[u] = len(self.n_a)
                self.n_a.append(n_a)
                self.n_b.append(n_b)
                self.groups.append(groups)
                self.links.append(links)

    def numbers(self, texts: list[str]) -> list[list[int]]:
        cut = [self.cut(t) for t in texts]
        fresh = set(chain.from_iterable(cut)) - self.number.keys()
        if fresh:
            if len(self.number) + len(fresh) > MEMORY_UNITS:
                self.forget()
                fresh = set(chain.from_iterable(cut))
            self.learn(sorted(fresh))
        get = self.number.__getitem__
        return [list(map(get, units)) for units in cut]


_ALIGNED = ("text_key binary, copies bigint, n_a bigint, n_b bigint, n_links bigint, groups_sha256 string, "
            "links array<bigint>, times array<bigint>")


def _aligner(path_a: str, path_b: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(path_a, path_b)
        for part in parts:
            for first, texts in slices(part.column(2), 1 << 21):
                numbers = pair.numbers(texts.to_pylist())
                sizes = np.array([len(x) for x in numbers], np.int64)
                unit = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
                row = np.repeat(np.arange(len(sizes)), sizes)
                n_a, n_b = np.frombuffer(pair.n_a, np.int64)[unit], np.frombuffer(pair.n_b, np.int64)[unit]
                good = np.bincount(row, n_a < 0, len(sizes)) == 0
                # distinct units of a text, then their links
                code, times = np.unique((row << 32) | unit, return_counts=True)
                code, times = code[good[code >> 32]], times[good[code >> 32]]
                links = [pair.links[u] for u in (code & 0xFFFFFFFF).tolist()]
                each = np.fromiter(map(len, links), np.int64, len(links)) // 8
                link = np.frombuffer(b"".join(links), "<i8")
                where, weight = np.repeat(code >> 32, each), np.repeat(times, each)
                order = np.argsort((where << (2 * B_BITS)) | link)
                link, where, weight = link[order], where[order], weight[order]
                new = np.ones(len(link), bool)
                new[1:] = (link[1:] != link[:-1]) | (where[1:] != where[:-1])
                starts = np.flatnonzero(new)
                total = np.add.reduceat(weight, starts) if len(starts) else weight
                bounds = pa.array(np.searchsorted(where[starts], np.arange(len(sizes) + 1)).astype(np.int32))
                ok = good.tolist()
                sums = [hashlib.sha256(";".join(map(pair.groups.__getitem__, x)).encode()).hexdigest() if k else "" for x, k in zip(numbers, ok)]

                def per_text(values, at):
                    return pa.array(np.where(good, np.bincount(at, values, len(sizes)), 0).astype(np.int64))

                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(first, len(texts)), part.column(1).slice(first, len(texts)),
                     per_text(n_a, row), per_text(n_b, row), per_text(weight, where), pa.array(sums, pa.string()),
                     pa.ListArray.from_arrays(bounds, pa.array(link[starts])), pa.ListArray.from_arrays(bounds, pa.array(total))],
                    names=[c.split()[0] for c in _ALIGNED.split(", ")])
    return run


def align_texts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """One row per distinct text: its key (SHA-256), copies, token counts, groups' digest, and its links with how often each occurs."""
    text = F.col(text_col)
    distinct = docs.filter(text.isNotNull() & (text != "")).groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    return materialize(distinct.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"), "copies", "text")
                       .mapInArrow(_aligner(path_a, path_b), _ALIGNED), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(link, count, best): corpus-wide links of each id pair, and whether no pair of its B id has more."""
    each = aligned.select("copies", F.explode(F.arrays_zip("links", "times")).alias("x"))
    counts = materialize(each.groupBy(F.col("x.links").alias("link")).agg(F.sum(F.col("x.times") * F.col("copies")).alias("count")), "pair-counts")
    b = F.col("link").bitwiseAND((1 << B_BITS) - 1)
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    return materialize(counts.withColumn("b", b).join(top, "b").select("link", "count", (F.col("count") == F.col("top")).alias("best")), "pairs")


def measures(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per distinct text (text_key, n_a, n_b, n_links, groups_sha256, n_best, count_sum)."""
    if pairs.count() <= MAX_BROADCAST:
        pairs = F.broadcast(pairs)
    each = aligned.select("text_key", F.explode(F.arrays_zip("links", "times")).alias("x"))
    sums = (each.select("text_key", F.col("x.links").alias("link"), F.col("x.times").alias("times")).join(pairs, "link")
            .groupBy("text_key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                     F.sum(F.col("times") * F.col("count")).alias("count_sum")))
    return (aligned.select("text_key", "n_a", "n_b", "n_links", "groups_sha256").join(sums, "text_key", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per row of docs."""
    aligned = align_texts(docs, path_a, path_b, text_col)
    per_text = materialize(measures(aligned, pair_counts(aligned)), "alignment-measures")
    doc_id, text = F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)
    some = text.isNotNull() & (text != "")
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    keyed = docs.filter(some).select(doc_id, F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"))
    out = (keyed.join(per_text.withColumn("n_groups", F.col("n_links")), "text_key")
           .select("doc_id", *[F.col(c).cast("long").alias(c) for c in longs], "groups_sha256"))
    none = docs.filter(~F.coalesce(some, F.lit(False))).select(doc_id, *[F.lit(0).cast("long").alias(c) for c in longs],
                                                               F.lit("").alias("groups_sha256"))
    return out.unionByName(none)


def op12(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    if path_a is None or path_b is None:
        import public_tokenizers
        path_a, path_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_documents(docs, path_a, path_b)
