"""Harmonic packing of documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces of which
exactly k fill a bin. A document is cut greedily: whole bins first, then the
largest ``capacity // k`` (k up to ``classes``) that fits, and a last piece
shorter than the smallest of these, whose class is ``capacity // length``. All
pieces of a class have one length, so a bin is any k of them, and workers
(shards) fill their bins without looking at each other.

The fewer than k pieces left of each class of a shard are bounded in number
(about 10 000 for capacity 2048, whatever the shard holds); one task per shard
packs them by first fit, longest first. Padding is then at most ``k - 1`` ids
of a full bin and part of about one bin per shard.

Defined cases: null and empty texts are the end id alone; repeated rows are
packed each; null ids are kept; a text longer than any capacity is cut; an
empty table gives an empty result. Other columns are not read. Sequence ids
are unique (shard, class, bin), not contiguous.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .tokens import END_ID, Encoder, batches

CAPACITY = 2048
CLASSES = 32
SHARD_PIECES = 1 << 15


def piece_lengths(n: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[int]:
    """The lengths, in order, into which a document of ``n`` ids is cut."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    smallest = capacity // classes
    while rest:
        size = capacity // -(-capacity // rest) if rest >= smallest else rest
        out.append(size)
        rest -= size
    return out


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cutter(path: str, capacity: int, classes: int):
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = Encoder.of(path, drops_blanks=False)
        end = END_ID.to_bytes(4, "little")
        for part in parts:
            ids = part.column(0)
            for first, texts in batches(part.column(1)):
                row, start, length, crc, total = [], [], [], [], []
                for i, raw in enumerate(encoder.ids(texts)):
                    data = memoryview(np.frombuffer(raw, f"<u{encoder.width}").astype("<u4").tobytes() + end)
                    n, at = len(data) // 4, 0
                    for size in piece_lengths(n, capacity, classes):
                        row.append(first + i)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(data[4 * at:4 * (at + size)]))
                        total.append(n)
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return cut


def _first_fit(capacity: int):
    def pack(rows):
        import pandas as pd

        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        room: list[int] = []
        bins, offsets, open_from = [], [], 0
        last = 0
        for n in rows["length"].tolist():
            if n != last:  # bins too full for this length are too full for none of the shorter ones: look again
                last, at = n, open_from
            while at < len(room) and room[at] < n:
                at += 1
            if at == len(room):
                room.append(capacity)
            bins.append(at)
            offsets.append(capacity - room[at])
            room[at] -= n
            while open_from < len(room) and room[open_from] == 0:
                open_from += 1
            at = max(at, open_from)
        return pd.DataFrame({**{c: rows[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard")},
                             "bin": bins, "offset": offsets})
    return pack


def sequence_id(shard, cls, number):
    """(shard, class, bin) in one long of 31, 12 and 20 bits: a shard has about ``SHARD_PIECES`` bins at most."""
    return (F.shiftleft(shard.cast("long"), 32) + F.shiftleft(cls.cast("long"), 20) + number).cast("long")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         classes: int = CLASSES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece."""
    pieces = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                         .mapInArrow(_cutter(tokenizer, capacity, classes), _PIECES), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    k = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    mine = W.partitionBy("shard", "length")
    ranked = (pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).cast("long"))
              .repartition("shard")
              .withColumn("rank", F.row_number().over(mine.orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
              .withColumn("k", k)
              .withColumn("full", F.floor(F.count(F.lit(1)).over(mine) / F.col("k")) * F.col("k")))

    def numbered(cls, number):
        return sequence_id(F.col("shard"), cls, number).alias("sequence_id")

    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    done = (ranked.filter(F.col("rank") < F.col("full"))
            .select(*cols, numbered(F.col("length"), F.floor(F.col("rank") / F.col("k"))),
                    ((F.col("rank") % F.col("k")) * F.col("length")).cast("long").alias("offset")))
    left = (ranked.filter(F.col("rank") >= F.col("full")).select(*cols, "shard")
            .groupBy("shard").applyInPandas(_first_fit(capacity), _PIECES + ", shard bigint, bin bigint, offset bigint")
            .select(*cols, numbered(F.lit(0), F.col("bin")), "offset"))
    return done.unionByName(left)


def op10(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(docs, tokenizer)
