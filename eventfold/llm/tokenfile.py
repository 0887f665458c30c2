"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames and a trailing seek table in
the public seekable format (a skippable frame with the compressed size, the
size and an XXH64 checksum of each frame, then a fixed-size footer). Frames
hold ``frame_ids`` ids each, little-endian unsigned integers of 2 or 4 bytes;
documents may span frames. The last data frame is the document index: count,
id width, then per document a null flag, the id and its number of tokens. A
reader opens the footer, the seek table and the index, and decompresses only
the frames that hold the documents it was asked for, checking each checksum.

Writing: documents are range-partitioned by id and sorted, each task writes
the file of its range to the shared folder through ``pyarrow.fs``. A file's
name carries the attempt, and only the attempt that succeeded returns the name
for the manifest, so lost or repeated tasks leave no wrong file behind.
Memory per task is one frame and the index of its range.

Defined cases: null and empty texts are the end id alone; null ids come first;
repeated ids follow each other by a hash of the text; an empty table writes no file. Other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import local_filesystem, materialize, shared_path
from .tokens import END_ID, Encoder, batches

FRAME_IDS = 1 << 16
LEVEL = 1
#: Magic numbers and layout of the public seekable format.
SKIPPABLE, SEEKABLE, HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY, _FOOTER, _INDEX = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<QB")


class FrameWriter:
    """Appends documents' ids to a binary stream, frame by frame."""

    def __init__(self, out, width: int, frame_ids: int = FRAME_IDS, level: int = LEVEL) -> None:
        import zstandard

        self.out, self.width, self.frame_bytes = out, width, frame_ids * width
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.buffer, self.entries = bytearray(), []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.entries.append(_ENTRY.pack(len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // self.width)
        self.buffer += ids
        while len(self.buffer) >= self.frame_bytes:
            self._frame(bytes(self.buffer[:self.frame_bytes]))
            del self.buffer[:self.frame_bytes]

    def close(self) -> None:
        import numpy as np

        if self.buffer:
            self._frame(bytes(self.buffer))
        self._frame(_INDEX.pack(len(self.doc_ids), self.width)
                    + np.array([d is not None for d in self.doc_ids], "u1").tobytes()
                    + np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()
                    + np.array(self.lengths, "<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(self.entries) * _ENTRY.size + _FOOTER.size))
        self.out.write(b"".join(self.entries))
        self.out.write(_FOOTER.pack(len(self.entries), HAS_CHECKSUMS, SEEKABLE))


class FrameReader:
    """Random access to a file written by FrameWriter; ``source`` can seek and read."""

    def __init__(self, source) -> None:
        import numpy as np
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.seek(0, 2)
        source.seek(size - _FOOTER.size)
        n, flags, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != SEEKABLE or flags != HAS_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        source.seek(size - _FOOTER.size - n * _ENTRY.size)
        table = np.frombuffer(source.read(n * _ENTRY.size), "<u4").reshape(n, 3).astype("i8")
        self.packed, self.plain, self.sums = table.T
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        index = self._frame(n - 1)
        count, self.width = _INDEX.unpack_from(index)
        p = _INDEX.size
        valid = np.frombuffer(index, "u1", count, p).astype(bool)
        ids = np.frombuffer(index, "<i8", count, p + count)
        self.doc_ids = [int(d) if v else None for d, v in zip(ids, valid)]
        self.lengths = np.frombuffer(index, "<i8", count, p + 9 * count)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.frame_starts = np.concatenate([[0], np.cumsum(self.plain[:-1])]) // self.width

    def _frame(self, i: int) -> bytes:
        import xxhash

        self.source.seek(int(self.at[i]))
        data = self.zstd.decompress(self.source.read(int(self.packed[i])), max_output_size=int(self.plain[i]))
        if len(data) != self.plain[i] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i}: the checksum does not match")
        return data

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, start in the file, ids as bytes) of the documents at ``rows``
        (ascending; all by default). Only frames that hold them are read, each once."""
        import numpy as np

        have, data = -1, b""
        for r in range(len(self.doc_ids)) if rows is None else rows:
            lo, hi, parts = int(self.starts[r]), int(self.starts[r + 1]), []
            f = int(np.searchsorted(self.frame_starts, lo, "right")) - 1
            while lo < hi:
                if f != have:
                    have, data = f, self._frame(f)
                base = int(self.frame_starts[f])
                end = min(hi, base + len(data) // self.width)
                parts.append(data[(lo - base) * self.width:(end - base) * self.width])
                lo, f = end, f + 1
            yield self.doc_ids[r], int(self.starts[r]), b"".join(parts)

    def find(self, doc_ids: Iterable[int | None]) -> list[int]:
        wanted = set(doc_ids)
        return [i for i, d in enumerate(self.doc_ids) if d in wanted]


def _writer(folder: str, path: str, frame_ids: int):
    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        encoder = Encoder.of(path, drops_blanks=True)
        end = END_ID.to_bytes(encoder.width, "little")
        fs, at = local_filesystem(folder)
        out = writer = None
        for part in parts:
            doc_ids = part.column(0)
            for first, texts in batches(part.column(1)):
                if writer is None:
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)  # not by the name
                    writer = FrameWriter(out, encoder.width, frame_ids)
                for i, ids in enumerate(encoder.ids(texts)):
                    writer.add(doc_ids[first + i].as_py(), ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([task.partitionId()], pa.int64()), "name": [name],
                "n_docs": pa.array([len(writer.doc_ids)], pa.int64()),
                "n_tokens": pa.array([int(np.sum(writer.lengths))], pa.int64())})
    return write


def write_ids(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              frame_ids: int = FRAME_IDS) -> DataFrame:
    """Writes the files and returns the manifest (part, name, n_docs, n_tokens,
    base: ids in the files before it), itself a table in the shared folder."""
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .withColumn("place", F.xxhash64("text")))
    # a hash of the text splits the rows of one id, null ids included, between files
    rows = (rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place", "text").drop("place"))
    manifest = materialize(rows.mapInArrow(_writer(folder, tokenizer, frame_ids),
                                           "part bigint, name string, n_docs bigint, n_tokens bigint"), "manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        fs, at = local_filesystem(folder)
        for part in parts:
            for name, base in zip(part.column("name").to_pylist(), part.column("base").to_pylist()):
                with fs.open_input_file(f"{at}/{name}") as source:
                    reader = FrameReader(source)
                    kind, rows = f"<u{reader.width}", ([], [], [], [])
                    for doc_id, start, ids in reader.documents():
                        crc = zlib.crc32(np.frombuffer(ids, kind).astype("<u4").tobytes())
                        for column, v in zip(rows, (doc_id, base + start, len(ids) // reader.width, crc)):
                            column.append(v)
                        if len(rows[0]) == 10_000:
                            yield _rows(rows)
                            rows = ([], [], [], [])
                    yield _rows(rows)

    def _rows(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())  # a task to a file
    return (manifest.select("part", "name", "base").repartitionByRange(files, "part")
            .mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def op8(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = shared_path(docs.sparkSession, "token-files")
    return read_ids(write_ids(docs, folder, tokenizer), folder)
