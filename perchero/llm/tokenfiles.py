"""Token-id files of shuffled byte planes.

Layout of a file: blocks of 65,536 ids, each as four byte planes (all lowest bytes, then all second
bytes, ...) that are compressed with zstandard one by one; then the chunk index and the document index,
compressed alike; then a fixed trailer (sizes of both and a marker). High planes of small ids are
constant and shrink to a few bytes.

A file is written under the name of its task attempt and moved to its final name when it is whole, so
a task that is run again leaves the same file.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perchero.llm.common import mapped, stored
from perchero.llm.encode import block_texts, encoder
from perchero.llm.textblock import blocks
from perchero.session import scratch_path

BLOCK_IDS = 1 << 16
PLANES = 4
END = 2
MARK = b"PLANES01"
_TRAILER = struct.Struct("<qqq8s")
_CHUNK = struct.Struct("<qqqIIII")


class Writer:
    """Writes ids in order; :meth:`close` adds the indexes."""

    def __init__(self, out, level: int = 1):
        self.out, self.at = out, 0
        self.packer = zstandard.ZstdCompressor(level=level)
        self.rest = np.zeros(0, np.uint32)
        self.chunks: list[bytes] = []
        self.ids, self.lengths = [], []
        self.total = 0

    def _put(self, raw: bytes) -> int:
        small = self.packer.compress(raw)
        self.out.write(small)
        self.at += len(small)
        return len(small)

    def _block(self, ids: np.ndarray) -> None:
        start = self.at
        planes = ids.astype("<u4").view(np.uint8).reshape(-1, PLANES)
        sizes = [self._put(np.ascontiguousarray(planes[:, p]).tobytes()) for p in range(PLANES)]
        self.chunks.append(_CHUNK.pack(start, self.total, len(ids), *sizes))
        self.total += len(ids)

    def add(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.ids += doc_ids
        self.lengths.append(counts)
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) // BLOCK_IDS * BLOCK_IDS
        for k in range(0, whole, BLOCK_IDS):
            self._block(ids[k: k + BLOCK_IDS])
        self.rest = ids[whole:].copy()

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        chunk_size = self._put(b"".join(self.chunks))
        known = np.array([0 if i is None else i for i in self.ids], "<i8").tobytes()
        null = np.array([i is None for i in self.ids], np.uint8).tobytes()
        lengths = np.concatenate([*self.lengths, np.zeros(0, np.int64)]).astype("<i8").tobytes()
        doc_size = self._put(known + lengths + null)
        self.out.write(_TRAILER.pack(chunk_size, doc_size, len(self.ids), MARK))


class Reader:
    """Reads a file by its indexes; any block can be read alone."""

    def __init__(self, source, size: int):
        self.source = source
        self.unpacker = zstandard.ZstdDecompressor()
        source.seek(size - _TRAILER.size)
        chunk_size, doc_size, n, mark = _TRAILER.unpack(source.read(_TRAILER.size))
        if mark != MARK:
            raise ValueError("not a token file")
        source.seek(size - _TRAILER.size - doc_size - chunk_size)
        chunks = self.unpacker.decompress(source.read(chunk_size))
        documents = self.unpacker.decompress(source.read(doc_size))
        self.chunks = list(_CHUNK.iter_unpack(chunks))
        known = np.frombuffer(documents, "<i8", n)
        self.lengths = np.frombuffer(documents, "<i8", n, 8 * n)
        null = np.frombuffer(documents, np.uint8, n, 16 * n)
        self.doc_ids = [None if gone else i for i, gone in zip(known.tolist(), null.tolist(), strict=True)]

    def block(self, k: int) -> np.ndarray:
        start, _, n, *sizes = self.chunks[k]
        self.source.seek(start)
        planes = np.empty((n, PLANES), np.uint8)
        for p, size in enumerate(sizes):
            planes[:, p] = np.frombuffer(self.unpacker.decompress(self.source.read(size)), np.uint8)
        return planes.reshape(-1).view("<u4")

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, ids before it in the file, number of ids, crc32 of them; one block in memory."""
        k, held, used, before = 0, np.zeros(0, "<u4"), 0, 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            crc, left = 0, n
            while left:
                if used == len(held):
                    held, used, k = self.block(k), 0, k + 1
                take = min(left, len(held) - used)
                crc = zlib.crc32(held[used: used + take].tobytes(), crc)
                used, left = used + take, left - take
            yield doc_id, before, n, crc
            before += n


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> DataFrame:
    """Encode whole texts in ascending doc_id order into files of ``folder``; one row per file.

    Rows: file number, path, documents and ids in it. Files follow each other in doc_id order. A null
    or empty text is its end id alone; ties on doc_id are ordered by a hash of the text; rows without
    an id come first.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        parts, *order).sortWithinPartitions(*order)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encoder_ = TaskContext.get(), encoder(tokenizer, special=True)
        number, sink, writer = context.partitionId(), None, None
        store, root = fs.FileSystem.from_uri(folder)
        mine = f"{root}/attempt-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        for batch in batches:
            for block in blocks(batch):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(mine)
                    writer = Writer(sink)
                ids, counts = encoder_.encode(block_texts(block), end)
                writer.add(batch.column("doc_id").slice(block.first, block.rows).to_pylist(), counts, ids)
        if writer is None:
            return
        writer.close()
        sink.close()
        store.move(mine, f"{root}/{number:08d}.planes")
        yield pa.RecordBatch.from_pydict({
            "file": [number], "path": [f"{folder}/{number:08d}.planes"], "documents": [len(writer.ids)],
            "ids": [writer.total]}, schema=pa.schema([
                ("file", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    return mapped(ranged, save, "file long, path string, documents long, ids long")


def read(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    spread = based.select("path", "base").repartition(
        int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    shape = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(batch.column(c).to_pylist() for c in ("path", "base")), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as source:
                    rows = []
                    for doc_id, start, n, crc in Reader(source, source.size()).documents():
                        rows.append((doc_id, base + start, n, crc))
                        if len(rows) == 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=shape)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=shape)

    return mapped(spread, load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def uri(path: str) -> str:
    """A path of the shared folder as a URI, which pyarrow's file systems need."""
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def written_and_read(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    folder = uri(scratch_path(docs.sparkSession, "planes"))
    return read(stored(write(docs, tokenizer, folder, end), "files"))


def round_trip(ids: np.ndarray) -> np.ndarray:
    """Ids through a file in memory, for checks."""
    out = io.BytesIO()
    writer = Writer(out)
    writer.add([0], np.array([len(ids)]), ids.astype(np.uint32))
    writer.close()
    reader = Reader(out, out.tell())
    return np.concatenate([reader.block(k) for k in range(len(reader.chunks))] or [np.zeros(0, "<u4")])
