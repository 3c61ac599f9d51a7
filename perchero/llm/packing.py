"""Packing along a space-filling curve.

A document's ids are counted into a hashed vector, the vector is projected to four dimensions, and
the cell of that point along a Hilbert curve is the document's key. Documents are laid end to end in
the order (key, doc_id) and cut every 2048 ids: neighbours on the curve share sequences, copies
stand side by side, and only the last sequence has padding. The ids are range-partitioned once; a running
sum inside each range and the totals of the ranges before it give the positions, so no task sees more
than its range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perchero.llm.common import discard, mapped, stored
from perchero.llm.encode import block_texts, encoder
from perchero.llm.textblock import blocks, mixed

LENGTH = 2048
END = 1
BUCKETS, DIMENSIONS, BITS = 512, 4, 12
#: Ids that are cut at a time.
PIECES_IDS = 1 << 21
#: Buckets of the ids below 2^16, in a table.
_BUCKET = (mixed(np.arange(1 << 16)) % np.uint64(BUCKETS)).astype(np.int64)


def _projection() -> np.ndarray:
    """Fixed +-1 directions, one per bucket and dimension."""
    draw = mixed(np.arange(BUCKETS * DIMENSIONS, dtype=np.uint64)) & np.uint64(1)
    return (draw.astype(float) * 2 - 1).reshape(BUCKETS, DIMENSIONS)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of integer cells (points x dimensions, ``bits`` bits each) along the Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(set_, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The Hilbert key of each document, from its ids."""
    if ids.max(initial=0) < len(_BUCKET):
        bucket = _BUCKET[ids]
    else:
        bucket = (mixed(ids) % np.uint64(BUCKETS)).astype(np.int64)
    first = np.repeat(np.arange(len(counts)) * BUCKETS, counts)
    vector = np.log1p(np.bincount(first + bucket, minlength=len(counts) * BUCKETS))
    vector = vector.reshape(len(counts), BUCKETS)
    vector -= vector.mean(axis=1, keepdims=True)
    norm = np.sqrt((vector**2).sum(axis=1, keepdims=True))
    point = vector @ _projection() / np.maximum(norm, 1e-12)
    share = 1 / (1 + np.exp(-1.7 * point))
    cells = np.clip((share * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert(cells)


def id_type(tokenizer: str, end: int = END) -> str:
    """The narrowest unsigned type that holds every id of the tokenizer."""
    largest = max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0)
    return "<u2" if max(largest, end) < 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Per document: doc_id, key, n_tokens (with the end id), ids (little-endian, of :func:`id_type`)."""
    narrow = id_type(tokenizer, end)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_ = encoder(tokenizer, special=True)
        for batch in batches:
            for block in blocks(batch):
                ids, counts = encoder_.encode(block_texts(block), end)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, block.rows), pa.array(curve_keys(ids, counts)),
                     pa.array(counts), _sliced(ids.astype(narrow), counts)],
                    names=["doc_id", "key", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), encode, f"doc_id {kind}, key long, n_tokens long, ids binary")


def _sliced(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value for each run of ``counts`` values, without a copy per row."""
    ends = np.concatenate(([0], np.cumsum(counts))) * values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values)]
    ).cast(pa.binary())


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``ahead``: the ids before each row in its partition."""
    before = 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        ahead = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_tokens"), batch.column("ids"), pa.array(ahead)],
            names=["doc_id", "n_tokens", "ids", "ahead"])


def placed(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (part, ahead, doc_id, n_tokens, ids) in the order (key, doc_id, row) of range partitions, and
    ``base``, the ids before each part."""
    spark = tokens.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "doc_id", "row"]
    kind = tokens.schema["doc_id"].dataType.simpleString()
    ranged = stored(mapped(
        tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("key", "row"), _running,
        f"doc_id {kind}, n_tokens long, ids binary, ahead long").withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    return ranged, totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Each id lies in one piece; sequence ids count from 0 without gaps and every sequence but the last
    is full. ``ids`` are little-endian 32-bit integers. A null or empty text is its end id alone. Rows that
    repeat a doc_id are laid one after the other, each with its own pieces. No documents give no pieces. Other
    columns are ignored.
    """
    tokens = stored(encoded(docs, tokenizer, end).withColumn("row", F.monotonically_increasing_id()), "tokens")
    ranged, bases = placed(tokens)
    discard(tokens)
    laid = ranged.join(F.broadcast(bases), "part").select(
        "doc_id", "ids", (F.col("base") + F.col("ahead")).alias("position"))
    narrow = id_type(tokenizer, end)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut(batch, narrow, length)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(
        laid, cut,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "ids binary")


def _cut(batch: pa.RecordBatch, narrow: str, length: int) -> Iterator[pa.RecordBatch]:
    """The pieces of each row, some MB of ids at a time."""
    width = np.dtype(narrow).itemsize
    column = batch.column("ids").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(at) // width
    position = batch.column("position").to_numpy()
    first = 0
    while first < len(sizes):
        upto = np.cumsum(sizes[first:])
        last = first + max(1, int(np.searchsorted(upto, PIECES_IDS, "right")))
        n, where = sizes[first:last], position[first:last]
        ids = raw[at[first]: at[last]].view(narrow).astype("<u4")
        pieces = (where + n - 1) // length - where // length + 1
        row = np.repeat(np.arange(len(n)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.maximum((where[row] // length + number) * length, where[row])
        close = np.minimum((where[row] // length + number + 1) * length, (where + n)[row])
        edges = np.concatenate(([0], np.cumsum(close - begin)))
        flat = memoryview(ids).cast("B")
        crc = [zlib.crc32(flat[4 * a: 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").slice(first, last - first).take(pa.array(row)),
             *(pa.array(x, pa.int64()) for x in (
                 begin - where[row], close - begin, crc, n[row], begin // length, begin % length)),
             _sliced(ids, close - begin)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        first = last
