"""Token counts by separator scan over flat token files without an index.

Flat files hold 16-bit ids, each document closed by the end-of-document id, and nothing else. Files
are scanned in blocks that know nothing of documents: a block finds all separators in one vectorised
comparison and reports the ids before the first, between neighbours and after the last. A prefix scan
over a file's blocks (running number of separators, running maximum of the last separator's place)
stitches documents across block boundaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perchero.llm.common import mapped, stored
from perchero.llm.encode import block_texts, encoder
from perchero.llm.textblock import blocks
from perchero.llm.tokenfiles import uri
from perchero.session import scratch_path

END = 50256
BLOCK_IDS = 1 << 20


def write_flat(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> DataFrame:
    """Encode whole texts into one flat file per task; rows (file, ordinal, doc_id, ids of the file so far)."""
    shape = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encoder_ = TaskContext.get(), encoder(tokenizer)
        store, root = fs.FileSystem.from_uri(folder)
        # each attempt has a file of its own: only the one whose rows are kept is ever read
        name, sink, seen = f"{context.partitionId():08d}-{uuid.uuid4().hex}.ids", None, 0
        try:
            for batch in batches:
                for block in blocks(batch):
                    if sink is None:
                        store.create_dir(root, recursive=True)
                        sink = store.open_output_stream(f"{root}/{name}")
                    ids, _ = encoder_.encode(block_texts(block), end)
                    if len(ids) and int(ids.max()) > 0xFFFF:
                        raise ValueError("this vocabulary needs more than 16 bits")
                    sink.write(ids.astype("<u2").tobytes())
                    rows = batch.column("doc_id").slice(block.first, block.rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{folder}/{name}"] * block.rows, pa.string()),
                         pa.array(np.arange(seen, seen + block.rows)), rows.cast(pa.int64())], schema=shape)
                    seen += block.rows
        finally:
            if sink is not None:
                sink.close()

    return mapped(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), save,
        "path string, ordinal long, doc_id long")


def block_list(paths: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(path, block, first, ids): the blocks of each file, by its size alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                n = store.get_file_info(at).size // 2
                rows += [(path, k, first, min(block_ids, n - first)) for k, first in enumerate(range(0, n, block_ids))]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(shape.names, row, strict=True)) for row in rows], schema=shape)

    shape = pa.schema([("path", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("ids", pa.int64())])
    return mapped(paths, cut, "path string, block long, first long, ids long")


def scan(block_rows: DataFrame, end: int = END) -> DataFrame:
    """Per block: places of its separators (from the file's start) as ``at``."""
    shape = pa.schema([
        ("path", pa.string()), ("block", pa.int64()), ("at", pa.list_(pa.int64()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, at = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(at) as source:
                    ids = np.frombuffer(source.read_at(2 * row["ids"], 2 * row["first"]), "<u2")
                found = np.flatnonzero(ids == end) + row["first"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["block"]]), pa.array([found], pa.list_(pa.int64()))],
                    schema=shape)

    return mapped(block_rows, search, "path string, block long, at array<bigint>")


def lengths(found: DataFrame) -> DataFrame:
    """Per document of a file: ``ordinal``, ``start`` and ``n_tokens`` (without the separator)."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        found.withColumn("n", F.size("at")).withColumn("last", F.try_element_at("at", F.lit(-1)))
        .withColumn("ordinals", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("from", F.coalesce(F.max("last").over(before), F.lit(-1)) + 1)
    )
    return (
        stitched.where("n > 0")
        .select(
            "path", "ordinals",
            F.concat(F.array("from"), F.transform(F.slice("at", 1, F.col("n") - 1), lambda x: x + 1)).alias("starts"),
            "at")
        .select("path", "ordinals", F.posexplode(F.arrays_zip("starts", "at")).alias("k", "d"))
        .select(
            "path", (F.col("ordinals") + F.col("k")).alias("ordinal"), F.col("d.starts").alias("start"),
            (F.col("d.at") - F.col("d.starts")).alias("n_tokens"))
    )


def token_counts(docs: DataFrame, tokenizer: str, end: int = END, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Per document: doc_id, n_tokens, and its start in its flat file.

    Null and empty texts have 0 tokens. Repeated rows are counted each for itself. No documents give
    no files and no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = uri(scratch_path(spark, "flat"))
    order = stored(write_flat(docs, tokenizer, folder, end), "order")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = order.select("path").distinct()
    rows = block_list(paths, block_ids).repartition(parts, "path", "block")
    # one row per document on both sides: merged at every size, as files compress far below their size in memory
    counted = lengths(scan(rows, end)).hint("merge")
    return order.join(counted, ["path", "ordinal"]).select(
        "doc_id", "n_tokens", "start", "ordinal", F.element_at(F.split("path", "/"), -1).alias("file"))
