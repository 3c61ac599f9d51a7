"""Ranks, first-per-key and top-k that keep working when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perchero.session import mapped, scratch_path
from perchero.sources.storage import in_name_order, write_table


def first_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the lowest ``order`` per key, with map-side partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    if rest == [order]:
        return rows.groupBy(*keys).agg(F.min(order).alias(order)).select(*rows.columns)
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """The first k rows per key; Spark limits each task's input to k per key before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def _runs(keys: Sequence[str]):
    """Counts sorted rows from 0, all of them (``_row``) and those of one key (``_inside``)."""
    def changed(column) -> np.ndarray:
        """For each row but the first whether the value differs from the row before."""
        differs = pc.not_equal(column.slice(0, len(column) - 1), column.slice(1))
        return differs.to_numpy(zero_copy_only=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, start, last = 0, 0, None  # rows so far, first row of the running key, last row
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)
            for key in keys:
                column = batch.column(batch.schema.get_field_index(key))
                if last is not None:
                    edge = pa.concat_arrays([last[key], column.slice(0, 1)])
                    fresh[0] |= changed(edge)[0]
                fresh[1:] |= changed(column)
            last = {k: batch.column(batch.schema.get_field_index(k)).slice(n - 1) for k in keys}
            row = np.arange(done, done + n)
            starts = np.maximum.accumulate(np.where(fresh, row, start))
            done, start = done + n, starts[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(row), pa.array(row - starts)],
                names=[*batch.schema.names, "_row", "_inside"])

    return count


def _offsets(cut: DataFrame, keys: Sequence[str]) -> list[tuple[int, int]]:
    """(block, rows of its first key in the blocks before it), for keys that go on from block to block."""
    key = F.struct(F.lit(0).alias("_"), *keys)
    edges = cut.groupBy("_block").agg(
        F.min_by(key, "_row").alias("first"), F.max_by(key, "_row").alias("last"),
        F.max_by("_inside", "_row").alias("inside"), F.max("_row").alias("row"),
    )
    found, before, carried = [], None, 0
    for edge in sorted(edges.collect(), key=lambda e: e["_block"]):  # one row per block
        offset = carried if before == edge["first"] else 0
        if offset:
            found.append((edge["_block"], offset))
        whole = edge["inside"] == edge["row"]  # the block's only key
        before, carried = edge["last"], edge["inside"] + 1 + (offset if whole else 0)
    return found


def keyed_position(rows: DataFrame, keys: Sequence[str], order: str, name: str = "position",
                   total: str | None = None, tie: str | None = None,
                   blocks: int | None = None) -> DataFrame:
    """0-based position of each row within its key, by the column ``order``.

    A plain ``row_number`` sorts a whole key in one task. Here all rows are cut into range blocks
    of about equal size by (key, order); Spark draws the bounds from a sample of the data, so sparse
    or clustered values fill the blocks as evenly as dense ones. Blocks are sorted and their rows
    counted along each key, in one pass and one shuffle. Only a block's first key can have rows in
    blocks before it: one small row per block tells how many. ``total`` adds the number of rows of
    the key; ``tie`` breaks equal order values. Rows with a null or NaN key are left out. The blocks are
    written once: bounds drawn twice might differ. They are read in the order of their names, so that rows that
    are numbered twice come in the same order.
    """
    spark = rows.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = [*keys, order, *([tie] if tie else [])]
    known = rows.dropna(subset=list(keys))
    sorted_ = known.repartitionByRange(blocks, *place).sortWithinPartitions(*place).withColumn(
        "_block", F.spark_partition_id())
    schema = T.StructType([*sorted_.schema.fields]).add("_row", "long").add("_inside", "long")
    path = scratch_path(spark, "ranked")
    cut = in_name_order(write_table(mapped(sorted_, _runs(list(keys)), schema), path), path)
    first_key = F.col("_row") == F.col("_inside")
    offsets = F.broadcast(
        spark.createDataFrame(_offsets(cut, keys), "_block int, _offset long"))
    numbered = cut.join(offsets, "_block", "left").withColumn(
        name, F.col("_inside") + F.when(first_key, F.coalesce("_offset", F.lit(0))).otherwise(0))
    out = numbered.select(*rows.columns, name)
    if total:
        sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias(total))
        out = out.join(sizes, list(keys)) if keys else out.crossJoin(sizes)
    return out.select(*rows.columns, name, *([total] if total else []))


def first_rows(rows: DataFrame, order: str, limit: int, blocks: int | None = None) -> DataFrame:
    """The ``limit`` rows with the lowest ``order``, whatever its size, without sorting all in one task.

    Range blocks are counted, the running sum of the counts says which block the limit falls into,
    and only in that one rows are numbered.
    """
    spark = rows.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = write_table(
        rows.repartitionByRange(blocks, order).withColumn("_block", F.spark_partition_id()),
        scratch_path(spark, "ranked"),
    )
    sizes = {r["_block"]: r["n"] for r in cut.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken, whole = 0, []
    for block in sorted(sizes):  # one number per block
        if taken + sizes[block] > limit:
            rest = cut.where(F.col("_block") == block).orderBy(order).limit(limit - taken)
            return cut.where(F.col("_block").isin(whole)).unionByName(rest).drop("_block")
        taken += sizes[block]
        whole.append(block)
    return cut.drop("_block")
