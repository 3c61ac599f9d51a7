"""Shared helpers: tables, intermediate results, joins with a checked broadcast."""

from __future__ import annotations

import gc
import shutil
import tempfile
from pathlib import Path

import perchero
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perchero.session import scratch_path

#: Sides of at most so many rows (of a few dozen bytes each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000

#: Separates words in the text contracts; the words themselves are lower-cased in A-Z only.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors once, for clusters where it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_perchero_shipped", False):
        return
    home = Path(perchero.__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/perchero", "zip", home.parent, home.name)
    context.addPyFile(archive)
    context._perchero_shipped = True


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    shipped(df.sparkSession)
    return df.mapInArrow(function, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files that nothing refers to any more; it does so after a collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that no later result reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def words(text: Column) -> Column:
    """Lower-cased words of a text (array; empty for null)."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, NON_WORD), "")
