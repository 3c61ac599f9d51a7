"""Written intermediate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


# Folders a task may write side by side; only beyond that are its rows sorted by folder.
FOLDERS = 8
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_table(table: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table and read it back: later plans start from the stored files.

    With ``partition_by`` (columns of few values) a task keeps one file open per value. Spark's
    default sorts all rows of a task by these columns instead.
    """
    spark = table.sparkSession
    writers = spark.conf.get(WRITERS)
    if partition_by:
        spark.conf.set(WRITERS, str(FOLDERS))
    try:
        table.write.mode("overwrite").partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(WRITERS, writers)
    return spark.read.schema(table.schema).parquet(path).select(*table.columns)


def in_name_order(table: DataFrame, path: str) -> DataFrame:
    """What :func:`write_table` has written to ``path``, files of equal size in the order of their names.

    Spark reads large files first, and equal ones in the order in which the file system lists them.
    """
    spark = table.sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    found = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(files)
    names = sorted(f.getPath().toString() for f in found)
    return spark.read.schema(table.schema).parquet(*names).select(*table.columns) if names else table
