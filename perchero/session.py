"""Session helpers."""

from __future__ import annotations

import math
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
PARTITIONS = "spark.sql.shuffle.partitions"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
# Input rows that one shuffle partition is meant for.
PARTITION_ROWS = 300_000
_scope = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is ``spark.checkpoint.dir``. Where a session leaves that unset, a folder in the warehouse
    (``spark.sql.warehouse.dir``), which all executors share as well, takes its place.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    context = spark.sparkContext
    return f"{scratch_root(spark)}/perchero/{context.applicationId}-{context.startTime}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written intermediate table."""
    folder = getattr(_scope, "folder", None) or run_folder(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables of this thread lie in one folder inside the block, and go with its end.

    What the block computes must be written elsewhere before that.
    """
    outer = getattr(_scope, "folder", None)
    _scope.folder = f"{run_folder(spark)}/scope-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scope.folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _scope.folder = outer


def spread(spark: SparkSession, rows: int) -> int:
    """Raise the number of shuffle partitions to what so many input rows ask for.

    A number fixed for small tables lets every sort, join and written file of a task grow with the
    input. A larger number of the session stays; one raised for a larger input goes back.
    """
    context, now = spark.sparkContext, int(spark.conf.get(PARTITIONS))
    asked, given = getattr(context, "_perchero_spread", (now, now))
    if now != given:  # set by the session's owner since
        asked = now
    wanted = max(asked, math.ceil(rows / PARTITION_ROWS))
    if wanted != now:
        spark.conf.set(PARTITIONS, str(wanted))
    context._perchero_spread = (asked, wanted)
    if not context.getConf().contains(ADVISORY):  # Spark's default joins small partitions to 64 MB
        spark.conf.set(ADVISORY, "16m")
    return wanted


@contextmanager
def dealt_by_part_of_keys(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside may use rows that are dealt by some of the join's keys already."""
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors once, for clusters where it is not installed."""
    context = spark.sparkContext
    if not getattr(context, "_perchero_sent", False):
        home = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/perchero", "zip", home.parent, home.name)
        context.addPyFile(archive)
        context._perchero_sent = True


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    shipped(df.sparkSession)
    return df.mapInArrow(function, schema)
