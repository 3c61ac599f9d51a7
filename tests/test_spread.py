"""Steps that must not grow with the input in one task, and joins dealt once."""

from __future__ import annotations

import math
from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

from check import normalised
from perchero.operators import dataset, generate
from perchero.operators.ranking import keyed_position
from perchero.session import PARTITION_ROWS, PARTITIONS, dealt_by_part_of_keys, spread
from perchero.sources import tables
from perchero.sources.storage import write_table


def plan(df) -> str:
    with redirect_stdout(StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_partitions_follow_the_input(spark):
    before = spark.conf.get(PARTITIONS)
    try:
        spark.conf.set(PARTITIONS, "8")
        assert spread(spark, 100) == 8
        assert spread(spark, 50 * PARTITION_ROWS) == 50 == int(spark.conf.get(PARTITIONS))
        assert spread(spark, 20 * PARTITION_ROWS) == 20  # back with a smaller input
        spark.conf.set(PARTITIONS, "40")
        assert spread(spark, 20 * PARTITION_ROWS) == 40  # the session's own larger number stays
        spark.conf.set(PARTITIONS, "8")
        assert spread(spark, 100) == 8
    finally:
        spark.conf.set(PARTITIONS, before)


def test_generated_wardrobes_are_dealt(spark):
    users = generate.users(spark.range(64, numPartitions=1).withColumnRenamed("id", "user_id"))
    tasks = generate.wardrobes(users).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "CSV_ROWS", 10)
    tables.write_csv(spark.range(95, numPartitions=1), str(tmp_path / "csv"))
    found = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    sizes = [r["count"] for r in found.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 95 and max(sizes) == 10


def test_folders_hold_their_rows(spark, tmp_path):
    rows = spark.range(1000).withColumn("g", F.concat(F.lit("g"), F.col("id") % 20))
    got = write_table(rows, str(tmp_path / "t"), ["g"])  # more folders than files open at once
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


@pytest.mark.parametrize("blocks", [1, 7])
def test_positions_along_runs(spark, blocks):
    """Keys that end, begin and go on across blocks and Arrow batches, null and NaN left out, no second shuffle."""
    keys = [1.0] * 30 + [2.0] * 3 + [float("nan")] * 25 + [3.0] + [None] * 4 + [0.0, -0.0]
    rows = spark.createDataFrame([(k, i * 7 % 97) for i, k in enumerate(keys)], "k double, v int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = keyed_position(rows, ["k"], "v", "p", "n", blocks=blocks)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    values: dict = {}
    for i, k in enumerate(keys):
        if k is not None and not math.isnan(k):
            values.setdefault(k + 0.0, []).append(i * 7 % 97)
    want = sorted((k, v, p, len(vs)) for k, vs in values.items() for p, v in enumerate(sorted(vs)))
    assert sorted((r.k + 0.0, r.v, r.p, r.n) for r in got.collect()) == want
    alone = plan(keyed_position(rows, ["k"], "v", "p", blocks=blocks))
    assert "Window" not in alone and "hashpartitioning" not in alone


@pytest.mark.parametrize("hot", [200_000, 3])
def test_drawn_outfits_join_like_others(spark, monkeypatch, hot):
    """Joined by user, also in slices of a busy one, with a repeated user, context and garment and a lost one."""
    monkeypatch.setattr(dataset, "HOT_ROWS", hot)
    ids = spark.range(5).withColumnRenamed("id", "user_id")
    users = generate.users(ids).unionByName(generate.users(ids.filter("user_id = 2")))
    garments = generate.wardrobes(generate.users(ids))
    keys = spark.range(40).select(F.col("id").alias("context_id"), F.expr("if(id < 20, 1, id % 5)").alias("user_id"))
    contexts = generate.contexts(keys).join(keys, "context_id")
    contexts = contexts.unionByName(contexts.filter("context_id = 7"))
    attempts = keys.select(F.col("context_id").alias("rating_id"), "user_id", "context_id")
    outfits = generate.draw_outfits(attempts, garments)
    chosen = outfits.filter("rating_id = 9").first()
    garments = garments.unionByName(garments.filter(F.col("garment_id") == chosen.top_garment_id))
    garments = garments.filter(F.col("garment_id") != chosen.shoes_garment_id)
    plain = dataset.full_dataset(outfits, users, contexts, garments)
    with dealt_by_part_of_keys(spark):
        drawn = dataset.full_dataset(outfits, users, contexts, garments, drawn=True)
        assert drawn.columns == plain.columns
        assert normalised(drawn.columns, drawn.collect()) == normalised(plain.columns, plain.collect())
        wide = generate.rated(outfits, users, contexts, garments, drawn=True)
        narrow = generate.rate(outfits, users, contexts, garments)
        assert normalised(narrow.columns, wide.select(*narrow.columns).collect()) == normalised(
            narrow.columns, narrow.collect())
    assert set(wide.columns) == {*plain.columns, "rating"}
