"""Ranking helpers, wardrobes, sources, generator, training table and evaluation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perchero import lookups as L
from perchero import schemas as S
from perchero.functions import expert, metrics
from perchero.functions.hashing import draw
from perchero.operators import dataset, evaluate, generate, wardrobe
from perchero.operators import ranking
from perchero.operators.ranking import first_per_key, first_rows, keyed_position, top_k
from perchero.sources import tables
from perchero.sources.storage import in_name_order, write_table


def keyed(spark, n=400):
    key = F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 5)
    return spark.range(n).select(key.alias("k"), (F.col("id") * 37 % 1009).alias("v"), "id")


@pytest.mark.parametrize("blocks", [1, 7, None])
def test_positions_equal_row_numbers(spark, blocks):
    rows = keyed_position(keyed(spark), ["k"], "v", "p", "n", tie="id", blocks=blocks)
    by = W.partitionBy("k")
    check = rows.withColumn("want", F.row_number().over(by.orderBy("v", "id")) - 1).withColumn(
        "size", F.count("*").over(by))
    assert check.count() == 400
    assert check.filter("p <> want or n <> size").count() == 0


def test_numbered_blocks_are_read_in_one_order(spark, tmp_path):
    """Files of equal size come as the file system lists them, which changed the blocks that forests draw rows from."""
    path = tmp_path / "table"
    table = write_table(spark.range(0, 8, 1, 8).repartitionByRange(8, "id").select("id"), str(path))
    files = sorted(path.glob("part-*"))
    assert len(files) == 8 and len({f.stat().st_size for f in files}) < 8
    got = in_name_order(table, str(path))
    wanted = [i for f in sorted(files, key=lambda f: -f.stat().st_size) for i in pq.read_table(f).column("id").to_pylist()]
    assert got.schema == table.schema and [r.id for r in got.collect()] == wanted and len(wanted) == 8


def test_global_positions(spark):
    rows = keyed_position(keyed(spark).drop("k"), [], "id", "p", blocks=16)
    assert rows.filter("p <> id").count() == 0


def test_sparse_ids_fill_the_blocks(spark, monkeypatch):
    """Ids far apart, as the library's own inserts make them, and one key with most rows."""
    kept = []
    monkeypatch.setattr(ranking, "write_table", lambda table, path: kept.append(write_table(table, path)) or kept[-1])
    step = 10**17 // 1000
    rows = spark.range(6000).select(
        F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 7).alias("k"),
        ((F.col("id") * 7919 % 6007) * step).alias("v"))
    got = keyed_position(rows, ["k"], "v", "p", blocks=12)
    by = W.partitionBy("k").orderBy("v")
    assert got.withColumn("want", F.row_number().over(by) - 1).filter("p <> want").count() == 0
    sizes = [r["count"] for r in kept[0].groupBy("_block").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 3 * 6000 / 12


@pytest.mark.parametrize("limit", [0, 1, 399, 400, 5000])
def test_first_rows(spark, limit):
    rows = keyed(spark).withColumn("v", F.col("id") * 10**15)
    got = first_rows(rows, "v", limit, blocks=5)
    assert got.columns == rows.columns
    assert sorted(r.id for r in got.collect()) == list(range(min(limit, 400)))


def test_generator_limits(spark):
    users, garments, contexts = small(spark)
    attempts = contexts.select(F.col("context_id").alias("rating_id"), "user_id", "context_id")
    every = sorted(generate.limited_outfits(attempts, garments).collect())
    ids = sorted(r.rating_id for r in attempts.collect())
    for rows, tries in ((3, None), (None, 7), (4, 9), (10**6, 10**6)):
        got = sorted(generate.limited_outfits(attempts, garments, rows, tries).collect())
        assert got == [r for r in every if r.rating_id in ids[:tries]][:rows]


def test_first_and_top(spark):
    rows = keyed(spark)
    firsts = {r.k: (r.v, r.id) for r in first_per_key(rows, ["k"], "v").collect()}
    tops = top_k(rows, ["k"], [F.col("v"), F.col("id")], 2).collect()
    assert all(firsts[r.k] == (r.v, r.id) for r in tops if r["rank"] == 1)
    assert max(r["rank"] for r in tops) == 2
    alone = first_per_key(rows.select("k", "v"), ["k"], "v").collect()
    assert {r.k: r.v for r in alone} == {k: v for k, (v, _) in firsts.items()}


def small(spark):
    users = generate.users(spark.range(1, 41).withColumnRenamed("id", "user_id"))
    garments = generate.wardrobes(users)
    contexts = generate.contexts(spark.range(1, 301).withColumnRenamed("id", "context_id"))
    contexts = contexts.withColumn("user_id", F.col("context_id") % 40 + 1)
    return users, garments, contexts


def test_generator_ranges(spark):
    users, garments, contexts = small(spark)
    assert users.filter(~F.col("age").between(18, 65)).count() == 0
    sizes = [r["count"] for r in garments.groupBy("user_id").count().collect()]
    assert min(sizes) >= 25 and max(sizes) <= 35 and len(sizes) == 40
    assert garments.filter(~F.col("formality_level").between(1, 5)).count() == 0
    assert garments.select("garment_id").distinct().count() == sum(sizes)
    for season, (low, high) in L.SEASON_TEMPERATURE.items():
        span = contexts.filter(F.col("season") == season).agg(
            F.min("temperature"), F.max("temperature")).first()
        assert low <= span[0] and span[1] <= high
    for activities, (low, high) in L.ACTIVITY_FORMALITY:
        outside = contexts.filter(F.col("activity").isin(activities))
        assert outside.filter(~F.col("formality_level").between(low, high)).count() == 0


def test_ratings(spark):
    users, garments, contexts = small(spark)
    rated = generate.ratings(users, garments, contexts).collect()
    owners = {r.garment_id: (r.user_id, r.type_group) for r in garments.collect()}
    complete = {r.user_id for r in wardrobe.complete_users(garments).collect()}
    assert {r.user_id for r in rated} <= complete and rated
    for r in rated:
        assert r.rating in (1.0, 2.0, 3.0, 4.0, 5.0)
        for role in L.ROLES:
            assert owners[r[f"{role}_garment_id"]] == (r.user_id, role)
    capped = generate.ratings(users, garments, contexts, max_rows=20).collect()
    ids = sorted(r.rating_id for r in rated)
    assert sorted(r.rating_id for r in capped) == ids[:20]
    twice = spark.createDataFrame(rated).drop("rating")
    again = twice.unionAll(twice.withColumn("rating_id", F.col("rating_id") + 1000))
    assert sorted(r.rating_id for r in generate.unique_outfits(again).collect()) == ids


def test_rounding(spark):
    df = spark.createDataFrame([(0.2,), (2.5,), (3.5,), (4.49,), (7.0,)], "x double").coalesce(1)
    got = [r[0] for r in df.select(expert.to_rating(F.col("x"))).collect()]
    assert got == [1.0, 2.0, 4.0, 4.0, 5.0]
    noise = spark.range(2000).agg(F.min(expert.noise(F.col("id"))),
                                  F.max(expert.noise(F.col("id")))).first()
    assert -0.4 <= noise[0] < -0.39 and 0.39 < noise[1] <= 0.4


def test_csv_round_trip_and_full_dataset(spark, tmp_path):
    users, garments, contexts = small(spark)
    rated = generate.ratings(users, garments, contexts)
    written = {
        "users": users.withColumnRenamed("user_id", "id"),
        "garments": garments.withColumnRenamed("garment_id", "id").drop("image_url").select(
            S.GARMENTS_CSV.names),
        "contexts": contexts.withColumnRenamed("context_id", "id").select(S.CONTEXTS_CSV.names),
        "ratings": rated.withColumnRenamed("rating_id", "id"),
    }
    paths = {name: str(tmp_path / f"{name}.csv") for name in written}
    for name, table in written.items():
        tables.write_csv(table, paths[name])
    read = tables.read_csv_tables(spark, paths)
    assert read["users"].columns == S.USERS.names
    full = dataset.full_dataset(**read)
    assert len(full.columns) == 46 and full.count() == rated.count()
    assert full.columns[:7] == S.RATINGS.names
    direct = dataset.full_dataset(rated, users, contexts, garments)
    assert full.exceptAll(direct.select(full.columns)).count() == 0
    assert not set(dataset.drop_ids(full).columns) & set(L.ID_COLUMNS)
    shape = evaluate.dataset_shape(full).first()
    assert (shape.n_columns, shape.n_rows) == (46, full.count())
    with pytest.raises(tables.MissingTables, match="contexts, ratings"):
        tables.read_csv_tables(spark, {
            "users": paths["users"], "garments": paths["garments"],
            "contexts": str(tmp_path / "nothing"),
        })


def test_csv_by_name_and_bad_rows(spark, tmp_path):
    path = str(tmp_path / "users.csv")
    with open(path, "w") as out:
        out.write('gender,age,id,further,username,body_shape,style_preference,skin_tone\n')
        out.write('mujer,31,1,z,"a, b",pera,urbano,fría\n,x,2,,c,,,\n,,3,,"two\nlines",,,\n,5,y9,,d,,,\n')
    good = {r.id: r for r in tables.read_csv(spark, path, S.USERS_CSV).collect()}
    assert sorted(good) == [1, 3] and good[1].username == "a, b" and good[1].age == 31
    assert good[3].username == "two\nlines" and good[3].age is None and good[1].gender == "mujer"
    bad = {r.id: r.wrong_columns for r in tables.bad_csv_rows(spark, path, S.USERS_CSV).collect()}
    assert bad == {"2": "age", "y9": "id"}
    with open(path, "w") as out:
        out.write("id,age\n1,2\n")
    with pytest.raises(tables.MissingColumns, match="username"):
        tables.read_csv(spark, path, S.USERS_CSV)


def test_unmatched_keys_stay(spark):
    users, garments, contexts = small(spark)
    lost = spark.createDataFrame([(1, 999, 999, 1, 2, 3, 4.0)], S.RATINGS)
    row = dataset.full_dataset(lost, users, contexts, garments).first()
    assert row.rating == 4.0 and row.username is None and row.top_type is None


def test_params_and_context_log(spark, tmp_path):
    tables.write_params(spark, L.BEST_PARAMS, str(tmp_path / "params"))
    assert tables.read_params(spark, str(tmp_path / "params")) == L.BEST_PARAMS
    _, _, contexts = small(spark)
    for _ in range(2):
        tables.append_contexts(contexts.limit(5), str(tmp_path / "log"))
    assert tables.read_parquet(spark, str(tmp_path / "log")).count() == 10


def test_wardrobe_pages(spark):
    users, garments, _ = small(spark)
    pages = wardrobe.wardrobe_pages(garments, 10).collect()
    assert max(len(r.garments) for r in pages) == 10
    assert sum(len(r.garments) for r in pages) == garments.count()
    mine = [g.garment_id for r in sorted(pages, key=lambda r: r.page) if r.user_id == 1
            for g in r.garments]
    assert mine == sorted(mine)


def test_lookups(spark):
    users, garments, _ = small(spark)
    chosen = wardrobe.with_palette(users).collect()
    assert len(chosen) == 40
    for r in chosen:
        known = (r.style_preference, r.gender) in L.PALETTES
        assert r.palette_gender == (r.gender if known else "mujer")
        assert not set(r.off_colors) & set(r.colors)
    roles = {r.type: r.role for r in wardrobe.with_meta(garments).collect()}
    assert roles.get("pumps", "formal") == "formal" and roles.get("bomber", "") == ""


def test_folds(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("rating_id"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") % 4 + 1).cast("double"))
        .alias("rating"),
    )
    folded = evaluate.stratified_folds(rows)
    sizes = folded.groupBy("rating").pivot("fold").count().collect()
    for row in sizes:
        counts = [row[str(f)] for f in range(5)]
        assert max(counts) - min(counts) <= 1
    assert folded.count() == 3000
    train, test = evaluate.split(rows)
    assert train.count() + test.count() == 3000
    assert 500 < test.count() < 700


def test_metrics(spark):
    rng = np.random.default_rng(3)
    actual = rng.integers(1, 6, 500).astype(float)
    guess = actual + rng.normal(0, 0.5, 500)
    df = spark.createDataFrame(list(zip(actual.tolist(), guess.tolist())), "a double, p double")
    row = df.agg(*[c.alias(n) for n, c in
                   metrics.all_metrics(F.col("a"), F.col("p")).items()]).first()
    error = actual - guess
    assert row.mae == pytest.approx(np.abs(error).mean())
    assert row.mape == pytest.approx((np.abs(error) / actual).mean())
    assert row.rmse == pytest.approx(math.sqrt((error ** 2).mean()))
    total = ((actual - actual.mean()) ** 2).sum()
    assert row.r2 == pytest.approx(1 - (error ** 2).sum() / total)


def test_histogram(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(3, 1, 1000)
    df = spark.createDataFrame([(float(v),) for v in values], "prediction double")
    rows = sorted(evaluate.histogram(df).collect(), key=lambda r: r.bin)
    counts, edges = np.histogram(values, bins=30)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.bin_low for r in rows] == pytest.approx(edges[:-1].tolist())
    flat = spark.createDataFrame([(2.0,)] * 3, "prediction double")
    assert [r.n for r in evaluate.histogram(flat).collect() if r.n] == [3]


def test_draws(spark):
    import hashlib

    row = spark.range(1).select(draw(F.lit(12345), "age").alias("h")).first()
    assert row.h == int(hashlib.md5(b"12345:age").hexdigest()[:8], 16)
