"""The denormalised training table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perchero import lookups as L
from perchero.operators.wardrobe import with_meta

KEYS = {"users": "user_id", "contexts": "context_id", "garments": "garment_id",
        "ratings": "rating_id"}

# Contexts of one user that one task may join with the user's garments.
HOT_ROWS = 200_000


def standard_key(table: DataFrame, key: str) -> DataFrame:
    """Rename ``id`` to the table's key unless that key already exists."""
    if "id" in table.columns and key not in table.columns:
        return table.withColumnRenamed("id", key)
    return table


def add_prefix(table: DataFrame, prefix: str) -> DataFrame:
    return table.select([F.col(c).alias(f"{prefix}{c}") for c in table.columns])


def full_dataset(ratings: DataFrame, users: DataFrame, contexts: DataFrame,
                 garments: DataFrame, drawn: bool = False) -> DataFrame:
    """Ratings with user, context and three garments: five left equi-joins, 46 columns.

    The garment side is one table read under three prefixes, without the image column. ``drawn``
    says that each garment is one of the row's own user and of the role's group, as
    :func:`perchero.operators.generate.draw_outfits` draws them.
    """
    facts = standard_key(ratings, KEYS["ratings"])
    users = standard_key(users, KEYS["users"])
    contexts = standard_key(contexts, KEYS["contexts"])
    garments = standard_key(garments, KEYS["garments"]).drop("image_url")
    context_columns = [c for c in contexts.columns if c not in ("user_id", "context_id")]
    dated = contexts.select("context_id", *context_columns)
    if drawn:
        out = _with_own_garments(
            facts.join(dated, "context_id", "left"), users, contexts, garments)
    else:
        out = facts.join(users, "user_id", "left").join(dated, "context_id", "left")
        for role in L.ROLES:
            out = out.join(add_prefix(garments, f"{role}_"), f"{role}_garment_id", "left")
    first = [*facts.columns, *[c for c in users.columns if c != "user_id"], *context_columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def _with_own_garments(facts: DataFrame, users: DataFrame, contexts: DataFrame,
                       garments: DataFrame) -> DataFrame:
    """The user, and garments of the row's own user and the role's group.

    Facts and garments are dealt by user once, and the widening rows stay there. Where users have
    more than ``HOT_ROWS`` contexts, theirs are dealt over slices, to each of which their garments go.
    """
    counts = contexts.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / HOT_ROWS).alias("_slices"))
    hot = counts.filter(F.col("user_id").isNotNull() & (F.col("_slices") > 1)).collect()  # few by their size
    keys = ["user_id"]
    if hot:
        slices = F.broadcast(contexts.sparkSession.createDataFrame(
            hot, contexts.select("user_id").schema.add("_slices", "long")))
        parts = F.coalesce("_slices", F.lit(1).cast("bigint"))
        facts = facts.join(users, "user_id", "left").join(slices, "user_id", "left").withColumn(
            "_slice", F.pmod(F.xxhash64("context_id"), parts)).drop("_slices")
        garments = garments.join(slices, "user_id", "left").withColumn(
            "_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_slices")
        keys.append("_slice")
        facts = facts.repartition(*keys)
    else:
        facts = facts.repartition(*keys).join(users, "user_id", "left")
    for role in L.ROLES:
        pool = add_prefix(garments.filter(F.col("type_group") == role), f"{role}_")
        pool = pool.withColumnRenamed(f"{role}_garment_id", "_id")
        same = F.col(f"{role}_garment_id") == F.col("_id")
        for key in keys:
            same = same & (F.col(key) == F.col(f"{role}_{key}"))
        facts = facts.join(pool, same, "left").drop("_id", f"{role}__slice")
    return facts.drop("_slice")


def join_outfits(outfits: DataFrame, users: DataFrame, contexts: DataFrame,
                 garments: DataFrame, roles: bool = False, drawn: bool = False) -> DataFrame:
    """:func:`full_dataset` under the names the expert rating reads.

    The context's formality becomes ``context_formality``; ``roles`` adds the garment roles.
    """
    if roles:
        garments = with_meta(garments).drop("base_formality")
    return full_dataset(outfits, users, contexts, garments, drawn).withColumnRenamed(
        "formality_level", "context_formality"
    )


def drop_ids(table: DataFrame) -> DataFrame:
    """Remove the identifying columns; absent ones are ignored."""
    return table.drop(*L.ID_COLUMNS, "rating_id")


def feature_matrix(features: DataFrame) -> DataFrame:
    """Model inputs before encoding, and the label where there is one."""
    label = ["rating"] if "rating" in features.columns else []
    return features.select(*L.NUMERIC_FEATURES, *L.CATEGORICAL_FEATURES, *label)
