"""Wardrobe tables: groups, completeness, palette and metadata lookups, paged ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perchero import lookups as L
from perchero.operators.ranking import keyed_position

GARMENT_LIST = [
    "garment_id", "name", "type", "primary_color", "pattern", "material",
    "formality_level", "description", "type_group", "image_url",
]


def garments_of(garments: DataFrame, users: DataFrame) -> DataFrame:
    """Garment lists of the given users."""
    wanted = garments.join(users.select("user_id"), "user_id", "left_semi")
    return wanted.select("user_id", *GARMENT_LIST)


def profiles(users: DataFrame, accounts: DataFrame) -> DataFrame:
    """The eight columns of a profile; ``accounts`` has the email of each user."""
    emails = accounts.select("user_id", "email")
    return users.join(emails, "user_id", "left").select(
        "user_id", "username", "email", "age", "body_shape", "style_preference", "skin_tone", "gender"
    )


def wardrobe_counts(garments: DataFrame) -> DataFrame:
    """Garments per user and group; other groups are ignored."""
    counts = [
        F.count_if(F.col("type_group") == role).alias(f"n_{role}") for role in L.ROLES
    ]
    return garments.groupBy("user_id").agg(*counts)


def complete_users(garments: DataFrame) -> DataFrame:
    """Users owning a top, a bottom and shoes: only they can get an outfit."""
    owns_all = [F.col(f"n_{role}") > 0 for role in L.ROLES]
    return wardrobe_counts(garments).filter(owns_all[0] & owns_all[1] & owns_all[2])


def wardrobe_pages(garments: DataFrame, page_size: int = 50) -> DataFrame:
    """The user -> garments relationship, nested.

    One row holds at most ``page_size`` garments, so a huge wardrobe never becomes one row.
    """
    placed = keyed_position(garments, ["user_id"], "garment_id")
    page = F.floor(F.col("position") / F.lit(page_size)).cast("int")
    item = F.struct("position", "garment_id", "name", "type", "type_group")
    return (
        placed.groupBy("user_id", page.alias("page"))
        .agg(F.array_sort(F.collect_list(item)).alias("garments"))
    )


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table as literals inside the plan, marked for broadcast."""
    items = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*items))))


def garment_meta(spark: SparkSession) -> DataFrame:
    """The fixed type table (about fifty rows)."""
    rows = [
        (type_, level, role)
        for type_, (level, role) in L.GARMENT_META.items()
    ]
    return literal_table(spark, ["type", "base_formality", "role"], rows)


def with_meta(garments: DataFrame) -> DataFrame:
    """Left lookup of base formality and role; unknown types get an empty role."""
    meta = garment_meta(garments.sparkSession)
    return garments.join(meta, "type", "left").withColumn(
        "role", F.coalesce(F.col("role"), F.lit(""))
    )


def palettes(spark: SparkSession) -> DataFrame:
    """The fixed palette table (thirteen rows), with the colours outside each palette."""
    columns = ["style_preference", "palette_gender", "types", "colors", "patterns"]
    rows = [(*key, *lists) for key, lists in L.PALETTES.items()]
    table = literal_table(spark, columns, rows)
    off = F.array_except(F.lit(L.COLORS), F.col("colors"))
    return F.broadcast(table.withColumn("off_colors", off))


def with_palette(users: DataFrame) -> DataFrame:
    """Palette by style and gender; a gender without a palette takes the fallback gender's."""
    known = [f"{style}/{gender}" for style, gender in L.PALETTES]
    own = F.concat_ws("/", "style_preference", "gender").isin(known)
    chosen = users.withColumn(
        "palette_gender", F.when(own, F.col("gender")).otherwise(L.FALLBACK_GENDER)
    )
    return chosen.join(
        palettes(users.sparkSession), ["style_preference", "palette_gender"], "left"
    )
