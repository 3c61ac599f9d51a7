"""Synthetic users, wardrobes, contexts and expert ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perchero import lookups as L
from perchero.functions.expert import add_inputs, expert_score, noise, to_rating
from perchero.functions.hashing import draw, draw_below, lookup, pick, pick_from
from perchero.functions.text import garment_description, garment_group, garment_name
from perchero.operators.dataset import join_outfits
from perchero.operators.ranking import first_per_key, first_rows, keyed_position
from perchero.operators.wardrobe import complete_users, with_meta, with_palette

OUTFIT = ["rating_id", "user_id", "context_id", *[f"{role}_garment_id" for role in L.ROLES]]


def user_columns(key: Column) -> dict[str, Column]:
    low, high = L.AGE_RANGE
    return {
        "age": (draw_below(key, "age", high - low + 1) + low).cast("int"),
        "body_shape": pick(L.BODY_SHAPES, key, "body_shape"),
        "style_preference": pick(L.STYLES, key, "style_preference"),
        "skin_tone": pick(L.SKIN_TONES, key, "skin_tone"),
        "gender": pick(L.GENDERS, key, "gender"),
    }


def users(keys: DataFrame) -> DataFrame:
    """One user per ``user_id``."""
    key = F.col("user_id")
    name = F.concat(F.lit("user_"), key.cast("string"))
    columns = [c.alias(n) for n, c in user_columns(key).items()]
    return keys.select("user_id", name.alias("username"), *columns)


def fill_garments(rows: DataFrame) -> DataFrame:
    """Attributes for (garment_id, user_id) rows carrying their owner's palette arrays."""
    key = F.col("garment_id")
    off = draw_below(key, "off", 100) < L.OFF_PALETTE_PERCENT
    color = F.when(off, pick_from(F.col("off_colors"), key, "primary_color")).otherwise(
        pick_from(F.col("colors"), key, "primary_color")
    )
    typed = with_meta(
        rows.select(
            "garment_id", "user_id",
            pick_from(F.col("types"), key, "type").alias("type"),
            color.alias("primary_color"),
            pick_from(F.col("patterns"), key, "pattern").alias("pattern"),
            pick(L.MATERIALS, key, "material").alias("material"),
        )
    )
    base = F.coalesce(F.col("base_formality"), (draw_below(key, "base", 5) + 1).cast("int"))
    level = base + pick(L.FORMALITY_SHIFTS, key, "formality_level")
    type_, color, material = F.col("type"), F.col("primary_color"), F.col("material")
    return typed.select(
        "garment_id", "user_id",
        garment_name(type_, material, color).alias("name"),
        "type", "primary_color", "pattern", "material",
        F.greatest(F.lit(1), F.least(F.lit(5), level)).alias("formality_level"),
        garment_description(key, type_, material, color, F.col("pattern")).alias("description"),
        garment_group(type_).alias("type_group"),
        F.lit("").alias("image_url"),
    )


def wardrobes(users: DataFrame) -> DataFrame:
    """25 to 35 garments per user from the palette of the user's style and gender."""
    low, high = L.WARDROBE_SIZE
    size = (draw_below(F.col("user_id"), "wardrobe", high - low + 1) + low).cast("int")
    # Users are small rows in few files, and each becomes some thirty garments with a dozen draws.
    spark = users.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = users.repartition(max(width, spark.sparkContext.defaultParallelism))
    rows = with_palette(dealt).select(
        "user_id", "types", "colors", "patterns", "off_colors",
        F.explode(F.sequence(F.lit(1), size)).alias("_nth"),
    )
    garment_id = F.col("user_id") * F.lit(100) + F.col("_nth")
    return fill_garments(rows.withColumn("garment_id", garment_id))


def temperature(season: Column, key: Column) -> Column:
    """Uniform in the season's range, one decimal."""
    low = lookup({s: lo for s, (lo, _) in L.SEASON_TEMPERATURE.items()}, season)
    high = lookup({s: hi for s, (_, hi) in L.SEASON_TEMPERATURE.items()}, season)
    steps = (high - low) * 10 + 1
    return (low * 10 + draw(key, "temp") % steps).cast("double") / F.lit(10.0)


def context_formality(activity: Column, key: Column) -> Column:
    low, high = F.lit(L.ANY_FORMALITY[0]), F.lit(L.ANY_FORMALITY[1])
    for activities, (lo, hi) in L.ACTIVITY_FORMALITY:
        low = F.when(activity.isin(activities), lo).otherwise(low)
        high = F.when(activity.isin(activities), hi).otherwise(high)
    return (low + draw(key, "cf") % (high - low + 1)).cast("int")


def fill_contexts(rows: DataFrame) -> DataFrame:
    """Weather, temperature, activity, mood and formality for rows with a season."""
    key = F.col("context_id")
    placed = rows.withColumn("activity", pick(L.ACTIVITIES, key, "activity"))
    weather = lookup(L.SEASON_WEATHER, F.col("season"))
    return placed.select(
        *[c for c in rows.columns if c != "season"],
        "season",
        pick_from(weather, key, "weather_condition").alias("weather_condition"),
        temperature(F.col("season"), key).alias("temperature"),
        "activity",
        pick(L.MOODS, key, "mood").alias("mood"),
        context_formality(F.col("activity"), key).alias("formality_level"),
    )


def contexts(keys: DataFrame) -> DataFrame:
    """One context per ``context_id``, season drawn evenly."""
    season = pick(L.SEASONS, F.col("context_id"), "season")
    return fill_contexts(keys.select("context_id", season.alias("season")))


def draw_outfits(attempts: DataFrame, garments: DataFrame) -> DataFrame:
    """One garment per group for each attempt (``rating_id, user_id, context_id``).

    Users without all three groups are skipped. A draw is an equi-join on the position inside
    the user's group, so no wardrobe is gathered anywhere.
    """
    sizes = complete_users(garments)
    rows = attempts.join(sizes, "user_id")
    placed = keyed_position(
        garments.filter(F.col("type_group").isin(L.ROLES))
        .select("user_id", "type_group", "garment_id"),
        ["user_id", "type_group"], "garment_id",
    )
    for role in L.ROLES:
        rows = rows.withColumn(f"_{role}", draw(F.col("rating_id"), role) % F.col(f"n_{role}"))
    for role in L.ROLES:
        pool = placed.filter(F.col("type_group") == role).select(
            "user_id", F.col("position").alias(f"_{role}"),
            F.col("garment_id").alias(f"{role}_garment_id"),
        )
        rows = rows.join(pool, ["user_id", f"_{role}"])
    return rows.select(*OUTFIT)


def unique_outfits(outfits: DataFrame) -> DataFrame:
    """The first attempt of each (user, context, top, bottom, shoes)."""
    keys = ["user_id", "context_id", *[f"{role}_garment_id" for role in L.ROLES]]
    return first_per_key(outfits, keys, "rating_id")


def rate(outfits: DataFrame, users: DataFrame, contexts: DataFrame,
         garments: DataFrame) -> DataFrame:
    """Expert rating with noise, rounded half-even and clamped."""
    return rated(outfits, users, contexts, garments).select(*outfits.columns, "rating")


def rated(outfits: DataFrame, users: DataFrame, contexts: DataFrame,
          garments: DataFrame, drawn: bool = False) -> DataFrame:
    """The outfits with their rating and all columns of the training table."""
    full = join_outfits(outfits, users, contexts, garments, roles=True, drawn=drawn)
    score = expert_score() + noise(F.col("rating_id"))
    rows = add_inputs(full).withColumn("rating", to_rating(score))
    first = outfits.columns
    rest = [c for c in full.columns if c not in first and c not in [f"{r}_role" for r in L.ROLES]]
    return rows.select(*first, "rating", *rest).withColumnRenamed("context_formality", "formality_level")


def limited_outfits(attempts: DataFrame, garments: DataFrame, max_rows: int | None = None,
                    max_attempts: int | None = None) -> DataFrame:
    """Distinct outfits of the first ``max_attempts`` attempts, at most the first ``max_rows`` of them.

    Both cuts are by attempt number (``rating_id``) from counts per range block; nothing is sorted
    as a whole.
    """
    if max_attempts is not None:
        attempts = first_rows(attempts, "rating_id", max_attempts)
    outfits = unique_outfits(draw_outfits(attempts, garments))
    return outfits if max_rows is None else first_rows(outfits, "rating_id", max_rows)


def ratings(users: DataFrame, garments: DataFrame, contexts: DataFrame,
            max_rows: int | None = None, max_attempts: int | None = None) -> DataFrame:
    """One rated outfit per context of a user with a complete wardrobe.

    ``max_rows`` and ``max_attempts`` are the generator's size parameters (``MAX_RATINGS`` and
    ``MAX_ATTEMPTS`` in the original data set).
    """
    rows = rated_contexts(users, garments, contexts, max_rows, max_attempts)
    return rows.select(*OUTFIT, "rating")


def rated_contexts(users: DataFrame, garments: DataFrame, contexts: DataFrame,
                   max_rows: int | None = None, max_attempts: int | None = None) -> DataFrame:
    """As :func:`ratings`, with all columns of the training table."""
    attempts = contexts.select(F.col("context_id").alias("rating_id"), "user_id", "context_id")
    outfits = limited_outfits(attempts, garments, max_rows, max_attempts)
    return rated(outfits, users, contexts, garments, drawn=True)
