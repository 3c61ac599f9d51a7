"""Table maintenance as change-log application.

A change is a row with a sequence number, the target's keys and a payload map. A key that is
absent from the map leaves its column alone; a key holding null overwrites it with null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perchero import lookups as L
from perchero.functions.text import allowed_image, extension, form_integer
from perchero.session import scratch_path
from perchero.sources.storage import write_table

REQUIRED = ["name", "type", "primary_color"]
GARMENT_DEFAULTS = {
    "pattern": None, "material": None, "formality_level": "3", "description": "",
    "type_group": "top", "image_url": "",
}
GARMENT_FIELDS = [*REQUIRED, *GARMENT_DEFAULTS]
PROFILE_FIELDS = ["username", "age", "body_shape", "style_preference", "skin_tone", "gender"]
INTEGERS = {"formality_level", "age"}


def _typed(value: Column, field: str) -> Column:
    return value.try_cast("int") if field in INTEGERS else value


def _payload(field: str) -> Column:
    return F.col("payload")[field]


def has_key(field: str) -> Column:
    return F.map_contains_key("payload", field)


def inserted_garments(changes: DataFrame) -> DataFrame:
    """Valid inserts: the three required keys must be there and not null, as the owner must be;
    defaults fill absent keys only."""
    valid = changes.filter((F.col("op") == "insert") & F.col("user_id").isNotNull())
    for field in REQUIRED:
        valid = valid.filter(_payload(field).isNotNull())
    fields = [
        _payload(f).alias(f) if f in REQUIRED else _typed(
            F.when(has_key(f), _payload(f)).otherwise(F.lit(GARMENT_DEFAULTS[f])), f
        ).alias(f)
        for f in GARMENT_FIELDS
    ]
    return valid.select("seq", "garment_id", "user_id", *fields)


def breaks_required(fields: Sequence[str]) -> Column:
    """True for a change that sets a required column to null; the table refuses it as a whole."""
    broken = F.lit(False)
    for field in fields:
        broken = broken | F.coalesce(has_key(field) & _payload(field).isNull(), F.lit(False))
    return broken


def last_values(fields: Sequence[str]) -> list[Column]:
    """One aggregate per field: the value of the last change that carries the field."""
    return [
        F.max_by(F.struct(_typed(_payload(f), f).alias("v")), F.when(has_key(f), F.col("seq")))
        .alias(f"_{f}")
        for f in fields
    ]


def _overwrite(field: str) -> Column:
    change = F.col(f"_{field}")
    return F.when(change.isNotNull(), change["v"]).otherwise(F.col(field)).alias(field)


def deleted_keys(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("op") == "delete").select("garment_id", "user_id").distinct()


def delete_garments(garments: DataFrame, changes: DataFrame) -> DataFrame:
    """Remove garments deleted by their owner; other delete requests do nothing."""
    return garments.join(deleted_keys(changes), ["garment_id", "user_id"], "left_anti")


def apply_garment_changes(garments: DataFrame, changes: DataFrame) -> DataFrame:
    """Snapshot plus inserts, partial updates and deletes, in sequence order.

    A change counts only if it names the owner, comes after the garment's insert, and sets no
    required column to null. All changes of a garment fold into one row by partial aggregation.
    """
    new = inserted_garments(changes)
    created = new.select("garment_id", F.col("seq").alias("_created"))
    refused = (F.col("op") == "update") & breaks_required(REQUIRED)
    later = changes.filter((F.col("op") != "insert") & ~refused).join(created, "garment_id", "left")
    later = later.filter(F.col("_created").isNull() | (F.col("seq") > F.col("_created")))
    later = later.withColumn(
        "payload", F.when(F.col("op") == "update", F.col("payload"))
    )
    folded = later.groupBy("garment_id", "user_id").agg(
        F.bool_or(F.col("op") == "delete").alias("_deleted"),
        *last_values(GARMENT_FIELDS),
    )
    rows = garments.unionByName(new.select(*garments.columns))
    merged = rows.join(folded, ["garment_id", "user_id"], "left")
    kept = merged.filter(~F.coalesce(F.col("_deleted"), F.lit(False)))
    return kept.select("garment_id", "user_id", *[_overwrite(f) for f in GARMENT_FIELDS])


def apply_profile_changes(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial profile updates; keys outside the profile are ignored.

    A change that sets the username to null, or to one that another user holds at that moment, is
    refused as a whole. Sequence numbers are distinct.
    """
    known = changes.join(users.select("user_id"), "user_id", "left_semi")
    legal = known.filter(~breaks_required(["username"]))
    refused = refused_names(users, legal.filter(has_key("username")).select(
        "seq", "user_id", _payload("username").alias("name")))
    folded = legal.join(refused, "seq", "left_anti").groupBy("user_id").agg(
        *last_values(PROFILE_FIELDS))
    merged = users.join(folded, "user_id", "left")
    return merged.select("user_id", *[_overwrite(f) for f in PROFILE_FIELDS])


def refused_names(users: DataFrame, claims: DataFrame) -> DataFrame:
    """The ``seq`` of the claims (seq, user_id, name) to a name that another user holds then.

    Only names that several users have or want are looked at. For each of them the last holder so
    far is known. Every claim by others until the holder's next claim of any name is refused at
    once; the first claim after the holder has left, or to a name nobody holds, succeeds. Claims of
    a name are decided in order, names side by side, so there are as many rounds as the longest
    chain of changing owners, not as many as claims.
    """
    spark = users.sparkSession

    def stored(rows: DataFrame, name: str) -> DataFrame:
        return write_table(rows, scratch_path(spark, name))

    claims = stored(claims, "claims")
    start = (claims.agg(F.min("seq")).first()[0] or 0) - 1
    held = users.filter(F.col("username").isNotNull()).select(
        F.lit(start).cast("long").alias("seq"), "user_id", F.col("username").alias("name"))
    wanted = claims.unionByName(held).groupBy("name").agg(
        F.min("user_id").alias("_a"), F.max("user_id").alias("_b")).filter("_a <> _b").select("name")
    contested = stored(wanted, "contested")
    open_ = stored(claims.join(contested, "name", "left_semi").select(*claims.columns), "open")
    granted = stored(claims.join(contested, "name", "left_anti").select(*claims.columns).unionByName(held), "granted")
    refused = open_.limit(0).select("seq")
    while not open_.isEmpty():
        last = granted.join(open_.select("name").distinct(), "name", "left_semi").groupBy("name").agg(
            F.max_by("user_id", "seq").alias("_holder"), F.max("seq").alias("_since"))
        moves = granted.select("seq", "user_id", F.lit(True).alias("_sure")).unionByName(
            open_.select("seq", "user_id", F.lit(False).alias("_sure")))
        left = last.join(moves.withColumnRenamed("user_id", "_holder"), "_holder").filter("seq > _since")
        left = left.groupBy("name").agg(
            F.min("seq").alias("_next"), F.min(F.when(F.col("_sure"), F.col("seq"))).alias("_left"))
        state = stored(open_.join(last, "name", "left").join(left, "name", "left"), "state")
        other = F.col("_holder").isNotNull() & (F.col("_holder") != F.col("user_id"))
        blocked = other & (F.col("_next").isNull() | (F.col("seq") < F.col("_next")))
        rest = state.filter(~blocked)
        first = rest.groupBy("name").agg(F.min("seq").alias("seq"))
        free = ~other | F.coalesce(F.col("_left") < F.col("seq"), F.lit(False))
        won = stored(rest.join(first, ["name", "seq"], "left_semi").filter(free).select(*claims.columns), "granted")
        refused = refused.unionByName(state.filter(blocked).select("seq"))
        open_ = stored(rest.join(won.select("seq"), "seq", "left_anti").select(*claims.columns), "open")
        granted = granted.unionByName(won)
    return refused


def clean_form_uploads(uploads: DataFrame) -> DataFrame:
    """Garments from upload forms: required fields must be non-empty, a given file an image."""
    def filled(field: str) -> Column:
        return F.coalesce(F.col(field), F.lit("")) != ""

    named = F.coalesce(F.col("filename"), F.lit("")) != ""
    valid = uploads.filter(filled("name") & filled("type") & filled("primary_color"))
    valid = valid.filter(~named | allowed_image(F.col("filename")))
    raw = F.coalesce(F.col("formality_raw"), F.lit("3"))
    return valid.select(
        "upload_id", "name", "type", "primary_color",
        F.nullif(F.col("pattern"), F.lit("")).alias("pattern"),
        F.nullif(F.col("material"), F.lit("")).alias("material"),
        form_integer(raw, 3).alias("formality_level"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.coalesce(F.col("type_group"), F.lit(L.ROLES[0])).alias("type_group"),
        F.when(named, extension(F.col("filename"))).alias("image_extension"),
    )


def accept_registrations(registrations: DataFrame, existing: DataFrame) -> DataFrame:
    """Registrations that succeed when taken in ``seq`` order.

    A registration fails if a field is missing or its email or username belongs to an existing
    user or to an earlier success. Sequence numbers are distinct. In each round

    * a row that comes first both in its email and in its username succeeds;
    * a row with a single earlier rival (second in one group and first in the other, or second to
      the same row in both) succeeds exactly if that rival fails. Such rows form chains; pointers
      that double their reach find the end of each chain and its parity, so a chain of n links
      takes log n steps, not n rounds;
    * what is decided leaves, with the rows that collide with a success.

    A chain that ends in a row with several earlier rivals waits for a later round. Every round
    ends in a written table, so the lineage stays short.
    """
    spark, columns = registrations.sparkSession, registrations.columns

    def stored(rows: DataFrame, name: str) -> DataFrame:
        return write_table(rows, scratch_path(spark, name))

    pending = registrations.filter(F.col("username").isNotNull() & F.col("email").isNotNull())
    for key in ("email", "username"):
        pending = pending.join(existing.select(key).distinct(), key, "left_anti")
    pending = stored(pending.select(*columns), "pending")
    accepted = pending.limit(0)
    while not pending.isEmpty():
        winners = stored(pending.join(
            _decided(_rivals(pending), stored).filter("wins").select("seq"), "seq").select(*columns), "accepted")
        accepted = accepted.unionByName(winners)
        for key in ("email", "username"):
            pending = pending.join(winners.select(key), key, "left_anti")
        pending = stored(pending.select(*columns), "pending")
    return accepted


def _rivals(pending: DataFrame) -> DataFrame:
    """(seq, ptr): itself for a row without earlier rivals, its only earlier rival, or null for several."""
    marked = pending.select("seq", "email", "username")
    for key in ("email", "username"):
        first = pending.groupBy(key).agg(F.min("seq").alias(f"_first_{key}"))
        marked = marked.join(first, key)
        later = marked.filter(F.col("seq") > F.col(f"_first_{key}"))
        marked = marked.join(later.groupBy(key).agg(F.min("seq").alias(f"_second_{key}")), key, "left")
    a, b = (F.col(f"_first_{k}") for k in ("email", "username"))
    seq = F.col("seq")
    second = [seq == F.coalesce(F.col(f"_second_{k}"), F.lit(-1)) for k in ("email", "username")]
    ptr = (
        F.when((seq == a) & (seq == b), seq).when((seq == a) & second[1], b)
        .when((seq == b) & second[0], a).when(second[0] & second[1] & (a == b), a)
    )
    return marked.select("seq", ptr.alias("ptr"))


def _decided(rivals: DataFrame, stored) -> DataFrame:
    """(seq, wins) of the rows whose chain ends in a row without rivals."""
    state = stored(rivals.select(
        "seq", F.coalesce("ptr", F.col("seq")).alias("ptr"),
        F.when(F.col("ptr") != F.col("seq"), 1).otherwise(0).alias("links"),
        F.col("ptr").isNull().alias("unknown")), "chains")
    while True:
        ahead = state.select(
            F.col("seq").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("links").alias("_links"),
            F.col("unknown").alias("_unknown"))
        moving = state.join(ahead, "ptr")
        if moving.filter(F.col("_ptr") != F.col("ptr")).isEmpty():
            break
        state = stored(moving.select(
            "seq", F.col("_ptr").alias("ptr"), ((F.col("links") + F.col("_links")) % 2).alias("links"),
            (F.col("unknown") | F.col("_unknown")).alias("unknown")), "chains")
    ends = state.filter((F.col("seq") == F.col("ptr")) & ~F.col("unknown")).select(F.col("seq").alias("ptr"))
    return state.filter(~F.col("unknown")).join(ends, "ptr", "left_semi").select(
        "seq", (F.col("links") == 0).alias("wins"))
