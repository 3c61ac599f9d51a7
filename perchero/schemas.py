"""Fixed table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "string": T.StringType(),
}


def _struct(spec: str) -> T.StructType:
    """Build a StructType from ``name type`` pairs; a trailing ``!`` marks NOT NULL."""
    fields = []
    for item in spec.split(","):
        name, kind = item.split()
        required = kind.endswith("!")
        fields.append(T.StructField(name, TYPES[kind.rstrip("!")], not required))
    return T.StructType(fields)


USERS = _struct(
    "user_id bigint!, username string!, age int, body_shape string, style_preference string,"
    "skin_tone string, gender string"
)
GARMENTS = _struct(
    "garment_id bigint!, user_id bigint!, name string!, type string!, primary_color string!,"
    "pattern string, material string, formality_level int, description string,"
    "type_group string, image_url string"
)
CONTEXTS = _struct(
    "context_id bigint!, user_id bigint, season string, weather_condition string,"
    "temperature double, activity string, mood string, formality_level int"
)
RATINGS = _struct(
    "rating_id bigint!, user_id bigint!, context_id bigint!, top_garment_id bigint!,"
    "bottom_garment_id bigint!, shoes_garment_id bigint!, rating double!"
)

# The CSV files name every key ``id``; contexts carry no user and garments no image there.
USERS_CSV = _struct(
    "id bigint, username string, age int, body_shape string, style_preference string,"
    "skin_tone string, gender string"
)
GARMENTS_CSV = _struct(
    "id bigint, user_id bigint, name string, type string, primary_color string,"
    "pattern string, material string, formality_level int, description string, type_group string"
)
CONTEXTS_CSV = _struct(
    "id bigint, season string, weather_condition string, temperature double,"
    "activity string, mood string, formality_level int"
)
RATINGS_CSV = _struct(
    "id bigint, user_id bigint, context_id bigint, top_garment_id bigint,"
    "bottom_garment_id bigint, shoes_garment_id bigint, rating double"
)

CONTEXT_ATTRIBUTES = [
    "season", "weather_condition", "temperature", "activity", "mood", "formality_level",
]
