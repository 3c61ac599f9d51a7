from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from perchero import lookups as L
from perchero.functions import text

GREETINGS = [
    ("hola", True), ("  ¡Buenas tardes!\n", True), ("HEY", True), ("", False), ("   ", False),
    (None, False), ("hey " + "a" * 56, True), ("hey " + "a" * 57, False),
    ("hola, qué me pongo", False), ("hola, hace frío", False), ("adios", False),
    ("\t hey " + "a" * 56 + " \n", True),
]


def test_greetings(spark):
    rows = spark.createDataFrame([(m, g) for m, g in GREETINGS], "m string, g boolean")
    for r in rows.withColumn("got", text.is_greeting(F.col("m"))).collect():
        assert r.got == r.g, repr(r.m)


def read(spark, reply, message="algo para salir"):
    df = spark.createDataFrame([(message, reply)], "message string, llm_reply string")
    row = text.with_context(df).first()
    return row.is_greeting, row.context.asDict()


DEFAULTS = {**L.DEFAULT_CONTEXT, "avoid_items": []}


@pytest.mark.parametrize("reply", [
    None, "", "nada", "{", "}{", '{"season": verano}', '{"season": 5}', '{"mood": ["x"]}',
    '{"activity": true}',
])
def test_unusable_replies_give_the_defaults(spark, reply):
    assert read(spark, reply)[1] == DEFAULTS


@pytest.mark.parametrize("value,expected", [
    ('"3.7"', 3), ("3.7", 3), ('"4"', 4), ("9", 5), ("-2", 1), ("true", 1), ("null", 3),
    ('" 2 "', 2), ("4.9", 4), ("[1]", 3), ('"x"', 3), ("99999999999999999999", 5), ("0", 1),
    ('"1_0"', 5),
])
def test_levels(spark, value, expected):
    assert read(spark, f'{{"formality_level": {value}}}')[1]["formality_level"] == expected


@pytest.mark.parametrize("value,expected", [
    ("7", 7.0), ('"7"', 7.0), ('" 7 "', 7.0), ("true", 1.0), ("null", 20.0), ('"mucho"', 20.0),
    ("-3.25", -3.25), ("[2]", 20.0), ('"1d"', 20.0), ('"1e1"', 10.0), ('"-inf"', float("-inf")),
    ("0", 0.0),
])
def test_temperatures(spark, value, expected):
    assert read(spark, f'{{"temperature": {value}}}')[1]["temperature"] == expected


@pytest.mark.parametrize("value,expected", [
    ("[]", []), ("null", []), ('""', []), ("0", []), ("false", []), ('"Lana"', ["lana"]),
    ('["Rojo", 3, null, true]', ["rojo", "3", "none", "true"]), ("7", ["7"]), ("true", ["true"]),
    ('[""]', [""]),
])
def test_avoid_items(spark, value, expected):
    assert read(spark, f'{{"avoid_items": {value}}}')[1]["avoid_items"] == expected


def test_text_fields(spark):
    reply = 'Claro:\n```{"season": "VERANO", "mood": "", "activity": null, "x": {"y": {}}}``` ok'
    context = read(spark, reply)[1]
    assert context["season"] == "verano"
    assert context["mood"] == "relajado" and context["activity"] == "casual_paseo"


def test_greeting_wins_over_reply(spark):
    greeting, context = read(spark, '{"season": "verano"}', "hola")
    assert greeting and context == {**DEFAULTS, "activity": "saludo"}


@pytest.mark.parametrize("name,allowed", [
    ("a.JPG", True), ("a.tar.webp", True), ("png", False), ("a.gif", False), ("a.", False),
    (".png", True), ("a.jpeg", True),
])
def test_image_names(spark, name, allowed):
    row = spark.range(1).select(text.allowed_image(F.lit(name)).alias("x")).first()
    assert row.x is allowed


@pytest.mark.parametrize("type_,group", [
    ("botines", "top"), ("zapatillas", "top"), ("botas_planas", "shoes"), ("Mocasines", "shoes"),
    ("joggers", "top"), ("pantalones_cargo", "bottom"), ("monos", "bottom"), ("vestido", "top"),
    ("falda con bota", "shoes"),
])
def test_groups(spark, type_, group):
    assert spark.range(1).select(text.garment_group(F.lit(type_)).alias("g")).first().g == group


def test_descriptions(spark):
    df = spark.range(200).select(text.garment_description(
        F.col("id"), F.lit("camisa"), F.lit("lino"), F.lit("azul"), F.lit("rayas")
    ).alias("d"), text.garment_description(
        F.col("id"), F.lit("camisa"), F.lit("papel"), F.lit("azul"), F.lit("liso")
    ).alias("plain"))
    rows = df.collect()
    assert len({r.d for r in rows}) == 6  # three sentences, two adjectives
    assert all("Lleva estampado: rayas." in r.d for r in rows)
    assert len({r.plain for r in rows}) == 3
    assert "camisa en azul, tejido principal: papel." in {r.plain for r in rows}


def test_prompts(spark):
    garment = F.struct(F.lit("n").alias("name"), F.lit("t").alias("type"),
                       F.lit("c").alias("primary_color"))
    outfit = F.struct(*[garment.alias(r) for r in L.ROLES])
    row = spark.range(1).select(
        text.reply_prompt(F.lit("m"), text.default_context(), outfit, F.lit(3.456)).alias("p"),
        text.extraction_prompt(F.lit("50% más")).alias("e"),
    ).first()
    assert "top: n (t, c)" in row.p and "Puntuación: 3.46" in row.p
    assert '"activity":"casual_paseo"' in row.p
    assert row.e.endswith("Mensaje: 50% más")
