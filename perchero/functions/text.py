"""Message and reply text: greetings, embedded JSON, context normalisation, prompts (T1-T14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perchero import lookups as L
from perchero.functions.hashing import contains_any, draw_below, lookup

INTEGER_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
FLOAT_TEXT = (
    r"(?i)^\s*[+-]?(([0-9][0-9_]*\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"
)


# --- messages -----------------------------------------------------------------------------

def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_greeting(message: Column) -> Column:
    """A short message that greets and names no garment, weather or occasion."""
    text = F.lower(strip(message))
    return F.coalesce(
        (F.length(message) > 0)
        & (F.length(text) <= L.GREETING_MAX_LENGTH)
        & ~contains_any(text, L.FASHION_KEYWORDS)
        & contains_any(text, L.GREETING_KEYWORDS),
        F.lit(False),
    )


def embedded_json(text: Column) -> Column:
    """From the first opening to the last closing brace; null where there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.nullif(found, F.lit(""))


def parse_reply(text: Column) -> Column:
    """The embedded JSON object as a variant; null where it is missing or malformed."""
    return F.try_parse_json(embedded_json(text))


# --- normalisation ------------------------------------------------------------------------

TEXT_KEYS = ["season", "weather_condition", "activity", "mood"]
TERM_LIST = "array<string>"


def entry(reply: Column, key: str, listed: bool = False) -> Column:
    """One key of a parsed reply: its JSON kind, its text, and its elements if asked for."""
    path = f"$.{key}"
    items = [F.try_variant_get(reply, path, TERM_LIST).alias("items")] if listed else []
    return F.struct(
        F.schema_of_variant(F.try_variant_get(reply, path, "variant")).alias("kind"),
        F.try_variant_get(reply, path, "string").alias("text"),
        *items,
    )


def _is_text(e: Column) -> Column:
    return F.coalesce(e["kind"] == "STRING", F.lit(False))


def _is_list(e: Column) -> Column:
    return F.coalesce(e["kind"].startswith("ARRAY"), F.lit(False))


def _is_nested(e: Column) -> Column:
    return _is_list(e) | F.coalesce(e["kind"].startswith("OBJECT"), F.lit(False))


def _number(e: Column, pattern: str) -> Column:
    """Double reading of a number, a boolean, or a text of the given form."""
    digits = F.regexp_replace(F.trim(e["text"]), "(?<=[0-9])_(?=[0-9])", "")
    return (
        F.when(_is_text(e), F.when(e["text"].rlike(pattern), digits.try_cast("double")))
        .when(e["kind"] == "BOOLEAN", (e["text"] == "true").cast("double"))
        .when(~_is_nested(e), e["text"].try_cast("double"))
    )


def _missing(e: Column) -> Column:
    """Absent, null, or an empty or zero value."""
    return (
        F.when(e["kind"].isNull() | (e["kind"] == "VOID"), True)
        .when(_is_text(e), e["text"] == "")
        .when(_is_nested(e), e["text"].isin("[]", "{}"))
        .when(e["kind"] == "BOOLEAN", e["text"] == "false")
        .otherwise(F.coalesce(e["text"].try_cast("double") == 0.0, F.lit(False)))
    )


def _to_float(e: Column, default: float) -> Column:
    return F.coalesce(_number(e, FLOAT_TEXT), F.lit(default))


def _to_level(e: Column, default: int) -> Column:
    """Integer reading kept inside 1..5: 3.7 gives 3, the text "3.7" the default."""
    parsed = _number(e, INTEGER_TEXT)
    bounded = F.greatest(F.lit(1.0), F.least(F.lit(5.0), parsed))
    return F.when(parsed.isNull(), default).otherwise(F.floor(bounded).cast("int"))


def to_terms(e: Column) -> Column:
    """Always a list of lower-cased texts; a scalar becomes a list of one."""
    listed = F.transform(e["items"], lambda x: F.lower(F.coalesce(x, F.lit("none"))))
    return (
        F.when(_missing(e), F.array().cast(TERM_LIST))
        .when(_is_list(e), listed)
        .otherwise(F.array(F.lower(e["text"])))
    )


def default_context(activity: str | None = None) -> Column:
    values = dict(L.DEFAULT_CONTEXT)
    if activity:
        values["activity"] = activity
    fields = [F.lit(v).alias(k) for k, v in values.items()]
    return F.struct(*fields, F.array().cast(TERM_LIST).alias("avoid_items"))


def with_context(messages: DataFrame) -> DataFrame:
    """Add ``is_greeting`` and the typed ``context`` struct read from message and reply.

    A greeting gets the defaults with its own activity. A reply without valid JSON, or with a
    text field of another kind, gets the defaults. The steps are separate projections, so each
    reply is parsed once.
    """
    rows = messages.withColumn("is_greeting", is_greeting(F.col("message")))
    rows = rows.withColumn(
        "_reply", F.when(~F.col("is_greeting"), parse_reply(F.col("llm_reply")))
    )
    rows = rows.withColumns({
        **{f"_{k}": entry(F.col("_reply"), k)
           for k in (*TEXT_KEYS, "temperature", "formality_level")},
        "_avoid_items": entry(F.col("_reply"), "avoid_items", listed=True),
    })
    rows = rows.withColumns({f"_no_{k}": _missing(F.col(f"_{k}")) for k in TEXT_KEYS})
    usable = F.col("_reply").isNotNull()
    readings = {}
    for k in TEXT_KEYS:
        missing, text = F.col(f"_no_{k}"), F.col(f"_{k}.text")
        usable = usable & (missing | _is_text(F.col(f"_{k}")))
        readings[k] = F.lower(F.when(missing, L.DEFAULT_CONTEXT[k]).otherwise(text))
    readings["temperature"] = _to_float(
        F.col("_temperature"), L.DEFAULT_CONTEXT["temperature"]
    )
    readings["formality_level"] = _to_level(
        F.col("_formality_level"), L.DEFAULT_CONTEXT["formality_level"]
    )
    read = F.struct(
        *[readings[k].alias(k) for k in L.DEFAULT_CONTEXT],
        to_terms(F.col("_avoid_items")).alias("avoid_items"),
    )
    context = (
        F.when(F.col("is_greeting"), default_context(L.GREETING_ACTIVITY))
        .when(usable, read)
        .otherwise(default_context())
    )
    return rows.select(*messages.columns, "is_greeting", context.alias("context"))


# --- prompts and fixed replies --------------------------------------------------------------

GREETING_REPLY = (
    "Para elegir un conjunto de tu armario necesito dos datos: adónde vas y qué tiempo hará."
)
OFFLINE_REPLY = (
    "El asistente de texto no está disponible; indica ocasión y clima y buscaré un conjunto."
)
ERROR_REPLY = (
    "No se pudo redactar la explicación; el conjunto mostrado sigue siendo el calculado."
)
EXTRACTION_PROMPT = (
    "Extrae del mensaje un único objeto JSON con las claves season, weather_condition, "
    "temperature, activity, mood, formality_level (1 a 5) y avoid_items (lista). "
    "Mensaje: %s"
)
NO_OUTFIT_LINE = "Conjunto: ninguno."
NO_RATING_LINE = "Sin puntuación."


def extraction_prompt(message: Column) -> Column:
    return F.format_string(EXTRACTION_PROMPT, message)


def garment_line(label: str, garment: Column) -> Column:
    return F.format_string(
        f"{label}: %s (%s, %s)", garment["name"], garment["type"], garment["primary_color"]
    )


def reply_prompt(message: Column, context: Column, outfit: Column, rating: Column) -> Column:
    """Everything a writer of the answer needs, for offline batch inference."""
    lines = [garment_line(r, outfit[r]) for r in L.ROLES]
    return F.concat_ws(
        "\n",
        F.format_string("Mensaje: %s", message),
        F.format_string("Contexto: %s", F.to_json(context)),
        F.when(outfit.isNull(), NO_OUTFIT_LINE).otherwise(F.concat_ws("\n", *lines)),
        F.when(rating.isNull(), NO_RATING_LINE).otherwise(
            F.format_string("Puntuación: %.2f", rating)
        ),
    )


# --- garment text ---------------------------------------------------------------------------

def garment_group(type_: Column) -> Column:
    """Shoes keywords win over bottom keywords; everything else is a top."""
    text = F.lower(type_)
    return (
        F.when(contains_any(text, L.SHOES_KEYWORDS), "shoes")
        .when(contains_any(text, L.BOTTOM_KEYWORDS), "bottom")
        .otherwise("top")
    )


def garment_name(type_: Column, material: Column, color: Column) -> Column:
    return F.concat(type_, F.lit(" de "), material, F.lit(" "), color)


def _fill(template: str, **columns: Column) -> Column:
    """A template with ``{name}`` fields as one concatenation."""
    pieces, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(head), columns[name]]
    return F.concat(*pieces, F.lit(rest))


def garment_description(
    key: Column, type_: Column, material: Column, color: Column, pattern: Column
) -> Column:
    """One of three sentences, a fabric sentence, and a pattern sentence unless plain."""
    fields = {"type": type_, "material": material, "color": color}
    which = draw_below(key, "description", len(L.DESCRIPTION_TEMPLATES))
    base = F.lit(None).cast("string")
    for i, template in enumerate(L.DESCRIPTION_TEMPLATES):
        base = F.when(which == i, _fill(template, **fields)).otherwise(base)
    adjectives = lookup(L.MATERIAL_ADJECTIVES, material)
    adjective = F.element_at(adjectives, (draw_below(key, "adjective", 2) + 1).cast("int"))
    fabric = F.when(material.isin(list(L.MATERIAL_ADJECTIVES)),
                    _fill(L.FABRIC_SENTENCE, adjective=adjective)).otherwise("")
    printed = F.when(pattern != "liso", _fill(L.PATTERN_SENTENCE, pattern=pattern)).otherwise("")
    return F.concat(base, fabric, printed)


# --- uploads --------------------------------------------------------------------------------

def extension(filename: Column) -> Column:
    """Lower-cased text after the last dot; null without a dot."""
    return F.when(filename.contains("."), F.lower(F.element_at(F.split(filename, r"\."), -1)))


def allowed_image(filename: Column) -> Column:
    return F.coalesce(extension(filename).isin(L.IMAGE_EXTENSIONS), F.lit(False))


def form_integer(raw: Column, default: int) -> Column:
    """Integer reading of a form field; anything else gives the default."""
    digits = F.regexp_replace(F.trim(raw), "_", "")
    return F.coalesce(
        F.when(raw.rlike(INTEGER_TEXT), digits.try_cast("int")), F.lit(default)
    )
