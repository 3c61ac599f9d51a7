"""Expert rating of an outfit.

Points are added term by term in a fixed order. What depends on one garment, the context and
the user alone is an *input*, computed once per garment (`garment_inputs`) or once per request
(`context_inputs`); the terms combine inputs. Enumerating outfits therefore repeats no text
matching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perchero import lookups as L
from perchero.functions.hashing import draw_below
from perchero.functions.sqltext import (
    among, case, mentions, number, pair_terms, points, text, total, with_columns, yes,
)

PARTS = ["activity", "climate", "patterns", "color", "body", "colorimetry", "gender"]
BASICS = ["camiseta", "croptop", "hoodie"]
OCCASIONS = {
    "office": ["trabajo_oficina"],
    "event": ["evento_formal"],
    "sports": L.SPORT_ACTIVITIES,
    "home": ["relax_en_casa"],
    "walk": ["casual_paseo"],
    "party": ["fiesta_nocturna"],
    "date": ["cita_romantica"],
}
# Points when all three garments qualify, per occasion.
FIRST_JOINT = {
    "office": 1.0, "event": 1.5, "home": 0.8, "walk": 0.7, "party": 0.5, "date": 0.8,
}
SECOND_JOINT = {"office": 0.7, "event": 1.0, "walk": -0.8}
# Points when not all of them qualify for the second condition.
SECOND_MISSED = {"home": -1.2}


# --- inputs -------------------------------------------------------------------------------

def context_inputs() -> dict[str, str]:
    """Which occasion's rules apply, and the points of its two joint conditions."""
    at = {name: among("activity", values) for name, values in OCCASIONS.items()}

    def per_occasion(values: dict) -> str:
        return case(((at[n], number(v)) for n, v in values.items()), number(0))

    dressed_up = f"{at['walk']} and context_formality > 2"
    return {
        "occasion": case(((test, text(n)) for n, test in at.items()), "'other'"),
        "joint1_points": per_occasion(FIRST_JOINT),
        "joint2_points": case([(dressed_up, number(0))], per_occasion(SECOND_JOINT)),
        "joint2_missed": per_occasion(SECOND_MISSED),
    }


class _Garment:
    """Attribute texts of one garment, null-safe where the rules compare text."""

    def __init__(self, prefix: str):
        self.type, self.name, self.material, self.pattern, self.kind = (
            f"coalesce({prefix}{a}, '')"
            for a in ("type", "name", "material", "pattern", "role")
        )
        self.color = f"{prefix}primary_color"
        self.level = f"coalesce({prefix}formality_level, 3)"  # a missing level counts as 3
        self.smart = f"{self.kind} in ('formal', 'smart')"
        self.sporty = f"{self.kind} in ('sport', 'sport_casual')"


def _body_points(index: int, type_: str, value: float) -> str:
    return case((
        (f"body_shape = {text(shape)} and {mentions(type_, keywords[index])}", number(value))
        for shape, keywords in L.BODY_SHAPE_KEYWORDS.items() if keywords[index]
    ), number(0))


def _in_colorimetry(index: int, color: str) -> str:
    return " or ".join(
        yes(f"skin_tone = {text(tone)} and {among(color, lists[index])}")
        for tone, lists in L.COLORIMETRY.items() if lists[index]
    )


def _joint_conditions(role: str, g: _Garment) -> tuple[str, str]:
    """The garment's share of the occasion's two joint conditions."""
    if role == "shoes":
        first = f"occasion <> 'event' or {g.level} >= 4"
        second = case([
            ("occasion = 'event'", g.smart), ("occasion = 'home'", f"{g.level} < 4"),
        ], "true")
        return first, second
    first = case([
        ("occasion = 'office'", f"{g.level} >= 3"),
        ("occasion = 'event'", f"{g.level} >= 4"),
        ("occasion = 'home'", f"{g.level} <= 2"),
        ("occasion = 'walk'", f"{g.level} between 1 and 3"),
        ("occasion = 'party'", f"{g.level} between 2 and 4"),
        ("occasion = 'date'", f"{g.level} between 3 and 5"),
    ], "false")
    second = case([
        ("occasion = 'office'", g.smart),
        ("occasion in ('event', 'walk')", f"{g.kind} = 'formal'"),
        ("occasion = 'home'", f"{g.level} < 4"),
    ], "false")
    return first, second


def _own_points(role: str, g: _Garment) -> str:
    """Points for the garment's role in the wardrobe."""
    if role != "shoes":
        return case([
            ("occasion <> 'sports'", number(0)), (g.sporty, number(1)),
        ], number(-0.8))
    sport, dressy = f"{g.kind} = 'sport'", "context_formality >= 3"
    return case([
        (f"occasion = 'sports' and {sport}", number(1.5)),
        (f"occasion = 'sports' and {g.smart}", number(-2)),
        (f"occasion = 'office' and {sport} and {dressy}", number(-1)),
        (f"occasion = 'event' and {sport}", number(-2)),
        (f"occasion = 'party' and {sport} and {dressy}", number(-0.5)),
        (f"occasion = 'date' and {g.smart}", number(0.8)),
        (f"occasion = 'date' and {sport}", number(-1.5)),
    ], number(0))


def _level_points(role: str, g: _Garment) -> str:
    """Points for the garment's formality alone."""
    cases = [(f"occasion = 'sports' and {g.level} >= 4", number(-1))]
    if role == "top":
        plain = f"{among(g.type, BASICS)} and {g.level} < 3"
        cases.append((f"occasion = 'office' and {plain}", number(-1.2)))
    return case(cases, number(0))


def _top_slots(g: _Garment) -> dict[str, str]:
    return {
        "climate": case([
            (f"season = 'invierno' and {g.material} in ('lana', 'tweed')", number(1)),
            (f"season = 'invierno' and {g.material} in ('lino', 'seda')", number(-2)),
            (f"season = 'verano' and {g.material} in ('lino', 'algodon')", number(1)),
            (f"season = 'verano' and {g.material} in ('lana', 'tweed')", number(-2)),
        ], number(0)),
        "loud": f"{g.pattern} in ('floral', 'animal_print')",
        "body": _body_points(0, g.type, 0.4),
        "body2": _body_points(2, g.type, -0.5),
        "gender1": points(
            f"gender = 'mujer' and {g.type} = 'vestido' and context_formality > 2", 0.7
        ),
        "pair1": yes(f"gender = 'hombre' and {g.type} = 'camisa'"),
        "pair2": yes(f"gender = 'hombre' and {g.type} = 'blazer'"),
        "pair3": yes(f"gender = 'no_binario' and {g.level} > 3"),
        "gender2": points(
            f"gender = 'no_binario' and {mentions(g.name, ['estructurado', 'asimetrico'])}", 0.5
        ),
    }


def _bottom_slots(g: _Garment) -> dict[str, str]:
    skirt = f"({mentions(g.type, ['falda'])} or {mentions(g.name, ['falda'])})"
    return {
        "body": _body_points(1, g.type, 0.4),
        "gender1": points(f"gender = 'mujer' and {skirt}", 0.2),
        "pair1": f"{g.type} = 'pantalones_sastre'",
        "pair2": f"{g.type} = 'jeans'",
        "pair3": yes(f"{g.level} < 3"),
    }


def _shoes_slots(g: _Garment) -> dict[str, str]:
    rain = among("weather_condition", L.RAIN_WEATHER)
    soaked = f"{mentions(g.type, ['sneaker'])} and {g.material} not in ('cuero', 'sintetico')"
    return {
        "climate": points(f"{rain} and {mentions(g.type, ['bota'])}", 0.5),
        "climate2": points(f"{rain} and {soaked}", -0.5),
    }


def garment_inputs(role: str, prefix: str = "") -> dict[str, str]:
    """What the score reads about one garment of a role, given context and user.

    Every role has the same slots; the ones its rules do not use hold a neutral value. With a
    ``prefix`` the attributes are read from the columns of a flat outfit table.
    """
    g, no, zero = _Garment(prefix), "false", number(0)
    first, second = _joint_conditions(role, g)
    slots = {
        "joint1": yes(first), "joint2": yes(second),
        "own": _own_points(role, g), "level_points": _level_points(role, g),
        "climate": zero, "climate2": zero, "primary_color": g.color,
        "busy": no, "loud": no, "printed": no,
        "body": zero, "body2": zero, "suits": no, "clashes": no,
        "gender1": zero, "pair1": no, "pair2": no, "pair3": no, "gender2": zero,
    }
    if role == "shoes":
        return slots | _shoes_slots(g)
    busy = [p for p, complexity in L.PATTERN_COMPLEXITY.items() if complexity > 1]
    slots |= {
        "busy": among(g.pattern, busy),
        "printed": f"{g.pattern} <> 'liso'",
        "suits": _in_colorimetry(0, g.color),
        "clashes": _in_colorimetry(1, g.color),
    }
    return slots | (_top_slots(g) if role == "top" else _bottom_slots(g))


def add_inputs(outfits: DataFrame) -> DataFrame:
    """All inputs for a table of flat outfits (``top_type``, ``top_role``, ...)."""
    slots = {
        f"{role}_{name}": sql
        for role in L.ROLES
        for name, sql in garment_inputs(role, f"{role}_").items()
        if name != "primary_color"
    }
    return with_columns(with_columns(outfits, context_inputs()), slots)


# --- terms --------------------------------------------------------------------------------

def _both(name: str) -> str:
    return f"top_{name} and bottom_{name}"


def _either(name: str) -> str:
    return f"top_{name} or bottom_{name}"


TERMS = {
    "activity": [
        case([(f"{_both('joint1')} and shoes_joint1", "joint1_points")], number(0)),
        case([(f"{_both('joint2')} and shoes_joint2", "joint2_points")], "joint2_missed"),
        "top_own", "bottom_own", "shoes_own",
        "top_level_points", "bottom_level_points", "shoes_level_points",
    ],
    "climate": ["top_climate", "shoes_climate", "shoes_climate2"],
    "patterns": [points(_both("busy"), -1.2), points("top_loud and bottom_printed", -1.2)],
    "color": [points("top_primary_color = bottom_primary_color and top_printed", -1)],
    "body": ["top_body", "bottom_body", "top_body2"],
    "colorimetry": [points(_either("clashes"), -0.5), points(_either("suits"), 0.3)],
    "gender": [
        "top_gender1", "bottom_gender1",
        points(_both("pair1"), 0.8), points(_both("pair2"), 0.4), points(_both("pair3"), 0.3),
        "top_gender2",
    ],
}
ALL_TERMS = [number(L.BASE_RATING), *(t for part in PARTS for t in TERMS[part])]
PAIR_TERMS = pair_terms(ALL_TERMS, "score_pair")
SCORE = total(ALL_TERMS)
PAIRED_SCORE = total(PAIR_TERMS.get(t, t) for t in ALL_TERMS)


def pair_columns() -> dict[str, str]:
    """The terms of a top and a bottom, to be computed before shoes are joined."""
    return {name: sql for sql, name in PAIR_TERMS.items()}


def expert_parts() -> dict[str, Column]:
    """Points per rule block."""
    return {part: F.expr(total(terms)) for part, terms in TERMS.items()}


def expert_score() -> Column:
    """Noise-free score: base plus every term, added one after the other."""
    return F.expr(SCORE)


def noise(key: Column) -> Column:
    """Deterministic noise in [-0.4, 0.4]."""
    return draw_below(key, "noise", 8001).cast("double") / F.lit(10000.0) - F.lit(L.NOISE)


def _bounded(value: Column) -> Column:
    low, high = L.RATING_RANGE
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def to_rating(score: Column) -> Column:
    """Half-even rounding to an integral rating, clamped to 1..5."""
    return _bounded(F.rint(score))


def flat_prediction() -> tuple[str, dict[str, str]]:
    """As text over flat outfits: the bounded score, and the texts of the inputs that it reads by name."""
    low, high = map(number, L.RATING_RANGE)
    slots = {
        f"{role}_{name}": sql for role in L.ROLES for name, sql in garment_inputs(role, f"{role}_").items()
        if name != "primary_color"}
    return f"greatest({low}, least({high}, {SCORE}))", slots


def expert_prediction(paired: bool = False) -> Column:
    """The noise-free score kept inside the rating range: a predictor without a model.

    ``paired`` reads :func:`pair_columns`.
    """
    return _bounded(F.expr(PAIRED_SCORE if paired else SCORE))
