"""Outfit compatibility features.

The features read the flat column names of an outfit: ``top_type``, ``bottom_material``,
``season``, ``temperature``, ``style_preference`` and so on. ``variant`` chooses between the
training and the serving behaviour, which differ in word lists and case handling. The three
share features can also read per-garment hits prepared before outfits are enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perchero import lookups as L
from perchero.functions.sqltext import among, case, number, text

DEFAULT_FORMALITY = 3
MATCHES = {
    "color_match": "primary_color", "material_match": "material", "pattern_match": "pattern",
}
PAIRS = [("top", "bottom"), ("top", "shoes"), ("bottom", "shoes")]


def formality(prefix: str = "") -> str:
    """Formality with the default for a missing value."""
    return f"coalesce({prefix}formality_level, {DEFAULT_FORMALITY})"


def match_columns() -> dict[str, Column]:
    """1 where top and bottom agree, 0 otherwise; two nulls do not agree."""
    return {
        name: F.expr(f"int(coalesce(top_{a} = bottom_{a}, false))") for name, a in MATCHES.items()
    }


def diff_columns() -> dict[str, Column]:
    return {
        f"formality_diff_{a}_{b}": F.expr(f"abs({formality(a + '_')} - {formality(b + '_')})")
        for a, b in PAIRS
    }


# --- share features -----------------------------------------------------------------------

def _style(variant: str) -> str:
    return "lower(style_preference)" if variant == "serve" else "style_preference"


def style_hit(variant: str, prefix: str = "") -> str:
    """1 where the garment's type or colour suits the user's style."""
    return case((
        (f"{_style(variant)} = {text(style)}",
         f"int({among(f'{prefix}type', types)} or {among(f'{prefix}primary_color', colors)})")
        for style, (types, colors) in L.STYLE_PREFS[variant].items()
    ), "0")


def material_hit(materials: list[str], prefix: str = "") -> str:
    return f"int({among(f'lower({prefix}material)', materials)})"


def garment_inputs(variant: str, prefix: str = "") -> dict[str, str]:
    """What the three share features need to know about one garment."""
    return {
        "style_hit": style_hit(variant, prefix),
        "summer": material_hit(L.SUMMER_MATERIALS, prefix),
        "winter": material_hit(L.WINTER_MATERIALS, prefix),
    }


def _share(name: str, variant: str, prepared: bool) -> str:
    hits = [
        f"{r}_{name}" if prepared else garment_inputs(variant, f"{r}_")[name] for r in L.ROLES
    ]
    return f"({' + '.join(f'({h})' for h in hits)}) / 3.0D"


def style_match(variant: str = "train", prepared: bool = False) -> Column:
    """Share of the garments whose type or colour suits the style; 0.5 for other styles."""
    known = among(_style(variant), list(L.STYLE_PREFS[variant]))
    return F.expr(case([(known, _share("style_hit", variant, prepared))], number(0.5)))


def seasonal_appropriateness(variant: str = "train", prepared: bool = False) -> Column:
    """Share of the garments in a material of the season; 0.5 in mild seasons."""
    season = "season" if variant == "train" else "lower(season)"
    return F.expr(case([
        (f"{season} = 'verano'", _share("summer", variant, prepared)),
        (f"{season} = 'invierno'", _share("winter", variant, prepared)),
    ], number(0.5)))


def temp_material_match(prepared: bool = False) -> Column:
    """As above by temperature. NaN is mild, although Spark orders it above every number."""
    return F.expr(case([
        ("isnan(temperature)", number(0.5)),
        ("temperature > 25", _share("summer", "train", prepared)),
        ("temperature < 10", _share("winter", "train", prepared)),
    ], number(0.5)))


def share_kinds() -> dict[str, str]:
    """Which share each serving context asks for: of the style, and 1 summer, 2 winter or 0 neither."""
    known = among(_style("serve"), list(L.STYLE_PREFS["serve"]))
    return {
        "style": f"coalesce({known}, false)",
        "season_kind": case([("lower(season) = 'verano'", "1"), ("lower(season) = 'invierno'", "2")], "0"),
        "temp_kind": case([
            ("isnan(temperature)", "0"), ("temperature > 25", "1"), ("temperature < 10", "2")], "0"),
    }


def feature_columns(variant: str = "train", prepared: bool = False) -> dict[str, Column]:
    """All nine features; ``prepared`` reads the per-garment hits instead of the texts."""
    return {
        **match_columns(),
        **diff_columns(),
        "style_match": style_match(variant, prepared),
        "seasonal_appropriateness": seasonal_appropriateness(variant, prepared),
        "temp_material_match": temp_material_match(prepared),
    }


def pair_columns() -> dict[str, str]:
    """What the serving features read of a top and a bottom, and which shares the context asks for."""
    hits = {f"{name}_pair": f"top_{name} + bottom_{name}" for name in garment_inputs("serve")}
    matches = {
        name: f"int(coalesce(top_{a} = bottom_{a}, false))" for name, a in MATCHES.items()}
    level = f"abs({formality('top_')} - {formality('bottom_')})"
    return {**matches, "formality_diff_top_bottom": level, **hits, **share_kinds()}


def paired_columns() -> dict[str, Column]:
    """The features that also read the shoes, from :func:`pair_columns`; as :func:`feature_columns`."""
    def share(name: str) -> str:
        return f"({name}_pair + shoes_{name}) / 3.0D"

    seasonal = [(f"{{}} = {kind}", share(name)) for kind, name in ((1, "summer"), (2, "winter"))]
    shares = {
        "style_match": case([("style", share("style_hit"))], number(0.5)),
        **{feature: case([(test.format(kind), value) for test, value in seasonal], number(0.5))
           for feature, kind in (("seasonal_appropriateness", "season_kind"),
                                 ("temp_material_match", "temp_kind"))},
    }
    diffs = {name: c for name, c in diff_columns().items() if "shoes" in name}
    return {**diffs, **{name: F.expr(sql) for name, sql in shares.items()}}


def flat_columns() -> tuple[dict[str, str], dict[str, str]]:
    """The serving features as text over flat outfits, and the texts of the hits that they read by name."""
    kinds = share_kinds()

    def seasonal(kind: str) -> str:
        return case([(f"{kinds[kind]} = {n}", _share(hit, "serve", True)) for n, hit in ((1, "summer"), (2, "winter"))], number(0.5))

    found = {
        **{name: f"int(coalesce(top_{a} = bottom_{a}, false))" for name, a in MATCHES.items()},
        **{f"formality_diff_{a}_{b}": f"abs({formality(a + '_')} - {formality(b + '_')})" for a, b in PAIRS},
        "style_match": case([(kinds["style"], _share("style_hit", "serve", True))], number(0.5)),
        "seasonal_appropriateness": seasonal("season_kind"),
        "temp_material_match": seasonal("temp_kind"),
    }
    slots = {f"{r}_{name}": sql for r in L.ROLES for name, sql in garment_inputs("serve", f"{r}_").items()}
    return found, slots


def add_features(outfits: DataFrame, variant: str = "train") -> DataFrame:
    """All features at once; missing descriptions become empty text."""
    texts = [f"{r}_description" for r in L.ROLES if f"{r}_description" in outfits.columns]
    if texts:
        outfits = outfits.fillna("", subset=texts)
    return outfits.withColumns(feature_columns(variant))
