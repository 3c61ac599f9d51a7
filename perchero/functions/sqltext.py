"""Small helpers for SQL expression text.

The scoring rules are long. As SQL text a rule set costs one call into the JVM instead of one
per operator, which takes seconds off every query that uses it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame


def number(value: float) -> str:
    """A double literal (a bare one would be a decimal)."""
    return f"{float(value)!r}D"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def among(expr: str, values: Sequence[str]) -> str:
    """Membership; null is not a member."""
    return f"coalesce({expr} in ({', '.join(text(v) for v in values)}), false)"


def mentions(expr: str, keywords: Sequence[str]) -> str:
    """True where the text contains a keyword; null contains none."""
    return f"coalesce({expr} rlike {text('|'.join(keywords))}, false)" if keywords else "false"


def yes(condition: str) -> str:
    return f"coalesce({condition}, false)"


def case(pairs: Iterable[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"when {condition} then {value}" for condition, value in pairs)
    return f"case {whens} else {default} end" if whens else default


def points(condition: str, value: float) -> str:
    return case([(condition, number(value))], number(0.0))


# What :func:`mentions` gives for one attribute, bare, in lower case or without nulls.
SEARCH = re.compile(r"coalesce\((?:\w+|lower\(\w+\)|coalesce\(\w+, ''\)) rlike '[^']*', false\)")


def hoisted(columns: Mapping[str, str], name: str) -> tuple[dict[str, str], dict[str, str]]:
    """The text searches inside the columns as columns of their own, and the columns reading those."""
    found: dict[str, str] = {}

    def column(match: re.Match) -> str:
        return found.setdefault(match.group(), f"{name}{len(found)}")

    rest = {key: SEARCH.sub(column, sql) for key, sql in columns.items()}
    return {alias: sql for sql, alias in found.items()}, rest


def pair_terms(terms: Iterable[str], name: str) -> dict[str, str]:
    """A column name for each term that reads both top and bottom, and no shoes."""
    both = [t for t in terms if "top_" in t and "bottom_" in t and "shoes_" not in t]
    return {t: f"{name}{i}" for i, t in enumerate(both)}


def total(terms: Iterable[str]) -> str:
    """A sum in the given order; the order decides the last digits."""
    return " + ".join(f"({t})" for t in terms)


def with_columns(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add SQL columns in one step."""
    return rows.selectExpr("*", *[f"{sql} as {name}" for name, sql in columns.items()])
