"""Deterministic picks: md5-based, so every engine draws the same values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, salt: str) -> Column:
    """A bigint in [0, 2^32): the first eight hex digits of ``md5(key:salt)``."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def draw_below(key: Column, salt: str, n: int | Column) -> Column:
    return draw(key, salt) % n


def pick(values: Sequence, key: Column, salt: str) -> Column:
    """One element of a fixed list."""
    return pick_from(F.lit(list(values)), key, salt)


def pick_from(values: Column, key: Column, salt: str) -> Column:
    """One element of an array column."""
    return F.element_at(values, (draw(key, salt) % F.size(values) + 1).cast("int"))


def lookup(table: Mapping, key: Column, default: Column | None = None) -> Column:
    """Value of a small fixed mapping; ``default`` (or null) for other keys."""
    entries = [F.lit(x) for k, v in table.items() for x in (k, v)]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, default)


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """True where ``text`` contains a keyword; the keywords hold no regex characters."""
    return text.rlike("|".join(keywords)) if keywords else F.lit(False)
