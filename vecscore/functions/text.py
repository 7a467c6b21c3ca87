"""Text functions of the cleaner, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, spelled out so that every engine reads it alike.
SPACE = r"[ \t\r\n\f\x0B]+"


def normal_space(col: Column) -> Column:
    """Null becomes empty; runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), SPACE, " "))


def strip_tags(col: Column) -> Column:
    """Each ``<...>`` becomes a blank, then :func:`normal_space`."""
    return normal_space(F.regexp_replace(col, "<[^>]+>", " "))


def alpha_ratio(col: Column) -> Column:
    """Letters over characters that aren't blank, at least one."""
    letters = F.length(F.regexp_replace(col, r"[^\p{L}]", ""))
    solid = F.length(F.regexp_replace(col, SPACE, ""))
    return letters / F.greatest(solid, F.lit(1))


def any_pattern(col: Column, patterns: list[str]) -> Column:
    """Whether any of the regular expressions is found; none given: never."""
    return col.rlike("(" + "|".join(patterns) + ")") if patterns else F.lit(False)


def without_title(abstract: Column, title: Column) -> Column:
    """The abstract less a leading repeat of the title, in any case, and the marks after it."""
    low = F.lower(title)
    rest = F.substring(abstract, F.length(low) + 1, F.length(abstract))
    trimmed = normal_space(F.regexp_replace(rest, r"^[ \t\r\n\f\x0B:;,.\-]+", ""))
    return F.when((F.length(title) > 0) & F.startswith(F.lower(abstract), low), trimmed).otherwise(abstract)
