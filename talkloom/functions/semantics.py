"""Dialect semantics as column functions: where Spark's default differs, the difference is settled here once."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[0-9A-Za-z_]"
SPACE = "[\\t\\n\\f\\r ]"


def ascii_regex(pattern: str) -> str:
    """``pattern`` with \\b as an ASCII word boundary and \\s as ASCII white space without the vertical tab."""
    edge = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace("\\s", "\\t\\n\\f\\r "), pattern)
    return inside.replace("\\b", edge).replace("\\s", SPACE)


def trim_all(x: Column) -> Column:
    """``x`` without white space of any kind at its ends."""
    return F.regexp_replace(x, "^[\\s\\u00a0]+|[\\s\\u00a0]+$", "")


def collapse_space(x: Column) -> Column:
    return F.regexp_replace(x, f"{SPACE}+", " ")


def extract_or_null(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null, not '', if there is none."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def pct(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole, rounded half away from zero; null if whole is 0."""
    return F.round(F.lit(100.0) * part / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def share(part: Column, whole: Column, digits: int) -> Column:
    return F.round(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def mean(x: Column, digits: int) -> Column:
    return F.round(F.avg(x), digits)


def week_start(date: Column, first: str = "sunday") -> Column:
    """The first day of the date's week, which begins on Sunday or Monday."""
    day = F.to_date(date)
    if first == "sunday":
        return F.date_sub(day, F.dayofweek(day) - 1)
    if first == "monday":
        return F.date_sub(day, F.weekday(day))
    raise ValueError(f"weeks begin on sunday or monday, not {first}")


def month_start(date: Column) -> Column:
    return F.trunc(F.to_date(date), "MM")


def string_agg(x: Column, order: Column, sep: str) -> Column:
    """Non-null ``x`` of a group joined in ``order``; null if all are null."""
    kept = F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x"))))
    return F.when(F.count(x) > 0, F.array_join(F.transform(F.array_sort(kept), lambda s: s["x"]), sep))


def distinct_agg(x: Column, sep: str, most: int) -> Column:
    """The first ``most`` distinct values in order, joined."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(x)), 1, most), sep)


def bucket(x: Column, bounds: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first bound that ``x`` is under."""
    out = None
    for bound, name in bounds:
        out = F.when(x < bound, name) if out is None else out.when(x < bound, name)
    return out.otherwise(rest)
