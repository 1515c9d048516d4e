"""Column helpers with pinned semantics: rounding, division, casts, null order, lenient dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_scaled(x: Column, digits: int) -> Column:
    """Round half away from zero on the scaled double, so ties fall as in an engine that scales before it rounds."""
    scale = float(10**digits)
    return F.round(x.cast("double") * scale, 0) / scale


def decimal_text(x: Column) -> Column:
    """A bare DECIMAL of the source queries: three decimals, rounded on the scaled double."""
    return round_scaled(x, 3).cast("decimal(18,3)")


def divide(a: Column, b: Column) -> Column:
    """a / b as double, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def whole(x: Column) -> Column:
    """Double to integer by rounding half to even."""
    return F.bround(x, 0).cast("long")


def integer_sequence(low: Column, high: Column) -> Column:
    """low to high, empty where high is less than low (a plain sequence would descend)."""
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))


def seconds_between(low: Column, high: Column) -> Column:
    """Exact seconds from low to high, as double."""
    return F.timestamp_diff("MICROSECOND", low, high) / 1e6


#: Patterns of dates, and what a text must look like to be read by one: a pattern that fails costs an exception.
DATE_PATTERNS = {
    "yyyy-M-d": "^[^:/.]*-[^:/.]*$", "yyyy/M/d": "^[^:.]*/[^:.]*$", "yyyy.M.d": "^[^:/]*[.][^:/]*$", "yyyyMMdd": "^[^:/.]+$", "d/M/yyyy": "^[^:.]*/[^:.]*$", "yyyy-M-d H:m:s": "^[^:]*:[^:]*:[^:]*$",
    "yyyy-M-d H:m": "^[^:]*:[^:]*$",
}


def any_date(text: Column) -> Column:
    """The first of DATE_PATTERNS that reads the whole text, or null."""
    return F.coalesce(*[F.when(text.rlike(shape), F.try_to_timestamp(F.trim(text), F.lit(p))) for p, shape in DATE_PATTERNS.items()])


def value_kind(text: Column) -> Column:
    """'', timestamp, numeric or string, for values in text form."""
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, "").when(text.rlike(r"^\d{4}-") & F.try_to_timestamp(text).isNotNull(), "timestamp").when(text.rlike("(?i)[0-9]|nan|inf") & text.try_cast("double").isNotNull(), "numeric").otherwise("string")


def ordered_choice(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def synonyms(column: Column, mapping: dict[str, str]) -> Column:
    """The mapped name where there is one, else the value itself."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(pairs, column), column)


def matches_any(column: Column, terms: tuple[str, ...], fold: bool = True) -> Column:
    """Whether the value contains one of the terms, as one alternation."""
    import re

    return (F.lower(column) if fold else column).rlike("|".join(re.escape(t.lower() if fold else t) for t in terms))
