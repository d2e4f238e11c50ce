"""Colour, length and style-value functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name no colour.
NOT_COLORS = ("inherit", "initial", "transparent", "none", "unset", "currentcolor")
_NUMBER = r"^\s*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\s*$"


def _channels(value: Column) -> Column:
    """The three clamped, truncated channels of rgb(...) or rgba(...), or null."""
    inside = F.slice(F.split(F.regexp_extract(value, r"^rgba?\(([^)]+)\)", 1), ","), 1, 3)
    numbers = F.transform(inside, lambda x: F.when(x.rlike(_NUMBER), F.greatest(F.lit(0), F.least(F.lit(255), F.trim(x).cast("double").cast("int")))))
    return F.when(value.rlike(r"^rgba?\([^)]+\)") & (F.size(inside) == 3) & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def _hex(numbers: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(numbers[i]), 2, "0")) for i in range(3)))


def _six(digits: Column) -> Column:
    """Three digits doubled; others as they are."""
    return F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)


def normalize(value: Column) -> Column:
    """#rrggbb of rgb(), rgba() and hex colours, words as they are; null for what is no colour."""
    v = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    first = F.regexp_extract(v, r"^(\S*)", 1)
    digits = _six(F.substring(first, 2, 100))
    return (
        F.when(v.rlike(r"^rgba?\([^)]+\)"), _hex(_channels(v)))
        .when(first.startswith("#"), F.when(digits.rlike("^([0-9a-f]{6}|[0-9a-f]{8})$"), F.concat(F.lit("#"), F.substring(digits, 1, 6))))
        .when(first.isin(*NOT_COLORS), F.lit(None))
        .when(first.rlike("^[a-z]+$"), first)
    )


def normalize_hex(value: Column) -> Column:
    """Like normalize, but of rgb(), rgba() and three or six digits alone."""
    v = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    digits = _six(F.substring(v, 2, 100))
    return F.when(v.rlike(r"^rgba?\([^)]+\)"), _hex(_channels(v))).when(v.startswith("#") & digits.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), digits))


def channels_of_hex(value: Column) -> Column:
    """Three numbers of a hex colour with or without "#", or null."""
    v = _six(F.regexp_replace(F.lower(F.trim(value)), "^#", ""))
    return F.when(v.rlike("^[0-9a-f]{6}$"), F.transform(F.array(*map(F.lit, (1, 3, 5))), lambda i: F.conv(F.substr(v, i, F.lit(2)), 16, 10).cast("int")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((F.pow(a[i] - b[i], F.lit(2)) for i in range(3)), F.lit(0.0)))


def to_px(value: Column) -> Column:
    """Pixels of a length in px, rem, em or without unit; null otherwise."""
    v = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    pattern = r"^(-?[0-9]*\.?[0-9]+)\s*(px|rem|em)?$"
    number = F.regexp_extract(v, pattern, 1).try_cast("double")
    return F.when(v.rlike(pattern), F.when(F.regexp_extract(v, pattern, 2).isin("rem", "em"), number * 16).otherwise(number))


def normalize_style_value(value: Column) -> Column:
    """Values that look alike compare equal: none, 0px, 0 and empty; opaque rgba() and hex."""
    v = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    pattern = r"^rgba?\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*(?:,\s*([0-9.]+))?\s*\)"
    r, g, b = (F.regexp_extract(v, pattern, i).try_cast("int") for i in (1, 2, 3))
    alpha = F.coalesce(F.regexp_extract(v, pattern, 4).try_cast("double"), F.lit(1.0))
    return (
        F.when(v.isNull() | v.isin("none", "0px", "0", ""), "none")
        .when(v.rlike(pattern) & (alpha >= 0.999), _hex(F.array(r, g, b)))
        .when(v.rlike(pattern), F.format_string("rgba(%d,%d,%d,%.2f)", r, g, b, alpha))
        .otherwise(v)
    )


def specificity(selector: Column) -> Column:
    """struct(ids, classes, tags) of a selector, without its pseudo-classes."""
    s = F.when(selector.contains(":"), F.regexp_replace(selector, r":[a-zA-Z0-9_-]+(\([^)]*\))?", "")).otherwise(selector)

    def count(x: str) -> Column:
        return F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))

    return F.struct(count("#").alias("ids"), (count(".") + count("[")).alias("classes"), F.regexp_count(s, F.lit(r"(^|[\s>+~]+)[a-zA-Z0-9]+")).alias("tags"))
