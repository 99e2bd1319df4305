"""String columns: formatting, escaping, truncating."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import java
from .fixed import (
    BYTE_UNITS,
    DIAGRAM_KINDS,
    HTML_ESCAPES,
    HTML_TAG,
    NO_EXPLANATION,
    PREVIEW_CHARS,
    TRUNCATION_MARK,
)
from .paths import contains_any, strip


def literal_replace(value: Column, old: str, new: str) -> Column:
    return F.replace(value, F.lit(old), F.lit(new))


def format_bytes(size: Column, decimals: int = 2) -> Column:
    """Size with the largest fitting unit of 1024 steps, trailing zeros dropped."""
    places = max(decimals, 0)

    def scaled(power: int) -> Column:
        amount = F.round(size / F.lit(float(1024**power)), places).cast(f"decimal(30,{places})").cast("string")
        if places:
            amount = F.regexp_replace(amount, r"\.?0+\z", "")
        return F.concat(amount, F.lit(" " + BYTE_UNITS[power]))

    result = F.when(size == 0, F.lit("0 " + BYTE_UNITS[0]))
    for power in range(len(BYTE_UNITS) - 1):
        result = result.when(size < 1024 ** (power + 1), scaled(power) if power else F.concat(size.cast("string"), F.lit(" Bytes")))
    return result.otherwise(scaled(len(BYTE_UNITS) - 1))


def capitalize_first(value: Column) -> Column:
    return F.concat(F.upper(F.substring(value, 1, 1)), value.substr(F.lit(2), F.length(value)))


def kebab(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1-$2"))


def truncate(value: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three of a cut text being dots."""
    cut = F.lit("...") if limit <= 3 else F.concat(F.substring(value, 1, limit - 3), F.lit("..."))
    return F.when(F.length(value) <= limit, value).otherwise(cut)


def preview(value: Column, chars: int = PREVIEW_CHARS, suffix: str = TRUNCATION_MARK) -> Column:
    return F.when(F.length(value) > chars, F.concat(F.substring(value, 1, chars), F.lit(suffix))).otherwise(value)


def escape_html(value: Column) -> Column:
    for old, new in HTML_ESCAPES:
        value = literal_replace(value, old, new)
    return value


def escape_regex(value: Column) -> Column:
    return F.regexp_replace(value, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def pluralize(count: Column, singular: str, plural: str) -> Column:
    return F.when(count == 1, singular).otherwise(plural)


def human_list(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    size = F.size(items)
    return (
        F.when(size == 0, "")
        .when(size <= 2, F.array_join(items, " and "))
        .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), size - 1), ", "), F.lit(", and "), F.element_at(items, -1)))
    )


def format_date(ts: Column) -> Column:
    return F.date_format(ts, "MMMM d, yyyy 'at' hh:mm a")


def unique_id(key: Column) -> Column:
    """Sixteen hex digits that are the same on every run for the same key."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, 16)


def strip_tags(value: Column) -> Column:
    return strip(F.regexp_replace(value, java(HTML_TAG), ""))


def plain_label(value: Column) -> Column:
    """Markup characters dropped; NULL when nothing is left to show."""
    return F.nullif(F.when(strip(value) == "", "").otherwise(F.translate(value, "<>&", "")), F.lit(""))


def unix_newlines(value: Column) -> Column:
    return strip(F.regexp_replace(value, r"\r\n?", "\n"))


def is_valid_diagram(value: Column) -> Column:
    return (F.length(strip(value)) > 0) & contains_any(value, DIAGRAM_KINDS)


def coalesce_body(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(NO_EXPLANATION))


def join_pieces(pieces: Column, fillers: Column) -> Column:
    """Text pieces with the fillers put back between them, in order."""
    return F.array_join(
        F.flatten(F.zip_with(pieces, fillers, lambda p, f: F.array(p, F.coalesce(f, F.lit(""))))), ""
    )
