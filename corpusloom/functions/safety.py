"""Checks and masks that keep secrets and nonsense out of names that are shown."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import any_of, java
from .fixed import (
    CONNECTION_MASKS,
    ENDPOINT_MASKS,
    GENERIC_CONNECTION,
    GENERIC_DEPENDENCY,
    GENERIC_ENDPOINT,
    INVALID_PACKAGE,
    NAME_MASK,
    UNSAFE_CONNECTION,
    UNSAFE_DEPENDENCY,
    UNSAFE_ENDPOINT,
    UNSAFE_FUNCTION,
)
from .text import literal_replace


def _none_of(patterns: list[str]):
    regex = any_of(patterns, java)
    return lambda value: ~value.rlike(regex)


is_valid_package = _none_of(INVALID_PACKAGE)
is_safe_function = _none_of(UNSAFE_FUNCTION)
is_safe_dependency = _none_of(UNSAFE_DEPENDENCY)
is_safe_connection = _none_of(UNSAFE_CONNECTION)
is_safe_endpoint = _none_of(UNSAFE_ENDPOINT)


def _masked(value: Column, masks: list[tuple[str, str]], needs: str) -> Column:
    """Masks apply only where the character they all need occurs; most texts skip them."""
    masked = value
    for pattern, replacement in masks:
        masked = F.regexp_replace(masked, java(pattern), replacement)
    return F.when(value.contains(needs), masked).otherwise(value)


def sanitize_dependency(value: Column) -> Column:
    return F.when(is_safe_dependency(value), value).otherwise(GENERIC_DEPENDENCY)


def sanitize_connection(value: Column) -> Column:
    masked = _masked(value, CONNECTION_MASKS, "=")
    return F.when(is_safe_connection(masked), masked).otherwise(GENERIC_CONNECTION)


def sanitize_endpoint(value: Column) -> Column:
    paths, queries = ENDPOINT_MASKS
    masked = _masked(_masked(value, [paths], "/"), [queries], "=")
    return F.when(is_safe_endpoint(masked), masked).otherwise(GENERIC_ENDPOINT)


def display_name(value: Column) -> Column:
    """A component or function name as it may be shown: quoted, on one line, words masked.

    Every sensitive word is masked, so the generic name for what is left is never needed.
    """
    quoted = literal_replace(literal_replace(value, '"', '\\"'), "\n", " ")
    return F.regexp_replace(quoted, java(NAME_MASK), "***")
