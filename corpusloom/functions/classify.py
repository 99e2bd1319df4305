"""Ordered rules that name what a file or function is."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import java
from .fixed import (
    ARROW_PATTERN,
    ASYNC_PATTERN,
    COMPONENT_DEFAULT,
    COMPONENT_NAME_RULES,
    COMPONENT_TEXT_RULES,
    ENTRY_NAMES,
    ENTRY_PATTERNS,
    ENTRY_PREFIXES,
    FUNCTION_NAME_RULES,
    PURPOSE_GATE,
    PURPOSE_RULES,
    SHAPE_DEFAULT,
    SHAPE_RULES,
)
from .paths import basename, contains_any, stem


def _first_rule(rules: list[tuple[Column, Column]], default: Column) -> Column:
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def component_type(path: Column, text: Column) -> Column:
    name = F.lower(basename(path))
    rules = [(contains_any(name, words), F.lit(label)) for words, label in COMPONENT_NAME_RULES]
    rules += [(contains_any(text, words), F.lit(label)) for words, label in COMPONENT_TEXT_RULES]
    return _first_rule(rules, F.lit(COMPONENT_DEFAULT))


def function_type(name: Column, text: Column) -> Column:
    lowered = F.lower(name)

    def around(pattern: str) -> Column:
        parts = java(pattern).split("NAME")
        return F.concat(F.lit(parts[0]), name, F.lit(parts[1]))

    rules = [(contains_any(lowered, words), F.lit(label)) for words, label in FUNCTION_NAME_RULES]
    rules += [
        (F.rlike(text, around(ASYNC_PATTERN)), F.lit("async-function")),
        (F.rlike(text, around(ARROW_PATTERN)), F.lit("arrow-function")),
    ]
    return _first_rule(rules, F.lit("function"))


def node_shape(kind: Column) -> Column:
    """Struct (shape, open, close) for a component type."""

    def shape(values: tuple[str, str, str]) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(("shape", "open", "close"), values)])

    return _first_rule([(contains_any(kind, words), shape(values)) for words, values in SHAPE_RULES], shape(SHAPE_DEFAULT))


def is_main_type(kind: Column) -> Column:
    return contains_any(kind, ["Main", "Entry"])


def is_entry_point(path: Column, text: Column) -> Column:
    name = F.lower(basename(path))
    named = name.isin(ENTRY_NAMES)
    for prefix in ENTRY_PREFIXES:
        named = named | name.startswith(prefix)
    for pattern in ENTRY_PATTERNS:  # one by one: each has a literal start to look for
        named = named | text.rlike(java(pattern))
    return named


def purpose(path: Column, text: Column) -> Column:
    """One sentence on what a file is for, from its path; only for code-like content."""
    rules = [
        (contains_any(text, PURPOSE_GATE) & contains_any(path, words), F.lit(sentence)) for words, sentence in PURPOSE_RULES
    ]
    return _first_rule(rules, F.concat(F.lit("Contains code for "), stem(path), F.lit(" module")))
