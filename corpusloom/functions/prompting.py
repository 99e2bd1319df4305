"""Prompt columns: template rendering, token estimates, cache keys, mode names."""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CHARS_PER_TOKEN, LEVEL_DEFAULT, LEVELS, MODE_ALIASES, PROJECT_MODES, PROMPT_SUFFIX

MISSING = "undefined"


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def estimate_tokens(text: Column, prompt: Column | None = None, completion: Column | None = None, total: Column | None = None) -> Column:
    """Counts reported by the model where there are any, else a quarter of the text's length."""
    guess = F.when(text.isNull(), 0).otherwise(F.ceil(utf16_length(text) / CHARS_PER_TOKEN)).cast("long")
    reported = [prompt + completion] if prompt is not None and completion is not None else []
    reported += [total] if total is not None else []
    return F.coalesce(*[c.cast("long") for c in reported], guess)


def render(template: Column, variables: Mapping[str, Column]) -> Column:
    """Fill ``{{name}}`` placeholders.

    The template is cut at its placeholders first and filled afterwards, so values are
    taken literally and never searched for placeholders themselves.
    """
    tokens = F.split(template, r"(?=\{\{)|(?<=\}\})")

    def fill(token: Column) -> Column:
        chain = F
        for name, value in variables.items():
            chain = chain.when(token == "{{" + name + "}}", F.coalesce(value, F.lit(MISSING)))
        return chain.otherwise(token)

    return F.array_join(F.transform(tokens, fill), "")


def level_phrase(level: Column) -> Column:
    phrase = F.lit(LEVEL_DEFAULT)
    for name, text in LEVELS.items():
        phrase = F.when(level == name, text).otherwise(phrase)
    return phrase


def resolve_mode(mode: Column) -> Column:
    for alias, name in MODE_ALIASES.items():
        mode = F.when(mode == alias, name).otherwise(mode)
    return mode


def mode_label(mode: Column) -> Column:
    """Struct (label, slug) of a project-level mode; NULL for file-level modes."""
    result = F.lit(None)
    for name, (label, slug) in PROJECT_MODES.items():
        named = F.struct(F.lit(label).alias("label"), F.lit(slug).alias("slug"))
        result = F.when(resolve_mode(mode) == name, named).otherwise(result)
    return result


def with_suffix(prompt: Column) -> Column:
    return F.concat(prompt, F.lit(PROMPT_SUFFIX))


def cache_key(path: Column, mode: Column, level: Column, provider: Column, model: Column) -> Column:
    parts = [F.coalesce(part.cast("string"), F.lit(MISSING)) for part in (path, mode, level, provider, model)]
    return F.md5(F.concat_ws("-", *parts))
