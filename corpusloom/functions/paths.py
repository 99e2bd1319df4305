"""Path columns: parts of a path and the rules that include or exclude a file."""

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import WHITE_SPACE
from .fixed import CODE_EXTENSIONS, EXCLUDES, KEY_FILE_PARTS, OUTPUT_PREFIX


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(WHITE_SPACE))


def _any(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def contains_any(value: Column, words: Sequence[str]) -> Column:
    return _any([value.contains(word) for word in words])


def unslashed(path: Column) -> Column:
    return F.rtrim(path, F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(unslashed(path), "/", -1)


def dirname(path: Column) -> Column:
    """Directory of a path; ``.`` when there is none, ``/`` directly under the root."""
    clean = unslashed(path)
    parent = clean.substr(F.lit(1), F.length(clean) - F.length(basename(path)) - 1)
    return (
        F.when((clean == "") & path.startswith("/"), "/")
        .when(F.instr(clean, "/") == 0, ".")
        .when(parent == "", "/")
        .otherwise(parent)
    )


def raw_extension(path: Column) -> Column:
    """Extension with its dot, in the case it was written."""
    name = basename(path)
    return F.when(name == "..", "").otherwise(F.regexp_extract(name, r"(?s)\A.+(\.[^.]*)\z", 1))


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty for dotfiles and names without one."""
    return F.lower(raw_extension(path))


def stem(path: Column) -> Column:
    """File name without its extension."""
    name = basename(path)
    return name.substr(F.lit(1), F.length(name) - F.length(raw_extension(path)))


def relative_path(path: Column, base: str | None = None) -> Column:
    """Path below ``base`` with forward slashes; the bare file name without a base."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    if base is None:
        return basename(slashed)
    prefix = base.replace("\\", "/").rstrip("/") + "/"
    return F.when(slashed.startswith(prefix), slashed.substr(F.lit(len(prefix) + 1), F.length(slashed))).otherwise(slashed)


def folded(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts; NULL when it leads out of its root."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(done: Column, part: Column) -> Column:
        parts, out = done["parts"], done["out"]
        up = F.struct(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))).alias("parts"), (out | (F.size(parts) == 0)).alias("out"))
        down = F.struct(F.concat(parts, F.array(part)).alias("parts"), out.alias("out"))
        return F.when(part == "..", up).when(part.isin("", "."), done).otherwise(down)

    return F.reduce(F.split(path, "/"), start, step, lambda done: F.when(~done["out"], F.array_join(done["parts"], "/")))


def include_ext(path: Column, exts: Sequence[str] = CODE_EXTENSIONS) -> Column:
    return extension(path).isin([ext.lower() for ext in exts])


def not_own_output(path: Column, prefix: str = OUTPUT_PREFIX) -> Column:
    return ~basename(path).startswith(prefix)


def exclude_literal(path: Column, patterns: Sequence[str], match: str = "substring") -> Column:
    """True where a literal pattern hits: the whole file name, or any part of the path.

    ``match="segment"`` asks for whole path segments instead, so that ``log`` leaves
    ``blog/`` alone.
    """
    literals = [re.escape(p) for p in patterns if "*" not in p]
    if not literals:
        return F.lit(False)
    # one search for all literals, so that a pushed-down filter computes the path once
    anywhere = "|".join(literals)
    return path.rlike(rf"(?:\A|/)(?:{anywhere})(?:/|\z)" if match == "segment" else anywhere)


def glob_regex(pattern: str) -> str:
    return ".*".join(re.sub(r"([.+?^${}()|\[\]\\])", r"\\\1", part) for part in pattern.split("*"))


def exclude_glob(path: Column, patterns: Sequence[str]) -> Column:
    """True where a ``*`` pattern matches the whole file name."""
    globs = [glob_regex(p) for p in patterns if "*" in p]
    if not globs:
        return F.lit(False)
    return basename(path).rlike(r"(?s)\A(?:" + "|".join(globs) + r")\z")


def included(
    path: Column,
    exts: Sequence[str] = CODE_EXTENSIONS,
    excludes: Sequence[str] = EXCLUDES,
    prefix: str = OUTPUT_PREFIX,
    force: bool = False,
    match: str = "substring",
) -> Column:
    """All path rules together; ``force`` keeps only the own-output rule."""
    if force:
        return not_own_output(path, prefix)
    return (
        not_own_output(path, prefix)
        & include_ext(path, exts)
        & ~exclude_literal(path, excludes, match)
        & ~exclude_glob(path, excludes)
    )


def ignore_pattern(rule: str) -> tuple[str, bool]:
    """One line of an ignore file as (pattern for a whole path, ignored?); paths of folders end in a slash.

    The pattern means the same in Java and Python. A rule with a slash before its end starts at the
    ignore file's folder, any other one matches at any depth; a slash at its end asks for a folder.
    """
    ignored = not rule.startswith("!")
    body = rule.removeprefix("!")
    anchored = "/" in body.rstrip("/")
    tail = "/" if body.endswith("/") else "/?"
    parts = re.findall(r"\*\*/|/\*\*\Z|\*+|\?|\[[!^]?\]?[^\]/]*\]|\\.|.", body.strip("/"), re.S)

    def spelled(k: int, part: str) -> str:
        if part == "**/":
            return "(?:.*/)?"
        if part == "/**":
            return "/.+"
        if part[0] == "*":
            alone = parts[k - 1][-1] == "/" if k else True
            return "[^/]+" if alone and (parts[k + 1] == "/" if k + 1 < len(parts) else True) else "[^/]*"
        if part == "?":
            return "[^/]"
        if part[0] == "[" and len(part) > 2:
            inside = part[1:-1]
            negated = inside[0] in "!^"
            return ("[^/" if negated else "[") + re.sub(r"([\\\[\]&~|^])", r"\\\1", inside[1:] if negated else inside) + "]"
        return re.sub(r"([.+^${}()|\[\]\\*?])", r"\\\1", part[1:] if part[0] == "\\" and len(part) > 1 else part)

    if body.strip("/") == "**":
        return ".+", ignored
    return ("" if anchored else "(?:.*/)?") + "".join(spelled(k, p) for k, p in enumerate(parts)) + tail, ignored


def ignored_by(path: Column, rules: Sequence[str]) -> Column:
    """Ordered ignore rules: ``!`` re-includes, the last rule that matches decides.

    What lies below an ignored folder stays ignored, whatever matches it.
    """
    patterns = [(rf"(?s)\A(?:{pattern})\z", ignored) for pattern, ignored in map(ignore_pattern, rules)]

    def verdict(place: Column) -> Column:
        result = F.lit(False)
        for regex, ignored in patterns:
            result = F.when(place.rlike(regex), F.lit(ignored)).otherwise(result)
        return result

    if not patterns:
        return F.lit(False)
    parts = F.split(path, "/")
    above = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0)
    return F.exists(above, lambda n: verdict(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))) | verdict(path)


def is_key_file(path: Column) -> Column:
    return contains_any(path, KEY_FILE_PARTS)


def path_labels(title: Column, prefix: str) -> Column:
    """``prefix: a/b.js, c\\d.py`` with each path cut to its file name; other titles unchanged."""
    listed = F.regexp_extract(title, r"(?s)\A" + re.escape(prefix) + r":\s*(.+)\z", 1)
    names = F.transform(
        F.split(listed, ","),
        lambda p: F.coalesce(
            F.nullif(F.element_at(F.split(strip(p), r"[/\\]"), -1), F.lit("")),
            strip(p),
        ),
    )
    return F.when(listed == "", title).otherwise(F.concat(F.lit(prefix + ": "), F.array_join(names, ", ")))
