"""Structure extraction: what a file declares, imports, connects to and starts.

Every rule works on one row and gives arrays, first-seen order kept and repeats dropped
inside the row. Nothing is shuffled, the text is not carried any further, and the
functions below that give one row per match only unfold those arrays.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, safety
from ..functions.dialect import NEEDS, NEEDS_MATCH, java
from ..functions.fixed import (
    API_CONNECTION_PATTERNS,
    API_PATTERNS,
    DATABASE_PATTERNS,
    DB_CONNECTION_PATTERNS,
    DEPENDENCY_PATTERNS,
    FUNCTION_PATTERNS,
    MAX_FUNCTIONS_PER_FILE,
    RESERVED_FUNCTIONS,
)
from ..functions.paths import stem

_BLANK = java(r"^\s*$")


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    found = F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))
    none = F.array().cast("array<string>")
    if pattern in NEEDS_MATCH:
        found = F.when(text.rlike(java(NEEDS_MATCH[pattern])), found).otherwise(none)
    if pattern in NEEDS:
        found = F.when(text.contains(NEEDS[pattern]), found).otherwise(none)
    return found


def function_names(text: Column, limit: int | None = MAX_FUNCTIONS_PER_FILE) -> Column:
    found = F.concat(*[all_matches(text, pattern, 1) for pattern in FUNCTION_PATTERNS])
    named = F.filter(
        found, lambda n: (F.length(n) > 1) & ~F.lower(n).isin(RESERVED_FUNCTIONS) & safety.is_safe_function(n)
    )
    distinct = F.array_distinct(named)
    return F.slice(distinct, 1, limit) if limit else distinct


def functions(text: Column, limit: int | None = MAX_FUNCTIONS_PER_FILE) -> Column:
    """array<struct<name,type>> of declared functions."""
    return F.transform(
        function_names(text, limit), lambda n: F.struct(n.alias("name"), classify.function_type(n, text).alias("type"))
    )


def _first_group(text: Column, pattern: str, groups: int) -> Column:
    """Group 1 of every match; of a pattern with two alternatives, the one that is not blank.

    The text is searched once; the alternatives are told apart in the short matches.
    """
    if groups == 1:
        return all_matches(text, pattern, 1)
    regex = java(pattern)

    def pick(match: Column) -> Column:
        first = F.regexp_extract(match, regex, 1)
        return F.when(first.rlike(_BLANK), F.regexp_extract(match, regex, 2)).otherwise(first)

    return F.transform(all_matches(text, pattern), pick)


def dependencies(text: Column, strict: bool = False, resolve_relative: bool = False) -> Column:
    """Imported names, cut to the package unless scoped.

    ``strict`` also drops an opening brace taken from ``import { x } from``.
    ``resolve_relative`` keeps ``./x`` imports as the stem of the file they name.
    """
    raw = F.concat(*[_first_group(text, pattern, groups) for pattern, groups in DEPENDENCY_PATTERNS])
    if resolve_relative:
        raw = F.transform(raw, lambda d: F.when(d.startswith("./") | d.startswith("../"), stem(d)).otherwise(d))
    usable = F.filter(raw, lambda d: ~d.rlike(_BLANK) & ~d.startswith("."))
    packages = F.transform(usable, lambda d: F.when(d.startswith("@"), d).otherwise(F.substring_index(d, "/", 1)))

    def accepted(d: Column) -> Column:
        valid = safety.is_safe_dependency(d) & safety.is_valid_package(d)
        return valid & (d != "{") if strict else valid

    return F.array_distinct(F.filter(packages, accepted))


def relative_imports(text: Column) -> Column:
    """Import specifiers that name a file by its place: ``./x``, ``../x``, ``.`` and ``..``, as they are written."""
    raw = F.concat(*[_first_group(text, pattern, groups) for pattern, groups in DEPENDENCY_PATTERNS])
    return F.array_distinct(F.filter(raw, lambda d: d.isin(".", "..") | d.startswith("./") | d.startswith("../")))


def databases(text: Column) -> Column:
    """Database words; a phrase from a connection word to a database word gives its first token."""
    lowered = [F.transform(all_matches(text, pattern), F.lower) for pattern in DATABASE_PATTERNS]
    lowered[-1] = F.transform(lowered[-1], lambda phrase: F.regexp_extract(phrase, java(r"^\S+"), 0))
    return F.array_distinct(F.concat(*lowered))


def apis(text: Column) -> Column:
    return F.array_distinct(F.transform(F.concat(*[all_matches(text, pattern) for pattern in API_PATTERNS]), F.lower))


def db_connections(text: Column) -> Column:
    found = F.concat(*[all_matches(text, pattern, group) for pattern, group in DB_CONNECTION_PATTERNS])
    return F.array_distinct(F.transform(F.filter(found, safety.is_safe_connection), safety.sanitize_connection))


def api_connections(text: Column) -> Column:
    found = F.concat(*[all_matches(text, pattern, group) for pattern, group in API_CONNECTION_PATTERNS])
    return F.array_distinct(F.transform(F.filter(found, safety.is_safe_endpoint), safety.sanitize_endpoint))


def extract_structure(files: DataFrame, text: str = "content", path: str = "relative_path", **dependency_options) -> DataFrame:
    """One narrow record per file, without its text: the input of all graph operators.

    ``functions`` holds the first fifteen, ``n_functions`` counts all.
    """
    body, where = F.col(text), F.col(path)
    files = files.withColumn("_names", function_names(body, None))
    return files.select(
        "project",
        "file_id",
        path,
        *(["language"] if "language" in files.columns else []),
        stem(where).alias("name"),
        classify.component_type(where, body).alias("type"),
        F.transform(
            F.slice("_names", 1, MAX_FUNCTIONS_PER_FILE), lambda n: F.struct(n.alias("name"), classify.function_type(n, body).alias("type"))
        ).alias("functions"),
        F.size("_names").cast("long").alias("n_functions"),
        dependencies(body, **dependency_options).alias("dependencies"),
        databases(body).alias("databases"),
        apis(body).alias("apis"),
        db_connections(body).alias("db_connections"),
        api_connections(body).alias("api_connections"),
        classify.is_entry_point(where, body).alias("is_entry"),
    )


def _unfold(files: DataFrame, values: Column, out: str, keep: tuple[str, ...] = ("project", "file_id")) -> DataFrame:
    return files.select(*keep, F.posexplode(values).alias("pos", out))


def extract_functions(files: DataFrame, limit: int | None = MAX_FUNCTIONS_PER_FILE) -> DataFrame:
    rows = _unfold(files, functions(F.col("content"), limit), "f")
    return rows.select("project", "file_id", "pos", "f.name", "f.type")


def extract_dependencies(files: DataFrame, **options) -> DataFrame:
    return _unfold(files, dependencies(F.col("content"), **options), "dependency")


def extract_databases(files: DataFrame) -> DataFrame:
    return _unfold(files, databases(F.col("content")), "database")


def extract_apis(files: DataFrame) -> DataFrame:
    return _unfold(files, apis(F.col("content")), "api")


def extract_db_connections(files: DataFrame) -> DataFrame:
    return _unfold(files, db_connections(F.col("content")), "connection")


def extract_api_connections(files: DataFrame) -> DataFrame:
    return _unfold(files, api_connections(F.col("content")), "connection")


def entry_points(files: DataFrame) -> DataFrame:
    path = F.col("relative_path")
    found = F.when(
        classify.is_entry_point(path, F.col("content")), F.array(F.struct(stem(path).alias("name"), path.alias("file")))
    )
    return files.select("project", "file_id", F.inline(found))
