"""Operators on a table of files: description, filters, counts, listings, ordering."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, prompting, text
from ..functions.fixed import (
    CODE_EXTENSIONS,
    DEFAULT_CONCURRENCY,
    DEFAULT_LANGUAGE,
    EXCLUDES,
    LANGUAGES,
    MAX_CONCURRENCY,
    MAX_KEY_FILES,
    OFFLINE_FILE,
    OFFLINE_PROJECT,
)
from .scale import first_n, lookup_join, ordinal
from .scale import neighbours as id_neighbours


def languages(spark: SparkSession) -> DataFrame:
    """The extension table, under a hundred fixed rows."""
    rows = ", ".join(f"('{ext}', '{language}')" for ext, language in LANGUAGES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS languages(ext, language)")


def detect_language(df: DataFrame, path: str = "relative_path") -> DataFrame:
    """Add ``language`` by extension; the fixed table is small enough to broadcast."""
    return (
        df.withColumn("ext", paths.extension(F.col(path)))
        .join(F.broadcast(languages(df.sparkSession)), "ext", "left")
        .withColumn("language", F.coalesce("language", F.lit(DEFAULT_LANGUAGE)))
        .drop("ext")
    )


def include_files(
    files: DataFrame, exts: Sequence[str] = CODE_EXTENSIONS, excludes: Sequence[str] = EXCLUDES, force: bool = False, match: str = "substring"
) -> DataFrame:
    return files.filter(paths.included(F.col("relative_path"), exts, excludes, force=force, match=match))


def apply_ignore_rules(files: DataFrame, rules: Sequence[str]) -> DataFrame:
    return files.filter(~paths.ignored_by(F.col("relative_path"), rules))


def limit_size(files: DataFrame, max_mb: float) -> DataFrame:
    return files.filter(F.octet_length("content") <= int(max_mb * 1024 * 1024))


def count_files(files: DataFrame, **rules) -> DataFrame:
    """Accepted files per project; reads paths only."""
    return include_files(files.select("project", "relative_path"), **rules).groupBy("project").agg(F.count("*").alias("files"))


def describe_files(files: DataFrame) -> DataFrame:
    """Path parts, content hash, language and size of every file."""
    path = F.col("relative_path")
    described = files.select(
        "file_id",
        "project",
        "relative_path",
        paths.basename(path).alias("file_name"),
        paths.stem(path).alias("stem"),
        paths.dirname(path).alias("dir"),
        paths.extension(path).alias("extension"),
        F.sha2("content", 256).alias("hash"),
        F.octet_length("content").cast("long").alias("size"),
    )
    return detect_language(described)


def offline_results(files: DataFrame, mode: str) -> DataFrame:
    """What a run without a model gives: one fixed text per file, or one row per project."""
    named = prompting.mode_label(F.lit(mode))
    if prompting.MODE_ALIASES.get(mode, mode) in prompting.PROJECT_MODES:
        return files.select("project").distinct().select(
            "project", named["label"].alias("relative_path"), named["slug"].alias("path"), F.lit(mode).alias("language"),
            F.lit(OFFLINE_PROJECT).alias("explanation"),
        )
    return files.withColumn("explanation", F.lit(OFFLINE_FILE))


def language_counts(files: DataFrame) -> DataFrame:
    return (
        files.groupBy("project", F.coalesce("language", F.lit("unknown")).alias("language"))
        .agg(F.count("*").alias("files"), F.min("file_id").alias("first_file_id"))
    )


def primary_language(files: DataFrame) -> DataFrame:
    """Most frequent language; of equal ones, that whose first file comes last."""
    return language_counts(files).groupBy("project").agg(
        F.max_by("language", F.struct("files", "first_file_id")).alias("language")
    )


def tech_stack(files: DataFrame) -> DataFrame:
    """Distinct languages and extensions in first-seen order, one row each."""
    kinds = F.array(
        F.struct(F.lit("language").alias("kind"), F.col("language").alias("value")),
        F.struct(F.lit("extension").alias("kind"), paths.raw_extension(F.col("relative_path")).alias("value")),
    )
    seen = (
        files.select("project", "file_id", F.inline(kinds))
        .groupBy("project", "kind", "value")
        .agg(F.min("file_id").alias("first_file_id"))
    )
    return ordinal(seen, ["project", "kind"], "first_file_id")


def by_directory(files: DataFrame, *carried: str) -> DataFrame:
    """Directory listing as rows: order by (dir_first, file_id) to print it. Other columns can be carried along."""
    path = F.col("relative_path")
    listed = files.select("project", "file_id", paths.dirname(path).alias("dir"), paths.basename(path).alias("file_name"), *carried)
    dirs = listed.groupBy("project", "dir").agg(F.count("*").alias("dir_files"), F.min("file_id").alias("dir_first"))
    shown = F.when(F.col("dir") == ".", "Root Directory").otherwise(F.col("dir"))
    return lookup_join(listed, dirs, ["project", "dir"], "file_id").withColumn("dir", shown)


def key_files(files: DataFrame, n: int = MAX_KEY_FILES) -> DataFrame:
    return first_n(files.filter(paths.is_key_file(F.col("relative_path"))), ["project"], ["file_id"], n, out="rank")


def assign_batches(files: DataFrame, concurrency: int = DEFAULT_CONCURRENCY) -> DataFrame:
    """Number consecutive groups of ``concurrency`` files, at most ten, within each project."""
    size = min(concurrency, MAX_CONCURRENCY)
    return ordinal(files, ["project"], "file_id").withColumn("batch", F.floor(F.col("ord") / size).cast("long")).drop("ord")


def progress(files: DataFrame) -> DataFrame:
    """Completed, total and rounded percent after each file."""
    numbered = ordinal(files, ["project"], "file_id", total="total")
    return numbered.withColumn("completed", F.col("ord") + 1).withColumn(
        "percent", F.floor(F.lit(100) * F.col("completed") / F.col("total") + F.lit(0.5)).cast("long")
    ).drop("ord")


def neighbours(files: DataFrame) -> DataFrame:
    """Previous and next file in reading order."""
    return id_neighbours(files.select("project", "file_id", "relative_path"), ["project"], "file_id", "file_id")


def _title() -> Column:
    return text.escape_html(F.col("relative_path"))


def toc(files: DataFrame) -> DataFrame:
    """Table of contents rows, one per file in order."""
    numbered = ordinal(files.select("project", "file_id", "relative_path"), ["project"], "file_id", out="index")
    return numbered.select(
        "project", "index", "file_id", _title().alias("title"),
        F.concat(F.lit('<li><a href="#file-'), F.col("index").cast("string"), F.lit('">'), _title(), F.lit("</a></li>")).alias("item"),
    )


def dedupe_paths(files: DataFrame) -> DataFrame:
    """A distinct ``tree_path`` for every file: repeats get their file index as a suffix.

    The first holder of each path is found by a map-side minimum and matched back on the
    file's (project, file_id), so a path shared by many files makes no large group.
    """
    path = F.col("relative_path")
    if "path" in files.columns:  # a file without a relative path goes by its full path, root cut off
        path = F.coalesce(F.nullif(path, F.lit("")), F.regexp_replace("path", r"\A(?:[a-zA-Z]:\\|/)", ""))
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    listed = files.select("project", "file_id", slashed.alias("relative_path"))
    firsts = (
        listed.groupBy("project", "relative_path").agg(F.min("file_id").alias("file_id")).select("project", "file_id", F.lit(True).alias("_first"))
    )
    path, index = F.col("relative_path"), F.col("index").cast("string")
    folder = path.substr(F.lit(1), F.length(path) - F.length(paths.basename(path)))
    renamed = F.concat(folder, paths.stem(path), F.lit("_"), index, paths.raw_extension(path))
    return (
        ordinal(listed, ["project"], "file_id", out="index")
        .join(firsts, ["project", "file_id"], "left")
        .withColumn("tree_path", F.when(F.col("_first"), path).otherwise(renamed))
        .drop("_first")
    )


def path_tree(files: DataFrame) -> DataFrame:
    """One row per node of the path tree: parent, part, depth, and the file at a leaf."""
    named = dedupe_paths(files).select(
        "project", "file_id", F.filter(F.split("tree_path", "/"), lambda part: part != "").alias("parts")
    )
    nodes = named.select("project", "file_id", "parts", F.posexplode("parts").alias("depth", "part")).select(
        "project",
        F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("parent"),
        "part",
        "depth",
        (F.col("depth") == F.size("parts") - 1).alias("is_file"),
        F.when(F.col("depth") == F.size("parts") - 1, F.col("file_id")).alias("file_id"),
    )
    return nodes.distinct()
