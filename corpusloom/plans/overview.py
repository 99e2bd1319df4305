"""The project job: summarise every file, then describe each project from the summaries."""

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, paths, text
from ..functions.fixed import MODE_ALIASES, PROJECT_ERROR_PREFIX, PROJECT_MODES
from ..functions.prompting import estimate_tokens
from ..operators.cache import CACHE_SCHEMA, with_cache_key
from ..operators.corpus import by_directory, detect_language, key_files, tech_stack
from ..operators.infer import Client
from ..operators.scale import lookup_join, ordinal, running_start
from ..session import materialize
from .explain import RunConfig, answer_with_cache, explain_corpus

#: Estimated tokens that the listing of one prompt may have.
TOKENS_PER_PROMPT = 100_000


def overview_rows(files: DataFrame) -> DataFrame:
    """What the overview needs of each file, without its text: purpose, and a preview of key files."""
    path, body = F.col("relative_path"), F.col("content")
    return files.select(
        "project", "file_id", "relative_path", "language", classify.purpose(path, body).alias("purpose"),
        F.when(paths.is_key_file(path), text.preview(body)).alias("preview"),
    )


def attach_summaries(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Add ``summary`` by relative path: the first summary of a path, else the purpose sentence."""
    first = summaries.groupBy("project", "relative_path").agg(F.min_by("summary", "file_id").alias("_found"))
    joined = lookup_join(rows, first, ["project", "relative_path"], "file_id")
    return joined.withColumn("summary", F.coalesce(F.nullif("_found", F.lit("")), "purpose")).drop("_found")


def listing_line(file_name: Column) -> Column:
    return F.concat(F.lit("- **"), file_name, F.lit("** ("), "language", F.lit("): "), "summary", F.lit("\n"))


def codebase_summary(files: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """The summary document of each project as ordered pieces of text.

    ``files`` holds ``overview_rows`` with their ``summary``. Joining the pieces in
    (section, i, j, k) order gives the document; no piece grows with the project. Stack and
    key files are taken from the rows of ``about`` where the listing is one of parts.
    """
    about = files if about is None else about

    def piece(section: int, i, j, k, value: Column) -> Column:
        keys = [(F.lit(v) if isinstance(v, int) else v).cast("long").alias(n) for n, v in (("i", i), ("j", j), ("k", k))]
        return F.struct(F.lit(section).alias("section"), *keys, value.alias("piece"))

    def pieces(df: DataFrame, *found: Column) -> DataFrame:
        return df.select("project", F.inline(F.array(*found)))

    # narrow rows, kept because directories and lines are both made from them
    listing = materialize(by_directory(files, "language", "summary"))
    dirs = listing.groupBy("project", "dir").agg(F.min("dir_first").alias("dir_first"))
    first = F.col("dir_first")
    is_language = F.col("kind") == "language"
    stack_title = F.when(is_language, "- **Languages**: ").otherwise("- **File Types**: ")
    source = F.concat(
        F.lit("### "), "relative_path", F.lit("\n\n```"), "language", F.lit("\n"), F.col("preview"), F.lit("\n```\n\n")
    )
    parts = [
        pieces(
            files.select("project").distinct(),
            piece(0, 0, 0, 0, F.lit("# Codebase Summary\n\n## Project Structure\n\n")),
            piece(2, 0, 0, 0, F.lit("## Technology Stack\n\n")),
            piece(2, 2, 0, 0, F.lit("\n")),
            piece(2, 4, 0, 0, F.lit("\n\n")),
            piece(3, 0, 0, 0, F.lit("## Key Files Content\n\n")),
        ),
        pieces(dirs, piece(1, first, 0, 0, F.concat(F.lit("### "), "dir", F.lit("\n\n"))), piece(1, first, 2, 0, F.lit("\n"))),
        pieces(listing, piece(1, first, 1, F.col("file_id"), listing_line(F.col("file_name")))),
        pieces(
            tech_stack(about),
            piece(2, F.when(is_language, 1).otherwise(3), F.col("ord"), 0, F.concat(F.when(F.col("ord") == 0, stack_title).otherwise(", "), "value")),
        ),
        pieces(key_files(about), piece(3, 1, F.col("rank"), 0, source)),
    ]
    return reduce(DataFrame.unionByName, parts)


def whole_documents(pieces: DataFrame) -> DataFrame:
    """One text per project. Only for projects whose listing fits a prompt."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "i", "j", "k", "piece")))
    return pieces.groupBy("project").agg(ordered.alias("_p")).select("project", F.array_join("_p.piece", "").alias("codebase_summary"))


def project_answers(
    files: DataFrame, cache: DataFrame, templates: DataFrame, client_factory: Callable[[], Client], config: RunConfig, about: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """One answer per project from files that carry their summaries; each project fits one prompt.

    Answers are cached by project and mode, and hold as long as the summary document is
    the same to the byte.
    """
    mode = MODE_ALIASES.get(config.mode, config.mode)
    label, slug = PROJECT_MODES[mode]
    body = F.col("codebase_summary")
    documents = materialize(whole_documents(codebase_summary(files, about))).select(
        "project", F.xxhash64("project").alias("file_id"), F.lit(label).alias("relative_path"), F.lit(mode).alias("language"), "codebase_summary",
        F.octet_length(body).cast("long").alias("file_size"), F.lit(None).cast("long").alias("mtime_ms"), F.sha2(body, 256).alias("file_hash"),
    )
    keyed = with_cache_key(documents, F.concat("project", F.lit("/" + slug)), config.key_parts())
    return answer_with_cache(keyed, cache, templates, client_factory, config)


def prompt_sizes(rows: DataFrame, tokens_per_prompt: int) -> DataFrame:
    """(project, file_id, fits, part): whether a project's listing fits one prompt, else the part each row goes to.

    Parts are runs of rows of about ``tokens_per_prompt`` tokens, two rows at least, so that
    every round has at most half as many rows as the one before. Kept as a table.
    """
    tokens = estimate_tokens(listing_line(paths.basename(F.col("relative_path"))))
    sized = running_start(rows.select("project", "file_id", tokens.alias("_tokens")), ["project"], "file_id", F.col("_tokens"))
    sized = sized.select("project", "file_id", F.col("_start").alias("_from"), F.col("_total").alias("_sum"))
    numbered = ordinal(sized, ["project"], "file_id", total="_rows")
    fits = (F.col("_sum") <= tokens_per_prompt) | (F.col("_rows") == 1)
    part = F.least(F.floor(F.col("_from") / tokens_per_prompt), F.floor(F.col("ord") / 2)).cast("long")
    return materialize(numbered.select("project", "file_id", fits.alias("fits"), part.alias("part")))


def summarize_projects(
    files: DataFrame,
    templates: DataFrame,
    client_factory: Callable[[], Client],
    config: RunConfig = RunConfig(mode="architecture"),
    tokens_per_prompt: int = TOKENS_PER_PROMPT,
    cache: DataFrame | None = None,
    key_path: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Summarise files, then projects: one answer per project, and the cache rows to upsert.

    A project whose listing of files has up to ``tokens_per_prompt`` estimated tokens is
    described from one prompt, whatever else is in the run. A larger one is described in
    parts first, and the parts' answers take the place of the file summaries in the next
    round; its stack and key files always come from its files. ``rounds`` says how many
    rounds a project took. When parts fail, the project gets an error row that counts them
    in ``failed_parts``. The number of rounds grows with the logarithm of the largest project.
    """
    spark = files.sparkSession
    cache = spark.createDataFrame([], CACHE_SCHEMA) if cache is None else cache
    if "mtime_ms" not in files.columns:
        # without times the cache goes by size and content
        files = files.withColumn("file_size", F.octet_length("content").cast("long")).withColumn("mtime_ms", F.lit(None).cast("long"))
    answers, fresh = explain_corpus(files, cache, templates, client_factory, replace(config, mode="summary"), key_path)
    summaries = answers.select("project", "relative_path", "file_id", F.col("explanation").alias("summary"))
    original = materialize(attach_summaries(overview_rows(detect_language(files)), summaries))
    mode = MODE_ALIASES.get(config.mode, config.mode)
    current, described, rounds = original, None, 1
    while True:
        sizes = prompt_sizes(current, tokens_per_prompt)
        ready = sizes.filter("fits").select("project", "file_id")
        rows = current.join(ready, ["project", "file_id"], "left_semi")
        about = original.join(ready.select("project").distinct(), "project", "left_semi") if rounds > 1 else None
        done, more = project_answers(rows, cache, templates, client_factory, config, about)
        done = done.withColumn("rounds", F.lit(rounds)).withColumn("failed_parts", F.lit(0).cast("long"))
        described = done if described is None else described.unionByName(done, allowMissingColumns=True)
        fresh = fresh.unionByName(more, allowMissingColumns=True)
        large = sizes.filter("not fits")
        if large.isEmpty():
            return described, fresh
        part = F.concat(F.lit("part "), F.col("part").cast("string"))
        named = materialize(large.select("project", "file_id", "part", F.concat("project", F.lit("/"), part).alias("_name")))
        parts = current.join(named, ["project", "file_id"]).withColumn("project", F.col("_name"))
        partial, more = project_answers(parts, cache, templates, client_factory, config)
        fresh = fresh.unionByName(more, allowMissingColumns=True)
        answered = partial.select(F.col("project").alias("_name"), "language", "error", F.col("explanation").alias("summary"))
        found = materialize(named.select("project", "part", "_name").distinct().join(answered, "_name"))
        counts = found.groupBy("project").agg(F.count_if(F.col("error").isNotNull()).alias("failed_parts"), F.count("*").alias("_parts"))
        failed = materialize(counts.filter("failed_parts > 0"))
        reason = F.concat(F.col("failed_parts").cast("string"), F.lit(" of "), F.col("_parts").cast("string"), F.lit(" parts failed"))
        errors = failed.select(
            "project", F.xxhash64("project").alias("file_id"), F.lit(PROJECT_MODES[mode][0]).alias("relative_path"), F.lit(mode).alias("language"),
            F.concat(F.lit(PROJECT_ERROR_PREFIX.format(mode=config.mode)), reason).alias("explanation"), reason.alias("error"),
            F.lit(False).alias("cached"), F.lit(rounds).alias("rounds"), "failed_parts",
        )
        described = described.unionByName(errors, allowMissingColumns=True)
        current = materialize(
            found.join(failed.select("project"), "project", "left_anti").select(
                "project", F.col("part").alias("file_id"), part.alias("relative_path"), "language",
                F.lit(None).cast("string").alias("purpose"), F.lit(None).cast("string").alias("preview"), "summary",
            )
        )
        rounds += 1
