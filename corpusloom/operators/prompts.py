"""Prompts for every file or project: template choice and rendering."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompting

# Own wording; the placeholders are fixed.
DEFAULT_TEMPLATES = {
    "explain": "Explain this {{language}} file to {{levelDescription}}.\n\nFile: {{filePath}}\n\n{{codeContent}}\n\nUse headings and fenced code.",
    "issues": "List bugs, risks and bad habits in this {{language}} file for {{levelDescription}}.\n\nFile: {{filePath}}\n\n{{codeContent}}",
    "linebyline": "Go through this {{language}} file line by line for {{levelDescription}}.\n\nFile: {{filePath}}\n\n{{codeContent}}",
    "summary": "Say in at most 100 words what this {{language}} file does.\n\nFile: {{filePath}}\n\n{{codeContent}}",
    "architecture": "Describe the architecture of this project to {{levelDescription}}.\n\n{{codebaseSummary}}",
    "onboarding": "Write a guide for developers who join this project.\n\n{{codebaseSummary}}",
}
FALLBACK_TEMPLATE = "Explain this {{language}} file.\n\nFile: {{filePath}}\n\n{{codeContent}}\n\nAnswer in markdown."
MAX_TEMPLATES = 100
MAX_TEMPLATE_CHARS = 1_000_000


def default_templates(spark: SparkSession) -> DataFrame:
    """(layer, mode, template) rows of the built-in templates."""
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(t).alias("template")) for m, t in DEFAULT_TEMPLATES.items()])
    return spark.range(1).select(F.lit("default").alias("layer"), F.inline(rows))


def choose_templates(templates: DataFrame) -> DataFrame:
    """One template per mode: the user's over the default."""
    priority = F.when(F.col("layer") == "user", 2).otherwise(1)
    return templates.groupBy("mode").agg(F.max_by("template", priority).alias("template"))


def pick_template(rows: DataFrame, templates: DataFrame, mode: str = "mode") -> DataFrame:
    """Add ``template`` to rows with a mode column: user, else default, else the fallback.

    All rows may have the same mode, which would make one task of a shuffled join, so the
    templates become a constant of the plan. There is one per mode; more than
    ``MAX_TEMPLATES`` modes or ``MAX_TEMPLATE_CHARS`` characters are an error.
    """
    chosen = choose_templates(templates)
    resolved = prompting.resolve_mode(F.col(mode))
    few = chosen.select("mode", F.left("template", F.lit(MAX_TEMPLATE_CHARS + 1)).alias("template")).limit(MAX_TEMPLATES + 1).collect()
    if len(few) > MAX_TEMPLATES or sum(len(row["template"] or "") for row in few) > MAX_TEMPLATE_CHARS:
        raise ValueError(f"more than {MAX_TEMPLATES} templates or {MAX_TEMPLATE_CHARS} characters of templates")
    known = F.create_map(*[F.lit(value) for row in few for value in (row["mode"], row["template"])]) if few else None
    found = rows.withColumn("template", F.lit(None).cast("string") if known is None else F.try_element_at(known, resolved))
    return found.withColumn("template", F.coalesce("template", F.lit(FALLBACK_TEMPLATE)))


def build_prompts(rows: DataFrame, templates: DataFrame, level: Column | None = None, path: str = "relative_path") -> DataFrame:
    """Add ``prompt`` and its ``input_tokens``.

    Rows need ``mode`` and what its template asks for: ``language`` and ``content`` for
    files, ``codebase_summary`` for projects.
    """
    have = set(rows.columns)
    variables = {"levelDescription": prompting.level_phrase(F.lit("beginner") if level is None else level)}
    columns = {"language": "language", "filePath": path, "codeContent": "content", "codebaseSummary": "codebase_summary"}
    variables |= {name: F.col(column) for name, column in columns.items() if column in have}
    rendered = pick_template(rows, templates).withColumn("prompt", prompting.with_suffix(prompting.render(F.col("template"), variables)))
    return rendered.withColumn("input_tokens", prompting.estimate_tokens(F.col("prompt"))).drop("template")


def usage_summary(results: DataFrame, *group: str) -> DataFrame:
    """Token totals and counts of answered rows, over everything or per group."""
    done = ~F.col("cached")
    return results.groupBy(*group).agg(
        F.coalesce(F.sum(F.when(done, F.col("input_tokens"))), F.lit(0)).cast("long").alias("total_input_tokens"),
        F.coalesce(F.sum(F.when(done, F.col("output_tokens"))), F.lit(0)).cast("long").alias("total_output_tokens"),
        F.coalesce(F.sum(F.when(done & F.col("error").isNull(), F.col("input_tokens") + F.col("output_tokens"))), F.lit(0)).cast("long").alias("total_tokens"),
        F.count_if("cached").alias("cached_files"),
        F.count_if(done).alias("processed_files"),
    )
