"""Report rows: what the report of a project is made of, in order."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.fixed import SOURCE_SHOWN_MODES
from .blocks import unwrap_markdown, wrap_diagrams
from .scale import numbered_once, ordinal


def section_html(index: Column, path: Column, language: Column, body: Column, source: Column | None) -> Column:
    """One file's section: anchor, escaped title, language badge, source when shown, body."""
    parts = [
        F.lit('<section id="file-'), index.cast("string"), F.lit('" data-path="'), text.escape_html(path), F.lit('"><h2>'),
        text.escape_html(path), F.lit('</h2><span class="badge">'), F.coalesce(F.nullif(language, F.lit("")), F.lit("text")), F.lit("</span>"),
    ]
    if source is not None:
        parts += [F.lit("<pre><code>"), text.escape_html(source), F.lit("</code></pre>")]
    return F.concat(*parts, F.lit('<div class="explanation">'), text.coalesce_body(body), F.lit("</div></section>"))


def frame_html(project: Column) -> tuple[Column, Column]:
    """Header and footer of a project's report."""
    title = text.escape_html(project)
    return F.concat(F.lit("<!DOCTYPE html><html><head><title>"), title, F.lit("</title></head><body>")), F.lit("</body></html>")


def report_sections(results: DataFrame, mode: str = "explain") -> DataFrame:
    """(project, section, ord, html): header (0), one section per file (1), footer (2).

    ``results`` needs (project, file_id, relative_path, language, explanation) and, for the
    modes that show the source, ``content``. Diagram blocks in an explanation become
    containers, fenced markdown its body.
    """
    shows_source = mode in SOURCE_SHOWN_MODES
    numbered = ordinal(results.select("project", "file_id"), ["project"], "file_id", out="ord")
    bodies = results.select("project", "file_id", "relative_path", "language", "explanation", *(["content"] if shows_source else []))
    bodies = unwrap_markdown(wrap_diagrams(bodies, "explanation", "explanation"), "explanation", "explanation")
    path = F.col("relative_path")
    files = numbered.join(bodies, ["project", "file_id"]).select(
        "project", F.lit(1).alias("section"), "ord",
        section_html(F.col("ord"), path, F.col("language"), F.col("explanation"), F.col("content") if shows_source else None).alias("html"),
    )
    header, footer = frame_html(F.col("project"))
    ends = F.array(*[F.struct(F.lit(n).alias("section"), html.alias("html")) for n, html in ((0, header), (2, footer))])
    frame = results.select("project").distinct().select("project", F.inline(ends))
    return frame.select("project", "section", F.lit(0).cast("long").alias("ord"), "html").unionByName(files)


def report_lines(results: DataFrame, mode: str = "explain") -> DataFrame:
    """(project, ord, html) in the order of the report, header and footer inside the first and last section of each project.

    The same text as ``report_sections``, for a report that is written at once: texts are moved once, to the task that writes them.
    """
    shows_source = mode in SOURCE_SHOWN_MODES
    wide = results.select("project", "file_id", "relative_path", "language", "explanation", *(["content"] if shows_source else []))
    numbered = numbered_once(wide, "project", "file_id", results)
    numbered = unwrap_markdown(wrap_diagrams(numbered, "explanation", "explanation"), "explanation", "explanation")
    body = section_html(F.col("ord"), F.col("relative_path"), F.col("language"), F.col("explanation"), F.col("content") if shows_source else None)
    header, footer = frame_html(F.col("project"))
    whole = F.concat(F.when(F.col("ord") == 0, F.concat(header, F.lit("\n"))).otherwise(""), body, F.when(F.col("is_last"), F.concat(F.lit("\n"), footer)).otherwise(""))
    return numbered.select("project", "ord", whole.alias("html"))


def labels(results: DataFrame, title: Column, prefix: str) -> DataFrame:
    """Report titles cut to the file names of the paths they list."""
    return results.withColumn("label", paths.path_labels(title, prefix))
