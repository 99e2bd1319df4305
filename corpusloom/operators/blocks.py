"""Blocks inside text: fenced diagrams, fenced markdown, HTML tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dialect import java
from ..functions.fixed import DIAGRAM_BLOCK, HTML_TABLE, MARKDOWN_BLOCK
from .extract import all_matches

TABLE_MARK = ("___TABLE_", "_PLACEHOLDER___")


def _bodies(value: Column, pattern: str) -> Column:
    return F.transform(all_matches(value, pattern, 1), text.strip)


def _rewritten(value: Column, pattern: str, replace: Callable[[Column, Column], Column]) -> Column:
    """Each block replaced by ``replace(body, index)``; a block with an empty body stays."""
    fillers = F.zip_with(
        all_matches(value, pattern),
        F.transform(_bodies(value, pattern), lambda body, i: F.struct(body.alias("body"), replace(body, i).alias("text"))),
        lambda whole, block: F.when(block["body"] == "", whole).otherwise(block["text"]),
    )
    return text.join_pieces(F.split(value, java(pattern), -1), fillers)


def _block_rows(files: DataFrame, pattern: str, column: str, out: str) -> DataFrame:
    rows = files.select("project", "file_id", F.posexplode(_bodies(F.col(column), pattern)).alias("pos", out))
    return rows.filter(F.col(out) != "")


def _diagram_id(key: Column, pos: Column) -> Column:
    return F.concat(F.lit("mermaid-diagram-"), text.unique_id(F.concat_ws("-", key.cast("string"), pos.cast("string"))))


def extract_diagrams(files: DataFrame, column: str = "content") -> DataFrame:
    """One row per diagram block: body, id, whether it names a known diagram kind."""
    return _block_rows(files, DIAGRAM_BLOCK, column, "code").select(
        "project", "file_id", "pos", text.unix_newlines(F.col("code")).alias("code"),
        _diagram_id(F.col("file_id"), F.col("pos")).alias("diagram_id"), text.is_valid_diagram(F.col("code")).alias("is_valid"),
    )


def wrap_diagrams(files: DataFrame, column: str = "content", out: str = "wrapped") -> DataFrame:
    """The text with every diagram block put into a container element."""

    def container(body: Column, i: Column) -> Column:
        return F.concat(
            F.lit('<div class="mermaid" id="'), _diagram_id(F.col("file_id"), i), F.lit('">'), body, F.lit("</div>")
        )

    return files.withColumn(out, _rewritten(F.col(column), DIAGRAM_BLOCK, container))


def extract_markdown_blocks(files: DataFrame, column: str = "content") -> DataFrame:
    return _block_rows(files, MARKDOWN_BLOCK, column, "body")


def unwrap_markdown(files: DataFrame, column: str = "content", out: str = "unwrapped") -> DataFrame:
    """The text with every fenced markdown block replaced by its body."""
    return files.withColumn(out, _rewritten(F.col(column), MARKDOWN_BLOCK, lambda body, _: body))


def extract_tables(files: DataFrame, column: str = "content") -> DataFrame:
    """Add ``tables`` (in order) and ``without_tables``, the text with numbered placeholders."""
    value = F.col(column)
    marks = F.transform(
        all_matches(value, HTML_TABLE), lambda _, i: F.concat(F.lit(TABLE_MARK[0]), i.cast("string"), F.lit(TABLE_MARK[1]))
    )
    return files.withColumn("tables", all_matches(value, HTML_TABLE)).withColumn(
        "without_tables", text.join_pieces(F.split(value, java(HTML_TABLE), -1), marks)
    )


def restore_tables(files: DataFrame, column: str = "without_tables", tables: str = "tables", out: str = "restored") -> DataFrame:
    """Put the tables back at their placeholders, by the number each placeholder carries."""
    mark = TABLE_MARK[0] + "([0-9]+)" + TABLE_MARK[1]
    value, held = F.col(column), F.col(tables)
    numbers = F.transform(F.regexp_extract_all(value, F.lit(mark), F.lit(1)), lambda n: n.cast("int"))
    found = F.zip_with(
        numbers, F.regexp_extract_all(value, F.lit(mark), F.lit(0)), lambda n, whole: F.coalesce(F.get(held, n), whole)
    )
    return files.withColumn(out, text.join_pieces(F.split(value, mark, -1), found))
