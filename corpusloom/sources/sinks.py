"""Report and result sinks, one folder per project.

A write replaces the folders of the projects that it holds and leaves all others. Files are staged beside them and
moved when the job is done, so a write that fails changes nothing.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import short_batches
from .storage import write_bytes


def write_ordered_text(lines: DataFrame, path: str, order: list[str], column: str, partitions: int | None = None) -> None:
    """Write text lines per project in order.

    Rows are range-partitioned by (project, order): a large project is spread over many
    tasks, whose part files, read in name order, give its lines in order.
    """
    keys = ["project", *order]
    ranged = lines.repartitionByRange(partitions, *keys) if partitions else lines.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).select("project", F.col(column).alias("value")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("project").text(path)


def write_report(sections: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write ``report_sections`` rows: header, one section per file in order, footer."""
    write_ordered_text(sections, path, ["section", "ord"], "html", partitions)


def write_sorted_report(lines: DataFrame, path: str) -> None:
    """Write ``report_lines``, which lie in order already: every task writes its range, file names give the order."""
    written = lines.select("project", F.col("html").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    written.partitionBy("project").text(path)


def write_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the result table, one folder per project, large projects in many files.

    Rows are range-partitioned by project first, so a task writes few projects, not one file for each.
    """
    keys = ["project", *(["file_id"] if "file_id" in results.columns else [])]
    placed = results.repartitionByRange(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    placed.partitionBy("project").format(fmt).save(path)


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row's ``content`` as the file ``relative_path`` below a shared folder; the number of files.

    Tasks write their own rows; a task that runs again writes the same files again. A path that
    leaves the folder (``..``) is an error.
    """

    def run(batches):
        for rows in batches:
            for path, content in zip(rows["relative_path"], rows["content"], strict=True):
                if ".." in path.split("/"):
                    raise ValueError(f"{path} leaves the folder")
                write_bytes(f"{folder}/{path}", (content or "").encode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"written": [len(rows)]})

    short_batches(files.sparkSession)
    written = files.select("relative_path", "content").mapInPandas(run, "written long")
    return written.agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]
