"""Prompt templates kept as one markdown file per mode."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .files import list_files, with_content


def load_templates(spark: SparkSession, default_dir: str, user_dir: str | None = None) -> DataFrame:
    """(layer, mode, template) from the ``<mode>.md`` files of a folder, listed and read by tasks; the user's layer beside the default."""

    def layer(folder: str, name: str) -> DataFrame:
        named = F.col("relative_path").rlike(r"(?s)\A[^_].*\.md\z") & (F.col("length") > 0)  # an empty file is no template
        listed = list_files(spark, [folder], named, ["*/"], ignore_files=False)
        return with_content(listed).select(F.lit(name).alias("layer"), paths.stem(F.col("path")).alias("mode"), F.col("content").cast("string").alias("template"))

    templates = layer(default_dir, "default")
    return templates.unionByName(layer(user_dir, "user")) if user_dir else templates
