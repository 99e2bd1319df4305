"""Inputs of the registered queries, all derived from the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import detect_language
from ..operators.prompts import default_templates
from ..plans.explain import RunConfig
from ..sources.cache_store import Folder
from ..sources.tables import as_corpus, code_corpus, read_spread, read_table

USER_TEMPLATE = "Tell {{levelDescription}} about {{language}} file {{filePath}}.\n{{codeContent}}\n$& {{other}}"
ENTRY_LIKE_NAMES = ["index", "Main", "app", "program", "start", "run", "init", "bootstrap", "main.js", "APP.py", "index.html", "mainframe.js", "my_app.py", "x.js"]
IGNORE_RULES = ["node_modules/", "docs/*", "!docs/index_0*"]
TOP_IGNORES, PROJECT_IGNORES, FILE_IGNORES = "core/\n*.py\n", "!core/\n/*0/\n", "*.js\n!src/*.py\ndocs/\n!docs/*.rs\n"
CONFIG = RunConfig(attempts=0, delay=0.0)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code corpus, for queries that only need paths or light work."""
    return code_corpus(read_table(spark, sf_dir, "documents"))


def spread_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code corpus, for queries that search the texts."""
    return code_corpus(read_spread(spark, sf_dir, "documents", "doc_id"))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_language(files(spark, sf_dir))


def page_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: one project per host, the address as path."""
    pages = read_spread(spark, sf_dir, "pages", "page_id")
    return as_corpus(pages, "page_id", "url", "html", F.regexp_extract("url", "//([^/:?#]+)", 1))


def file_side(df: DataFrame) -> DataFrame:
    """Current size and time of every file, and the path its cache key is made from."""
    return df.select(
        "*",
        F.octet_length("content").cast("long").alias("file_size"),
        (F.lit(1704067200000) + F.col("file_id") * 1000).alias("mtime_ms"),
        F.concat_ws("/", "project", F.col("file_id").cast("string"), "relative_path").alias("key_path"),
    )


def cache_seed(df: DataFrame) -> DataFrame:
    """Earlier answers: by ``file_id % 4`` unchanged, touched, changed, or never seen."""
    kind = F.col("file_id") % 4
    side = file_side(df.select("file_id", "project", "relative_path", "content")).filter(kind != 3)
    return side.select(
        F.md5(F.concat("key_path", F.lit("-explain-beginner-stub-stub-1"))).alias("cache_key"),
        F.when(kind == 2, F.sha2(F.concat(F.lit("stale"), "content"), 256)).otherwise(F.sha2("content", 256)).alias("file_hash"),
        "file_size",
        (F.col("mtime_ms") + F.when(kind == 0, 0).otherwise(60000)).alias("mtime_ms"),
        F.concat(F.lit("cached answer "), F.col("file_id").cast("string")).alias("explanation"),
    )


def lot_size(spark: SparkSession, folder: str, least: int = 1, lots: int = 4) -> int:
    """Files that arrive together, at least ``least``, when all files of a folder come in ``lots`` lots at most, however many tasks have written them."""
    return max(least, -(-sum(name.endswith(".parquet") for name in Folder(spark, folder).names()) // lots))


def templates(spark: SparkSession) -> DataFrame:
    user = spark.range(1).select(F.lit("user").alias("layer"), F.lit("explain").alias("mode"), F.lit(USER_TEMPLATE).alias("template"))
    return default_templates(spark).unionByName(user)


def stub_client():
    """A client whose answers are a formula, and which fails for every fiftieth document."""

    def call(row: dict) -> str:
        if 0 <= row["file_id"] < 10**12 and row["file_id"] % 50 == 7:
            raise ValueError(f"no answer for {row['file_id']}")
        return f"summary of {row['relative_path']} ({row['input_tokens']} tokens)"

    return call
