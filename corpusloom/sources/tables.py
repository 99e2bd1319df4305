"""Table corpora: any table read as files, and the code corpus derived from ``documents``."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_spread(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table for costly per-row work, dealt out by key to all shuffle partitions.

    For tables written as few large row groups, which a scan cannot split. It is the same
    plan at every size and shuffles the table once; read a table of many row groups with
    ``read_table``, whose scan is split by ``spark.sql.files.maxPartitionBytes``.
    """
    return read_table(spark, folder, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def as_corpus(df: DataFrame, key: str | Column, path: str | Column, text: str | Column, project: str | Column) -> DataFrame:
    """Any table as files: (file_id, project, relative_path, content)."""

    def col(value: str | Column) -> Column:
        return F.col(value) if isinstance(value, str) else value

    return df.select(
        col(key).cast("long").alias("file_id"),
        F.coalesce(col(project).cast("string"), F.lit("")).alias("project"),
        col(path).cast("string").alias("relative_path"),
        col(text).cast("string").alias("content"),
    )


# The derived corpus must equal its SQL twin in the oracle.
STEMS = "userController,authService,orderModel,appConfig,stringUtils,main,apiTest,parser,index,httpClient"
EXTS = ".js,.ts,.py,.java,.go,.rs,.md,.log"
DIRS = "src,src/core,node_modules/pkg,src/web,docs"


def code_corpus(documents: DataFrame) -> DataFrame:
    """A code corpus made from the whole ``documents`` table, one file per document.

    Each text gets a path and a code head of one of eight languages, so that every
    extraction rule has something to find in every project.
    """
    d = documents.selectExpr("doc_id", "source", "text", "CAST(floor(doc_id / 20) AS BIGINT) AS k").selectExpr(
        "doc_id",
        "source",
        "text",
        f"split_part('{STEMS}', ',', CAST(k % 10 AS INT) + 1) || '_' || CAST(CAST(floor(k / 10) AS BIGINT) % 5 AS STRING) AS stem",
        f"split_part('{STEMS}', ',', CAST((k * 7 + 3) % 10 AS INT) + 1) || '_' || CAST(k % 2 AS STRING) AS dep",
        f"split_part('{EXTS}', ',', CAST((k + CAST(floor(k / 8) AS BIGINT)) % 8 AS INT) + 1) AS ext",
        f"split_part('{DIRS}', ',', CAST((k * 3 + CAST(floor(k / 5) AS BIGINT)) % 5 AS INT) + 1) AS dir",
    )

    def lines(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    dep, stem = F.col("dep"), F.col("stem")
    head = (
        F.when(
            F.col("ext") == ".js",
            lines(
                "import helper from '", dep, "';\nconst db = require('mysql/promise');\nfunction getItem",
                (F.col("doc_id") % 4).cast("string"), '(a) {\n  return fetch("https://api.example.com/v1");\n}\n',
            ),
        )
        .when(
            F.col("ext") == ".ts",
            "import { x } from '@scope/kit';\nconst saveAll = (a) => a;\nclass Box {\n  handleEvent(e) {\n  }\n}\n",
        )
        .when(
            F.col("ext") == ".py",
            lines(
                "from ", dep, " import run\nimport os\ndef validate_row(r):\n"
                '    return connect("host=db01.example.org;password=hunter2")\nif __name__ == "__main__":\n    main()\n',
            ),
        )
        .when(
            F.col("ext") == ".java",
            "import java.util.List;\npublic class Box { public static void main(String[] a) { formatAll(a); } }\n",
        )
        .when(F.col("ext") == ".go", 'import "fmt"\nfunc main() { }\nfunc CheckSum(a int) int { return a }\n')
        .when(F.col("ext") == ".rs", "use serde;\nfn convert_all(a: i32) { }\n")
        .when(
            F.col("ext") == ".md",
            lines(
                "```mermaid\nflowchart TD\n  A --> B\n```\n<table><tr><td>", stem,
                "</td></tr></table>\n```markdown\n# ", dep, "\n```\n",
            ),
        )
        .otherwise("")
    )
    return as_corpus(d, "doc_id", F.concat_ws("/", "dir", F.concat("stem", "ext")), F.concat(head, "text"), "source")
