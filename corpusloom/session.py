"""Session settings and the shared folder that cuts lineage."""

import atexit
import re
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, cores: int | None = None, app: str = "corpusloom") -> SparkSession:
    """A session with the settings the jobs expect; on a cluster the submitter's values stay."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # rows sent to Python carry whole prompts
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.shuffle.partitions", str(cores or 8))
        )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows and bytes of the batches that carry whole texts to Python.
BATCH_ROWS, BATCH_BYTES = 512, 4 * 1024 * 1024


def short_batches(spark: SparkSession) -> None:
    """Keep the batches that carry texts to Python small, so that a worker's memory does not follow the rows of its partition; smaller settings stay."""
    units = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        setting = f"spark.sql.execution.arrow.max{name}PerBatch"
        found = re.fullmatch(r"(\d+)([bkmg]?)b?", (spark.conf.get(setting, None) or "").lower())
        if found is None or not 0 < int(found[1]) << units[found[2]] <= most:
            spark.conf.set(setting, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode without one, a scratch folder of this process."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        scratch = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, scratch, ignore_errors=True)
        context.setCheckpointDir(scratch)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from the result, kept as a parquet table in the shared folder.

    Later steps read only the columns they use, know how large it is, and lose nothing with
    an executor. The tables belong to the run; clear the folder as checkpoints are cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
