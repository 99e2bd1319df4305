"""Progress of running streams: what every batch has observed, kept as a table."""

import json
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.cache_store import Folder

NAME = "corpusloom_progress"
PROGRESS = "query_id string, run_id string, batch long, at timestamp, rows_per_second double, completed long, failed long, cached long"


def observed(stream: DataFrame) -> DataFrame:
    """A stream whose batches count their rows, failures and cached answers on the way."""
    failed = F.count_if(F.col("error").isNotNull()) if "error" in stream.columns else F.sum(F.lit(0))
    cached = F.count_if(F.col("cached")) if "cached" in stream.columns else F.sum(F.lit(0))
    return stream.observe(NAME, F.count("*").alias("completed"), failed.alias("failed"), cached.alias("cached"))


class ProgressTable(StreamingQueryListener):
    """Writes one small file for every batch of observed streams below ``path``; ``read_progress`` is the table.

    A batch that is run again writes its file again. Register it with ``spark.streams.addListener``;
    ``finished`` tells when a query's last batch is in.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)
        self.ended: dict[str, Event] = {}

    def finished(self, query: StreamingQuery, seconds: float = 60.0) -> bool:
        """Wait until everything that a stopped query has reported is written."""
        return self.ended.setdefault(str(query.runId), Event()).wait(seconds)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        counts = progress.observedMetrics.get(NAME)
        if counts is not None and counts["completed"]:
            row = {
                "query_id": str(progress.id), "run_id": str(progress.runId), "batch": progress.batchId, "at": progress.timestamp,
                "rows_per_second": progress.processedRowsPerSecond, **{c: counts[c] or 0 for c in ("completed", "failed", "cached")},
            }
            name = f"{progress.id}-{progress.batchId:09d}.json"
            self.folder.delete(name)
            self.folder.create(name, json.dumps(row))

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event()).set()


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row for every batch that has had rows."""
    return spark.read.schema(PROGRESS).json(path) if Folder(spark, path).names() else spark.createDataFrame([], PROGRESS)
