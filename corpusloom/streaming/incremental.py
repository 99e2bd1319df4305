"""Incremental runs: new and changed files as a stream, against the versioned answer cache."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.cache import CACHE_SCHEMA, full_path, with_cache_key
from ..operators.infer import Client
from ..plans.explain import RunConfig, explain_corpus
from ..session import materialize
from ..sources.cache_store import CacheStore, KeyedStore

SEEN = "file_size long, mtime_ms long, file_hash string"
#: Groups of keys in the state of a stream; a checkpoint holds on to their number.
BUCKETS = 4096
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema: str | StructType, max_files: int | None = None) -> DataFrame:
    """Parquet files of corpus rows as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


class LastSeen(StatefulProcessor):
    """Size, time and hash of every file, kept by its cache key; says which rows may have an answer already.

    Files come in groups, a bucket of keys each, so the cost of a call into Python is shared by many files; a
    group's state is a map that is read and written only at the keys that arrive. All rows of a key in one batch are judged
    by what the batches before have left.
    """

    def __init__(self, columns: list[str], expiry_ms: int | None):
        self.columns, self.expiry_ms = columns, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "cache_key string", SEEN, self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, newest = {}, {}
        for batch in rows:
            status = []
            for name, size, mtime_ms, file_hash in zip(*(batch[c] for c in ("cache_key", "file_size", "mtime_ms", "file_hash")), strict=True):
                if name not in known:
                    known[name] = self.seen.getValue((name,))
                status.append(_status(known[name], size, mtime_ms, file_hash))
                file = (mtime_ms, size, file_hash)
                newest[name] = max(newest.get(name, file), file)
            yield batch[self.columns].assign(seen_status=status)
        for name, (mtime_ms, size, file_hash) in newest.items():
            self.seen.updateValue((name,), (int(size), int(mtime_ms), file_hash))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for name, size, mtime_ms, file_hash in zip(*(initialState[c] for c in ("cache_key", "file_size", "mtime_ms", "file_hash")), strict=True):
            self.seen.updateValue((name,), (int(size), int(mtime_ms), file_hash))

    def close(self) -> None:
        pass


def _status(known, size, mtime_ms, file_hash) -> str:
    if known is None or known[0] != size:
        return "miss"
    return "hit" if known[1] == mtime_ms else "refresh" if known[2] == file_hash else "miss"


def with_seen_status(keyed: DataFrame, before: DataFrame | None = None, expiry_ms: int | None = None) -> DataFrame:
    """A stream of files with ``seen_status``, from state that is kept by ``cache_key``, in ``BUCKETS`` groups.

    ``keyed`` needs (cache_key, file_size, mtime_ms, file_hash), none of them NULL. ``before``, rows with the
    same columns and one for a key, is the state that a new checkpoint starts from. State that was not renewed for
    ``expiry_ms`` is dropped; its files then count as new.
    """
    schema = StructType([*keyed.schema.fields]).add("seen_status", "string")
    bucket = F.pmod(F.xxhash64("cache_key"), F.lit(BUCKETS)).cast("int").alias("_bucket")
    first = None if before is None else before.select(bucket, "cache_key", *[f.split()[0] for f in SEEN.split(", ")]).groupBy("_bucket")
    return keyed.select("*", bucket).groupBy("_bucket").transformWithStateInPandas(
        LastSeen(keyed.columns, expiry_ms), schema, "append", "none" if expiry_ms is None else "processingTime", first
    )


def explain_stream(
    stream: DataFrame,
    store: CacheStore,
    out: str,
    checkpoint: str,
    templates: DataFrame,
    client_factory: Callable[[], Client],
    config: RunConfig = RunConfig(),
    key_path: Column | None = None,
    expiry_ms: int | None = None,
) -> StreamingQuery:
    """Explain each batch of arriving files and add its answers to the cache.

    What was seen of each file lies in the query's state store, so only files that may have an answer are looked up in the
    cache, in their buckets; a batch of new files reads none of it. The state starts from the
    cache as the runs before left it. A batch
    writes its own version, results and cache rows alike, so a batch that is run again
    replaces exactly what it wrote. A new checkpoint is a new run over the same store.
    """
    spark = stream.sparkSession
    own = store.begin(checkpoint)
    path = full_path(stream) if key_path is None else key_path
    keyed = with_cache_key(stream, path, config.key_parts())
    if "file_hash" not in keyed.columns:
        keyed = keyed.withColumn("file_hash", F.sha2("content", 256))
    # read by the first batch of a new checkpoint only
    before = store.read(before=own).select("cache_key", "file_size", "mtime_ms", "file_hash").na.drop()
    judged = with_seen_status(keyed, before, expiry_ms)

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch)  # the state is asked once
        seen = rows.filter("seen_status <> 'miss'")
        known = spark.createDataFrame([], CACHE_SCHEMA) if seen.isEmpty() else store.read(before=own, batch=batch_id, keys=seen)
        files = rows.drop("cache_key", "seen_status")
        results, fresh = explain_corpus(files, known, templates, client_factory, config, key_path)
        results.write.mode("overwrite").parquet(f"{out}/{own.folder(batch_id)}")
        store.write(fresh, own, batch_id)

    provider = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps the provider that it was started with
    try:
        return judged.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if provider is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, provider)


USAGE = "project string, files long, cached_files long, input_tokens long, output_tokens long"


def usage_store(spark: SparkSession, out: str) -> KeyedStore:
    return KeyedStore(spark, out, USAGE, "project")


def usage_stream(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running totals per project over a stream of results; each batch writes the totals it changed.

    A new checkpoint counts from the start again, in a run that comes after all others.
    """
    store = usage_store(results.sparkSession, out)
    own = store.begin(checkpoint)
    totals = results.groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(
        F.count("*").alias("files"),
        F.sum(F.when(F.col("cached"), 1).otherwise(0)).alias("cached_files"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        store.write(batch, own, batch_id)

    return (
        totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_usage(spark: SparkSession, out: str) -> DataFrame:
    """The newest totals of every project written by the last run of ``usage_stream``.

    Totals are folded as they are written, so this reads few rows for each project, however many batches there were.
    """
    return usage_store(spark, out).read(latest_run=True)
