"""Reuse of earlier answers: three-tier lookup, miss set, keyed upsert.

A cache row is (cache_key, file_hash, file_size, mtime_ms, explanation, created_at, config).
The file side needs (cache_key, file_size, mtime_ms) and either ``file_hash`` or ``content``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompting import cache_key
from ..session import materialize

CACHE_SCHEMA = (
    "cache_key string, file_hash string, file_size long, mtime_ms long, explanation string, created_at timestamp, "
    "config struct<mode:string,level:string,provider:string,model:string>"
)


def full_path(files: DataFrame) -> Column:
    """What names a file across projects: its full path, or project and relative path."""
    return F.col("path") if "path" in files.columns else F.concat_ws("/", "project", "relative_path")


def with_cache_key(files: DataFrame, path: Column, config: dict[str, str]) -> DataFrame:
    parts = [F.lit(config.get(name)) for name in ("mode", "level", "provider", "model")]
    return files.withColumn("cache_key", cache_key(path, *parts))


def _hash(files: DataFrame) -> Column:
    return F.col("file_hash") if "file_hash" in files.columns else F.sha2("content", 256)


def cache_lookup(files: DataFrame, cache: DataFrame, use_cache: bool = True, metadata_first: bool = False) -> DataFrame:
    """Each file's (cache_key, file_hash, cache_status, cached_explanation).

    Status is ``hit`` for equal time and size, ``refresh`` for equal size and content hash,
    else ``miss``. Only keys, sizes, times and hashes are shuffled, never content.
    ``metadata_first`` settles hits on metadata alone and reads content only if there are
    files of unchanged size and changed time, and only theirs; ``file_hash`` is then NULL
    for the others.
    """
    ids = [c for c in ("project", "file_id") if c in files.columns]
    meta = [*ids, "cache_key", "file_size", "mtime_ms"]
    if not use_cache:
        return files.select(*meta, _hash(files).alias("file_hash")).select(
            *meta, "file_hash", F.lit("miss").alias("cache_status"), F.lit(None).cast("string").alias("cached_explanation")
        )
    known = cache.select(
        "cache_key", F.col("file_hash").alias("_hash"), F.col("file_size").alias("_size"), F.col("mtime_ms").alias("_mtime"),
        F.col("explanation").alias("_text"),
    )
    same_size = F.col("file_size") == F.col("_size")
    fresh = same_size & (F.col("mtime_ms") == F.col("_mtime"))
    if metadata_first:
        narrow = materialize(files.select(*meta).join(known.drop("_hash", "_text"), "cache_key", "left"))
        unsure = narrow.filter(same_size & ~F.coalesce(fresh, F.lit(False))).select(*ids, "cache_key")
        current = narrow.select(*meta)
        if unsure.isEmpty():
            current = current.withColumn("file_hash", F.lit(None).cast("string"))
        else:
            source = files.select(*ids, "cache_key", *(["file_hash"] if "file_hash" in files.columns else ["content"]))
            hashes = unsure.distinct().join(source, [*ids, "cache_key"])
            hashed = hashes.select(*ids, "cache_key", _hash(hashes).alias("file_hash")).dropDuplicates([*ids, "cache_key"])
            current = current.join(hashed, [*ids, "cache_key"], "left")
    else:
        current = files.select(*meta, _hash(files).alias("file_hash"))
    status = F.when(fresh, "hit").when(same_size & (F.col("file_hash") == F.col("_hash")), "refresh").otherwise("miss")
    return current.join(known, "cache_key", "left").select(
        *meta, "file_hash", status.alias("cache_status"), F.when(status != "miss", F.col("_text")).alias("cached_explanation")
    )


def cache_misses(looked_up: DataFrame) -> DataFrame:
    return looked_up.filter(F.col("cache_status") == "miss").drop("cache_status", "cached_explanation")


def refreshed(looked_up: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache rows whose file kept its content: the same answer with the new time."""
    times = looked_up.filter(F.col("cache_status") == "refresh").groupBy("cache_key").agg(F.max("mtime_ms").alias("_mtime"))
    return cache.join(times, "cache_key").withColumn("mtime_ms", F.col("_mtime")).drop("_mtime")


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with ``fresh`` rows in the place of those with the same key.

    A file scanned twice has one key and one row here; two different contents under one key
    are an error, because each would get the other's answer. The result reads ``cache``, so
    write it somewhere else.
    """
    columns = [F.col(c) for c in fresh.columns if c != "cache_key"]
    clash = F.coalesce(F.min("file_hash") != F.max("file_hash"), F.lit(False))
    told = F.raise_error(F.concat(F.lit("two contents share the cache key "), "cache_key"))
    entry = F.max(F.struct(*columns))
    fresh = fresh.groupBy("cache_key").agg(F.when(clash, told).otherwise(entry).alias("entry")).select("cache_key", "entry.*")
    return cache.join(fresh.select("cache_key"), "cache_key", "left_anti").unionByName(fresh, allowMissingColumns=True)
