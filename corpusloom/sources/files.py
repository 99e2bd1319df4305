"""Files on shared storage: folders are listed and files are read inside the tasks."""

import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.fixed import CODE_EXTENSIONS, EXCLUDES, MAX_FILE_SIZE_MB, OUTPUT_PREFIX
from ..session import BATCH_BYTES, materialize
from . import storage

IGNORE_FILE = ".gitignore"
#: Names a task lists before it hands the folders that are left to other tasks.
LISTED = 20_000
#: Bytes of files that one task reads.
READ = 128 * 1024 * 1024
LISTING = "number int, is_folder boolean, relative_path string, path string, length long, mtime_ms long, rules string"


def decode_text(content: Column) -> Column:
    """UTF-8 text of raw bytes, bad bytes becoming replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def limit_size(df: DataFrame, max_mb: float = MAX_FILE_SIZE_MB, column: str = "length") -> DataFrame:
    """Drop files above a size; a scan applies it to its listing."""
    return df.filter(F.col(column) <= int(max_mb * 1024 * 1024))


def rule_lines(text: str) -> list[str]:
    """The rules of an ignore file's text, in order."""
    lines = (re.sub(r"(?<!\\)\s+\Z", "", line) for line in text.splitlines())
    return [line for line in lines if line and not line.startswith("#")]


def load_ignore_rules(path: str) -> list[str]:
    """The rules of one ignore file, in order, for ``scan_files(ignore_rules=...)``."""
    return rule_lines(storage.read_bytes(path).decode("utf-8", "replace"))


@lru_cache(maxsize=4096)
def _compiled(rules: str) -> list[tuple[int, list[tuple[re.Pattern, bool]]]]:
    """(length of the folder's path, patterns) of a chain of ignore files, the innermost first, the last rule first."""
    chain = []
    for folder, lines in reversed(json.loads(rules)):
        patterns = [(re.compile(pattern, re.S), ignored) for pattern, ignored in map(paths.ignore_pattern, reversed(lines))]
        chain.append((len(folder) + 1 if folder else 0, patterns))
    return chain


def is_ignored(relative: str, rules: str) -> bool:
    """The verdict of a chain of ignore files on one path, folders with a slash at their end.

    The innermost file with a rule that matches decides, by its last such rule. The folders above are
    not looked at: a walk never enters an ignored one.
    """
    for start, patterns in _compiled(rules):
        below = relative[start:]
        for pattern, ignored in patterns:
            if pattern.fullmatch(below):
                return ignored
    return False


def _walk(base: str, folder: str, rules: str, ignore_files: bool, limit: int) -> Iterator[tuple[bool, str, str, int, int, str]]:
    """(is_folder, path below base, path, length, time, rules) of the files below a folder, and of folders left for others.

    Ignored folders are not listed. Names with a leading dot are left out.
    """
    waiting, seen = [(folder, rules)], 0
    while waiting:
        folder, rules = waiting.pop()
        place = f"{base}/{folder}".rstrip("/")
        if seen >= limit:
            yield True, folder, place, 0, 0, rules
            continue
        if ignore_files and (found := storage.entry(f"{place}/{IGNORE_FILE}")) and not found.is_folder:
            if lines := load_ignore_rules(f"{place}/{IGNORE_FILE}"):
                rules = json.dumps([*json.loads(rules), [folder, lines]])
        for e in storage.entries(place):
            seen += 1
            relative = f"{folder}/{e.name}" if folder else e.name
            if e.name.startswith(".") or is_ignored(f"{relative}/" if e.is_folder else relative, rules):
                continue
            if not e.is_folder:
                yield False, relative, f"{place}/{e.name}", e.size, e.mtime_ms, ""
            elif not (e.link and storage.leads_back(f"{place}/{e.name}")):
                waiting.append((relative, rules))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the store that it lies on; one that names another scheme than ``file`` has it already."""
    if not storage.is_local(path):
        return path.rstrip("/")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def list_files(
    spark: SparkSession, sources: Sequence[str], keep: Column | None = None, ignore_rules: Sequence[str] = (), ignore_files: bool = True
) -> DataFrame:
    """(number, path, relative_path, length, mtime_ms) of the files below each source, kept.

    Folders are listed level by level: a task walks below its folders until it has seen ``LISTED``
    names and hands the rest on as rows of the next round, so one deep or wide tree is spread over all
    tasks. The driver sees the number of folders that are left, never a path. ``keep``, a condition on
    those columns, is applied as files are listed.

    Ignore files apply below their folder, after ``ignore_rules``; an ignored folder is final, nothing below it is
    listed. Rules travel with their folders. A missing source raises; a source that is a file is that file.
    """
    bases = [qualified(spark, source) for source in sources]
    for base in bases:
        if storage.entry(base) is None:
            raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {base}.")
    limit, tasks = LISTED, int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(number: int, folder: str, rules: str):
        base = bases[number]
        here = None if folder else storage.entry(base)
        if here is None or here.is_folder:
            yield from _walk(base, folder, rules, ignore_files, limit)
        elif not is_ignored(here.name, rules):
            yield False, here.name, base, here.size, here.mtime_ms, ""

    def run(batches):
        for batch in batches:
            for number, *place in zip(*(batch.column(c).to_pylist() for c in ("number", "relative_path", "rules")), strict=True):
                found = rows(number, *place)
                while part := list(islice(found, 8192)):
                    columns = [pa.array([number] * len(part), pa.int32()), *(pa.array(v) for v in zip(*part, strict=True))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [field.split()[0] for field in LISTING.split(", ")]
    rules = json.dumps([["", list(ignore_rules)]] if ignore_rules else [])
    level = spark.createDataFrame([(n, True, "", base, 0, 0, rules) for n, base in enumerate(bases)], LISTING)
    found, left = [level.filter("not is_folder")], len(bases)
    while left:
        listed = level.repartition(min(left, tasks)).mapInArrow(run, LISTING)
        kept = materialize(listed if keep is None else listed.filter(F.col("is_folder") | keep))
        found.append(kept.filter("not is_folder"))
        level = kept.filter("is_folder")
        left = level.count()
    return reduce(DataFrame.unionByName, found).drop("is_folder", "rules")


def with_content(listed: DataFrame) -> DataFrame:
    """Listed files with their bytes, read inside the tasks and handed on as soon as they have ``BATCH_BYTES``."""
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = listed.agg(F.sum("length")).first()[0] or 0

    def run(batches):
        for batch in batches:
            first, found, size = 0, [], 0
            for path in batch.column("path").to_pylist():
                found.append(storage.read_bytes(path))
                size += len(found[-1])
                if size >= BATCH_BYTES or first + len(found) == batch.num_rows:
                    part = batch.slice(first, len(found)).columns
                    yield pa.RecordBatch.from_arrays([*part, pa.array(found, pa.binary())], names=[*batch.schema.names, "content"])
                    first, found, size = first + len(found), [], 0

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema)
    return listed.repartition(max(tasks, -(-size // READ)), "path").mapInArrow(run, f"{fields}, content binary")


def _accepted(exts: Sequence[str], excludes: Sequence[str], prefix: str = OUTPUT_PREFIX, force: bool = False) -> Column:
    return paths.included(F.col("relative_path"), exts, excludes, prefix, force)


def scan_files(
    spark: SparkSession,
    sources: str | Sequence[str],
    exts: Sequence[str] = CODE_EXTENSIONS,
    excludes: Sequence[str] = EXCLUDES,
    max_mb: float | None = MAX_FILE_SIZE_MB,
    force: bool = False,
    project: str | None = None,
    ignore_rules: Sequence[str] = (),
    prefix: str = OUTPUT_PREFIX,
    ignore_files: bool = True,
    in_order: bool = False,
) -> DataFrame:
    """One row per accepted file below each path, duplicates between paths kept.

    ``force`` takes a named file whatever its extension. A missing path raises. The path, size and
    ignore rules are applied while folders are listed, before any content is read; the listing is kept
    and contents are read when the rows are. ``file_id`` is a hash of the path, the same on every run;
    ``in_order`` gives counters in path order instead, numbered before contents are read.
    """
    sources = [sources] if isinstance(sources, str) else list(sources)
    keep = _accepted(exts, excludes, prefix, force)
    if max_mb is not None:
        keep = keep & (F.col("length") <= int(max_mb * 1024 * 1024))
    listed = list_files(spark, sources, keep, ignore_rules, ignore_files)
    names = F.array(*[F.lit(project or source.rstrip("/").rsplit("/", 1)[-1]) for source in sources])
    listed = listed.withColumns({"project": F.element_at(names, F.col("number") + 1), "file_id": F.xxhash64("path", "number")})
    return with_content(in_path_order(listed) if in_order else listed).select(
        "file_id", "project", "path", "relative_path", decode_text(F.col("content")).alias("content"), F.col("length").alias("file_size"), "mtime_ms"
    )


def skipped_files(
    spark: SparkSession,
    source: str,
    exts: Sequence[str] = CODE_EXTENSIONS,
    excludes: Sequence[str] = EXCLUDES,
    max_mb: float = MAX_FILE_SIZE_MB,
    force: bool = False,
    ignore_rules: Sequence[str] = (),
    ignore_files: bool = True,
) -> DataFrame:
    """(path, size) of files below a path that a scan leaves out for their size alone."""
    keep = _accepted(exts, excludes, force=force) & (F.col("length") > int(max_mb * 1024 * 1024))
    return list_files(spark, [source], keep, ignore_rules, ignore_files).select("path", F.col("length").alias("size"))


def in_path_order(files: DataFrame) -> DataFrame:
    """Replace the hashed ``file_id`` of files by 0, 1, 2, … in (project, path) order.

    ``files`` is read twice; of a scan ask for ``in_order``, which numbers its listing. Only the paths are sorted, over all tasks; the sorted list is kept in the shared
    folder, so the numbers cannot change when an executor is lost.
    """
    keys = ["project", "relative_path", "path", "file_id"]
    listed = files.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(
        listed.select("path", "file_id", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    )
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    # one row per partition of the sort
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.join(starts, "_part").select("path", "file_id", (F.col("_start") + F.col("_at") - F.col("_from")).alias("_id"))
    # path and hash together are unique, also where two hashes are equal
    return files.join(numbered, ["path", "file_id"]).withColumn("file_id", F.col("_id")).drop("_id").select(*files.columns)


def count_files(
    spark: SparkSession,
    source: str,
    exts: Sequence[str] = CODE_EXTENSIONS,
    excludes: Sequence[str] = EXCLUDES,
    force: bool = False,
    ignore_rules: Sequence[str] = (),
    ignore_files: bool = True,
) -> int:
    """Number of accepted files, from the listing alone; 0 for a missing path. No size limit."""
    try:
        return list_files(spark, [source], _accepted(exts, excludes, force=force), ignore_rules, ignore_files).count()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return 0
        raise
