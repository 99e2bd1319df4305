"""Keyed rows, such as the answer cache, on shared storage: segments of parquet rows, and a log that says which of them count.

Every commit writes one small file ``log/<number>.json`` with the list of live segments, under a number
that nobody has used. Readers take the file with the highest number, so they see a version whole
or not at all. A segment is a folder of rows that is never changed; large ones lie in buckets by a hash of the key, so
that a lookup of few keys reads few of them.
"""

import json
from collections.abc import Callable
from typing import Any, NamedTuple
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import CACHE_SCHEMA

VERSION = "seq long, run string, batch long"
#: Rows of a bucket, and buckets of a segment at most (a power of two).
BUCKET_ROWS, BUCKETS = 100_000, 4096
#: So many segments of about one size are folded into one; sizes of a tier differ by this factor.
FAN = 8
#: Rows of the smallest tier.
TIER_ROWS = 1000
#: Log files that are kept, and commits after which a folded segment's folder is deleted.
KEPT = 16


class Run(NamedTuple):
    """One writer of versions: its place in the order of runs, and its own name."""

    seq: int
    name: str

    def folder(self, batch: int) -> str:
        return f"seq={self.seq}/run={self.name}/batch={batch}"


class Folder:
    """A folder on whatever store its path names, by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self) -> bool:
        return self.fs.exists(self.at())

    def names(self) -> list[str]:
        return [status.getPath().getName() for status in self.fs.listStatus(self.at())] if self.exists() else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file, seen whole or not at all; False if the name is taken."""
        hadoop = self.jvm.org.apache.hadoop.fs
        waiting = self.fs.makeQualified(self.at(f".{uuid4().hex}.tmp"))
        self.fs.mkdirs(self.at())
        stream = self.fs.create(waiting, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        options = self.jvm.java.lang.reflect.Array.newInstance(hadoop.Options.Rename.NONE.getClass(), 1)
        options[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(waiting, self.fs.makeQualified(self.at(name)), options)
            return True
        except Exception as error:
            self.fs.delete(waiting, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on whatever store its path names."""
    return Folder(spark, path).exists()


def note_run(spark: SparkSession, checkpoint: str | None, last: Callable[[], int]) -> Run:
    """A run that comes after all others, ``last`` telling their highest place.

    With a checkpoint the run is noted there: started again from it, it is the same run and
    replaces what its last batch wrote; a new checkpoint is a new run and replaces nothing.
    """
    note = f"{checkpoint}/corpusloom-run"
    if checkpoint and exists(spark, note):
        return Run(*spark.read.schema("seq long, name string").parquet(note).first())
    run = Run(last() + 1, uuid4().hex)
    if checkpoint:
        spark.createDataFrame([run], "seq long, name string").coalesce(1).write.parquet(note)
    return run


def begin_run(spark: SparkSession, path: str, checkpoint: str | None = None) -> Run:
    """A run that writes folders ``Run.folder(batch)`` below ``path``, after everything written there so far."""

    def last() -> int:
        return max((int(name.removeprefix("seq=")) for name in Folder(spark, path).names() if name.startswith("seq=")), default=0)

    return note_run(spark, checkpoint, last)


class KeyedStore:
    """Rows with a string key in versions; the latest version of a key counts.

    Versions are ordered by run, then by batch inside a run. A run adds only its own rows,
    and writing its last batch again (after a failure, or a replayed stream batch) replaces that
    batch and nothing else.

    Before a version is committed, earlier segments are folded by size: whenever ``FAN`` of one tier have
    gathered they become one, with the latest row of each key, so there are at most ``FAN`` segments for each power of ``FAN``
    in the number of rows. What a fold replaces is deleted ``KEPT`` commits later; a
    reader that lasts longer has to start again. A run that goes on after newer ones have written may
    miss answers of its own that a newer run has replaced, and asks again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.schema, self.key = spark, schema, key
        self.columns = spark.createDataFrame([], schema).columns
        self.path = path.rstrip("/")
        self.log = Folder(spark, f"{self.path}/log")

    # --- the log ------------------------------------------------------------------------------

    def _state(self) -> tuple[int, dict[str, Any]]:
        """(number, state) of the last commit."""
        while True:
            numbers = sorted(int(name[:-5]) for name in self.log.names() if name.endswith(".json"))
            if not numbers:
                return 0, {"segments": [], "dropped": [], "seq": 0}
            try:
                return numbers[-1], json.loads(self.log.read(f"{numbers[-1]:012d}.json"))
            except Exception:
                if numbers[-1] == max((int(n[:-5]) for n in self.log.names() if n.endswith(".json")), default=0):
                    raise

    def segments(self) -> list[dict[str, Any]]:
        """Live segments: folder, rows, buckets, and the version each was written as (none for a folded one)."""
        return self._state()[1]["segments"]

    def _commit(self, change: Callable[[list[dict[str, Any]]], tuple[list[dict[str, Any]], list[str]] | None], seq: int = 0) -> bool:
        """Apply ``change`` (segments to add, folders to drop; None to give up) to the newest state, until no other commit comes first."""
        while True:
            number, state = self._state()
            found = change(state["segments"])
            if found is None:
                return False
            add, drop = found
            number += 1
            gone = [d for d in state["dropped"] if d[1] + KEPT <= number]
            new = {
                "segments": [s for s in state["segments"] if s["folder"] not in drop] + add,
                "dropped": [d for d in state["dropped"] if d not in gone] + [[folder, number] for folder in drop],
                "seq": max(state["seq"], seq),
            }
            if self.log.create(f"{number:012d}.json", json.dumps(new)):
                for folder, _ in gone:
                    Folder(self.spark, f"{self.path}/data").delete(folder)
                for name in self.log.names():
                    if name.endswith(".json") and int(name[:-5]) <= number - KEPT:
                        self.log.delete(name)
                return True

    # --- rows -----------------------------------------------------------------------------------

    def _rows(self, segments: list[dict[str, Any]]) -> DataFrame:
        schema = f"{self.schema}, {VERSION}, segment string, buckets int, bucket int"
        if not segments:
            return self.spark.createDataFrame([], schema)
        data = f"{self.path}/data"
        return self.spark.read.schema(schema).option("basePath", data).parquet(*(f"{data}/{s['folder']}" for s in segments))

    def _bucket(self, buckets: int) -> Column:
        return F.xxhash64(self.key).bitwiseAND(F.lit(buckets - 1)).cast("int")

    def _put(self, rows: DataFrame, count: int | None = None) -> dict[str, Any] | None:
        """Write a segment's folder; rows beyond one bucket are dealt to buckets."""
        folder, path = f"segment={uuid4().hex}", f"{self.path}/data"
        if count is None:
            first = f"{path}/{folder}"
            rows.write.parquet(f"{first}/buckets=1/bucket=0")
            written = self.spark.read.schema(f"{self.schema}, {VERSION}").parquet(f"{first}/buckets=1/bucket=0")
            count = written.count()
            if count <= BUCKET_ROWS:
                if not count:
                    Folder(self.spark, path).delete(folder)
                    return None
                return {"folder": folder, "rows": count, "buckets": 1}
            dealt = self._put(written, count)
            Folder(self.spark, path).delete(folder)
            return dealt
        buckets = min(BUCKETS, 1 << max(0, -(-count // BUCKET_ROWS) - 1).bit_length())
        tasks = min(buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        placed = rows.withColumns({"buckets": F.lit(buckets), "bucket": self._bucket(buckets)})
        placed.repartition(tasks, "bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("buckets", "bucket").parquet(f"{path}/{folder}")
        return {"folder": folder, "rows": count, "buckets": buckets}

    def _latest(self, versions: DataFrame) -> DataFrame:
        values = [c for c in self.columns if c != self.key]
        # equal keys inside one version: the largest row, so that every reader sees the same
        order = F.struct("seq", "run", "batch", *values)
        latest = versions.groupBy(self.key).agg(F.max(order).alias("entry"))
        return latest.select(self.key, *[f"entry.{c}" for c in [*values, "seq", "run", "batch"]])

    # --- use --------------------------------------------------------------------------------------

    def begin(self, checkpoint: str | None = None) -> Run:
        run = note_run(self.spark, checkpoint, lambda: self._state()[1]["seq"])
        if self._state()[1]["seq"] < run.seq:
            self._commit(lambda live: ([], []), run.seq)
        return run

    def read(self, before: Run | None = None, batch: int = 0, keys: DataFrame | None = None, latest_run: bool = False) -> DataFrame:
        """The rows as they stand, or as batch ``batch`` of a run sees it; only some keys when given.

        A run sees what runs before it wrote and its own earlier batches. Giving the keys
        that will be looked up reads only their buckets, and keeps the rows of all others out of
        the shuffle that finds the latest version. ``latest_run`` leaves out what older runs have written.
        """
        state = self._state()[1]
        segments = state["segments"]
        if before is not None:
            segments = [s for s in segments if s.get("run") is None or s["seq"] < before.seq or (s["run"] == before.name and s["batch"] < batch)]
        versions = self._rows(segments)
        if before is not None:
            own = (F.col("run") == before.name) & (F.col("batch") < batch)
            versions = versions.filter((F.col("seq") < before.seq) | own)
        if keys is not None:
            sizes = {s["buckets"] for s in segments if s["buckets"] > 1}
            if sizes:
                # at most BUCKETS numbers
                wanted = [r[0] for r in keys.select(self._bucket(BUCKETS)).distinct().collect()]
                places = F.col("buckets") == 1
                for n in sorted(sizes):
                    places = places | ((F.col("buckets") == n) & F.col("bucket").isin(sorted({w & (n - 1) for w in wanted})))
                versions = versions.filter(places)
            versions = versions.join(keys.select(self.key), self.key, "left_semi")
        if latest_run:
            versions = versions.filter(F.col("seq") == state["seq"])
        return self._latest(versions).drop("seq", "run", "batch")

    def write(self, rows: DataFrame, run: Run | None = None, batch: int = 0) -> Run:
        """Write one version; without a run it is a run of its own, after all others."""
        run = run or self.begin()
        self._fold(run, batch)
        known = [c for c in self.columns if c in rows.columns]
        version = {"seq": F.lit(run.seq).cast("long"), "run": F.lit(run.name), "batch": F.lit(batch).cast("long")}
        segment = self._put(rows.select(*known).withColumns(version))
        add = [segment | {"seq": run.seq, "run": run.name, "batch": batch}] if segment else []
        self._commit(lambda live: (add, [s["folder"] for s in live if s.get("run") == run.name and s["batch"] == batch]), run.seq)
        return run

    def _fold(self, run: Run, batch: int) -> None:
        """Fold tiers that are full, leaving out the version that is about to be written."""
        while True:
            tiers: dict[int, list[dict[str, Any]]] = {}
            for s in self.segments():
                if s.get("run") != run.name or s["batch"] != batch:
                    tier, limit = 0, TIER_ROWS
                    while s["rows"] > limit:
                        tier, limit = tier + 1, limit * FAN
                    tiers.setdefault(tier, []).append(s)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FAN), None)
            if full is None or not self._replace(full):
                return

    def _replace(self, segments: list[dict[str, Any]]) -> bool:
        count = sum(s["rows"] for s in segments)
        folded = self._put(self._latest(self._rows(segments)), count)
        folders = [s["folder"] for s in segments]
        folded["rows"] = self._rows([folded]).count()
        entry = folded | {"seq": max(s["seq"] for s in segments), "run": None, "batch": 0}

        def change(live):
            return ([entry], folders) if set(folders) <= {s["folder"] for s in live} else None

        if self._commit(change):
            return True
        Folder(self.spark, f"{self.path}/data").delete(folded["folder"])
        return False

    def compact(self, into: str) -> "KeyedStore":
        """A new store holding only the latest row of every key."""
        store = KeyedStore(self.spark, into, self.schema, self.key)
        store.write(self.read())
        return store

    def sweep(self) -> int:
        """Delete folders that no kept commit names, left by writers that failed; only while nobody writes."""
        named = set()
        for name in self.log.names():
            if name.endswith(".json"):
                state = json.loads(self.log.read(name))
                named |= {s["folder"] for s in state["segments"]} | {d[0] for d in state["dropped"]}
        data = Folder(self.spark, f"{self.path}/data")
        stray = [name for name in data.names() if name not in named]
        for name in stray:
            data.delete(name)
        return len(stray)


class CacheStore(KeyedStore):
    """The answer cache."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, CACHE_SCHEMA, "cache_key")
