"""Registered queries that write files, reports, cache stores or streams, and read them back."""

from contextlib import suppress
from uuid import uuid4

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import corpus, infer, prompts, report
from ..plans import explain, overview
from ..session import shared_folder
from ..sources import files as scans
from ..sources import sinks
from ..sources.cache_store import CacheStore
from ..sources.tables import read_table
from ..sources.templates import load_templates
from ..streaming import incremental, progress
from . import samples

STORED = {}
ID = ["project", "file_id"]
#: Small enough that projects of the sf0.01 tables are described in two rounds.
ROUND_TOKENS = 1000


def register(fn):
    STORED[fn.__name__] = fn
    return fn


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def _place() -> Column:
    """project/folder/relative path with the id in its name; some folders start with an underscore, some hold a colon."""
    number, path = F.col("file_id") % 40, F.col("relative_path")
    folder = F.concat(F.when(number % 13 == 0, "_").otherwise(""), number.cast("string"), F.when(number % 11 == 0, ":v").otherwise(""))
    named = F.concat(paths.dirname(path), F.lit("/"), paths.stem(path), F.lit("-"), F.col("file_id").cast("string"), paths.raw_extension(path))
    return F.concat_ws("/", "project", folder, named)


def _written_corpus(spark: SparkSession, sf: str, body: Column | None = None) -> str:
    """The code corpus as files; queries that only look at paths give a short body."""
    base = _folder(spark, "corpus")
    files = samples.files(spark, sf).withColumn("place", _place())
    sinks.write_files(files.select(F.col("place").alias("relative_path"), F.col("content") if body is None else body.alias("content")), base)
    return base


def _ignored_corpus(spark: SparkSession, sf: str, body: Column | None = None) -> str:
    """Ignore files at the top, in every project and in every seventh folder of a project."""
    base, files = _written_corpus(spark, sf, body), samples.files(spark, sf)
    nested = [
        (spark.range(1).select(F.lit("").alias("folder")), samples.TOP_IGNORES),
        (files.select(F.concat("project", F.lit("/")).alias("folder")).distinct(), samples.PROJECT_IGNORES),
        (files.filter("file_id % 40 % 7 = 0").select(F.regexp_extract(_place(), "^[^/]*/[^/]*/", 0).alias("folder")).distinct(), samples.FILE_IGNORES),
    ]
    for folders, rules in nested:
        name = F.concat("folder", F.lit(scans.IGNORE_FILE))
        sinks.write_files(folders.select(name.alias("relative_path"), F.lit(rules).alias("content")), base)
    return base


@register
def scanned_files(spark, sf):
    found = scans.scan_files(spark, _written_corpus(spark, sf), project="all")
    return found.select("relative_path", "file_size", F.md5("content").alias("content_md5"))


@register
def scan_ignored(spark, sf):
    found = scans.scan_files(spark, _ignored_corpus(spark, sf, F.md5("content")), project="all")
    return found.select("relative_path", "file_size", F.col("content").alias("content_md5"))


@register
def scan_counts(spark, sf):
    """The ignore files decide here too."""
    base = _ignored_corpus(spark, sf, F.md5("content"))
    counts = [(name, scans.count_files(spark, f"{base}{below}")) for name, below in (("all", ""), ("src1", "/src1"), ("missing", "/none"))]
    return spark.createDataFrame(counts, "scope string, files long")


@register
def scan_union(spark, sf):
    """The whole corpus, and one of its folders again."""
    base = _written_corpus(spark, sf, F.md5("content"))
    found = scans.scan_files(spark, [base, f"{base}/src0"], project="all")
    whole = F.regexp_replace("path", r"\A.*/corpus-[0-9a-f]{32}/", "")
    return found.groupBy(whole.alias("whole_path"), "content").agg(F.count("*").alias("times"), F.count_distinct("file_id").alias("ids"))


@register
def scan_skipped(spark, sf):
    skipped = scans.skipped_files(spark, _ignored_corpus(spark, sf), max_mb=0.004)
    return skipped.select(F.regexp_replace("path", r"\A.*/corpus-[0-9a-f]{32}/", "").alias("whole_path"), "size")


@register
def scan_in_order(spark, sf):
    found = scans.scan_files(spark, _written_corpus(spark, sf, F.md5("content")), project="all", in_order=True)
    return found.select("file_id", "relative_path", F.col("content").alias("content_md5"))


@register
def decoded_text(spark, sf):
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFFE")))
    return read_table(spark, sf, "documents").select("doc_id", scans.decode_text(raw).alias("decoded"))


@register
def loaded_templates(spark, sf):
    """Documents as templates: one file each, and a user's layer over the even ones."""
    base = _folder(spark, "templates")
    named = read_table(spark, sf, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"), F.col("text").alias("content"))
    sinks.write_files(named, f"{base}/default")
    sinks.write_files(named.filter("doc_id % 2 = 0").withColumn("content", F.concat(F.lit("user "), "content")), f"{base}/user")
    chosen = prompts.choose_templates(load_templates(spark, f"{base}/default", f"{base}/user"))
    return chosen.select("mode", F.md5("template").alias("template_md5"))


@register
def written_results(spark, sf):
    path = _folder(spark, "results")
    sinks.write_results(samples.described(spark, sf).select(*ID, "relative_path", "language"), path)
    return spark.read.parquet(path).select(*ID, "relative_path", "language")


@register
def written_one_project(spark, sf):
    """All projects, then one of them again, then a write that fails: the rows that are there afterwards."""
    path, rows = _folder(spark, "results"), samples.described(spark, sf).select(*ID, "relative_path", "language")
    sinks.write_results(rows, path)
    sinks.write_results(rows.filter("project = 'src1'").withColumn("language", F.lit("again")), path)
    broken = F.when(F.col("file_id") % 2 == 0, F.raise_error(F.lit("lost"))).otherwise(F.lit("never"))
    with suppress(PySparkException):
        sinks.write_results(rows.filter("project in ('src2', 'src3')").withColumn("language", broken), path)
    return spark.read.parquet(path).select(*ID, "relative_path", "language")


@register
def written_report(spark, sf):
    path = _folder(spark, "report")
    rows = corpus.offline_results(samples.described(spark, sf), "architecture").withColumn("file_id", F.xxhash64("project"))
    sinks.write_report(report.report_sections(rows, "architecture"), path)
    return spark.read.text(path).select("project", F.col("value").alias("line"))


@register
def written_file_report(spark, sf):
    """A report with the source of every file, moved once and read back line by line."""
    path = _folder(spark, "report")
    rows = samples.described(spark, sf).withColumn("explanation", F.concat(F.lit("about "), "relative_path"))
    sinks.write_sorted_report(report.report_lines(rows), path)
    return spark.read.option("lineSep", "\n").text(path).select("project", F.col("value").alias("line"))


@register
def cache_store_latest(spark, sf):
    store = CacheStore(spark, _folder(spark, "store"))
    seed = samples.cache_seed(samples.files(spark, sf))
    store.write(seed)
    store.write(seed.filter("file_size % 2 = 0").withColumn("explanation", F.concat(F.lit("newer "), "explanation")))
    return store.read().select("cache_key", "explanation")


@register
def cache_same_path_projects(spark, sf):
    """Two projects with the same paths, default keys: the second run finds each project's own answers."""
    docs = read_table(spark, sf, "documents").select(
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("project"), F.col("doc_id").alias("file_id"),
        F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".js")).alias("relative_path"), "text",
    )
    side = docs.select(
        *ID, "relative_path", F.concat("project", "text").alias("content"), F.lit(1).cast("long").alias("file_size"), F.lit(1).cast("long").alias("mtime_ms")
    )
    store = CacheStore(spark, _folder(spark, "store"))
    templates = samples.templates(spark)
    _, fresh = explain.explain_corpus(side, store.read(), templates, lambda: lambda row: f"ans {row['project']}/{row['relative_path']}", samples.CONFIG)
    store.write(fresh)
    again, _ = explain.explain_corpus(side, store.read(), templates, lambda: lambda row: "asked again", samples.CONFIG)
    return again.select(*ID, "explanation", "cached")


@register
def retried_answers(spark, sf):
    """A client that fails as often as the id says, and three tries for each row."""

    def client():
        seen: dict[int, int] = {}

        def call(row):
            seen[row["file_id"]] = seen.get(row["file_id"], 0) + 1
            if seen[row["file_id"]] <= row["file_id"] % 4:
                raise ValueError("busy")
            return f"answer {row['file_id']}"

        return call

    asked = samples.files(spark, sf).select(*ID, F.col("relative_path").alias("prompt"))
    found = infer.infer(asked, client, attempts=2, delay=0.0)
    return found.select(*ID, "explanation", "error", F.col("attempts").cast("long").alias("attempts"))


@register
def resumed_answers(spark, sf):
    """A run whose client fails for every third document, and a later run that asks for the rest."""

    def client(name, fails):
        def call(row):
            if fails and row["file_id"] % 3 == 0:
                raise ValueError("down")
            return f"{name} {row['prompt']}"

        return lambda: call

    asked, journal = samples.files(spark, sf).select(*ID, F.md5("content").alias("prompt")), _folder(spark, "journal")
    infer.infer(asked, client("first", True), attempts=0, journal=journal).write.format("noop").mode("overwrite").save()
    found = infer.infer(asked, client("second", False), attempts=0, journal=journal)
    return found.select(*ID, "explanation", "error", F.col("attempts").cast("long").alias("attempts"))


@register
def infer_odd_replies(spark, sf):
    """Replies without a text are errors of their row; counts that are no numbers are left out."""

    def client():
        replies = [None, {}, 7, {"text": None}, {"text": "ok", "total_tokens": "many"}, {"text": "sur\ud800rogate", "total_tokens": 9}, "plain"]
        return lambda row: replies[row["file_id"] % 7]

    asked = samples.files(spark, sf).select(*ID, F.md5("content").alias("prompt"))
    return infer.infer(asked, client, attempts=0).select(*ID, "explanation", "error", "reported_tokens", "output_tokens")


@register
def report_same_ids(spark, sf):
    """Two projects that hold the same file ids: each report has its own texts."""
    rows = samples.described(spark, sf).withColumn("project", F.explode(F.array(F.lit("a"), F.lit("b"))))
    rows = rows.select(
        *ID, "relative_path", "language", F.concat("project", F.lit(" says "), F.col("file_id").cast("string")).alias("explanation"), F.concat("project", "content").alias("content")
    )
    return report.report_sections(rows).withColumn("section", F.col("section").cast("long"))


@register
def observed_progress(spark, sf):
    """Counts observed while the rows are written for real."""
    found, _ = explain.explain_corpus(
        samples.file_side(samples.files(spark, sf)), samples.cache_seed(samples.files(spark, sf)), samples.templates(spark), samples.stub_client, samples.CONFIG, F.col("key_path")
    )
    watched, seen = infer.observe_progress(found)
    watched.write.parquet(_folder(spark, "observed"))
    return spark.createDataFrame([tuple(seen.get[c] for c in ("completed", "failed", "cached"))], "completed long, failed long, cached long")


@register
def project_summaries_rounds(spark, sf):
    answers, _ = overview.summarize_projects(
        samples.files(spark, sf), samples.templates(spark), samples.stub_client, explain.RunConfig(mode="arch", attempts=0, delay=0.0), tokens_per_prompt=ROUND_TOKENS
    )
    return answers.select("project", F.col("rounds").cast("long").alias("rounds"), "failed_parts", F.col("error").isNull().alias("answered"))


def _warm_stream(spark: SparkSession, sf: str) -> tuple[DataFrame, CacheStore]:
    """Files arriving in lots, four at most, against a store that knows earlier answers: the results, and the store afterwards."""
    base = _folder(spark, "stream")
    files = samples.file_side(samples.files(spark, sf))
    files.repartitionByRange("file_id").write.option("maxRecordsPerFile", max(1, files.count() // 3)).parquet(f"{base}/in")
    store = CacheStore(spark, f"{base}/cache")
    store.write(samples.cache_seed(samples.files(spark, sf)))
    arriving = incremental.file_stream(spark, f"{base}/in", files.schema, max_files=samples.lot_size(spark, f"{base}/in", least=2))
    incremental.explain_stream(
        arriving, store, f"{base}/results", f"{base}/checkpoint", samples.templates(spark), samples.stub_client, samples.CONFIG, F.col("key_path")
    ).awaitTermination()
    return spark.read.parquet(f"{base}/results"), store


@register
def stream_progress(spark, sf):
    """Files arriving in three lots, one for a batch: what each batch has observed."""
    base, files = _folder(spark, "watched"), samples.files(spark, sf)
    rows = files.select(*ID, F.when(F.col("file_id") % 5 == 0, "failed").alias("error"), (F.col("file_id") % 7 == 0).alias("cached"))
    for lot in range(3):
        rows.filter(F.col("file_id") % 3 == lot).coalesce(1).write.mode("append").parquet(f"{base}/in")
    watch = progress.ProgressTable(spark, f"{base}/progress")
    spark.streams.addListener(watch)
    try:
        stream = progress.observed(incremental.file_stream(spark, f"{base}/in", rows.schema, max_files=1))
        query = stream.writeStream.format("noop").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        watch.finished(query)
    finally:
        spark.streams.removeListener(watch)
    return progress.read_progress(spark, f"{base}/progress").select("completed", "failed", "cached")


@register
def stream_results(spark, sf):
    return _warm_stream(spark, sf)[0].select(*ID, "relative_path", "language", "explanation", "cached", "error")


@register
def stream_cache(spark, sf):
    return _warm_stream(spark, sf)[1].read().select("cache_key", "file_hash", "file_size", "mtime_ms", "explanation")
