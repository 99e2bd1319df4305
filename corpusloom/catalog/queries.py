"""Registered queries: every operator, run over whole tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, nested, paths, prompting, safety, text
from ..operators import blocks, cache, corpus, extract, graph, infer, overlay, prompts, report
from ..operators.scale import lookup_join
from ..plans import explain, overview
from ..plans.structure import project_metrics, structure
from ..session import materialize, shared_folder
from ..sources.cache_store import CacheStore
from ..sources.tables import read_spread, read_table
from ..streaming import incremental
from . import samples
from .stored import STORED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(STORED)
ID = ["project", "file_id"]


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- files: description, filters, counts, order ------------------------------------------------


@register
def describe_files(spark, sf):
    return corpus.describe_files(samples.files(spark, sf))


@register
def included_files(spark, sf):
    return corpus.include_files(samples.files(spark, sf).select(*ID, "relative_path"))


@register
def included_by_segment(spark, sf):
    return corpus.include_files(samples.files(spark, sf).select(*ID, "relative_path"), match="segment")


@register
def forced_files(spark, sf):
    return corpus.include_files(samples.files(spark, sf).select(*ID, "relative_path"), force=True)


@register
def ignore_rules(spark, sf):
    return corpus.apply_ignore_rules(samples.files(spark, sf).select(*ID, "relative_path"), samples.IGNORE_RULES)


@register
def size_limit(spark, sf):
    kept = corpus.limit_size(samples.files(spark, sf), max_mb=0.004)
    return kept.select(*ID, F.octet_length("content").cast("long").alias("size"))


@register
def count_files(spark, sf):
    return corpus.count_files(samples.files(spark, sf))


@register
def language_counts(spark, sf):
    return corpus.language_counts(samples.described(spark, sf)).select("project", "language", "files")


@register
def primary_language(spark, sf):
    return corpus.primary_language(samples.described(spark, sf))


@register
def tech_stack(spark, sf):
    return corpus.tech_stack(samples.described(spark, sf))


@register
def by_directory(spark, sf):
    return corpus.by_directory(samples.files(spark, sf))


@register
def key_files(spark, sf):
    return corpus.key_files(samples.files(spark, sf)).select(*ID, "relative_path", F.col("rank").cast("long").alias("rank"))


@register
def file_preview(spark, sf):
    body = F.col("content")
    return samples.files(spark, sf).select(*ID, text.preview(body).alias("preview"), text.preview(body, 200, "...").alias("short"))


@register
def relative_paths(spark, sf):
    full = F.concat(F.lit("C:\\work\\"), F.replace(F.col("relative_path"), F.lit("/"), F.lit("\\")))
    return samples.files(spark, sf).select(
        *ID, paths.relative_path(full, "C:/work").alias("below"), paths.relative_path(full).alias("bare")
    )


@register
def offline_results(spark, sf):
    return corpus.offline_results(samples.described(spark, sf), "explain").select(*ID, "language", "explanation")


@register
def offline_projects(spark, sf):
    return corpus.offline_results(samples.described(spark, sf), "arch")


@register
def mode_labels(spark, sf):
    names = F.array(*[F.lit(m) for m in ("explain", "arch", "architecture", "onboarding", "flowchart")])
    mode = F.element_at(names, (F.col("file_id") % 5 + 1).cast("int"))
    named = prompting.mode_label(mode)
    return samples.files(spark, sf).select(*ID, prompting.resolve_mode(mode).alias("mode"), named["label"].alias("label"), named["slug"].alias("slug"))


@register
def batches(spark, sf):
    return corpus.assign_batches(samples.files(spark, sf).select(*ID))


@register
def progress(spark, sf):
    return corpus.progress(samples.files(spark, sf).select(*ID))


@register
def deduped_paths(spark, sf):
    return corpus.dedupe_paths(samples.files(spark, sf))


@register
def path_tree(spark, sf):
    return corpus.path_tree(samples.files(spark, sf)).withColumn("depth", F.col("depth").cast("long"))


@register
def neighbours(spark, sf):
    return corpus.neighbours(samples.files(spark, sf))


@register
def toc(spark, sf):
    return corpus.toc(samples.files(spark, sf))


# --- structure -----------------------------------------------------------------------------------


def _long_pos(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.col("pos").cast("long"))


@register
def functions(spark, sf):
    rows = samples.spread_files(spark, sf).select(*ID, F.posexplode(extract.function_names(F.col("content"), None)).alias("pos", "name"))
    return _long_pos(rows)


@register
def functions_top15(spark, sf):
    return _long_pos(extract.extract_functions(samples.spread_files(spark, sf)))


@register
def function_types(spark, sf):
    return extract.extract_functions(samples.spread_files(spark, sf), None).groupBy("project", "type").agg(F.count("*").alias("functions"))


@register
def dependencies(spark, sf):
    return _long_pos(extract.extract_dependencies(samples.spread_files(spark, sf)))


@register
def dependencies_strict(spark, sf):
    return _long_pos(extract.extract_dependencies(samples.spread_files(spark, sf), strict=True))


@register
def databases(spark, sf):
    return _long_pos(extract.extract_databases(samples.spread_files(spark, sf)))


@register
def apis(spark, sf):
    return _long_pos(extract.extract_apis(samples.spread_files(spark, sf)))


@register
def page_apis(spark, sf):
    return _long_pos(extract.extract_apis(samples.page_corpus(spark, sf)))


@register
def page_functions(spark, sf):
    return _long_pos(extract.extract_functions(samples.page_corpus(spark, sf)))


@register
def db_connections(spark, sf):
    return _long_pos(extract.extract_db_connections(samples.spread_files(spark, sf)))


@register
def api_connections(spark, sf):
    return _long_pos(extract.extract_api_connections(samples.spread_files(spark, sf)))


@register
def page_connections(spark, sf):
    return _long_pos(extract.extract_api_connections(samples.page_corpus(spark, sf)))


@register
def entry_points(spark, sf):
    return extract.entry_points(samples.spread_files(spark, sf))


@register
def component_types(spark, sf):
    kind = classify.component_type(F.col("relative_path"), F.col("content"))
    text_only = classify.component_type(F.lit("x"), F.col("content"))
    return samples.files(spark, sf).select(*ID, kind.alias("type"), text_only.alias("type_by_text"))


@register
def node_shapes(spark, sf):
    kind = classify.component_type(F.col("relative_path"), F.col("content"))
    return samples.files(spark, sf).select(*ID, kind.alias("type")).select(*ID, "type", classify.node_shape(F.col("type")).alias("s")).select(
        *ID, "type", "s.shape", F.col("s.open").alias("opening"), F.col("s.close").alias("closing")
    )


@register
def purposes(spark, sf):
    return samples.files(spark, sf).select(*ID, classify.purpose(F.col("relative_path"), F.col("content")).alias("purpose"))


# --- rules on names and blocks that the derived corpus does not have --------------------------------


@register
def named_entry_points(spark, sf):
    """Every name and prefix that makes an entry point, in mixed case, beside names that do not."""
    names = F.array(*[F.lit(n) for n in samples.ENTRY_LIKE_NAMES])
    named = F.concat(F.lit("src/"), F.element_at(names, (F.col("doc_id") % len(samples.ENTRY_LIKE_NAMES) + 1).cast("int")))
    rows = read_table(spark, sf, "documents").select("doc_id", named.alias("relative_path"))
    return rows.select("doc_id", "relative_path", classify.is_entry_point(F.col("relative_path"), F.lit("")).alias("is_entry"))


@register
def own_output_files(spark, sf):
    """Files of which every third is named like our own output."""
    name = F.when(F.col("file_id") % 3 == 0, F.lit("corpusloom-output-")).otherwise("x-")
    renamed = samples.files(spark, sf).select(*ID, F.concat(F.lit("src/"), name, paths.basename(F.col("relative_path"))).alias("relative_path"))
    return corpus.include_files(renamed)


@register
def diagram_validity(spark, sf):
    """Diagram blocks made from the documents: of a known kind, of none, and blank."""
    kinds = F.array(F.lit("graph TD\n"), F.lit("nothing known\n"), F.lit(" \n"), F.lit("pie\n"))
    kind = F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int"))
    body = F.concat(kind, F.when(F.trim(F.replace(kind, F.lit("\n"))) == "", "").otherwise(F.translate("text", "`", "")))
    content = F.concat(F.lit("a ```mermaid\n"), body, F.lit("``` b"))
    docs = read_table(spark, sf, "documents").select(F.lit("p").alias("project"), F.col("doc_id").alias("file_id"), content.alias("content"))
    return blocks.extract_diagrams(docs).select("file_id", "is_valid")


@register
def hot_key_lookup(spark, sf):
    """The lookup join with every source hot, so that all of its keys are split."""
    docs, labels = read_table(spark, sf, "documents").select("doc_id", "source"), read_table(spark, sf, "labels")
    sums = docs.join(labels, "doc_id").groupBy("source").agg(F.sum("quality").cast("long").alias("good"))
    return lookup_join(docs, sums, ["source"], "doc_id", rows_per_task=5).select("doc_id", "source", "good")


@register
def dependency_parts(spark, sf):
    """The dependency text in parts of two names each."""
    return graph.dependency_summary(structure(samples.spread_files(spark, sf), "name", "dependencies"), per_part=2)


# --- graph ------------------------------------------------------------------------------------------


@register
def dependency_class(spark, sf):
    return _long_pos(graph.classify_dependencies(structure(samples.spread_files(spark, sf), "name", "dependencies")))


@register
def internal_deps(spark, sf):
    return graph.internal_dependencies(structure(samples.spread_files(spark, sf), "name", "dependencies"))


@register
def external_deps(spark, sf):
    return graph.external_dependencies(structure(samples.spread_files(spark, sf), "name", "dependencies"))


@register
def project_dependencies(spark, sf):
    deps = graph.project_dependencies(structure(samples.spread_files(spark, sf), "name", "dependencies"))
    return deps.withColumn("first_pos", F.col("first_pos").cast("long"))


@register
def project_connections(spark, sf):
    found = graph.project_connections(structure(samples.spread_files(spark, sf), "db_connections", "api_connections"))
    return found.withColumn("first_pos", F.col("first_pos").cast("long"))


@register
def component_counts(spark, sf):
    return graph.component_counts(structure(samples.spread_files(spark, sf), "name", "type", "n_functions", "dependencies"))


@register
def component_summary(spark, sf):
    return graph.component_summary(structure(samples.spread_files(spark, sf), "name", "type", "n_functions", "dependencies"))


@register
def dependency_summary(spark, sf):
    return graph.dependency_summary(structure(samples.spread_files(spark, sf), "name", "dependencies"))


@register
def component_edges(spark, sf):
    return _long_pos(graph.component_edges(structure(samples.spread_files(spark, sf), "name", "type", "dependencies")))


@register
def start_edges(spark, sf):
    return graph.start_edges(structure(samples.spread_files(spark, sf), "relative_path", "name", "type", "is_entry"))


GRAPH_COLUMNS = ["relative_path", "name", "type", "functions", "n_functions", "dependencies", "is_entry"]


@register
def graph_nodes(spark, sf):
    return graph.nodes(structure(samples.spread_files(spark, sf), *GRAPH_COLUMNS))


@register
def graph_edges(spark, sf):
    return graph.edges(structure(samples.spread_files(spark, sf), *GRAPH_COLUMNS))


@register
def graph_text(spark, sf):
    lines = graph.graph_lines(structure(samples.spread_files(spark, sf), *GRAPH_COLUMNS))
    return lines.withColumn("section", F.col("section").cast("long"))


@register
def architecture_report(spark, sf):
    rows = graph.architecture_report(structure(samples.spread_files(spark, sf), *graph.REPORT_COLUMNS))
    return rows.drop("section_no")


QUERIES["project_metrics"] = lambda spark, sf: project_metrics(samples.spread_files(spark, sf))


# --- cache --------------------------------------------------------------------------------------------


def _keyed(spark, sf) -> DataFrame:
    side = samples.file_side(samples.files(spark, sf))
    return cache.with_cache_key(side, F.col("key_path"), samples.CONFIG.key_parts())


def _looked_up(spark, sf, **options) -> DataFrame:
    return cache.cache_lookup(_keyed(spark, sf), samples.cache_seed(samples.files(spark, sf)), **options)


@register
def cache_keys(spark, sf):
    return _keyed(spark, sf).select(
        *ID, "cache_key",
        prompting.cache_key(F.col("key_path"), F.lit("issues"), F.lit(None), F.lit("p"), F.lit(None)).alias("partial_key"),
    )


@register
def cache_lookup(spark, sf):
    return _looked_up(spark, sf).select(*ID, "cache_key", "file_hash", "cache_status", "cached_explanation")


@register
def cache_lookup_by_metadata(spark, sf):
    return _looked_up(spark, sf, metadata_first=True).select(*ID, "cache_status", "cached_explanation")


@register
def cache_bypass(spark, sf):
    return _looked_up(spark, sf, use_cache=False).select(*ID, "cache_status")


@register
def cache_misses(spark, sf):
    return cache.cache_misses(_looked_up(spark, sf)).select(*ID, "cache_key", "file_hash", "file_size", "mtime_ms")


@register
def cache_upsert(spark, sf):
    seed = samples.cache_seed(samples.files(spark, sf))
    looked_up = materialize(_looked_up(spark, sf))
    answered = cache.cache_misses(looked_up).select(
        "cache_key", "file_hash", "file_size", "mtime_ms", F.concat(F.lit("answer "), F.col("file_id").cast("string")).alias("explanation")
    )
    return cache.cache_upsert(seed, answered.unionByName(cache.refreshed(looked_up, seed)))


# --- prompts and usage -----------------------------------------------------------------------------------


def _prompts(spark, sf) -> DataFrame:
    return prompts.build_prompts(samples.described(spark, sf).withColumn("mode", F.lit("explain")), samples.templates(spark))


@register
def file_prompts(spark, sf):
    return _prompts(spark, sf).select(*ID, "prompt", "input_tokens")


@register
def prompt_modes(spark, sf):
    modes = F.array(*[F.lit(m) for m in ("explain", "issues", "linebyline", "summary", "nosuchmode")])
    rows = samples.described(spark, sf).withColumn("mode", F.element_at(modes, (F.col("file_id") % 5 + 1).cast("int")))
    return prompts.build_prompts(rows, samples.templates(spark), F.lit("expert")).select(*ID, "mode", F.md5("prompt").alias("prompt_md5"))


@register
def token_estimates(spark, sf):
    turns = read_table(spark, sf, "conversations")
    odd = F.col("turn") % 2 == 1
    reported = F.when(odd & (F.col("conv_id") % 3 == 0), F.col("conv_id"))
    return turns.select(
        "conv_id", "turn",
        prompting.estimate_tokens(F.col("text")).alias("estimate"),
        prompting.estimate_tokens(F.col("text"), reported, F.col("turn"), F.when(odd, F.lit(5))).alias("with_reported"),
    )


def _answers(spark, sf) -> DataFrame:
    return infer.infer(
        explain.spread_calls(_prompts(spark, sf).select(*ID, "relative_path", "input_tokens", "prompt"), samples.CONFIG),
        samples.stub_client, attempts=0, delay=0.0,
    )


@register
def infer_stub(spark, sf):
    return _answers(spark, sf).select(*ID, "explanation", "error", F.col("attempts").cast("long").alias("attempts"), "input_tokens", "output_tokens")


@register
def map_batches(spark, sf):
    """Texts without accents, for which Spark has no function."""

    def plain(pdf):
        from unicodedata import combining, normalize

        return pdf.assign(plain=["".join(c for c in normalize("NFD", t) if not combining(c)) for t in pdf["text"]])[["doc_id", "plain"]]

    return infer.map_batches(read_table(spark, sf, "documents").select("doc_id", "text"), plain, "doc_id long, plain string")


@register
def answered_only(spark, sf):
    return infer.drop_failed(_answers(spark, sf)).select(*ID, "explanation")


def _explained(spark, sf) -> tuple[DataFrame, DataFrame]:
    files = samples.file_side(samples.files(spark, sf))
    seed = samples.cache_seed(samples.files(spark, sf))
    return explain.explain_corpus(files, seed, samples.templates(spark), samples.stub_client, samples.CONFIG, F.col("key_path"))


@register
def explain_corpus_stub(spark, sf):
    return _explained(spark, sf)[0].select(*ID, "relative_path", "language", "explanation", "cached", "error")


@register
def explain_corpus_cache(spark, sf):
    return _explained(spark, sf)[1].select("cache_key", "file_hash", "file_size", "mtime_ms", "explanation")


@register
def usage_summary(spark, sf):
    return prompts.usage_summary(_explained(spark, sf)[0], "project")


@register
def codebase_summary(spark, sf):
    rows = materialize(overview.overview_rows(samples.described(spark, sf)))
    pieces = overview.codebase_summary(rows.withColumn("summary", F.col("purpose")))
    return pieces.withColumn("section", F.col("section").cast("long"))


@register
def attached_summaries(spark, sf):
    rows = overview.overview_rows(samples.described(spark, sf))
    summaries = rows.filter(F.col("language") == "javascript").select(
        "project", "relative_path", "file_id", F.concat(F.lit("summary "), F.col("file_id").cast("string")).alias("summary")
    )
    return overview.attach_summaries(rows, summaries).select(*ID, "summary")


@register
def project_summaries_stub(spark, sf):
    answers, _ = overview.summarize_projects(
        samples.files(spark, sf), samples.templates(spark), samples.stub_client, explain.RunConfig(mode="arch", attempts=0, delay=0.0)
    )
    return answers.select("project", "relative_path", "language", "explanation", "input_tokens")


# --- blocks and reports -------------------------------------------------------------------------------------


@register
def diagram_blocks(spark, sf):
    return _long_pos(blocks.extract_diagrams(samples.files(spark, sf)))


@register
def wrapped_diagrams(spark, sf):
    return blocks.wrap_diagrams(samples.files(spark, sf)).select(*ID, "wrapped")


@register
def markdown_blocks(spark, sf):
    return _long_pos(blocks.extract_markdown_blocks(samples.files(spark, sf)))


@register
def unwrapped_markdown(spark, sf):
    return blocks.unwrap_markdown(samples.files(spark, sf)).select(*ID, "unwrapped")


@register
def html_tables(spark, sf):
    return _long_pos(
        blocks.extract_tables(samples.files(spark, sf)).select(*ID, "without_tables", F.posexplode("tables").alias("pos", "table_html"))
    )


@register
def tables_roundtrip(spark, sf):
    tables = blocks.restore_tables(blocks.extract_tables(samples.files(spark, sf)))
    return tables.select(*ID, (F.col("restored") == F.col("content")).alias("same"), F.size("tables").cast("long").alias("tables"))


@register
def page_titles_plain(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@register
def page_paths(spark, sf):
    url = F.col("url")
    return read_table(spark, sf, "pages").select(
        "page_id", paths.basename(url).alias("base"), paths.dirname(url).alias("dir"), paths.extension(url).alias("ext"), paths.stem(url).alias("stem")
    )


@register
def path_labels(spark, sf):
    title = F.concat(F.lit("Report: "), "relative_path", F.lit(", a\\b.py,"), F.col("project"))
    return report.labels(samples.files(spark, sf), title, "Report").select(*ID, "label")


@register
def report_sections(spark, sf):
    rows = samples.described(spark, sf).withColumn("explanation", F.when(F.col("file_id") % 3 != 0, classify.purpose(F.col("relative_path"), F.col("content"))))
    return report.report_sections(rows).withColumn("section", F.col("section").cast("long"))


@register
def project_sections(spark, sf):
    rows = corpus.offline_results(samples.described(spark, sf), "architecture").withColumn("file_id", F.xxhash64("project"))
    return report.report_sections(rows, "architecture").withColumn("section", F.col("section").cast("long"))


@register
def resolved_imports(spark, sf):
    """Every file imports four places and itself; files named index stand for their folder."""
    path = F.col("relative_path")
    files = samples.files(spark, sf).select(*ID, F.regexp_replace(path, "index_[0-9]", "index").alias("relative_path"))
    stem = paths.stem(path)
    imports = F.concat(
        F.lit("import a from './"), stem, F.lit("';\nimport b from '../web/./"), stem, F.lit("';\nimport d from '../../../out';\nimport e from '.';\nconst c = require('./x/../"),
        paths.basename(path), F.lit("');\n"),
    )
    return graph.resolved_imports(files.withColumn("content", imports)).withColumn("pos", F.col("pos").cast("long"))


# --- text functions -------------------------------------------------------------------------------------------


@register
def format_bytes(spark, sf):
    size = F.octet_length("text").cast("long")
    docs = read_table(spark, sf, "documents")
    return docs.select(
        "doc_id", text.format_bytes(size).alias("bytes"), text.format_bytes(size * 1000).alias("larger"),
        text.format_bytes(size * 1048576, 0).alias("rounded"), text.format_bytes(F.col("doc_id") % 2).alias("tiny"),
    )


@register
def kebab(spark, sf):
    stem = paths.stem(F.col("relative_path"))
    return samples.files(spark, sf).select(
        *ID, text.kebab(stem).alias("kebab"), text.capitalize_first(stem).alias("capital"), text.escape_regex(F.col("relative_path")).alias("escaped"),
        text.unique_id(F.col("file_id")).alias("unique_id"),
    )


@register
def truncated(spark, sf):
    value = F.col("text")
    return read_table(spark, sf, "documents").select(
        "doc_id", text.truncate(value, 100).alias("t100"), text.truncate(value, 3).alias("t3"), text.truncate(F.col("source"), 4).alias("t4")
    )


@register
def escaped_html(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@register
def human_lists(spark, sf):
    words = F.split("text", " ")
    docs = read_table(spark, sf, "documents")
    count = F.size(words)
    return docs.select(
        "doc_id", text.human_list(words).alias("listed"), text.human_list(F.slice(words, 1, 2)).alias("pair"),
        F.concat(count.cast("string"), F.lit(" "), text.pluralize(count, "word", "words")).alias("counted"),
    )


@register
def event_dates(spark, sf):
    return read_table(spark, sf, "events").select("event_id", text.format_date(F.col("ts")).alias("shown"))


@register
def normal_lines(spark, sf):
    windows = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    return read_table(spark, sf, "documents").select("doc_id", text.unix_newlines(windows).alias("unix"))


# --- safety ------------------------------------------------------------------------------------------------------


def _words(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.explode(F.split("text", r"[ \n]")).alias("word")).select("word").distinct()


@register
def safe_names(spark, sf):
    word: Column = F.col("word")
    return _words(read_table(spark, sf, "documents")).select(
        "word", safety.is_valid_package(word).alias("package"), safety.is_safe_function(word).alias("function"),
        safety.is_safe_dependency(word).alias("dependency"), safety.is_safe_connection(word).alias("connection"),
        safety.is_safe_endpoint(word).alias("endpoint"),
    )


@register
def masked_names(spark, sf):
    word: Column = F.col("word")
    return _words(read_table(spark, sf, "documents")).select(
        "word", safety.sanitize_dependency(word).alias("dependency"), safety.sanitize_connection(word).alias("connection"),
        safety.sanitize_endpoint(word).alias("endpoint"), safety.display_name(word).alias("component"),
        safety.display_name(word).alias("function"), text.plain_label(word).alias("label"),
    )


@register
def secret_masking(spark, sf):
    value = F.col("text")
    return read_spread(spark, sf, "documents", "doc_id").select(
        "doc_id", safety.display_name(value).alias("component"), safety.sanitize_connection(value).alias("connection"),
        safety.sanitize_endpoint(value).alias("endpoint"),
    )


# --- overlays ---------------------------------------------------------------------------------------------------------


@register
def overlay_labels(spark, sf):
    docs, labels = read_table(spark, sf, "documents").select("doc_id", "source"), read_table(spark, sf, "labels")
    own = labels.select("doc_id", F.col("quality").cast("long").alias("value"))
    votes = docs.join(labels, "doc_id").groupBy("source", "quality").agg(F.count("*").alias("n"))
    majority = votes.groupBy("source").agg(F.max_by("quality", F.struct("n", "quality")).cast("long").alias("value"))
    by_source = lookup_join(docs, majority, ["source"], "doc_id").select("doc_id", "value")
    constant = docs.select("doc_id", F.lit(0).cast("long").alias("value"))
    return overlay.overlay([own, by_source, constant], ["doc_id"]).withColumn("layer_priority", F.col("layer_priority").cast("long"))


@register
def merge_props(spark, sf):
    props = F.from_json("props", "map<string,string>")
    changes = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("k"), F.col("event_type"))).otherwise(F.create_map(F.lit("u"), F.col("user_id").cast("string")))
    merged = nested.merge_maps(props, changes)
    return read_table(spark, sf, "events").select(
        "event_id", F.element_at(merged, "k").alias("k"), F.element_at(merged, "u").alias("u"), F.size(merged).cast("long").alias("size")
    )


@register
def merge_structs(spark, sf):
    events = read_table(spark, sf, "events").select(
        "event_id",
        F.struct(F.col("event_type").alias("a"), F.struct(F.col("user_id").alias("x"), F.col("value").alias("y")).alias("b")).alias("left"),
        F.struct(
            F.when(F.col("event_id") % 2 == 0, F.lit("new")).alias("a"),
            F.struct(F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("long")).alias("x"), F.lit("z").alias("z")).alias("b"),
        ).alias("right"),
    )
    merged = nested.deep_merge(F.col("left"), F.col("right"), events.schema["left"].dataType, events.schema["right"].dataType)
    return events.select("event_id", merged.alias("m")).select("event_id", "m.a", "m.b.x", "m.b.y", "m.b.z")


@register
def merge_variants(spark, sf):
    """Settings of no fixed shape: nested objects, replaced arrays, kept nulls, an object that gives way to a text."""
    events = read_table(spark, sf, "events")
    kind = F.col("event_id") % 5
    change = (
        F.when(kind == 0, F.concat(F.lit('{"base":{"props":{"k":"'), "event_type", F.lit('","new":{"u":'), F.col("user_id").cast("string"), F.lit('}},"n":null}}')))
        .when(kind == 1, F.concat(F.lit('{"base":{"list":['), F.col("event_id").cast("string"), F.lit(']},"tag":{"t":1}}')))
        .when(kind == 2, F.lit('{"base":"flat"}'))
        .when(kind == 3, F.lit("7"))
    )
    left = F.parse_json(F.concat(F.lit('{"base":{"props":'), "props", F.lit(',"n":1,"list":[1,2]},"tag":"x"}')))
    merged = events.select("event_id", nested.merge_variants(left, F.parse_json(change)).alias("m"))
    return merged.select(
        "event_id",
        F.try_variant_get("m", "$.base.props.k", "string").alias("k"),
        F.try_variant_get("m", "$.base.props.new.u", "long").alias("u"),
        F.try_variant_get("m", "$.base.n", "long").alias("n"),
        F.is_variant_null(F.try_variant_get("m", "$.base.n", "variant")).alias("n_is_null"),
        F.to_json(F.try_variant_get("m", "$.base.list", "variant")).alias("list"),
        F.to_json(F.try_variant_get("m", "$.tag", "variant")).alias("tag"),
        F.when(F.schema_of_variant(F.try_variant_get("m", "$.base", "variant")) == "STRING", F.try_variant_get("m", "$.base", "string")).alias("flat"),
    )


# --- streaming ------------------------------------------------------------------------------------------------------------


@register
def stream_usage(spark, sf):
    """Files arriving in three lots (four with a rest), explained as they come, with running totals per project."""
    from uuid import uuid4

    base = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    files = samples.file_side(samples.files(spark, sf)).drop("relative_path").withColumnRenamed("key_path", "relative_path")
    files.write.option("maxRecordsPerFile", max(1, files.count() // 3)).parquet(f"{base}/in")
    store = CacheStore(spark, f"{base}/cache")
    arriving = incremental.file_stream(spark, f"{base}/in", files.schema, max_files=samples.lot_size(spark, f"{base}/in"))
    incremental.explain_stream(
        arriving, store, f"{base}/results", f"{base}/c1", samples.templates(spark), samples.stub_client, samples.CONFIG
    ).awaitTermination()
    results = spark.readStream.schema(spark.read.parquet(f"{base}/results").schema).parquet(f"{base}/results")
    incremental.usage_stream(results, f"{base}/usage", f"{base}/c2").awaitTermination()
    return incremental.latest_usage(spark, f"{base}/usage")
