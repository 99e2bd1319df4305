"""Cache, prompts, model calls, overview, report and stream on small inputs."""

import os
import sys
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom.catalog import samples
from corpusloom.operators import blocks, cache, corpus, extract, graph, infer, overlay, prompts, report
from corpusloom.plans import explain, overview
from corpusloom.plans.structure import analyze, structure
from corpusloom.session import materialize, shared_folder
from corpusloom.sources import cache_store, sinks
from corpusloom.sources.cache_store import CacheStore
from corpusloom.sources.templates import load_templates
from corpusloom.streaming import incremental

CONFIG = samples.CONFIG
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def files(spark, sf_dir):
    return samples.file_side(samples.files(spark, sf_dir))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- structure ----------------------------------------------------------------------------------


def test_expected_extraction_per_extension(spark, sf_dir):
    records = extract.extract_structure(samples.files(spark, sf_dir))
    seen = {}
    for r in records.collect():
        seen.setdefault(os.path.splitext(r.relative_path)[1], []).append(r)
    for r in seen[".ts"]:
        assert [(f.name, f.type) for f in r.functions] == [("saveAll", "setter"), ("handleEvent", "handler")]
        assert r.dependencies == ["@scope/kit", "{"] and not r.is_entry
    for r in seen[".py"]:
        assert [f.name for f in r.functions] == ["validate_row"] and r.dependencies[1:] == ["os", "run"]
        assert r.is_entry and "db01.example.org" in r.db_connections
    for r in seen[".js"]:
        assert r.dependencies[1:] == ["mysql", "helper"] and r.databases[:2] == ["mysql", "db"] and r.api_connections == ["https://api.example.com"]
    for r in seen[".java"]:
        assert r.dependencies == ["java.util.List"] and r.functions == [] and r.is_entry
    for r in seen[".go"]:
        assert r.dependencies == ["fmt"] and [f.type for f in r.functions] == ["validator"]
    for r in seen[".rs"]:
        assert r.dependencies == ["serde"] and [f.type for f in r.functions] == ["converter"]


def tiny_project(spark):
    data = [
        (0, "p", "src/a.js", "import b from 'b';\nimport x from 'react';\nfunction one() {}\nfunction two() {}\nfunction three() {}"),
        (1, "p", "src/b.js", "import a from 'a'"),
        (2, "p", "lib/a.py", "import b"),
        (3, "p", "main.js", ""),
        (4, "p", "src/mainframe.js", ""),
    ]
    return spark.createDataFrame(data, "file_id long, project string, relative_path string, content string")


def test_graph_text_of_a_small_project(spark):
    lines = graph.graph_lines(structure(tiny_project(spark))).orderBy("section", "i", "j", "k")
    assert [r.line for r in lines.collect()] == [
        "flowchart TD", '    START[("Start")]', '    ENTRY1[("main (entry point)")]', "    START --> ENTRY1",
        '    COMP1["a - Function"]', "COMP1 --> COMP2",
        '    COMP1 --> FUNC1_1["one()"]', '    COMP1 --> FUNC1_2["two()"]', '    COMP1 --> FUNC1_MORE["1 more funcs"]',
        '    COMP2["b - Component"]', "COMP2 --> COMP3", '    COMP3["a - Component"]', "COMP3 --> COMP2",
        '    COMP4("main - Main")', '    COMP5("mainframe - Main")', "    START --> COMP5",
        '    END[("End")]', *[f"    COMP{i} --> END" for i in range(1, 6)],
    ]


def test_graph_invariants(spark, sf_dir):
    parts = analyze(samples.files(spark, sf_dir))
    records = parts["records"]
    both = graph.internal_dependencies(records).union(graph.external_dependencies(records))
    every = graph.dependency_rows(records).select("project", "dependency").distinct()
    assert rows(both, "project", "dependency") == rows(every, "project", "dependency")
    known = {(r.project, r.node_id) for r in parts["nodes"].collect()}
    for edge in parts["edges"].collect():
        assert (edge.project, edge.src) in known and (edge.project, edge.dst) in known
    split = records.repartition(13)
    assert rows(graph.graph_lines(split), "project", "section", "i", "j", "k", "line") == rows(parts["diagram"], "project", "section", "i", "j", "k", "line")


def test_relative_imports_can_be_kept(spark):
    df = spark.createDataFrame([("import x from './util/b.js'; import { y } from 'z'",)], "t string")
    assert df.select(extract.dependencies(F.col("t"))).first()[0] == ["z", "{"] or df.select(extract.dependencies(F.col("t"))).first()[0][0] == "z"
    assert "b" in df.select(extract.dependencies(F.col("t"), strict=True, resolve_relative=True)).first()[0]


def test_dependency_summary_continues_in_parts(spark):
    records = structure(tiny_project(spark), "name", "dependencies")
    whole = graph.dependency_summary(records).orderBy("kind", "part").collect()
    cut = graph.dependency_summary(records, per_part=1).orderBy("kind", "part").collect()
    for kind in ("external", "internal"):
        assert "".join(r.text for r in cut if r.kind == kind) == "".join(r.text for r in whole if r.kind == kind)


def test_empty_corpus(spark):
    empty = tiny_project(spark).limit(0)
    assert all(df.count() == 0 for df in analyze(empty).values())


def test_path_collisions(spark):
    data = [(0, "p", "a/x.js"), (1, "p", "a/x.js"), (2, "p", "a\\x.js"), (3, "q", "a/x.js")]
    df = spark.createDataFrame(data, "file_id long, project string, relative_path string")
    assert rows(corpus.dedupe_paths(df), "file_id", "tree_path") == [(0, "a/x.js"), (1, "a/x_1.js"), (2, "a/x_2.js"), (3, "a/x.js")]
    same_ids = spark.createDataFrame([(0, "p", "a.js"), (1, "p", "a.js"), (0, "q", "a.js"), (1, "q", "b.js")], df.schema)
    assert rows(corpus.dedupe_paths(same_ids), "project", "file_id", "tree_path") == [("p", 0, "a.js"), ("p", 1, "a_1.js"), ("q", 0, "a.js"), ("q", 1, "b.js")]


# --- cache ----------------------------------------------------------------------------------------


def test_cache_tiers_agree_with_metadata_first(files):
    keyed = cache.with_cache_key(files, F.col("key_path"), CONFIG.key_parts())
    seed = samples.cache_seed(files)
    plain = cache.cache_lookup(keyed, seed)
    status = dict(rows(plain, "file_id", "cache_status"))
    assert all(status[i] == ["hit", "refresh", "miss", "miss"][i % 4] for i in status)
    assert rows(cache.cache_lookup(keyed, seed, metadata_first=True), "file_id", "cache_status") == sorted(status.items())
    assert {s for _, s in rows(cache.cache_lookup(keyed, seed, use_cache=False), "file_id", "cache_status")} == {"miss"}


def test_files_scanned_twice_share_a_cache_row(spark, files):
    twice = files.union(files.withColumn("file_id", F.col("file_id") + 1000))
    keyed = cache.with_cache_key(twice, F.col("key_path"), CONFIG.key_parts())
    seed = samples.cache_seed(files)
    for metadata_first in (False, True):
        looked = cache.cache_lookup(keyed, seed, metadata_first=metadata_first)
        assert looked.count() == twice.count() and looked.select("file_id").distinct().count() == twice.count()
    assert cache.refreshed(cache.cache_lookup(keyed, seed), seed).count() == files.filter("file_id % 4 = 1").count()
    fresh = cache.cache_misses(cache.cache_lookup(keyed, seed)).select("cache_key", "file_hash", "file_size", "mtime_ms", F.lit("x").alias("explanation"))
    assert cache.cache_upsert(seed, fresh).count() == files.count()


def test_cache_store_versions(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "cache"))
    assert store.read().count() == 0
    entry = "cache_key string, file_hash string, file_size long, mtime_ms long, explanation string"
    store.write(spark.createDataFrame([("a", "h", 1, 1, "one"), ("b", "h", 1, 1, "b")], entry))
    second = store.write(spark.createDataFrame([("a", "h2", 1, 1, "two")], entry))
    assert rows(store.read(), "cache_key", "explanation") == [("a", "two"), ("b", "b")]
    assert rows(store.read(before=second), "cache_key", "explanation") == [("a", "one"), ("b", "b")]
    store.write(spark.createDataFrame([("a", "h3", 1, 1, "again")], entry), second)  # the same version, written again
    assert rows(store.read(), "cache_key", "explanation") == [("a", "again"), ("b", "b")]
    store.write(spark.createDataFrame([("a", "h2", 1, 1, "two")], entry), second)
    small = store.compact(str(tmp_path / "compacted"))
    assert rows(small.read(), "cache_key", "explanation") == [("a", "two"), ("b", "b")]


ENTRY = "cache_key string, file_hash string, file_size long, mtime_ms long, explanation string"


def entries(spark, names, text):
    return spark.createDataFrame([(n, "h", 1, 1, f"{text} {n}") for n in names], ENTRY)


def test_many_batches_leave_few_files(spark, tmp_path, monkeypatch):
    for name, value in (("FAN", 3), ("KEPT", 4), ("TIER_ROWS", 5), ("BUCKET_ROWS", 10)):
        monkeypatch.setattr(cache_store, name, value)
    store = CacheStore(spark, str(tmp_path / "cache"))
    run, expected, most = store.begin(), {}, 0
    for batch in range(40):
        names = [f"k{(batch * 7 + i) % 90}" for i in range(1 + batch % 5)]
        store.write(entries(spark, names, f"b{batch}").coalesce(1), run, batch)
        expected |= {n: f"b{batch} {n}" for n in names}
        most = max(most, len(store.segments()))
        assert len(os.listdir(tmp_path / "cache" / "log")) <= 2 * (cache_store.KEPT + 2)  # a checksum beside each
    assert dict(rows(store.read(), "cache_key", "explanation")) == expected
    assert most <= 12 and len(os.listdir(tmp_path / "cache" / "data")) <= 12 + 4 * cache_store.KEPT
    assert any(s["buckets"] > 1 for s in store.segments())
    (tmp_path / "cache" / "data" / "left-by-a-failure").mkdir()
    assert store.sweep() == 1 and dict(rows(store.read(), "cache_key", "explanation")) == expected


def test_few_keys_read_few_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache_store, "BUCKET_ROWS", 20)
    store = CacheStore(spark, str(tmp_path / "cache"))
    store.write(entries(spark, [f"k{i}" for i in range(1000)], "old"))
    store.write(entries(spark, ["k5"], "new"))
    large = store.segments()[0]
    assert large["buckets"] == 64 and len(os.listdir(tmp_path / "cache" / "data" / large["folder"] / "buckets=64")) > 40
    found = store.read(keys=spark.createDataFrame([("k5",), ("k6",), ("none",)], "cache_key string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:300]
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 1 and "IN" in scans[0]
    assert rows(found, "cache_key", "explanation") == [("k5", "new k5"), ("k6", "old k6")]


def test_no_reader_sees_a_version_that_is_not_committed(spark, tmp_path, monkeypatch):
    store = CacheStore(spark, str(tmp_path / "cache"))
    store.write(entries(spark, ["a"], "one"))

    def fails(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(CacheStore, "_commit", fails)
        store.write(entries(spark, ["a", "b"], "two"), cache_store.Run(2, "x"))
    assert rows(store.read(), "cache_key", "explanation") == [("a", "one a")]
    assert store.sweep() == 1
    other = CacheStore(spark, str(tmp_path / "cache"))  # another writer commits first
    state = store._state
    with monkeypatch.context() as patch:
        calls = []

        def late():
            found = state()
            if not calls:
                calls.append(1)
                other.write(entries(spark, ["c"], "other"))
            return found

        patch.setattr(store, "_state", late)
        store._commit(lambda live: ([], []), 9)
    assert rows(store.read(), "cache_key") == [("a",), ("c",)] and store._state()[1]["seq"] == 9


def test_a_replayed_batch_sees_what_it_saw(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache_store, "FAN", 2)
    store = CacheStore(spark, str(tmp_path / "cache"))
    store.write(entries(spark, ["a", "b"], "before"))
    run = store.begin(str(tmp_path / "check"))
    for batch in range(6):
        seen = rows(store.read(before=run, batch=batch), "cache_key", "explanation")
        store.write(entries(spark, ["a", f"n{batch}"], f"b{batch}"), run, batch)
        assert rows(store.read(before=run, batch=batch), "cache_key", "explanation") == seen  # the batch is run again
        store.write(entries(spark, ["a"], f"again{batch}"), run, batch)
        assert rows(store.read(before=run, batch=batch + 1), "cache_key", "explanation")[0] == ("a", f"again{batch} a")
        assert not any(k == f"n{batch}" for k, _ in rows(store.read(), "cache_key", "explanation"))
    assert store.begin(str(tmp_path / "check")) == run


def test_second_run_is_all_hits(spark, files, tmp_path):
    store = CacheStore(spark, str(tmp_path / "cache"))
    templates = samples.templates(spark)
    results, fresh = explain.explain_corpus(files, store.read(), templates, lambda: lambda row: "ok " + row["relative_path"], CONFIG, F.col("key_path"))
    assert results.filter("cached").count() == 0
    store.write(fresh)

    def no_calls():
        def call(row):
            raise AssertionError("the model was called")

        return call

    again, more = explain.explain_corpus(files, store.read(), templates, no_calls, CONFIG, F.col("key_path"))
    assert again.filter("cached").count() == files.count() and more.count() == 0
    assert rows(again, "file_id", "explanation") == rows(results, "file_id", "explanation")
    changed = files.withColumn("content", F.when(F.col("file_id") == 5, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    changed = samples.file_side(changed.drop("file_size", "mtime_ms", "key_path"))
    third, _ = explain.explain_corpus(changed, store.read(), templates, lambda: lambda row: "new", CONFIG, F.col("key_path"))
    assert rows(third.filter("NOT cached"), "file_id", "explanation") == [(5, "new")]


def test_projects_with_equal_paths_keep_their_own_answers(spark):
    data = [(0, "a", "src/index.js", "one", 3, 5), (0, "b", "src/index.js", "two", 3, 5)]
    df = spark.createDataFrame(data, "file_id long, project string, relative_path string, content string, file_size long, mtime_ms long")
    first, fresh = explain.explain_corpus(df, spark.createDataFrame([], cache.CACHE_SCHEMA), samples.templates(spark), lambda: lambda row: "ans " + row["project"], CONFIG)
    assert rows(first, "project", "explanation") == [("a", "ans a"), ("b", "ans b")]
    store = materialize(fresh)
    assert store.select("cache_key").distinct().count() == 2
    again, _ = explain.explain_corpus(df, store, samples.templates(spark), broken_client, CONFIG)
    assert rows(again.filter("cached"), "project", "explanation") == [("a", "ans a"), ("b", "ans b")]
    placed = df.withColumn("path", F.concat(F.lit("/x/"), "project", F.lit("/"), "relative_path")).withColumn("project", F.lit("app"))
    placed = placed.withColumn("file_id", F.xxhash64("path"))
    keys = cache.with_cache_key(placed, cache.full_path(placed), CONFIG.key_parts())
    assert keys.select("cache_key").distinct().count() == 2


def broken_client():
    def call(row):
        raise AssertionError("the model was called")

    return call


def test_two_contents_under_one_key_are_an_error(spark):
    entry = "cache_key string, file_hash string, file_size long, mtime_ms long, explanation string"
    fresh = spark.createDataFrame([("k", "h1", 1, 1, "a"), ("k", "h2", 1, 1, "b")], entry)
    with pytest.raises(Exception, match="two contents share the cache key k"):
        cache.cache_upsert(fresh.limit(0), fresh).collect()


def test_a_warm_run_reads_no_content(spark, files):
    keyed = cache.with_cache_key(files, F.col("key_path"), CONFIG.key_parts())
    known = keyed.select("cache_key", F.sha2("content", 256).alias("file_hash"), "file_size", "mtime_ms", F.lit("x").alias("explanation"))
    seed = materialize(known)
    looked = cache.cache_lookup(keyed, seed, metadata_first=True)
    assert "content" not in looked._jdf.queryExecution().optimizedPlan().toString() and "sha2" not in looked._jdf.queryExecution().toString()
    assert looked.filter("cache_status <> 'hit'").count() == 0


def test_texts_are_shuffled_once_for_misses(spark, files, monkeypatch):
    seen = []
    kept = explain.call_model
    monkeypatch.setattr(explain, "call_model", lambda rows, *args: (seen.append(rows), kept(rows, *args))[1])
    explain.explain_corpus(files.repartition(4), samples.cache_seed(files), samples.templates(spark), samples.stub_client, CONFIG, F.col("key_path"))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1


def test_secrets_are_not_stored(spark, files):
    _, fresh = explain.explain_corpus(files, samples.cache_seed(files), samples.templates(spark), samples.stub_client, CONFIG, F.col("key_path"))
    assert set(fresh.select("config.*").columns) == {"mode", "level", "provider", "model"}


# --- prompts ----------------------------------------------------------------------------------------


def test_template_precedence(spark, tmp_path):
    for layer, name, body in (("d", "explain", "default {{language}}"), ("d", "issues", "issues"), ("u", "explain", "mine {{language}}")):
        folder = tmp_path / layer
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.md").write_text(body + "\nline two")
    templates = load_templates(spark, str(tmp_path / "d"), str(tmp_path / "u"))
    modes = spark.createDataFrame([("explain", "c"), ("issues", "c"), ("other", "c")], "mode string, language string")
    got = dict(rows(prompts.pick_template(modes, templates), "mode", "template"))
    assert got["explain"] == "mine {{language}}\nline two" and got["issues"] == "issues\nline two" and got["other"] == prompts.FALLBACK_TEMPLATE
    built = prompts.build_prompts(modes, templates, F.lit("expert")).filter("mode = 'explain'").first()
    assert built.prompt == "mine c\nline two\n\nIMPORTANT: Always respond in markdown format."


def test_templates_are_bounded(spark, monkeypatch):
    modes = spark.createDataFrame([(m,) for m in ("explain", "arch", "other")] * 4, "mode string")
    got = prompts.pick_template(modes, samples.templates(spark))
    expected = {"explain": samples.USER_TEMPLATE, "arch": prompts.DEFAULT_TEMPLATES["architecture"], "other": prompts.FALLBACK_TEMPLATE}
    assert rows(got, "mode", "template") == sorted(list(expected.items()) * 4)
    for name in ("MAX_TEMPLATES", "MAX_TEMPLATE_CHARS"):
        with monkeypatch.context() as patch, pytest.raises(ValueError):
            patch.setattr(prompts, name, 2)
            prompts.pick_template(modes, samples.templates(spark))
    assert prompts.pick_template(modes, samples.templates(spark).limit(0)).select("template").distinct().first()[0] == prompts.FALLBACK_TEMPLATE


def test_level_and_alias(spark):
    df = spark.createDataFrame([("arch", "the summary", "expert"), ("onboarding", "the summary", "x")], "mode string, codebase_summary string, level string")
    made = dict(rows(prompts.build_prompts(df, prompts.default_templates(spark), F.col("level")), "mode", "prompt"))
    assert "an expert developer" in made["arch"] and "the summary" in made["arch"] and "the summary" in made["onboarding"]


def test_usage_summary(spark):
    df = spark.createDataFrame(
        [(100, 50, False, None), (7, 0, False, "failed"), (None, None, True, None)], "input_tokens long, output_tokens long, cached boolean, error string"
    )
    assert tuple(prompts.usage_summary(df).first()) == (107, 50, 150, 1, 2)


# --- model calls ----------------------------------------------------------------------------------------


def test_retry_doubles_the_wait():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("busy")
        return "ok"

    assert infer.with_retry(flaky, 3, 1.0, waits.append) == ("ok", 3) and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        infer.with_retry(lambda: (_ for _ in ()).throw(ValueError("no")), 0, 1.0, waits.append)
    assert waits == [1.0, 2.0]


def counting_client():
    seen = {}

    def call(row):
        seen[row["file_id"]] = seen.get(row["file_id"], 0) + 1
        if row["file_id"] == 1:
            raise ValueError("broken")
        if row["file_id"] == 2 and seen[2] < 3:
            raise ValueError("busy")
        return {"text": "answer", "prompt_tokens": 9, "completion_tokens": 4} if row["file_id"] == 3 else "four" * 2

    return call


def test_infer_isolates_failures(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "file_id long, prompt string").repartition(2)
    got = {r.file_id: r for r in infer.infer(df, counting_client, attempts=3, delay=0.0).collect()}
    assert got[1].explanation == "Error generating explanation: broken" and got[1].error == "broken" and got[1].attempts == 4 and got[1].output_tokens == 0
    assert got[2].attempts == 3 and got[2].error is None and got[2].output_tokens == 2
    assert got[3].output_tokens == 4 and got[3].prompt_tokens == 9
    assert sorted(r.file_id for r in infer.drop_failed(infer.infer(df, counting_client, attempts=0, delay=0.0)).collect()) == [0, 3, 4]


def test_odd_replies_are_errors_of_their_row(spark):
    replies = [None, {}, 7, {"text": 3}, {"text": "ok", "completion_tokens": 2.5, "prompt_tokens": True}, b"bytes", ["x"], {"text": "\ud800"}, {"text": "n", "total_tokens": 2**70}]
    df = spark.createDataFrame([(i, "p") for i in range(len(replies))], "file_id long, prompt string").repartition(3)
    got = {r.file_id: r for r in infer.infer(df, lambda: lambda row: replies[row["file_id"]], attempts=1, delay=0.0).collect()}
    for i in (0, 1, 2, 3, 5, 6):
        assert got[i].error.startswith("the reply has no text") and got[i].explanation.endswith(got[i].error) and got[i].attempts == 2
    assert (got[4].explanation, got[4].completion_tokens, got[4].prompt_tokens, got[7].explanation, got[8].reported_tokens) == ("ok", None, None, "?", None)

    def no_client():
        raise OSError("no key")

    assert {r.error for r in infer.infer(df, no_client, attempts=0).collect()} == {"no client: no key"}


def test_a_task_that_runs_again_asks_for_the_rest_only(tmp_path):
    rows = pd.DataFrame({"file_id": range(40), "prompt": ["p"] * 40, "_request": [f"r{i}" for i in range(40)]})
    asked = []

    def client(dies_after):
        def call(row):
            if len(asked) >= dies_after:
                raise KeyboardInterrupt  # the task ends here
            asked.append(row["file_id"])
            if row["file_id"] == 5:
                raise ValueError("broken")
            return f"answer {row['file_id']}"

        return lambda: call

    def run(factory):
        return list(infer.answer_rows(iter([rows[:25], rows[25:]]), factory, 2, 0, 0.0, "s", None, infer.Journal(str(tmp_path / "part=3"))))

    with pytest.raises(KeyboardInterrupt):
        run(client(20))
    first = len(asked)
    assert 20 <= first <= 22
    found = run(client(10**9))
    assert len(asked) <= 40 + 4 and set(asked) == set(range(40))  # what was under way is asked again, nothing else
    answers = [a for _, part in found for a in part]
    assert [a["text"] for a in answers] == [None if i == 5 else f"answer {i}" for i in range(40)] and answers[5]["error"] == "broken"
    again = len(asked)
    run(client(0))
    assert len(asked) == again


def test_a_later_run_asks_for_what_failed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "file_id long, prompt string").repartition(4)
    journal, calls = str(tmp_path / "journal"), tmp_path / "calls"
    calls.mkdir()

    def client(name, fails):
        def call(row):
            (calls / f"{name}-{row['file_id']}").touch()
            if row["file_id"] in fails:
                raise ValueError("down")
            return {"text": f"{name} {row['file_id']}", "total_tokens": 4}

        return lambda: call

    first = infer.infer(df, client("one", {3, 4}), attempts=0, journal=journal)
    assert first.filter("error is not null").count() == 2
    assert first.count() == 30 and len(os.listdir(calls)) == 30  # the second action asks nobody
    second = infer.infer(df.union(spark.createDataFrame([(99, "new")], df.schema)), client("two", set()), attempts=0, journal=journal)
    got = {r.file_id: r for r in second.collect()}
    assert len(got) == 31 and {i for i, r in got.items() if r.explanation.startswith("two")} == {3, 4, 99}
    assert got[7].reported_tokens == 4 and got[7].output_tokens == 4 and len([c for c in os.listdir(calls) if c.startswith("two")]) == 3


def test_calls_of_a_partition_share_their_rate():
    now, waits = [0.0], []
    bucket = infer.TokenBucket(2.0, 1, lambda: now[0], waits.append)
    for _ in range(4):
        bucket.take()
    assert waits == [0.5, 1.0, 1.5]
    now[0] = 100.0
    bucket.take()
    assert len(waits) == 3


def test_observe_progress(spark):
    df = spark.createDataFrame([(1, None, False), (2, "e", False), (3, None, True)], "file_id long, error string, cached boolean")
    watched, seen = infer.observe_progress(df)
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"completed": 3, "failed": 1, "cached": 1}


def test_progress_and_batches(spark):
    df = spark.createDataFrame([("p", i) for i in range(1, 8)], "project string, file_id long")
    done = {r.file_id: r for r in corpus.progress(df).collect()}
    assert (done[1].completed, done[1].total, done[1].percent) == (1, 7, 14) and done[7].percent == 100
    assert [b for _, b in rows(corpus.assign_batches(df, 3), "file_id", "batch")] == [0, 0, 0, 1, 1, 1, 2]
    assert {b for _, b in rows(corpus.assign_batches(df, 99), "file_id", "batch")} == {0}


# --- overview ---------------------------------------------------------------------------------------------


def echo_client():
    def call(row):
        return f"about {row['relative_path']}" if "whole code bases" not in row["system"] else row["prompt"]

    return call


def test_large_projects_are_described_in_rounds(spark, sf_dir):
    files = samples.files(spark, sf_dir).filter("project in ('src0', 'src1')")
    config = explain.RunConfig(mode="architecture", attempts=0, delay=0.0)
    whole, _ = overview.summarize_projects(files, samples.templates(spark), echo_client, config)
    rounds, _ = overview.summarize_projects(files, samples.templates(spark), echo_client, config, tokens_per_prompt=60)
    assert rows(whole, "project", "rounds") == [("src0", 1), ("src1", 1)]
    assert rows(rounds, "project") == [("src0",), ("src1",)] and min(r.rounds for r in rounds.collect()) > 1
    first, last = whole.filter("project = 'src0'").first().explanation, rounds.filter("project = 'src0'").first().explanation
    for path in [r.relative_path for r in files.filter("project = 'src0'").collect()]:
        assert f"about {path}" in first and f"about {path}" in last
    assert first[first.index("## Technology Stack"):] == last[last.rindex("## Technology Stack"):]  # from the files in every round


def test_a_large_project_does_not_change_a_small_one(spark, sf_dir):
    source = samples.files(spark, sf_dir)
    small = source.filter("project = 'src1'").limit(2).withColumn("project", F.lit("small"))
    config = explain.RunConfig(mode="architecture", attempts=0, delay=0.0)
    alone, _ = overview.summarize_projects(small, samples.templates(spark), echo_client, config, tokens_per_prompt=60)
    both, _ = overview.summarize_projects(small.union(source.filter("project = 'src0'")), samples.templates(spark), echo_client, config, tokens_per_prompt=60)
    beside = both.filter("project = 'small'")
    assert rows(alone, "explanation", "rounds") == rows(beside, "explanation", "rounds")
    assert both.filter("project = 'src0'").first().rounds > 1


def test_failed_parts_are_told(spark, sf_dir):
    def broken_parts():
        def call(row):
            if "/part 1" in row["project"]:
                raise ValueError("down")
            return "fine"

        return call

    files = samples.files(spark, sf_dir).filter("project in ('src0', 'src1')")
    config = explain.RunConfig(mode="architecture", attempts=0, delay=0.0)
    answers, _ = overview.summarize_projects(files, samples.templates(spark), broken_parts, config, tokens_per_prompt=60)
    for r in answers.collect():
        assert r.failed_parts == 1 and r.error.startswith("1 of ") and r.explanation.endswith("parts failed")


def test_project_answers_are_cached(spark, sf_dir, tmp_path):
    files = samples.files(spark, sf_dir).filter("project in ('src0', 'src1')")
    config = explain.RunConfig(mode="arch", attempts=0, delay=0.0)
    store = CacheStore(spark, str(tmp_path / "cache"))
    answers, fresh = overview.summarize_projects(files, samples.templates(spark), echo_client, config)
    assert fresh.count() == files.count() + 2 and answers.filter("cached").count() == 0
    store.write(fresh)
    again, _ = overview.summarize_projects(files, samples.templates(spark), echo_client, config, cache=store.read())
    assert again.filter("cached").count() == 2 and rows(again, "project", "explanation") == rows(answers, "project", "explanation")


def test_project_errors_name_the_mode(spark, sf_dir):
    def broken():
        def call(row):
            raise ValueError("down")

        return call

    files = samples.files(spark, sf_dir).filter("project = 'src0'")
    answers, fresh = overview.summarize_projects(files, samples.templates(spark), broken, explain.RunConfig(mode="onboarding", attempts=0))
    assert [r.explanation for r in answers.collect()] == ["Error generating onboarding analysis: down"] and fresh.count() == 0


def test_codebase_summary_text(spark):
    described = corpus.detect_language(tiny_project(spark))
    listed = overview.overview_rows(described).withColumn("summary", F.col("purpose"))
    document = overview.whole_documents(overview.codebase_summary(listed)).first().codebase_summary
    assert document.startswith("# Codebase Summary\n\n## Project Structure\n\n### src\n\n- **a.js** (javascript): Contains code for a module\n- **b.js**")
    assert "### Root Directory\n\n- **main.js** (javascript): " in document
    assert "- **Languages**: javascript, python\n- **File Types**: .js, .py\n\n## Key Files Content\n\n### main.js\n\n```javascript\n\n```\n\n### src/mainframe.js" in document


# --- blocks, report, overlay ------------------------------------------------------------------------------


def test_tables_roundtrip_with_repeats_and_dollars(spark):
    t = "a <table><td>$1</td></table> b <TABLE x>2</TABLE><table><td>$1</td></table> c"
    df = spark.createDataFrame([(1, t), (2, "none"), (3, "")], "file_id long, content string")
    cut = blocks.extract_tables(df)
    assert cut.filter("file_id = 1").first().without_tables == "a ___TABLE_0_PLACEHOLDER___ b ___TABLE_1_PLACEHOLDER______TABLE_2_PLACEHOLDER___ c"
    assert rows(blocks.restore_tables(cut), "file_id", "restored") == [(1, t), (2, "none"), (3, "")]


def test_diagrams(spark):
    t = "x ```mermaid\n graph TD\n A-->B \n``` y ```mermaid  ``` z ```markdown\n# h\n```"
    df = spark.createDataFrame([("p", 1, t)], "project string, file_id long, content string")
    found = blocks.extract_diagrams(df).collect()
    assert [(r.pos, r.code, r.is_valid) for r in found] == [(0, "graph TD\n A-->B", True)]
    wrapped = blocks.wrap_diagrams(df).first().wrapped
    assert f'x <div class="mermaid" id="{found[0].diagram_id}">graph TD\n A-->B</div> y ```mermaid  ``` z' in wrapped
    assert blocks.unwrap_markdown(df).first().unwrapped.endswith("z # h")


def test_report_shows_diagrams_and_markdown(spark):
    why = "see ```mermaid\ngraph TD\n``` and ```markdown\n**x**\n```"
    df = spark.createDataFrame([("p", 5, "a<b.js", None, why, "x < y"), ("p", 9, "z.js", "javascript", None, "")], "project string, file_id long, relative_path string, language string, explanation string, content string")
    html = [r.html for r in report.report_sections(df).orderBy("section", "ord").collect()]
    assert len(html) == 4 and '<div class="mermaid" id="mermaid-diagram-' in html[1] and "and **x**</div>" in html[1]
    assert 'id="file-0" data-path="a&lt;b.js"' in html[1] and '<span class="badge">text</span>' in html[1] and "<pre><code>x &lt; y</code></pre>" in html[1]
    assert "No explanation available." in html[2] and "<pre>" not in report.report_sections(df, "summary").filter("section = 1").first().html


def test_report_is_written_in_order(spark, sf_dir, tmp_path):
    described = corpus.detect_language(samples.files(spark, sf_dir)).withColumn("explanation", F.lit("why"))
    sections = materialize(report.report_sections(described, "summary"))
    out = tmp_path / "report"
    sinks.write_report(sections, str(out), partitions=5)
    for project in ("src0", "src7"):
        folder = out / f"project={project}"
        written = "".join((folder / name).read_text() for name in sorted(os.listdir(folder)) if name.startswith("part-")).splitlines()
        expected = [r.html for r in sections.filter(F.col("project") == project).orderBy("section", "ord").collect()]
        assert written == expected and written[0].startswith("<!DOCTYPE") and written[-1] == "</body></html>"


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("p", 0, "old"), ("q", 0, "old"), ("q", 1, "old")], "project string, file_id long, text string")
    lines = lambda frame: frame.select("project", F.lit(1).alias("section"), F.col("file_id").alias("ord"), F.col("text").alias("html"))
    for write, read in ((sinks.write_results, spark.read.parquet), (lambda f, p: sinks.write_report(lines(f), p), lambda p: spark.read.text(p).withColumnRenamed("value", "text"))):
        place = f"{path}-{write.__name__}"
        write(df, place)
        write(df.filter("project = 'q' and file_id = 0").withColumn("text", F.lit("new")), place)
        assert rows(read(place), "project", "text") == [("p", "old"), ("q", "new")]
        with pytest.raises(Exception):  # noqa: B017
            write(df.withColumn("text", F.when(F.col("project") == "q", F.raise_error(F.lit("lost"))).otherwise(F.lit("never"))), place)
        assert rows(read(place), "project", "text") == [("p", "old"), ("q", "new")]


def test_files_are_not_written_outside_their_folder(spark, tmp_path):
    df = spark.createDataFrame([("../x", "text")], "relative_path string, content string")
    with pytest.raises(Exception, match="leaves the folder"):
        sinks.write_files(df, str(tmp_path / "in"))


def test_imports_are_resolved_by_path(spark):
    data = [
        (0, "p", "src/a/util.js", "import x from '../b/util'; import y from './util.js'"),
        (1, "p", "src/b/util.js", "import x from '../a/util'\nconst z = require('..')"),
        (2, "p", "src/b/util.ts", ""),
        (3, "p", "src/index.tsx", "import q from './b/'; import r from './none'; import s from 'util'"),
        (4, "p", "main.js", "import a from './src'"),
        (0, "q", "src/b/util.js", "import x from '../a/util'"),
    ]
    df = spark.createDataFrame(data, "file_id long, project string, relative_path string, content string")
    assert rows(graph.resolved_imports(df).na.fill("-", ["target_path"]), "project", "file_id", "specifier", "target_path") == [
        ("p", 0, "../b/util", "src/b/util.ts"), ("p", 0, "./util.js", "src/a/util.js"), ("p", 1, "..", "src/index.tsx"), ("p", 1, "../a/util", "src/a/util.js"),
        ("p", 3, "./b/", "-"), ("p", 3, "./none", "-"), ("p", 4, "./src", "src/index.tsx"), ("q", 0, "../a/util", "-"),
    ]


def test_results_are_written_per_project(spark, tmp_path):
    df = tiny_project(spark)
    for fmt in ("parquet", "json"):
        sinks.write_results(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 5


def test_overlay_layers(spark):
    layer = lambda data: spark.createDataFrame(data, "key string, value string")
    got = overlay.overlay([layer([("a", "cli"), ("b", None)]), layer([("a", "file"), ("b", "file")]), layer([("a", "d"), ("b", "d"), ("c", "d")])], ["key"])
    assert rows(got, "key", "value", "layer_priority") == [("a", "cli", 3), ("b", "file", 2), ("c", "d", 1)]
    by_key = overlay.overlay([layer([("a", "x"), ("model:one", None), ("model:two", None)])], ["key"], default=F.when(F.col("key") == "model:one", "m1").otherwise("m2"))
    assert rows(by_key, "key", "value", "layer_priority") == [("a", "x", 1), ("model:one", "m1", 0), ("model:two", "m2", 0)]


# --- streaming ----------------------------------------------------------------------------------------------


def test_stream_equals_batch(spark, files, tmp_path):
    base = str(tmp_path)
    plain = files.drop("key_path")
    plain.repartition(3, "file_id").write.parquet(f"{base}/in")
    templates = samples.templates(spark)
    store = CacheStore(spark, f"{base}/cache")

    def run():
        arriving = incremental.file_stream(spark, f"{base}/in", plain.schema, max_files=1)
        incremental.explain_stream(arriving, store, f"{base}/out", f"{base}/check", templates, samples.stub_client, CONFIG).awaitTermination()

    run()
    batch, _ = explain.explain_corpus(plain, store.read().limit(0), templates, samples.stub_client, CONFIG)
    streamed = spark.read.parquet(f"{base}/out")
    assert rows(streamed, "file_id", "explanation") == rows(batch, "file_id", "explanation")
    run()
    assert spark.read.parquet(f"{base}/out").count() == streamed.count()

    results = spark.readStream.schema(streamed.schema).parquet(f"{base}/out")
    incremental.usage_stream(results, f"{base}/usage", f"{base}/check2").awaitTermination()
    usage = incremental.latest_usage(spark, f"{base}/usage")
    expected = streamed.groupBy("project").agg(F.count("*").alias("files"), F.sum("input_tokens").alias("input_tokens"))
    assert rows(usage, "project", "files", "input_tokens") == rows(expected, "project", "files", "input_tokens")


def test_a_stream_looks_up_only_files_it_has_seen(spark, files, tmp_path, monkeypatch):
    """Started four times from one checkpoint: new files, the same ones, touched ones, and changed ones."""
    base, templates = str(tmp_path), samples.templates(spark)
    plain = files.drop("key_path").filter("file_id < 12")
    store, looked_up, read = CacheStore(spark, f"{base}/cache"), [], CacheStore.read
    monkeypatch.setattr(CacheStore, "read", lambda self, *a, **k: (looked_up.append(k["keys"].count()) if k.get("keys") is not None else None, read(self, *a, **k))[1])

    def run(subset, client):
        subset.coalesce(1).write.mode("append").parquet(f"{base}/in")
        arriving = incremental.file_stream(spark, f"{base}/in", plain.schema)
        incremental.explain_stream(arriving, store, f"{base}/out", f"{base}/check", templates, client, CONFIG).awaitTermination()
        return spark.read.parquet(f"{base}/out")

    first = run(plain, samples.stub_client)  # file 7 has no answer
    assert first.filter("cached").count() == 0 and looked_up == []
    same = run(plain, lambda: lambda row: "asked again")
    assert looked_up == [12]
    assert rows(same.filter("batch = 1 and not cached"), "file_id", "explanation") == [(7, "asked again")]
    touched = run(plain.filter("file_id < 3").withColumn("mtime_ms", F.col("mtime_ms") + 5), broken_client)
    assert touched.filter("batch = 2 and cached").count() == 3 and looked_up == [12, 3]
    changed = plain.filter("file_id < 2").withColumn("content", F.concat("content", F.lit("!"))).withColumn("file_size", F.col("file_size") + 1)
    assert run(changed, lambda: lambda row: "new").filter("batch = 3 and not cached and explanation = 'new'").count() == 2 and looked_up == [12, 3]


def test_status_of_seen_files():
    known = (5, 100, "h")
    assert [incremental._status(known, *f) for f in ((5, 100, "x"), (5, 101, "h"), (5, 101, "x"), (6, 100, "h"))] == ["hit", "refresh", "miss", "miss"]
    assert incremental._status(None, 5, 100, "h") == "miss"


def test_three_checkpoints_share_one_store(spark, files, tmp_path):
    base, templates = str(tmp_path), samples.templates(spark)
    plain = files.drop("key_path").filter("file_id % 50 <> 7")
    store = CacheStore(spark, f"{base}/cache")

    def run(name, subset, client):
        subset.coalesce(1).write.mode("append").parquet(f"{base}/in-{name}")
        arriving = incremental.file_stream(spark, f"{base}/in-{name}", plain.schema)
        incremental.explain_stream(arriving, store, f"{base}/out-{name}", f"{base}/check-{name}", templates, client, CONFIG).awaitTermination()
        return spark.read.parquet(f"{base}/out-{name}")

    first = run("one", plain.filter("file_id < 20"), samples.stub_client)
    assert first.filter("cached").count() == 0
    second = run("two", plain.filter("file_id < 21"), samples.stub_client)
    assert second.filter("not cached").select("file_id").collect() == [(20,)]
    run("three", plain.filter("file_id between 40 and 45"), samples.stub_client)
    every = plain.filter("file_id < 21 or file_id between 40 and 45")
    assert store.read().count() == every.count()  # nothing is lost
    again = run("four", every, broken_client)
    assert again.filter("cached").count() == every.count()
    grown = run("one", plain.filter("file_id = 30"), samples.stub_client)  # the first checkpoint goes on
    assert grown.count() == first.count() + 1 and store.read().count() == every.count() + 1


def session_like(master, folder):
    """Stands in for a session on a cluster."""
    chosen = []
    context = SimpleNamespace(
        master=master, getConf=lambda: {"spark.checkpoint.dir": folder}, getCheckpointDir=lambda: chosen[-1] if chosen else None, setCheckpointDir=chosen.append
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert shared_folder(session_like("spark://host:7077", "s3a://shared/checkpoints")) == "s3a://shared/checkpoints"
    with pytest.raises(ValueError):
        shared_folder(session_like("spark://host:7077", None))
    table = materialize(spark.range(3))
    assert table.count() == 3 and shared_folder(spark).removeprefix("file:") in table.inputFiles()[0]


class HeldState:
    """A map state as a stream's processor sees it."""

    def __init__(self):
        self.held = {}
        self.getValue, self.updateValue = self.held.get, self.held.__setitem__

    def getMapState(self, *_):
        return self


def test_files_of_a_bucket_share_one_call():
    """Three keys in one group, one of them twice: each is judged by what was held before the batch."""
    state, seen = HeldState(), incremental.LastSeen(["cache_key"], None)
    seen.init(state)
    columns = ["cache_key", "file_size", "mtime_ms", "file_hash"]
    seen.handleInitialState((1,), pd.DataFrame([("a", 5, 100, "x"), ("b", 5, 100, "y")], columns=columns), None)
    lots = [pd.DataFrame([("a", 5, 100, "x"), ("b", 5, 101, "y"), ("c", 5, 100, "z")], columns=columns), pd.DataFrame([("c", 6, 90, "w")], columns=columns)]
    found = pd.concat(seen.handleInputRows((1,), iter(lots), None))
    assert list(zip(found["cache_key"], found["seen_status"], strict=True)) == [("a", "hit"), ("b", "refresh"), ("c", "miss"), ("c", "miss")]
    assert state.held == {("a",): (5, 100, "x"), ("b",): (5, 101, "y"), ("c",): (5, 100, "z")}


@pytest.mark.parametrize("tasks", [1, 10])
def test_files_arrive_in_few_lots_whatever_wrote_them(spark, tmp_path, tasks):
    spark.range(90).repartition(tasks).write.option("maxRecordsPerFile", 30).parquet(f"{tmp_path}/in")
    assert [samples.lot_size(spark, f"{tmp_path}/in", least) for least in (1, 2)] == [-(-tasks // 4), max(2, -(-tasks // 4))]


def test_batches_with_texts_are_short(spark, tmp_path):
    """Batches that go to Python are bounded in rows and bytes, whatever the session had."""
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for length, most in ((10, 512), (100_000, 45)):
        texts = spark.range(1500).select(F.col("id").cast("string").alias("relative_path"), F.repeat(F.lit("x"), length).alias("content")).coalesce(1)
        spark.conf.set(records, "10000")
        found = infer.map_batches(texts, lambda pdf: pd.DataFrame({"n": [len(pdf)]}), "n long").agg(F.max("n"), F.sum("n")).first()
        assert found[0] <= most and found[1] == 1500
        spark.conf.set(records, "10000")
        asked = texts.select(F.col("content").alias("prompt"))
        assert infer.infer(asked, lambda: lambda row: "a", attempts=0).count() == 1500 and spark.conf.get(records) == "512"
    spark.conf.set(records, "10000")
    assert sinks.write_files(texts.limit(3), str(tmp_path)) == 3 and spark.conf.get(records) == "512"
    spark.conf.set(records, "100")
    infer.map_batches(texts, lambda pdf: pdf, texts.schema)
    assert spark.conf.get(records) == "100"
    spark.conf.set(records, "512")


def test_templates_are_read_by_few_tasks(spark, tmp_path):
    """Many small files are no reason for many tasks; other names and folders below are left out."""
    for n in range(400):
        (tmp_path / f"m {n}.md").write_text(f"body {n}")
    (tmp_path / "none.md").write_text("")
    (tmp_path / "below").mkdir()
    for name in ("_x.md", ".y.md", "z.txt", "below/w.md"):
        (tmp_path / name).write_text("not this")
    templates = load_templates(spark, str(tmp_path))
    assert rows(templates, "layer", "mode", "template") == sorted([("default", f"m {n}", f"body {n}") for n in range(400)])
    assert templates.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
