"""The pipeline against plain versions of its stages, on odd rows and on the small tables."""


import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import decontaminate
from tests.llm.test_rules_seeds import plain_overlaps
from tests.llm.test_simhash import plain_fingerprint


def plain_near_dedup(rows):
    """Rows with the smallest id of each group; nulls last, exact repeats once."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    prints = np.array([plain_fingerprint(t) for _, t in distinct], dtype=np.uint64)
    group = list(range(len(distinct)))
    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3):
            a, b = group[i], group[int(j)]
            if a != b:
                group = [min(a, b) if g in (a, b) else g for g in group]
    return [r for i, r in enumerate(distinct) if group[i] == i]


def plain_cut(rows, length=200):
    """Texts without repeated strings; a character stays whole if a byte of it stays."""
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in data:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for (d, text), t in zip(rows, data, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept, at = [], 0
        for c in text or "":
            size = len(c.encode())
            if not gone[at : at + size].all():
                kept.append(c)
            at += size
        out.append((d, None if text is None else "".join(kept)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def written(spark, frame, tmp_path, name):
    frame.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_stages_on_the_small_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs_before = pairs(docs), docs
        docs = written(spark, stage(spark, docs, sf_dir), tmp_path, str(k))
        if name != "best_fit_packing":
            assert docs.columns == docs_before.columns
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            kept = {d for d, _ in pairs(docs)}
            judged = [(d in kept) == (labels[d] == 1) for d, _ in before if d in labels]
            assert np.mean(judged) > 0.95
        elif name == "simhash_near_dedup":
            assert ordered(pairs(docs)) == ordered(plain_near_dedup(before))
        elif name == "suffix_array_dedup":
            assert ordered(pairs(docs)) == ordered(plain_cut(before))
            assert docs.filter("n_chars != length(text)").count() == 0
        elif name == "benchmark_decontamination":
            kept = set(pairs(docs))
            words = {w for _, t in items for w in decontaminate.tokens(t.encode())}
            for d, t in before:
                if len(t or "") < 2500 and sum(w in words for w in decontaminate.tokens((t or "").encode())) >= 8:
                    assert ((d, t) in kept) == (not plain_overlaps([(d, t)], items))
        else:
            assert {r.doc_id for r in docs.collect()} == {d for d, _ in before}
            assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0


def test_run_equals_its_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(spark, stage(spark, docs, sf_dir), tmp_path, str(k))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert ordered(docs.select(columns).collect()) == ordered(corpus_pipeline.run(spark, sf_dir).select(columns).collect())


@pytest.fixture(scope="module")
def odd(spark, odd_texts):
    rows = list(enumerate(odd_texts)) + [(3, odd_texts[3]), (3, odd_texts[3]), (5, "other text of the same id"), (None, odd_texts[7]), (None, "alone without an id")]
    table = spark.createDataFrame([(d, t, "en", None, 0, 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, k int, shift string")
    return rows, table.repartition(3)


def test_filters_on_odd_rows(spark, sf_dir, odd):
    rows, table = odd
    kept = corpus_pipeline.near_dedup(spark, table, sf_dir)
    assert kept.columns == table.columns
    assert ordered(pairs(kept)) == ordered(plain_near_dedup(rows))
    cut = corpus_pipeline.substring_dedup(spark, table, sf_dir)
    assert ordered(pairs(cut)) == ordered(plain_cut(rows))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), sf_dir).count() == 0, name
        out = stage(spark, table, sf_dir)
        if name != "best_fit_packing":
            assert out.columns == table.columns
        out.write.format("noop").mode("overwrite").save()
