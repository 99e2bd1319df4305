"""Held-out accuracy of the classifiers, and rows at the edge."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import gam, language, queries, toxicity
from corpusloom.llm.common import labelled_rows

SF = "/root/testdata/sf0.01"


def ranked(scores, labels):
    """Probability that a positive row has the higher score."""
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    n = labels.sum()
    return (order[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def known(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def check_scores(rows, total):
    assert len(rows) == total
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_on_held_out_rows(spark, known):
    rows = queries.QUERIES["op9_gam_quality"](spark, SF).collect()
    check_scores(rows, spark.read.parquet(f"{SF}/documents.parquet").count())
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    y = np.array([known[r.doc_id].quality for r in held])
    assert ranked(np.array([r.score for r in held]), y) > 0.97
    assert (np.array([r.predicted for r in held]) == y).mean() > 0.95


@pytest.mark.parametrize(("folder", "recall"), [(SF, 0.8), ("/root/testdata/sf0.1", 0.85)])
def test_toxicity_on_held_out_rows(spark, folder, recall):
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES["op1_toxicity"](spark, folder).collect()
    check_scores(rows, spark.read.parquet(f"{folder}/documents.parquet").count())
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    y = np.array([known[r.doc_id] for r in held])
    assert ranked(np.array([r.score for r in held]), y) > 0.85
    found = np.array([r.predicted for r in held])
    assert found[y == 1].mean() >= recall and y[found == 1].mean() >= 0.9


def plain_toxicity(text, model):
    """The score of a text, byte by byte and window by window."""
    cleaned = []
    for byte in (text or "").encode():
        cleaned.append(byte + 32 if 65 <= byte <= 90 else byte if 97 <= byte <= 122 or byte >= 128 else 32)
    words = bytes(cleaned).split()
    one, two = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic)
    gains = []
    for i in range(0, len(words), toxicity.WORDS):
        window = b" " + b" ".join(words[i : i + toxicity.WORDS]) + b" "
        out, h = [], 0
        for byte in window:
            h = 0 if byte == 32 else (33 * h + byte) % 256
            out += [byte, (h + 1) % 256]
        gains.append(min(toxicity.MOST, max(0, len(one.compress(bytes(out))) - len(two.compress(bytes(out))))))
    n = len(gains)
    over = [sum(g >= t for g in gains) for t in model.thresholds]
    x = [sum(gains) / max(1, n), max(gains, default=0), *[np.log1p(c) for c in over], *[c / (n + 3) for c in over], *[(c / (n + 3)) ** 0.5 for c in over]]
    raw = sum((v - c) / s * w for v, c, s, w in zip(x, model.centre, model.spread, model.weights, strict=False)) + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def test_toxicity_equals_a_plain_scorer(spark, odd, known):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150).unionByName(odd.select("doc_id", F.substring("text", 1, 4000).alias("text")))
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), queries.labels(spark, SF, "toxic"))
    rows = docs.collect()
    expected = sorted((str(r.doc_id), round(float(plain_toxicity(r.text, model)), 9)) for r in rows)
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.score(spark.createDataFrame(rows, docs.schema), model).collect()) == expected


def plain_quality(text, model):
    """The score of a text, table by table."""
    x = gam.measure((text or "").encode(), gam.byte_groups())
    raw = model.constant
    for value, edges, table in zip(x, model.edges, model.tables, strict=True):
        raw += table[sum(value >= e for e in edges)]
    for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
        raw += table[sum(x[i] >= e for e in model.pair_edges[i]), sum(x[j] >= e for e in model.pair_edges[j])]
    return 1 / (1 + np.exp(-raw))


def test_quality_equals_a_plain_scorer(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = gam.fit(docs, queries.labels(spark, SF, "quality"))
    rows = docs.limit(100).unionByName(odd.select("doc_id", "text")).collect()
    expected = sorted((str(r.doc_id), round(float(plain_quality(r.text, model)), 6)) for r in rows)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in gam.score(spark.createDataFrame(rows, docs.schema), model).collect()) == expected


def test_rows_not_ids_bound_the_fits(spark, monkeypatch):
    """One labelled id on 20,000 rows: what reaches the driver is bounded by ``rows``, and is learnt from."""
    texts = F.concat(F.lit("some words of text number "), (F.col("id") % 500).cast("string"))
    docs = spark.range(20_000).select(F.when(F.col("id") < 19_990, 1).otherwise(F.col("id")).alias("doc_id"), texts.alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(1, 1), (19_995, 0), (19_996, 0)], "doc_id long, label int")
    assert 3 <= labelled_rows(docs, labels, 10).count() <= 10
    brought = []
    kind = type(docs)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (lambda rows: (brought.append(len(rows)), rows)[1])(collect(self)))
    for module in (gam, toxicity):
        module.fit(docs, labels, rows=10)
    model = language.fit(docs, rows=10)
    assert max(brought) <= 10 and list(model.languages) == ["en"]
    assert {r.lang_pred for r in language.predict(docs.limit(5), model).collect()} == {"en"}


def test_language_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op10_language"](spark, SF).collect()
    check_scores(rows, len(lang))
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.99
    assert {r.family for r in rows} == {"de+en", "es+fr"}


ODD = [(1, None), (2, ""), (3, "\n\t "), (4, "123 !!"), (5, "a"), (None, "the and of"), (5, "twice"), (6, "é ü"), (7, "long text with words " * 50_000), (8, "\x00\x1c")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en" if d != 3 else None, 0.5, "x") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, features string")


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (5, 0), (6, 1), (None, 1), (7, None), (99, 0)], "doc_id long, label int")
    rows = gam.score(odd, gam.fit(odd, labels)).collect()
    check_scores(rows, len(ODD))
    rows = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    check_scores(rows, len(ODD))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {(r.doc_id, r.lang_pred) for r in language.predict(odd, language.fit(docs)).collect()}
    assert {(d, "und") for d in (1, 2, 3, 4, 8)} <= found
    assert (7, "en") in found and (6, "und") not in found
    alone = language.predict(odd, language.fit(odd)).collect()  # one language only
    assert {r.lang_pred for r in alone} == {"en", "und"}


def test_empty_tables(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, label int")
    for module in (gam, toxicity):
        model = module.fit(odd.limit(0), labels)
        assert module.score(odd.limit(0), model).count() == 0
        check_scores(module.score(odd, model).collect(), len(ODD))
    model = language.fit(odd.limit(0))
    assert language.predict(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.predict(odd, model).collect()} == {"und"}


def test_labels_outside_the_sample_do_not_change_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality as label")
    held = queries.held_out(2, 4)
    one = gam.fit(docs, labels.filter(~held))
    changed = docs.withColumn("text", queries.F.when(held, "other").otherwise(queries.F.col("text")))
    two = gam.fit(changed, labels.filter(~held))
    assert all(np.array_equal(a, b) for a, b in zip(one.tables, two.tables, strict=True))


def test_pairs_are_learnt():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(gam.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)  # no single feature tells
    model = gam.train(x, y)
    assert (2, 5) in model.pairs
    assert ((gam.predict(x, model) > 0.5) == y).mean() > 0.95
