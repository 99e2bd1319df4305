"""Repeated bytes and words against plain counting."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pieces, queries, suffix_dedup, superkmer
from corpusloom.llm.common import documents


def bytes_expected(rows, length=200):
    """(id, n_bytes, n_removed, n_spans, sha) of each row, by counting all strings."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for d, t in data:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((np.diff(gone.astype(int)) == -1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words_expected(rows, size=50):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[i : i + size])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone[i : i + size] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def odd(spark, odd_texts):
    rows = list(enumerate(odd_texts)) + [(3, odd_texts[3]), (5, "other text of the same id"), (None, odd_texts[7]), (None, None)]
    table = spark.createDataFrame([(d, t, "clash", 1, "x") for d, t in rows], "doc_id long, text string, m string, h int, spans string")
    return rows, table.repartition(5)


@pytest.mark.parametrize("hot", [pieces.HOT, 2])
def test_bytes_of_odd_rows(odd, hot):
    rows, table = odd
    found = suffix_dedup.removal(table, hot=hot)
    assert ordered(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == ordered(bytes_expected(rows))
    for r in found.filter("n_removed > 0").limit(5).collect():
        assert sum(s["last"] - s["first"] for s in r.spans) == r.n_removed
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("hot", [pieces.HOT, 2])
def test_words_of_odd_rows(odd, hot):
    rows, table = odd
    found = superkmer.removal(table, hot=hot).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert ordered(found) == ordered(words_expected(rows))


@pytest.mark.parametrize("length", [40, 300])
def test_other_lengths(odd, length):
    rows, table = odd
    found = suffix_dedup.removal(table, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(found) == ordered(bytes_expected(rows, length))


def test_empty_tables(odd):
    _, table = odd
    assert suffix_dedup.removal(table.limit(0)).count() == 0
    assert superkmer.removal(table.limit(0)).count() == 0
    assert suffix_dedup.deduplicate(table.limit(0)).count() == 0


def test_cleaned_texts_keep_columns_and_characters(odd):
    rows, table = odd
    out = suffix_dedup.deduplicate(table)
    assert out.columns == table.columns
    assert out.count() == len(rows)
    assert out.filter(F.col("text").isNull()).count() == sum(t is None for _, t in rows)
    assert not [r for r in out.select("text").collect() if r.text and "�" in r.text]


def test_long_texts_are_divided_without_loss(spark, monkeypatch):
    chance = random.Random(2)
    long = " ".join(str(chance.randrange(10**6)) for _ in range(3000))
    rows = [(1, long), (2, "x " * 40 + long[4000:9000]), (3, "y" * 700)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(pieces, "CHUNK", 1000)
    assert ordered(suffix_dedup.removal(table).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == ordered(bytes_expected(rows))
    assert ordered(superkmer.removal(table).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == ordered(words_expected(rows))


def test_common_prefixes_of_random_collections():
    chance = random.Random(4)
    for _ in range(30):
        base = bytes(chance.choice(b"ab") for _ in range(40))
        texts, left, windows, length = [], [], [], 6
        for _ in range(chance.randint(1, 12)):
            a = chance.randrange(0, 15)
            b = chance.randrange(25, 40)
            t = bytearray(base[a:b])
            if chance.random() < 0.7:
                t[chance.randrange(len(t))] = chance.choice(b"abc")
            texts.append(bytes(t))
            left.append(20 - a)
            windows.append(len(t) - length + 1)
        found = suffix_dedup.shared_strings(texts, left, windows, length)
        places = defaultdict(list)
        for i, t in enumerate(texts):
            for j in range(windows[i]):
                places[j - left[i], t[j : j + length]].append((i, j))
        for same in places.values():
            for i, j in same:
                assert found[i][j] == (len(same) > 1)


def test_registered_queries(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    found = queries.QUERIES["op2_suffix_dedup"](spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(found) == ordered(bytes_expected(rows))
    found = queries.QUERIES["op5_superkmer_dedup"](spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert ordered(found) == ordered(words_expected(rows))


def test_repeated_rows_are_fetched_and_cut_once(spark):
    chance = random.Random(5)
    text = " ".join(str(chance.randrange(10**6)) for _ in range(300))
    rows = [(1, text)] * 40 + [(None, text)] * 30 + [(2, text[:1200]), (3, "x " * 300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    each = pieces.distinct(pieces.repeated(suffix_dedup.piece_table(table, 200)))
    fetched = pieces.with_text(each.select("k", "m", "h"), table, "m long, h long", lambda k, t, wanted: [(w["m"], w["h"]) for w in wanted])
    assert fetched.count() == each.count()
    spans = suffix_dedup.with_spans(table).filter("doc_id = 1").select(suffix_dedup.SPANS).first()[0]
    assert len(spans) == len({(s["first"], s["last"]) for s in spans})
    found = suffix_dedup.removal(table).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(found) == ordered(bytes_expected(rows))
    assert ordered(superkmer.removal(table).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == ordered(words_expected(rows))
