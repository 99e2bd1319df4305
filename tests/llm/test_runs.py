"""Periodic runs against a search over all periods and places."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import periodic_runs, queries
from corpusloom.llm.common import documents


def runs_expected(words, least=24, periods=3):
    """{(start, length): smallest period} by going through every period."""
    found = {}
    for p in range(1, len(words) // periods + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if length >= max(least, periods * p):
                found.setdefault((start, length), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def row_expected(doc_id, text, loop=True):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if loop and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(runs_expected(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *digest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), n)


def random_words(chance):
    """Words of few letters with periodic stretches, nested and beside one another."""
    out = []
    for _ in range(chance.randint(0, 6)):
        stretch = [chance.randint(0, chance.choice([1, 2, 5, 40])) for _ in range(chance.randint(1, 12))]
        out += stretch * chance.randint(1, 9) + stretch[: chance.randint(0, len(stretch))]
    return np.array(out, dtype=np.int64)


def test_runs_of_random_sequences():
    chance = random.Random(5)
    for _ in range(150):
        texts = [random_words(chance) for _ in range(chance.randint(1, 9))]
        least = chance.choice([24, 6, 1])
        found = [[] for _ in texts]
        for k, *run in zip(*(v.tolist() for v in periodic_runs.runs_of(texts, least)), strict=True):
            found[k].append(tuple(run))
        assert [sorted(f) for f in found] == [runs_expected(t.tolist(), least) for t in texts]


def test_grammar_answers_exact_extensions():
    chance = random.Random(8)
    for _ in range(40):
        body = np.concatenate([random_words(chance) for _ in range(4)])
        text = np.concatenate([[100], body, [101], body, [102]])
        n = len(text)
        i, j = np.array([(a, b) for a in range(1, n - 1, 3) for b in range(a + 1, n - 1, 2)] or [(0, n - 1)]).T
        grammar = periodic_runs.Grammar(text)
        after, before = grammar.common(i, j, True), grammar.common(i, j, False)
        for a, b, r, s in zip(i, j, after, before, strict=True):
            assert (text[a : a + r] == text[b : b + r]).all() and text[a + r] != text[b + r]
            assert (text[a - s : a] == text[b - s : b]).all() and text[a - s - 1] != text[b - s - 1]


def test_long_repetitive_text_stays_cheap():
    texts = [np.zeros(60_000, dtype=np.int64), np.tile(np.arange(7), 9000), np.arange(50_000)]
    document, start, length, period = periodic_runs.runs_of(texts)
    assert list(zip(document, start, length, period, strict=True)) == [(0, 0, 60_000, 1), (1, 0, 63_000, 7)]


@pytest.mark.parametrize("chunk", [4_000_000, 3000])
def test_query_equals_search(spark, sf_dir, tmp_path, odd_texts, monkeypatch, chunk):
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    chance = random.Random(3)
    rows = [(k, " ".join(f"w{x}" for x in random_words(chance))) for k in range(200)]
    rows += [(1000 + k, t if t is None or len(t) < 20_000 else t[:20_000]) for k, t in enumerate(odd_texts)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, n int").repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((row_expected(*r) for r in rows), key=repr)


def test_given_documents(spark, sf_dir):
    rows = documents(spark, sf_dir).filter(F.length("text") < 6000).select("doc_id", "text").collect()
    wanted = {r.doc_id: row_expected(*r) for r in rows}
    found = {r.doc_id: tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert all(found[d] == row for d, row in wanted.items())
    assert sum(row[1] > 0 for row in found.values()) > 10


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert found.collect() == [] and found.columns[:2] == ["doc_id", "n_runs"]
