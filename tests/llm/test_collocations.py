"""Collocations against plain counting, and the summaries' guarantee."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import collocations, queries
from corpusloom.llm.collocations import Summary, capacity
from corpusloom.llm.common import documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least=30, longest=4, covered=80, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, found in counts.items():
        phrases = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in phrases.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i : i + n]] = max(longer[p[i : i + n]], a)
        ranked = []
        for p, a in phrases.items():
            score, _, left, right = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            if 100 * longer[p] < covered * a or p not in longer:
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def odd_rows(odd_texts):
    """Repeated passages, borders between words, upper case, nulls, an empty language and a null one."""
    chance = random.Random(4)
    words = ["Ab", "ab", "c", "ß", "É", "é", "d\x00", "e f", "g-h", "i"]
    rows = [(chance.choice(["en", "de", "", None, "und"]), t) for t in odd_texts if t is None or len(t) < 20_000]
    for _ in range(400):
        text = "".join(chance.choice(words) + chance.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?", "\x0c"]) for _ in range(chance.randint(0, 60)))
        rows.append((chance.choice(["en", "en", "de", None]), text))
    return rows + [("en", "One phrase OF its own")] * 40 + [("xx", "too rare")] * 3


def table(spark, rows, parts=6):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "lang string, text string, phrase string, n int").repartition(parts)


@pytest.mark.parametrize("chunk", [16_000_000, 2000])
@pytest.mark.parametrize(("least", "longest", "top"), [(30, 4, 2000), (2, 4, None), (30, 2, 5), (12, 5, 50)])
def test_equals_counting(spark, odd_rows, monkeypatch, chunk, least, longest, top):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    result = collocations.collocations(table(spark, odd_rows), least=least, longest=longest, top=top)
    assert found(result) == expected(odd_rows, least, longest, top=top)


def test_a_full_filter_changes_nothing(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(collocations.Filter, "passes", lambda self, values: np.ones(len(values), dtype=bool))
    assert found(collocations.collocations(table(spark, odd_rows))) == expected(odd_rows)


@pytest.mark.parametrize("ors", [1, 2])
def test_what_a_filter_passes_wrongly_changes_nothing(spark, monkeypatch, ors):
    """Phrases may pass although their beginnings do not; they are rare, and no other phrase is counted with them."""
    exact, chance, bits = collocations.bloom, random.Random(7), np.random.default_rng(7)
    words = [f"w{n}" for n in range(16)]
    rows = [("en", " ".join(min(chance.choices(words, k=2)) for _ in range(3000))) for _ in range(10)]

    def fuller(survivors):
        found = exact(survivors)
        for _ in range(ors):
            found.words |= bits.integers(0, 2**64, len(found.words), np.uint64)
        return found

    monkeypatch.setattr(collocations, "bloom", fuller)
    assert found(collocations.collocations(table(spark, rows, parts=1), covered=1000, top=None)) == expected(rows, covered=1000, top=None)


def test_given_documents(spark, sf_dir):
    rows = [(r.lang, r.text) for r in documents(spark, sf_dir).select("lang", "text").collect()]
    assert found(queries.QUERIES["op13_collocations"](spark, sf_dir)) == expected(rows)


def test_empty_table(spark):
    assert found(collocations.collocations(table(spark, []))) == []
    assert found(collocations.collocations(table(spark, [(None, None), ("en", "")]))) == []


def test_summaries_merge_without_losing_what_is_frequent():
    chance = np.random.default_rng(3)
    for least in (5, 30):
        values = np.concatenate([chance.integers(0, 4000, 20_000), chance.zipf(1.3, 20_000) % 5000 + 10_000]).astype(np.uint64)
        chance.shuffle(values)
        truth = Counter(values.tolist())
        whole = Summary(capacity(len(values), least))
        for part in np.array_split(values, 23):
            keys, counts = np.unique(part, return_counts=True)
            small = Summary(whole.capacity)
            small.merge(keys, counts)
            small.fold()
            whole.merge(small.keys, small.counts, small.error)
            whole.fold()
            assert len(whole.keys) <= whole.capacity
        assert whole.error < least
        for key, n in zip(whole.keys.tolist(), whole.counts.tolist(), strict=True):
            assert n <= truth[key] <= n + whole.error
        assert {k for k, n in truth.items() if n >= least} <= set(whole.survivors(least).tolist())


def test_numbers_beyond_64_bits(spark):
    """2000000 * a passes 64 bits; the expression of the score stays exact."""
    from pyspark.sql import functions as F

    a, parts = 9_000_000_000_000_007, (9_000_000_000_000_011, 9_000_000_000_000_013)
    row = spark.createDataFrame([(a, *parts)], "a long, l long, r long").select(collocations.scored(F.col("a"), F.col("l"), F.col("r")))
    assert row.first()[0] == 2000000 * a // sum(parts)
