"""Largest inner products against a full comparison."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import cover_search, queries
from corpusloom.llm.cover_search import Best, Block, CoverTree, highest


def expected(rows, k=5, asked=lambda i: i % 50 == 0):
    """rows: (id, vector of whole numbers)"""
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v})
    out = []
    for i, q in rows:
        if asked(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in rows if j != i)
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, k=5, parts=5):
    table = spark.createDataFrame([(i, v, "clash", 2) for i, v in rows], "vec_id long, vector array<long>, ids string, unit int").repartition(parts)
    return sorted(tuple(r) for r in cover_search.top_k(table, F.col("vec_id") % 50 == 0, k).collect())


@pytest.fixture(scope="module")
def odd_rows():
    """Clusters, hundreds of copies of one vector, ties, short and empty vectors, nulls, repeated rows and ids."""
    chance = np.random.default_rng(2)
    centres = chance.integers(-300, 300, (8, 6))
    points = [(c + chance.integers(-9, 10, 6)).tolist() for c in centres for _ in range(60)]
    points += [[7, 0, -3, 250, 1, 1]] * 400 + [[1, 0, 0, 0, 0, 0]] * 20 + [[1, 2]] * 3 + [[0] * 6, [], [1, None, 3, 4, 5, 6], None]
    rows = list(enumerate(points))
    random.Random(1).shuffle(rows)
    return rows + [(0, points[0])] * 30 + [(50, [9, 9, 9, 9, 9, 9]), (None, points[3]), (-50, points[5]), (-1, points[5])]


@pytest.mark.parametrize(("unit", "block", "sample", "k"), [(32_768, 2048, 2048, 5), (40, 16, 3, 5), (100, 64, 50, 1), (32_768, 2048, 2048, 1000)])
def test_equals_full_comparison(spark, odd_rows, monkeypatch, unit, block, sample, k):
    for name, value in (("UNIT", unit), ("BLOCK", block), ("SAMPLE", sample), ("LEAF", 4)):
        monkeypatch.setattr(cover_search, name, value)
    assert found(spark, odd_rows, k) == expected(odd_rows, k)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, [1]), (1, None)]) == []
    assert found(spark, [(50, [1, 2])]) == []
    assert found(spark, [(50, [1, 2]), (3, [4, 5]), (7, [4, 5])]) == [(50, 1, 3, 14), (50, 2, 7, 14)]


def test_scores_beyond_double_precision(spark):
    big = 2**30
    rows = [(k, [big - k, big + k, -1]) for k in range(60)]
    assert found(spark, rows) == expected(rows)
    with pytest.raises(Exception, match="too large"):
        found(spark, [(0, [2**40, 0]), (1, [2**40, 1])])


def test_given_embeddings(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, dtype=np.float64)).astype(int).tolist()) for r in table]
    result = queries.QUERIES["op12_cover_search"](spark, sf_dir)
    assert result.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(tuple(r) for r in result.collect()) == expected(rows)


def test_vectors_that_take_no_part(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, 0.25]), (1, [inf, 0.0]), (2, [nan, 1.0]), (3, [None, 1.0]), (4, None), (5, [-0.001, 1.0]), (50, [nan, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.QUERIES["op12_cover_search"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(0, 1, 5, 128 * -1 + 64 * 256)]


def clustered(chance, n, centres=20, dim=8):
    middle = chance.integers(-2000, 2000, (centres, dim))
    return middle[chance.integers(0, centres, n)] + chance.integers(-20, 20, (n, dim))


def test_tree_covers_and_separates():
    chance = np.random.default_rng(1)
    points = clustered(chance, 900).astype(float)
    tree = CoverTree(points, leaf=4)
    assert sorted(np.concatenate([m for m, c in zip(tree.members, tree.children, strict=True) if not c])) == list(range(900))
    for node, below in enumerate(tree.children):
        away = np.linalg.norm(points[tree.members[node]] - points[tree.centre[node]], axis=1)
        assert away.max() <= tree.radius[node] + 1e-6
        assert not below or sorted(np.concatenate([tree.members[c] for c in below])) == sorted(tree.members[node])
        several = [c for c in below if tree.radius[c] <= tree.radius[node] / 2 + 1e-6]
        for a in several:
            for b in several:
                assert a == b or np.linalg.norm(points[tree.centre[a]] - points[tree.centre[b]]) > tree.radius[node] / 2 - 1e-6


def test_bounds_prune_clustered_points(monkeypatch):
    chance = np.random.default_rng(4)
    points = clustered(chance, 2000)
    block, queries_ = Block(points, np.arange(2000)[:, None]), points[::20]
    tree, best = CoverTree(queries_.astype(float), cover_search.FEW), Best(100, 6)
    compared = []
    whole = Block._compare
    monkeypatch.setattr(Block, "_compare", lambda self, q, a, m, b: (compared.append(len(a) * len(m)), whole(self, q, a, m, b)))
    block.search(queries_, tree, best)
    assert sum(compared) < 0.5 * 100 * 2000
    scores = queries_ @ points.T
    for row, got, ids in zip(scores, best.scores, best.ids, strict=True):
        order = np.lexsort((np.arange(2000), -row))[:6]
        assert got.tolist() == row[order].tolist() and ids.tolist() == order.tolist()
    for a in range(0, len(tree.centre), 7):
        for b in range(0, len(block.tree.centre), 13):
            assert scores[np.ix_(tree.members[a], block.tree.members[b])].max() <= highest(tree.ball(a), block.tree.ball(b))
