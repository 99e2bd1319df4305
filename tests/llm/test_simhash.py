"""SimHash components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from corpusloom.llm import queries, simhash_vp
from corpusloom.llm.common import documents
from corpusloom.llm.components import star_roots


def plain_fingerprint(text, length=3):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [words] if len(words) < length else [words[i : i + length] for i in range(len(words) - length + 1)]
    hashes = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows, max_bits=3):
    """doc_id of each row's smallest partner, by comparing all fingerprints."""
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= max_bits) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


def test_odd_rows(spark, odd_texts):
    rows = list(enumerate(odd_texts)) + [(3, odd_texts[3]), (5, "one two"), (None, odd_texts[7]), (None, "alone, without an id")]
    table = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").repartition(4)
    found = simhash_vp.near_duplicates(table)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_components(rows)
    assert simhash_vp.near_duplicates(table.limit(0)).count() == 0


def test_spark_hash_is_the_same(spark):
    text = "Some words, é and more"
    found = spark.sql(f"select xxhash64('{text}') h").first().h
    assert found == np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)


@pytest.mark.parametrize(
    ("shard_points", "leaf", "home", "passing"), [(10**6, 256, 10**6, 10**6), (40, 256, 10**6, 50), (40, 4, 7, 30), (300, 16, 60, 100), (10**6, 256, 90, 10**6)]
)
def test_links_connect_all_close_points(spark, monkeypatch, shard_points, leaf, home, passing):
    monkeypatch.setattr(simhash_vp, "LEAF_POINTS", leaf)
    monkeypatch.setattr(simhash_vp, "PASSING", passing)
    chance = random.Random(9)
    points = {chance.getrandbits(64) for _ in range(500)}
    for p in list(points)[:120]:  # chains and clusters
        for _ in range(chance.randint(1, 6)):
            for _ in range(chance.randint(1, 4)):
                p ^= 1 << chance.randrange(64)
            points.add(p)
    values = np.array(sorted(points), dtype=np.uint64)
    signed = values.view(np.int64)
    table = spark.createDataFrame([(int(v),) for v in signed], "fp long").repartition(3)
    links = simhash_vp.similar_links(table, 3, shard_points, home)
    pairs = {(r.a, r.b) for r in links.collect()}
    assert all(int(np.uint64(a % 2**64) ^ np.uint64(b % 2**64)).bit_count() <= 64 for a, b in pairs)
    roots = {r.node: r.root for r in star_roots(links, "a", "b").collect()}
    expected = plain_sets(values)
    found = {}
    for v in signed.tolist():
        found.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, found.values())) == expected


def test_a_shard_is_divided_into_blocks(spark):
    """However many points a shard has of its own, no block is much larger than asked for, and no pair is lost."""
    rng = np.random.default_rng(12)
    values = rng.integers(0, 2**64, 12_000, dtype=np.uint64)
    near = values[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    values = np.unique(np.concatenate([values, near, near[:500] ^ np.uint64(5)]))
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(4)
    nodes = simhash_vp.build_tree(values[::30], 4)
    blocks = simhash_vp.blocks_of(table, nodes, 3, len(values), 500)
    shard, index, home = simhash_vp.route(nodes, values, 3)
    own = np.bincount(shard[home], minlength=len(blocks))
    assert (blocks == np.maximum(1, -(-own // 500))).all() and own.sum() == len(values)
    mine = simhash_vp.scramble(values[index[home]] + np.uint64(1)) % blocks[shard[home]].astype(np.uint64)
    assert np.unique(shard[home] * 1000 + mine.astype(np.int64), return_counts=True)[1].max() <= 700
    roots = {r.node: r.root for r in star_roots(simhash_vp.similar_links(table, 3, 4000, 500), "a", "b").collect()}
    found = {}
    for v in values.view(np.int64).tolist():
        found.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, found.values())) == plain_sets(values)


def plain_sets(values):
    sets = {int(v): {int(v)} for v in values.view(np.int64)}
    for i, v in enumerate(values):
        for w in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ v) <= 3]:
            a, b = sets[int(v.view(np.int64))], sets[int(w.view(np.int64))]
            if a is not b:
                a |= b
                for x in b:
                    sets[x] = a
    return sorted(sorted(s) for s in {id(s): s for s in sets.values()}.values())


def test_star_roots_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2001, 2000), (5, 5), (2001, 2000)]
    table = spark.createDataFrame(links, "a long, b long")
    roots = {r.node: r.root for r in star_roots(table, "a", "b").collect()}
    assert roots == {i: 0 for i in range(1, 101)} | {1000 + i: 1000 for i in range(1, 60)} | {2001: 2000}
    assert star_roots(table.limit(0), "a", "b").count() == 0


def test_registered_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op6_simhash_vp"](spark, sf_dir).collect()), key=repr) == plain_components(rows)
