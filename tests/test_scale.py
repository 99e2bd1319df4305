"""The skew-proof building blocks against plain Python, with blocks and tasks made tiny."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import scale


def rows_with_hot_group(seed, spread):
    rng = random.Random(seed)
    ids = rng.sample(range(-200, spread), 300)
    return [("hot" if rng.random() < 0.5 else f"p{rng.randint(0, 5)}", i, rng.randint(0, 9)) for i in ids]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("spread", [400, 10**15])
def test_ordinal(spark, seed, spread):
    rows = rows_with_hot_group(seed, spread)
    df = spark.createDataFrame(rows, "g string, id long, v int").repartition(7)
    got = {(r.g, r.id): (r.ord, r.n) for r in scale.ordinal(df, ["g"], "id", total="n").collect()}
    assert len(got) == len(rows)
    for group in {r[0] for r in rows}:
        ids = sorted(r[1] for r in rows if r[0] == group)
        for i, one in enumerate(ids):
            assert got[(group, one)] == (i, len(ids))


def test_ordinal_within(spark):
    rng = random.Random(3)
    rows = sorted({(f"p{rng.randint(0, 2)}", rng.randint(0, 60), rng.randint(0, 6)) for _ in range(300)})
    df = spark.createDataFrame(rows, "g string, id long, pos int")
    got = {(r.g, r.id, r.pos): r.ord for r in scale.ordinal(df, ["g"], "id", within="pos").collect()}
    for group in ("p0", "p1", "p2"):
        for i, row in enumerate(r for r in rows if r[0] == group):
            assert got[row] == i


def test_running_start_with_weights(spark):
    rows = rows_with_hot_group(5, 500)
    df = spark.createDataFrame(rows, "g string, id long, v int")
    got = {(r.g, r.id): (r._start, r._total) for r in scale.running_start(df, ["g"], "id", F.col("v")).collect()}
    for group, one, _ in rows:
        mine = [(i, v) for g, i, v in rows if g == group]
        assert got[(group, one)] == (sum(v for i, v in mine if i < one), sum(v for _, v in mine))


def test_neighbours(spark):
    rows = rows_with_hot_group(9, 900)
    df = spark.createDataFrame(rows, "g string, id long, v int").select("g", "id")
    got = {(r.g, r.id): (r.prev_id, r.next_id) for r in scale.neighbours(df, ["g"], "id", "id").collect()}
    assert len(got) == len(rows)
    for group in {r[0] for r in rows}:
        ids = sorted(r[1] for r in rows if r[0] == group)
        for i, one in enumerate(ids):
            assert got[(group, one)] == (ids[i - 1] if i else None, ids[i + 1] if i + 1 < len(ids) else None)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("rows_per_task", [5, 40, 1_000_000])
def test_lookup_join(spark, how, rows_per_task):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 10 + ["a", "b", "c", None])) for i in range(400)]
    lookup = {"hot": 1, "a": 2, "z": 3}
    left = spark.createDataFrame(rows, "id int, k string")
    right = spark.createDataFrame(list(lookup.items()), "k string, v int")
    got = sorted((r.id, r.k, r.v) for r in scale.lookup_join(left, right, ["k"], "id", how, rows_per_task).collect())
    expected = sorted((i, k, lookup.get(k)) for i, k in rows if how == "left" or k in lookup)
    assert got == expected


def test_lookup_join_splits_hot_keys(spark):
    left = spark.range(100).select("id", F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    plan = scale.lookup_join(left, right, ["k"], "id", rows_per_task=10)
    assert plan.count() == 100 and plan.agg(F.sum("v")).first()[0] == 100


def test_first_n(spark):
    rows = rows_with_hot_group(4, 700)
    df = spark.createDataFrame(rows, "g string, id long, v int")
    got = sorted((r.g, r.id) for r in scale.first_n(df, ["g"], ["id"], 3).collect())
    groups = {r[0] for r in rows}
    assert got == sorted((g, i) for g in groups for i in sorted(r[1] for r in rows if r[0] == g)[:3])


@pytest.mark.parametrize("ids", ["hashed", "counted"])
def test_a_hot_group_lies_in_several_ranges(spark, ids):
    """Nine rows in ten are of one group; no range, so no window, holds much more than its share."""
    number = F.xxhash64("id") if ids == "hashed" else F.col("id")
    df = spark.range(8000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("g"), number.alias("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would share one task
    try:
        placed = scale._placed(df, ["g"], ["id"])
        sizes = [r["count"] for r in placed.groupBy("__part", "g").count().filter("g = 'hot'").collect()]
        assert len(sizes) >= 6 and max(sizes) <= 3 * 8000 / 8
        got = scale.ordinal(df, ["g"], "id", total="n").filter("g = 'hot'").collect()
        assert [r.ord for r in sorted(got, key=lambda r: r.id)] == list(range(7200)) and {r.n for r in got} == {7200}
        beside = {r.id: (r.prev_id, r.next_id) for r in scale.neighbours(df, ["g"], "id", "id").filter("g = 'hot'").collect()}
        every = sorted(beside)
        assert all(beside[i] == (every[k - 1] if k else None, every[k + 1] if k + 1 < len(every) else None) for k, i in enumerate(every))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_wide_rows_are_numbered_with_one_exchange(spark, coalesce):
    rows = [(g, i, f"{g}/{i}") for g, i, _ in rows_with_hot_group(21, 900)] + [("a", 5, "a/5"), ("zz", 1, "zz/1"), ("zz", 2, "zz/2")]
    df = spark.createDataFrame(rows, "g string, id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        made = scale.numbered_once(df, "g", "id")
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange rangepartitioning(") == 1 and "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan
        got = made.withColumn("at", F.monotonically_increasing_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = sorted((r.g, r.id) for r in got)
    assert [(r.g, r.id) for r in sorted(got, key=lambda r: r.at)] == ordered and all(r.text == f"{r.g}/{r.id}" for r in got)
    for group in {r.g for r in got}:
        mine = [i for g, i in ordered if g == group]
        assert {(r.id, r.ord, r.is_last) for r in got if r.g == group} == {(i, k, k + 1 == len(mine)) for k, i in enumerate(mine)}
