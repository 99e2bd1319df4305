"""Exact search for the largest inner products with cover trees over queries and data.

Every different vector is one point; it keeps as many of its smallest ids as an answer can use.
The top level of both trees is a net of centres chosen farthest first from a bounded sample; every
point, query or not, belongs to its nearest centre, and a centre with many points has several units. Pairs of
a query group and a unit are pruned by covering radii: no inner product between two balls exceeds

    <c, d> + r |d| + s |c| + r s        (centres c and d, covering radii r and s)

so where that is below the group's worst k-th score so far, the pair is never made. The first such scores
come from the sample. A unit then builds a cover tree of every block of its points, each group that
visits it one of its queries, and both are descended together, best bound first, under the same rule.
Scores are integers and exact; nothing is approximate.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import lookup_join
from .common import bounded_sample, expand, keep, short_batches

#: Different vectors that the centres and the first scores come from.
SAMPLE = 2048
#: Centres at most, points of a unit, points of a tree, points and queries of a leaf, components of a query group.
CENTRES, UNIT, BLOCK, LEAF, FEW, GROUP = 256, 32_768, 2048, 32, 8, 16_384
LOWEST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Products of components are exact in double precision up to here.
EXACT = 2**53


class CoverTree:
    """Nodes with centre, covering radius and either children or points.

    The children of a node are a net of its points: farther apart than half the node's radius, and every
    point nearer than that to its child's centre. Children of one point lie in one leaf.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.norms = points, (points * points).sum(1)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        todo = [(0, np.arange(len(points)), -1)] if len(points) else []
        while todo:
            centre, members, parent = todo.pop()
            away = self._distance(centre, members)
            number = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(away.max()))
            self.members.append(members)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(number)
            if len(members) > leaf and self.radius[number] > 0:
                todo += [(c, m, number) for c, m in self._net(centre, members, away)]

    def _distance(self, centre: int, members: np.ndarray) -> np.ndarray:
        squares = self.norms[members] + self.norms[centre] - 2 * (self.points[members] @ self.points[centre])
        squares[members == centre] = 0
        return np.sqrt(np.maximum(squares, 0))

    def _net(self, centre: int, members: np.ndarray, away: np.ndarray) -> list[tuple[int, np.ndarray]]:
        wide = away.max() / 2
        centres, owner, near = [centre], np.zeros(len(members), dtype=np.int64), away.copy()
        while near.max() > wide:
            centres.append(int(members[near.argmax()]))
            other = self._distance(centres[-1], members)
            closer = other < near
            near[closer], owner[closer] = other[closer], len(centres) - 1
        counts = np.bincount(owner, minlength=len(centres))
        if len(centres) == len(members):
            return []
        parts = [(c, members[owner == k]) for k, c in enumerate(centres) if counts[k] > 1]
        lone = members[counts[owner] == 1]
        return parts + ([(int(lone[0]), lone)] if len(lone) else [])

    def ball(self, node: int) -> tuple[np.ndarray, float, float]:
        """(centre, covering radius, length of the centre)"""
        return self.points[self.centre[node]], self.radius[node], float(np.sqrt(self.norms[self.centre[node]]))


def highest(one: tuple[np.ndarray, float, float], two: tuple[np.ndarray, float, float]) -> float:
    """No inner product of a point of one ball with a point of the other is larger."""
    (c, r, long_c), (d, s, long_d) = one, two
    bound = float(c @ d) + r * long_d + s * long_c + r * s
    return bound + 1 + 1e-6 * (long_c + r) * (long_d + s)


def inner_products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact scores; one beyond 64 bits raises an error."""
    largest = int(max(queries.max(), -queries.min())) * int(max(points.max(), -points.min())) if queries.size and points.size else 0
    if largest * queries.shape[1] < EXACT:
        return (queries.astype(np.float64) @ points.astype(np.float64).T).astype(np.int64)
    return (queries.astype(object) @ points.astype(object).T).astype(np.int64)


class Best:
    """The best (score, id) entries of each query, by score and then by the smaller id."""

    def __init__(self, size: int, depth: int, floor: np.ndarray | None = None):
        self.scores = np.full((size, depth), LOWEST, dtype=np.int64)
        self.ids = np.full((size, depth), NO_ID, dtype=np.int64)
        self.floor = np.full(size, LOWEST, dtype=np.int64) if floor is None else floor.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Entries of the queries ``rows``, in any order."""
        if not len(rows):
            return
        depth = self.scores.shape[1]
        which, place = np.unique(rows, return_inverse=True)
        row = np.concatenate([place, np.repeat(np.arange(len(which)), depth)])
        scores = np.concatenate([scores, self.scores[which].ravel()])
        ids = np.concatenate([ids, self.ids[which].ravel()])
        by = np.lexsort((ids, ~scores, row))
        first = np.flatnonzero(np.diff(row[by], prepend=-1))
        taken = by[expand(first, np.full(len(first), depth))]
        self.scores[which], self.ids[which] = scores[taken].reshape(-1, depth), ids[taken].reshape(-1, depth)
        self.floor[which] = np.maximum(self.floor[which], self.scores[which, -1])


class Block:
    """Points with their ids and tree."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids, self.tree = points, ids, CoverTree(points.astype(np.float64), LEAF)

    def search(self, queries: np.ndarray, tree: CoverTree, best: Best) -> None:
        """Descend both trees together, the pair with the highest bound first."""
        if not tree.centre or not self.tree.centre:
            return
        todo = [(highest(tree.ball(0), self.tree.ball(0)), 0, 0)]
        while todo:
            bound, q, d = todo.pop()
            if bound < best.floor[tree.members[q]].min():
                continue
            below, inside = tree.children[q], self.tree.children[d]
            if not below and not inside:
                self._compare(queries, tree.members[q], self.tree.members[d], best)
                continue
            if inside and (not below or self.tree.radius[d] >= tree.radius[q]):
                pairs = [(q, c) for c in inside]
            else:
                pairs = [(c, d) for c in below]
            todo += sorted((highest(tree.ball(a), self.tree.ball(b)), a, b) for a, b in pairs)

    def _compare(self, queries: np.ndarray, asked: np.ndarray, members: np.ndarray, best: Best) -> None:
        scores = inner_products(queries[asked], self.points[members])
        row, column = np.nonzero(scores >= best.floor[asked][:, None])
        found = self.ids[members[column]]
        real = found != NO_ID
        best.add(np.repeat(asked[row], real.sum(1)), np.repeat(scores[row, column], real.sum(1)), found[real])


def padded(rows: list[np.ndarray], width: int, fill: int = 0) -> np.ndarray:
    out = np.full((len(rows), width), fill, dtype=np.int64)
    for row, values in zip(out, rows, strict=True):
        row[: len(values)] = values
    return out


def _matrix(column: pa.Array, width: int, fill: int = 0) -> np.ndarray:
    """A column of lists as an array; shorter lists are filled up."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    return padded(np.split(flat, np.cumsum(lengths)[:-1]), width, fill) if len(lengths) else np.zeros((0, width), np.int64)


def net(sample: np.ndarray, size: int) -> np.ndarray:
    """At most ``size`` rows of the sample, chosen farthest first."""
    points = sample.astype(np.float64)
    chosen, near = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < size and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, distance) of every point."""
    points = points.astype(np.float64)
    squares = (points * points).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * (points @ centres.T)
    which = squares.argmin(1)
    return which, np.sqrt(((points - centres[which]) ** 2).sum(1))


def _assign(points: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """``points`` with ``centre`` and ``away``, kept."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                which, away = nearest(_matrix(batch.column("vector"), width), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(which, pa.int32()), pa.array(away)], names=[*batch.schema.names, "centre", "away"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return keep(points.mapInArrow(run, f"{fields}, centre int, away double"))


def _numbered(points: DataFrame, size: int, name: str) -> DataFrame:
    """Points of a centre dealt to as many numbered parts as hold about ``size`` points each."""
    counts = points.groupBy("centre").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
    first = F.sum("parts").over(Window.partitionBy(F.lit(0)).orderBy("centre").rowsBetween(Window.unboundedPreceding, -1))
    # at most CENTRES rows
    starts = F.broadcast(counts.withColumn("first", F.coalesce(first, F.lit(0))))
    return points.join(starts, "centre").withColumn(name, (F.col("first") + F.pmod("h1", "parts")).cast("long")).drop("parts", "first")


def _groups(queries: DataFrame, sample: np.ndarray, width: int, depth: int) -> DataFrame:
    """(group, centre, radius, worst, h1s, h2s, vector, bounds): queries of a centre together, with the scores the sample gives; kept."""
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vector"))
    each = F.struct("h1", "h2", "away", F.concat("vector", zeros).alias("vector"))
    rows = _numbered(queries, max(1, GROUP // max(1, width)), "group").groupBy("group", "centre").agg(F.collect_list(each).alias("q"))
    rows = rows.select(
        "group", "centre", F.array_max("q.away").alias("radius"), F.col("q.h1").alias("h1s"), F.col("q.h2").alias("h2s"), F.flatten("q.vector").alias("vector")
    )
    shared = queries.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        for batch in batches:
            bounds = []
            for n, flat in zip(batch.column("h1s").value_lengths().to_pylist(), batch.column("vector"), strict=True):
                scores = inner_products(flat.values.to_numpy().reshape(n, width), shared.value)
                place = scores.shape[1] - depth
                bounds.append(np.partition(scores, place, axis=1)[:, place] if place >= 0 else np.full(n, LOWEST))
            worst = pa.array([int(b.min()) for b in bounds], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, worst, pa.array(bounds, pa.list_(pa.int64()))], names=[*batch.schema.names, "worst", "bounds"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return keep(rows.mapInArrow(run, f"{fields}, worst long, bounds array<bigint>"))


def _visits(groups: DataFrame, points: DataFrame, centres: np.ndarray) -> DataFrame:
    """(unit, group, ...): groups with every unit that may hold one of their answers."""
    spark = groups.sparkSession
    asked = groups.groupBy("centre").agg(F.max("radius").alias("r"), F.min("worst").alias("worst")).collect()
    given = points.groupBy("centre").agg(F.max("away").alias("s")).collect()
    long = np.sqrt((centres * centres).sum(1))
    pairs = []
    for q in asked:
        for d in given:
            one, two = (centres[q["centre"]], q["r"], float(long[q["centre"]])), (centres[d["centre"]], d["s"], float(long[d["centre"]]))
            if highest(one, two) >= q["worst"]:
                pairs.append((q["centre"], d["centre"], float(one[0] @ two[0]), one[2], two[2]))
    # at most CENTRES ** 2 rows
    near = F.broadcast(spark.createDataFrame(pairs, "centre int, other int, dot double, long_c double, long_d double"))
    units = points.groupBy("unit", F.col("centre").alias("other")).agg(F.max("away").alias("s"))
    met = groups.join(near, "centre").join(units, "other")
    reach = F.expr("dot + radius * long_d + s * long_c + radius * s + 1 + 1e-6 * (long_c + radius) * (long_d + s)")
    return met.filter(reach >= F.col("worst"))


def _search(points: DataFrame, visits: DataFrame, width: int, depth: int) -> DataFrame:
    """(group, h1s, h2s, scores, ids): the best entries of every group in every unit that it visits."""
    none = F.array().cast("array<bigint>")
    columns = ["unit", "kind", "group", "h1s", "h2s", "vector", "values"]
    data = points.select(
        "unit", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("group"), none.alias("h1s"), none.alias("h2s"), "vector", F.col("ids").alias("values")
    )
    asked = visits.select("unit", F.lit(1).alias("kind"), "group", "h1s", "h2s", "vector", F.col("bounds").alias("values"))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = data.select(*columns).unionByName(asked.select(*columns)).repartition(tasks, "unit").sortWithinPartitions("unit", "kind")

    def run(batches):
        unit, vectors, ids, blocks = None, [], [], []
        for batch in batches:
            kinds, at = batch.column("kind").to_numpy(), batch.column("unit").to_numpy()
            cuts = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(kinds, prepend=-1) != 0)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                part = batch.slice(a, b - a)
                if at[a] != unit:
                    unit, vectors, ids, blocks = at[a], [], [], []
                if kinds[a] == 0:
                    vectors.append(_matrix(part.column("vector"), width))
                    ids.append(_matrix(part.column("values"), depth, NO_ID))
                    continue
                if vectors:
                    every, names = np.concatenate(vectors), np.concatenate(ids)
                    blocks += [Block(every[k : k + BLOCK], names[k : k + BLOCK]) for k in range(0, len(every), BLOCK)]
                    vectors, ids = [], []
                for n in range(part.num_rows):
                    row = {name: part.column(name)[n].values.to_numpy() for name in ("vector", "values")}
                    queries = row["vector"].reshape(-1, width)
                    tree, best = CoverTree(queries.astype(np.float64), FEW), Best(len(queries), depth, row["values"])
                    for block in blocks:
                        block.search(queries, tree, best)
                    many = pa.list_(pa.int64())
                    arrays = [part.column(name).slice(n, 1) for name in ("group", "h1s", "h2s")]
                    arrays += [pa.array([best.scores.ravel()], many), pa.array([best.ids.ravel()], many)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["group", "h1s", "h2s", "scores", "ids"])

    return rows.mapInArrow(run, "group long, h1s array<bigint>, h2s array<bigint>, scores array<bigint>, ids array<bigint>")


def _merge(found: DataFrame, depth: int) -> DataFrame:
    """(h1, h2, ids, scores): the best entries of each different query, kept."""
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        def done():
            many = pa.list_(pa.int64())
            real = best.ids != NO_ID
            arrays = [pa.array(h1), pa.array(h2), pa.array([i[r] for i, r in zip(best.ids, real, strict=True)], many)]
            arrays.append(pa.array([s[r] for s, r in zip(best.scores, real, strict=True)], many))
            return pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "ids", "scores"])

        group = best = None
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n] for name in batch.schema.names}
                scores, ids = (row[c].values.to_numpy() for c in ("scores", "ids"))
                if row["group"].as_py() != group:
                    if best is not None:
                        yield done()
                    group, h1, h2 = row["group"].as_py(), row["h1s"].values, row["h2s"].values
                    best = Best(len(h1), depth)
                real = ids != NO_ID
                best.add(np.repeat(np.arange(len(h1)), depth)[real], scores[real], ids[real])
        if best is not None:
            yield done()

    return keep(found.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(run, "h1 long, h2 long, ids array<bigint>, scores array<bigint>"))


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is a query, the ``k`` other rows with the largest inner product.

    ``vector`` holds whole numbers; ``is_query`` depends on the id only. Equal scores go by the smaller id; fewer rows than ``k`` are all
    returned. Rows with a null id, a null vector or a null component take no part. Rows equal in
    id and vector are one row; an id with several vectors is a row for each, of which none answers another.
    A shorter vector is filled up with zeros. A score beyond 64 bits raises an error. Other columns are not read, whatever their names. An
    empty table gives no rows.

    The sample of ``SAMPLE`` different vectors only places centres and starts the bounds; every row is indexed.
    """
    spark, depth = vectors.sparkSession, k + 1
    short_batches(spark)  # a row may hold a whole query group
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<bigint>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.filter("id is not null and vector is not null and not exists(vector, x -> x is null)")
    rows = rows.select("*", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2"))
    once = F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("asked"))
    rows = keep(rows.withColumn("_n", once).filter("_n = 1").drop("_n"))

    same = Window.partitionBy("h1", "h2")
    least = rows.withColumn("_n", F.row_number().over(same.orderBy("id"))).filter(F.col("_n") <= depth)
    points = keep(least.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector")))
    queries = rows.filter("asked").withColumn("_n", F.row_number().over(same.orderBy("id"))).filter("_n = 1").select("h1", "h2", "vector")

    total, width = points.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    picked = bounded_sample(points.select("h1", "vector"), "h1", SAMPLE, total).select("vector").collect()
    sample = padded([np.array(r["vector"], dtype=np.int64) for r in picked], width)
    size = min(CENTRES, max(2 * spark.sparkContext.defaultParallelism, -(-total // UNIT)))
    centres = net(sample, size)
    points = _numbered(_assign(points, centres, width), UNIT, "unit")
    groups = _groups(_assign(queries, centres, width), sample, width, depth)
    best = _merge(_search(points, _visits(groups, points, centres), width, depth), depth)

    asked = rows.filter("asked").select("id", "h1", "h2")
    entries = F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda e: e["ids"] != F.col("id")), 1, k)
    answers = lookup_join(asked, best, ["h1", "h2"], "id", "inner").select("id", F.posexplode(entries).alias("at", "entry"))
    return answers.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("entry.ids").alias("vec_id"), F.col("entry.scores").alias("score"))
