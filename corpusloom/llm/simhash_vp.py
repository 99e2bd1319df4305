"""SimHash near-duplicates through vantage-point trees.

A fingerprint is 64 majority bits over the XXH64 hashes of word shingles. Equal fingerprints
are one point. The top of a vantage-point tree is built from a small sample of the points:
each inner node has a vantage point and a radius, points within the radius go to one side, the
others to the other side, and the leaves are shards. A point lives in one shard, and by the
triangle inequality a partner within ``max_bits`` can only live in shards whose nodes it
reaches with that tolerance; it is sent to those that come after its own, so every pair meets
in one shard. A shard with many points of its own is divided into blocks of them: a task holds one block, and
all other points of the shard stream past it. A block goes on splitting in the same way and compares only what no
bound excludes. It returns a spanning forest of its links, not all pairs, and the links become
components in ``components.star_roots``.

Texts are lower-cased in A-Z and split at ASCII white space; with fewer words than the shingle
length the whole sequence is the one shingle; null and empty texts have fingerprint zero and
are linked like any other. Rows with a null ``doc_id`` are points too but give no component
number; an empty table gives an empty result; other columns are not carried.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, expand, keep, short_batches, text_bytes
from .components import star_roots
from .pieces import key, scramble

#: Points a shard should have, leaves of the tree at most (each split copies points near its border), and sample points per shard.
SHARD_POINTS = 32768
MAX_SHARDS = 4096
SAMPLED = 64
#: About so many points of a shard's own are a block; so many others are compared with it at a time.
HOME_POINTS = 1 << 17
PASSING = 1 << 16
#: Below so many points all are compared; so many comparisons are made at a time.
LEAF_POINTS = 256
BLOCK = 1 << 20
HASHES = 1 << 17


def shingle_hashes(text: bytes, length: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, at most ``HASHES`` at a time."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= length:
        yield np.array([digest(joined, seed)], dtype=np.uint64)
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts, ends = (ends - sizes + 1)[: len(words) - length + 1], ends[length - 1 :]
    for first in range(0, len(starts), HASHES):
        part = zip(starts[first : first + HASHES].tolist(), ends[first : first + HASHES].tolist(), strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in part], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, length: int = 3) -> int:
    total, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, length):
        total += bit_counts(hashes)
        n += len(hashes)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, k, fp): the key of id and text, and the fingerprint's 64 bits as a long."""
    short_batches(docs.sparkSession)

    def compute(batches):
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in text_bytes(batch)], dtype=np.uint64)
            arrays = [batch.column("doc_id"), batch.column("k"), pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "k", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key().alias("k"))
    return source.mapInArrow(compute, "doc_id long, k binary, fp long")


def distance(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point).astype(np.int16)


def radius(distances: np.ndarray) -> int:
    """The median, lowered where nothing would lie outside."""
    return int(min(np.median(distances), distances.max() - 1))


def build_tree(sample: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, inside, outside); a negative child -k - 1 is shard k."""
    nodes, leaves = [], 0

    def grow(points: np.ndarray, wanted: int) -> int:
        nonlocal leaves
        if wanted <= 1 or len(points) < 2:
            leaves += 1
            return -leaves
        candidates = points[:: max(1, len(points) // 8)][:8]
        vantage = max(candidates, key=lambda c: distance(points, c).std())
        away = distance(points, vantage)
        if away.max() == 0:
            leaves += 1
            return -leaves
        cut, at = radius(away), len(nodes)
        nodes.append((int(vantage), cut, 0, 0))
        inside = grow(points[away <= cut], wanted // 2)
        outside = grow(points[away > cut], wanted - wanted // 2)
        nodes[at] = (int(vantage), cut, inside, outside)
        return at

    grow(sample, shards)
    return nodes


def route(nodes: list, points: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, index of the point, at home): each point's own shard and the later ones within reach."""
    own = np.zeros(len(points), dtype=np.int32)
    shards, indexes = [], []
    todo = [(0 if nodes else -1, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node < 0:
            own[at[home]] = -node - 1
            shards.append(np.full(len(at), -node - 1, dtype=np.int32))
            indexes.append(at)
            continue
        vantage, cut, inside, outside = nodes[node]
        away = distance(points[at], np.uint64(vantage))
        near, far = away <= cut + max_bits, away > cut - max_bits
        todo.append((inside, at[near], (home & (away <= cut))[near]))
        todo.append((outside, at[far], (home & (away > cut))[far]))
    shard, index = np.concatenate([np.zeros(0, np.int32), *shards]), np.concatenate([np.zeros(0, np.int64), *indexes])
    later = shard >= own[index]
    return shard[later], index[later], (shard == own[index])[later]


class Forest:
    """Disjoint sets over 0..n-1; links are merged array by array."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        while True:
            x, y = parent[a], parent[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up


def link(points: np.ndarray, queries: np.ndarray, values: np.ndarray, max_bits: int, forest: Forest) -> None:
    """Merge every query with every point within ``max_bits``; points and queries are indexes of ``values``."""
    todo = [(points, queries)]
    while todo:
        points, queries = todo.pop()
        if not len(points) or not len(queries):
            continue
        if len(points) <= LEAF_POINTS:
            step = max(1, BLOCK // len(points))
            for first in range(0, len(queries), step):
                part = queries[first : first + step]
                q, p = np.nonzero(np.bitwise_count(values[part][:, None] ^ values[points][None, :]) <= max_bits)
                forest.join(part[q], points[p])
            continue
        some = points[:: len(points) // 4][:4]
        vantage = max((values[s] for s in some), key=lambda v: distance(values[points[:1024]], v).std())
        away, reach = distance(values[points], vantage), distance(values[queries], vantage)
        cut = radius(away)
        todo.append((points[away <= cut], queries[reach <= cut + max_bits]))
        todo.append((points[away > cut], queries[reach > cut - max_bits]))


class HomeBlock:
    """A block's own points; others are linked to them as they pass. Gives the links that joined something."""

    def __init__(self, values: np.ndarray, max_bits: int):
        self.values, self.max_bits = values, max_bits
        self.forest = Forest(len(values))
        link(np.arange(len(values)), np.arange(len(values)), values, max_bits, self.forest)

    def own_links(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.forest.parent != np.arange(len(self.values)))
        return self.values[child], self.values[self.forest.parent[child]]

    def passing(self, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.values)
        both = np.concatenate([self.values, others])
        forest = Forest(len(both))
        forest.parent[:n] = self.forest.parent
        link(np.arange(n), np.arange(n, len(both)), both, self.max_bits, forest)
        # the smaller number is the parent, so own points keep parents among themselves
        new = np.flatnonzero(forest.parent != np.concatenate([self.forest.parent, np.arange(n, len(both))]))
        self.forest.parent = forest.parent[:n].copy()
        return both[new], both[forest.parent[new]]


def blocks_of(points: DataFrame, nodes: list, max_bits: int, total: int, home_points: int) -> np.ndarray:
    """Blocks of every shard, from the number of its own points; one value for each leaf of the tree."""
    leaves = len(nodes) + 1
    if total <= home_points:
        return np.ones(leaves, dtype=np.int64)
    tree = points.sparkSession.sparkContext.broadcast(nodes)

    def own(batches):
        counts = np.zeros(leaves, dtype=np.int64)
        for batch in batches:
            shard, _, home = route(tree.value, batch.column(0).to_numpy().view(np.uint64), max_bits)
            counts += np.bincount(shard[home], minlength=leaves)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(leaves)), pa.array(counts)], names=["shard", "n"])

    sizes = points.select("fp").mapInArrow(own, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()  # one row per leaf
    found = np.ones(leaves, dtype=np.int64)
    for r in sizes:
        found[r["shard"]] = max(1, -(-r["n"] // home_points))
    return found


def similar_links(points: DataFrame, max_bits: int = 3, shard_points: int = SHARD_POINTS, home_points: int = HOME_POINTS) -> DataFrame:
    """Links (a, b) that connect exactly the points, distinct values of ``fp``, within ``max_bits`` of each other."""
    spark = points.sparkSession
    total = points.count()
    shards = min(MAX_SHARDS, max(1, 2 ** math.ceil(math.log2(max(1, total / shard_points)))))
    nodes = []
    if shards > 1:  # SAMPLED points per shard, a small part of all
        sample = bounded_sample(points.select("fp"), "fp", SAMPLED * shards, total).collect()
        nodes = build_tree(np.array([r[0] for r in sample], dtype=np.int64).view(np.uint64), shards)
    blocks = blocks_of(points, nodes, max_bits, total, home_points)
    plan = spark.sparkContext.broadcast((nodes, blocks, np.cumsum(blocks) - blocks))

    def send(batches):
        nodes, blocks, first = plan.value
        for batch in batches:
            values = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            shard, index, home = route(nodes, values.view(np.uint64), max_bits)
            mine = (scramble(values.view(np.uint64)[index] + np.uint64(1)) % blocks[shard].astype(np.uint64)).astype(np.int64)
            # a visitor passes all blocks of the shard, an own point those before its block
            passes = np.where(home, mine, blocks[shard])
            past = expand(first[shard], passes)
            unit = np.concatenate([(first[shard] + mine)[home], past])
            sent = np.concatenate([values[index[home]], np.repeat(values[index], passes)])
            kind = np.repeat([0, 1], [int(home.sum()), len(past)])
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(kind, pa.int32()), pa.array(sent)], names=["unit", "kind", "fp"])

    def compare(batches):
        def links(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        unit, block, waiting, size = None, None, [], 0

        def flush():
            if not waiting:
                return None
            values = np.concatenate(waiting)
            waiting.clear()
            return values

        for batch in batches:
            units, kinds = batch.column("unit").to_numpy(), batch.column("kind").to_numpy()
            values = batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(units, prepend=-1) != 0) | (np.diff(kinds, prepend=-1) != 0)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(units)], strict=True):
                starts_unit, meets = units[a] != unit, kinds[a] == 1 and block is None and units[a] == unit
                if starts_unit or meets:
                    # what has gathered is the block itself, or points that have passed it
                    gathered = flush()
                    size = 0
                    if gathered is not None:
                        if block is None:
                            block = HomeBlock(gathered, max_bits)
                            yield links(*block.own_links())
                        else:
                            yield links(*block.passing(gathered))
                if starts_unit:
                    unit, block = units[a], None
                    if kinds[a] == 1:  # nobody lives here
                        block = HomeBlock(np.zeros(0, np.uint64), max_bits)
                waiting.append(values[a:b])
                size += b - a
                if block is not None and size >= PASSING:
                    yield links(*block.passing(flush()))
                    size = 0
        gathered = flush()
        if gathered is not None:
            if block is None:
                yield links(*HomeBlock(gathered, max_bits).own_links())
            else:
                yield links(*block.passing(gathered))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = points.select("fp").mapInArrow(send, "unit long, kind int, fp long").repartition(tasks, "unit")
    return routed.sortWithinPartitions("unit", "kind").mapInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, shingle: int = 3, max_bits: int = 3, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(fp, doc_id, k, root, component_id): ``root`` names the group of a row, whatever its ids."""
    prints = keep(fingerprints(docs, shingle))
    points = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = star_roots(similar_links(points.select("fp"), max_bits, shard_points), "a", "b")
    labelled = keep(points.join(roots, points["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    components = keep(labelled.groupBy("root").agg(F.min("first").alias("component_id")))
    return prints.join(labelled.join(components, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints a chain of links joins share a component."""
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return grouped(docs, shingle, max_bits, shard_points).select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 3, shard_points: int = SHARD_POINTS) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, all columns kept; null ids come last.

    Of rows that repeat an id and text the smallest stays, columns compared in their order (any one, where a column has no order).
    """
    rows = keep(grouped(docs, shingle, max_bits, shard_points).select("k", "root", F.struct(F.col("doc_id").isNull(), "doc_id", "k").alias("order")))
    best = keep(rows.groupBy("root").agg(F.min("order").alias("best")))
    judged = rows.join(best, "root").select("k", (F.col("order") == F.col("best")).alias("stays"))
    counts = keep(judged.groupBy("k", "stays").agg(F.count("*").alias("n")).filter("n > 1 or not stays"))
    name = "__near_key"
    # the same join at every size: the list grows with the corpus, so it is never broadcast
    listed = counts.select(F.col("k").alias(name), "stays")
    marked = docs.withColumn(name, key()).join(listed.withColumnRenamed("stays", f"{name}_stays").hint("merge"), name, "left")
    kept = marked.filter(F.col(f"{name}_stays").isNull()).select(*docs.columns)
    if listed.filter("stays").isEmpty():
        return kept
    repeated = marked.filter(F.col(f"{name}_stays"))
    if any(word in docs.schema.simpleString() for word in ("map<", "variant", "void")):
        return kept.union(repeated.dropDuplicates([name]).select(*docs.columns))
    least = F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(f"{name}_row")
    return kept.union(repeated.groupBy(name).agg(least).select(f"{name}_row.*"))
