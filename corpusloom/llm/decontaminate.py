"""Benchmark decontamination with spaced seeds.

A seed is the hash of five tokens chosen by a fixed mask, so tokens under the mask's gaps may
differ. The three masks together hit every overlap that ``verify`` accepts in its shortest
form: for 8 to 13 aligned tokens, a fifth of them replaced in any way, at least one mask falls
on equal tokens only (checked over all patterns in the tests).

Seeds of the benchmark are a table. Training texts are read once; a Bloom filter of fixed size
over the benchmark's seeds drops positions that cannot match before anything is shuffled. What
is left of a text is a few stretches: the hashes of the tokens around positions that passed, long ones cut into
pieces that share as many tokens as the longest item has. Their
seeds join the seed table; a hit says that item and text may be aligned with a certain shift,
and each (text, item, shift) is verified once, on the aligned tokens alone: some ``window`` aligned tokens, or the
whole item if it is shorter, of which at least ``similarity`` are equal and which contain a hit. ``first_token`` to
``end_token`` reach from the first such window of the best shift to the last; tokens between two of them may differ.
Texts themselves are never shuffled.

Tokens are runs of anything but ASCII white space, lower-cased in A-Z, without ASCII
punctuation at either end; tokens of punctuation only do not count. Items of fewer than
``LEAST`` tokens have no room for replaced tokens: they are matched whole, by one hash of all their tokens, and then token by
token; the first place in a text is given. Items without a token match nothing. Null texts are empty; null ids are
carried; a text is never cut, so a task's memory grows with the longest one; rows that repeat an id and text are one; empty tables give an empty result; other
columns are not carried by ``contaminated`` and all are kept by ``clean``.
"""

import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import keep, short_batches, slices, text_bytes

MASKS = ((0, 1, 3, 4, 5), (0, 1, 5, 6, 7), (0, 1, 2, 3, 5))
WINDOW, LEAST, SIMILARITY = 13, 8, 0.8
#: Bits of the Bloom filter; it is 2 MiB for any benchmark.
BLOOM_BITS = 24
#: Tokens of a piece of a long stretch, besides what it shares with its neighbours.
PIECE = 2048
EDGE = string.punctuation.encode()
ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]


def tokens(text: bytes) -> list[bytes]:
    return [t for t in (w.strip(EDGE) for w in text.lower().split()) if t]


def token_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def seeds(hashes: np.ndarray, mask: int) -> np.ndarray:
    """The seed at every position where the mask fits."""
    places = MASKS[mask]
    n = len(hashes) - places[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, mask + 1, dtype=np.uint64)
    for factor, at in zip(ODD, places, strict=True):
        total += pieces.scramble(hashes[at : at + n] * factor)
    return pieces.scramble(total)


def bloom_places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << BLOOM_BITS) - 1)
    return (values & low).astype(np.int64), ((values >> np.uint64(32)) & low).astype(np.int64)


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, tokens): one row per different benchmark row, tokens as hashes; kept."""

    def read(batches):
        for batch in batches:
            found = [token_hashes(tokens(t)).view(np.int64) for t in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("item_id"), pa.array(found, pa.list_(pa.int64()))], names=["item", "item_id", "tokens"]
            )

    rows = benchmark.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return keep(rows.dropDuplicates(["item"]).mapInArrow(read, "item long, item_id long, tokens array<bigint>").filter(F.size("tokens") > 0))


def seed_table(items: DataFrame) -> DataFrame:
    """(seed, item, at): every seed of every item; kept."""

    def make(batches):
        for batch in batches:
            for item, found in zip(batch.column("item").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                hashes = np.array(found, dtype=np.int64).view(np.uint64)
                for mask in range(len(MASKS)):
                    values = seeds(hashes, mask)
                    arrays = [pa.array(values.view(np.int64)), pa.array([item] * len(values), pa.int64()), pa.array(np.arange(len(values), dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["seed", "item", "at"])

    return keep(items.select("item", "tokens").mapInArrow(make, "seed long, item long, at int"))


def bloom(table: DataFrame) -> np.ndarray:
    """The filter as bytes; the driver gets at most its 2**(BLOOM_BITS - 6) words."""
    places = F.array(F.col("seed").bitwiseAND((1 << BLOOM_BITS) - 1), F.shiftrightunsigned("seed", 32).bitwiseAND((1 << BLOOM_BITS) - 1))
    each = table.select(F.explode(places).alias("p"))
    words = each.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash of the ``n`` tokens from every place on."""
    total = np.full(max(0, len(hashes) - n + 1), n, dtype=np.uint64)
    for j in range(n if len(total) else 0):
        total = pieces.scramble(total * ODD[0] + hashes[j : j + len(total)])
    return total


def whole_items(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, item_id, k, first_token, end_token, n_equal): the first place of every short item in every text that holds it."""

    def one(batches):
        for batch in batches:
            for item, item_id, found in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "tokens")), strict=True):
                value = runs(np.array(found, dtype=np.int64).view(np.uint64), len(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array([item_id], pa.int64()), pa.array([found], pa.list_(pa.int64()))], names=["seed", "item_id", "tokens"])

    table = keep(items.select("item", "item_id", "tokens").mapInArrow(one, "seed long, item_id long, tokens array<bigint>"))
    known = docs.sparkSession.sparkContext.broadcast(bloom(table))
    schema = "k binary, doc_id long, seed long, first_token long, found array<bigint>"

    def scan(batches):
        for batch in batches:
            rows = []
            for key, doc_id, text in zip(batch.column("k").to_pylist(), batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                hashes = token_hashes(tokens(text))
                for n in lengths:
                    values = runs(hashes, n)
                    one, two = bloom_places(values)
                    passed = (known.value[one >> 6] >> (one & 63).astype(np.uint64)) & (known.value[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1)
                    at = np.flatnonzero(passed)
                    _, first = np.unique(values[at], return_index=True)
                    rows += [(key, doc_id, int(values[i].view(np.int64)), int(i), hashes[i : i + n].view(np.int64)) for i in at[first]]
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", pieces.key().alias("k"))
    met = source.mapInArrow(scan, schema).join(table, "seed").filter("found = tokens")
    size = F.size("tokens").cast("long")
    return met.select("doc_id", "item_id", "k", "first_token", (F.col("first_token") + size).alias("end_token"), size.alias("n_equal"))


def stretches(docs: DataFrame, table: DataFrame, window: int, longest: int) -> DataFrame:
    """(k, doc_id, start, tokens, seeds, positions): tokens around seeds that the Bloom filter lets pass; kept.

    ``start`` and ``positions`` count the tokens of the text. Every run of ``window`` tokens that
    contains a position lies in its stretch. Long stretches are cut into pieces; each position is in one
    piece, and ``longest`` tokens of the stretch around it are in that piece too.
    """
    shared = max(window, longest)
    piece = max(PIECE, 2 * shared)
    short_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(bloom(table))
    schema = "k binary, doc_id long, start long, tokens array<bigint>, seeds array<bigint>, positions array<bigint>"
    names = [f.split()[0] for f in schema.split(", ")]

    def passing(hashes: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, text, seed) of all masks, by place."""
        words, found = known.value, []
        for mask, places in enumerate(MASKS):
            values = seeds(hashes, mask)
            one, two = bloom_places(values)
            passed = (words[one >> 6] >> (one & 63).astype(np.uint64)) & (words[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1)
            at = np.flatnonzero(passed)
            which = np.searchsorted(begin, at, side="right") - 1
            if len(at):
                inside = at + places[-1] < begin[which] + counts[which]
                found.append((at[inside], which[inside], values[at[inside]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at, which, values = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], which[order], values[order]

    def scan(batches):
        for batch in batches:
            texts, keys, ids = text_bytes(batch), batch.column("k"), batch.column("doc_id")
            for a, b in slices(texts, 1_000_000):
                each = [tokens(t) for t in texts[a:b]]
                counts = np.array([len(t) for t in each])
                begin = np.cumsum(counts) - counts
                hashes = token_hashes([t for found in each for t in found])
                at, which, values = passing(hashes, begin, counts)
                if not len(at):
                    continue
                first = np.flatnonzero((np.diff(at, prepend=at[0] - 1) > 2 * window) | (np.diff(which, prepend=-1) != 0))
                rows = []
                for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
                    w = int(which[i])
                    low = max(int(at[i]) - window, int(begin[w]))
                    high = min(int(at[j - 1]) + window, int(begin[w] + counts[w]))
                    cuts = np.unique(np.searchsorted(at[i:j], np.arange(int(at[i]), int(at[j - 1]) + 1, piece))) + i
                    for c, d in zip(cuts.tolist(), [*cuts[1:].tolist(), j], strict=True):
                        core = int(at[i]) + (int(at[c]) - int(at[i])) // piece * piece
                        start, end = max(low, core - shared), min(high, core + piece + shared)
                        rows.append((keys[a + w].as_py(), ids[a + w].as_py(), start - int(begin[w]), hashes[start:end].view(np.int64), values[c:d].view(np.int64), at[c:d] - begin[w]))
                long, many = pa.int64(), pa.list_(pa.int64())
                arrays = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.binary(), long, long, many, many, many), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", pieces.key().alias("k"))
    return keep(source.mapInArrow(scan, schema))


def verify(text: np.ndarray, item: np.ndarray, shift: int, hits: list[int], window: int, similarity: float) -> tuple[int, int, int] | None:
    """(first token, end, equal tokens) of the accepted overlap in the text, if there is one.

    ``text[i]`` is aligned with ``item[i - shift]``; ``hits`` are positions of the text.
    """
    first, end = max(0, shift), min(len(text), shift + len(item))
    size = min(window, len(item))
    if end - first < size:
        return None
    equal = text[first:end] == item[first - shift : end - shift]
    total = np.concatenate([[0], np.cumsum(equal)])
    good = total[size:] - total[:-size] >= np.ceil(similarity * size - 1e-9)
    near = np.zeros(len(good) + 1, dtype=np.int64)
    for p in hits:
        near[min(len(good), max(0, p - first - size + 1))] += 1
        near[min(len(good), max(0, p - first + 1))] -= 1
    good &= np.cumsum(near)[:-1] > 0
    where = np.flatnonzero(good)
    if not len(where):
        return None
    a, b = int(where[0]), int(where[-1]) + size
    return first + a, first + b, int(total[b] - total[a])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, k, first_token, end_token, n_equal): the best verified overlap of each text and item.

    ``k`` is the hash of the row's id and text.
    """
    items = item_table(benchmark)
    long = items.filter(F.size("tokens") >= LEAST)
    short = sorted(r[0] for r in items.filter(F.size("tokens") < LEAST).select(F.size("tokens")).distinct().collect())  # LEAST - 1 numbers at most
    table = seed_table(long)
    found = stretches(docs, table, window, long.agg(F.max(F.size("tokens"))).first()[0] or 0)
    each = found.select("k", "start", F.inline(F.arrays_zip("seeds", "positions"))).withColumnRenamed("seeds", "seed")
    shift = (F.col("positions") - F.col("at")).alias("shift")
    # the first piece with a hit of an alignment holds all of it
    hits = F.sort_array(F.collect_set("positions")).alias("hits")
    aligned = each.join(table, "seed").groupBy("k", "item", shift).agg(hits, F.min("start").alias("start"))
    known = long.select("item", "item_id", F.col("tokens").alias("item_tokens"))
    rows = aligned.join(known, "item").join(found.select("k", "doc_id", "start", "tokens"), ["k", "start"])
    first = F.greatest("shift", "start")
    end = F.least(F.col("shift") + F.size("item_tokens"), F.col("start") + F.size("tokens"))
    rows = rows.select(
        "doc_id", "item_id", "k", "shift", "hits", "item_tokens", first.alias("first"),
        F.slice("tokens", (first - F.col("start") + 1).cast("int"), (end - first).cast("int")).alias("tokens"),
    )
    schema = "doc_id long, item_id long, k binary, first_token long, end_token long, n_equal long"

    def check(batches):
        for batch in batches:
            out = []
            columns = {c: batch.column(c).to_pylist() for c in ("doc_id", "item_id", "k", "shift", "first", "hits")}
            for n, (doc_id, item_id, k, shift, first, hits) in enumerate(zip(*columns.values(), strict=True)):
                text, item = (batch.column(c)[n].values.to_numpy() for c in ("tokens", "item_tokens"))
                if overlap := verify(text, item, shift - first, [p - first for p in hits], window, similarity):
                    out.append((doc_id, item_id, k, overlap[0] + first, overlap[1] + first, overlap[2]))
            if out:
                arrays = [pa.array(v, pa.binary() if n == 2 else pa.int64()) for n, v in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

    overlaps = rows.mapInArrow(check, schema)
    if short:
        overlaps = overlaps.unionByName(whole_items(docs, items.filter(F.size("tokens") < LEAST), short))
    place = F.max(F.struct("n_equal", (-F.col("first_token")).alias("first"), "end_token")).alias("best")
    best = overlaps.groupBy("doc_id", "item_id", "k").agg(place)
    return best.select("doc_id", "item_id", "k", (-F.col("best.first")).alias("first_token"), "best.end_token", "best.n_equal")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without an overlap, all columns kept."""
    name = "__contaminated_key"
    found = keep(contaminated(docs, benchmark, window, similarity).select(F.col("k").alias(name)).distinct())
    # the same join at every size: the list grows with the corpus, so it is never broadcast
    return docs.join(found.hint("merge"), pieces.key() == F.col(name), "left_anti")
