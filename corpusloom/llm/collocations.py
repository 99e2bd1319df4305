"""Collocations: phrases that stand together far more often than their parts, per language.

1. Every chunk of texts counts its n-grams by hash and deals them to hash partitions. The counts of
   a partition are a Misra-Gries summary: at most ``capacity`` counters, and when there are more, the
   largest that must go is taken off all of them. Summaries of chunks are merged in the same way, in
   any order. A partition's capacity exceeds its mass divided by the threshold, so that what is taken
   off stays below the threshold and every frequent n-gram survives; collisions only let others pass.
2. This is done for words and pairs first, then for three and four words at places where all pairs
   have survived; a frequent phrase has only frequent parts.
3. A second pass over the texts counts what survived exactly, by the words themselves. A Bloom filter
   of bounded size holds the survivors; what it passes wrongly is counted and then found too rare.

Scores and the choice of phrases are plain joins of the exact counts.
"""

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, keep, short_batches, slices, text_bytes

#: A phrase has at most so many words, and at least so many occurrences.
LONGEST, LEAST = 4, 30
#: A phrase goes when a longer one that holds it has this share of its occurrences, in hundredths.
COVERED = 80
TOP = 2000
#: Bytes of text that are counted together.
CHUNK = 16_000_000
#: Hash partitions for each shuffle partition.
PARTS = 8
#: The Bloom filter has 32 bits for a survivor, at most 2**28 (32 MiB); beyond that it passes more.
BLOOM_BITS = 28

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ends of a piece become line feeds, tabs become spaces.
FOLDED = bytes.maketrans(UPPER + b".,;:!?\x0b\x0c\r\t", UPPER.lower() + b"\n" * 9 + b" ")
SCRAMBLE = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, a line feed for every end of a piece, and empty ones that mean nothing."""
    return text.translate(FOLDED).replace(b"\n", b" \n ").split(b" ")


class Coded:
    """Texts as one array of word numbers, 0 for ends of pieces; each language has words of its own."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.words: list[tuple[str, bytes]] = [("", b"\n")]
        numbers: dict[str, dict[bytes, int]] = {}
        parts = []
        for text, lang in zip(texts, langs, strict=True):
            known = numbers.setdefault(lang, {b"": -1, b"\n": 0})
            found = tokens(text)
            for word in set(found).difference(known):
                known[word] = len(self.words)
                self.words.append((lang, word))
            row = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
            parts += [row[row >= 0], np.zeros(1, np.int32)]
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def hashes(self) -> np.ndarray:
        seeds = {lang: xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass")) for lang in {lang for lang, _ in self.words}}
        return np.fromiter((xxhash.xxh64_intdigest(word, seeds[lang]) for lang, word in self.words), np.uint64, len(self.words))

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, hash, whole) of the n-grams from every place on; ``whole`` tells which lie in one piece."""
        single = self.hashes()[self.ids]
        inside = self.ids > 0
        value, whole = single, inside
        yield 1, value, whole
        for n in range(2, longest + 1):
            value = value[:-1] * SCRAMBLE[0] + single[n - 1 :]
            value = (value ^ (value >> np.uint64(31))) * SCRAMBLE[1]
            value ^= value >> np.uint64(29)
            whole = whole[:-1] & inside[n - 1 :]
            yield n, value, whole


class Summary:
    """Misra-Gries counters of one hash partition."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        """Add the counters of another summary; they are put together some at a time."""
        self.error += error
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > self.capacity:
            self.fold()

    def fold(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c.astype(np.int64) for _, c in self.waiting)])
        self.waiting, self.size = [], 0
        if not len(keys):
            return
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            place = len(keys) - self.capacity - 1
            cut = int(np.partition(counts, place)[place])
            counts = counts - cut
            keys, counts = keys[counts > 0], counts[counts > 0]
            self.error += cut
        self.keys, self.counts = keys, counts

    def survivors(self, least: int) -> np.ndarray:
        """Keys that may have ``least`` occurrences: all that have, as long as the error is smaller."""
        self.fold()
        return self.keys[self.counts + self.error >= least]


def capacity(mass: int, least: int) -> int:
    """Counters that leave no key with ``least`` of ``mass`` occurrences out."""
    return mass // least + 1


class Filter:
    """A Bloom filter with two places for a key."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def places(self, values: np.ndarray) -> list[np.ndarray]:
        return [(values >> np.uint64(s)) & np.uint64((1 << self.bits) - 1) for s in (0, 64 - self.bits)]

    def passes(self, values: np.ndarray) -> np.ndarray:
        one, two = (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) for p in self.places(values))
        return (one & two & np.uint64(1)).astype(bool)


def bloom(survivors: DataFrame) -> Filter:
    """The filter of a column ``h``; the driver gets its words, 2**(BLOOM_BITS - 6) at most."""
    bits = min(BLOOM_BITS, max(16, (32 * survivors.count()).bit_length()))
    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    each = survivors.select(F.explode(F.array(low, F.shiftrightunsigned("h", 64 - bits))).alias("p"))
    words = each.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return Filter(bits, out)


def _texts(docs: DataFrame, language: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(language).cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _chunks(batches) -> Iterator[Coded]:
    for batch in gathered(batches, CHUNK):
        texts, langs = text_bytes(batch), batch.column("lang").to_pylist()
        for a, b in slices(texts, CHUNK):
            yield Coded(texts[a:b], langs[a:b])


def _alive(coded: Coded, longest: int, known: Filter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hash, whole) where no part of two words is known to be rare."""
    pairs = None
    for n, value, whole in coded.grams(longest):
        if known is not None and n == 2:
            pairs = whole & known.passes(value)
            whole = pairs
        elif known is not None and n > 2:
            alive = pairs[: len(whole)].copy()
            for k in range(1, n - 1):
                alive &= pairs[k : k + len(whole)]
            whole = alive
        yield n, value, whole


def frequent(texts: DataFrame, orders: tuple[int, int], least: int, known: Filter | None = None) -> DataFrame:
    """(h): hashes of n-grams of the given lengths, every one with ``least`` occurrences among them; kept.

    With ``known``, the survivors among pairs, only places where all pairs may be frequent are counted.
    """
    spark = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = PARTS * tasks
    shared = spark.sparkContext.broadcast(known)

    def summarize(batches):
        for coded in _chunks(batches):
            found = [value[whole] for n, value, whole in _alive(coded, orders[1], shared.value) if n >= orders[0]]
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
            rows = [(int(part[a]), int(counts[a:b].sum()), keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for a, b in pairwise(cuts)]
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "mass", "keys", "counts"]
                )

    def merge(batches):
        summaries: dict[int, Summary] = {}
        for batch in batches:
            for row in batch.to_pylist():
                summary = summaries.get(row["part"]) or summaries.setdefault(row["part"], Summary(capacity(row["total"], least)))
                summary.merge(np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.uint32))
        for summary in summaries.values():
            yield pa.RecordBatch.from_arrays([pa.array(summary.survivors(least).view(np.int64))], names=["h"])

    chunks = keep(texts.mapInArrow(summarize, "part int, mass long, keys binary, counts binary"))
    # one row for each hash partition
    masses = F.broadcast(chunks.groupBy("part").agg(F.sum("mass").alias("total")))
    return keep(chunks.join(masses, "part").select("part", "total", "keys", "counts").repartition(tasks, "part").mapInArrow(merge, "h long"))


def exact_counts(texts: DataFrame, pairs: Filter, known: Filter, longest: int, least: int) -> DataFrame:
    """(lang, words, phrase, f) of every phrase of up to ``longest`` words with ``least`` occurrences or more, and
    with ``words`` 0 the number of all word occurrences of each language; kept."""
    shared = texts.sparkSession.sparkContext.broadcast((pairs, known))
    names = ["lang", "words", "phrase", "f"]

    def batches_of(lang, n, phrase, f):
        yield from pa.table([lang, pa.array(np.full(len(lang), n, dtype=np.int32)), phrase, pa.array(f, pa.int64()) if isinstance(f, np.ndarray) else f], names).to_batches()

    def count(batches):
        pairs, known = shared.value
        for coded in _chunks(batches):
            ids, langs = coded.ids.astype(np.int64), pa.array([lang for lang, _ in coded.words], pa.string())
            words = pa.array([word for _, word in coded.words], pa.binary()).cast(pa.string())
            often = pa.table({"lang": langs, "f": np.bincount(ids, minlength=len(words))}).slice(1).group_by("lang").aggregate([("f", "sum")])
            yield from batches_of(often["lang"], 0, pa.array([""] * len(often)), often["f_sum"])
            name, named = ids, np.ones(len(ids), dtype=bool)
            for n, value, whole in _alive(coded, longest, pairs):
                alive = whole if n == 2 else whole & (pairs if n == 1 else known).passes(value)
                # a filter may pass a phrase and not its beginning; the phrase is rare then, and its beginning has no name
                named = alive & named[: len(alive)]
                at = np.flatnonzero(named)
                key = ids[at] if n == 1 else name[at] * len(words) + ids[at + n - 1]
                _, first, number, f = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                name = np.zeros(len(value), dtype=np.int64)
                name[at] = number if n > 1 else key
                spans = [ids[at[first] + k] for k in range(n)]
                phrase = pc.binary_join_element_wise(*(words.take(pa.array(span)) for span in spans), " ")
                yield from batches_of(langs.take(pa.array(spans[0])), n, phrase, f)

    counted = texts.mapInArrow(count, "lang string, words int, phrase string, f long").groupBy(*names[:3]).agg(F.sum("f").alias("f"))
    return keep(counted.filter((F.col("f") >= least) | (F.col("words") == 0)))


def scored(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 * a / (left + right)), in whole numbers that do not overflow."""
    return F.call_function("div", F.lit(2000000).cast("decimal(7,0)") * a.cast("decimal(19,0)"), left.cast("decimal(19,0)") + right.cast("decimal(19,0)"))


def collocations(docs: DataFrame, language: str = "lang", least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``longest`` words of each language.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    spaces and tabs. ``a`` counts all occurrences of the phrase, ``l`` and ``r`` those of the two parts
    of its lowest-scoring cut (the one with the shortest first part of equals), ``n`` all words of the
    language; the score is floor(2000000 * a / (l + r)). Phrases with fewer than ``least`` occurrences
    have no row, nor has a phrase that lies in a longer one with ``covered`` hundredths of its
    occurrences. Ranks go by score and occurrences, largest first, then by the phrase's UTF-8 bytes; ``top`` None
    gives all.

    Null texts are empty, a null language is ``und``. Repeated rows count each time. Other columns are
    not read, whatever their names. Empty tables and texts give no rows. A text is never cut; a chunk holds at least one whole text.
    """
    short_batches(docs.sparkSession)
    texts = _texts(docs, language)
    first = frequent(texts, (1, min(2, longest)), least)
    pairs = bloom(first)
    rest = frequent(texts, (3, longest), least, pairs) if longest > 2 else first
    counts = exact_counts(texts, pairs, bloom(rest), longest, least)

    phrases = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = phrases.select("*", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - words)").alias("right")
    )
    parts = counts.filter("words > 0").select("lang", F.col("phrase").alias("part"), F.col("f"))
    met = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    met = met.join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cut = F.struct(scored(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut")
    best = met.select("lang", "phrase", "words", "a", cut).groupBy("lang", "phrase", "words", "a").agg(F.min("cut").alias("cut"))

    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), w -> transform(sequence(1, words - w + 1), s -> array_join(slice(split(phrase, ' '), s, w), ' '))))"
    )
    longer = phrases.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("f"))
    around = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    wide = "decimal(28,0)"
    kept = best.join(around, ["lang", "phrase"], "left").filter(
        F.expr(f"f is null or 100 * cast(f as {wide}) < {int(covered)} * cast(a as {wide})")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    sizes = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score")
    )
