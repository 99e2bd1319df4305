"""Repeated word windows by super-k-mer partitioning.

A window is ``size`` consecutive words. Consecutive windows with the same minimiser, the word
gram with the smallest hash, are one super-k-mer: a packed string of their words. Equal windows
have equal minimisers, so the packed strings of a bucket hold all windows that can be equal.
Identical packed strings are reduced to one row, with its smallest ``doc_id``, before anything is
fetched or shuffled; in the bucket all windows are sorted as strings and equal ones are counted,
and take the smallest ``doc_id`` among them. Buckets with more than ``pieces.HOT`` distinct
strings are split into single windows by a 128-bit hash of their words.

A word is removed when a window over it also begins in a document with a smaller ``doc_id``.
Words are runs of anything but space and the characters 9 to 13. Null and empty texts have no
words; a null ``doc_id`` is never smaller and loses nothing; rows with equal ids do not remove
each other's words; an empty table gives an empty result; other columns are not carried.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import short_batches
from .suffix_dedup import joined

SIZE = 50
GRAM = 8
#: Packed strings that are compared together at least.
COLLECTION = 4096


def gram_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of the eight words from every word on."""
    digest = xxhash.xxh3_64_intdigest
    x = np.fromiter(map(digest, words), np.uint64, len(words))
    for step in (1, 2, 4):
        x = pieces.scramble(x[:-step] * pieces.MIX[0] + x[step:] * pieces.MIX[1])
    return x


def packed_table(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Super-k-mers as places (see ``pieces``); starts and windows are counted in words."""
    short_batches(docs.sparkSession)
    names = [f.split()[0] for f in pieces.PIECE.split(", ")]

    def scan(batches):
        for batch, rows in pieces.spread(batches, pieces.CHUNK // 4, len, bytes.split, size - 1):
            words = [w for _, _, part in rows for w in part]
            sizes = np.array([len(part) for _, _, part in rows])
            begin = np.cumsum(sizes) - sizes
            grams = gram_hashes(words)
            starts, windows, at = pieces.cut(grams, size - GRAM + 1, begin, begin + sizes - size + 1)
            which = np.searchsorted(begin, starts, side="right") - 1
            data = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(lengths) - 1
            first, last = (ends - lengths + 1)[starts], ends[starts + windows + size - 2]
            content = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            index = pa.array(np.array([i for i, _, _ in rows])[which])
            offset = np.array([at for _, at, _ in rows])[which] + starts - begin[which]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams[at].view(np.int64)),
                    pa.array(np.array(content, dtype=np.uint64).view(np.int64)),
                    batch.column("k").take(index),
                    batch.column("doc_id").take(index),
                    pa.array(offset, pa.int64()),
                    pa.array(windows, pa.int32()),
                    pa.array(at - starts, pa.int32()),
                ],
                names=names,
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", pieces.key().alias("k"))
    return source.mapInArrow(scan, pieces.PIECE)


def windows_of(packed: bytes, size: int) -> list[bytes]:
    lengths = np.array([len(w) for w in packed.split(b" ")], dtype=np.int64) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    return [packed[a:b] for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=False)]


def count_windows(rows: list[dict], size: int) -> list[tuple]:
    """(m, h, a, b, first): windows a to b of a packed string occur first in the document ``first``."""
    table = []
    for r in rows:
        if r["least"] is not None:
            m, h, least = r["m"], r["h"], r["least"]
            table.extend((w, least, m, h, i) for i, w in enumerate(windows_of(r["packed"], size)))
    table.sort()
    firsts: dict[tuple, dict[int, int]] = {}
    same, first = None, None
    for w, least, m, h, i in table:
        if w != same:
            same, first = w, least
        firsts.setdefault((m, h), {})[i] = first
    result = []
    for r in rows:
        if r["least"] is None:
            continue
        found = firsts[r["m"], r["h"]]
        begin = 0
        for i in range(1, r["windows"] + 1):
            if i == r["windows"] or found[i] != found[begin]:
                if found[begin] < r["most"]:
                    result.append((r["m"], r["h"], begin, i, found[begin]))
                begin = i
    return result


def repeated_words(docs: DataFrame, size: int = SIZE, hot: int = pieces.HOT) -> DataFrame:
    """(k, first, last): runs of words, per document key, that are covered by earlier documents' windows."""
    spark = docs.sparkSession
    found = pieces.repeated(packed_table(docs, size))
    each = pieces.distinct(found)

    def whole(k, text, wanted):
        words = text.split()
        return [
            (w["m"], w["h"], w["least"], w["most"], w["windows"], b" ".join(words[w["start"] : w["start"] + w["windows"] + size - 1]))
            for w in wanted
        ]

    def single(k, text, wanted):
        words, rows = text.split(), []
        for w in wanted:
            for i in range(w["windows"]):
                at = w["start"] + i
                digest = xxhash.xxh3_128_intdigest(b" ".join(words[at : at + size]))
                rows.append((w["m"], w["h"], i, w["least"], w["most"], (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)))
        return rows

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = "m long, h long, least long, most long, windows int, packed binary"
    cold = pieces.with_text(each.filter(F.col("crowd") <= hot).drop("crowd", "n", "left"), docs, columns, whole)
    runs = pieces.by_bucket(cold, parts, "m long, h long, a int, b int, earliest long", lambda rows: count_windows(rows, size), COLLECTION)
    columns = "m long, h long, a int, least long, most long, w1 long, w2 long"
    strings = pieces.keep(pieces.with_text(each.filter(F.col("crowd") > hot).drop("crowd", "n", "left"), docs, columns, single))
    earliest = strings.groupBy("w1", "w2").agg(F.min("least").alias("earliest"))
    more = strings.join(earliest, ["w1", "w2"]).filter("earliest < most").select("m", "h", "a", (F.col("a") + 1).alias("b"), "earliest")
    where = found.join(pieces.keep(runs.union(more)), ["m", "h"]).filter(F.col("doc_id") > F.col("earliest"))
    return where.select("k", (F.col("start") + F.col("a")).alias("first"), (F.col("start") + F.col("b") + size - 1).alias("last"))


def removal(docs: DataFrame, size: int = SIZE, hot: int = pieces.HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept, kept_sha256) of every document."""
    schema = "n_words long, n_removed long, spans array<struct<first:bigint,last:bigint>>, kept string, kept_sha256 string"

    @F.pandas_udf(schema)
    def apply(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for text, ranges in zip(texts, found, strict=True):
            words = (text or b"").split()
            spans = joined([] if ranges is None else [(r["first"], r["last"]) for r in ranges])
            ends, starts = [0, *[b for _, b in spans]], [*[a for a, _ in spans], len(words)]
            left = [w for e, s in zip(ends, starts, strict=True) for w in words[e:s]]
            kept = b" ".join(left)
            gone = [{"first": a, "last": b} for a, b in spans]
            rows.append((len(words), len(words) - len(left), gone, kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "spans", "kept", "kept_sha256"])

    short_batches(docs.sparkSession)
    key, ranges, result = "__piece_key", "__piece_spans", "__piece_result"
    spans = repeated_words(docs, size, hot).groupBy("k").agg(F.collect_set(F.struct("first", "last")).alias(ranges))
    keyed = docs.select("doc_id", "text").withColumn(key, pieces.key())
    marked = keyed.join(spans.withColumnRenamed("k", key), key, "left")
    return marked.select("doc_id", apply(F.col("text").cast("binary"), ranges).alias(result)).select("doc_id", f"{result}.*")
