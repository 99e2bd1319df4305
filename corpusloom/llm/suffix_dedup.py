"""Repeated byte strings, found by column-wise construction of a collection's Burrows-Wheeler transform.

A document goes into pieces that share an anchor (``pieces``); the distinct pieces of a bucket
are the documents of a collection, laid side by side so that their anchors are in one column.
Equal strings of ``length`` bytes hold the same anchor at the same distance, so they begin in
the same column, and the suffixes of a column need no comparing with those of another.

A collection is built from the last column to the first. A round reads the next column of
symbols from a sequential file, one symbol per piece, in the order of the suffixes so far:
that is the column's part of the transform. A stable sort by that symbol, pieces that end here
coming first, gives the order of the suffixes that begin in this column, and the common prefix
of neighbours grows by one where their symbols agree: one more than the least common prefix
between the two in the last round. Order, transform and common prefixes are appended to a
second sequential file; reading it back marks strings whose neighbour shares ``length`` bytes.
Memory is bounded by one column of the collection and its state.

Identical pieces are one row with a number before anything is fetched, and buckets with more
than ``pieces.HOT`` distinct pieces are split into single strings by their 128-bit hash.

Texts are UTF-8; a null text is empty; strings never cross rows. Rows that repeat an id and
text are occurrences of their own and get the same spans. An empty table gives an empty result.
Keys of documents and identity of pieces are hashes (64 bits for an id and its text, 128 for a piece).
"""

import hashlib
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import short_batches

LENGTH = 200
GRAM = 32
#: Pieces a collection holds before the next bucket starts a new one.
COLLECTION = 16384
KEY, SPANS, RESULT = "__piece_key", "__piece_spans", "__piece_result"


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the 32 bytes from every position on."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    mixed = words[:n] * pieces.MIX[0] + words[8 : n + 8] * pieces.MIX[1]
    mixed ^= mixed >> np.uint64(29)
    mixed += words[16 : n + 16] * pieces.MIX[2] + words[24 : n + 24] * pieces.MIX[3]
    return pieces.scramble(mixed)


def piece_table(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    if length <= GRAM:
        raise ValueError(f"strings are longer than {GRAM} bytes")
    short_batches(docs.sparkSession)
    names = [f.split()[0] for f in pieces.PIECE.split(", ")]

    def scan(batches):
        for batch, rows in pieces.spread(batches, pieces.CHUNK, len, bytes, length - 1):
            data = b"".join(part for _, _, part in rows)
            sizes = np.array([len(part) for _, _, part in rows])
            begin = np.cumsum(sizes) - sizes
            grams = gram_hashes(data)
            starts, windows, at = pieces.cut(grams, length - GRAM + 1, begin, begin + sizes - length + 1)
            which = np.searchsorted(begin, starts, side="right") - 1
            ends = starts + windows + length - 1
            content = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
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


def shared_strings(texts: list[bytes], left: list[int], windows: list[int], length: int) -> list[np.ndarray]:
    """For every piece, which of its windows begin in another piece too.

    ``left`` is the anchor's place in the piece; pieces are aligned there.
    """
    n, most = len(texts), max(left)
    kind = np.uint8 if length < 1 << 8 else np.uint16 if length < 1 << 16 else np.uint32
    begin = most - np.array(left, dtype=np.int64)
    end = begin + np.array([len(t) for t in texts])
    width = int(end.max())
    with tempfile.TemporaryFile() as symbols, tempfile.TemporaryFile() as rounds:
        cells = np.zeros((n, width), dtype=np.uint8)
        for i, t in enumerate(texts):
            cells[i, begin[i] : end[i]] = np.frombuffer(t, np.uint8)
        np.ascontiguousarray(cells.T[::-1]).tofile(symbols)
        del cells
        symbols.seek(0)
        ending = [np.zeros(0, dtype=np.int64)] * (width + 1)
        by_end = np.argsort(end, kind="stable")
        for ids in np.split(by_end, np.flatnonzero(np.diff(end[by_end])) + 1):
            ending[end[ids[0]]] = ids
        order, common = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind)
        for column in range(width - 1, -1, -1):
            symbol = np.fromfile(symbols, np.uint8, n)
            new = ending[column + 1]
            ids = np.concatenate([new, order])
            prefix = np.concatenate([np.zeros(len(new), kind), common, np.zeros(1, kind)])
            place = np.flatnonzero(begin[ids] <= column)
            transform = symbol[ids[place]]
            sort = np.argsort(transform, kind="stable")
            place, sorted_symbols = place[sort], transform[sort]
            order, common = ids[place], np.zeros(len(place), kind)
            agree = np.flatnonzero(sorted_symbols[1:] == sorted_symbols[:-1]) if len(place) else np.zeros(0, np.int64)
            if len(agree):
                between = np.empty(2 * len(agree), dtype=np.int64)
                between[0::2], between[1::2] = place[agree] + 1, place[agree + 1] + 1
                least = np.minimum.reduceat(prefix, between)[::2]
                common[agree + 1] = np.minimum(least, length - 1) + 1
            for part in (np.array([len(order)], np.int64), order.astype(np.int32), common, transform):
                part.tofile(rounds)
        rounds.seek(0)
        flat = np.zeros(sum(windows), dtype=bool)
        base = np.cumsum(windows) - windows
        for column in range(width - 1, -1, -1):
            size = int(np.fromfile(rounds, np.int64, 1)[0])
            order, common = np.fromfile(rounds, np.int32, size), np.fromfile(rounds, kind, size)
            np.fromfile(rounds, np.uint8, size)  # the transform itself is not needed here
            full = np.append(common >= length, False)
            found = order[full[:-1] | full[1:]]
            flat[base[found] + column - begin[found]] = True
    return [flat[b : b + w] for b, w in zip(base.tolist(), windows, strict=True)]


def runs_of(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]])))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def repeated_runs(docs: DataFrame, length: int = LENGTH, hot: int = pieces.HOT) -> DataFrame:
    """(k, first, last): runs of bytes, per document key, that repeated strings cover."""
    spark = docs.sparkSession
    found = pieces.repeated(piece_table(docs, length))
    each = pieces.distinct(found)

    def whole(k, text, wanted):
        return [(w["m"], w["h"], w["n"], w["windows"], w["left"], text[w["start"] : w["start"] + w["windows"] + length - 1]) for w in wanted]

    def single(k, text, wanted):
        rows = []
        for w in wanted:
            for i in range(w["windows"]):
                at = w["start"] + i
                digest = xxhash.xxh3_128_intdigest(text[at : at + length])
                rows.append((w["m"], w["h"], i, w["n"], (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)))
        return rows

    def compare(rows):
        marks = shared_strings([r["text"] for r in rows], [r["left"] for r in rows], [r["windows"] for r in rows], length)
        result = []
        for r, mark in zip(rows, marks, strict=True):
            runs = [(0, r["windows"])] if r["n"] > 1 else runs_of(mark)
            result.extend((r["m"], r["h"], a, b) for a, b in runs)
        return result

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = "m long, h long, n long, windows int, left int, text binary"
    cold = pieces.with_text(each.filter(F.col("crowd") <= hot).drop("least", "most", "crowd"), docs, columns, whole)
    runs = pieces.by_bucket(cold, parts, "m long, h long, a int, b int", compare, COLLECTION)
    columns = "m long, h long, a int, n long, w1 long, w2 long"
    strings = pieces.keep(pieces.with_text(each.filter(F.col("crowd") > hot).drop("least", "most", "crowd", "left"), docs, columns, single))
    twice = strings.groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").select("w1", "w2")
    more = strings.join(twice, ["w1", "w2"], "left_semi").select("m", "h", "a", (F.col("a") + 1).alias("b"))
    where = found.select("m", "h", "k", "start").join(pieces.keep(runs.union(more)), ["m", "h"])
    return where.select("k", (F.col("start") + F.col("a")).alias("first"), (F.col("start") + F.col("b") + length - 1).alias("last"))


def joined(spans) -> list[tuple[int, int]]:
    """Maximal runs of (first, last) ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *[b for _, b in spans]]
    starts = [*[a for a, _ in spans], len(data)]
    return b"".join(data[e:s] for e, s in zip(ends, starts, strict=True))


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans cut back so that no character loses only some of its bytes."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, length: int = LENGTH, hot: int = pieces.HOT) -> DataFrame:
    """All columns of ``docs`` and SPANS, the ranges found in each text, each once; null where there is none."""
    spans = repeated_runs(docs, length, hot).groupBy("k").agg(F.collect_set(F.struct("first", "last")).alias(SPANS))
    return docs.withColumn(KEY, pieces.key()).join(spans.withColumnRenamed("k", KEY), KEY, "left").drop(KEY)


def removal(docs: DataFrame, length: int = LENGTH, hot: int = pieces.HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept, kept_sha256) of every document."""
    schema = "n_bytes long, n_removed long, n_spans long, spans array<struct<first:bigint,last:bigint>>, kept binary, kept_sha256 string"

    @F.pandas_udf(schema)
    def apply(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for text, ranges in zip(texts, found, strict=True):
            data = text or b""
            spans = joined([] if ranges is None else [(r["first"], r["last"]) for r in ranges])
            kept = without(data, spans)
            gone = [{"first": a, "last": b} for a, b in spans]
            rows.append((len(data), len(data) - len(kept), len(spans), gone, kept, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    short_batches(docs.sparkSession)
    marked = with_spans(docs.select("doc_id", "text"), length, hot)
    return marked.select("doc_id", apply(F.col("text").cast("binary"), SPANS).alias(RESULT)).select("doc_id", f"{RESULT}.*")


def deduplicate(docs: DataFrame, length: int = LENGTH, hot: int = pieces.HOT) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; characters cut in part are kept whole."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, ranges in zip(texts, found, strict=True):
            if text is None or ranges is None:
                out.append(None if text is None else text.decode("utf-8", "replace"))
                continue
            data = text
            spans = whole_characters(data, joined([(r["first"], r["last"]) for r in ranges]))
            out.append(without(data, spans).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    short_batches(docs.sparkSession)
    marked = with_spans(docs, length, hot)
    return marked.withColumn("text", clean(F.col("text").cast("binary"), SPANS)).select(*docs.columns)
