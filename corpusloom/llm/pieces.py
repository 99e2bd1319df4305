"""Cutting texts into pieces that share an anchor, and carrying findings on pieces back to documents.

A window's anchor is its gram with the smallest hash, the leftmost of equals; it depends on the
window's content alone. Consecutive windows with the same anchor position form a piece, so two
equal windows always lie in pieces with equal anchors, at the same distance from it. An anchor
found once in the whole collection cannot belong to a repeated window, so only the others'
pieces get their text fetched, each distinct piece once.

Rows of a piece table: ``m`` anchor hash (the bucket), ``h`` hash of the piece's content,
``k`` key of the document (128-bit hash of id and text), ``doc_id``, ``start``, ``windows`` and
``left``, the anchor's distance from the start.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
#: Positions that are hashed at a time; the position has to fit into POSITION bits.
POSITION = 20
CHUNK = 1 << 19
#: Buckets with more distinct pieces are compared window by window.
HOT = 8192

PIECE = "m long, h long, k binary, doc_id long, start long, windows int, left int"


def key() -> Column:
    """128 bits of a row's id and text."""
    parts = (F.xxhash64("doc_id", "text"), F.xxhash64(F.lit("second"), "text", "doc_id"))
    return F.unhex(F.concat(*[F.lpad(F.hex(part), 16, "0") for part in parts]))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[4]
    return x ^ (x >> np.uint64(29))


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` gram hashes, the position of the smallest, the leftmost of equals."""
    low = np.uint64((1 << POSITION) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        rest = span - width
        least = np.minimum(least[:-rest], least[rest:])
    return (least & low).astype(np.int64)


def cut(grams: np.ndarray, span: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of the pieces; windows begin in the ranges [first, last) only."""
    at = anchors(grams, span)
    change = np.zeros(len(at), dtype=bool)
    change[1:] = at[1:] != at[:-1]
    change[first] = True
    inside = np.zeros(len(at) + 1, dtype=np.int32)
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    change[last[last < len(at)]] = True
    inside = np.cumsum(inside[:-1]) > 0
    starts = np.flatnonzero(change)
    starts = starts[inside[starts]] if len(starts) else starts
    borders = np.flatnonzero(change)
    ends = np.append(borders, len(at))[np.searchsorted(borders, starts, side="right")]
    return starts, ends - starts, at[starts]


def spread(batches: Iterator[pa.RecordBatch], limit: int, length: Callable[[object], int], read: Callable[[bytes], object], overlap: int):
    """Chunks (rows, first offsets, values) of whole or divided texts, at most ``limit`` units each.

    A text longer than the limit is divided with ``overlap`` units in common, so that no
    window is lost or counted twice.
    """
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        rows, size = [], 0
        for i, text in enumerate(texts):
            value = read(text or b"")
            n = length(value)
            if n <= overlap:
                continue
            for at in range(0, n - overlap, limit):
                part = value[at : at + limit + overlap]
                if rows and size + len(part) > limit:
                    yield batch, rows
                    rows, size = [], 0
                rows.append((i, at, part))
                size += len(part)
        if rows:
            yield batch, rows


def repeated(pieces: DataFrame) -> DataFrame:
    """Pieces whose anchor occurs twice or more, kept.

    The counts are a table of their own, so that both sides of the join are plain shuffles
    and a crowded anchor's partition can be split at run time.
    """
    table = keep(pieces)
    often = keep(table.groupBy("m").agg(F.count("*").alias("n")).filter("n > 1").select("m"))
    return keep(table.join(often, "m", "left_semi"))


def distinct(pieces: DataFrame) -> DataFrame:
    """Each distinct piece with its number, its first document, one place, and how many its bucket has; kept."""
    place = F.struct("doc_id", "k", "start", "windows", "left")
    each = keep(pieces.groupBy("m", "h").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min(place).alias("place")))
    crowd = keep(each.groupBy("m").agg(F.count("*").alias("crowd")))
    return keep(each.join(crowd, "m").select("m", "h", "n", "least", "most", "place.k", "place.start", "place.windows", "place.left", "crowd"))


def with_text(each: DataFrame, docs: DataFrame, columns: str, take: Callable) -> DataFrame:
    """Rows that ``take(text, wanted pieces of the document)`` makes where the places of ``each`` lie.

    Rows with equal id and text share a key, and texts are reduced to one per key before the join.
    """
    wanted = F.collect_list(F.struct(*[c for c in each.columns if c != "k"])).alias("wanted")
    grouped = each.groupBy("k").agg(wanted)
    texts = docs.select(key().alias("_k"), F.col("text").cast("binary").alias("text")).dropDuplicates(["_k"])
    joined = texts.join(grouped, F.col("_k") == F.col("k")).select("k", "text", "wanted")

    def run(batches):
        for batch in batches:
            rows = []
            for k, text, found in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "wanted")), strict=True):
                rows.extend(take(k, text, found))
            if rows:
                arrays = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(columns))
    names, types = arrow.names, arrow.types
    return joined.mapInArrow(run, columns)


def by_bucket(rows: DataFrame, parts: int, columns: str, work: Callable, limit: int) -> DataFrame:
    """Rows of ``work(list of rows)`` over whole buckets, some buckets at a time until ``limit`` rows are together."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(columns))
    names, types = arrow.names, arrow.types

    def batch_of(found):
        arrays = [pa.array(v, t) for v, t in zip(zip(*found, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        waiting, last = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if len(waiting) >= limit and row["m"] != last:
                    if found := work(waiting):
                        yield batch_of(found)
                    waiting = []
                waiting.append(row)
                last = row["m"]
        if waiting and (found := work(waiting)):
            yield batch_of(found)

    return rows.repartition(parts, "m").sortWithinPartitions("m", "h").mapInArrow(run, columns)
