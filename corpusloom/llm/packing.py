"""Best-fit packing by linear grouping.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths,
at most ``capacity`` rows whatever the input, goes to the driver. There lengths above a
quarter of the capacity are split into groups of equal cardinality and rounded up to the
largest of their group; a linear program over all configurations of those few sizes says how
often each configuration is used; actual lengths are put in place of the rounded ones; what
is left over and all small lengths are added best-fit, largest first. All of this works on
runs of equal lengths, so its cost does not depend on the number of documents. The plan is
a list of runs, a few per length, by which every piece finds its sequence from its length
and its number among the pieces of that length.

Null texts are empty: such a document is its end id alone. Rows with the same ``doc_id`` are
packed independently; an empty table gives an empty result; other columns are not carried.
"""

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, keep, short_batches, slices, text_bytes
from .tokens import TOGETHER, default_tokenizer, encoder, with_end

#: Sub-groups into which the pieces of one length are dealt to be numbered.
SALTS = 1024
#: Numbers of groups that are tried; 0 is best-fit alone, taken only where it needs fewer sequences.
GROUPS = (40, 24, 16, 8, 0)


class Run(NamedTuple):
    """Pieces ``first``, ``first + 1``, ... of a length: ``each`` of them go to every sequence from ``sequence`` on."""

    length: int
    first: int
    pieces: int
    sequence: int
    each: int
    offset: int


def cut_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    short_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches):
        words = encoder(path)
        for batch in gathered(batches, TOGETHER):
            texts, doc_ids = text_bytes(batch), batch.column("doc_id").to_pylist()
            for a, b in slices(texts, TOGETHER):
                ids, counts = with_end(*words.encode(texts[a:b]), end_id)
                ids, rows, begin = ids.astype("<u4"), [], 0
                for doc_id, n in zip(doc_ids[a:b], counts.tolist(), strict=True):
                    for piece, start in enumerate(range(0, n, capacity)):
                        part = ids[begin + start : begin + min(n, start + capacity)]
                        rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part))
                    begin += n
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns[:5], types, strict=True)]
                if with_ids:
                    arrays.append(pa.array([p.astype(np.int32) for p in columns[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """All multisets of sizes that fit together, one column each, single sizes first."""
    n, found = len(sizes), []
    most = capacity // min(sizes)
    for k in range(1, most + 1):
        for chosen in combinations_with_replacement(range(n), k):
            if sum(sizes[i] for i in chosen) <= capacity:
                found.append(np.bincount(chosen, minlength=n))
    return np.array(found, dtype=float).T


def fewest(columns: np.ndarray, demand: np.ndarray) -> dict[int, float]:
    """Solve min sum(x), columns x = demand, x >= 0; the first columns are the unit matrix."""
    n = len(demand)
    basis, inverse, x = list(range(n)), np.eye(n), demand.astype(float)
    for _ in range(50 * n):
        gain = inverse.sum(axis=0) @ columns
        enter = int(np.argmax(gain))
        if gain[enter] <= 1 + 1e-9:
            break
        direction = inverse @ columns[:, enter]
        ratio = np.full(n, np.inf)
        np.divide(x, direction, out=ratio, where=direction > 1e-9)
        leave = int(np.argmin(ratio))
        x = x - ratio[leave] * direction
        x[leave] = ratio[leave]
        row = inverse[leave] / direction[leave]
        inverse = inverse - np.outer(direction, row)
        inverse[leave] = row
        basis[leave] = enter
    return {j: v for j, v in zip(basis, x.tolist(), strict=True) if v > 1e-9}


class _Bins:
    """Open sequences with the same room, kept as runs of sequence numbers."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 0
        self.rooms: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.used: dict[int, int] = defaultdict(int)
        self.runs: list[Run] = []

    def put(self, sequence: int, count: int, room: int) -> None:
        if count and room:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append((sequence, count))

    def take(self, room: int) -> tuple[int, int]:
        run = self.open[room].pop()
        if not self.open[room]:
            self.rooms.remove(room)
        return run

    def place(self, length: int, pieces: int, sequence: int, each: int, room: int) -> None:
        self.runs.append(Run(length, self.used[length], pieces, sequence, each, self.capacity - room))
        self.used[length] += pieces

    def best_fit(self, length: int, pieces: int) -> None:
        """Put pieces of one length into the fullest sequences that have room, then into new ones."""
        while pieces:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                count = -(-pieces // each)
                self.put(self.next, count, self.capacity)
                self.next += count
                at = bisect_left(self.rooms, self.capacity)
            room = self.rooms[at]
            sequence, count = self.take(room)
            each = room // length
            full = min(count, pieces // each)
            if full:
                self.place(length, full * each, sequence, each, room)
                self.put(sequence, full, room - each * length)
                pieces -= full * each
            rest = count - full
            if rest and pieces:  # fewer than ``each`` are left
                self.place(length, pieces, sequence + full, pieces, room)
                self.put(sequence + full, 1, room - pieces * length)
                full, rest, pieces = full + 1, rest - 1, 0
            self.put(sequence + full, rest, room)


def plan(histogram: dict[int, int], capacity: int, groups: int) -> _Bins:
    """Place every piece of the histogram; ``groups`` 0 is best-fit alone."""
    bins, left = _Bins(capacity), dict(histogram)
    large = sorted((n for n in left if n > capacity // 4), reverse=True)
    total = sum(left[n] for n in large)
    if groups and total:
        per_group, members, sizes = -(-total // groups), [], []
        for n in large:
            count = left[n]
            while count:
                if not members or sum(c for _, c in members[-1]) == per_group:
                    members.append([])
                    sizes.append(n)
                part = min(count, per_group - sum(c for _, c in members[-1]))
                members[-1].append((n, part))
                count -= part
        columns = configurations(sizes, capacity)
        solution = fewest(columns, np.array([sum(c for _, c in m) for m in members]))
        for j, times in sorted(solution.items(), key=lambda v: -float(np.dot(columns[:, v[0]], sizes))):
            chosen = [g for g in range(len(sizes)) for _ in range(int(columns[g, j]))]
            todo = int(times + 1e-6)
            while todo:
                step = todo
                for g in set(chosen):
                    step = min(step, members[g][-1][1] // chosen.count(g)) if members[g] else 0
                if not step:  # a run of equal lengths ends inside a configuration
                    step, actual = 1, []
                    for g in chosen:
                        if not members[g]:
                            break
                        n, c = members[g].pop()
                        actual.append(n)
                        if c > 1:
                            members[g].append((n, c - 1))
                    if len(actual) < len(chosen):
                        break
                else:
                    actual = []
                    for g in chosen:
                        n, c = members[g].pop()
                        actual.append(n)
                        if c > step:
                            members[g].append((n, c - step))
                room = capacity
                for n in actual:
                    bins.place(n, step, bins.next, 1, room)
                    left[n] -= step
                    room -= n
                bins.put(bins.next, step, room)
                bins.next += step
                todo -= step
    for n in sorted(left, reverse=True):
        if left[n]:
            bins.best_fit(n, left[n])
    return bins


def best_plan(histogram: dict[int, int], capacity: int) -> _Bins:
    """The plan with the fewest sequences among several numbers of groups."""
    return min((plan(histogram, capacity, g) for g in GROUPS), key=lambda b: b.next)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have doc_id, piece and length; other columns are kept.

    ``pieces`` is read three times and should be a kept table.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # capacity rows at most
    found = sorted(best_plan(histogram, capacity).runs)
    table = np.array(found, dtype=np.int64).reshape(-1, 6)
    runs = spark.sparkContext.broadcast(table)
    before = counts.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    ).drop("_n")
    here = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        salted.withColumn("_number", F.row_number().over(here) - 1)
        .join(before, ["length", "_salt"])
        .withColumn("_number", F.col("_number") + F.coalesce("_before", F.lit(0)))
        .drop("_salt", "_before")
    )
    schema = numbered.drop("_number").schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names

    def assign(batches):
        known = runs.value
        key = known[:, 0] << 40 | known[:, 1]
        for batch in batches:
            length, number = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("length", "_number"))
            run = known[np.searchsorted(key, length << 40 | number, side="right") - 1]
            inside = number - run[:, 1]
            sequence, offset = run[:, 3] + inside // run[:, 4], run[:, 5] + inside % run[:, 4] * length
            arrays = [batch.column(c) for c in names[:-2]] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return numbered.mapInArrow(assign, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from packed pieces that carry ``ids``; a sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack(keep(cut_documents(docs, tokenizer, capacity, end_id, with_ids)), capacity)
