"""Periodic runs of word sequences by recompression.

The words of many documents form one sequence with a separator of its own at every border.
Rounds of block compression (a maximal block of one symbol becomes one symbol) and pair
compression (symbols are dealt to two sides by a hash, and a left one followed by a right one
becomes one symbol) shrink it to nothing; the levels are a run-length grammar in which equal
stretches are parsed alike but for their edges. How far two places agree is then answered by
climbing to coarser symbols while both places lie on their borders, and coming down where they
differ, for arrays of pairs at a time, to both sides.

A run of period p and length L keeps L - p consecutive places equal to those p words on. Places on
a grid as wide as the shortest such stretch meet every run, so each period costs a harmonic share
of the text; a place whose word differs from the word p on is passed by at once. Of equal
stretches found with several periods the smallest period counts; the others are its multiples.
"""

from collections import defaultdict
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import expand, gathered, short_batches, slices, text_bytes

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 24, 3
#: Bytes of text in one grammar; a longer text is one by itself.
CHUNK = 4_000_000
#: Grid places looked at together.
PLACES = 1 << 21
ROUNDS = 96
MIX = np.uint64(0x9E3779B97F4A7C15)


class Grammar:
    """Levels of a sequence: symbols, the symbol above each, and the first symbol below each."""

    def __init__(self, text: np.ndarray):
        self.symbols, self.up, self.first, self.blocks = [text], [], [], []
        fresh = int(text.max()) + 1 if len(text) else 0
        for turn in range(ROUNDS):
            if len(self.symbols[-1]) <= 2:
                break
            fresh = self._compress_blocks(fresh)
            fresh = self._compress_pairs(fresh, turn)

    def _add(self, starts: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        lengths = np.diff(starts, append=len(self.symbols[-1]))
        self.up.append(np.repeat(np.arange(len(starts), dtype=np.int32), lengths))
        self.first.append(np.append(starts, len(self.symbols[-1])).astype(np.int32))
        self.blocks.append(blocks)
        self.symbols.append(symbols)

    def _compress_blocks(self, fresh: int) -> int:
        text = self.symbols[-1]
        starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        lengths = np.diff(starts, append=len(text))
        long = lengths > 1
        if not long.any():
            return fresh
        symbols = text[starts]
        names, symbols[long] = np.unique(symbols[long] * (len(text) + 1) + lengths[long], return_inverse=True)
        symbols[long] += fresh
        self._add(starts, symbols, True)
        return fresh + len(names)

    def _compress_pairs(self, fresh: int, turn: int) -> int:
        text = self.symbols[-1]
        side = ((text.astype(np.uint64) + np.uint64(turn + 1)) * MIX) ^ np.uint64(turn * 0x5851F42D)
        side = (((side ^ (side >> np.uint64(29))) * MIX) >> np.uint64(63)).astype(bool)
        heads = np.append(~side[:-1] & side[1:], False)
        if not heads.any():
            return fresh
        starts = np.flatnonzero(~np.append(False, heads[:-1]))
        symbols, joined = text[starts], heads[starts]
        left = starts[joined]
        names, symbols[joined] = np.unique(text[left] * fresh + text[left + 1], return_inverse=True)
        symbols[joined] += fresh
        self._add(starts, symbols, False)
        return fresh + len(names)

    def _step(self, level: int, a: np.ndarray, right: bool) -> np.ndarray | int:
        """Symbols to the end of the block that lies beside the border ``a``."""
        up, first = self.up[level], self.first[level]
        return first[up[a] + 1] - a if right else a - first[up[a - 1]]

    def _advance(self, level: int, a: np.ndarray, b: np.ndarray, which: np.ndarray, right: bool) -> None:
        step = 1
        if level < len(self.up) and self.blocks[level]:
            step = np.minimum(self._step(level, a[which], right), self._step(level, b[which], right))
        a[which] += step if right else -step
        b[which] += step if right else -step

    def common(self, i: np.ndarray, j: np.ndarray, right: bool) -> np.ndarray:
        """How many words agree from the places i and j on, or before them; i is not j.

        Every end of the sequence is a separator, so a place never leaves it.
        """
        a, b = i.astype(np.int64), j.astype(np.int64)
        back, top = 0 if right else 1, len(self.up)
        live, fallen = np.arange(len(a)), []
        for level in range(top + 1):
            symbols, down, risen = self.symbols[level], [], []
            while len(live):
                equal = symbols[a[live] - back] == symbols[b[live] - back]
                down.append(live[~equal])
                live = live[equal]
                if level < top and len(live):
                    up, first = self.up[level], self.first[level]
                    border = (first[up[a[live]]] == a[live]) & (first[up[b[live]]] == b[live])
                    risen.append(live[border])
                    live = live[~border]
                self._advance(level, a, b, live, right)
            fallen.append(np.concatenate(down) if down else live)
            live = np.concatenate(risen) if risen else live
            if not len(live):
                break
            a[live], b[live] = self.up[level][a[live]], self.up[level][b[live]]
        here = fallen.pop()
        for level in range(len(fallen) - 1, -1, -1):
            symbols, first = self.symbols[level], self.first[level]
            a[here], b[here] = first[a[here]], first[b[here]]
            live = here
            while len(live := live[symbols[a[live] - back] == symbols[b[live] - back]]):
                self._advance(level, a, b, live, right)
            here = np.concatenate([here, fallen[level]])
        return np.abs(a - i)


def grid(starts: np.ndarray, lengths: np.ndarray, size: int, least: int, periods: int):
    """(place, period) of the harmonic grid, some at a time; documents lie by growing length."""
    longest = int(lengths.max()) if len(lengths) else 0
    period = np.arange(1, longest // periods + 1)
    needed = np.maximum(least, periods * period)
    period, needed = period[needed <= longest], needed[needed <= longest]
    begin = starts[np.searchsorted(lengths, needed)]
    width = needed - period
    counts = np.maximum(0, -(-(size - period - begin) // width))
    batch = np.cumsum(counts) // PLACES
    cuts = np.flatnonzero(np.diff(batch, prepend=-1, append=-1)) if len(batch) else batch
    for a, b in pairwise(cuts.tolist()):
        nth = expand(np.zeros(b - a, dtype=np.int64), counts[a:b])
        yield np.repeat(begin[a:b], counts[a:b]) + nth * np.repeat(width[a:b], counts[a:b]), np.repeat(period[a:b], counts[a:b])


def runs_of(documents: list[np.ndarray], least: int = LEAST, periods: int = PERIODS) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) arrays of all runs, by document, start and period.

    A document is an array of word numbers from 0 on.
    """
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    words = max((int(d.max()) + 1 for d in documents if len(d)), default=0)
    parts = [np.array([words])]
    for n, k in enumerate(order):
        parts += [documents[k], np.array([words + n + 1])]
    text = np.concatenate(parts).astype(np.int64)
    begins = np.cumsum(lengths[order] + 1) - lengths[order]
    found = [(np.zeros(0, np.int64),) * 3]
    grammar = None
    for place, period in grid(begins, lengths[order], len(text), least, periods):
        same = text[place] == text[place + period]
        if not same.any():
            continue
        grammar = grammar or Grammar(text)
        place, period = place[same], period[same]
        after = grammar.common(place, place + period, True)
        before = grammar.common(place, place + period, False)
        length = before + after + period
        good = length >= np.maximum(least, periods * period)
        found.append(((place - before)[good], length[good], period[good]))
    start, length, period = (np.concatenate(v) for v in zip(*found, strict=True))
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    if len(start):
        new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))
        start, length, period = start[new], length[new], period[new]
    which = np.searchsorted(begins, start, side="right") - 1
    document = order[which]
    by = np.lexsort((period, start, document))
    return document[by], (start - begins[which])[by], length[by], period[by]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that lie in no run after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([w for w, n in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not n])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``, one row for one row.

    Words are what stands between ASCII white space. ``runs`` are (start, length, period) of all
    maximal stretches with smallest period q and at least max(``least``, ``periods`` * q) words, by
    start and period; ``collapsed`` is the UTF-8 text of the words that lie in no run after its first q
    words, joined by one space.

    Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows, null
    ids and equal ids each give their own row; other columns are not read, whatever their names. A text is never cut: the memory of a task
    grows with its longest text, at about 100 bytes a word.
    """
    short_batches(docs.sparkSession)

    def run(batches):
        for batch in gathered(batches, CHUNK):
            texts, ids = text_bytes(batch), batch.column("doc_id")
            for a, b in slices(texts, CHUNK):
                split = [t.split() for t in texts[a:b]]
                number = defaultdict(count().__next__)
                coded = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in split]
                runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
                for k, *found in zip(*(v.tolist() for v in runs_of(coded, least, periods)), strict=True):
                    runs[k].append(tuple(found))
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in each] for each in runs]
                arrays = [
                    ids.slice(a, b - a), pa.array([len(w) for w in split], pa.int64()), pa.array(rows, kind),
                    pa.array([collapsed(w, r) for w, r in zip(split, runs, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])

    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    return source.mapInArrow(run, schema)


def densest(runs: Column) -> Column:
    """The run with the most periods, the first of equals; null where there is none. Lengths are compared crosswise, so exactly."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.reduce(runs, nothing, lambda best, run: F.when(better(best, run), run).otherwise(best))


def listing(runs: Column) -> Column:
    """``start,length,period`` of every run, each with a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
