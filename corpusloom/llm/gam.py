"""A quality classifier: generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes round the features, one shallow tree a
turn, and adds the tree's leaf values to that feature's lookup table; then it goes round the
most useful pairs of features in the same way with two-way tables. A text's score is the
logistic function of the sum of its table entries, one vectorised addition per table.

``fit`` uses at most ``rows`` labelled documents, chosen by the hash of their id; ``score``
reads whole texts. Null and empty texts have all features at zero and get a score like any
other; rows with a null id are scored; an empty table gives an empty result; ``score`` returns
only its own columns, ``accepted`` all columns of its rows.
"""

from collections import Counter
from itertools import combinations
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_rows, short_batches, text_bytes

ROWS = 12000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
RATE, LEAVES, LEAST = 0.1, 3, 20

FEATURES = (
    "log_words", "word_length", "symbols", "capitals", "digits", "punctuation", "marks", "distinct_words",
    "adjacent_repeats", "commonest_word", "distinct_lines", "line_words", "one_word_lines", "non_ascii", "brackets",
)


class Model(NamedTuple):
    constant: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]


def byte_groups() -> dict[str, np.ndarray]:
    groups = {"symbols": b"#*$%&|<>~^=_", "punctuation": b".,;:", "marks": b"!?", "brackets": b"()[]{}\\/"}
    return {k: np.array(list(v)) for k, v in groups.items()}


def measure(text: bytes, groups: dict[str, np.ndarray]) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = sum(map(len, words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    distinct = set(words)
    per_line = [line.count(b" ") for line in lines]
    return [
        float(np.log1p(n)),
        solid / n,
        float(counts[groups["symbols"]].sum()) / n,
        float(counts[65:91].sum()) / solid,
        float(counts[48:58].sum()) / solid,
        float(counts[groups["punctuation"]].sum()) / n,
        float(counts[groups["marks"]].sum()) / n,
        len(distinct) / n,
        sum(map(eq, words, words[1:])) / n,
        max(Counter(words).values()) / n,
        len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(c == 0 for c in per_line) / len(lines),
        float(counts[128:].sum()) / solid,
        float(counts[groups["brackets"]].sum()) / n,
    ]


def feature_table(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, features) and the carried columns."""
    short_batches(docs.sparkSession)
    groups = byte_groups()

    def run(batches):
        for batch in batches:
            values = pa.array([measure(t, groups) for t in text_bytes(batch)], pa.list_(pa.float64()))
            arrays = [batch.column("doc_id"), values, *[batch.column(c) for c in carried]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "features", *carried])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    kinds = "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in carried)
    return source.mapInArrow(run, "doc_id long, features array<double>" + kinds)


def edges_of(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, values, side="right")


def leaf(g, h):
    return g / (h + 1.0)


def gain(g, h):
    return g * g / (h + 1.0)


def shallow_tree(grad: np.ndarray, hess: np.ndarray, count: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, float]:
    """Leaf value of every bin for the best cuts, found one after the other, and their gain."""
    parts, total = [(0, len(grad))], 0.0
    sums = [np.concatenate([[0], np.cumsum(v)]) for v in (grad, hess, count)]
    while len(parts) < leaves:
        best = None
        for a, b in parts:
            for_cut = np.arange(a + 1, b)
            left, right = ([s[for_cut] - s[a] for s in sums], [s[b] - s[for_cut] for s in sums])
            better = gain(left[0], left[1]) + gain(right[0], right[1]) - gain(sums[0][b] - sums[0][a], sums[1][b] - sums[1][a])
            better = np.where((left[2] >= LEAST) & (right[2] >= LEAST), better, 0)
            if len(better) and (best is None or better.max() > best[0]):
                best = float(better.max()), a, int(for_cut[better.argmax()]), b
        if best is None or best[0] <= 1e-9:
            break
        parts.remove((best[1], best[3]))
        parts += [(best[1], best[2]), (best[2], best[3])]
        total += best[0]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = leaf(sums[0][b] - sums[0][a], sums[1][b] - sums[1][a])
    return out, total


def pair_tree(grad: np.ndarray, hess: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of one feature, then of the other on either side; grids by bins of both."""
    best = None
    for flip in (False, True):
        g, h, c = (v.T if flip else v for v in (grad, hess, count))
        for cut in range(1, g.shape[0]):
            values, total = np.zeros(g.shape), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                part, better = shallow_tree(g[rows].sum(axis=0), h[rows].sum(axis=0), c[rows].sum(axis=0), 2)
                values[rows] = part
                total += better + gain(g[rows].sum(), h[rows].sum())
            total -= gain(g.sum(), h.sum())
            if best is None or total > best[1]:
                best = (values.T if flip else values), total
    return best or (np.zeros(grad.shape), 0.0)


def probability(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    x, y = x.reshape(-1, len(FEATURES)), y.astype(float)
    if not len(y):
        return Model(0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [], [np.zeros(0)] * len(FEATURES), [])
    share = (y.sum() + 1) / (len(y) + 2)
    constant = float(np.log(share / (1 - share)))
    edges = [edges_of(v, BINS) for v in x.T]
    bins = [binned(v, e) for v, e in zip(x.T, edges, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    raw = np.full(len(y), constant)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            p = probability(raw)
            size = len(tables[j])
            tree, _ = shallow_tree(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), np.bincount(b, minlength=size))
            tables[j] += RATE * tree
            raw += RATE * tree[b]
    pair_edges = [edges_of(v, PAIR_BINS) for v in x.T]
    coarse = [binned(v, e) for v, e in zip(x.T, pair_edges, strict=True)]
    sizes = [len(e) + 1 for e in pair_edges]

    def grids(i: int, j: int):
        p = probability(raw)
        at, shape = coarse[i] * sizes[j] + coarse[j], (sizes[i], sizes[j])
        n = shape[0] * shape[1]
        return at, [np.bincount(at, w, n).reshape(shape) for w in (y - p, p * (1 - p), np.ones(len(y)))]

    ranked = sorted(((pair_tree(*grids(i, j)[1])[1], i, j) for i, j in combinations(range(len(FEATURES)), 2)), reverse=True)
    pairs = [(i, j) for better, i, j in ranked[:PAIRS] if better > 1e-6]
    pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            at, grid = grids(i, j)
            tree, _ = pair_tree(*grid)
            pair_tables[k] += RATE * tree
            raw += RATE * tree.reshape(-1)[at]
    return Model(constant, edges, tables, pairs, pair_edges, pair_tables)


def predict(x: np.ndarray, model: Model) -> np.ndarray:
    x = x.reshape(-1, len(FEATURES))
    raw = np.full(len(x), model.constant)
    for v, edges, table in zip(x.T, model.edges, model.tables, strict=True):
        raw += table[binned(v, edges)]
    for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
        raw += table[binned(x[:, i], model.pair_edges[i]), binned(x[:, j], model.pair_edges[j])]
    return probability(raw)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model from at most ``rows`` labelled rows; ``labels`` has doc_id and label. Rows equal in id and text count once."""
    labelled = labelled_rows(docs, labels, rows)
    found = sorted((r[0], r[2], r[1]) for r in feature_table(labelled.select("doc_id", "text", "label"), "label").collect())
    return train(np.array([f for _, _, f in found], dtype=float), np.array([y for _, y, _ in found], dtype=float))


def score_column(model: Model):
    """The score of a text, given as bytes, as a column function."""
    groups = byte_groups()

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(np.array([measure(t or b"", groups) for t in texts], dtype=float), model))

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model)(F.col("text").cast("binary")).alias("score"))


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, all columns kept."""
    short_batches(docs.sparkSession)
    return docs.filter(score_column(model)(F.col("text").cast("binary")) >= least)
