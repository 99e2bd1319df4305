"""Toxicity by compression distance between two zstandard dictionaries.

A text becomes windows of ``WORDS`` words, lower-cased in A-Z, letters only. Each window is
compressed with the dictionary of ordinary text and with that of toxic text; bytes saved by
the second are the window's evidence. A document's features are the mean and the largest evidence, and how
many windows, and what share of them, pass each threshold. Thresholds are quantiles of the evidence in toxic documents that the
dictionaries have not seen, and the weights of the features are fitted on such documents too. Every letter is followed by a
check byte of its word up to it, so a match is a match of beginnings of words: the middle of an
ordinary word looks like no beginning of a telling one, and a match saves twice its letters.

Toxic documents are mostly ordinary words, so the toxic dictionary is made of contrast: the longest
beginnings of words of toxic texts that occur in significantly more toxic than
ordinary documents, the most telling last. Its content stands in front of the ordinary dictionary's, so that ordinary
words cost the same in both and the difference is quiet where nothing is toxic.

``fit`` uses at most ``rows`` labelled rows, chosen by hash, and their whole texts; dictionaries are made and features
measured in tasks, the driver sees the features. Null and empty texts
have no evidence and get the score of that; rows with a null id are scored and are not held
out; an empty table gives an empty result; extra columns are not carried.
"""

from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, labelled_rows, short_batches, text_bytes

ROWS, FOLDS = 8000, 4
WORDS = 8
ORDINARY_BYTES, TOXIC_BYTES = 16384, 8192
#: Letters of a beginning of a word, with the space before it.
SHORTEST, LONGEST = 5, 13
#: A beginning tells when its share of toxic documents is this many times that of ordinary ones, at this significance.
RATIO, LEAST_Z = 8, 4.5
#: Evidence of toxic documents' windows that become thresholds: these quantiles of what is above 1 byte.
QUANTILES = (0.1, 0.3, 0.5, 0.7, 0.85, 0.95)
#: Evidence is counted up to this many bytes.
MOST = 64
PENALTY = 0.1


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    thresholds: tuple[int, ...]
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


def letters_only() -> bytes:
    """Byte table: A-Z to lower case, a-z and all non-ASCII bytes as they are, the rest to a space."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: bytes, table: bytes) -> bytes:
    """The words with a space before, between and behind them."""
    return b" ".join([b"", *text.translate(table).split(), b""])


_POWERS = np.array([pow(33, i, 256) for i in range(8)], dtype=np.uint8)
_INVERSE = np.array([pow(33, -i, 256) for i in range(8)], dtype=np.uint8)


def coded(text: bytes) -> bytes:
    """Every byte followed by a check byte of the word up to it: ``h = 33 * h + byte`` from the last space on."""
    data = np.frombuffer(text, np.uint8)
    place = np.arange(len(data)) & 7
    summed = np.cumsum(data * _INVERSE[place], dtype=np.uint8)
    start = np.maximum.accumulate(np.where(data == 32, np.arange(len(data)), -1))
    before = np.where(start >= 0, summed[np.maximum(start, 0)], np.uint8(0))
    out = np.empty((len(data), 2), dtype=np.uint8)
    out[:, 0], out[:, 1] = data, (summed - before) * _POWERS[place] + np.uint8(1)
    return out.tobytes()


def windows(text: bytes) -> list[bytes]:
    """The coded windows of a normal text."""
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    if len(spaces) < 2 or len(text) < 3:
        return []
    starts = spaces[:-1:WORDS]
    ends = np.append(spaces[WORDS:-1:WORDS], spaces[-1]) + 1
    whole = coded(text)
    return [whole[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def compressor(content: bytes):
    import zstandard

    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0, strategy=zstandard.STRATEGY_LAZY2,
        window_log=17, chain_log=14, hash_log=16, search_log=4, min_match=6, target_length=8,
    )
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def saved(found: list[bytes], ordinary, toxic) -> np.ndarray:
    """Bytes that the toxic dictionary saves per window."""
    one = np.fromiter((len(ordinary.compress(w)) for w in found), np.int64, len(found))
    return one - np.fromiter((len(toxic.compress(w)) for w in found), np.int64, len(found))


def counted(gains: np.ndarray) -> np.ndarray:
    """How many windows have each evidence: 0 and less, 1, 2, ... ``MOST`` and more bytes."""
    return np.bincount(np.clip(gains, 0, MOST), minlength=MOST + 1)


def features(counts: np.ndarray, thresholds: tuple[int, ...]) -> np.ndarray:
    """Features of documents from their windows' ``counted`` evidence, one row each."""
    counts = counts.reshape(-1, MOST + 1)
    total = counts.sum(axis=1)
    value = np.arange(MOST + 1)
    mean = counts @ value / np.maximum(1, total)
    largest = ((counts > 0) * value).max(axis=1) if len(counts) else mean
    over = np.array([counts[:, t:].sum(axis=1) for t in thresholds]).reshape(len(thresholds), -1)
    share = over / (total + 3)
    return np.vstack([mean, largest, np.log1p(over), share, np.sqrt(share)]).T


def calibrated(counts: np.ndarray) -> tuple[int, ...]:
    """Thresholds from the ``counted`` evidence of toxic documents."""
    above = counts.reshape(-1, MOST + 1).sum(axis=0)[2:]
    if not above.sum():
        return tuple(range(2, 2 + len(QUANTILES)))
    ranks = np.cumsum(above) / above.sum()
    return tuple(int(np.searchsorted(ranks, q)) + 2 for q in QUANTILES)


def beginnings(text: bytes) -> set[bytes]:
    """Beginnings of the words of a normal text, with the space before them, and whole words with both spaces."""
    found = set()
    for word in set(text.split()):
        word = b" " + word + b" "
        found.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
    return found


def telling(toxic: list[bytes], ordinary: list[bytes]) -> dict[bytes, float]:
    """Beginnings whose share of toxic documents is significantly above that of ordinary ones, with the significance."""
    seen, elsewhere = Counter(), Counter()
    for text in toxic:
        seen.update(beginnings(text))
    for text in ordinary:
        elsewhere.update(p for p in beginnings(text) if p in seen)
    a, b, out = max(1, len(toxic)), max(1, len(ordinary)), {}
    for part, n in seen.items():
        m = elsewhere[part]
        if n < 3 or n / a < RATIO * m / b:
            continue
        share = (n + m) / (a + b)
        z = (n / a - m / b) / max(share * (1 - share) * (1 / a + 1 / b), 1e-12) ** 0.5
        if z >= LEAST_Z:
            out[part] = z
    return out


def segments(text: bytes, known: dict[bytes, float]) -> set[bytes]:
    """The longest telling beginning of every word."""
    found = set()
    for word in set(text.split()):
        word = b" " + word + b" "
        found.add(next((word[:k] for k in range(min(len(word), LONGEST), SHORTEST - 1, -1) if word[:k] in known), b""))
    return found - {b""}


def dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights, the constant last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionaries(texts: list[bytes], labels: list[int]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary."""
    toxic, plain = (sorted({t for t, y in zip(texts, labels, strict=True) if y == label}) for label in (1, 0))
    ordinary = dictionary(2 * ORDINARY_BYTES, [w for t in plain for w in windows(t)])[-ORDINARY_BYTES:] or b" " * 16
    known = telling(toxic, plain)
    found = sorted(set().union(*(segments(t, known) for t in toxic)), key=lambda s: (known[s], s))
    return ordinary, b"".join(coded(s) for s in found)[-TOXIC_BYTES:] + ordinary


def train(counts: np.ndarray, labels: np.ndarray, contents: tuple[bytes, bytes]) -> Model:
    """Thresholds and weights from the ``counted`` evidence of documents under dictionaries that have not seen them."""
    thresholds = calibrated(counts[labels == 1]) if len(labels) else calibrated(np.zeros(0))
    x = features(counts, thresholds)
    if not len(x):
        return Model(*contents, thresholds, np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1))
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(*contents, thresholds, centre, spread, logistic((x - centre) / spread, labels.astype(float)))


def probability(x: np.ndarray, model: Model) -> np.ndarray:
    raw = ((x - model.centre) / model.spread) @ model.weights[:-1] + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model from at most ``rows`` labelled rows; ``labels`` has doc_id and label. Rows equal in id and text count once."""
    spark = docs.sparkSession
    short_batches(spark)
    table = letters_only()
    part = F.pmod(F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string")).cast("binary")), F.lit(FOLDS)).cast("int").alias("part")
    known = keep(labelled_rows(docs, labels, rows).select(part, F.col("text").cast("binary").alias("text"), "label"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        texts = [normal(bytes(t) if t is not None else b"", table) for t in group["text"]]
        ordinary, toxic = dictionaries(texts, group["label"].tolist())
        return pd.DataFrame({"left_out": [int(group["left_out"].iloc[0])], "ordinary": [ordinary], "toxic": [toxic]})

    # a set of at most ``rows`` rows for each fold that is left out, and one of all
    sets = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda k: k != F.col("part"))
    learnt = known.withColumn("left_out", F.explode(sets)).groupBy("left_out").applyInPandas(learn, "left_out int, ordinary binary, toxic binary")
    found = {r["left_out"]: (bytes(r["ordinary"]), bytes(r["toxic"])) for r in learnt.collect()}
    nothing = dictionaries([], [])

    def measure(batches):
        pairs = {}
        for batch in batches:
            counts = []
            for k, text in zip(batch.column("part").to_pylist(), text_bytes(batch), strict=True):
                pairs.setdefault(k, tuple(map(compressor, found.get(k, nothing))))
                counts.append(counted(saved(windows(normal(text, table)), *pairs[k])))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(counts, pa.list_(pa.int64()))], names=["label", "counts"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    measured = sorted(map(tuple, known.repartition(tasks).mapInArrow(measure, "label int, counts array<bigint>").collect()))
    y = np.array([label for label, _ in measured])
    return train(np.array([c for _, c in measured]).reshape(-1, MOST + 1), y, found.get(FOLDS, nothing))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence, telling_windows, n_windows) of every document."""
    short_batches(docs.sparkSession)
    table = letters_only()

    def measure(batches):
        one, two = compressor(model.ordinary), compressor(model.toxic)
        for batch in batches:
            gains = [saved(windows(normal(t, table)), one, two) for t in text_bytes(batch)]
            p = probability(features(np.array([counted(g) for g in gains]), model.thresholds), model)
            arrays = [
                batch.column("doc_id"),
                pa.array(p),
                pa.array([int(g.sum()) for g in gains], pa.int64()),
                pa.array([int((g >= model.thresholds[2]).sum()) for g in gains], pa.int64()),
                pa.array([len(g) for g in gains], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "evidence", "telling_windows", "n_windows"])

    schema = "doc_id long, score double, evidence long, telling_windows long, n_windows long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, schema)
