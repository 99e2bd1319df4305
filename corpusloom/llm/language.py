"""Language identification in two steps: first the family, then the language within it.

A text is the square roots of its byte n-gram frequencies (two to four bytes of lower-cased
letters, hashed into ``SLOTS``). Families are learnt: languages whose mean vectors are close
are put together, average link, until about the square root of their number are left. Linear
support vector machines, one for each pair, separate the families, and one-versus-one machines
separate the languages of a family; each margin becomes a probability by a logistic fit, and
pairwise probabilities are averaged per class. The score is the family's times the language's.

``fit`` uses at most ``rows`` documents, equally many per language where there are enough,
chosen by the hash of their id; ``predict`` reads whole texts. A null text or one without a
letter is ``und`` with score 1. Rows with a null id are predicted; null languages are not
learnt; an empty table gives an empty result; other columns are not carried.
"""

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches, text_bytes, thinned
from .toxicity import letters_only, logistic

#: Languages that are learnt at most.
LANGUAGES = 512
ROWS = 2400
SLOT_BITS = 12
SLOTS = 1 << SLOT_BITS
PIECE = 1 << 20
ASCII_LETTER = re.compile(rb"[A-Za-z]")


class Machine(NamedTuple):
    """A linear machine between classes ``one`` (positive) and ``two``, with its logistic scale."""

    one: int
    two: int
    weights: np.ndarray
    constant: float
    scale: float
    offset: float


class Model(NamedTuple):
    languages: list[str]
    families: list[list[int]]
    between: list[Machine]
    within: list[list[Machine]]


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def vector(text: bytes, table: bytes) -> np.ndarray:
    data = np.frombuffer(b" " + b" ".join(text.translate(table).split()) + b" ", np.uint8)
    counts = np.zeros(SLOTS)
    for first in range(0, len(data), PIECE):
        part = data[first : first + PIECE + 3].astype(np.uint32)
        code = part
        for n in (2, 3, 4):
            if len(part) < n:
                break
            code = code[:-1] << np.uint32(8) | part[n - 1 :]
            own = min(len(code), PIECE)
            slots = (code[:own] * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2246822519) >> np.uint32(32 - SLOT_BITS)
            counts += np.bincount(slots, minlength=SLOTS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def machine(x: np.ndarray, y: np.ndarray, one: int, two: int, rounds: int = 12, cost: float = 10.0) -> Machine:
    """A linear support vector machine by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    norms, alpha, w = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = min(max(alpha[i] + (1 - y[i] * (x[i] @ w)) / norms[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    margin = x @ w
    scale, offset = logistic(margin[:, None], (y > 0).astype(float), 0.1)
    return Machine(one, two, w[:-1], float(w[-1]), float(scale), float(offset))


def machines(x: np.ndarray, classes: np.ndarray, names: list[int]) -> list[Machine]:
    out = []
    for a, one in enumerate(names):
        for two in names[a + 1 :]:
            rows = (classes == one) | (classes == two)
            out.append(machine(x[rows], np.where(classes[rows] == one, 1.0, -1.0), one, two))
    return out


def shares(x: np.ndarray, found: list[Machine], names: list[int]) -> np.ndarray:
    """Mean pairwise probability of every class, adding up to one."""
    if len(names) == 1:
        return np.ones((len(x), 1))
    total = np.zeros((len(x), len(names)))
    for m in found:
        p = 1 / (1 + np.exp(-np.clip((x @ m.weights + m.constant) * m.scale + m.offset, -30, 30)))
        total[:, names.index(m.one)] += p
        total[:, names.index(m.two)] += 1 - p
    return total / total.sum(axis=1, keepdims=True)


def group(means: np.ndarray, wanted: int) -> list[list[int]]:
    """Average-link clustering of the rows by cosine."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    alike = unit @ unit.T
    families = [[i] for i in range(len(means))]
    while len(families) > wanted:
        pairs = [(alike[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(families) for j, b in enumerate(families) if i < j]
        _, i, j = max(pairs)
        families[i] = families[i] + families[j]
        del families[j]
    return families


def train(x: np.ndarray, languages: list[str]) -> Model:
    names = sorted(set(languages))
    if not names:
        return Model([], [], [], [])
    classes = np.array([names.index(v) for v in languages])
    means = np.array([x[classes == k].mean(axis=0) for k in range(len(names))])
    # what all languages share says nothing about their kinship
    families = group(means - means.mean(axis=0) if len(names) > 2 else means, max(1, round(len(names) ** 0.5)))
    of = np.array([next(f for f, members in enumerate(families) if k in members) for k in classes])
    between = machines(x, of, list(range(len(families))))
    within = [machines(x, classes, members) for members in families]
    return Model(names, families, between, within)


def decide(x: np.ndarray, model: Model) -> tuple[list[str], np.ndarray]:
    family = shares(x, model.between, list(range(len(model.families))))
    chosen = family.argmax(axis=1)
    languages, scores = np.empty(len(x), dtype=object), np.zeros(len(x))
    for f, members in enumerate(model.families):
        rows = np.flatnonzero(chosen == f)
        if len(rows):
            inside = shares(x[rows], model.within[f], members)
            best = inside.argmax(axis=1)
            languages[rows] = [model.languages[members[k]] for k in best]
            # pairwise means of n classes reach at most 2 / n
            scores[rows] = np.minimum(1, family[rows, f] * len(model.families) / 2 if len(model.families) > 1 else 1)
            scores[rows] *= np.minimum(1, inside[np.arange(len(rows)), best] * len(members) / 2 if len(members) > 1 else 1)
    return languages.tolist(), scores


def fit(docs: DataFrame, rows: int = ROWS) -> Model:
    """A model from at most ``rows`` rows (doc_id, text, lang), as many of each language.

    Rows equal in id, text and language count once. Of more than ``LANGUAGES`` values of ``lang`` the most frequent are learnt.
    """
    spark = docs.sparkSession
    short_batches(spark)
    table = letters_only()
    known = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text", "lang").alias("_key")).filter("lang is not null and text is not null")
    # different rows, within a few hundredths; at most LANGUAGES rows
    counts = known.groupBy("lang").agg(F.approx_count_distinct("_key", 0.03).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    each = max(2, rows // max(1, len(counts)))
    # of a large language four times as many are ranked, so that no task ranks a whole language
    shares = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 4 * each / r["n"]))]) if counts else F.create_map().cast("map<string,double>")
    some = thinned(known.select("lang", "_key"), "_key", shares[F.col("lang")]).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("_key"), "_key")
    chosen = some.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= each).select(F.col("_key").alias("_picked"))
    sample = known.join(F.broadcast(chosen), F.col("_key") == F.col("_picked")).dropDuplicates(["_key"])  # ``rows`` rows at most

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch)
            some = [i for i, t in enumerate(texts) if has_letter(t)]
            values = [vector(texts[i], table).astype(np.float32).tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some, pa.int64())), batch.column("lang").take(pa.array(some, pa.int64())), pa.array(values, pa.binary())], names=["doc_id", "lang", "v"])

    found = [(r[0], r[1], bytes(r[2])) for r in sample.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, v binary").collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    x = np.array([np.frombuffer(v, np.float32) for _, _, v in found], dtype=np.float32).reshape(-1, SLOTS)
    return train(x, [lang for _, lang, _ in found])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, family) of every document."""
    short_batches(docs.sparkSession)
    table = letters_only()
    family = {lang: "+".join(sorted(model.languages[k] for k in members)) for members in model.families for lang in (model.languages[k] for k in members)}

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch)
            known = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
            lang, scores = ["und"] * len(texts), np.ones(len(texts))
            if known:
                found, values = decide(np.array([vector(texts[i], table) for i in known]), model)
                for i, language in zip(known, found, strict=True):
                    lang[i] = language
                scores[known] = values
            arrays = [batch.column("doc_id"), pa.array(lang), pa.array(scores), pa.array([family.get(v) for v in lang], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "family"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, family string")
