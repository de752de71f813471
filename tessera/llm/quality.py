"""Quality scores by positive-unlabelled learning.

A small network over shape features of whole texts is trained on trusted
positives and unlabelled web text only: it minimises the non-negative unbiased
risk  pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])  with the
sigmoid loss, which is bounded, so that single texts cannot drive the risk. The
class prior ``pi`` is estimated from the same two samples (``estimate_prior``): no label
but 1 is looked at. The score is the sigmoid of the network's output: label 1 is likelier from 0.5 on.

Positives and unlabelled texts are drawn by hashed id, about ``fit_positives``
and ``fit_unlabelled`` whole texts (documented bounds that do not depend on the
input's size). Scoring is one pass
over all documents where they lie, with a model of fixed size.

Null texts are empty; an empty text has zero features and is scored like any
other. A document labelled more than once is a positive if all its labels are
1. Rows that repeat an id are scored each on their own text, and are all drawn if the id is;
rows without an id are scored and teach nothing. Without positives the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import LOWER, U64, Words, byte_class, slices, small_batches

FIT_POSITIVES = 3000
FIT_UNLABELLED = 6000
BIGRAMS = 128
HIDDEN = 24

IS_SOLID = byte_class((0x09, 0x0D), (0x20, 0x20), negate=True)
NOT_BREAK = byte_class((0x0A, 0x0A), negate=True)


def _categories() -> np.ndarray:
    """A shape category for each byte."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[0x80:] = 1
    kind[0x61:0x7B], kind[0x41:0x5B], kind[0x30:0x3A] = 2, 3, 4
    kind[0x20], kind[0x0A], kind[[9, 11, 12, 13]] = 5, 6, 7
    for i, signs in enumerate((b".,;:", b"!?", b"#$%&*@^~", b"|/\\", b"'\"-", b"()[]{}<>", b"_=+`"), 8):
        kind[list(signs)] = i
    return kind


CATEGORY = _categories()
CATEGORIES = 16
SHAPES = 9
FEATURES = CATEGORIES + SHAPES + BIGRAMS


def _repeats(words: Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the share of distinct units among its units and the share of its most frequent one."""
    row = words.rows()
    n = np.maximum(np.diff(words.bounds), 1)
    if not len(row):
        return np.zeros(rows), np.zeros(rows)
    _, at, count = np.unique(words.hash + row.astype(U64) * U64(0xD6E8FEB86659FD93), return_index=True, return_counts=True)
    most = np.zeros(rows)
    np.maximum.at(most, row[at], count)
    return np.bincount(row[at], minlength=rows) / n, most / n


def shape_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One float32 row per text: byte categories, repetition and length, hashed byte pairs."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(rows), size)
    kind = CATEGORY[data]
    n = np.maximum(size, 1)[:, None]
    out = np.zeros((rows, FEATURES), dtype=np.float32)
    out[:, :CATEGORIES] = np.bincount(row * CATEGORIES + kind, minlength=rows * CATEGORIES).reshape(rows, CATEGORIES) / n
    words, lines = Words(data, offsets, IS_SOLID), Words(data, offsets, NOT_BREAK)
    count = np.diff(words.bounds)
    shape = out[:, CATEGORIES : CATEGORIES + SHAPES]
    shape[:, 0], shape[:, 1] = _repeats(words, rows)
    shape[:, 2], shape[:, 3] = _repeats(lines, rows)
    shape[:, 4] = np.log1p(count) / 10
    shape[:, 5] = np.log1p(np.diff(lines.bounds)) / 10
    length = words.end - words.start
    owner = words.rows()
    shape[:, 6] = np.bincount(owner, length, minlength=rows) / np.maximum(count, 1) / 10
    same = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    shape[:, 7] = np.bincount(owner[1:][same], minlength=rows) / np.maximum(count, 1)
    last = CATEGORY[data[words.end - 1]] >= 8 if len(words.end) else np.zeros(0, bool)
    shape[:, 8] = np.bincount(owner[last], minlength=rows) / np.maximum(count, 1)
    if len(data) > 1:
        low = LOWER[data].astype(np.uint32)
        pair = (((low[:-1] << 8) | low[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BIGRAMS.bit_length() + 1)
        inside = row[:-1] == row[1:]
        pairs = np.bincount(row[:-1][inside] * BIGRAMS + pair[inside], minlength=rows * BIGRAMS).reshape(rows, BIGRAMS)
        out[:, CATEGORIES + SHAPES :] = np.sqrt(pairs / n)
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # hidden weights, hidden bias, output weights, output bias

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40).astype(np.float64)))


def hidden_and_logits(w: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(x @ w[0] + w[1], 0)
    return h, h @ w[2] + w[3]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def risk_parts(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part of the unbiased risk and the negative one, which is no less than 0 in expectation."""
    sp, su = (sigmoid(hidden_and_logits(w, x)[1]) for x in (p, u))
    return prior * (1 - sp).mean(), su.mean() - prior * sp.mean()


def _backward(w: list[np.ndarray], x: np.ndarray, d: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    back = np.outer(d, w[2]) * (h > 0)
    return [x.T @ back, back.sum(axis=0), h.T @ d, np.array([d.sum()])]


def descent(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float, against: bool = False) -> list[np.ndarray]:
    """Gradient of the non-negative risk; where the negative part is below 0, that of its negation, so that the step undoes it.

    With ``against``, of the risk of telling positives from unlabelled texts, half and half.
    """
    (hp, gp), (hu, gu) = hidden_and_logits(w, p), hidden_and_logits(w, u)
    sp, su = sigmoid(gp), sigmoid(gu)
    steep_p, steep_u = sp * (1 - sp), su * (1 - su)
    if against:
        dp, du = -0.5 * steep_p / len(p), 0.5 * steep_u / len(u)
    elif su.mean() - prior * sp.mean() >= 0:
        dp, du = -2 * prior * steep_p / len(p), steep_u / len(u)
    else:
        dp, du = prior * steep_p / len(p), -steep_u / len(u)
    return [x + y for x, y in zip(_backward(w, p, dp, hp), _backward(w, u, du, hu), strict=True)]


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, batches: int = 12, rate: float = 5e-3, decay: float = 1e-3, seed: int = 17, against: bool = False) -> QualityModel:
    """Minimises the non-negative risk by Adam on drawn batches; ``against`` as in ``descent``."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    norm = lambda x: np.clip((x - mean) / scale, -8, 8).astype(np.float64)
    p, u = norm(positive), norm(unlabelled)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    for _ in range(epochs):
        for a, b in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches), strict=True):
            if not len(a) or not len(b):
                continue
            t += 1
            for i, g in enumerate(descent(w, p[a], u[b], prior, against)):
                g = g + decay * w[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return QualityModel(mean, scale, [x.astype(np.float32) for x in w])


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, slack: float = 0.01, risk: float = 0.1) -> float:
    """The class prior from scores of positives and of unlabelled texts.

    Above a threshold that mostly positives pass, the share of unlabelled texts is the prior times that of positives. The
    threshold is the one whose ratio of shares has the least upper confidence bound.
    """
    p, u = np.sort(positive)[::-1], np.sort(unlabelled)[::-1]
    of_p = np.arange(1, len(p) + 1) / len(p)
    of_u = np.searchsorted(-u, -p, side="right") / len(u)
    width = sum(np.sqrt(np.log(4 / risk) / (2 * len(x))) for x in (p, u))
    at = np.argmin(of_u / of_p + (1 + slack) * width / of_p)
    return float(np.clip(of_u[at] / of_p[at], 0.01, 0.99))


#: Rounds of telling positives from unlabelled texts: few, before single texts are learned by heart.
PRIOR_EPOCHS = 7


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 23) -> float:
    """The share of positives among unlabelled texts: a network learns to tell one half of both apart and scores the other half, both ways."""
    rng = np.random.default_rng(seed)
    halves = [np.array_split(x[rng.permutation(len(x))], 2) for x in (positive, unlabelled)]
    if not len(halves[0][1]) or not len(halves[1][1]):
        return 0.5
    found = []
    for fold in (0, 1):
        model = fit_nnpu(halves[0][fold], halves[1][fold], 0.5, epochs=PRIOR_EPOCHS, against=True)
        found.append(best_bin_prior(*(model.logits(x[1 - fold]) for x in halves)))
    return float(np.mean(found))


def learns(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _draw(id_col: str):
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches, "text"):
        x = shape_features(data, offsets)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["positive", "features"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_positives: int = FIT_POSITIVES, fit_unlabelled: int = FIT_UNLABELLED) -> QualityModel | None:
    """Learns from labels of training rows; None without any positive."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(learns("id") & F.col("label").isNotNull()).groupBy("id").agg(F.min("label").alias("label"))
    ones = known.where("label = 1").count()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(learns("id"))
    total = texts.count() if ones else 0
    if not ones or not total:
        return None
    chosen = known.where((F.col("label") == 1) & (_draw("id") < fit_positives / ones)).select("id")  # about fit_positives ids
    positive = texts.join(chosen, "id", "left_semi").select(F.lit(True).alias("positive"), "text")
    unlabelled = texts.where(_draw("id") < fit_unlabelled / total).select(F.lit(False).alias("positive"), "text")
    rows = positive.unionByName(unlabelled).mapInArrow(_features, "positive boolean, features binary").collect()
    # sorted, so that the order of rows does not matter
    x = {k: np.frombuffer(b"".join(sorted(bytes(r["features"]) for r in rows if r["positive"] is k)), dtype=np.float32).reshape(-1, FEATURES) for k in (True, False)}
    return fit_nnpu(x[True], x[False], estimate_prior(x[True], x[False])) if len(x[True]) and len(x[False]) else None


def score_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, data, offsets in slices(batches, "text"):
            s = m.score(shape_features(data, offsets)) if m else np.full(rows.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, score double")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", (~learns("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
