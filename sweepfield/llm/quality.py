"""Quality: Bradley-Terry ranking learned from preference pairs.

Every text becomes a short vector of surface features, computed with numpy
over Arrow batches. Training pairs a good labelled text with a bad one; under
the Bradley-Terry model the chance that the good one wins is the logistic of
the difference of scores, so the weights follow from a logistic loss on
feature differences. The threshold is a quantile of the scores of all labelled
texts: the share of bad ones among them. Scores are mapped so that the
threshold lands on 0.7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sweepfield.llm.common import known_labels, labelled, slices, text_of, written

FEATURES = [
    "log_words", "word_bytes", "upper", "digit", "space", "newline", "full_stop", "comma", "bar", "other_marks",
    "high_bytes", "distinct", "repeats", "top_word", "long_words", "distinct_lines",
]
# Bounds of the training sample: labelled texts per class, and pairs.
SAMPLE_PER_CLASS, PAIRS = 5_000, 40_000
PASS_SCORE, STEPS, RIDGE = 0.7, 60, 1e-3
RANKS = 100_000  # the threshold's rank is right to one part in so many
_UPPER, _DIGIT, _SPACE, _LINE, _STOP, _COMMA, _BAR, _MARK, _HIGH, _LOWER = range(10)


def _classes() -> np.ndarray:
    table = np.full(256, _MARK, np.uint8)
    for b in range(256):
        c = chr(b)
        if b > 127:
            table[b] = _HIGH
        elif c.isupper():
            table[b] = _UPPER
        elif c.islower():
            table[b] = _LOWER
        elif c.isdigit():
            table[b] = _DIGIT
        elif c == "\n":
            table[b] = _LINE
        elif c.isspace():
            table[b] = _SPACE
        elif c in ".!?":
            table[b] = _STOP
        elif c in ",;:":
            table[b] = _COMMA
        elif c == "|":
            table[b] = _BAR
    return table


CLASSES = _classes()


def _distinct_share(lists: pa.Array, n: int):
    """Items per text, share of distinct ones, share equal to the item before, share of the commonest."""
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    flat, parents = flat.filter(real), parents.filter(real).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.bincount(parents, minlength=n)
    some = np.maximum(counts, 1)
    keys, times = np.unique(parents * max(len(coded.dictionary), 1) + codes, return_counts=True)
    owner = keys // max(len(coded.dictionary), 1)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    again = np.bincount(parents[1:][(codes[1:] == codes[:-1]) & (parents[1:] == parents[:-1])], minlength=n)
    sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    return counts, np.bincount(owner, minlength=n) / some, again / some, top / some, np.bincount(parents, sizes, minlength=n) / some, np.bincount(parents, sizes > 20, minlength=n) / some


def features(texts: pa.Array) -> np.ndarray:
    """One row per text; an empty or null text gives zeros."""
    n = len(texts)
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64, n + 1, whole.offset * 8)
    data = CLASSES[np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]]
    sizes = np.diff(offsets)
    some = np.maximum(sizes, 1)
    shares = []
    for kind in range(_LOWER):
        running = np.append(0, np.cumsum(data == kind))
        shares.append((running[offsets[1:] - offsets[0]] - running[offsets[:-1] - offsets[0]]) / some)
    counts, distinct, repeats, top, mean, long_words = _distinct_share(pc.utf8_split_whitespace(whole), n)
    _, lines, *_ = _distinct_share(pc.split_pattern(whole, "\n"), n)
    return np.column_stack([
        np.log1p(counts), mean / 10, *[shares[k] for k in (_UPPER, _DIGIT, _SPACE, _LINE, _STOP, _COMMA, _BAR, _MARK, _HIGH)],
        distinct, repeats, top, long_words, lines])


@dataclass(frozen=True)
class Ranking:
    """Weights over the expanded features, and the map from raw score to 0..1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + np.log(PASS_SCORE / (1 - PASS_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, with their squares and hinges, so that a feature may have a best range."""
    z = np.clip(z, -6, 6)
    return np.hstack([z, z * z / 6, np.maximum(z - 1, 0), np.maximum(-1 - z, 0)])


def fit(x: np.ndarray, labels: np.ndarray, seed: int = 11) -> Ranking:
    """Weights from preference pairs (a good text over a bad one) by Newton steps on the logistic loss.

    With one class only there is no pair: all texts then score alike, above
    the threshold when that class is good.
    """
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    z = expand((x - mean) / scale) if len(x) else np.zeros((0, 4 * len(FEATURES)))
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(4 * len(FEATURES)), 0.0 if len(good) or not len(bad) else 1.0, 1.0)
    rng = np.random.default_rng(seed)
    size = min(PAIRS, len(good) * len(bad))
    # Every text takes part: both sides are cycled through in random order.
    turn = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-size // len(rows)))])[:size]
    pairs = z[turn(good)] - z[turn(bad)]
    w, eye = np.zeros(z.shape[1]), np.eye(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(pairs @ w, -30, 30)))
        gradient = pairs.T @ (p - 1) / size + RIDGE * w
        bend = (pairs * (p * (1 - p))[:, None]).T @ pairs / size + RIDGE * eye
        move = np.linalg.solve(bend, gradient)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    raw = z @ w
    return Ranking(mean, scale, w, _quantile_cut(raw, labels), 4.0 / (raw.std() + 1e-6))


def _quantile_cut(raw: np.ndarray, labels: np.ndarray) -> float:
    """Score quantile at the share of bad texts, both classes weighed as sampled; of equal scores the middle."""
    order = np.sort(raw)
    k = int(round((labels == 0).mean() * len(raw)))
    k = min(max(k, 1), len(raw) - 1)
    return float((order[k - 1] + order[k]) / 2)


def labelled_features(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS):
    """Features and labels of at most ``per_class`` texts of each class, those with the smallest hash of their id.

    ``labels(doc_id, label)``. Whole texts are used; their features alone reach the driver.
    """
    known = known_labels(labels)
    picked = None
    for y in (0, 1):
        some = known.filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select("doc_id", text_of("text").alias("_t")).join(F.broadcast(picked), "doc_id").select("doc_id", "_y", "_t")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            x = features(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "_y", "x"])

    found = rows.mapInArrow(measure, "doc_id long, _y int, x array<double>").orderBy("doc_id", "x").limit(4 * per_class).collect()
    x = np.array([r["x"] for r in found]) if found else np.zeros((0, len(FEATURES)))
    return x, np.array([r["_y"] for r in found])


def fit_labelled(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Ranking:
    """Weights from the bounded sample; threshold and slope from the scores of all labelled texts.

    The threshold lies between the score at the share of bad texts among all
    labelled ones and the next higher score, so it means the same at every size.
    """
    model = fit(*labelled_features(docs, labels, per_class))
    if not model.weights.any():  # one class only: all texts score alike
        return model
    raw = written(labelled(docs, known_labels(labels), lambda d: _map_scores(d, model.raw, "doc_id", "text")).select("_y", "score"), "ranks")
    counts = raw.agg(F.count("*").alias("n"), F.sum(1 - F.col("_y")).alias("bad"), F.stddev_pop("score").alias("spread")).first()
    at = raw.agg(F.percentile_approx("score", counts["bad"] / counts["n"], RANKS).alias("q")).first()["q"]
    above = raw.filter(F.col("score") > at).agg(F.min("score").alias("next")).first()["next"]
    return replace(model, threshold=at if above is None else (at + above) / 2, slope=4.0 / (counts["spread"] + 1e-6))


def score_quality(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)``, one row per input row; null and empty texts score by their zero features."""
    return _map_scores(docs, model.score, id_col, text_col)


def _map_scores(docs: DataFrame, measure: Callable[[np.ndarray], np.ndarray], id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_t"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(measure(features(batch.column(1))), pa.float64())], names=[id_col, "score"])

    return rows.mapInArrow(score, StructType([rows.schema.fields[0], StructField("score", DoubleType())]))
