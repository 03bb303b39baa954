"""Toxicity: a bidirectional gated recurrent network over words and their characters.

Each word enters as its learned vector, zero for words that training hardly
saw, beside the pooled vectors of its character trigrams. A recurrent layer runs in both directions
over windows of words, attention pools each window, and the text scores as
its worst window. Windows overlap, so no phrase is only seen cut in two, and
they cover every text to its end. Training is plain numpy on a bounded sample
of labelled texts; scoring is numpy over Arrow batches, many windows at once.
The cut between toxic and clean comes from the scores of all labelled texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sweepfield.llm.common import known_labels, labelled, slices, text_of

GRAM_BITS, DIM, HIDDEN = 14, 8, 8
MIN_TEXTS = 3  # a word has a vector of its own from this many training texts
WINDOW, STRIDE = 32, 16
# Bounds of the training sample: labelled texts per class, and their length.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 2_000, 8_000
EPOCHS, BATCH, RATE, DECAY, SEED = 10, 128, 0.02, 0.1, 7
MIN_VISITS = 80_000  # windows seen in training at least: few texts are gone through more often
BLOCK = 4_096  # windows scored at once
SLICE_BYTES = 1_000_000  # text scored at once; its words and their vectors take some hundred times as much
CUT_STEPS = 1_000  # scores counted together when the cut is set, per unit of the logit
# Byte map: ASCII letters and digits and all other bytes as they are, the rest of ASCII as a space.
PLAIN = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def tokenize(texts: pa.Array):
    """Distinct words of a batch with their hashes, and the batch as codes.

    Returns word hashes, trigram buckets with their word starts, codes of all
    words in order, and the words per text.
    """
    lower = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    # Punctuation counts as white space; bytes of letters outside ASCII stay.
    offsets = np.frombuffer(lower.buffers()[1], np.int64, len(lower) + 1, lower.offset * 8)
    plain = PLAIN[np.frombuffer(lower.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]]
    lower = pa.LargeStringArray.from_buffers(len(lower), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(plain))
    lists = pc.utf8_split_whitespace(lower)
    # A text of white space alone, or with some at its ends, yields empty words.
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    flat, parents = flat.filter(real), parents.filter(real)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    counts = np.bincount(parents.to_numpy(zero_copy_only=False), minlength=len(texts))
    words = coded.dictionary
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), codes, counts
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[:int(sizes.sum())] if words.offset == 0 else np.frombuffer(
        b"".join(w.encode() for w in words.to_pylist()), np.uint8)
    # Every word framed by a border byte on both sides, so it has as many trigrams as bytes.
    ends = np.cumsum(sizes + 2)
    starts = ends - sizes - 2
    framed = np.ones(int(ends[-1]), np.uint64)
    inner = np.ones(len(framed), bool)
    inner[starts] = False
    inner[ends - 1] = False
    framed[inner] = data
    middle = np.flatnonzero(inner)
    grams = (framed[middle - 1] << np.uint64(16)) | (framed[middle] << np.uint64(8)) | framed[middle + 1]
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(middle), dtype=np.uint64) - np.repeat(first, sizes).astype(np.uint64)
    whole = np.add.reduceat(_mix(grams + (place << np.uint64(24))), first)
    return (
        _mix(whole),
        (_mix(grams) >> np.uint64(64 - GRAM_BITS)).astype(np.int64), first, codes, counts)


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first word and length of every window over texts of these word counts.

    A text of n words has windows from 0, STRIDE, 2 STRIDE ... until one
    reaches its end; an empty text has none.
    """
    each = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1, 0)
    owner = np.repeat(np.arange(len(counts)), each)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    offset = np.cumsum(counts) - counts
    start = rank * STRIDE
    return owner, offset[owner] + start, np.minimum(counts[owner] - start, WINDOW)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights, forward pass and gradients."""

    def __init__(self, seed: int = SEED, vocabulary: np.ndarray = np.zeros(0, np.uint64)) -> None:
        self.vocabulary = vocabulary  # sorted word hashes; the last row of the word table is for all others
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "word": np.zeros((len(vocabulary) + 1, DIM), np.float32),
            "gram": (0.3 * rng.normal(size=(1 << GRAM_BITS, DIM))).astype(np.float32),
            "attend": draw(2 * HIDDEN, HIDDEN), "query": draw(HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32),
        }
        for side in ("f", "b"):
            self.p |= {f"x{side}": draw(2 * DIM, 3 * HIDDEN), f"h{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}

    def rows_of(self, words: np.ndarray) -> np.ndarray:
        """Row of each word hash in the word table."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, len(self.vocabulary))

    def inputs(self, words, grams, first) -> np.ndarray:
        """Input vectors of distinct words, and a last row of zeros for places past a window's end."""
        if not len(words):
            return np.zeros((1, 2 * DIM), np.float32)
        sizes = np.diff(np.append(first, len(grams)))[:, None]
        chars = np.add.reduceat(self.p["gram"][grams], first, axis=0) / np.sqrt(sizes).astype(np.float32)
        return np.vstack([np.hstack([self.p["word"][self.rows_of(words)], chars]), np.zeros((1, 2 * DIM), np.float32)])

    def _scan(self, gates, hidden, mask, order, keep):
        """States of one direction; ``gates(t)`` are the input parts of step t."""
        h, size = np.zeros((mask.shape[1], HIDDEN), np.float32), HIDDEN
        states, steps = np.zeros((*mask.shape, HIDDEN), np.float32), []
        for t in order:
            g, u = gates(t), h @ hidden
            zr = _sigmoid(g[:, :2 * size] + u[:, :2 * size])
            z, r = zr[:, :size], zr[:, size:]
            n = np.tanh(g[:, 2 * size:] + r * u[:, 2 * size:])
            on = mask[t][:, None]
            new = h + on * (1 - z) * (n - h)
            if keep:
                steps.append((t, h, z, r, n, u[:, 2 * size:]))
            h = states[t] = new
        return states, steps

    def forward(self, vectors, codes, keep=False):
        """Logits of windows; ``codes`` (windows, WINDOW), -1 past the end."""
        codes = np.ascontiguousarray(codes.T)
        mask = (codes >= 0).astype(np.float32)
        p, states, steps = self.p, [], []
        for side, order in (("f", range(len(codes))), ("b", range(len(codes) - 1, -1, -1))):
            table = vectors @ p[f"x{side}"] + p[f"c{side}"]
            s, k = self._scan(lambda t, table=table: table[codes[t]], p[f"h{side}"], mask, order, keep)
            states.append(s)
            steps.append(k)
        both = np.concatenate(states, axis=2)
        key = np.tanh(both @ p["attend"])
        weight = np.where(mask > 0, key @ p["query"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, both)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (codes, mask, steps, both, key, weight, pooled)) if keep else logit

    def gradients(self, vectors, saved, d_logit):
        """Gradients of all weights but the tables, and of the input vectors."""
        codes, mask, steps, both, key, weight, pooled = saved
        p, g, size = self.p, {}, HIDDEN
        g["out"], g["bias"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, both)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["query"] = np.einsum("tb,tbh->h", d_score, key)
        d_key = d_score[:, :, None] * p["query"] * (1 - key ** 2)
        g["attend"] = both.reshape(-1, 2 * size).T @ d_key.reshape(-1, size)
        d_both = weight[:, :, None] * d_pooled + d_key @ p["attend"].T
        d_vectors = np.zeros_like(vectors)
        for side, own, part in (("f", steps[0], slice(0, size)), ("b", steps[1], slice(size, None))):
            d_table = np.zeros((len(vectors), 3 * size), np.float32)
            d_hidden, d_h = np.zeros_like(p[f"h{side}"]), np.zeros((mask.shape[1], size), np.float32)
            for t, h, z, r, n, un in reversed(own):
                d_h = d_h + d_both[t][:, part]
                on = mask[t][:, None]
                d_n = d_h * on * (1 - z) * (1 - n ** 2)
                d_z = d_h * on * (h - n) * z * (1 - z)
                d_r = d_n * un * r * (1 - r)
                d_u = np.hstack([d_z, d_r, d_n * r])
                np.add.at(d_table, codes[t], np.hstack([d_z, d_r, d_n]))
                d_hidden += h.T @ d_u
                d_h = d_h * (1 - on * (1 - z)) + d_u @ p[f"h{side}"].T
            d_table[-1] = 0
            g[f"h{side}"], g[f"x{side}"], g[f"c{side}"] = d_hidden, vectors.T @ d_table, d_table.sum(axis=0)
            d_vectors += d_table @ p[f"x{side}"].T
        return g, d_vectors


def _codes_matrix(codes, start, size):
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    return np.where(inside, codes[np.minimum(at, len(codes) - 1)], -1)


def train(texts: list[str], labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> tuple[Network, float]:
    """Fit on labelled texts; returns the network and the logit at which a text counts as toxic.

    A toxic text teaches through its worst windows, a clean one through its
    worst and through random windows. With one class only, or no text, the
    network stays as drawn and no text is called toxic (or all are).
    """
    rng = np.random.default_rng(seed)
    net = Network(seed)
    labels = np.asarray(labels, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        return net, -1e3 if len(labels) and labels[0] > 0 else 1e3
    words, grams, first, codes, counts = tokenize(pa.array(texts, pa.string()))
    owner, start, size = windows_of(counts)
    if not len(owner):
        return net, 1e3
    seen = np.unique(np.repeat(np.arange(len(counts)), counts) * len(words) + codes) % len(words)
    net = Network(seed, np.unique(words[np.bincount(seen, minlength=len(words)) >= MIN_TEXTS]))
    buckets = net.rows_of(words)
    sizes = np.diff(np.append(first, len(grams)))
    spread = np.repeat(1.0 / np.sqrt(sizes), sizes).astype(np.float32)[:, None]
    word_of = np.repeat(np.arange(len(first)), sizes)
    target = labels[owner]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0

    def logits():
        vectors = net.inputs(words, grams, first)
        return np.concatenate([
            net.forward(vectors, _codes_matrix(codes, start[i:i + BLOCK], size[i:i + BLOCK])) for i in range(0, len(owner), BLOCK)])

    worst = np.full(len(labels), -np.inf)
    epochs = max(epochs, min(6 * epochs, MIN_VISITS // len(owner)))
    for epoch in range(epochs):
        scores = logits() if epoch else rng.random(len(owner))
        worst = np.full(len(labels), -np.inf)
        np.maximum.at(worst, owner, scores)
        top = scores >= worst[owner]
        if epoch == 0:
            chosen = rng.random(len(owner)) < np.minimum(1.0, 8.0 / np.bincount(owner, minlength=len(labels))[owner])
        else:
            chosen = top | ((target == 0) & ((scores > -2) | (rng.random(len(owner)) < 0.2)))
        picked = rng.permutation(np.flatnonzero(chosen))
        balance = max(1.0, min(4.0, (target[picked] == 0).sum() / max(1, (target[picked] > 0).sum()) / 2))
        for i in range(0, len(picked), BATCH):
            part, step = picked[i:i + BATCH], step + 1
            matrix = _codes_matrix(codes, start[part], size[part])
            used, local = np.unique(matrix[matrix >= 0], return_inverse=True)
            small = np.full(matrix.shape, -1)
            small[matrix >= 0] = local
            rows = np.flatnonzero(np.isin(word_of, used)) if len(used) < len(first) else np.arange(len(grams))
            slot = np.searchsorted(used, word_of[rows])
            chars = np.zeros((len(used), DIM), np.float32)
            np.add.at(chars, slot, net.p["gram"][grams[rows]] * spread[rows])
            keep = (rng.random((len(used), 1)) > 0.5).astype(np.float32)  # words drop out half the time: characters must suffice
            vectors = np.vstack([np.hstack([net.p["word"][buckets[used]] * keep, chars]), np.zeros((1, 2 * DIM), np.float32)])
            logit, saved = net.forward(vectors, small, keep=True)
            error = (_sigmoid(logit) - target[part]) * np.where(target[part] > 0, balance, 1.0)
            grad, d_vectors = net.gradients(vectors, saved, (error / len(part)).astype(np.float32))
            grad["word"], grad["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(grad["word"], buckets[used], d_vectors[:-1, :DIM] * keep)
            grad["word"][-1] = 0
            np.add.at(grad["gram"], grams[rows], d_vectors[slot, DIM:] * spread[rows])
            for k, v in grad.items():
                m, s = moments[k]
                m *= 0.9
                m += 0.1 * v
                s *= 0.99
                s += 0.01 * v * v
                rate = RATE / (1 + 3 * epoch / epochs)
                net.p[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)
                if k in ("word", "gram"):
                    net.p[k] *= 1 - DECAY * rate
    scores, worst = logits(), np.full(len(labels), -np.inf)
    np.maximum.at(worst, owner, scores)
    known = np.isfinite(worst)
    return net, _cut(worst[known], labels[known])


def _cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """Logit that splits the training texts with the fewest errors, midway between its neighbours."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    wrong = np.append(0, np.cumsum(y)) + np.append((1 - y).sum(), (1 - y).sum() - np.cumsum(1 - y))
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    low, high = s[k - 1] if k > 0 else s[0] - 2, s[k] if k < len(s) else s[-1] + 2
    return float((low + high) / 2)


def labelled_texts(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS):
    """At most ``per_class`` texts of each class by smallest hash of the id, as lists on the driver.

    ``labels(doc_id, label)``. Only texts of up to ``chars`` characters are
    used for training; scoring has no such bound.
    """
    known = known_labels(labels)
    texts = docs.select("doc_id", text_of("text").alias("_t")).filter(F.char_length("_t") <= chars)
    # Labels and hashes alone are ranked; the texts of the chosen few are fetched after.
    picked = None
    for y in (0, 1):
        some = known.filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    rows = texts.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "_t").limit(4 * per_class).collect()
    return [r["_t"] for r in rows], np.array([r["_y"] for r in rows], np.float32)


def fit_labelled(docs: DataFrame, labels: DataFrame, **sample) -> tuple[Network, float]:
    """Network fitted on the bounded sample, and the cut over all labelled texts.

    Every labelled text is scored whole, as in scoring, and the cut is the one
    with the fewest errors at the labels' own class rates, whatever the table's
    size. Scores meet in steps of 1 / ``CUT_STEPS`` before they reach the driver.
    """
    net, cut = train(*labelled_texts(docs, labels, **sample))
    if abs(cut) >= 1e3:  # one class only: nothing was fitted
        return net, cut
    scored = labelled(
        docs.select("doc_id", "text"), known_labels(labels), lambda d: _map_worst(d, net, lambda worst: worst, "text", ["doc_id"], "_s"))
    step = F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("_s"))) * CUT_STEPS)
    rows = scored.filter("_s > double('-Infinity')").groupBy(step.alias("step")).agg(
        F.min("_s").alias("low"), F.max("_s").alias("high"), F.sum("_y").alias("toxic"), F.sum(1 - F.col("_y")).alias("clean")).collect()
    rows.sort(key=lambda r: r["step"])
    toxic, clean = np.array([r["toxic"] for r in rows]), np.array([r["clean"] for r in rows])
    if not len(rows) or not toxic.sum() or not clean.sum():
        return net, cut
    wrong = np.append(0, np.cumsum(toxic)) + np.append(clean.sum() - np.append(0, np.cumsum(clean[:-1])), 0)
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    low = rows[k - 1]["high"] if k > 0 else rows[0]["low"] - 2
    high = rows[k]["low"] if k < len(rows) else rows[-1]["high"] + 2
    return net, float((low + high) / 2)


def score_toxicity(
    docs: DataFrame, model: tuple[Network, float], text_col: str = "text", keep: list[str] | None = None,
    score_col: str = "score",
) -> DataFrame:
    """``keep`` (by default all) input columns and ``score_col`` (0 to 1): the worst window of the whole text.

    One row per input row in any order. Null and empty texts score as the
    cleanest. The score replaces a column of its name in the output.
    """
    net, cut = model
    kept = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    return _map_worst(docs, net, lambda worst: _sigmoid(np.maximum(worst - cut, -30.0)), text_col, kept, score_col)


def _map_worst(
    docs: DataFrame, net: Network, finish: Callable[[np.ndarray], np.ndarray], text_col: str, kept: list[str], score_col: str,
) -> DataFrame:
    """``kept`` columns and ``finish`` of the largest logit of each text's windows, minus infinity without any."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, len(kept), SLICE_BYTES)):
            words, grams, first, codes, counts = tokenize(batch.column(len(kept)))
            owner, start, size = windows_of(counts)
            worst = np.full(batch.num_rows, -np.inf)
            vectors = net.inputs(words, grams, first)
            for i in range(0, len(owner), BLOCK):
                part = slice(i, i + BLOCK)
                np.maximum.at(worst, owner[part], net.forward(vectors, _codes_matrix(codes, start[part], size[part])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(finish(worst), pa.float64())], names=[*kept, score_col])

    rows = docs.select(*kept, text_of(text_col).alias("_scored"))
    return rows.mapInArrow(score, StructType([*rows.schema.fields[:-1], StructField(score_col, DoubleType())]))
