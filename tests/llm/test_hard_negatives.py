"""Hard negatives against a loop over all pairs, and the intervals of the codes."""

import math
import random

import numpy as np
import pytest

from sweepfield.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, id string, values string, block int"


def loop(rows, anchor, positives=5, negatives=10):
    sound = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        sound.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    out = []
    for vec_id, label, vector in sound:
        if not anchor(vec_id):
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, k) for i, k, v in sound if i != vec_id)
        for minus, i, _ in [x for x in scored if x[2] == label][:positives]:
            near = [x for x in scored if x[2] != label and 30 * -minus <= 100 * -x[0] <= 90 * -minus][:negatives]
            out += [(vec_id, i, rank, j, -minus, -m) for rank, (m, j, _) in enumerate(near, 1)]
    return sorted(out)


def rows_of(count, dims, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[i % 4]], rng.randint(0, 2)) for i in range(count)]


@pytest.mark.parametrize("size", [2048, 7])
def test_equals_the_loop(spark, size, monkeypatch):
    for name, value in (("ROWS", size), ("ANCHORS", min(size, 5)), ("HELD", 2 if size == 7 else 128), ("GROUP_BLOCKS", 1 if size == 7 else 64)):
        monkeypatch.setattr(hn, name, value)
    rows = rows_of(160, 12, 1)
    rows += [(None, [1.0] * 12, 1), (501, None, 1), (502, [1.0] * 12, None), (503, [math.nan] * 12, 1), (504, [math.inf] + [0.0] * 11, 1),
             (505, [None] * 12, 1), (506, [], 1), (507, [2.0] * 3, 1), (10, [3.0] * 12, 0), (10, [3.0] * 12, 0), (600, [0.0] * 12, 2)]
    rows += [(700 + i, rows[3][1], i % 2) for i in range(30)]  # ties
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    found = sorted(tuple(r) for r in hn.mine(df, lambda c: c % 10 == 0).collect())
    assert found == loop(rows, lambda i: i % 10 == 0) and len(found) > 500
    assert hn.mine(df.limit(0), lambda c: c % 10 == 0).count() == 0
    assert hn.mine(df, lambda c: c == 999).count() == 0


def test_intervals_hold_and_exclude():
    rng = np.random.default_rng(2)
    for dims in (1, 3, 64, 100):
        base = rng.integers(-300, 300, (40, dims))
        left = np.vstack([base, base[:5] * 3, np.zeros((1, dims), int)])
        turn = hn.rotation(dims)
        low, high = hn.Anchors(left.astype(float), turn).interval(*hn.code(left.astype(float), turn))
        exact = hn.scores(left, left)
        assert np.all(low <= exact) and np.all(exact <= high)
        # A vector parallel to its code has no rest, so nothing is left open but the planes' rounding.
        assert np.mean(high - low) < 2 * np.mean(np.outer(np.linalg.norm(left, axis=1), np.linalg.norm(left, axis=1)))


def test_large_integers():
    big = np.array([[2**31, -(2**30)], [3, 2**31 - 1]])
    assert hn.scores(big, big).tolist() == [[2**62 + 2**60, 3 * 2**31 - 2**30 * (2**31 - 1)], [3 * 2**31 - 2**30 * (2**31 - 1), 9 + (2**31 - 1) ** 2]]
