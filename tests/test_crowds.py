"""Boxes of small images, treated in one go, against the same boxes treated as a crowd."""

import random

import numpy as np
import pytest
from conftest import as_set

from sweepfield.operators import boxes

NAN, INF = float("nan"), float("inf")


def table(spark, odd=False):
    draw = random.Random(5)
    rows = []
    for image in range(6):
        for i in range(30):
            x, y = draw.randrange(60), draw.randrange(50)
            rows.append((image, i, float(x), float(y), float(x + 1 + draw.randrange(25)), float(y + 1 + draw.randrange(25)), draw.randrange(12) / 11))
    if odd:
        rows += [(1, 90, 3.0, 3.0, 30.0, 30.0, None), (2, 91, 3.0, 3.0, 30.0, 30.0, -1.0), (3, 92, 3.0, NAN, 30.0, 30.0, 0.9),
                 (None, 93, 3.0, 3.0, 30.0, 30.0, 0.5), (4, 94, 3.0, 3.0, 3.0, 3.0, 0.7)]
    return spark.createDataFrame(rows, "image_id long, box_id long, x0 double, y0 double, x1 double, y1 double, score double")


def turned(df):
    return df.selectExpr("image_id", "box_id", "score", "x0 - y0 AS x1", "x0 + y0 AS y1", "x1 - y0 AS x2", "x1 + y0 AS y2",
                         "x1 - y1 AS x3", "x1 + y1 AS y3", "x0 - y1 AS x4", "x0 + y1 AS y4")


def text_of(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(sorted(df.columns)).collect())


MADE = {
    "nms": lambda df: boxes.nms(df, 0.3), "gaussian": lambda df: boxes.soft_nms(df, floor=0.2),
    "linear": lambda df: boxes.soft_nms(df, "linear", floor=0.2), "hard": lambda df: boxes.soft_nms(df, "hard", floor=0.2),
}


@pytest.mark.parametrize("name, shape", [("nms", "odd"), ("gaussian", "odd"), ("linear", "boxes"), ("hard", "boxes"), ("nms", "quads"), ("gaussian", "quads")])
def test_small_images_equal_crowds(spark, monkeypatch, name, shape):
    df = turned(table(spark)) if shape == "quads" else table(spark, shape == "odd")
    found = text_of(MADE[name](df))
    monkeypatch.setattr(boxes, "CROWD", 0)
    assert found == text_of(MADE[name](df)) and found


def test_pairs_of_small_images_equal_crowds(spark, monkeypatch):
    df = table(spark)
    plain, quads = as_set(boxes.iou_pairs(df)), as_set(boxes.quad_iou_pairs(turned(df)))
    monkeypatch.setattr(boxes, "CROWD", 0)
    assert plain == as_set(boxes.iou_pairs(df)) and quads == as_set(boxes.quad_iou_pairs(turned(df)))


def test_small_images_need_no_rounds(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rounds over small images")

    monkeypatch.setattr(boxes, "_nms_rounds", refuse)
    monkeypatch.setattr(boxes, "_soft_rounds", refuse)
    assert boxes.nms(table(spark)).count() and boxes.soft_nms(turned(table(spark))).count()



def test_unmerged_neighbours_are_compared_at_once(monkeypatch):
    draw = np.random.default_rng(3)
    low = draw.integers(0, 40, (300, 2)).astype(float)
    high = low + draw.integers(20, 40, (300, 2))
    group = {"x0": low[:, 0], "y0": low[:, 1], "x1": high[:, 0], "y1": high[:, 1], "score": draw.random(300) + 0.1, "box_id": np.arange(300), "held": np.array([False])}
    calls, real = [], boxes._shared_area
    monkeypatch.setattr(boxes, "_shared_area", lambda p, q: calls.append(len(p)) or real(p, q))
    closed, last = boxes._merge_walk(group, boxes.SIDES, 0.3)
    merges = 300 - len(closed) - 1
    # One call for all neighbours, and one after each merge at most.
    assert 0 < merges and len(calls) <= merges + 1
