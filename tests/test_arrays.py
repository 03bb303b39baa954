"""Folds in blocks and what is built on them."""

import json
import random

from pyspark.sql import functions as F

from sweepfield.functions.arrays import BLOCK, fold_collect
from sweepfield.operators.text import reply_objects


def running_odd(items):
    """Running sums at odd items."""
    def step(state, item):
        after = state + item
        return after, F.when(item % 2 == 1, F.array(after)).otherwise(F.array().cast("array<bigint>"))

    return fold_collect(items, F.lit(0).cast("bigint"), step, "array<bigint>")


def test_fold_equals_a_loop(spark):
    rng = random.Random(3)
    sizes = [0, 1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 7]
    rows = [(i, [rng.randrange(100) for _ in range(n)]) for i, n in enumerate(sizes)] + [(99, None)]
    found = {r.i: r.out for r in spark.createDataFrame(rows, "i int, items array<bigint>").select("i", running_odd(F.col("items")).alias("out")).collect()}
    for i, items in rows:
        total, want = 0, []
        for v in items or []:
            total += v
            want += [total] if v % 2 else []
        assert found[i] == (want if items is not None else None)


def test_many_objects_in_one_reply(spark):
    made = [{"k": i, "s": 'a } " \\ {', "in": {"x": [i]}} for i in range(20_000)]
    text = "é start " + " é ".join(json.dumps(m, ensure_ascii=False) for m in made) + " end {"
    got = reply_objects(spark.createDataFrame([(1, text)], "id long, reply string")).orderBy("position").collect()
    assert [json.loads(r.object) for r in got] == made and [r.position for r in got] == list(range(len(made)))
