"""Spaced seeds against planted passages, changed words included."""

import random

from sweepfield.llm import decontaminate


def words(rng, n, size=400):
    return [f"v{rng.randrange(size)}" for _ in range(n)]


def test_planted_passages_are_found_and_clean_texts_kept(spark):
    rng = random.Random(4)
    items = [words(rng, n) for n in (14, 20, 40, 60, 5, 0)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(6, None), (0, " ".join(items[0]))]
    docs, planted = [(0, None), (1, ""), (2, "short")], {}
    for i in range(3, 60):
        body = words(rng, rng.randint(10, 300))
        if i % 3 == 0:
            k = rng.randrange(4)
            copy = items[k][:]
            for _ in range(rng.randint(0, len(copy) // 10)):
                copy[rng.randrange(len(copy))] = "changed"
            at = rng.randrange(len(body))
            body = body[:at] + copy + body[at:]
            planted[i] = (k, at, copy)
        docs.append((i, ", ".join(body).upper() if i % 2 else " ".join(body)))
    docs += [docs[3], (None, docs[3][1])]
    df = spark.createDataFrame([(i, t, "z", 0) for i, t in docs], "doc_id long, text string, item_id string, _w int").repartition(3)
    bench_df = spark.createDataFrame(bench, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_overlaps(df.drop("item_id"), bench_df).collect()}
    for i, (k, at, copy) in planted.items():
        row = found[(i, k)]
        assert row.first_word >= at - 1 and row.matched >= sum(a == b for a, b in zip(copy, items[k])) - 2
    assert {d for d, _ in found} == set(planted) | {None}
    kept = decontaminate.decontaminate(df, bench_df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(60)) - set(planted)
    assert decontaminate.decontaminate(df, bench_df.limit(0)).count() == df.count()
    assert decontaminate.find_overlaps(df.limit(0), bench_df).count() == 0


def test_parts_thin_copies_and_short_items_are_found(spark):
    rng = random.Random(9)
    items = {0: words(rng, 60, 10**6), 1: words(rng, 40, 10**6), 2: words(rng, 15, 10**6), 3: words(rng, 10, 10**6), 4: ["ab", "cd", "ef", "gh", "ij"], 5: ["lone"], 6: ["two", "words"]}
    change = lambda w, at: ["changed" if i in at else x for i, x in enumerate(w)]
    copies = {
        0: (0, change(items[0], range(20, 40)), 20),  # two whole ends, the middle replaced
        1: (1, change(items[1], range(4, 40, 5)), 32),  # every fifth word
        2: (2, change(items[2], (3, 7, 11)), 12), 3: (3, change(items[3], (3, 6)), 8),  # no four words in a row
        4: (4, items[4], 5), 5: (5, items[5], 1), 6: (6, items[6], 2),
    }
    body = words(rng, 50, 10**6)
    docs = [(i, " ".join(body[:25] + copy + body[25:])) for i, (_, copy, _) in copies.items()]
    docs += [(100, "ab cd ef gh xx"), (101, "two other words"), (102, " ".join(change(items[0], range(0, 60, 3))))]
    found = decontaminate.find_overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    got = {r.doc_id: (r.item_id, r.first_word, r.matched) for r in found.collect()}
    assert got == {i: (k, 25, matched) for i, (k, _, matched) in copies.items()}


def test_best_stretch_equals_loops(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [([int(rng.random() < rng.choice((0.6, 0.8, 0.9))) for _ in range(rng.randint(0, 45))],) for _ in range(200)]
    found = spark.createDataFrame(rows, "a array<int>").select("a", decontaminate.best_stretch(F.col("a"), F.lit(12), 0.8).alias("b")).collect()
    for r in found:
        sums = [(sum(r.a[i:j]), j - i) for i in range(len(r.a)) for j in range(i + 12, len(r.a) + 1)]
        want = max((m for m, n in sums if 5 * m >= 4 * n), default=None)
        assert (r.b and r.b.matched) == want
