"""Quality and toxicity: held-out accuracy on made texts, gradients and edge cases."""

import random

import numpy as np
import pyarrow as pa

from sweepfield.llm import common, quality, toxicity


def made(n, seed, bad_rate=0.3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rude = ["vileword", "vilenoun", "nastyword"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        bad = int(rng.random() < bad_rate)
        if bad:
            for _ in range(1 + len(text) // 40):
                text[rng.randrange(len(text))] = rng.choice(rude)
        rows.append((i, " ".join(text) + ".", bad))
    return rows


def test_toxic_words_are_learned(spark):
    rows = made(500, 1)
    net, cut = toxicity.train([r[1] for r in rows[:350]], np.array([r[2] for r in rows[:350]]))
    df = spark.createDataFrame([(i, t, "s") for i, t, _ in rows[350:]] + [(-1, None, "s"), (-2, "", "s"), (-3, " \n", "s")], "doc_id long, text string, score string")
    scored = toxicity.score_toxicity(df, (net, cut)).collect()
    assert len(scored) == 153 and set(scored[0].asDict()) == {"doc_id", "text", "score"}
    truth = {i: b for i, _, b in rows}
    right = [truth[r.doc_id] == (r.score >= 0.5) for r in scored if r.doc_id >= 0]
    assert np.mean(right) >= 0.93
    assert all(r.score < 0.01 for r in scored if r.doc_id < 0)
    assert toxicity.score_toxicity(df.limit(0), (net, cut)).count() == 0


def test_the_last_words_of_a_long_text_count(spark):
    rows = made(500, 2)
    model = toxicity.train([r[1] for r in rows], np.array([r[2] for r in rows]))
    clean = " ".join(r[1] for r in rows if not r[2])[:60_000]
    df = spark.createDataFrame([(0, clean + " vileword vilenoun"), (1, clean[:3000])], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(df, model).collect()}
    assert score[0] >= 0.5


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    vectors = np.vstack([rng.normal(size=(6, 2 * toxicity.DIM)), np.zeros((1, 2 * toxicity.DIM))]).astype(np.float32)
    codes = rng.integers(0, 6, size=(3, toxicity.WINDOW))
    codes[1, 5:] = -1
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    vectors = vectors.astype(np.float64)
    weight = np.array([1.0, -2.0, 0.5])
    _, saved = net.forward(vectors, codes, keep=True)
    grad, _ = net.gradients(vectors, saved, weight)
    for name in ("xf", "hb", "cf", "attend", "query", "out"):
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in net.p[name].shape)
            kept, step = net.p[name][at], 1e-2
            net.p[name][at] = kept + step
            up = net.forward(vectors, codes) @ weight
            net.p[name][at] = kept - step
            down = net.forward(vectors, codes) @ weight
            net.p[name][at] = kept
            assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-2 * max(1, abs(grad[name][at])), name


def test_windows_cover_every_word():
    counts = np.array([0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 200])
    owner, start, size = toxicity.windows_of(counts)
    seen = np.zeros(counts.sum(), int)
    for s, n in zip(start, size):
        seen[s:s + n] += 1
    assert seen.min() >= 1 and size.max() <= toxicity.WINDOW and 0 not in owner


def test_one_class_or_nothing():
    for texts, labels in (([], []), (["a b"], [1]), (["a", "b"], [0, 0]), ([""], [1])):
        net, cut = toxicity.train(texts, np.array(labels))
        assert np.isfinite(cut)
    x = quality.features(pa.array(["a b", None, ""]))
    assert x.shape == (3, len(quality.FEATURES)) and np.isfinite(x).all()
    for labels in ([], [1, 1, 1], [0, 0, 0]):
        model = quality.fit(x[:len(labels)], np.array(labels))
        assert np.isfinite(model.score(x)).all()


def test_quality_ranks_held_out_texts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))]
        good = rng.random() < 0.7
        if not good:
            words = [rng.choice(words[:3]) for _ in words] if rng.random() < 0.5 else [w.upper() + "!!###" for w in words]
        rows.append((i, " ".join(words), int(good)))
    model = quality.fit(quality.features(pa.array([r[1] for r in rows[:250]])), np.array([r[2] for r in rows[:250]]))
    df = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows[250:]] + [(None, None, 0.5)], "doc_id long, text string, score double")
    got = quality.score_quality(df, model).collect()
    truth = {i: y for i, _, y in rows}
    right = [(r.score >= quality.PASS_SCORE) == truth[r.doc_id] for r in got if r.doc_id is not None]
    assert len(got) == 151 and np.mean(right) >= 0.93


def test_toxicity_cut_has_fewest_errors_over_all_labelled_texts(spark, monkeypatch):
    rows = made(400, 3, bad_rate=0.12)
    clean = " ".join(t for _, t, bad in rows if not bad)
    rows += [(1000 + i, clean[3_000 * i:3_000 * i + 12_000], 0) for i in range(8)] + [(2000, None, 0), (2001, "", 1)]
    rows += [(3000 + i, clean[9 * i:9 * i + 60] + " vileword", 0) for i in range(25)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9999, 1), (None, 1), (5, None)], "doc_id long, label int")
    for limit in (common.BROADCAST_ROWS, 10):  # labels broadcast, and labels shuffled
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        net, cut = toxicity.fit_labelled(docs, labels, per_class=30)
        raw = {r.doc_id: np.log(r.score / (1 - r.score)) for r in toxicity.score_toxicity(docs, (net, 0.0)).collect()}
        pairs = sorted((raw[i], y) for i, t, y in rows if t)
        wrong = lambda c, pairs=pairs: sum((s >= c) != y for s, y in pairs)
        edges = [pairs[0][0] - 1] + [(a[0] + b[0]) / 2 for a, b in zip(pairs, pairs[1:])] + [pairs[-1][0] + 1]
        assert wrong(cut) <= min(map(wrong, edges)) + 1  # equal but for scores that share a step
    assert toxicity.STRIDE <= toxicity.WINDOW // 2


def test_quality_threshold_keeps_the_labels_share_at_every_sample_size(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.15
        noise = 0.5 if bad else 0.3  # classes overlap
        rows.append((i, " ".join("A#1" if rng.random() < noise else "word" + rng.choice("abcdef") for _ in range(40)), int(not bad)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    bad = sum(1 - y for _, _, y in rows)
    for per_class in (40, 5_000):  # a capped sample has as many bad as good texts
        model = quality.fit_labelled(docs, labels, per_class)
        failed = quality.score_quality(docs, model).filter(f"score < {quality.PASS_SCORE}").count()
        assert abs(failed - bad) <= 3
