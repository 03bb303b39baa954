"""Exact dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
import tempfile

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sweepfield.llm import exact_dedup, jaccard_join
from sweepfield.llm.exact_dedup import QuotientFilter


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**56 - 1) | st.integers(0, 6), max_size=40), min_size=1, max_size=4))
def test_filters_merge_without_loss(parts):
    filters = []
    for part in parts:
        values, counts = np.unique(np.array(part, np.uint64), return_counts=True)
        filters.append(QuotientFilter.from_bytes(QuotientFilter.build(values, counts, 56).to_bytes()))
    values, counts = QuotientFilter.merge(filters, 56).items()
    want, times = np.unique(np.array(sum(parts, []), np.uint64), return_counts=True)
    assert values.tolist() == want.tolist() and counts.tolist() == times.tolist()


def test_exact_dedup(spark):
    texts = ["a b", "a  b", "a\tb", " a b", "", None, " ", "\n", "é", "x" * 30_000, "x" * 30_000, "a b"]
    rows = [(10 - i, t, "c") for i, t in enumerate(texts)] + [(10, "a b", "c"), (None, "é", "c"), (None, "only null", "c"), (None, "only null", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(3)
    got = exact_dedup.exact_dedup(df).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        own = [r for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        low = min((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids) and {r.keep_id for r in own} == {low} and {r.group_size for r in own} == {len(ids)}
        assert [r.doc_id for r in own if r.kept] == [low]
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0


def brute_components(rows):
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append({tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return {doc: (len(sets[i]), low[find(i)]) for i, (doc, _) in enumerate(rows)}


def made_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    pick = lambda n, v=vocabulary: [rng.choice(v) for _ in range(n)]
    base, passage, texts = pick(60), pick(50), []
    for _ in range(70):  # near copies of one text: its signatures are hot
        words = base[:]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [" ".join(pick(rng.randint(2, 40)) + passage + pick(rng.randint(2, 10))) for _ in range(60)]  # a common passage
    for _ in range(120):  # short ones, where empty partitions matter
        words = pick(rng.choice([0, 1, 3, 4, 5, 6, 8, 9, 10, 12, 14, 20]), vocabulary[:6])
        texts.append(" ".join(words))
        texts.append(" ".join(words + pick(1) if rng.random() < 0.5 else words[1:]))
    return [None, "", " \n", "One Two", "one two", "one  TWO"] + texts + texts[:20]


def test_components_equal_brute_force(spark):
    rows = list(enumerate(made_texts(3)))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node long").repartition(4)
    found = jaccard_join.near_duplicates(df)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(rows)
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_signatures_miss_no_linked_pair():
    rng = random.Random(8)
    for size in (1, 4, 5, 9, 10, 30, 31, 100, 300):
        for _ in range(30):
            x = {rng.getrandbits(60) for _ in range(size)}
            y = set(list(x)[:max(1, size - rng.randint(0, size // 8))]) | {rng.getrandbits(60) for _ in range(rng.randint(0, max(1, size // 8)))}
            shared = len(x & y)
            if 100 * shared < 80 * len(x | y):
                continue
            hashes = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in (x, y)])
            row, key, margin = jaccard_join.signatures(hashes, np.array([len(x), len(y)]))
            both = set(key[row == 0].tolist()) & set(key[row == 1].tolist())
            assert both
            if (margin >= 0).any():  # and it is a filled one
                assert len(both) >= 1


def test_one_of_each_component_stays(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(5, words + " x"), (3, words), (None, words + " y"), (8, "other text"), (9, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_join.drop_near_copies(df).collect()) == [3, 7, 8, 9]


def test_common_passages_make_no_pairs(spark, monkeypatch):
    passage = " ".join(f"w{k}" for k in range(300))
    rows = [(i, " ".join(f"own{i}x{k}" for k in range(75)) + " " + passage) for i in range(40)]
    near = [" ".join(f"near{k}" for k in range(75)) + " " + passage + f" end{i}" for i in range(2)]
    rows += [(40 + i, text) for i, text in enumerate(near)]
    seen, possible, own_rows = [], jaccard_join._possible, []
    monkeypatch.setattr(jaccard_join, "_possible", lambda pairs, *a: seen.append(pairs.count()) or possible(pairs, *a))
    compare = jaccard_join.batches_of
    monkeypatch.setattr(jaccard_join, "batches_of", lambda spark, n: own_rows.append(n) or compare(spark, n))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == {i: min(i, 40) for i, _ in rows}
    assert len(seen) == jaccard_join.ROUNDS + 2 and seen[-1] == 0, seen
    assert own_rows == [jaccard_join.PAIR_BATCH] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_files_that_pack_well_are_not_broadcast(spark, monkeypatch):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    plans, link = [], jaccard_join._link_nodes
    folder = tempfile.mkdtemp(dir="/tmp") + "/packed"
    spark.range(2_000_000).selectExpr("id DIV 20 AS k", "id DIV 20 AS v").write.parquet(folder)  # 32 MB of rows in a file of a few
    plan = lambda: spark.range(3_000_000).join(spark.read.parquet(folder), F.col("id") == F.col("k"))._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(jaccard_join, "_link_nodes", lambda *a: plans.append(plan()) or link(*a))
    try:
        for n in names:
            spark.conf.set(n, "10MB")
        assert "BroadcastHashJoin" in plan()
        df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h")], "doc_id long, text string")
        assert jaccard_join.near_duplicates(df).count() == 2
        assert len(plans) == 1 and "BroadcastHashJoin" not in plans[0]
        assert [spark.conf.get(n) for n in names] == ["10MB", "10MB"]
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_rarest_pairs_lose_no_similar_pair(spark):
    rng = random.Random(5)
    common = [rng.getrandbits(60) for _ in range(60)]
    sets = []
    for _ in range(60):
        base = common[:rng.choice([0, 20, 40, 60])] + [rng.getrandbits(60) for _ in range(rng.choice([1, 4, 12]))]
        for _ in range(rng.choice([1, 2, 3])):
            sets.append({h for h in base if rng.random() > 0.06} | {rng.getrandbits(60) for _ in range(rng.choice([0, 1, 2]))})
    sets = [s for s in sets if s]
    label = [i % 9 for i in range(len(sets))]
    rows = [(i, len(s), label[i], bytearray(np.array(sorted(s), "<u8").tobytes())) for i, s in enumerate(sets)]
    for similarity in (80, 60):
        pairs = jaccard_join.rarest_pairs(spark.createDataFrame(rows, "node long, size long, label long, hashes binary"), similarity).collect()
        got = {(min(p), max(p)) for p in pairs}
        want = {(i, j) for j in range(len(sets)) for i in range(j)
                if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}
        assert len(got) == len(pairs) and want <= got and len(want) > 20 and all(label[i] != label[j] for i, j in got)
