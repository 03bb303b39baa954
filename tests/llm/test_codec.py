"""Encoding against the library, and exact round trips under dropout."""

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sweepfield.llm import sentencepiece_codec as codec
from sweepfield.llm.catalog import MODEL_FILE
from sweepfield.llm.common import slices

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL_FILE), reason="tokenizer files not present")
_rng = random.Random(6)
TEXTS = [
    None, "", " ", "  ", "\n", "\n\n x", "  a\tb\n c ", "Été ﬁ ①", "▁x ▁▁", "日本語 " * 30, "x" * 300, "ab" * 200 + " q", "\u0000 é" * 3,
    "The quick brown fox jumps over the lazy dog. " * 5, "".join(_rng.choice("abcde fg\n  ▁é①") for _ in range(2000)),
]


@pytest.fixture(scope="module")
def vocabulary():
    return codec.Vocabulary.load(MODEL_FILE)


def lists(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_without_dropout_equals_the_library(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    texts = [t or "" for t in TEXTS if not t or "▁" not in t]
    assert lists(*codec.encode_texts(vocabulary, pa.array(texts), np.arange(len(texts)), dropout=0)) == [model.encode(t) for t in texts]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_every_segmentation_decodes_to_the_text(vocabulary, dropout):
    ids, counts = codec.encode_texts(vocabulary, pa.array(TEXTS), np.arange(len(TEXTS)), dropout=dropout)
    assert codec.decode_ids(vocabulary, ids, counts).to_pylist() == [t or "" for t in TEXTS]


def test_side_by_side_equals_the_heap(vocabulary, monkeypatch):
    words = pa.array([" " + "".join(_rng.choice("etaoinshr") for _ in range(_rng.randint(1, 14))) for _ in range(400)], pa.large_string())
    draws = np.arange(400) % 16
    a = codec._encode_words(vocabulary, words, draws, 3, 0.3)
    monkeypatch.setattr(codec, "WIDTHS", (1,))
    b = codec._encode_words(vocabulary, words, draws, 3, 0.3)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_seed_and_draw_vary_the_result(vocabulary):
    text = pa.array(["The quick brown fox jumps over the lazy dog again and again"] * 8)
    one = lists(*codec.encode_texts(vocabulary, text, np.arange(8), dropout=0.3))
    assert len({tuple(x) for x in one}) > 3
    assert one == lists(*codec.encode_texts(vocabulary, text, np.arange(8), dropout=0.3))
    assert one != lists(*codec.encode_texts(vocabulary, text, np.arange(8), seed=1, dropout=0.3))


def test_a_task_holds_little_of_a_large_batch(vocabulary):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(800)) for _ in range(800)]  # 4 MB
    batch = pa.record_batch([pa.array(texts)], names=["t"])
    tracemalloc.start()
    for part in slices(batch, 0, codec.SLICE_BYTES):
        ids, counts = codec.encode_texts(vocabulary, part.column(0), np.arange(part.num_rows))
        assert codec.decode_ids(vocabulary, ids, counts).cast(pa.string()).equals(part.column(0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6, peak


def test_blocks_of_words_do_not_change_ids(vocabulary, monkeypatch):
    rng = random.Random(5)
    texts = pa.array([" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 40))) for _ in range(60)) for _ in range(20)])
    whole = codec.encode_texts(vocabulary, texts, np.arange(20))
    sizes = []
    block = codec._encode_block
    monkeypatch.setattr(codec, "BLOCK_SYMBOLS", 256)
    monkeypatch.setattr(codec, "_encode_block", lambda v, symbols, *rest: sizes.append(symbols.size) or block(v, symbols, *rest))
    parts = codec.encode_texts(vocabulary, texts, np.arange(20))
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert len(sizes) > 20 and max(sizes) <= 256


def test_frame_round_trip(spark, vocabulary):
    rows = [(i if i else None, t, "x") for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = codec.encode(df, vocabulary).cache()
    assert made.count() == len(rows) and made.filter("NOT lossless").isEmpty()
    back = sorted((r.doc_id or 0, r.text) for r in codec.decode(made, vocabulary).collect())
    assert back == sorted((i or 0, t or "") for i, t, _ in rows)
    assert codec.encode(df.limit(0), vocabulary).count() == 0
