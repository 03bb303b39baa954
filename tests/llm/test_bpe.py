"""Trie encoding against the tokenizer library, and against plain merging of pairs."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from sweepfield.llm import bpe_trie
from sweepfield.llm.catalog import WORD_FILE

pytestmark = pytest.mark.skipif(not os.path.exists(WORD_FILE), reason="tokenizer files not present")
_rng = random.Random(11)
SIGNS = "abcdefghij'''strevmld 123 .!-éßİΣς ǅ́̈한글ﬁ日‍각<|>\t\n"
TEXTS = [
    None, "", " ", "'s", "''s", "'S a'sb 'll'll x'", "<|startoftext|>a<|endoftext|>", "<|startoftext|>́a <|STARTOFTEXT|>",
    "a<|endoftext|><|endoftext|>'s", "İİ", "x" * 3000, "ab" * 800, "́", "á'́s", "\x00\x1c\x85 a", "㎏ ½ ² Ⅷ", "🙂🙂👍🏽", "the lower lowest lowermost",
] + ["".join(_rng.choice(SIGNS) for _ in range(_rng.randint(1, 300))) for _ in range(300)]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe_trie.BpeVocabulary.load(WORD_FILE)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(WORD_FILE)
    made.no_truncation()
    made.no_padding()
    return made


def lists(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("limit", [bpe_trie.TRIE_NODES, 50])
def test_equals_the_library(vocabulary, library, limit, monkeypatch):
    monkeypatch.setattr(bpe_trie, "INSERTED", 20 if limit == 50 else bpe_trie.INSERTED)  # the small trie is emptied again and again
    ids, counts = bpe_trie.encode_texts(bpe_trie.Trie(vocabulary, limit), pa.array(TEXTS))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert lists(ids, counts) == want
    assert bpe_trie.decode_ids(vocabulary, ids, counts).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]


def merged(vocabulary, word):
    """Plain merging: the lowest rank first, leftmost among equals."""
    tokens = [vocabulary.ids[c] for c in word]
    made = {pair: i for i, pair in enumerate(vocabulary.halves) if pair != (-1, -1)}
    while True:
        ranked = [(vocabulary.pairs.get(a << 20 | b, 1 << 60), k) for k, (a, b) in enumerate(zip(tokens, tokens[1:]))]
        if not ranked or min(ranked)[0] == 1 << 60:
            return tokens
        k = min(ranked)[1]
        tokens[k:k + 2] = [made[tokens[k], tokens[k + 1]]]


def test_every_path_equals_plain_merging(vocabulary):
    words = ["".join(_rng.choice("etaoinshrdl") for _ in range(_rng.randint(1, 30))).encode() for _ in range(300)] + [b"a" * n for n in range(1, 40)]
    trie = bpe_trie.Trie(vocabulary)
    found = trie.encode(words)
    for word, tokens in zip(words, found):
        signs = word.decode()[:-1] + chr(word[-1] + bpe_trie.END)
        assert tokens == merged(vocabulary, signs) == trie.path_tokens(signs)
    # Shared beginnings are one path.
    assert len(trie.children) < sum(len(w) for w in words)


def test_frames(spark, vocabulary, library):
    rows = [(i if i else None, t, "x", "y") for i, t in enumerate(TEXTS)] + [(1, TEXTS[4], "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    made = bpe_trie.decode(bpe_trie.encode(df, vocabulary), vocabulary)
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in made.collect()) == sorted(
        (i or 0, len(w), library.decode(w, skip_special_tokens=False)) for i, t, *_ in rows for w in [library.encode(t or "", add_special_tokens=False).ids])
    digests = {r.doc_id: r for r in bpe_trie.digest(made).collect()}
    ids = library.encode(TEXTS[5], add_special_tokens=False).ids
    assert digests[5].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert digests[5].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_trie.encode(df.limit(0), vocabulary).count() == 0
    lists = spark.createDataFrame([(1, None), (2, [0, None, 49406])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe_trie.decode(lists, vocabulary).orderBy("doc_id").collect()] == ["", "! <|startoftext|>"]
