"""Byte-pair encoding and decoding by a trie over distinct words.

A text is normalised, cut into words and each word is encoded on its own. The
distinct words go into a trie, one symbol a level. A prefix's encoding ends in
exactly one token, and what stands before that token is the encoding of a
shorter prefix; so a node keeps its last token alone, and a depth-first walk
finds it from the nodes above. Words with a common beginning share all of that
work. A word's last byte is a symbol of its own kind, since pieces that end a
word are other pieces.

Which token a prefix ends in: the one that ends the prefix and fits behind the
last token of the rest, that is, no merge across the border would have come
before the merges that built the two sides.

The trie stays from batch to batch and is emptied at a fixed number of nodes;
very long words are walked as a single path with a few bytes per symbol.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from sweepfield.llm.common import slices, text_of

SLICE_BYTES = 3_000_000  # text encoded at once
TRIE_NODES, INSERTED = 400_000, 20_000  # the trie is emptied beyond this, looked at after so many words; some 200 bytes a node
PATH_SYMBOLS = 512  # longer words don't enter the trie
END = 256  # added to the byte that ends a word
SPACE, LETTER, DIGIT, OTHER, SPECIAL = range(5)
CODES = 0x110000
COMPOSING = 0x300  # texts below this code point are composed already

# What the words of this vocabulary are, and its word end mark.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
WORD_END = "</w>"


def byte_signs() -> dict[str, int]:
    """The printable sign of each byte in the vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def code_classes() -> np.ndarray:
    """Class of every code point, by the pattern engine that cuts the words."""
    from tokenizers import Regex, pre_tokenizers

    found = np.full(CODES + 2, OTHER, np.uint8)
    found[CODES:] = SPECIAL
    codes = np.delete(np.arange(CODES), np.arange(0xD800, 0xE000))
    text = codes.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}")):
        hits = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True).pre_tokenize_str(text)
        for _, (a, b) in hits:
            found[codes[a:b]] = kind
    return found


def lower_codes() -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Lower case of every code point, and of those that become several."""
    from tokenizers import normalizers

    lower = normalizers.Lowercase().normalize_str
    table, several = np.arange(CODES + 2, dtype=np.int32), {}
    for start in range(0, CODES, 256):
        if 0xD800 <= start < 0xE000:
            continue
        signs = [chr(c) for c in range(start, start + 256)]
        if lower("".join(signs)) == "".join(signs):
            continue
        for sign in signs:
            small = [ord(c) for c in lower(sign)]
            if len(small) == 1:
                table[ord(sign)] = small[0]
            else:
                several[ord(sign)] = np.array(small, np.int32)
    return table, several


@dataclass
class BpeVocabulary:
    """What encoding and decoding need, all of it of the vocabulary's own size."""

    tokens: list[str]  # what an id decodes to
    ids: dict[str, int] = field(repr=False)  # symbols of a token, word ends 256 higher, to its id
    pairs: dict[int, int] = field(repr=False)  # left << 20 | right to the rank of their merge
    halves: list[tuple[int, int]] = field(repr=False)  # the two tokens an id was merged from
    ranks: list[int] = field(repr=False)  # rank of the merge that makes an id; -1 for single symbols
    ends: dict[str, tuple[int, ...]] = field(repr=False)  # lengths of the tokens that can end in these one to three symbols, longest first
    classes: np.ndarray = field(repr=False)
    lower: np.ndarray = field(repr=False)
    several: dict[int, np.ndarray] = field(repr=False)
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> BpeVocabulary:
        """From a tokenizer file with byte signs, word ends and no decoder."""
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, signs = whole["model"], byte_signs()
        words = whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if words != WORD_PATTERN or model["end_of_word_suffix"] != WORD_END or whole["decoder"] is not None:
            raise ValueError("not a vocabulary of this kind of words")
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        return cls.build(model["vocab"], [tuple(m) for m in model["merges"]], special, signs, code_classes(), *lower_codes())

    @classmethod
    def build(cls, vocab, merges, special, signs, classes, lower, several) -> BpeVocabulary:
        size = max([*vocab.values(), *special.values()]) + 1
        tokens = [""] * size
        for name, i in [*vocab.items(), *special.items()]:
            tokens[i] = name

        def symbols(name: str) -> str:
            ends = name.endswith(WORD_END)
            raw = [signs[c] for c in (name[: -len(WORD_END)] if ends else name)]
            return "".join(chr(b) for b in raw[:-1]) + chr(raw[-1] + END * ends)

        # Names outside the byte signs can't be made from a text.
        ids = {symbols(n): i for n, i in vocab.items() if n and n != WORD_END and all(c in signs for c in n.removesuffix(WORD_END))}
        pairs, ranks, halves = {}, [-1] * size, [(-1, -1)] * size
        for rank, (a, b) in enumerate(merges):
            made = vocab[a + b]
            pairs.setdefault(vocab[a] << 20 | vocab[b], rank)
            if ranks[made] >= 0:
                raise ValueError("a token with two merges has no single way to be built")
            ranks[made], halves[made] = rank, (vocab[a], vocab[b])
        # Three symbols may end any longer token; fewer stand for themselves, where a word has no more or no token ends in three.
        ends: dict[str, set[int]] = {}
        for name in ids:
            ends.setdefault(name[-3:], set()).add(len(name))
        for tail in list(ends):
            for cut in range(len(tail)):
                ends.setdefault(tail[cut:], set())
        for tail, sizes in ends.items():
            sizes.update(k for k in range(1, len(tail) + 1) if tail[-k:] in ids)
        ends = {tail: tuple(sorted(sizes, reverse=True)) for tail, sizes in ends.items()}
        return cls(tokens, ids, pairs, halves, ranks, ends, classes, lower, several, special)

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when they stand side by side.

        Goes back in time along the border: as long as the pair that touches
        there would not merge, the side built later falls into its halves. A
        merge across the border wins against the left side's own if it ranks
        lower, against the right side's own also at equal rank, as it stands
        further left.
        """
        pairs, ranks, halves = self.pairs, self.ranks, self.halves
        before_left, before_right = 1 << 60, 1 << 60  # ranks at which the touching parts are absorbed
        while True:
            across = pairs.get(left << 20 | right)
            if across is not None and across < before_left and across <= before_right:
                return False
            a, b = ranks[left], ranks[right]
            if a < 0 and b < 0:
                return True
            if a > b or (a == b and a >= 0 and before_left <= before_right):
                before_left, left = a, halves[left][1]
            else:
                before_right, right = b, halves[right][0]


class Trie:
    """Distinct words with the last token of every prefix; rows of ``nodes`` are ``(last token, its start node)``."""

    def __init__(self, vocabulary: BpeVocabulary, limit: int = TRIE_NODES):
        self.vocabulary, self.limit = vocabulary, limit
        self.known: dict[int, bool] = {}  # pairs already judged
        self.clear()

    def clear(self):
        self.children: list[dict[str, int] | None] = [None]
        self.last, self.back = array("i", [-1]), array("i", [-1])

    def fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 4 * self.limit:
                self.known.clear()
            found = self.known[key] = self.vocabulary.fits(left, right)
        return found

    def insert(self, words: list[str]) -> list[int]:
        """Nodes of words in sorted order, which walks the trie depth first: what a word shares with the word before stays on the path.

        A new node gets its last token at once, from the nodes above it.
        """
        ids, ends, last, back, children = self.vocabulary.ids, self.vocabulary.ends, self.last, self.back, self.children
        known, fits = self.known, self.fits
        found, path, before = [], [0], ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1:]
            node = path[-1]
            for depth in range(shared + 1, len(word) + 1):
                sign, below = word[depth - 1], children[node]
                if below is None:
                    below = children[node] = {}
                following = below.get(sign)
                if following is None:
                    for length in ends.get(word[max(depth - 3, 0):depth]) or ends.get(word[max(depth - 2, 0):depth]) or ends[sign]:
                        if length > depth:
                            continue
                        token = ids.get(word[depth - length:depth])
                        if token is None:
                            continue
                        start = path[depth - length]
                        if start:
                            fine = known.get(last[start] << 20 | token)
                            if not (fits(last[start], token) if fine is None else fine):
                                continue
                        break
                    else:
                        raise ValueError("no token ends this prefix")
                    following = below[sign] = len(children)
                    children.append(None)
                    last.append(token)
                    back.append(start)
                node = following
                path.append(node)
            before = word
            found.append(node)
        return found

    def tokens_of(self, node: int) -> list[int]:
        found = []
        while node:
            found.append(self.last[node])
            node = self.back[node]
        return found[::-1]

    def path_tokens(self, word: str) -> list[int]:
        """Tokens of one long word, its prefixes' last tokens in a flat array."""
        ids, ends, fits = self.vocabulary.ids, self.vocabulary.ends, self.fits
        last, size = array("i", [-1]), array("B", [0])
        for end in range(1, len(word) + 1):
            for length in ends.get(word[max(end - 3, 0):end]) or ends.get(word[max(end - 2, 0):end]) or ends[word[end - 1]]:
                if length > end:
                    continue
                token = ids.get(word[end - length:end])
                if token is not None and (length == end or fits(last[end - length], token)):
                    last.append(token)
                    size.append(length)
                    break
            else:
                raise ValueError("no token ends this prefix")
        found, end = array("i"), len(word)
        while end:
            found.append(last[end])
            end -= size[end]
        return found[::-1].tolist()

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of distinct words."""
        found: list[list[int]] = [[]] * len(words)
        raw = [w.decode("latin-1") for w in words]
        signs = [w[:-1] + chr(ord(w[-1]) + END) for w in raw]
        short = []
        for i, word in enumerate(signs):
            if len(word) > PATH_SYMBOLS:
                found[i] = self.path_tokens(word)
            else:
                short.append(i)
        short.sort(key=signs.__getitem__)
        for start in range(0, len(short), INSERTED):
            if len(self.children) > self.limit:
                self.clear()
            own = short[start:start + INSERTED]
            for i, node in zip(own, self.insert([signs[i] for i in own])):
                found[i] = self.tokens_of(node)
        return found


def _composed(texts: list[str], marks: dict[str, int]) -> tuple[list[str], list[int], list[int]]:
    """Texts cut at special tokens and composed: parts, their text, and the special token before each part (-1 for none)."""
    from tokenizers import normalizers

    compose = normalizers.NFC().normalize_str
    cut = re.compile("(" + "|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)) + ")") if marks else None
    parts, owner, before = [], [], []
    for i, text in enumerate(texts):
        pieces = cut.split(text) if cut and any(m in text for m in marks) else [text]
        for k in range(0, len(pieces), 2):
            piece = pieces[k]
            parts.append(piece if piece.isascii() or max(piece) < chr(COMPOSING) else compose(piece))
            owner.append(i)
            before.append(marks[pieces[k - 1]] if k else -1)
    return parts, owner, before


def split_words(vocabulary: BpeVocabulary, texts: pa.Array):
    """``(data, starts, owner, special)``: bytes of all words one after another, where each starts, its text, and its
    id where it is a special token (else -1)."""
    parts, owner, before = _composed(texts.to_pylist(), vocabulary.special)
    sizes = np.array([len(p) for p in parts], np.int64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
    text = np.repeat(np.array(owner, np.int64), sizes)
    part = np.repeat(np.arange(len(parts)), sizes)
    marked = np.flatnonzero(np.array(before, np.int64) >= 0)
    token = np.full(len(codes), -1, np.int64)
    if len(marked):  # a special token is one sign of its own before its part
        where = (np.cumsum(sizes) - sizes)[marked]
        codes, text, part = np.insert(codes, where, CODES), np.insert(text, where, np.array(owner)[marked]), np.insert(part, where, -1)
        token = np.insert(token, where, np.array(before)[marked])
    codes = vocabulary.lower[codes]
    for sign, small in vocabulary.several.items():
        hits = np.flatnonzero(codes == sign)
        if len(hits):
            more = np.repeat(hits + 1, len(small) - 1)
            codes[hits] = small[0]
            codes, text, part = np.insert(codes, more, np.tile(small[1:], len(hits))), np.insert(text, more, text[more - 1]), np.insert(part, more, part[more - 1])
            token = np.insert(token, more, -1)
    kind = vocabulary.classes[codes]
    first = np.ones(len(codes), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (kind[1:] == SPECIAL) | (part[1:] != part[:-1])
    # An apostrophe that starts a run takes a known suffix of letters with it.
    quotes = np.flatnonzero(first & (codes == 39))
    padded = np.append(codes, [-1, -1])
    padded_part = np.append(part, [-9, -9])
    for suffix in SUFFIXES:
        hit = np.ones(len(quotes), bool)
        for k, sign in enumerate(suffix, 1):
            hit &= (padded[np.minimum(quotes + k, len(codes))] == ord(sign)) & (padded_part[np.minimum(quotes + k, len(codes))] == part[quotes])
        taken = quotes[hit]
        first[taken + 1] = False
        behind = taken + 1 + len(suffix)
        behind = behind[behind < len(codes)]
        first[behind] = True
        quotes = quotes[~hit]
    solid = kind != SPACE
    codes, text, token, first = codes[solid], text[solid], token[solid], first[solid]
    widths = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    widths[token >= 0] = 1
    data = np.where(token >= 0, 0, codes).astype("<u4").tobytes().decode("utf-32-le").encode()
    heads = np.flatnonzero(first)
    return data, (np.cumsum(widths) - widths)[heads], text[heads], token[heads]


def encode_texts(trie: Trie, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, and how many each has. Null counts as empty."""
    n = len(texts)
    data, starts, owner, special = split_words(trie.vocabulary, pc.fill_null(texts, ""))
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    made = trie.encode(coded.dictionary.to_pylist())
    counts = np.array([len(m) for m in made], np.int64)
    flat = np.fromiter((t for m in made for t in m), np.int32, int(counts.sum()))
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.where(special >= 0, 1, counts[word])
    place = (np.cumsum(counts) - counts)[word]
    total = int(size.sum())
    ids = flat[np.minimum(np.arange(total) - np.repeat(np.cumsum(size) - size - place, size), max(len(flat) - 1, 0))]
    marked = np.flatnonzero(special >= 0)
    ids[(np.cumsum(size) - size)[marked]] = special[marked]
    return ids, np.bincount(owner, size, minlength=n).astype(np.int64)


def decode_ids(vocabulary: BpeVocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of consecutive id lists: the tokens' own names with one space between, special ones included."""
    table = pa.array([" " + t for t in vocabulary.tokens], pa.large_string())
    taken = table.take(pa.array(ids))
    lengths = np.diff(np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
    data = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[:ends[-1]] if len(ids) else np.zeros(0, np.uint8)
    keep = np.ones(len(data), bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False  # the space before the first token
    gone = np.append(0, np.cumsum(~keep))
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends - gone[ends]), pa.py_buffer(data[keep]))


def encode(docs: DataFrame, vocabulary: BpeVocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids array<int>)``, one row per input row.

    Null counts as the empty text; a text without words has no ids. Repeated
    rows get equal results, ids may be null or repeat. Very long texts are
    encoded one at a time and very long words as a path of a few bytes per
    byte. Other columns are dropped, whatever their names.
    """
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(vocabulary)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                ids, counts = encode_texts(trie, part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), lists], names=[id_col, "n_tokens", "ids"])

    schema = StructType([rows.schema.fields[0]]).add("n_tokens", "long")
    return rows.mapInArrow(run, StructType([*schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, vocabulary: BpeVocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns but ``ids_col``, then the ids and ``text_col``, the text of each id list.

    A null list gives the empty text; a null id inside a list is skipped. A
    column already called ``text_col`` is replaced.
    """
    kept = [c for c in encoded.columns if c not in (ids_col, text_col)]
    some = F.coalesce(F.filter(ids_col, lambda x: x.isNotNull()), F.array().cast("array<int>"))
    rows = encoded.select(*kept, some.alias(ids_col))
    names = [*rows.columns, text_col]
    slice_ids = SLICE_BYTES // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(len(kept))).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(sizes) // slice_ids
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                ids = pc.list_flatten(part.column(len(kept))).to_numpy(zero_copy_only=False)
                texts = decode_ids(vocabulary, ids, sizes[a:b]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(text_col, "string"))


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and hashes of ids and decoded texts."""
    return decoded.select(
        id_col, "n_tokens", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
