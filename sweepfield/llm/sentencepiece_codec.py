"""SentencePiece encoding and decoding with seeded merge dropout.

A text starts as characters. Every adjacent pair that forms a piece is a
candidate on an agenda, best score first and leftmost among equals. When a
candidate comes up, a keyed hash of the seed, the draw, the word and the place
decides whether it is skipped; a skipped pair comes back only when one of its
sides changes. Dropped merges give other segmentations of the same text, and
every one of them decodes to exactly that text, characters without a piece
through byte pieces.

No piece crosses from a word into the next white space, so words are encoded
on their own: distinct words of a batch go through the agenda once per draw,
many side by side in numpy, one agenda step of every word at a time. Words
above 64 characters use a heap instead, with the same results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from sweepfield.llm.common import slices, text_of

SPACE = "▁"  # how the vocabulary writes a space
DROPOUT, SEED, DRAWS = 0.1, 20, 16
WIDTHS = (4, 8, 12, 16, 24, 32, 64)
FREE = 1 << 24  # symbols from here on are characters without a piece
SLICE_BYTES = 1_000_000  # text encoded at once; its ids and tables take some eighty times as much
BLOCK_SYMBOLS = 1 << 16  # places of a block of words that go through the agenda side by side
NEVER = np.int32(2**31 - 1)


def _hash(*parts) -> np.ndarray:
    """64-bit mix of integer arrays."""
    h = np.array([0x9E3779B97F4A7C15], np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB)


@dataclass
class Vocabulary:
    """Pieces as the encoder needs them: ordinary pieces with ranks, byte pieces, and the merge table."""

    pieces: list[bytes]  # what an id decodes to
    char_codes: np.ndarray = field(repr=False)  # sorted code points that are pieces
    char_ids: np.ndarray = field(repr=False)
    pair_keys: np.ndarray = field(repr=False)  # sorted left << 32 | right
    pair_ids: np.ndarray = field(repr=False)
    pair_ranks: np.ndarray = field(repr=False)
    byte_ids: np.ndarray = field(repr=False)
    special: int = 0

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a model file with byte pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        scores = np.array([model.get_score(i) for i in range(size)])
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) for i in range(size)]
        return cls.build(names, scores, plain, {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)})

    @classmethod
    def build(cls, names: list[str], scores: np.ndarray, plain: list[bool], byte_ids: dict[int, int]) -> Vocabulary:
        names = [n.replace(SPACE, " ") if p else n for n, p in zip(names, plain)]
        # Equal scores have equal rank: the leftmost pair goes first then.
        rank_of = {s: r for r, s in enumerate(sorted({float(s) for s, p in zip(scores, plain) if p}, reverse=True))}
        ids = {n: i for i, (n, p) in enumerate(zip(names, plain)) if p}
        if any(" " in n.lstrip(" ") or "\n" in n.strip("\n") and len(n) > 1 for n in ids):
            raise ValueError("pieces cross word borders; words can't be encoded one by one")
        symbol = lambda n: ids.get(n, FREE + ord(n) if len(n) == 1 else None)
        pairs = {}
        for n, i in ids.items():
            for cut in range(1, len(n)):
                left, right = symbol(n[:cut]), symbol(n[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (i, rank_of[float(scores[i])])
        keys = np.array(sorted(pairs), np.int64)
        chars = sorted((ord(n), i) for n, i in ids.items() if len(n) == 1)
        back = {i: bytes([b]) for b, i in byte_ids.items()}
        return cls(
            [back.get(i, n.encode() if p else b"") for i, (n, p) in enumerate(zip(names, plain))],
            np.array([c for c, _ in chars], np.int64), np.array([i for _, i in chars], np.int64),
            keys, np.array([pairs[k][0] for k in keys.tolist()], np.int32), np.array([pairs[k][1] for k in keys.tolist()], np.int32),
            np.array([byte_ids[b] for b in range(256)], np.int32))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.char_codes):
            return FREE + codes
        at = np.minimum(np.searchsorted(self.char_codes, codes), len(self.char_codes) - 1)
        return np.where(self.char_codes[at] == codes, self.char_ids[at], FREE + codes)

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair; rank ``NEVER`` where the two form no piece."""
        keys = (left << 32) | right
        if not len(self.pair_keys):
            return np.zeros(keys.shape, np.int64), np.full(keys.shape, NEVER)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return self.pair_ids[at].astype(np.int64), np.where(hit, self.pair_ranks[at], NEVER)


def _skips(seed: int, draw, word, at, left_over, piece, dropout: float) -> np.ndarray:
    """Whether the candidate is skipped: a keyed hash against the rate."""
    if dropout <= 0:
        return np.zeros(np.shape(at), bool)
    return (_hash(seed, draw, word, at, left_over, piece) >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53


def encode_one(vocabulary: Vocabulary, symbols: list[int], word: int, draw: int, seed: int, dropout: float) -> list[int]:
    """Agenda on a heap for one word. ``at`` counts live symbols to the left, as in the side-by-side form."""
    count, live = len(symbols), np.ones(len(symbols), bool)
    symbols, after, before = list(symbols), list(range(1, count + 1)), list(range(-1, count - 1))
    agenda: list[tuple[int, int, int, int, int]] = []
    # Live symbols left of a place, in a tree of sums, so long words stay quick.
    tree = [0] * (count + 1)

    def add(i, by):
        i += 1
        while i <= count:
            tree[i] += by
            i += i & -i

    def left_of(i):
        total = 0
        while i > 0:
            total += tree[i]
            i -= i & -i
        return total

    for i in range(count):
        add(i, 1)
    remaining = count

    def propose(a, b):
        if a >= 0 and b < count:
            piece, rank = vocabulary.merged(np.array([symbols[a]]), np.array([symbols[b]]))
            if rank[0] != NEVER:
                heapq.heappush(agenda, (int(rank[0]), a, b, int(piece[0]), symbols[a] << 32 | symbols[b]))

    for i in range(count - 1):
        propose(i, i + 1)
    while agenda:
        _, a, b, piece, pair = heapq.heappop(agenda)
        if not (live[a] and b < count and live[b] and after[a] == b and symbols[a] << 32 | symbols[b] == pair):
            continue
        if bool(np.any(_skips(seed, draw, word, left_of(a), remaining, piece, dropout))):
            continue
        symbols[a], live[b] = piece, False
        add(b, -1)
        remaining -= 1
        after[a] = after[b]
        if after[a] < count:
            before[after[a]] = a
        propose(before[a], a)
        propose(a, after[a])
    return [s for s, on in zip(symbols, live) if on]


def _encode_block(vocabulary: Vocabulary, symbols: np.ndarray, sizes: np.ndarray, words, draws, seed: int, dropout: float):
    """Side-by-side agenda: ``symbols`` (words, width) with -1 past the end; returns symbols and sizes."""
    out, out_sizes = symbols.copy(), sizes.copy()
    pieces, ranks = vocabulary.merged(symbols[:, :-1], symbols[:, 1:])
    rows, width = np.arange(len(symbols)), symbols.shape[1]
    place = np.arange(width)
    while len(rows):
        best = ranks.argmin(axis=1)
        line = np.arange(len(rows))
        live = ranks[line, best] != NEVER
        if not live.all():
            done = ~live
            out[rows[done]], out_sizes[rows[done]] = symbols[done], sizes[done]
            rows, symbols, sizes, pieces, ranks, best = rows[live], symbols[live], sizes[live], pieces[live], ranks[live], best[live]
            words, draws = words[live], draws[live]
            line = np.arange(len(rows))
            if not len(rows):
                break
        piece = pieces[line, best]
        skip = _skips(seed, draws, words, best, sizes, piece, dropout)
        ranks[line[skip], best[skip]] = NEVER
        go = np.flatnonzero(~skip)
        if not len(go):
            continue
        at = best[go]
        source = place[None, :] + (place[None, :] > at[:, None])
        moved = np.take_along_axis(np.hstack([symbols[go], np.full((len(go), 1), -1)]), source, axis=1)
        moved[np.arange(len(go)), at] = piece[go]
        symbols[go] = moved
        sizes[go] -= 1
        # Pairs move along; the two around the new symbol are looked up.
        pair_source = np.minimum(source[:, :-1], width - 1)
        padded_ranks = np.hstack([ranks[go], np.full((len(go), 1), NEVER)])
        padded_pieces = np.hstack([pieces[go], np.zeros((len(go), 1), pieces.dtype)])
        new_ranks = np.take_along_axis(padded_ranks, pair_source, axis=1)
        new_pieces = np.take_along_axis(padded_pieces, pair_source, axis=1)
        some = np.arange(len(go))
        for shift in (-1, 0):
            p = at + shift
            fine = (p >= 0) & (p < width - 1)
            q = np.flatnonzero(fine)
            found, rank = vocabulary.merged(moved[some[q], p[q]], moved[some[q], p[q] + 1])
            new_ranks[some[q], p[q]], new_pieces[some[q], p[q]] = rank, found
        ranks[go], pieces[go] = new_ranks, new_pieces
    return out, out_sizes


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, ...`` of every run, one after another."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def _encode_words(vocabulary: Vocabulary, words: pa.Array, draws: np.ndarray, seed: int, dropout: float):
    """Ids of distinct words, flat, and how many each has."""
    text = "".join(words.to_pylist())
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    symbols = vocabulary.symbols(codes)
    keys = np.add.reduceat(_hash(codes, np.arange(len(codes)) - np.repeat(starts, sizes)), starts) if len(sizes) else np.zeros(0, np.uint64)
    found, counts = [], np.zeros(len(sizes), np.int64)
    order, low = [], 0
    for width in WIDTHS:
        fitting = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        for rows in np.split(fitting, range(BLOCK_SYMBOLS // width, len(fitting), BLOCK_SYMBOLS // width)) if len(fitting) else ():
            grid = np.full((len(rows), width), -1, np.int64)
            grid[np.arange(width) < sizes[rows][:, None]] = symbols[_runs(starts[rows], sizes[rows])]
            if width > 1:
                done, left = _encode_block(vocabulary, grid, sizes[rows].copy(), keys[rows], draws[rows], seed, dropout)
            found.append(done[np.arange(width) < left[:, None]])
            counts[rows] = left
            order.append(rows)
    for row in np.flatnonzero(sizes > low):
        part = symbols[starts[row]:starts[row] + sizes[row]].tolist()
        done = encode_one(vocabulary, part, keys[row], draws[row], seed, dropout)
        found.append(np.array(done, np.int64))
        counts[row] = len(done)
        order.append(np.array([row]))
    if not found:
        return np.zeros(0, np.int32), counts
    flat, order = np.concatenate(found), np.concatenate(order)
    # Back to word order, then characters without a piece as their bytes.
    place = np.cumsum(counts[order]) - counts[order]
    at = np.empty(len(order), np.int64)
    at[order] = place
    flat = flat[_runs(at, counts)]
    free = np.flatnonzero(flat >= FREE)
    if len(free):
        raw = [chr(int(c) - FREE).encode() for c in flat[free]]
        lengths = np.ones(len(flat), np.int64)
        lengths[free] = [len(r) for r in raw]
        spread = np.repeat(flat, lengths)
        spread[_runs((np.cumsum(lengths) - lengths)[free], lengths[free])] = vocabulary.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        counts = np.add.reduceat(lengths, np.cumsum(counts) - counts) if len(counts) else counts
        flat = spread
    return flat.astype(np.int32), counts


def encode_texts(vocabulary: Vocabulary, texts: pa.Array, keys: np.ndarray, seed: int = SEED, dropout: float = DROPOUT, draws: int = DRAWS):
    """Ids of all texts, flat, and how many each has. ``keys``: one integer per text that varies the draws."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    framed = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    framed = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), framed)
    offsets = np.frombuffer(framed.buffers()[1], np.int64, n + 1, framed.offset * 8)
    data = np.frombuffer(framed.buffers()[2] or b"", np.uint8)[:offsets[-1]]
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    space, line = data == 32, data == 10
    border = np.zeros(len(data), bool)
    border[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    border[heads] = True
    starts = np.flatnonzero(border)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data))
    coded = words.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    owner = np.searchsorted(offsets, starts, side="right") - 1
    per_text = np.bincount(owner, minlength=n)
    if dropout > 0:
        rank = np.arange(len(starts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        draw = (_hash(seed, np.asarray(keys)[owner], rank) % np.uint64(draws)).astype(np.int64)
    else:
        draws, draw = 1, np.zeros(len(starts), np.int64)
    used = np.zeros(len(distinct) * draws, bool)
    mixed = codes * draws + draw
    used[mixed] = True
    members = np.flatnonzero(used)
    flat, counts = _encode_words(vocabulary, distinct.take(pa.array(members // draws)), members % draws, seed, dropout)
    place = np.cumsum(counts) - counts
    row = (np.cumsum(used) - 1)[mixed]
    ids = flat[_runs(place[row], counts[row])]
    return ids, np.bincount(owner, counts[row], minlength=n).astype(np.int64)


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The texts of consecutive id lists; ids without a text of their own (controls) give nothing."""
    table = pa.array(vocabulary.pieces, pa.large_binary())
    taken = table.take(pa.array(ids))
    lengths = np.diff(np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
    data = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[:ends[-1]] if len(ids) else np.zeros(0, np.uint8)
    # The leading space of every text was put in by the encoder.
    keep = np.ones(len(data), bool)
    heads = ends[:-1][np.diff(ends) > 0]
    keep[heads[data[heads] == 32]] = False
    gone = np.append(0, np.cumsum(~keep))
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends - gone[ends]), pa.py_buffer(data[keep]))


def encode(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
    seed: int = SEED, dropout: float = DROPOUT, draws: int = DRAWS, verify: bool = True,
) -> DataFrame:
    """``(id_col, n_tokens, ids array<int>, lossless)``, one row per input row.

    Null counts as the empty text, which has no ids. A word's draw follows
    from the seed, the row's id and text and the word's place, so a repeated
    row gets the same ids and a rerun gives the same result. ``dropout`` 0
    gives the model's own segmentation. ``lossless`` tells whether the ids
    decoded to the text; it is null when ``verify`` is off. Other columns are
    dropped.
    """
    rows = docs.select(F.col(id_col), F.xxhash64(F.col(id_col), text_of(text_col)).alias("_key"), text_of(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                texts = part.column(2)
                ids, counts = encode_texts(vocabulary, texts, part.column(1).to_numpy(zero_copy_only=False), seed, dropout, draws)
                same = pc.equal(decode_ids(vocabulary, ids, counts), texts.cast(pa.large_string())) if verify else pa.nulls(len(counts), pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), lists, same], names=[id_col, "n_tokens", "ids", "lossless"])

    schema = StructType([rows.schema.fields[0]]).add("n_tokens", "long")
    schema = StructType([*schema.fields, StructField("ids", ArrayType(IntegerType()))]).add("lossless", "boolean")
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)`` from id lists; a null list gives the empty text."""
    rows = encoded.select(F.col(id_col), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            texts = decode_ids(vocabulary, ids, counts).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "text"])

    return rows.mapInArrow(run, StructType([rows.schema.fields[0]]).add("text", "string"))
