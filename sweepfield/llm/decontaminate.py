"""Benchmark decontamination by spaced seeds.

A spaced seed is a fixed mask over consecutive words: the hash at a position
covers the words under the mask's ones and ignores the rest, so a changed word
under a gap leaves the hash as it is. Hashes of every position of every
document are joined with those of the benchmark items. Hits that keep the same
offset between document and item lie on one diagonal; each diagonal is then
compared word by word with the item, and its best local stretch is kept.

The benchmark side is broadcast behind a count and shuffled beyond it; hits
are folded per diagonal before they move, so a passage that a third of all
documents share costs one row per document.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepfield.llm.common import broadcast_if_counted, fold_case, same, text_of, word_arrays, written

# Words are runs of letters and digits; letters outside ASCII count.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Second pair of each mask made of two word pairs: 1111 and 110011. Every stretch
# of eight words or more with a share of MIN_SHARE has a hit, one of MIN_WORDS or
# more has LEAST_HITS: so by counting over all patterns of 8 to 23 words, and a
# longer stretch holds one of 12 to 23 words with the share.
MASKS = [2, 4]
SPANS = [second + 2 for second in MASKS]
LEAST_HITS = 3
# A stretch counts from MIN_WORDS compared words of which MIN_SHARE agree.
MIN_WORDS, MIN_SHARE = 12, 0.8
# Items below this length match whole and exactly.
EXACT_BELOW = 8


def _joined(first: Column, later: Column, step: int) -> Column:
    return F.zip_with(first, F.slice(later, step + 1, 2_000_000_000), lambda a, b: F.xxhash64(a, b))


def seed_hashes(rows: DataFrame, keep: list[str], whole: list[int]) -> DataFrame:
    """``keep`` columns and ``seed, at, hash``: one row per mask and word position of ``_w``.

    ``whole`` are lengths of items shorter than every mask (1 to 3 words): such
    runs of words are hashed too, as seed ``len(MASKS) + i`` for its i-th entry.
    Texts shorter than a mask give one row with a null hash.
    """
    hashed = rows.select(*keep, F.size("_w").alias("_n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    pairs = hashed.select(*keep, "_n", "_h", _joined(F.col("_h"), F.col("_h"), 1).alias("_p"))
    runs = {1: F.col("_h"), 2: F.col("_p"), 3: _joined(F.col("_p"), F.col("_h"), 2)}
    hashes = [_joined(F.col("_p"), F.col("_p"), second) for second in MASKS] + [runs[n] for n in whole]
    counts = [F.greatest(F.col("_n") - span + 1, F.lit(0)) for span in SPANS + whole]
    lists = pairs.select(*keep, "_n", *[F.slice(h, 1, n).alias(f"_s{i}") for i, (h, n) in enumerate(zip(hashes, counts))])
    names = [f"_s{i}" for i in range(len(hashes))]
    # posexplode_outer, since for the inner form Catalyst computes the arrays twice.
    flat = lists.select(*keep, "_n", F.concat(*names).alias("_all")).select(*keep, "_n", F.posexplode_outer("_all").alias("_i", "hash"))
    seed, at, start = F.lit(0), F.col("_i"), F.lit(0)
    for i, n in enumerate(counts[:-1], 1):
        start = start + n
        seed, at = F.when(F.col("_i") >= start, i).otherwise(seed), F.when(F.col("_i") >= start, F.col("_i") - start).otherwise(at)
    return flat.select(*keep, seed.alias("seed"), at.alias("at"), "hash")


def best_stretch(agree: Column, need: Column, min_share: float) -> Column:
    """``struct<matched, minus_words, minus_first>`` of the stretch with the most agreeing words, null if none.

    ``agree`` holds 1 and 0. A stretch has at least ``need`` entries and the
    share; of equal ones the shortest counts. One pass: with a weight for
    agreeing and one for other entries, a stretch has the share when its running sum ends no
    lower than it began, and the longest one up to an entry begins where the
    sum first fell that low.
    """
    share = Fraction(str(min_share)).limit_denominator(1000)
    miss, hit = -share.numerator, share.denominator - share.numerator
    place = F.struct(F.lit(0).alias("at"), F.lit(0).alias("ones"))
    none = F.lit(None).cast("struct<matched:int,minus_words:int,minus_first:int>")
    # lows[k] is the first place where the sum was -k or less.
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at"), F.lit(0).alias("ones"), F.array(place).alias("lows"), none.alias("best"))

    def step(s, a):
        total, at, ones = s["sum"] + F.when(a == 1, hit).otherwise(miss), s["at"] + 1, s["ones"] + a
        fall = 1 - F.size(s["lows"]) - total
        here = F.struct(at.alias("at"), ones.alias("ones"))
        lows = F.when(fall > 0, F.concat(s["lows"], F.array_repeat(here, fall))).otherwise(s["lows"])
        low = F.get(s["lows"], F.greatest(-total, F.lit(0)))
        found = F.struct((ones - low["ones"]).alias("matched"), (low["at"] - at).alias("minus_words"), (-low["at"]).alias("minus_first"))
        best = F.when((fall <= 0) & (at - low["at"] >= need), F.greatest(s["best"], found)).otherwise(s["best"])
        return F.struct(total.alias("sum"), at.alias("at"), ones.alias("ones"), lows.alias("lows"), best.alias("best"))

    return F.aggregate(agree, start, step, lambda s: s["best"])


def _words(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    return word_arrays(df, fold_case(text), SEPARATOR, keep)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    min_words: int = MIN_WORDS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """``(id_col, _fp, item_col, first_word, last_word, words, matched, share)``, best stretch per text and item.

    Positions are words of the document. Items under ``EXACT_BELOW`` words
    match whole and exactly. Null texts count as empty and match nothing; null
    ids are kept and matched by value. Repeated rows give one row. ``_fp`` is
    the text's hash, which tells rows of equal id apart. With smaller limits
    than the given ones, a stretch is found only where a seed hits.
    """
    text = text_of(text_col)
    keep = [F.col(id_col).alias("_id"), F.xxhash64(text).alias("_fp")]
    items = _words(benchmark, text_of("text"), [F.col(item_col).alias("_item")]).distinct()
    items = broadcast_if_counted(written(items.withColumn("_size", F.size("_w")), "items"))
    whole = sorted(r["_size"] for r in items.filter(F.col("_size").between(1, min(SPANS) - 1)).select("_size").distinct().collect())
    own = F.lit(True)  # a run of fewer words than any mask is a seed of items of that length only
    for i, n in enumerate(whole, len(MASKS)):
        own = own & ((F.col("seed") != i) | (F.col("_size") == n))
    seeds = seed_hashes(items, ["_item", "_size"], whole).filter(F.col("hash").isNotNull() & own).select(
        "seed", "hash", "_item", "_size", F.col("at").alias("_t"))
    seeds = broadcast_if_counted(written(seeds, "seeds"))
    grams = seed_hashes(_words(docs, text, keep), ["_id", "_fp"], whole)
    hits = grams.join(seeds, ["seed", "hash"])
    # A hit of a whole short item is a find: the first place in the document is enough.
    offset = F.when(F.col("seed") < len(MASKS), F.col("at") - F.col("_t"))
    diagonals = hits.groupBy("_id", "_fp", "_item", "_size", offset.alias("_o")).agg(F.min("at").alias("_a"), F.count("*").alias("_hits"))
    if min_words >= MIN_WORDS and min_share >= MIN_SHARE:
        diagonals = diagonals.filter((F.col("_hits") >= LEAST_HITS) | (F.col("_size") < MIN_WORDS))
    diagonals = written(diagonals.select("_id", "_fp", "_item", "_size", F.coalesce("_o", "_a").alias("_d")), "diagonals")
    # Only texts with hits are split into words again.
    suspects = diagonals.select("_id", "_fp").distinct()
    rows = docs.select(*keep, text.alias("_text"))
    there = broadcast_if_counted(written(suspects.select(F.col("_id").alias("_i"), F.col("_fp").alias("_f")), "suspects"))
    found = rows.join(there, same([(F.col("_id"), F.col("_i")), (F.col("_fp"), F.col("_f"))]), "left_semi")
    words = _words(found, F.col("_text"), [F.col("_id").alias("_i"), F.col("_fp").alias("_f")])
    # The compared words: the whole item where it lies inside the document.
    low = F.greatest(F.lit(0), -F.col("_d"))
    high = F.least(F.col("_size"), F.size("_w") - F.col("_d"))
    met = words.join(broadcast_if_counted(diagonals), same([(F.col("_i"), F.col("_id")), (F.col("_f"), F.col("_fp"))])).select(
        "_id", "_fp", "_item", "_size", low.alias("_low"), (low + F.col("_d")).alias("_from"), F.slice("_w", low + F.col("_d") + 1, high - low).alias("_dw"))
    agree = F.zip_with("_dw", F.slice("_w", F.col("_low") + 1, F.size("_dw")), lambda a, b: F.when(a == b, 1).otherwise(0))
    both = met.join(items.select("_item", "_size", "_w"), same([(met["_item"], items["_item"]), (met["_size"], items["_size"])])).select(
        "_id", "_fp", met["_item"], met["_size"], "_from", agree.alias("_agree"))
    need = F.least(F.lit(min_words), F.col("_size"))
    scored = both.withColumn("_best", best_stretch(F.col("_agree"), need, min_share)).filter("_best IS NOT NULL")
    # The longest stretch may begin with words that differ; they are left off down to the length needed.
    first, words_in = -F.col("_best.minus_first"), -F.col("_best.minus_words")
    lead = F.least(F.array_position(F.slice("_agree", first + 1, words_in), 1).cast("int") - 1, words_in - need)
    scored = scored.select(
        "_id", "_fp", "_item", "_size", (F.col("_from") + first + lead).alias("first_word"), (words_in - lead).alias("words"),
        F.col("_best.matched").alias("matched")).withColumn("share", F.col("matched") / F.col("words"))
    good = scored.filter((F.col("_size") >= EXACT_BELOW) | (F.col("matched") == F.col("_size")))
    best = F.max_by(F.struct("first_word", "words", "matched", "share"), F.struct("matched", "share", -F.col("first_word")))
    return good.groupBy("_id", "_fp", "_item").agg(best.alias("b")).select(
        F.col("_id").alias(id_col), "_fp", F.col("_item").alias(item_col), F.col("b.first_word").cast("long").alias("first_word"),
        (F.col("b.first_word") + F.col("b.words") - 1).cast("long").alias("last_word"), F.col("b.words").cast("long").alias("words"),
        F.col("b.matched").cast("long").alias("matched"), F.col("b.share").alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The documents without any verified overlap, all their columns kept."""
    bad = written(find_overlaps(docs, benchmark, id_col, text_col, **limits).select(
        F.col(id_col).alias("_bad_id"), F.col("_fp").alias("_bad_fp")).distinct(), "leaks")
    marked = docs.withColumn("_own_fp", F.xxhash64(text_of(text_col)))
    return marked.join(
        broadcast_if_counted(bad), same([(F.col(id_col), F.col("_bad_id")), (F.col("_own_fp"), F.col("_bad_fp"))]), "left_anti").select(*docs.columns)
