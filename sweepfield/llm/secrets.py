"""Secrets: known formats by pattern, unknown ones by two character Markov models.

The models are first-order: transition counts of random strings and of
ordinary identifiers, both from labelled samples, smoothed and compared as a
log-likelihood ratio per character. Counting is a grouped aggregate over the
samples' character pairs; its result has at most 2 x 128 x 128 rows, a bound
that does not depend on the data. Scanning is a projection: no shuffle and no
Python, so a hot source or a very long text changes nothing. Every run of
characters that keys are made of is scored, whatever letters it has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepfield.functions.arrays import bound
from sweepfield.llm.common import count_kind, match_spans, span_text, text_of, written

# Kinds in the order they are listed, and the patterns of the contract.
KINDS = ["assign", "access", "hex", "random"]
BASE_KINDS = 3
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Candidates for the models: long runs of the characters that keys are made of.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
CODES = 128
# Log-likelihood ratio per character pair from which a run counts as random.
THRESHOLD = 0.25
# Weight of a character's own frequency against the transitions seen, as a count and as a share.
PRIOR, SHARE = 4.0, 0.2
# What stands in the place of a base span while the free parts are searched.
MASK = "\x01"
# Words of ordinary identifiers, paths and names, so that the
# ordinary label knows the letter pairs of English in any corpus.
ORDINARY_WORDS = (
    "account action active address admin after agent amount api application archive argument array asset async attribute author average backup "
    "balance batch before begin binary block body branch browser buffer build button cache calculate callback cancel category change channel "
    "character check class classification client cluster column command comment commit component config connection constant container content "
    "context controller convert country create credit current customer database date default delete delivery description design detail device "
    "dictionary directory discount display document domain download driver duration element email enable encode engine entity environment error "
    "event example exception execute expire export external factory failure feature field filter folder format function gateway generate global "
    "group handler header height history hostname identifier image import index initial input instance integer interface internal invoice item "
    "journal keyboard language layout length level library license limit listener local location logger machine manager maximum memory message "
    "method minimum model module monitor network notification number object operation option order output package page parameter parent"
).split()
# Bound of the labelled sample: documents whose tokens are labelled for training.
SAMPLE_DOCS = 2_000


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE_DOCS) -> DataFrame:
    """``(token, random)`` from at most ``limit`` documents, those with the smallest hash of their id.

    Random: digests of the ids in six alphabets (base64, letters and digits,
    letters, and one case only), so that the label exists in any corpus, and
    access keys found in the texts. Ordinary: the distinct words of each text
    and the fixed ones, three at a time in the usual spellings of identifiers
    and paths, and dates, counters, numbers and UUIDs made from the ids. Null
    ids and repeated rows add nothing; null texts give no words.
    """
    chosen = _smallest_hashes(docs.select(F.col(id_col).alias("_id")).filter("_id IS NOT NULL").distinct(), limit)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).join(F.broadcast(chosen), "_id", "left_semi")
    label = lambda tokens, random: tokens.select(F.explode("_tokens").alias("token"), F.lit(random).alias("random"))
    keys = F.regexp_extract_all("_t", F.lit(ACCESS), F.lit(0)).alias("_tokens")
    words = F.array_distinct(F.regexp_extract_all("_t", F.lit("(?<![A-Za-z0-9])[A-Za-z]?[a-z]{3,12}(?![A-Za-z0-9])"), F.lit(0)))
    fixed = F.transform(F.array(*[F.lit(w) for w in ORDINARY_WORDS]), lambda w: F.struct(F.xxhash64(w, F.col("_id")).alias("h"), w.alias("w")))
    mixed = F.transform(F.slice(F.array_sort(fixed), 1, 12), lambda f: f["w"])
    made = chosen.withColumn("_d", F.sha2(F.col("_id").cast("string"), 512))
    return (
        label(rows.select(keys), True)
        .unionByName(label(made.select(_random_forms(F.col("_d")).alias("_tokens")), True))
        .unionByName(label(rows.select(_identifiers(words).alias("_tokens")), False))
        .unionByName(label(made.select(F.concat(_identifiers(mixed), _numbers(F.col("_d"))).alias("_tokens")), False)))


def _smallest_hashes(ids: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` distinct ids of the smallest hash, as a written table.

    Hashes are even, so a bound at about twice the share keeps all of them;
    the sort then sees a few thousand ids however many there are.
    """
    hashed = ids.select("_id", F.xxhash64("_id").alias("_h"))
    share = (2 * limit + 1_000) / max(1, hashed.count())
    bound_at = min(2**63 - 1, int(-(2**63) + share * 2**64))
    return written(hashed.filter(F.col("_h") <= bound_at).orderBy("_h", "_id").limit(limit).select("_id"), "secret-sample")


def _random_forms(digest: Column) -> Column:
    """A digest in the alphabets keys are written in."""
    full = F.base64(F.unhex(digest))
    letters = F.regexp_replace(full, "[^A-Za-z]", "")
    plain = F.regexp_replace(full, "[^A-Za-z0-9]", "")
    return F.array(full, plain, letters, F.lower(letters), F.upper(letters), F.upper(plain), F.lower(plain))


def _identifiers(words: Column) -> Column:
    """Three words at a time joined the way names and paths are."""
    def spelled(all_words: Column) -> Column:
        last = F.greatest(F.floor((F.size(all_words) - 1) / 3), F.lit(0)).cast("int")
        threes = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_words, i * 3 + 1, 3))
        joined = lambda t, sign: F.array_join(t, sign)
        return F.flatten(F.transform(threes, lambda t: F.array(
            joined(t, "_"), F.lower(joined(t, "-")), F.lower(joined(t, "/")), F.upper(joined(t, "_")),
            F.replace(F.initcap(joined(t, " ")), F.lit(" "), F.lit("")),
            F.concat(F.lower(F.get(t, F.lit(0))), F.replace(F.initcap(joined(F.slice(t, 2, 2), " ")), F.lit(" "), F.lit("")), F.lit("2")), F.concat(F.lower(joined(t, "")), F.lit("2")),
            F.concat(F.upper(joined(t, "_")), F.lit("_1")))))

    return bound(words, spelled)


def _numbers(digest: Column) -> Column:
    """Dates, counters, numbers and UUIDs from a hex digest."""
    part = lambda at, size: F.substring(digest, at, size)
    tens = F.translate(digest, "abcdef", "012345")
    two = lambda at, top: F.lpad((F.substring(tens, at, 2).cast("int") % top + 1).cast("string"), 2, "0")
    date = F.concat(F.lit("20"), two(1, 30), F.lit("-"), two(3, 12), F.lit("-"), two(5, 28))
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    step = F.substring(tens, 7, 1).cast("int")
    counter = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((i + step) % 10).cast("string")), "")
    return F.array(
        date, F.concat(date, F.lit("T"), two(8, 23), F.lit("-"), two(10, 58), F.lit("-"), two(12, 58)), uuid, F.substring(tens, 20, 20), counter,
        F.concat(F.replace(date, F.lit("-"), F.lit("")), F.lit("_"), two(8, 23), two(10, 58), two(12, 58)))


def train_markov(samples: DataFrame) -> list[float]:
    """Log ratio of the two transition models, indexed by ``first * 128 + second``.

    ``samples(token, random)``: null and one-character tokens carry no pair and
    count for nothing; characters outside ASCII count as code 0. Without any
    sample every ratio is zero and no run scores above it.
    """
    chars = F.transform(F.split("token", ""), lambda c: F.when(F.ascii(c) < CODES, F.ascii(c)).otherwise(0))
    pairs = samples.filter("token IS NOT NULL AND random IS NOT NULL").select("random", chars.alias("_c")).select(
        "random", F.explode(F.zip_with("_c", F.slice("_c", 2, F.greatest(F.size("_c") - 1, F.lit(0))), lambda a, b: a * CODES + b)).alias("pair"),
    ).filter("pair IS NOT NULL")
    rows = pairs.groupBy("random", "pair").count().collect()  # 2 x 128 x 128 rows at most
    used = sorted({code for r in rows for code in divmod(r["pair"], CODES)})
    model = {label: _transitions({r["pair"]: r["count"] for r in rows if r["random"] == label}, used) for label in (True, False)}
    ratios = [0.0] * (CODES * CODES)
    for first in used:
        for second in used:
            ratios[first * CODES + second] = round(model[True](first, second) - model[False](first, second), 4)
    return ratios


def _transitions(counts: dict[int, int], used: list[int]):
    """Log probability of a character after another; rare first characters lean on the second one's own frequency."""
    starts, ends = {}, {}
    for pair, n in counts.items():
        starts[pair // CODES] = starts.get(pair // CODES, 0) + n
        ends[pair % CODES] = ends.get(pair % CODES, 0) + n
    total, size = sum(counts.values()), len(used)

    def log_probability(first: int, second: int) -> float:
        alone = (ends.get(second, 0) + 0.5) / (total + 0.5 * size)
        after = (counts.get(first * CODES + second, 0) + PRIOR * alone) / (starts.get(first, 0) + PRIOR)
        return math.log((1 - SHARE) * after + SHARE * alone)

    return log_probability


def randomness(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio over the token's character pairs; ASCII tokens."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.least(F.ascii(c), F.lit(CODES - 1)))

    def step(state, code):
        known = F.element_at(table, F.greatest(state["last"], F.lit(0)) * CODES + code + 1)
        return F.struct(code.alias("last"), (state["sum"] + F.when(state["last"] >= 0, known).otherwise(0.0)).alias("sum"))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(codes, start, step, lambda s: s["sum"]) / F.greatest(F.char_length(token) - 1, F.lit(1))


def _of_kind(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end"), F.lit(None).cast("double").alias("score")))


def _long_value(span: Column) -> Column:
    return F.char_length(F.regexp_extract(span["hit"], ASSIGN, 2)) >= 6


def _masked(text: Column, assigns: Column, known: Column) -> Column:
    """The text with every base span masked, each character by one mark, so that places stay.

    ``known`` tells whether the text has access or hex spans at all.
    """
    head = F.array_join(F.transform(assigns, lambda s: F.concat(
        s["gap"], F.when(_long_value(s), F.repeat(F.lit(MASK), F.char_length(s["hit"]))).otherwise(s["hit"]))), "")
    rest = F.when(F.size(assigns) > 0, F.concat(head, F.get(assigns, F.size(assigns) - 1)["rest"])).otherwise(text)
    # A character of a long run: the run starts here, or the one before was masked just now.
    access = F.regexp_replace(rest, r"(?:(?=AKIA[A-Z0-9]{16})|(?!^)\G)[A-Z0-9]", MASK)
    return F.when(known, F.regexp_replace(access, r"(?:(?=[0-9a-f]{24})|(?!^)\G)[0-9a-f]", MASK)).otherwise(rest)


def find_secrets(
    docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``(id_col, secrets array<struct<start, kind, end, score>>)``, one row per input row.

    ``kind`` indexes ``KINDS``; ``score`` is the log-likelihood ratio of the
    model's own spans and null for the base formats. The model scores what the
    base spans leave free of each run, if that has 16 characters or more. Null
    texts count as empty; null ids and repeated rows pass through; other
    columns are dropped. The cost is linear in the matches of a text, which may
    be very long.
    """
    def scan(text: Column) -> Column:
        found = F.struct(
            match_spans(text, ASSIGN).alias("assign"), _of_kind(match_spans(text, ACCESS), 1).alias("access"),
            _of_kind(match_spans(text, HEX), 2).alias("hex"))
        return bound(found, lambda f: _with_runs(text, f))

    def _with_runs(text: Column, f: Column) -> Column:
        masked = _masked(text, f["assign"], F.size(f["access"]) + F.size(f["hex"]) > 0)
        runs = bound(masked, lambda m: F.transform(match_spans(m, CANDIDATE), lambda s: F.struct(
            s["start"].alias("start"), F.lit(BASE_KINDS).alias("kind"), s["end"].alias("end"), randomness(s["hit"], ratios).alias("score"))))
        assigns = _of_kind(F.filter(f["assign"], _long_value), 0)
        return F.array_sort(F.concat(assigns, f["access"], f["hex"], F.filter(runs, lambda r: r["score"] >= threshold)))

    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    return rows.select(id_col, bound(F.col("_text"), scan).alias("secrets"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans and the list of all spans."""
    base = F.filter("secrets", lambda s: s["kind"] < BASE_KINDS)
    counts = [count_kind("secrets", i).alias(f"n_{KINDS[i]}") for i in range(BASE_KINDS)]
    return found.select(
        id_col, *counts, F.sha2(span_text(base, KINDS), 256).alias("base_sha256"), span_text(F.col("secrets"), KINDS).alias("spans"))
