"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Everything is a projection of one row: no shuffle, no Python. The spans of a
kind are the leftmost non-overlapping matches of its pattern; a validator then
keeps or drops each of them. Scores start from the kind's prior and move up
when a telling word stands in the few dozen characters before or behind the
match. A text may hold any number of matches: the cost is linear in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepfield.functions.arrays import bound
from sweepfield.llm.common import count_kind, match_spans, span_text, text_of

# The kinds in the order they are listed.
KINDS = ["email", "ip", "card", "phone", "iban"]
BASE_KINDS = 4
# The patterns of the contract. Possessive repeats and the look
# behind keep long runs linear; they match the same spans. ``\G`` lets a match
# start right where the last one ended.
# Account numbers take their country's own length, so that words and numbers
# behind them stay outside; of other countries the valid beginning is taken.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR",
    27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC",
    32: "LC", 33: "RU",
}
IBAN_KNOWN = "|".join(IBAN_SIZES.values())
IBAN = "|".join(
    [rf"(?:{names})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{size - 4}}}+" for size, names in IBAN_SIZES.items()]
    + [rf"(?!{IBAN_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!(?:{IBAN_KNOWN})[0-9]{{2}}))?[A-Z0-9]){{11,30}}"])
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})(?![A-Za-z0-9])",
}
PRIORS = {"email": 0.85, "ip": 0.6, "card": 0.8, "phone": 0.65, "iban": 0.9}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|address)",
    "ip": r"(?i)(?:\bip\b|host|server|login|address|from)",
    "card": r"(?i)(?:card|visa|credit|debit|payment|pay)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|contact)",
    "iban": r"(?i)(?:iban|account|bank|transfer)",
}
CONTEXT_CHARS, CONTEXT_PAIRS, CONTEXT_GAIN = 48, 16, 0.1


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    """Luhn checksum of a digit string, whole result in one fold from the right."""
    terms = F.transform(
        F.reverse(F.split(digits, "")),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(terms, F.lit(0), lambda a, t: a + t) % 10 == 0


def mod97_valid(hit: Column) -> Column:
    """Account check: first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))

    def fold(rest, c):
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    remainder = F.aggregate(F.split(turned, ""), F.lit(0), fold)
    return F.char_length(plain).between(15, 34) & (remainder == 1)


def account_in(hit: Column) -> Column:
    """The hit when its check holds, else the longest beginning before a space whose check holds, else null.

    Countries of a known length match at that length only.
    """
    begins = F.transform(F.sequence(F.char_length(hit), F.lit(15), F.lit(-1)), lambda n: F.substring(hit, F.lit(1), n))
    border = lambda b: F.substring(hit, F.char_length(b) + 1, F.lit(1)).isin("", " ") & ~F.endswith(b, F.lit(" "))
    shorter = F.get(F.filter(begins, lambda b: border(b) & mod97_valid(b)), F.lit(0))
    return F.when(mod97_valid(hit), hit).when(~F.rlike(hit, F.lit(f"^(?:{IBAN_KNOWN})")), shorter)


def _accounts(spans: Column) -> Column:
    """The spans cut to the account number they begin with; the others dropped."""
    held = F.transform(spans, lambda s: s.withField("own", account_in(s["hit"])))
    return F.transform(F.filter(held, lambda s: s["own"].isNotNull()), lambda s: s.withField(
        "end", s["start"] + F.char_length(s["own"])).withField("behind", F.substring(s["hit"], F.char_length(s["own"]) + 1, F.lit(CONTEXT_CHARS))))


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(
            F.split(hit, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        digits = digits_of(hit)
        return F.when(F.char_length(digits).between(12, 19), luhn_valid(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits_of(hit)).between(9, 15)
    return F.lit(True)


def _around(spans: Column, s: Column) -> Column:
    """The characters before and behind one of ``spans``, a line between them.

    A match and the text up to the next one have three characters or more, so
    ``CONTEXT_PAIRS`` neighbours hold all that is looked at.
    """
    first = F.greatest(s["at"] - CONTEXT_PAIRS, F.lit(0))
    before = F.transform(F.slice(spans, first + 1, s["at"] - first), lambda p: F.concat(p["gap"], p["hit"]))
    after = F.transform(F.slice(spans, s["at"] + 2, CONTEXT_PAIRS), lambda p: F.concat(p["hit"], p["rest"]))
    return F.concat(
        F.right(F.concat(F.array_join(before, ""), s["gap"]), F.lit(CONTEXT_CHARS)), F.lit("\n"),
        F.left(F.concat(s["behind"], s["rest"], F.array_join(after, "")), F.lit(CONTEXT_CHARS)))


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind with their scores."""
    rank = KINDS.index(kind)

    def confirmed(spans: Column) -> Column:
        numbered = F.transform(spans, lambda s, i: s.withField("at", i).withField("own", s["hit"]).withField("behind", F.lit("")))
        kept = _accounts(numbered) if kind == "iban" else F.filter(numbered, lambda s: _valid(kind, s["hit"]))
        return F.transform(kept, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end"),
            (F.lit(PRIORS[kind]) + F.when(F.rlike(_around(spans, s), F.lit(CONTEXT[kind])), CONTEXT_GAIN).otherwise(0.0)).alias("score"),
            s["own"].alias("hit")))

    return bound(match_spans(text, PATTERNS[kind]), confirmed)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, pii array<struct<start, kind, end, score, hit>>)``, one row per input row.

    Sorted by start, then kind. ``kind`` indexes ``KINDS``. Null texts count
    as empty and give an empty array; null ids and repeated rows pass through;
    other columns are dropped, so their names never clash.
    """
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    return rows.select(id_col, F.array_sort(F.concat(*[_spans(F.col("_text"), k) for k in KINDS])).alias("pii"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Spans as rows: ``(id_col, kind, start, end, score, hit)`` above a score."""
    found = find_personal_data(docs, id_col, text_col)
    names = F.array(*[F.lit(k) for k in KINDS])
    return found.select(id_col, F.inline("pii")).filter(F.col("score") >= threshold).select(
        id_col, F.element_at(names, F.col("kind") + 1).alias("kind"), "start", "end", "score", "hit")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans, the list of all spans and their scores in per cent, in the same order."""
    base = F.filter("pii", lambda s: s["kind"] < BASE_KINDS)
    counts = [count_kind("pii", i).alias(f"n_{KINDS[i]}") for i in range(BASE_KINDS)]
    return found.select(
        id_col, *counts, F.sha2(span_text(base, KINDS), 256).alias("base_sha256"), span_text(F.col("pii"), KINDS).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"))
