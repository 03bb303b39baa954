"""Chat formatting: typed content parts flattened into one marked-up string.

A message is a list of parts. The visitor below has one rule per part type:
text is escaped, the other types become a placeholder with a running number,
an entry in the attachment list and an expanded token count. Turns are then
framed by the template. Every control string that stands inside a text is
broken by an escape mark first, so the output parses back without doubt.
All of it is DataFrame functions; one shuffle groups the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepfield.functions.arrays import fold_collect
from sweepfield.llm.common import text_of

# The template. Each turn is OPEN, role, HEAD, content, CLOSE.
OPEN, HEAD, CLOSE = "<|turn|>", "<|says|>", "</s>"
BEGIN = "<s>"
MEDIA = ["image", "audio", "document"]
PLACEHOLDER = "<|{0}|>"
# Strings that mean something to this template or to common others. None has
# another one's first character inside, so breaking after the first is enough.
CONTROLS = [
    OPEN, HEAD, CLOSE, BEGIN, *[PLACEHOLDER.format(m) for m in MEDIA], "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<unk>", "<pad>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>",
]
MARK = "␛"  # SYMBOL FOR ESCAPE
TOKENS = {"image": 256, "audio": 50, "document": 128}  # default tokens per unit of each type
PART = "struct<type:string,text:string,ref:string,units:long>"
_ANY = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)


def escape(text: Column) -> Column:
    """Break every control string; ``unescape`` restores the text exactly."""
    marked = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    return F.regexp_replace(marked, rf"([<\[])(?={_ANY})", f"$1{MARK}1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK + "1"), F.lit("")), F.lit(MARK + "0"), F.lit(MARK))


def visit(part: Column) -> Column:
    """One part as ``struct<content, ref, tokens>`` by its type; unknown types count as text."""
    shown, tokens = escape(F.coalesce(part["text"], F.lit(""))), F.lit(0).cast("long")
    units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))
    for media in MEDIA:
        hit = part["type"] == media
        shown = F.when(hit, F.lit(PLACEHOLDER.format(media))).otherwise(shown)
        tokens = F.when(hit, units * TOKENS[media]).otherwise(tokens)
    ref = F.when(part["type"].isin(MEDIA), F.struct(part["type"].alias("type"), part["ref"].alias("ref"), tokens.alias("tokens")))
    return F.struct(shown.alias("content"), ref.alias("ref"), tokens.alias("tokens"))


def text_parts(text: str = "text") -> Column:
    """A plain text column as a list with one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text_of(text).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("long").alias("units")))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts",
    trained: str = "assistant",
) -> DataFrame:
    """``(conv_col, formatted, loss, attachments, media_tokens)``, one row per conversation.

    ``loss`` lists code point spans (``start``, ``length``) of the contents of
    ``trained`` turns, in order. ``attachments`` lists (type, ref, tokens) in
    the order of the placeholders. Turns go by number; ties and repeated rows
    by role and content, all kept. Null roles count as the empty role, null
    part lists as no parts, null conversation ids form one group. Other
    columns are dropped. A conversation is one output string, so it has to
    fit into one row.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    seen = turns.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("turn"), escape(F.coalesce(F.col(role_col), F.lit(""))).alias("role"),
        F.transform(parts, visit).alias("_seen"),
    ).select(
        "_conv", "turn", "role", F.array_join(F.transform("_seen", lambda v: v["content"]), "").alias("content"),
        F.filter(F.transform("_seen", lambda v: v["ref"]), lambda r: r.isNotNull()).alias("refs"),
    )
    grouped = seen.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "refs"))).alias("_turns"))
    framed = grouped.select("_conv", "_turns", F.transform("_turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), t["role"], F.lit(HEAD)).alias("head"), t["content"].alias("content"),
        (t["role"] == trained).alias("trained"))).alias("_framed"))
    span = "array<struct<start:long,length:long>>"

    def step(at, t):
        first = at + F.char_length(t["head"])
        size = F.char_length(t["content"]).cast("long")
        own = F.array(F.struct(first.alias("start"), size.alias("length")))
        return first + size + len(CLOSE), F.when(t["trained"], own).otherwise(F.array().cast(span))

    loss = fold_collect(F.col("_framed"), F.lit(len(BEGIN)).cast("long"), step, span)
    refs = F.flatten(F.transform("_turns", lambda t: t["refs"]))
    return framed.select(
        F.col("_conv").alias(conv_col),
        F.concat(F.lit(BEGIN), F.array_join(F.transform("_framed", lambda t: F.concat(t["head"], t["content"], F.lit(CLOSE))), "")).alias("formatted"),
        loss.alias("loss"),
        refs.alias("attachments"),
    ).select("*", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, r: a + r["tokens"]).alias("media_tokens"))


def parse_chats(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Turns read back from the output: ``(conv_col, turns array<struct<role, text>>, trained_text)``."""
    frames = F.slice(F.split("formatted", OPEN.replace("|", r"\|"), -1), 2, 1_000_000_000)
    turns = F.transform(frames, lambda f: F.struct(
        unescape(F.substring_index(f, HEAD, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(f, HEAD, -1), CLOSE, 1)).alias("text")))
    masked = F.array_join(F.transform(
        "loss", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    return formatted.select(conv_col, "formatted", turns.alias("turns"), masked.alias("trained_text"))


def digest(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The contract's columns, all read back from ``formatted`` and its loss spans."""
    read = parse_chats(formatted, conv_col)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("trained_text").cast("long").alias("loss_chars"), F.sha2("trained_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
