"""Page texts and model replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepfield.functions.arrays import bound, fold_collect

# Page marker, required reply keys and fall-back sizes.
PAGE_MARK = "\n=== 第 {} 页 ===\n"
REQUIRED_KEYS = ["X", "Y", "Z", "Unit"]
DEFAULT_SIZES = {"X": 6.6, "Y": 6.6, "Z": 1.6}


def assemble_text(pages: DataFrame) -> DataFrame:
    """Page texts in order, each under its marker: ``pages(document, page, text)``, pages from 0.

    One row per document at every size; its text has to fit into a row.
    """
    before, after = PAGE_MARK.split("{}")
    block = F.concat(F.lit(before), (F.col("page") + 1).cast("string"), F.lit(after), "text", F.lit("\n"))
    entries = F.array_sort(F.collect_list(F.struct("page", block.alias("block"))))
    return pages.groupBy("document").agg(
        F.array_join(F.transform(entries, lambda e: e["block"]), "").alias("text")
    )


def first_chars(text: Column, n: int = 5000) -> Column:
    """The first ``n`` characters: this operator is the prefix itself."""
    return F.substring(text, 1, n)


def reply_dict(text: Column, name: str = "fss_size", legacy: str | None = None) -> Column:
    """Map of the first ``name = {…}`` in a reply, required keys filled with 'unknown'.

    The dictionary ends at the first closing brace. Null when none is found;
    ``legacy`` is tried second.
    """
    found = lambda n: F.nullif(F.regexp_extract(text, rf"(?s){n}\s*=\s*(\{{.*?\}})", 1), F.lit(""))
    body = F.coalesce(found(name), found(legacy)) if legacy else found(name)
    pair = r"""['"]([^'"]+)['"]\s*:\s*(?:'([^']*)'|"([^"]*)"|([^,}'"]+))"""
    take = lambda group: F.regexp_extract_all(body, F.lit(pair), F.lit(group))
    # Exactly one of the three value groups is set.
    values = F.transform(
        F.arrays_zip(take(2).alias("a"), take(3).alias("b"), take(4).alias("c")),
        lambda z: F.concat(z["a"], z["b"], F.trim(z["c"])),
    )
    pairs = F.map_from_entries(
        F.filter(F.arrays_zip(take(1).alias("k"), values.alias("v")), lambda e: e["k"].isNotNull())
    )
    missing = F.filter(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), lambda k: ~F.array_contains(F.map_keys(pairs), k))
    fill = F.map_from_arrays(missing, F.transform(missing, lambda _: F.lit("unknown")))
    return F.when(body.isNotNull(), F.map_concat(pairs, fill))


def fill_defaults(sizes: Column, overrides: dict[str, Column] | None = None) -> dict[str, Column]:
    """Numbers for X, Y and Z: an override first, then the reply, then the default for 'unknown'."""
    out = {}
    for key, default in DEFAULT_SIZES.items():
        raw = F.element_at(sizes, key)
        value = F.when(raw == "unknown", F.lit(default)).otherwise(raw.try_cast("double"))
        given = (overrides or {}).get(key)
        out[key] = F.coalesce(given, value) if given is not None else value
    return out


# What the brace count depends on: an escaped character, a quote, a brace.
_MARKS = r'\\[\s\S]|["{}]'


def _objects(reply: Column) -> Column:
    """Balanced top-level JSON objects of a text, in order; unreadable ones are left out.

    The marks of the text and the stretches between them are folded once, in
    blocks: the state knows the mark's number, the brace depth and whether a
    string is open. An object is joined from the marks and stretches it spans,
    so its place in the text costs nothing.
    """
    text = F.regexp_replace(reply, "```(json)?", "")
    marks, gaps = F.regexp_extract_all(text, F.lit(_MARKS), F.lit(0)), F.split(text, _MARKS, -1)
    steps = F.filter(F.zip_with(marks, gaps, lambda m, g: F.struct(m.alias("mark"), g.alias("gap"))), lambda s: s["mark"].isNotNull())
    spans = "array<struct<first:int,size:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("open"))

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        # Outside strings a backslash escapes nothing.
        sign = F.when(state["quoted"], s["mark"]).otherwise(F.right(s["mark"], F.lit(1)))
        inside = state["depth"] > 0
        opens, closes = ~state["quoted"] & (sign == "{"), ~state["quoted"] & inside & (sign == "}")
        first = F.when(opens & ~inside, state["at"]).otherwise(state["open"])
        after = F.struct(
            (state["at"] + 1).alias("at"), (state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(inside & (sign == '"'), ~state["quoted"]).otherwise(state["quoted"]).alias("quoted"), first.alias("open"))
        span = F.struct(state["open"].alias("first"), (state["at"] - state["open"]).alias("size"))
        return after, F.when(closes & (state["depth"] == 1), F.array(span)).otherwise(F.array().cast(spans))

    def pieces(all_steps: Column) -> Column:
        inner = lambda s: F.transform(
            F.slice(all_steps, s["first"] + 2, s["size"]), lambda t: F.concat(t["gap"], t["mark"]))
        return F.transform(fold_collect(all_steps, start, step, spans), lambda s: F.concat(F.lit("{"), F.array_join(inner(s), "")))

    found = F.coalesce(bound(steps, pieces), F.array().cast("array<string>"))
    return F.filter(found, lambda p: F.json_object_keys(p).isNotNull())


def reply_objects(replies: DataFrame, text: str = "reply") -> DataFrame:
    """One row per JSON object found in each reply, in order."""
    kept = [c for c in replies.columns if c != text]
    # The outer form: for the inner one Catalyst computes the array twice.
    found = replies.select(*kept, F.posexplode_outer(_objects(F.col(text))).alias("position", "object"))
    return found.filter("object IS NOT NULL")


def judged_replies(replies: DataFrame, required: list[str], text: str = "reply") -> DataFrame:
    """Each reply with its ``object`` and the ``reason`` why it is not usable, null for usable ones.

    The whole reply counts first, else its first embedded object; usable means
    a JSON object that holds all ``required`` keys.
    """
    is_object = lambda v: F.coalesce(F.schema_of_variant(F.try_parse_json(v)).startswith("OBJECT"), F.lit(False))
    stripped = F.trim(F.regexp_replace(F.col(text), "```(json)?", ""))
    # Only replies that are no object as a whole are scanned for one.
    found = bound(stripped, lambda v: F.when(is_object(v), v).otherwise(F.get(_objects(F.col(text)), F.lit(0))))
    fits = lambda v: bound(F.try_parse_json(v), lambda j: reduce(
        lambda a, b: a & b, [F.try_variant_get(j, f"$.{k}", "variant").isNotNull() for k in required], j.isNotNull()
    ))
    # Object and verdict are one value, so that a filter on either finds both by one scan.
    verdict = bound(found, lambda v: F.struct(
        v.alias("object"), F.when(v.isNull(), "no JSON object").when(~F.coalesce(fits(v), F.lit(False)), "missing keys").alias("reason")))
    return replies.select("*", verdict.alias("_v")).select(*replies.columns, F.col("_v.object").alias("object"), F.col("_v.reason").alias("reason"))


def route_replies(replies: DataFrame, required: list[str], text: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Replies with a usable object, and the failures with their raw text, as ``judged_replies`` finds them.

    Each of the two reads the replies; what needs both takes ``judged_replies``.
    """
    judged = judged_replies(replies, required, text)
    good = judged.filter("reason IS NULL").drop("reason", text)
    bad = judged.filter("reason IS NOT NULL").select(*replies.columns, "reason")
    return good, bad


def first_match(items: DataFrame, order: list[str], flag: str, keys: list[str]) -> DataFrame:
    """First flagged item of each group in order, null when none is flagged."""
    rest = [c for c in items.columns if c not in (*keys, flag)]
    record = F.when(F.col(flag), F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order]))
    found = items.groupBy(*keys).agg(F.min_by(record, F.when(F.col(flag), F.struct(*order))).alias("m"))
    return found.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])
