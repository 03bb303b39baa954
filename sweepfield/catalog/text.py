"""Queries over page texts and replies."""

from pyspark.sql import functions as F

from sweepfield.catalog.registry import register
from sweepfield.operators import text


@register("assemble_text", """SELECT document, string_agg(chr(10) || '=== 第 ' || (page + 1) || ' 页 ===' || chr(10) || text || chr(10), '' ORDER BY page) AS text FROM pages_text GROUP BY ALL""")
def _(t):
    return text.assemble_text(t.pages_text())


@register("first_chars", "SELECT doc_id, substring(text, 1, 5000) AS head FROM documents")
def _(t):
    return t.table("documents").select("doc_id", text.first_chars(F.col("text")).alias("head"))


@register("reply_dict", """SELECT doc_id AS reply_id, (n_chars % 97)::VARCHAR AS x, source AS y, 'unknown' AS z, 'unknown' AS unit, lang AS note FROM documents""")
def _(t):
    found = t.replies().select("reply_id", text.reply_dict(F.col("reply"), "parameters").alias("d"))
    return found.select("reply_id", *[F.element_at("d", k).alias(n) for k, n in (("X", "x"), ("Y", "y"), ("Z", "z"), ("Unit", "unit"), ("note", "note"))])


@register("fill_defaults", """SELECT doc_id AS reply_id, (n_chars % 97)::DOUBLE AS x, CASE WHEN doc_id % 3 = 0 THEN 2.5::DOUBLE ELSE TRY_CAST(source AS DOUBLE) END AS y, 1.6::DOUBLE AS z FROM documents""")
def _(t):
    found = t.replies().select("reply_id", text.reply_dict(F.col("reply"), "parameters").alias("d"))
    sizes = text.fill_defaults(F.col("d"), {"Y": F.when(F.col("reply_id") % 3 == 0, F.lit(2.5))})
    return found.select("reply_id", *[v.alias(k.lower()) for k, v in sizes.items()])


def mixed_replies(t):
    """Event properties inside prose, fences and broken braces."""
    k = F.col("event_id") % 4
    body = (
        F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n``` and "), "props"))
        .when(k == 2, F.concat(F.lit("{broken} then "), "props", F.lit(" {\"open\": ")))
        .when(F.col("event_id") % 8 == 3, F.concat(F.lit("never closed {\"open\": "), "props")).otherwise(F.concat(F.lit("a stray } and \" then "), "props"))
    )
    return t.table("events").select(F.col("event_id").alias("reply_id"), body.alias("reply"))


@register("reply_objects", """SELECT event_id AS reply_id, unnest(CASE WHEN event_id % 4 = 1 THEN [0, 1] WHEN event_id % 8 = 3 THEN []::INTEGER[] ELSE [0] END)::BIGINT AS position, props AS object FROM events""")
def _(t):
    return text.reply_objects(mixed_replies(t)).withColumn("position", F.col("position").cast("long"))


@register("route_replies", """SELECT event_id AS reply_id, CASE WHEN event_id % 8 = 3 THEN 'no JSON object' ELSE 'good' END AS route, CASE WHEN event_id % 8 <> 3 THEN props END AS object FROM events""")
def _(t):
    judged = text.judged_replies(mixed_replies(t), ["k"])
    good = F.col("reason").isNull()
    return judged.select("reply_id", F.coalesce("reason", F.lit("good")).alias("route"), F.when(good, F.col("object")).alias("object"))


@register("first_match", """SELECT document, min(page) FILTER (length(text) > 120) AS page, arg_min(text, page) FILTER (length(text) > 120) AS text FROM pages_text GROUP BY document""")
def _(t):
    items = t.pages_text().withColumn("flag", F.length("text") > 120)
    return text.first_match(items, ["page"], "flag", ["document"])
