"""Queries over sources, payloads, repair and the streaming log."""

import uuid

from pyspark.sql import functions as F

from sweepfield.catalog.contours import r
from sweepfield.catalog.registry import register
from sweepfield.catalog.trials import FILES
from sweepfield.catalog.validation import LOOPS, loop_points
from sweepfield.functions.numeric import rounded
from sweepfield.operators import repair
from sweepfield.session import shared_folder
from sweepfield.sources import payloads, sinks, sweeps
from sweepfield.streaming import trials as streaming


def lines(t):
    """Curves as text lines in three export shapes, by design."""
    c = F.col
    f, v, k = c("freq").cast("decimal(18,6)").cast("string"), c("value").cast("decimal(18,2)").cast("string"), c("design_id") % 3
    level = ((c("event_id") % 90 + 10) / 100).cast("decimal(4,2)").cast("string")
    micros = F.unix_micros(c("ts").cast("timestamp"))
    rows = t.table("events").select(
        c("user_id").alias("design_id"), "event_id", "ts", ((micros - 1704067200000000) / 3600000000.0).alias("freq"), (-c("value")).alias("value")
    )
    # A literal list stands over many lines, each tuple over two.
    tuple_lines = F.array(F.concat(F.lit("("), f, F.lit(",")), F.concat(F.lit("  ("), level, F.lit("-0.00j), 50.0),")))
    marked = rows.select(
        c("design_id").alias("design"), c("event_id").alias("line_no"),
        F.explode(F.when(k == 0, tuple_lines).when(k == 1, F.array(F.concat(f, F.lit(";"), v))).otherwise(
            F.array(F.concat(F.lit("f="), f, F.lit(" GHz, level "), v, F.lit(" dB"))))).alias("value"))
    ends = rows.select("design_id").distinct().filter(k == 0).select(
        c("design_id").alias("design"), F.inline(F.array(
            F.struct(F.lit(-1).cast("long").alias("line_no"), F.lit("[").alias("value")),
            F.struct(F.lit(2**62).alias("line_no"), F.lit("]").alias("value")))))
    return marked.unionByName(ends)


@register("read_sweeps", """SELECT user_id::VARCHAR AS path, ((epoch_us(ts) - 1704067200000000) / 3600000000.0::DOUBLE)::DECIMAL(18, 6)::DOUBLE AS freq,
    CASE WHEN user_id % 3 = 0 THEN round(20 * log10((event_id % 90 + 10) / 100.0::DOUBLE), 3) ELSE -value END AS value FROM events""")
def _(t):
    # One file per design in the shared folder, read back as any export is.
    folder = f"{shared_folder(t.spark)}/sweeps-{uuid.uuid4().hex}"
    rows = lines(t).repartition("design").sortWithinPartitions("design", "line_no", F.desc("value"))
    rows.select("design", "value").write.options(**sinks.MOVED_BY_TASKS).partitionBy("design").text(folder)
    out = sweeps.read_sweeps(t.spark, folder).withColumn("path", F.regexp_extract("path", "design=([0-9]+)", 1))
    return out.select("path", rounded(F.col("freq")).alias("freq"), rounded(F.col("value"), 3).alias("value"))


@register("latest_file_per_group", """WITH f AS (SELECT user_id, '/out/' || user_id || '/' || ['s11.csv', 'A_S11_b.txt', 'xs11.csv', 's21.csv', 's11.json'][1 + event_id % 5] AS path, ts, event_id FROM events)
    SELECT user_id, arg_max(path, ts) AS path FROM f WHERE event_id % 5 < 3 GROUP BY user_id""")
def _(t):
    names = F.array(*[F.lit(n) for n in ("s11.csv", "A_S11_b.txt", "xs11.csv", "s21.csv", "s11.json")])
    files = t.table("events").select(
        "user_id", F.col("ts").alias("mtime"),
        F.concat(F.lit("/out/"), F.col("user_id").cast("string"), F.lit("/"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))).alias("path"),
    )
    return sweeps.latest_file_per_group(files, ["user_id"]).select("user_id", "path")


HISTORY = """SELECT o_orderkey AS iteration, printf('%.6f', o_totalprice) AS patch_length, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE printf('%.9f', o_totalprice) END AS f_resonance,
    '' AS min_s11, printf('%.9f', o_custkey::DOUBLE) AS objective_value, o_orderstatus AS status, printf('%.3f', o_totalprice) AS simulation_time FROM orders"""


def history(t):
    c = F.col
    return t.table("orders").select(
        c("o_orderkey").alias("iteration"), c("o_totalprice").alias("patch_length"), F.when(c("o_orderkey") % 5 != 0, c("o_totalprice")).alias("f_resonance"),
        F.lit(None).cast("double").alias("min_s11"), c("o_custkey").cast("double").alias("objective_value"), c("o_orderstatus").alias("status"), c("o_totalprice").alias("simulation_time"),
    )


@register("history_rows", HISTORY)
def _(t):
    return sinks.history_rows(history(t))


@register("write_history", HISTORY)
def _(t):
    folder = f"{shared_folder(t.spark)}/history-{uuid.uuid4().hex}"
    # Written in two goes, as a log grows, and read back from the files.
    for part in (0, 1):
        sinks.write_history(history(t).filter(F.col("iteration") % 2 == part), folder)
    names = list(sinks.HISTORY)
    back = t.spark.read.option("header", "true").schema("iteration bigint, " + ", ".join(f"{n} string" for n in names[1:])).csv(folder)
    return back.select("iteration", *[F.coalesce(n, F.lit("")).alias(n) for n in names[1:]])


@register("write_json_records", """SELECT CASE status WHEN 'failed' THEN 'failed' ELSE 'success' END AS kind, count(*) AS records, sum(trial_id)::BIGINT AS ids,
    max(CASE WHEN status = 'failed' THEN status END) AS error_message FROM trials GROUP BY 1""")
def _(t):
    c = F.col
    rows = t.trials().select(
        c("trial_id").alias("iteration"), c("objective").alias("patch_length"), c("objective").alias("f_resonance"), c("objective").alias("min_s11"),
        c("objective").alias("objective_value"), "status", *[F.lit(None).cast("string").alias(n) for n in ("json_path", "s11_path", "error_message")],
    )
    folder = f"{shared_folder(t.spark)}/records-{uuid.uuid4().hex}"
    sinks.write_json_records(rows, folder)
    text = "iteration bigint, error_message string"
    back = [t.spark.read.schema(text).json(f"{folder}/{kind}").withColumn("kind", F.lit(kind)) for kind in ("success", "failed")]
    return back[0].unionByName(back[1]).groupBy("kind").agg(
        F.count(F.lit(1)).alias("records"), F.sum("iteration").alias("ids"), F.max("error_message").alias("error_message")
    )


# Payload text per outline: points under a key that varies, one malformed point, two segments and a hole.
def payload_texts(embeddings):
    k = F.col("vec_id")
    e = F.col("embedding")
    number = lambda i: F.get(e, i).cast("double").cast("string")
    pair = lambda i: F.concat(F.lit("["), number(i * 2), F.lit(", "), number(i * 2 + 1), F.lit("]"))
    listed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), pair), ", ")
    name = F.when(k % 3 == 0, "resampled_points").when(k % 3 == 1, "fallback_points").otherwise("points")
    doc = F.concat(
        F.lit('{"canvas": {"width": 10, "height": 8}, "components": [{"component_id": '), k.cast("string"), F.lit(', "closed": true, "resampled_points": [], "'),
        name, F.lit('": [["bad", 1], '), listed, F.lit('], "segments": [{"type": "Line", "start": [0, 1], "end": [2, 3]}, {"kind": "b-spline", "start_idx": 4, "end_idx": 2}], '),
        F.lit('"holes": [{"id": "h", "points": [[0, 0], [1, 0], [1, 1], [0, 0]]}, {"points": [[0, 0]]}]}]}'),
    )
    return embeddings.select(k.alias("design_id"), doc.alias("doc"))


def loaded(t):
    return payloads.parse_payloads(payload_texts(t.table("embeddings")), "doc")


@register("explode_points", "SELECT contour_id AS design_id, 0::BIGINT AS comp, idx, round(x, 6) AS x, round(y, 6) AS y FROM contours")
def _(t):
    return payloads.explode_points(loaded(t)).select("design_id", F.col("comp").cast("long").alias("comp"), "idx", *r("x", "y"))


@register("load_payloads", """SELECT vec_id AS design_id, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS component_count, coalesce(n, 0)::BIGINT AS points, low
    FROM embeddings LEFT JOIN (SELECT contour_id, count(*) AS n, round(min(x), 6) AS low FROM contours WHERE contour_id % 7 <> 0 GROUP BY contour_id) ON contour_id = vec_id""")
def _(t):
    folder = f"{shared_folder(t.spark)}/payloads-{uuid.uuid4().hex}"
    # One file per design; every seventh is no JSON object, or empty.
    broken = F.when(F.col("design_id") % 14 == 0, "").when(F.col("design_id") % 7 == 0, "[1, 2").otherwise(F.col("doc"))
    # A table may come in few row groups: the rows are dealt out before they grow into texts.
    texts = payload_texts(t.table("embeddings").repartition("vec_id"))
    payloads.write_payloads(texts.select("design_id", broken.alias("doc")), folder)
    payload = payloads.load_payloads(t.spark, folder).withColumn("design_id", F.regexp_extract("design_id", r"design_id=(\d+)", 1).cast("long"))
    points = payloads.explode_points(payload).groupBy("design_id").agg(F.count(F.lit(1)).alias("points"), F.min("x").alias("low"))
    return payloads.parameterization_summary(payload).select("design_id", "component_count").join(points, "design_id", "left").select(
        "design_id", "component_count", F.coalesce("points", F.lit(0)).alias("points"), *r("low"))


@register("primitive_inventory", """WITH b AS (SELECT contour_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM contours WHERE idx BETWEEN 2 AND 4 GROUP BY contour_id)
    SELECT contour_id AS design_id, 'c' || contour_id || '_s0' AS primitive_id, 'LINE' AS type, 2::BIGINT AS points, 0.0::DOUBLE AS min_x, 3.0::DOUBLE AS max_y FROM b
    UNION ALL SELECT contour_id, 'c' || contour_id || '_s1', 'BSPLINE', 3, round(x0, 6), round(y1, 6) FROM b UNION ALL SELECT contour_id, 'c' || contour_id || '_h1', 'HOLE', 3, 0.0, 1.0 FROM b""")
def _(t):
    out = payloads.primitive_inventory(loaded(t))
    return out.select("design_id", "primitive_id", "type", F.size("points").cast("long").alias("points"), rounded(F.get("bbox", F.lit(0))).alias("min_x"), rounded(F.get("bbox", F.lit(3))).alias("max_y"))


@register("parameterization_summary", """SELECT vec_id AS design_id, 10.0::DOUBLE AS board_width, 1::BIGINT AS component_count, 2::BIGINT AS primitive_count, 2::BIGINT AS hole_count, false AS line_only FROM embeddings""")
def _(t):
    out = payloads.parameterization_summary(loaded(t))
    return out.select("design_id", F.get("board", F.lit(2)).alias("board_width"), "component_count", "primitive_count", "hole_count", "line_only")


@register("components_to_boundary", """SELECT contour_id AS design_id, idx, round(x, 6) + 0.0 AS x, round(8 - y, 6) AS y, 1::BIGINT AS holes FROM contours""")
def _(t):
    out = payloads.components_to_boundary(loaded(t))
    return out.select("design_id", F.size("holes").cast("long").alias("holes"), F.posexplode("outer").alias("idx", "p")).select(
        "design_id", F.col("idx").cast("long").alias("idx"), rounded(F.col("p.x")).alias("x"), rounded(F.col("p.y")).alias("y"), "holes"
    )


@register("boundary_to_components", """SELECT vec_id AS design_id, vec_id::VARCHAR AS geometry_id, 32::BIGINT AS points, 1::BIGINT AS holes FROM embeddings""")
def _(t):
    made = payloads.components_to_boundary(loaded(t))
    thin = F.array(F.named_struct(F.lit("id"), F.lit("thin"), F.lit("role"), F.lit("hole"), F.lit("vertices"), F.slice("outer", 1, 2)))
    doc = F.to_json(F.struct(F.array(F.struct(
        F.col("geometry_id").alias("id"), F.struct(F.col("outer").alias("vertices")).alias("outer_boundary"), F.concat("holes", thin).alias("holes")
    )).alias("geometries")))
    out = payloads.boundary_to_components(made.select("design_id", doc.alias("doc")), "doc")
    return out.select("design_id", "geometry_id", F.size("points").cast("long").alias("points"), F.size("holes").cast("long").alias("holes"))


@register("nested_number", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value + 1 WHEN 2 THEN 3.5::DOUBLE END AS gain FROM events""")
def _(t):
    k, v = F.col("event_id") % 4, F.col("value").cast("string")
    doc = (
        F.when(k == 0, F.concat(F.lit('{"a": {"gain": 1}, "Gain_dBi": '), v, F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"gain": "n/a", "list": [1, {"peak_gain_dbi": "'), (F.col("value") + 1).cast("string"), F.lit('"}], "z": {"gain": 9}}')))
        .when(k == 2, F.lit('{"deep": [{"x": {"gain": null}}, {"realized_gain_dbi": 3.5}]}')).otherwise("{broken")
    )
    rows = t.table("events").select("event_id", doc.alias("doc"))
    return rows.select("event_id", payloads.nested_number("doc").alias("gain"))


@register("drop_duplicates_kept", """WITH RECURSIVE w AS (SELECT contour_id, idx, x, y, x AS kx, y AS ky, true AS keep FROM contours WHERE idx = 0
      UNION ALL SELECT c.contour_id, c.idx, c.x, c.y, CASE WHEN sqrt((c.x - kx) ** 2 + (c.y - ky) ** 2) > 0.12 THEN c.x ELSE kx END, CASE WHEN sqrt((c.x - kx) ** 2 + (c.y - ky) ** 2) > 0.12 THEN c.y ELSE ky END,
        sqrt((c.x - kx) ** 2 + (c.y - ky) ** 2) > 0.12 FROM w JOIN contours c ON c.contour_id = w.contour_id AND c.idx = w.idx + 1)
    SELECT contour_id, idx FROM w WHERE keep""")
def _(t):
    return repair.drop_duplicates_kept(t.contours(), 0.12, t.spans("contours"), close=False).select("contour_id", "idx")


@register("repair_points", f"""WITH RECURSIVE {LOOPS},
    a AS (SELECT contour_id, idx, x, y, z, x AS kx, y AS ky, z AS kz, true AS keep FROM loop_points WHERE idx = 0
      UNION ALL SELECT contour_id, idx, x, y, z, CASE WHEN far THEN x ELSE kx END, CASE WHEN far THEN y ELSE ky END, CASE WHEN far THEN z ELSE kz END, far
      FROM (SELECT p.*, kx, ky, kz, sqrt((p.x - kx) ** 2 + (p.y - ky) ** 2 + (p.z - kz) ** 2) > 1e-9 AS far FROM a JOIN loop_points p ON p.contour_id = a.contour_id AND p.idx = a.idx + 1)),
    u AS (SELECT contour_id, idx, x, y, z, row_number() OVER (PARTITION BY contour_id ORDER BY idx) AS p, count(*) OVER (PARTITION BY contour_id) AS n1 FROM a WHERE keep),
    b AS (SELECT contour_id, idx, x, y, z, p, n1, x AS kx, y AS ky, true AS keep FROM u WHERE p = 1
      UNION ALL SELECT contour_id, idx, x, y, z, p, n1, CASE WHEN far THEN x ELSE kx END, CASE WHEN far THEN y ELSE ky END, far
      FROM (SELECT u.*, kx, ky, u.n1 <= 3 OR sqrt((u.x - kx) ** 2 + (u.y - ky) ** 2) >= 0.01 AS far FROM b JOIN u ON u.contour_id = b.contour_id AND u.p = b.p + 1)),
    k AS (SELECT * FROM b WHERE keep),
    f AS (SELECT contour_id, any_value(n1) AS n1, count(*) AS n2, avg(z) AS mz, greatest(max(z) - avg(z), avg(z) - min(z)) AS off, max(idx) AS last,
      arg_min(x, idx) AS ax, arg_min(y, idx) AS ay, arg_min(z, idx) AS az, sqrt((arg_min(x, idx) - arg_max(x, idx)) ** 2 + (arg_min(y, idx) - arg_max(y, idx)) ** 2) AS gap FROM k GROUP BY contour_id),
    g AS (SELECT f.*, n0, n2 >= 3 AND off > 1e-9 AND off < 1e-6 AS flat, n2 >= 3 AND closed AS ring, f.contour_id % 8 = 0 AS explicit
      FROM f JOIN loops l ON l.contour_id = f.contour_id JOIN (SELECT contour_id, count(*) AS n0 FROM loop_points GROUP BY contour_id) c ON c.contour_id = f.contour_id),
    m AS (SELECT k.contour_id, idx, CASE WHEN moved THEN ax ELSE x END AS x, CASE WHEN moved THEN ay ELSE y END AS y, CASE WHEN flat THEN mz WHEN moved THEN az ELSE z END AS z
      FROM (SELECT k.*, flat, mz, ax, ay, az, k.idx = last AND ring AND (gap <= 1e-6 OR explicit) AS moved FROM k JOIN g ON k.contour_id = g.contour_id) k
      UNION ALL SELECT contour_id, last + 1, ax, ay, CASE WHEN flat THEN mz ELSE az END FROM g WHERE ring AND gap > 1e-6 AND NOT explicit)
    SELECT m.contour_id, row_number() OVER (PARTITION BY m.contour_id ORDER BY idx) - 1 AS idx, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z,
      (n0 > n1)::BIGINT + (n1 > n2)::BIGINT + flat::BIGINT + (ring AND gap > 1e-6)::BIGINT AS operations FROM m JOIN g ON m.contour_id = g.contour_id""")
def _(t):
    points, loops = loop_points(t)
    flags = loops.select("contour_id", "closed", (F.col("contour_id") % 8 == 0).alias("explicit_closure"))
    fixed, log = repair.repair_points(points, flags, t.spans("circles"))
    done = log.groupBy("contour_id").agg(F.count(F.lit(1)).alias("operations"))
    return fixed.join(done, "contour_id", "left").select("contour_id", "idx", *r("x", "y", "z"), F.coalesce("operations", F.lit(0)).alias("operations"))


@register("append_trials", """SELECT run_id, min(objective) AS best, arg_min(trial_id, (objective, trial_id)) AS best_evaluation, count(*) AS trials, count(*) FILTER (status = 'failed') AS failed FROM trials GROUP BY run_id""")
def _(t):
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    # The table arrives in six micro-batches of a few files, read side by side; every second batch is compacted.
    t.table("orders").repartition(6 * FILES).write.parquet(f"{folder}/arriving")
    stream = t.spark.readStream.schema(t.table("orders").schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/arriving")
    log = stream.select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("evaluation"), (F.col("o_totalprice") / F.lit(1e5)).alias("objective"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"),
    )
    streaming.append_trials(log, f"{folder}/log", f"{folder}/log-state").awaitTermination()
    # As many files in the log as tasks wrote: a third of them is a batch.
    files = max(1, -(-len(t.spark.read.parquet(f"{folder}/log").inputFiles()) // 3))
    appended = t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/log")
    streaming.refresh_best(appended, f"{folder}/best", f"{folder}/best-state", compact_every=2).awaitTermination()
    return streaming.read_best(t.spark, f"{folder}/best")


