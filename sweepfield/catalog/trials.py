"""Queries over trial logs and attempt histories."""

import uuid

from pyspark.sql import functions as F

from sweepfield.catalog.registry import register
from sweepfield.functions.numeric import rounded
from sweepfield.operators import trials
from sweepfield.session import shared_folder
from sweepfield.streaming import knowledge as streaming

SCHEDULE = """schedule AS (SELECT run_id, count(*) AS total, run_id % 4 AS n1, run_id % 3 AS n3, run_id % 2 AS n4,
    run_id % 7 <> 0 AS enabled, run_id % 5 AS point_count FROM trials GROUP BY run_id)"""
STAGED = SCHEDULE + """,
    staged AS (SELECT t.*, CASE WHEN NOT enabled THEN 2 WHEN evaluation - 1 < n1 THEN 1
      WHEN n4 > 0 AND evaluation >= greatest(1, total - n4 + 1) THEN 4
      WHEN evaluation >= greatest(1, total - n4 - n3 + 1) THEN 3 ELSE 2 END AS stage,
      total, n4, point_count,
      CASE WHEN trial_id % 3 <> 0 THEN 0.9 + (trial_id % 10)::DOUBLE / 50 END AS global_scale_x,
      CASE WHEN trial_id % 4 <> 0 THEN 0.8 + (trial_id % 7)::DOUBLE / 20 END AS global_scale_y,
      CASE WHEN trial_id % 5 <> 0 THEN 1.0 + (trial_id % 3)::DOUBLE / 10 END AS port_width_scale
      FROM trials t JOIN schedule s ON t.run_id = s.run_id),
    best1 AS (SELECT run_id, arg_min(evaluation, (objective, evaluation)) AS evaluation, min(objective) AS loss,
      arg_min(coalesce(global_scale_x, 1.0), (objective, evaluation)) AS bx,
      arg_min(coalesce(global_scale_y, 1.0), (objective, evaluation)) AS b_y,
      arg_min(coalesce(port_width_scale, 1.0), (objective, evaluation)) AS bp FROM staged WHERE stage = 1 GROUP BY run_id)"""


def schedule(t):
    run = F.col("run_id")
    return t.trials().groupBy("run_id").agg(F.count(F.lit(1)).alias("total")).select(
        "run_id", "total", (run % 4).alias("n1"), (run % 3).alias("n3"), (run % 2).alias("n4"),
        (run % 7 != 0).alias("enabled"), (run % 5).alias("point_count"),
    )


def staged(t):
    k = F.col("trial_id")
    return trials.assign_stage(t.trials(), schedule(t)).select(
        "*",
        F.when(k % 3 != 0, F.lit(0.9) + (k % 10).cast("double") / 50).alias("global_scale_x"),
        F.when(k % 4 != 0, F.lit(0.8) + (k % 7).cast("double") / 20).alias("global_scale_y"),
        F.when(k % 5 != 0, F.lit(1.0) + (k % 3).cast("double") / 10).alias("port_width_scale"),
    )


@register("assign_stage", f"WITH {STAGED} SELECT trial_id, evaluation, stage::BIGINT AS stage FROM staged")
def _(t):
    return trials.assign_stage(t.trials(), schedule(t)).select("trial_id", "evaluation", F.col("stage").cast("long").alias("stage"))


@register("best_so_far", """WITH seen AS (SELECT *, min(objective) OVER (PARTITION BY run_id ORDER BY evaluation) AS best FROM trials)
    SELECT a.trial_id, a.best, min(b.evaluation) AS best_evaluation FROM seen a JOIN trials b
    ON a.run_id = b.run_id AND b.objective = a.best AND b.evaluation <= a.evaluation GROUP BY a.trial_id, a.best""")
def _(t):
    return trials.best_so_far(t.trials(), t.spans("trials")).select("trial_id", "best", "best_evaluation")


@register("best_record", """SELECT run_id, arg_min(trial_id, (objective, evaluation)) AS trial_id, min(objective) AS objective,
    arg_min(evaluation, (objective, evaluation)) AS evaluation FROM trials WHERE status = 'completed' GROUP BY run_id""")
def _(t):
    done = t.trials().withColumn("frequency", F.when(F.col("status") == "completed", F.col("objective")))
    return trials.best_record(done, ["frequency"]).select("run_id", "trial_id", "objective", "evaluation")


@register("stage1_best", f"""WITH {STAGED} SELECT run_id, loss, evaluation, bx AS global_scale_x, b_y AS global_scale_y,
    bp AS port_width_scale FROM best1""")
def _(t):
    return trials.stage1_best(staged(t))


@register("search_bounds", f"""WITH {STAGED},
    runs AS (SELECT DISTINCT run_id, stage FROM staged),
    full_runs AS (SELECT r.run_id, r.stage, coalesce(bx, 1.0) AS bx, coalesce(b_y, 1.0) AS b_y, coalesce(bp, 1.0) AS bp
      FROM runs r LEFT JOIN best1 b ON r.run_id = b.run_id),
    rows AS (SELECT run_id, stage, unnest(['global_scale_x', 'global_scale_y', 'port_width_scale']) AS variable,
        unnest([bx, b_y, bp]) AS c FROM full_runs WHERE stage IN (1, 3))
    SELECT run_id, stage::BIGINT AS stage, variable,
      CASE stage WHEN 1 THEN 0.8::DOUBLE ELSE round(greatest(1e-6, c * 0.95), 6) END AS lower,
      CASE stage WHEN 1 THEN 1.2::DOUBLE ELSE round(greatest(1e-6, c * 1.05), 6) END AS upper,
      CASE stage WHEN 1 THEN 1.0::DOUBLE ELSE round(c, 6) END AS "default" FROM rows
    UNION ALL SELECT run_id, stage, unnest(['stage4_delta_x', 'stage4_delta_y']), -7.0::DOUBLE, 7.0::DOUBLE, 0.0::DOUBLE
      FROM full_runs WHERE stage = 4""")
def _(t):
    rows = staged(t)
    out = trials.search_bounds(rows.select("run_id", "stage").distinct(), trials.stage1_best(rows))
    return out.select(
        "run_id", F.col("stage").cast("long").alias("stage"), "variable",
        *[rounded(F.col(c)).alias(c) for c in ("lower", "upper", "default")],
    )


@register("apply_defaults", f"""WITH {STAGED} SELECT trial_id,
    round(CASE stage WHEN 2 THEN coalesce(bx, 1.0) WHEN 1 THEN coalesce(global_scale_x, 1.0)
      WHEN 3 THEN coalesce(global_scale_x, bx, 1.0) ELSE global_scale_x END, 6) AS global_scale_x,
    round(CASE stage WHEN 2 THEN coalesce(b_y, 1.0) WHEN 1 THEN coalesce(global_scale_y, 1.0)
      WHEN 3 THEN coalesce(global_scale_y, b_y, 1.0) ELSE global_scale_y END, 6) AS global_scale_y,
    round(CASE stage WHEN 2 THEN coalesce(bp, 1.0) WHEN 1 THEN coalesce(port_width_scale, 1.0)
      WHEN 3 THEN coalesce(port_width_scale, bp, 1.0) ELSE port_width_scale END, 6) AS port_width_scale,
    CASE WHEN stage = 4 THEN CASE WHEN point_count > 0 THEN greatest(0, s.evaluation
      - CASE WHEN n4 <= 0 THEN total + 1 ELSE greatest(1, total - n4 + 1) END) % point_count ELSE 0 END END AS point_index
    FROM staged s LEFT JOIN best1 b ON s.run_id = b.run_id""")
def _(t):
    rows = staged(t)
    out = trials.apply_defaults(rows, trials.stage1_best(rows), schedule(t))
    return out.select("trial_id", *[rounded(F.col(c)).alias(c) for c in trials.SCALES], "point_index")


@register("split_outcomes", """SELECT status, run_id, count(*) AS n, min(objective) AS low,
    CASE WHEN status = 'failed' THEN 'failed' END AS error_message FROM trials GROUP BY status, run_id""")
def _(t):
    good, bad = trials.split_outcomes(t.trials())
    both = good.withColumn("error_message", F.lit(None).cast("string")).unionByName(bad)
    return both.groupBy("status", "run_id", "error_message").agg(F.count(F.lit(1)).alias("n"), F.min("objective").alias("low"))


@register("recent_window", """SELECT run_id, attempt_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC) AS k
    FROM attempts) WHERE k <= 8""")
def _(t):
    return trials.recent_window(t.attempts(), 8).select("run_id", "attempt_id")


KINDS = ["click", "view", "purchase", "error"]


@register("operation_counts", """SELECT run_id, count(*) FILTER (operation = 'click') AS click,
    count(*) FILTER (operation = 'view') AS view, count(*) FILTER (operation = 'purchase') AS purchase,
    count(*) FILTER (operation = 'error') AS error FROM (SELECT *,
      row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC) AS k FROM attempts) WHERE k <= 5 GROUP BY run_id""")
def _(t):
    return trials.operation_counts(t.attempts(), 5, KINDS)


@register("operation_sequences", """SELECT run_id, (iteration - 1) // 4 AS iteration,
    string_agg(operation, '>' ORDER BY iteration) AS operations FROM attempts GROUP BY ALL""")
def _(t):
    i = F.col("iteration") - 1
    rows = t.attempts().select("run_id", F.floor(i / 4).alias("iteration"), (i % 4).alias("position"), "operation")
    out = trials.operation_sequences(rows)
    return out.select("run_id", "iteration", F.array_join("operations", ">").alias("operations"))


MEASURES = """measured AS (SELECT run_id, iteration, -value AS s11, CASE WHEN attempt_id % 9 <> 0 THEN value - 60 END AS frequency_error,
    CASE WHEN attempt_id % 5 <> 0 THEN value / 8 END AS gain FROM attempts)"""


def measured(t):
    k, v = F.col("attempt_id"), F.col("value")
    return t.attempts().select(
        "run_id", "iteration", (-v).alias("s11"), F.when(k % 9 != 0, v - 60).alias("frequency_error"),
        F.when(k % 5 != 0, v / 8).alias("gain"),
    )


@register("effect_deltas", f"""WITH {MEASURES}, moved AS (SELECT run_id, iteration, iteration > 1 AS later,
      round(s11 - lag(s11) OVER w, 6) AS a, round(abs(frequency_error) - abs(lag(frequency_error) OVER w), 6) AS b,
      round(gain - lag(gain) OVER w, 6) AS c FROM measured WINDOW w AS (PARTITION BY run_id ORDER BY iteration))
    SELECT run_id, iteration, a AS s11_delta, a < 0 AS s11_improved, b AS frequency_delta, b < 0 AS frequency_improved,
      c AS gain_delta, c > 0 AS gain_improved FROM moved WHERE later""")
def _(t):
    return trials.effect_deltas(measured(t), t.spans("attempts"))


@register("pattern_flags", """WITH groups AS (SELECT run_id, (iteration - 1) // 3 AS iteration,
      count(*) AS n, count(*) FILTER (operation = 'click') AS a, count(*) FILTER (operation = 'view') AS b,
      count(*) FILTER (operation = 'purchase') AS c, count(*) FILTER (operation = 'error') AS d,
      max(value) > 5 AS available, max(value) > 60 AS improved FROM attempts GROUP BY ALL),
    sums AS (SELECT run_id, sum(a) AS resize, sum(b) AS move, sum(c) AS add_, sum(d) AS del, sum(n) AS total,
      count(*) FILTER (available) AS av, count(*) FILTER (available AND improved) AS im FROM (SELECT *,
        row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC) AS k FROM groups) WHERE k <= 5 GROUP BY run_id)
    SELECT run_id, resize::BIGINT AS resize, move::BIGINT AS move, add_::BIGINT AS "add", del::BIGINT AS "delete",
      av >= 3 AND im <= 1 AS weak, add_ > 0 AND del > 0 AS oscillation,
      resize + move >= greatest(3, total // 2) AS dominant,
      concat_ws(',', CASE WHEN av >= 3 AND im <= 1 THEN 'try_several_changes' END, CASE WHEN add_ > 0 AND del > 0 THEN 'stop_adding_and_deleting' END,
        CASE WHEN resize + move >= greatest(3, total // 2) THEN 'change_shape' END) AS advice FROM sums""")
def _(t):
    group = F.floor((F.col("iteration") - 1) / 3)
    lists = t.attempts().groupBy("run_id", group.alias("iteration")).agg(
        F.collect_list("operation").alias("operations"), (F.max("value") > 5).alias("effect_available"),
        (F.max("value") > 60).alias("improved"),
    )
    out = trials.pattern_flags(lists, 5, KINDS)
    return out.withColumn("advice", F.array_join("advice", ","))


@register("distinct_in_order", """WITH recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY page DESC) AS k
      FROM pages_text) WHERE k <= 8),
    items AS (SELECT document, page, unnest(string_split(text, ' ')) AS item, generate_subscripts(string_split(text, ' '), 1) AS pos FROM recent),
    clean AS (SELECT document, page, pos, regexp_replace(item, '^\\s+|\\s+$', '', 'g') AS text FROM items),
    firsts AS (SELECT document, text, min((page, pos)) AS spot FROM clean WHERE text <> '' GROUP BY document, text),
    late AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY spot DESC) AS back FROM firsts)
    SELECT document AS run_id, row_number() OVER (PARTITION BY document ORDER BY spot) AS rank, text FROM late WHERE back <= 20""")
def _(t):
    lists = t.pages_text().select(
        F.col("document").alias("run_id"), F.col("page").alias("iteration"), F.split("text", " ").alias("words")
    )
    out = trials.distinct_in_order(lists, "words")
    return out.withColumn("rank", F.col("rank").cast("long"))


LISTS = """lists AS (SELECT run_id, (iteration - 1) // 3 AS iteration, -max(value) AS s11, CASE WHEN min(attempt_id) % 9 <> 0 THEN max(value) - 60 END AS frequency_error,
      CASE WHEN min(attempt_id) % 5 <> 0 THEN min(value) / 8 END AS gain, count(*) AS n, count(*) FILTER (operation = 'click') AS a,
      count(*) FILTER (operation = 'view') AS b, count(*) FILTER (operation = 'purchase') AS c, count(*) FILTER (operation = 'error') AS d,
      max(value) > 5 AS available, max(value) > 60 AS improved, list(operation || ' ' || attempt_id % 11 ORDER BY iteration) AS notes FROM attempts GROUP BY ALL)"""

FILES = 24  # that one micro-batch of attempts arrives in


@register("refresh_knowledge", f"""WITH {LISTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC) AS k FROM lists),
    sums AS (SELECT run_id, sum(a) FILTER (k <= 5) AS resize, sum(b) FILTER (k <= 5) AS move, sum(c) FILTER (k <= 5) AS add_, sum(d) FILTER (k <= 5) AS del,
      sum(n) FILTER (k <= 5) AS total, count(*) FILTER (k <= 5 AND available) AS av, count(*) FILTER (k <= 5 AND available AND improved) AS im FROM ranked GROUP BY run_id),
    moved AS (SELECT run_id, iteration, k, round(s11 - lag(s11) OVER w, 6) AS x, round(abs(frequency_error) - abs(lag(frequency_error) OVER w), 6) AS y,
      round(gain - lag(gain) OVER w, 6) AS z FROM ranked WINDOW w AS (PARTITION BY run_id ORDER BY iteration)),
    items AS (SELECT run_id, iteration, unnest(notes) AS text, generate_subscripts(notes, 1) AS pos FROM ranked WHERE k <= 8),
    firsts AS (SELECT run_id, text, min((iteration, pos)) AS spot FROM items GROUP BY run_id, text),
    late AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY spot DESC) AS back FROM firsts),
    noted AS (SELECT run_id, string_agg(text, '|' ORDER BY spot) AS notes FROM late WHERE back <= 20 GROUP BY run_id),
    deltas AS (SELECT run_id, count(*) FILTER (x < 0) AS improvements FROM moved GROUP BY run_id)
    SELECT run_id, iteration, x AS s11_delta, y AS frequency_delta, z AS gain_delta, z > 0 AS gain_improved, improvements, resize::BIGINT AS resize, move::BIGINT AS move,
      add_::BIGINT AS "add", del::BIGINT AS "delete", av >= 3 AND im <= 1 AS weak, add_ > 0 AND del > 0 AS oscillation, resize + move >= greatest(3, total // 2) AS dominant, notes
    FROM moved JOIN sums USING (run_id) JOIN noted USING (run_id) JOIN deltas USING (run_id) WHERE k = 1""")
def _(t):
    folder = f"{shared_folder(t.spark)}/knowledge-{uuid.uuid4().hex}"
    group = F.floor((F.col("iteration") - 1) / 3).alias("iteration")
    note = F.concat("operation", F.lit(" "), (F.col("attempt_id") % 11).cast("string"))
    high, low, first = F.max("value"), F.min("value"), F.min("attempt_id")
    lists = t.attempts().groupBy("run_id", group).agg(
        (-high).alias("s11"), F.when(first % 9 != 0, high - 60).alias("frequency_error"), F.when(first % 5 != 0, low / 8).alias("gain"),
        F.collect_list("operation").alias("operations"), (high > 5).alias("effect_available"), (high > 60).alias("improved"),
        F.transform(F.array_sort(F.collect_list(F.struct("iteration", note.alias("note")))), lambda s: s["note"]).alias("notes"))
    lists.write.parquet(f"{folder}/all")
    lists = t.spark.read.parquet(f"{folder}/all")
    parts = 6
    top = (lists.agg(F.max("iteration")).first()[0] or 0) + 1
    # The attempts arrive in the order of their numbers, a few files per micro-batch with a run's attempts
    # in one of them; the stream is stopped and started halfway.
    for part in range(parts):
        arriving = lists.filter(F.floor(F.col("iteration") * parts / top) == part)
        arriving.repartition(FILES, "run_id").write.mode("append").parquet(f"{folder}/arriving")
        if part in (parts // 2, parts - 1):
            stream = t.spark.readStream.schema(lists.schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/arriving")
            streaming.refresh_knowledge(stream, f"{folder}/made", f"{folder}/state", KINDS, compact_every=4).awaitTermination()
    effects = streaming.read_effects(t.spark, f"{folder}/made").groupBy("run_id").agg(F.count_if("s11_improved").alias("improvements"))
    latest = streaming.read_knowledge(t.spark, f"{folder}/made").withColumn("notes", F.array_join("notes", "|"))
    return latest.join(effects, "run_id", "left").select(
        "run_id", "iteration", "s11_delta", "frequency_delta", "gain_delta", "gain_improved", F.coalesce("improvements", F.lit(0)).alias("improvements"),
        "resize", "move", "add", "delete", "weak", "oscillation", "dominant", "notes")


@register("next_iteration", """SELECT c.c_custkey AS run_id, coalesce(max(CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE evaluation END) + 1,
    nullif(count(evaluation), 0) + 1, 1) AS next_iteration FROM customer c LEFT JOIN trials t ON c.c_custkey = t.run_id GROUP BY c.c_custkey""")
def _(t):
    text = F.when(F.col("run_id") % 3 == 0, "n/a").otherwise(F.col("evaluation").cast("string"))
    log = t.trials().select("run_id", text.alias("iteration"))
    return trials.next_iteration(t.table("customer").select(F.col("c_custkey").alias("run_id")), log)


@register("propose_candidates", """WITH b AS (SELECT run_id, v AS variable_no, min(objective) AS lower, max(objective) AS upper
      FROM trials, (SELECT unnest([1, 2, 3]) AS v) GROUP BY run_id, v),
    d AS (SELECT *, unnest(range(1, 6)) AS draw FROM b),
    s1 AS (SELECT *, ((12345 + 7) % 2147483647 * 48271 + 11) % 2147483647 AS s FROM d),
    s2 AS (SELECT * EXCLUDE s, ((s + run_id % 2147483647) % 2147483647 * 48271 + 11) % 2147483647 AS s FROM s1),
    s3 AS (SELECT * EXCLUDE s, ((s + variable_no) % 2147483647 * 48271 + 11) % 2147483647 AS s FROM s2),
    s4 AS (SELECT * EXCLUDE s, ((s + draw) % 2147483647 * 48271 + 11) % 2147483647 AS s FROM s3)
    SELECT run_id, variable_no::BIGINT AS variable_no, draw::BIGINT AS draw,
      round(lower + (upper - lower) * (s / 2147483647.0::DOUBLE), 6) AS candidate FROM s4""")
def _(t):
    bounds = t.trials().groupBy("run_id").agg(F.min("objective").alias("lower"), F.max("objective").alias("upper"))
    bounds = bounds.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("variable_no"))
    out = trials.propose_candidates(bounds, 5, seed=7)
    return out.select("run_id", F.col("variable_no").cast("long").alias("variable_no"), F.col("draw").cast("long").alias("draw"), rounded(F.col("candidate")).alias("candidate"))


KEYS = trials.REQUIRED + trials.REQUIRED_TO_EXECUTE + trials.REQUIRED_TO_SOLVE + trials.OPTIONAL + ["notes"]


@register("missing_inputs", f"""WITH names AS (SELECT {KEYS} AS k),
    entries AS (SELECT l_orderkey AS run_id, k[1 + l_partkey % {len(KEYS)}] AS key, l_quantity > 10 AS present FROM lineitem, names),
    there AS (SELECT run_id, list(DISTINCT key) FILTER (present) AS p, bool_or(key = 'instance_json') AS o FROM entries GROUP BY run_id),
    wanted AS (SELECT o_orderkey AS run_id, unnest({trials.REQUIRED}
      || CASE WHEN o_orderkey % 2 = 0 THEN {trials.REQUIRED_TO_EXECUTE} ELSE []::VARCHAR[] END
      || CASE WHEN o_orderkey % 4 = 0 THEN {trials.REQUIRED_TO_SOLVE} ELSE []::VARCHAR[] END
      || CASE WHEN o THEN ['instance_json'] ELSE []::VARCHAR[] END) AS key, p
      FROM orders LEFT JOIN there ON o_orderkey = run_id)
    SELECT o_orderkey AS run_id, coalesce(string_agg(key, ',' ORDER BY key), '') AS missing FROM orders LEFT JOIN
      (SELECT run_id, key FROM wanted WHERE NOT coalesce(list_contains(p, key), false)) m ON o_orderkey = m.run_id GROUP BY o_orderkey""")
def _(t):
    key = F.element_at(F.array(*[F.lit(k) for k in KEYS]), (F.col("l_partkey") % len(KEYS) + 1).cast("int"))
    manifest = t.table("lineitem").select(F.col("l_orderkey").alias("run_id"), key.alias("key"), (F.col("l_quantity") > 10).alias("present"))
    order = F.col("o_orderkey")
    runs = t.table("orders").select(order.alias("run_id"), (order % 2 == 0).alias("execute"), (order % 4 == 0).alias("solve"))
    return trials.missing_inputs(runs, manifest).select("run_id", F.array_join("missing", ",").alias("missing"))


TARGET_DOC = """docs AS (SELECT p_partkey, '{"experiment": "' || p_name || '", "target": {"f0_ghz": ' || p_size
    || CASE p_partkey % 3 WHEN 0 THEN ', "s11": {"threshold_db": "-15", "goal": "below"}' WHEN 1 THEN ', "s11": 4' ELSE '' END
    || ', "gain": {"threshold_dbi": ' || CASE WHEN p_partkey % 2 = 0 THEN '6' ELSE '"high"' END || ', "goal": "above"}'
    || ', "bandwidth": {"reference_db": -10}}}' AS doc FROM part)"""


@register("reference_targets", f"""WITH {TARGET_DOC} SELECT p_partkey, doc ->> '$.experiment' AS experiment,
    TRY_CAST(doc ->> '$.target.f0_ghz' AS DOUBLE) AS target_freq, TRY_CAST(doc ->> '$.target.s11.threshold_db' AS DOUBLE) AS target_s11,
    doc ->> '$.target.s11.goal' AS s11_goal, TRY_CAST(doc ->> '$.target.gain.threshold_dbi' AS DOUBLE) AS target_gain,
    doc ->> '$.target.gain.goal' AS gain_goal, TRY_CAST(doc ->> '$.target.bandwidth.reference_db' AS DOUBLE) AS bandwidth_reference,
    doc ->> '$.target.bandwidth.goal' AS bandwidth_goal FROM (SELECT p_partkey, doc::JSON AS doc FROM docs)""")
def _(t):
    k = F.col("p_partkey")
    s11 = F.when(k % 3 == 0, ', "s11": {"threshold_db": "-15", "goal": "below"}').when(k % 3 == 1, ', "s11": 4').otherwise("")
    doc = F.concat(
        F.lit('{"experiment": "'), F.col("p_name"), F.lit('", "target": {"f0_ghz": '), F.col("p_size").cast("string"), s11,
        F.lit(', "gain": {"threshold_dbi": '), F.when(k % 2 == 0, "6").otherwise('"high"'),
        F.lit(', "goal": "above"}, "bandwidth": {"reference_db": -10}}}'),
    )
    return trials.reference_targets(t.table("part").select("p_partkey", doc.alias("doc")), "doc")


@register("normalize_reflection", """SELECT doc_id, true AS available, source AS summary, lang AS lessons,
    source || '|' || lang AS guidance, '' AS avoid, lang AS helped, text AS hurt, '' AS uncertain FROM documents""")
def _(t):
    doc = F.to_json(F.struct(
        F.concat(F.lit("  "), "source", F.lit(" ")).alias("summary"), F.col("lang").alias("electromagnetic_lessons"),
        F.array("source", "lang").alias("next_iteration_guidance"), F.col("n_chars").alias("avoid_repeating"),
        F.struct(F.array("lang").alias("helped"), F.col("text").alias("hurt")).alias("strategy_effect"),
    ))
    out = trials.normalize_reflection(t.table("documents").select("doc_id", doc.alias("doc")), "doc")
    joined = lambda c, name: F.array_join(c, "|").alias(name)
    return out.select(
        "doc_id", "available", "summary", joined("electromagnetic_lessons", "lessons"),
        joined("next_iteration_guidance", "guidance"), joined("avoid_repeating", "avoid"),
        joined("helped", "helped"), joined("hurt", "hurt"), joined("uncertain", "uncertain"),
    )
