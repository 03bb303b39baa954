"""Engineering views over the driver tables, as DataFrames and as SQL.

Each view covers its whole source table. ``Tables`` also keeps the measured
group spans of a view, so that many queries share one measurement.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepfield.plans.ordered import NO_SPLIT, Spans, measure_spans, with_position

EPOCH_US = 1704067200000000  # 2024-01-01 00:00:00 UTC in microseconds

SQL = {
    "sweeps": f"""SELECT user_id AS design_id,
        (epoch_us(ts) - {EPOCH_US}) / 3600000000.0::DOUBLE AS freq, -value AS value FROM events""",
    "targets": """SELECT user_id AS design_id, 360.0::DOUBLE + user_id % 60 AS target_freq,
        240.0::DOUBLE AS band_start, 480.0::DOUBLE AS band_end, -20.0::DOUBLE AS threshold
        FROM events GROUP BY user_id""",
    "trials": """SELECT o_custkey AS run_id,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS evaluation,
        o_totalprice / 1e5 AS objective,
        CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS status,
        o_orderkey AS trial_id FROM orders""",
    "attempts": """SELECT user_id AS run_id, event_id AS attempt_id,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration,
        event_type AS operation, value FROM events""",
    "contours": """SELECT vec_id AS contour_id, idx::BIGINT AS idx,
        embedding[2 * idx + 1]::DOUBLE AS x, embedding[2 * idx + 2]::DOUBLE AS y
        FROM embeddings, (SELECT unnest(range(0, 32)) AS idx) AS positions""",
    "circles": """SELECT p_partkey AS contour_id, idx::BIGINT AS idx,
        p_size * cos(2 * pi() * idx / 12) AS x, p_size * sin(2 * pi() * idx / 12) AS y
        FROM part, (SELECT unnest(range(0, 12)) AS idx) AS positions""",
    "hierarchy": """SELECT p_partkey AS id,
        CASE WHEN p_partkey = 0 THEN -1 ELSE (p_partkey - 1) // 2 END AS parent FROM part""",
    "edits": """SELECT vec_id AS contour_id, (vec_id % 360)::DOUBLE AS angle,
        (vec_id % 7)::DOUBLE / 10 AS dx, (vec_id % 5)::DOUBLE / 10 AS dy,
        1 + (vec_id % 3)::DOUBLE / 2 AS factor FROM embeddings""",
    "edges": """SELECT contour_id, idx, x AS x1, y AS y1,
        coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2,
        coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
        FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY idx)""",
    "primitives": """SELECT contour_id AS design_id, idx,
        CASE idx % 4 WHEN 0 THEN 'line' WHEN 1 THEN 'arc' WHEN 2 THEN 'spline' ELSE 'hole' END AS type,
        x1, y1, x2, y2 FROM edges""",
    "pixels": """SELECT vec_id AS image_id, i % 7 AS px, i // 7 AS py,
        floor(least(255, greatest(0, (embedding[3 * i + 1]::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE * 255)))::INTEGER AS r,
        floor(least(255, greatest(0, (embedding[3 * i + 2]::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE * 255)))::INTEGER AS g,
        floor(least(255, greatest(0, (embedding[3 * i + 3]::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE * 255)))::INTEGER AS b
        FROM embeddings, (SELECT unnest(range(0, 22)) AS i) AS positions""",
    "boxes": """SELECT user_id AS image_id, event_id AS box_id,
        (event_id % 97)::DOUBLE AS x0, (event_id % 89)::DOUBLE AS y0,
        (event_id % 97 + 10 + event_id % 13)::DOUBLE AS x1,
        (event_id % 89 + 10 + event_id % 7)::DOUBLE AS y1,
        value / 500 AS score FROM events""",
    "pages_text": "SELECT conv_id AS document, turn AS page, text FROM conversations",
    "replies": """SELECT doc_id AS reply_id,
        'Reply: parameters = {''X'': ''' || (n_chars % 97)::VARCHAR || ''', ''Y'': ''' || source || ''', ''note'': '''
        || lang || '''} end. ' || text AS reply FROM documents""",
}

# Views that read other views; the order here is the order of definition.
USES = {"edges": ["contours"], "primitives": ["contours", "edges"]}


def with_views(sql: str) -> str:
    """Prefix a query with the views it names."""
    needed: list[str] = []
    for name in SQL:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\s+(AS\s+)?\w+\b", sql):
            for item in [*USES.get(name, []), name]:
                if item not in needed:
                    needed.append(item)
    if not needed:
        return sql
    head = ",\n".join(f"{name} AS ({SQL[name]})" for name in needed)
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head},\n{body[len('WITH'):]}"
    return f"WITH {head}\n{body}"


_SPANS: dict[tuple, Spans] = {}


class Tables:
    """Driver tables of one data set and the views derived from them."""

    ORDER = {
        "sweeps": (["design_id"], "freq"),
        "trials": (["run_id"], "evaluation"),
        "attempts": (["run_id"], "iteration"),
        "contours": (["contour_id"], "idx"),
        "circles": (["contour_id"], "idx"),
        "pages_text": (["document"], "page"),
        "boxes": (["image_id"], "x0"),
    }

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spans(self, view: str) -> Spans:
        """Groups of the view to split, measured once per session and data set."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, view)
        if key not in _SPANS:
            keys, order = self.ORDER[view]
            _SPANS[key] = measure_spans(getattr(self, view)(), keys, order)
        return _SPANS[key]

    def measured(self, name: str, df: DataFrame, keys: list[str], order: str) -> Spans:
        """Groups of a derived table to split, measured once per session and data set."""
        return self._cached((name, order), lambda: measure_spans(df, keys, order))

    def sweeps(self) -> DataFrame:
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.table("events").select(
            F.col("user_id").alias("design_id"),
            ((micros - F.lit(EPOCH_US)) / F.lit(3600000000.0)).alias("freq"),
            (-F.col("value")).alias("value"),
        )

    def targets(self) -> DataFrame:
        ids = self.table("events").select(F.col("user_id").alias("design_id")).distinct()
        return ids.select(
            "design_id",
            (F.lit(360.0) + F.col("design_id") % 60).alias("target_freq"),
            F.lit(240.0).alias("band_start"),
            F.lit(480.0).alias("band_end"),
            F.lit(-20.0).alias("threshold"),
        )

    def trials(self) -> DataFrame:
        orders = self.table("orders").select(
            F.col("o_custkey").alias("run_id"),
            F.col("o_orderdate").cast("timestamp").alias("day"),
            F.col("o_orderkey").alias("trial_id"),
            (F.col("o_totalprice") / F.lit(1e5)).alias("objective"),
            F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"),
        )
        spans = self._cached(("orders", "day"), lambda: measure_spans(orders, ["run_id"], "day"))
        numbered = with_position(orders, ["run_id"], ["day", "trial_id"], spans, "evaluation")
        return numbered.select("run_id", "evaluation", "objective", "status", "trial_id")

    def attempts(self) -> DataFrame:
        events = self.table("events").select(
            F.col("user_id").alias("run_id"),
            F.col("event_id").alias("attempt_id"),
            F.col("ts").cast("timestamp").alias("at"),
            F.col("event_type").alias("operation"),
            "value",
        )
        spans = self._cached(("events", "at"), lambda: measure_spans(events, ["run_id"], "at"))
        numbered = with_position(events, ["run_id"], ["at", "attempt_id"], spans, "iteration")
        return numbered.select("run_id", "attempt_id", "iteration", "operation", "value")

    def _cached(self, name, measure) -> Spans:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _SPANS:
            _SPANS[key] = measure()
        return _SPANS[key]

    def contours(self) -> DataFrame:
        e = F.col("embedding")
        point = lambda i: F.struct(
            i.cast("long").alias("idx"),
            F.get(e, i * 2).cast("double").alias("x"),
            F.get(e, i * 2 + 1).cast("double").alias("y"),
        )
        return self.table("embeddings").select(
            F.col("vec_id").alias("contour_id"), F.inline(F.transform(F.sequence(F.lit(0), F.lit(31)), point))
        )

    def circles(self) -> DataFrame:
        size = F.col("p_size")
        point = lambda i: F.struct(
            i.cast("long").alias("idx"),
            (size * F.cos(F.lit(2) * F.pi() * i / F.lit(12))).alias("x"),
            (size * F.sin(F.lit(2) * F.pi() * i / F.lit(12))).alias("y"),
        )
        return self.table("part").select(
            F.col("p_partkey").alias("contour_id"), F.inline(F.transform(F.sequence(F.lit(0), F.lit(11)), point))
        )

    def hierarchy(self) -> DataFrame:
        part = F.col("p_partkey")
        return self.table("part").select(
            part.alias("id"),
            F.when(part == 0, F.lit(-1).cast("long")).otherwise(F.expr("(p_partkey - 1) div 2")).alias("parent"),
        )

    def edits(self) -> DataFrame:
        v = F.col("vec_id")
        return self.table("embeddings").select(
            v.alias("contour_id"),
            (v % 360).cast("double").alias("angle"),
            ((v % 7).cast("double") / 10).alias("dx"),
            ((v % 5).cast("double") / 10).alias("dy"),
            (F.lit(1) + (v % 3).cast("double") / 2).alias("factor"),
        )

    def primitives(self) -> DataFrame:
        """Closed contour edges typed by position; one array cell bounds each outline."""
        e = F.col("embedding")
        at = lambda i: F.get(e, i).cast("double")
        edge = lambda i: F.struct(
            i.cast("long").alias("idx"),
            F.element_at(F.array(*[F.lit(t) for t in ("line", "arc", "spline", "hole")]), i % 4 + 1).alias("type"),
            at(i * 2).alias("x1"),
            at(i * 2 + 1).alias("y1"),
            at((i + 1) % 32 * 2).alias("x2"),
            at((i + 1) % 32 * 2 + 1).alias("y2"),
        )
        return self.table("embeddings").select(
            F.col("vec_id").alias("design_id"), F.inline(F.transform(F.sequence(F.lit(0), F.lit(31)), edge))
        )

    def pixels(self) -> DataFrame:
        e = F.col("embedding")
        level = lambda i: F.floor(
            F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.get(e, i).cast("double") + 0.6) / 1.2 * 255))
        ).cast("int")
        pixel = lambda i: F.struct(
            (i % 7).cast("long").alias("px"),
            F.floor(i / 7).cast("long").alias("py"),
            level(i * 3).alias("r"),
            level(i * 3 + 1).alias("g"),
            level(i * 3 + 2).alias("b"),
        )
        return self.table("embeddings").select(
            F.col("vec_id").alias("image_id"), F.inline(F.transform(F.sequence(F.lit(0), F.lit(21)), pixel))
        )

    def boxes(self) -> DataFrame:
        i = F.col("event_id")
        return self.table("events").select(
            F.col("user_id").alias("image_id"),
            i.alias("box_id"),
            (i % 97).cast("double").alias("x0"),
            (i % 89).cast("double").alias("y0"),
            (i % 97 + 10 + i % 13).cast("double").alias("x1"),
            (i % 89 + 10 + i % 7).cast("double").alias("y1"),
            (F.col("value") / 500).alias("score"),
        )

    def pages_text(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("document"), F.col("turn").alias("page"), "text"
        )

    def replies(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("reply_id"),
            F.concat(
                F.lit("Reply: parameters = {'X': '"), (F.col("n_chars") % 97).cast("string"),
                F.lit("', 'Y': '"), F.col("source"), F.lit("', 'note': '"), F.col("lang"),
                F.lit("'} end. "), F.col("text"),
            ).alias("reply"),
        )
