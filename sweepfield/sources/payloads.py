"""Design payload JSON: reading, flattening and reshaping."""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweepfield.functions.numeric import is_finite
from sweepfield.operators.primitives import primitive_type
from sweepfield.session import setting, shared_folder
from sweepfield.sources.sinks import MOVED_BY_TASKS

# Coordinates are read as text, so one malformed number spoils one point only.
COORDS = "array<array<string>>"
SEGMENT = (
    f"type string, kind string, primitive_type string, role string, segment_id string, start array<string>, `end` array<string>, "
    f"center array<string>, control_points {COORDS}, points {COORDS}, start_idx int, end_idx int"
)
POINT_KEYS = f"resampled_points {COORDS}, fallback_points {COORDS}, sampled_points {COORDS}, points {COORDS}"
HOLE = f"id string, hole_id string, role string, bbox array<double>, {POINT_KEYS}, primitives array<struct<type: string>>, segments array<struct<type: string>>"
PAYLOAD = (
    f"schema_version string, backend string, canvas struct<width: double, height: double, unit: string, source_origin: array<double>>, "
    f"metrics struct<component_count: bigint, primitive_count: bigint, hole_count: bigint, line_only_parameterization: boolean>, "
    f"components array<struct<component_id: string, name: string, role: string, closed: boolean, bbox: array<double>, "
    + POINT_KEYS.replace(f" {COORDS}", f": {COORDS}")
    + ", segments: array<struct<" + ", ".join(p.replace(" ", ": ", 1) for p in SEGMENT.split(", ")) + ">>"
    + ", primitives: array<struct<" + ", ".join(p.replace(" ", ": ", 1) for p in SEGMENT.split(", ")) + ">>"
    + ", holes: array<struct<" + ", ".join(p.replace(" ", ": ", 1) for p in HOLE.split(", ")) + ">>>>"
)


# Files of a folder are dealt into this many below it, so that listing runs side by side.
FOLDERS = 64
# What opening a file counts for when files are packed into tasks, in bytes read meanwhile.
OPEN_COST = "64KB"


def write_payloads(documents: DataFrame, path: str) -> None:
    """``documents(design_id, doc)`` as one file per design, its id in the path; a null text counts as empty, of a repeated id one text is kept.

    Each text ends with a line end, since Spark passes over files without bytes.

    On a local or mounted file system Spark's writer starts processes to set the
    rights of each file, some 20 ms each; there the tasks write the files
    themselves, each moved into place when it is whole.
    """
    if not path.startswith("file:"):
        documents.select("design_id", "doc").write.options(**MOVED_BY_TASKS).partitionBy("design_id").text(path)
        return
    root = "/" + path.removeprefix("file:").lstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = TaskContext.get().taskAttemptId(), set()
        for batch in batches:
            for design, doc in zip(*[column.to_pylist() for column in batch.columns]):
                name = "design_id=" + quote(design, safe="")
                folder = f"{root}/{zlib.crc32(name.encode()) % FOLDERS}"
                if folder not in known:
                    os.makedirs(folder, exist_ok=True)
                    known.add(folder)
                with open(f"{folder}/.{name}-{own}", "w", encoding="utf-8", newline="") as file:
                    file.write(doc + "\n")
                os.replace(f"{folder}/.{name}-{own}", f"{folder}/{name}.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    os.makedirs(root)
    texts = documents.select(F.coalesce(F.col("design_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.coalesce("doc", F.lit("")).alias("doc"))
    texts.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def load_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One payload row per JSON file, opened once; blank or non-object files give an empty payload, files without bytes no row.

    Spark counts a file as 4 MB more than it holds, so a task would open 32
    files at most; here it opens some 2,000 small ones.
    """
    shared_folder(spark)
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    with setting(spark, "spark.sql.files.openCostInBytes", OPEN_COST):
        return parse_payloads(texts.select(F.col("_metadata.file_path").alias("design_id"), "value").checkpoint(), "value")


def parse_payloads(texts: DataFrame, column: str) -> DataFrame:
    """Payload struct from JSON text with an explicit schema."""
    kept = [c for c in texts.columns if c != column]
    parsed = F.from_json(F.col(column), PAYLOAD, {"mode": "PERMISSIVE"})
    empty = F.from_json(F.lit("{}"), PAYLOAD)
    is_object = F.ltrim(F.col(column)).startswith("{")
    return texts.select(*kept, F.coalesce(F.when(is_object, parsed), empty).alias("payload"))


def _point(raw: Column) -> Column:
    """Finite ``(x, y, z)`` or null from an array of texts; z defaults to 0."""
    number = lambda i: F.get(raw, F.lit(i)).try_cast("double")
    x, y = number(0), number(1)
    z = F.when(F.size(raw) >= 3, number(2)).otherwise(0.0)
    return F.when((F.size(raw) >= 2) & is_finite(x) & is_finite(y) & z.isNotNull(), F.struct(x.alias("x"), y.alias("y"), z.alias("z")))


def _points(raw: Column) -> Column:
    return F.filter(F.transform(F.coalesce(raw, F.array().cast(COORDS)), _point), lambda p: p.isNotNull())


def _first_filled(*arrays: Column) -> Column:
    """The first non-empty array."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])


def _samples(part: Column) -> Column:
    return _points(_first_filled(*[part[k] for k in ("resampled_points", "fallback_points", "sampled_points", "points")]))


def _segment_points(segment: Column) -> Column:
    own = _points(_first_filled(segment["control_points"], segment["points"]))
    ends = F.filter(F.array(*[_point(segment[k]) for k in ("start", "end", "center")]), lambda p: p.isNotNull())
    return F.concat(own, ends)


def explode_points(payloads: DataFrame) -> DataFrame:
    """Points of each component: the first filled list, else those of its primitives.

    Malformed points are dropped; ``idx`` numbers the rest from 0.
    """
    comps = payloads.select("design_id", F.posexplode("payload.components").alias("comp", "c"))
    listed = _samples(F.col("c"))
    both = F.concat(*[F.coalesce(F.col(f"c.{k}"), _no_segments()) for k in ("primitives", "segments")])
    fallback = F.flatten(F.transform(both, _segment_points))
    points = F.when(F.size(listed) > 0, listed).otherwise(fallback)
    return comps.select("design_id", "comp", F.coalesce("c.closed", F.lit(False)).alias("closed"), F.posexplode(points).alias("idx", "p")).select(
        "design_id", "comp", "closed", F.col("idx").cast("long").alias("idx"), "p.x", "p.y", "p.z"
    )


def _no_segments() -> Column:
    inner = ", ".join(p.replace(" ", ": ", 1) for p in SEGMENT.split(", "))
    return F.array().cast(f"array<struct<{inner}>>")


def _box(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def primitive_inventory(payloads: DataFrame) -> DataFrame:
    """Typed rows of all segments (else primitives) and holes with points and box.

    A line keeps its ends, a spline its control points, an arc start, centre and
    end; where those are missing the sampled stretch of the component stands in.
    """
    comps = payloads.select("design_id", F.posexplode("payload.components").alias("comp", "c"))
    c = F.col("c")
    source = F.coalesce(*[F.when(F.size(c[k]) > 0, c[k]) for k in ("segments", "primitives")])
    source_key = F.when(F.size(c["segments"]) > 0, "segments").otherwise("primitives")
    parts = comps.select("design_id", "comp", "c", source_key.alias("source_key"), F.posexplode(source).alias("n", "s"))
    s = F.col("s")
    kind = primitive_type(F.coalesce(*[F.when(s[k] != "", s[k]) for k in ("type", "kind", "primitive_type")]))
    picked = lambda keys: F.filter(F.array(*[_point(s[k]) for k in keys]), lambda p: p.isNotNull())
    own = F.when(F.col("type") == "LINE", picked(("start", "end"))).when(F.col("type") == "BSPLINE", _points(s["control_points"])).when(
        F.col("type").isin("ARC", "CURVE"), picked(("start", "center", "end"))
    )
    all_samples = _samples(c)
    low = F.greatest(F.lit(0), F.least(s["start_idx"], s["end_idx"]))
    high = F.least(F.size(F.col("samples")) - 1, F.greatest(s["start_idx"], s["end_idx"]))
    known = s["start_idx"].isNotNull() & s["end_idx"].isNotNull()
    stretch = F.when(~known, F.col("samples")).when(
        high >= low, F.slice("samples", low + 1, F.greatest(F.lit(0), high - low + 1))
    ).otherwise(F.slice("samples", 1, 0))
    rows = parts.withColumn("type", kind).withColumn("samples", all_samples).select("*", own.alias("own"), stretch.alias("stretch"))
    size = F.coalesce(F.size("own"), F.lit(0))
    points = (
        F.when(size <= 0, F.col("stretch"))
        .when((size == 1) & (F.size("stretch") >= 2), F.array(F.get("stretch", F.lit(0)), F.element_at("stretch", F.when(F.size("stretch") > 0, -1))))
        .otherwise(F.col("own"))
    )
    name = F.concat(
        F.lit("c"), F.coalesce(c["component_id"], F.col("comp").cast("string")), F.lit("_s"), F.coalesce(s["segment_id"], F.col("n").cast("string"))
    )
    segments = rows.select("design_id", "comp", F.col("n").alias("primitive_index"), "source_key", name.alias("primitive_id"), "type", points.alias("points"))
    holes = comps.select("design_id", "comp", "c", F.posexplode("c.holes").alias("n", "h"))
    ring = _samples(F.col("h"))
    first, last = F.get("ring", F.lit(0)), F.get("ring", F.size("ring") - 1)
    closed = (F.size("ring") >= 2) & (F.hypot(first["x"] - last["x"], first["y"] - last["y"]) <= 1e-9)
    hole_name = F.concat(
        F.lit("c"), F.coalesce(c["component_id"], (F.col("comp") + 1).cast("string")), F.lit("_h"), (F.col("n") + 1).cast("string")
    )
    opened = F.when(closed, F.slice("ring", F.lit(1), F.greatest(F.lit(0), F.size("ring") - 1))).otherwise(F.col("ring"))
    hole_rows = holes.withColumn("ring", ring).select(
        "design_id", "comp", F.col("n").alias("primitive_index"), F.lit("holes").alias("source_key"), hole_name.alias("primitive_id"),
        F.lit("HOLE").alias("type"), opened.alias("points"),
    ).filter(F.size("points") >= 3)
    return segments.filter(F.size("points") > 0).unionByName(hole_rows).select("*", _box(F.col("points")).alias("bbox"))


def parameterization_summary(payloads: DataFrame) -> DataFrame:
    """Board box and component, primitive and hole counts, with fall-backs."""
    p = F.col("payload")
    comps = F.coalesce(p["components"], F.from_json(F.lit("{}"), PAYLOAD)["components"])
    total = lambda f: F.aggregate(F.transform(p["components"], f), F.lit(0).cast("long"), lambda a, v: a + v)
    size = lambda a: F.greatest(F.lit(0), F.coalesce(F.size(a), F.lit(0))).cast("long")
    filled = lambda a, b: F.when(size(a) > 0, size(a)).otherwise(size(b))
    inner = lambda c: F.aggregate(
        F.transform(F.coalesce(c["holes"], F.filter(c["holes"], lambda h: F.lit(False))), lambda h: filled(h["primitives"], h["segments"])),
        F.lit(0).cast("long"), lambda a, v: a + v,
    )
    found = {
        "component_count": size(comps),
        "primitive_count": F.coalesce(total(lambda c: filled(c["primitives"], c["segments"]) + F.coalesce(inner(c), F.lit(0))), F.lit(0)),
        "hole_count": F.coalesce(total(lambda c: size(c["holes"])), F.lit(0)),
    }
    points = F.flatten(F.transform(p["components"], lambda c: _points(_first_filled(c["points"], c["fallback_points"]))))
    canvas = F.when(
        (p["canvas"]["width"] > 0) & (p["canvas"]["height"] > 0), F.array(F.lit(0.0), F.lit(0.0), p["canvas"]["width"], p["canvas"]["height"])
    )
    board = F.coalesce(canvas, F.when(F.size(points) > 0, _box(points)))
    counted = lambda name: F.coalesce(F.when(p["metrics"][name] != 0, p["metrics"][name]), found[name]).alias(name)
    return payloads.select(
        "design_id", board.alias("board"), *[counted(n) for n in found], F.coalesce(p["metrics"]["line_only_parameterization"], F.lit(False)).alias("line_only")
    )


BOUNDARY = (
    "schema_version string, geometries array<struct<id: string, outer_boundary: struct<vertices: array<struct<x: double, y: double>>>, "
    "holes: array<struct<id: string, role: string, vertices: array<struct<x: double, y: double>>>>>>"
)


def boundary_to_components(documents: DataFrame, json_column: str) -> DataFrame:
    """Component payload rows of boundary documents: outer ring, holes with three or more points, boxes."""
    doc = documents.select("design_id", F.from_json(json_column, BOUNDARY).alias("d"))
    shapes = doc.select("design_id", F.posexplode("d.geometries").alias("component_id", "g")).filter(F.col("g.outer_boundary").isNotNull())
    ring = lambda v: F.transform(v, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    holes = F.filter(
        F.transform(F.coalesce("g.holes", F.filter("g.holes", lambda h: F.lit(False))), lambda h, i: F.struct(
            F.coalesce(h["id"], F.format_string("hole_%03d", i)).alias("id"), F.coalesce(h["role"], F.lit("hole")).alias("role"),
            ring(h["vertices"]).alias("points"), _box(h["vertices"]).alias("bbox"),
        )), lambda h: F.size(h["points"]) >= 3,
    )
    outer = ring(F.col("g.outer_boundary.vertices"))
    return shapes.filter(F.size(outer) >= 3).select(
        "design_id", F.col("component_id").cast("long").alias("component_id"), F.lit(True).alias("closed"),
        F.coalesce("g.id", F.concat(F.lit("geometry_"), F.col("component_id").cast("string"))).alias("geometry_id"),
        outer.alias("points"), _box(outer).alias("bbox"), holes.alias("holes"),
    )


def components_to_boundary(payloads: DataFrame) -> DataFrame:
    """Boundary rows of component payloads in the board frame (y turned over the canvas)."""
    comps = payloads.select("design_id", F.col("payload.canvas").alias("canvas"), F.posexplode("payload.components").alias("n", "c"))
    origin = lambda i: F.coalesce(F.get("canvas.source_origin", F.lit(i)), F.lit(0.0))
    height = F.coalesce("canvas.height", F.lit(0.0))
    turn = lambda points: F.transform(
        points, lambda p: F.struct((p["x"] + origin(0)).alias("x"), (height - p["y"] + origin(1)).alias("y"))
    )
    holes = F.filter(
        F.transform(F.coalesce("c.holes", F.filter("c.holes", lambda h: F.lit(False))), lambda h, i: F.struct(
            F.coalesce(h["id"], F.format_string("slot_%03d", i + 1)).alias("id"), F.coalesce(h["role"], F.lit("hole")).alias("role"), turn(_samples(h)).alias("vertices")
        )), lambda h: F.size(h["vertices"]) >= 3,
    )
    rows = comps.select(
        "design_id", F.coalesce("c.component_id", F.concat(F.lit("geometry_"), F.col("n").cast("string"))).alias("geometry_id"),
        turn(_samples(F.col("c"))).alias("outer"), holes.alias("holes"),
    )
    return rows.filter(F.size("outer") >= 3)


# Names under which a gain may be stored.
# Names under which a gain is reported.
GAIN_KEYS = ["gain", "gain_dbi", "peak_gain_dbi", "realized_gain_dbi", "simulated_gain_dbi"]


@dataclass(frozen=True)
class _Found:
    """What a parsed JSON object holds: the number it stands for, if any."""

    number: float | None


def _finite(value) -> float | None:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number if math.isfinite(number) else None


def _inside(value) -> Iterator[float]:
    """Numbers found in objects at or below a parsed value, in order."""
    if isinstance(value, _Found):
        if value.number is not None:
            yield value.number
    elif isinstance(value, list):
        yield from chain.from_iterable(map(_inside, value))


def nested_number(column: str, keys: list[str] | None = None) -> Column:
    """First finite number under one of the names in nested JSON text.

    The keys of a level go before the values below it, depth first. The parser
    closes inner objects first, so each object is reduced to its number as it
    closes and nothing is walked afterwards.
    """
    names = {k.lower() for k in (keys or GAIN_KEYS)}

    def closed(pairs: list) -> _Found:
        fields = dict(pairs)
        own = (_finite(v) for k, v in fields.items() if k.lower() in names and not isinstance(v, (_Found, list)))
        below = chain.from_iterable(map(_inside, fields.values()))
        return _Found(next((n for n in chain(own, below) if n is not None), None))

    @F.pandas_udf(T.DoubleType())
    def search(texts: pd.Series) -> pd.Series:
        def read(text: str | None) -> float | None:
            try:
                return next(_inside(json.loads(text, object_pairs_hook=closed)), None) if text is not None else None
            except json.JSONDecodeError:
                return None

        return texts.map(read).astype("float64")

    return search(F.col(column))
