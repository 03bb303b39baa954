"""Reading response curves from exported text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepfield.functions.numeric import is_finite
from sweepfield.operators.curves import complex_to_db
from sweepfield.plans.ordered import measure_spans, with_running
from sweepfield.plans.sizing import broadcast_if_small
from sweepfield.session import shared_folder

# Fixed pattern: what counts as a number inside a line of prose.
NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
# Tokens of a literal list: quoted strings, brackets, commas, everything else.
TOKEN = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[\[\](),]|[^\s\[\](),'"]+"""
_DIGITS = r"(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
REAL, COMPLEX = rf"^[-+]?{_DIGITS}$", rf"^([-+]?{_DIGITS})??([-+]?{_DIGITS})j$"
# What may stand between brackets and commas of a readable literal.
ATOM = rf"^(?:[-+]|[-+]?{_DIGITS}j?(?:[-+]{_DIGITS}j?)*[-+]?|None|True|False|['\"].*)$"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files below ``path`` with their file and their order in it.

    Large files are split across tasks; block start and a running number keep
    the order.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), "value",
    )


def _pair(freq: Column, value: Column) -> Column:
    return F.when(freq.isNotNull() & value.isNotNull(), F.struct(freq.alias("freq"), value.alias("value")))


def _literal_samples(lines: DataFrame) -> DataFrame:
    """``(path, freq, value)`` of files that hold one well-formed literal list, tuples over any number of lines.

    Tokens are numbered over the whole file; the running bracket depth tells
    which tuple and, by its commas, which field a token belongs to. Unreadable
    files give nothing, tuples without two numbers are left out.
    """
    c, order = F.col, ["block", "line_no", "pos"]
    tokens = lines.select("path", "block", "line_no", F.posexplode_outer(F.regexp_extract_all("value", F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    tokens = tokens.filter("tok IS NOT NULL")
    spans = measure_spans(tokens, ["path"], "block")
    opens, closes = c("tok").isin("(", "["), c("tok").isin(")", "]")
    step = F.when(opens, 1).when(closes, -1).otherwise(0).cast("long")
    deep = with_running(tokens, ["path"], order, {"depth": ("sum", step)}, spans).withColumn("level", c("depth") + closes.cast("int"))
    count = lambda hit: ("sum", hit.cast("long"))
    placed = with_running(deep, ["path"], order, {
        "item": count(opens & (c("level") == 2)), "commas": count((c("tok") == ",") & (c("level") == 2))}, spans)
    is_atom = ~opens & ~closes & (c("tok") != ",")
    # One list from the first token to the last, brackets of a kind in pairs, only readable atoms.
    number = lambda t: F.count_if(c("tok") == t)
    sound = placed.groupBy("path").agg(
        ((F.count_if(c("depth") <= 0) == 1) & (F.sum(step) == 0) & (number("(") == number(")")) & (number("[") == number("]"))
         & (F.count_if(is_atom & ~c("tok").rlike(ATOM)) == 0)).alias("sound")).filter("sound").select("path")
    # A nested list or tuple keeps its marks and so is no number.
    shown = is_atom | ((c("level") >= 3) & c("tok").isin(",", "["))
    items = placed.filter("level >= 2").join(sound, "path", "left_semi").groupBy("path", "item").agg(
        F.min("commas").alias("first"),
        F.array_sort(F.collect_list(F.when(shown, F.struct(*order, "commas", "tok")))).alias("atoms"))
    field = lambda k: F.regexp_replace(F.array_join(F.transform(
        F.filter("atoms", lambda a: a["commas"] == c("first") + k), lambda a: a["tok"]), " "), r"\s*([-+])\s*", "$1")
    texts = items.select("path", field(0).alias("f"), field(1).alias("v"))
    part = lambda i: F.when(F.regexp_extract("v", COMPLEX, i) == "", 0.0).otherwise(F.regexp_extract("v", COMPLEX, i).try_cast("double"))
    value = F.when(c("v").rlike(COMPLEX), complex_to_db(part(1), part(2))).when(c("v").rlike(REAL), c("v").try_cast("double"))
    found = texts.select("path", F.when(c("f").rlike(REAL), c("f").try_cast("double")).alias("freq"), value.alias("value"))
    return found.filter("freq IS NOT NULL AND value IS NOT NULL")


def _delimited(line: Column) -> Column:
    """The first two fields of a delimited line, when both are numbers."""
    parts = F.split(line, "[,;\t]")
    field = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    return F.array_compact(F.array(_pair(field(0), field(1))))


def _numbers(line: Column) -> Column:
    """The first two numbers found in a line."""
    found = F.regexp_extract_all(line, F.lit(f"({NUMBER})"), F.lit(1))
    at = lambda i: F.get(found, F.lit(i)).try_cast("double")
    return F.array_compact(F.array(_pair(at(0), at(1))))


def parse_sweep_lines(lines: DataFrame) -> DataFrame:
    """Samples of every file from ``lines(path, block, line_no, value)``.

    Three shapes are tried per file: a literal list (when the file starts with
    a bracket), delimited fields, and the first two numbers of a line; the first
    that yields any sample is used. The choice is one small row per file.
    """
    clean = lines.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    line, place = F.col("value"), F.struct("block", "line_no")
    per_file = clean.groupBy("path").agg(
        F.min_by(F.ltrim(line).startswith("["), F.when(F.trim(line) != "", place)).alias("_bracket"),
        F.bool_or(F.size(_delimited(line)) > 0).alias("_delimited"))
    bracketed = per_file.filter("_bracket").select("path")
    literal = _literal_samples(clean.join(broadcast_if_small(bracketed), "path", "left_semi"))
    taken = literal.select("path").distinct()
    rest = clean.join(broadcast_if_small(per_file.select("path", "_delimited")), "path").join(broadcast_if_small(taken), "path", "left_anti")
    other = rest.select("path", F.inline_outer(F.when(F.col("_delimited"), _delimited(line)).otherwise(_numbers(line))))
    rows = literal.unionByName(other)
    return rows.filter(is_finite(F.col("freq")) & is_finite(F.col("value")))


def read_sweeps(spark: SparkSession, path: str) -> DataFrame:
    """Curves of all files below ``path`` as ``(path, freq, value)``.

    Their lines are used several times, and opening many small files costs far
    more than their lines do: each file is opened once.
    """
    shared_folder(spark)
    return parse_sweep_lines(text_lines(spark, path).checkpoint())


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` with modification time; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("modificationTime").alias("mtime"))


# Fixed pattern: names of exported curve files.
CURVE_NAME = r"(s11|S11)[^/]*\.(csv|txt)$"


def latest_file_per_group(files: DataFrame, keys: list[str]) -> DataFrame:
    """Newest matching curve file of each group: ``files(…, path, mtime)``; the first path on ties."""
    named = files.filter(F.regexp_extract("path", "([^/]*)$", 1).rlike(CURVE_NAME))
    newest = named.groupBy(*keys).agg(F.max("mtime").alias("mtime"))
    return named.join(newest, [*keys, "mtime"]).groupBy(*keys, "mtime").agg(F.min("path").alias("path"))
