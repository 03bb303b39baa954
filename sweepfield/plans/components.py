"""Connected components by repeated minimum labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepfield.session import shared_folder

TILE_BITS = 4
TILE = 1 << TILE_BITS  # side of a square of cells that is labelled in one go
TILE_ROWS = 2_000  # tiles that go side by side


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest node id of each node's component.

    ``nodes(node)`` holds distinct ids, ``links(a, b)`` has both directions.
    Each round takes the smallest label around a node and then jumps to that
    label's own label, so long chains shrink quickly. Rounds are checkpointed
    to the shared folder and survive lost executors.
    """
    shared_folder(nodes.sparkSession)
    links = links.checkpoint()
    labels = nodes.select("node", F.col("node").alias("label")).checkpoint()
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_near"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", "label", F.least("label", "_near").alias("_low")
        ).checkpoint()
        if lower.filter(F.col("_low") < F.col("label")).isEmpty():
            return labels
        roots = lower.select(F.col("node").alias("_root"), F.col("_low").alias("_top"))
        labels = lower.join(roots, F.col("_low") == F.col("_root"), "left").select(
            "node", F.least("_low", "_top").alias("label")
        ).checkpoint()


def tile_labels(tile: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the cells by tile, x and y, and the place in that order of the least cell each one touches inside its tile.

    ``x`` and ``y`` count from the tile's corner. All tiles go side by side.
    """
    side = TILE + 2  # a margin, so that neighbours never run into the next line
    code = (tile * side + x + 1) * side + y + 1
    order = np.argsort(code, kind="stable")
    code = code[order]
    label = np.arange(len(code))
    ends = []
    for step in (1, side - 1, side, side + 1):
        at = np.minimum(np.searchsorted(code, code + step), len(code) - 1)
        hit = np.flatnonzero(code[at] == code + step)
        ends.append((hit, at[hit]))
    left, right = (np.concatenate(e) for e in zip(*ends))
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return order, label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def grid_components(cells: DataFrame, keys: list[str], x: str = "cell_x", y: str = "cell_y") -> DataFrame:
    """Label distinct occupied cells, numbered by whole numbers, that touch, diagonals included.

    Cells link only within equal ``keys``; a cell without a coordinate stands
    alone. Cells of a tile are labelled together in one task. Only keys that
    spread over several tiles go on: cells at the edges of their tiles link the
    parts, so links grow with the edges and never with pairs of rows.
    """
    spot = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    tile_of = lambda n: F.shiftright(F.col(n).cast("long"), TILE_BITS)
    tile = [tile_of(n).alias(f"_t{n}") for n in (x, y)]
    placed = cells.select(*keys, x, y, *tile)
    own = [*keys, f"_t{x}", f"_t{y}"]
    tiles = placed.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*own).agg(F.collect_set(spot(x, y)).alias("_cells"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, TILE_ROWS) for whole in batches for at in range(0, whole.num_rows, TILE_ROWS)):
            lists = batch.column(len(own))
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            spots = pc.list_flatten(lists)
            row = np.repeat(np.arange(batch.num_rows), counts)
            inside = [
                spots.field(k).to_numpy(zero_copy_only=False).astype(np.int64) - TILE * batch.column(len(keys) + k).to_numpy().astype(np.int64)[row]
                for k in (0, 1)]
            order, least = tile_labels(row, *inside)
            sorted_spots, rows = spots.take(pa.array(order)), pa.array(row[order])
            lead = sorted_spots.take(pa.array(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(rows) for k in range(len(own))]
                + [part.field(k) for part in (sorted_spots, lead) for k in (0, 1)], names=[*own, x, y, "_lx", "_ly"])

    kind = {f.name: f.dataType.simpleString() for f in tiles.schema.fields} | {n: cells.schema[n].dataType.simpleString() for n in (x, y)}
    schema = ", ".join(f"`{n}` {kind[n]}" for n in [*own, x, y]) + f", _lx {kind[x]}, _ly {kind[y]}"
    parts = tiles.mapInArrow(label, schema)
    alone = placed.filter(F.col(x).isNull() | F.col(y).isNull()).select(*keys, x, y).distinct().select(*keys, x, y, spot(x, y).alias("region"))
    wide = placed.groupBy(*keys).agg(*[f(f"_t{n}").alias(f"_{f.__name__}_{n}") for n in (x, y) for f in (F.min, F.max)]).filter(
        (F.col(f"_min_{x}") < F.col(f"_max_{x}")) | (F.col(f"_min_{y}") < F.col(f"_max_{y}"))).select(*[F.col(k).alias(f"_k{k}") for k in keys])
    if wide.isEmpty():
        return parts.select(*keys, x, y, spot("_lx", "_ly").alias("region")).unionByName(alone)

    same = [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys]
    shared_folder(cells.sparkSession)
    parts = parts.checkpoint()
    node = F.struct(*[F.col(k) for k in keys], F.col("_lx").alias("x"), F.col("_ly").alias("y"))
    at = lambda n: F.pmod(F.col(n), F.lit(TILE))
    edge = parts.join(wide, same, "left_semi").filter(at(x).isin(0, TILE - 1) | at(y).isin(0, TILE - 1)).select(node.alias("a"), *own, x, y)
    shifts = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    moved = edge.select("a", *keys, f"_t{x}", f"_t{y}", F.inline(F.array(*[
        F.struct((F.col(x) + a).alias("_x"), (F.col(y) + b).alias("_y")) for a, b in shifts
    ]))).filter((tile_of("_x") != F.col(f"_t{x}")) | (tile_of("_y") != F.col(f"_t{y}")))
    other = edge.select(F.col("a").alias("b"), *[F.col(k).alias(f"_k{k}") for k in keys], x, y)
    links = moved.drop(f"_t{x}", f"_t{y}").join(other, [*same, F.col("_x") == F.col(x), F.col("_y") == F.col(y)]).select("a", "b").distinct()
    found = connected_components(links.select(F.col("a").alias("node")).distinct(), links).select(F.col("node").alias("_node"), "label")
    region = F.when(F.col("label").isNull(), spot("_lx", "_ly")).otherwise(spot("label.x", "label.y"))
    return parts.join(found, node == F.col("_node"), "left").select(*keys, x, y, region.alias("region")).unionByName(alone)
