"""Exact k-means updates that look at few distances: points by cells of a grid.

Per cell the weights and weighted coordinates of its points are summed once, with the
box around them.  In an update most boxes have one centroid that is the nearest of all
their points, whatever the point: these cells are assigned whole by their sums.  The
points of the others are compared with the centroids that can be nearest in their box.
Bounds leave room for rounding, and sums are exact integers, so the means are those of
comparing every point with every centroid, to the bit.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from topicatlas.functions.points import MICRO
from topicatlas.operators.lineage import cut_lineage

Centroid = tuple[float, float]

#: Micro-degrees of a side of a cell: 259,200 cells at most on the map, whatever the data.
CELL = 500_000
#: Share by which bounds are widened, far above the rounding of a distance.
ROOM = 1e-9
# Low bits of a product that are summed apart.
PART_BITS = 20
#: Pairs of a box or point and a centroid that are looked at together.
PAIRS_AT_ONCE = 1_000_000

SUMS = [f"_{part}_{axis}" for axis in ("lon_udeg", "lat_udeg") for part in ("high", "low")]


def weighted_parts(column: str, weight: str = "n") -> list[Column]:
    """A product of coordinate and weight in two parts, its low bits and the rest.

    Their sums are exact and do not overflow.
    """
    low_n = F.col(weight).bitwiseAND((1 << PART_BITS) - 1)
    high_n = F.shiftright(weight, PART_BITS)
    value = F.col(column).cast("bigint")
    high = value * high_n + F.shiftright(value * low_n, PART_BITS)
    low = (value * low_n).bitwiseAND((1 << PART_BITS) - 1)
    return [F.sum(high).alias(f"_high_{column}"), F.sum(low).alias(f"_low_{column}")]


def mean_of_parts(column: str) -> Column:
    """The mean in degrees, from the parts and the sum of weights ``n``."""
    high = F.col(f"_high_{column}").cast("decimal(19,0)") * F.lit(1 << PART_BITS).cast("decimal(8,0)")
    total = (high + F.col(f"_low_{column}").cast("decimal(19,0)")).cast("double")
    return total / F.col("n").cast("double") / F.lit(float(MICRO))


@dataclass(frozen=True)
class PointGrid:
    """Points with their cell, and a row per cell with its box and sums; both are written."""

    points: DataFrame
    cells: DataFrame
    n_points: int
    n_cells: int


def point_grid(points: DataFrame, cell: int = CELL) -> PointGrid:
    """The grid of ``lon_udeg, lat_udeg, n``."""
    x, y = (F.floor(F.col(axis) / cell).cast("bigint") for axis in ("lon_udeg", "lat_udeg"))
    placed = points.select(
        "lon_udeg", "lat_udeg", F.col("n").cast("bigint").alias("n"), (F.shiftleft(x, 32) + y).alias("cell")
    )
    # Points of a cell lie together, so a task meets few cells.
    placed = cut_lineage(placed.repartitionByRange("cell", "lon_udeg", "lat_udeg"), "points-by-cell")
    box = [f(axis).alias(f"{name}_{axis}") for axis in ("lon_udeg", "lat_udeg") for name, f in (("least", F.min), ("most", F.max))]
    cells = placed.groupBy("cell").agg(
        *box, *weighted_parts("lon_udeg"), *weighted_parts("lat_udeg"), F.sum("n").alias("n"), F.count("*").alias("points")
    )
    cells = cut_lineage(cells, "cells")
    n_points, n_cells = cells.agg(F.coalesce(F.sum("points"), F.lit(0)), F.count("*")).first()
    return PointGrid(placed, cells, n_points, n_cells)


def possible_centroids(box: Sequence[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of boxes and centroids, which centroid can be the nearest of a point in a box.

    It can if its least distance to the box is not above the least of the greatest
    distances of all centroids.
    """
    left, right, bottom, top = (side[:, None] for side in box)
    dx = np.maximum(np.maximum(left - x, x - right), 0.0)
    dy = np.maximum(np.maximum(bottom - y, y - top), 0.0)
    far_x, far_y = np.maximum(np.abs(left - x), np.abs(right - x)), np.maximum(np.abs(bottom - y), np.abs(top - y))
    near, far = dx * dx + dy * dy, far_x * far_x + far_y * far_y
    bound = far.min(axis=1) * (1 + ROOM) + ROOM * ROOM
    return near * (1 - ROOM) <= bound[:, None]


def judged_cells(cells: DataFrame, centroids: Sequence[Centroid]) -> DataFrame:
    """Adds ``possible``: the centroids that can be nearest to points of a cell, in order.

    Of equal centroids only the last can: they tie everywhere, and it is the last that counts.
    """
    x, y = (np.array([c[i] for c in centroids]) for i in (0, 1))
    last = {c: k for k, c in enumerate(centroids)}
    kept = np.array(sorted(last.values()))
    columns = cells.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, PAIRS_AT_ONCE // len(kept))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                box = [part.column(f"{n}_{a}").to_numpy() / MICRO for a in ("lon_udeg", "lat_udeg") for n in ("least", "most")]
                possible = possible_centroids(box, x[kept], y[kept])
                offsets = np.append(0, np.cumsum(possible.sum(axis=1))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept[np.nonzero(possible)[1]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], lists], [*columns, "possible"])

    return cells.mapInArrow(task, StructType([*cells.schema.fields, StructField("possible", ArrayType(IntegerType()))]))


def _nearest_of_possible(centroids: Sequence[Centroid], columns: Sequence[str]):
    x, y = (np.array([c[i] for c in centroids]) for i in (0, 1))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("possible")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(counts):
                continue
            candidate = lists.flatten().to_numpy(zero_copy_only=False)
            lon, lat = (np.repeat(batch.column(c).to_numpy() / MICRO, counts) for c in ("lon_udeg", "lat_udeg"))
            dx, dy = x[candidate] - lon, y[candidate] - lat
            distance = np.sqrt(dx * dx + dy * dy)
            starts = np.cumsum(counts) - counts
            nearest = np.repeat(np.minimum.reduceat(distance, starts), counts)
            # Candidates are in order; of the equally near ones the last counts.
            cluster = np.maximum.reduceat(np.where(distance == nearest, candidate, -1), starts)
            arrays = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(cluster.astype(np.int32))], [*columns, "cluster"])

    return task


def pruned_means(grid: PointGrid, centroids: Sequence[Centroid]) -> DataFrame:
    """``cluster, lon, lat, n, looked_at`` of the clusters that have points.

    ``looked_at`` is how many distances of points the update took for the cluster; each
    cell took one of its box for each centroid.
    """
    alone = F.size("possible") == 1
    whole = judged_cells(grid.cells, centroids).filter(alone).select(
        F.col("possible")[0].alias("cluster"), *SUMS, "n", F.lit(0).cast("bigint").alias("looked_at")
    )
    # A row per cell at most, bounded by the map.
    boxes = grid.cells.select("cell", *[c for c in grid.cells.columns if c.startswith(("least_", "most_"))])
    open_cells = judged_cells(boxes, centroids).filter(~alone).select("cell", "possible")
    rest = grid.points.join(F.broadcast(open_cells), "cell")
    rest = rest.select(
        F.col("lon_udeg").cast("bigint"), F.col("lat_udeg").cast("bigint"), "n",
        F.size("possible").cast("bigint").alias("looked_at"), "possible",
    )
    columns = ["lon_udeg", "lat_udeg", "n", "looked_at"]
    schema = ", ".join(f"{c} bigint" for c in columns) + ", cluster int"
    single = rest.mapInArrow(_nearest_of_possible(centroids, columns), schema)
    by_point = single.groupBy("cluster").agg(
        *weighted_parts("lon_udeg"), *weighted_parts("lat_udeg"), F.sum("n").alias("n"), F.sum("looked_at").alias("looked_at")
    )
    sums = whole.unionByName(by_point).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in (*SUMS, "n", "looked_at")])
    return sums.select("cluster", mean_of_parts("lon_udeg").alias("lon"), mean_of_parts("lat_udeg").alias("lat"), "n", "looked_at")
