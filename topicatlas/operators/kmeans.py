"""Lloyd's k-means on planar coordinates, over distinct points with weights.

A bag of points and its distinct points with multiplicities have the same means,
so the loop reads at most one row per location.  Each update is one aggregation
whose result has k rows; only those reach the driver.
"""

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicatlas.functions.points import MICRO, degrees, random_points
from topicatlas.operators.lineage import cut_lineage, exists
from topicatlas.operators.pruning import mean_of_parts, point_grid, pruned_means, weighted_parts
from topicatlas.schemas import CENTROID, ITERATION_LOG, RUN

Centroid = tuple[float, float]

# Up to this many centroids the distances are one generated expression; beyond it
# the generated method is too long for the JIT and Arrow batches are faster.
EXPRESSION_CENTROIDS = 32

# From so many distances of an update on a grid of the points pays for itself.
PRUNED_DISTANCES = 20_000_000

# Work of one task in an update; a table of few, full files has too few tasks.
DISTANCES_PER_TASK = 2_000_000


def seed_centroids(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` distinct points in the order of a seeded hash, as ``cluster, lon_udeg, lat_udeg``."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "lon_udeg", "lat_udeg"))
    order = ["_draw", "lon_udeg", "lat_udeg"]
    distinct = points.select("lon_udeg", "lat_udeg").distinct()
    return _numbered(distinct.withColumn("_draw", draw).orderBy(*order).limit(k), order)


def seed_occurrences(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` occurrences without replacement: heavy points are likelier and may repeat.

    Every occurrence has an exponential key and the k smallest win.  The smallest
    key of a point with n occurrences is one draw divided by n, so the k points
    with the smallest first keys are enough; only those are expanded, each to at
    most k occurrences.  Rows that repeat a point add up.
    """

    def spacing(index: Column) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), "lon_udeg", "lat_udeg", index)
        bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
        uniform = (bits + 0.5) / F.lit(float(1 << 52))
        return -F.log(uniform) / (F.col("n") - index + 1)

    def smallest(df: DataFrame) -> DataFrame:
        return df.orderBy("_draw", "lon_udeg", "lat_udeg").limit(k)

    points = points.groupBy("lon_udeg", "lat_udeg").agg(F.sum("n").alias("n"))
    first = smallest(points.withColumn("_draw", spacing(F.lit(1).cast("bigint"))))
    index = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("n", F.lit(k).cast("bigint"))))
    upto = W.partitionBy("lon_udeg", "lat_udeg").orderBy("_index")
    expanded = (
        first.select("lon_udeg", "lat_udeg", "n", index.alias("_index"))
        .withColumn("_spacing", spacing(F.col("_index")))
        .withColumn("_draw", F.sum("_spacing").over(upto))
    )
    return _numbered(smallest(expanded), ["_draw", "lon_udeg", "lat_udeg"])


def _numbered(chosen: DataFrame, order: Sequence[str]) -> DataFrame:
    # k rows, so the single window partition is small.
    number = F.row_number().over(W.orderBy(*order)) - 1
    return chosen.select(number.cast("int").alias("cluster"), "lon_udeg", "lat_udeg")


def initial_centroids(
    points: DataFrame,
    k: int,
    seed: int = 0,
    init: str = "distinct",
    given: Sequence[Centroid] | None = None,
) -> list[Centroid]:
    """The given centroids, of which there must be k, else drawn ones.

    Fewer points than k is an error unless ``init`` is ``random``.
    """
    if given is not None:
        if len(given) != k:
            raise ValueError(f"{len(given)} centroids are given for k={k}")
        return [(float(lon), float(lat)) for lon, lat in given]
    if init == "random":
        rows = random_points(points.sparkSession, k, seed).orderBy("cluster").collect()
        return [(row["lon"], row["lat"]) for row in rows]
    draws = {"distinct": seed_centroids, "occurrence": seed_occurrences}
    if init not in draws:
        raise ValueError(f"unknown init {init!r}")
    rows = draws[init](points, k, seed).orderBy("cluster").collect()
    if len(rows) < k:
        raise ValueError(f"{len(rows)} points are too few for k={k}")
    return [(row["lon_udeg"] / MICRO, row["lat_udeg"] / MICRO) for row in rows]


def first_equal(centroids: Sequence[Centroid]) -> list[int]:
    """For every centroid, the lowest index holding the same coordinates."""
    seen: dict[Centroid, int] = {}
    return [seen.setdefault(centroid, index) for index, centroid in enumerate(centroids)]


def nearest_expression(lon: str, lat: str, centroids: Sequence[Centroid]) -> Column:
    """Index of the nearest centroid; of equally near ones the last."""
    # Listed backwards, so the first position of the minimum is the last centroid.
    # As text, because building it column by column costs more than a small update.
    distances = ", ".join(
        f"sqrt(({x!r}D - {lon}) * ({x!r}D - {lon}) + ({y!r}D - {lat}) * ({y!r}D - {lat}))"
        for x, y in reversed(centroids)
    )
    position = F.expr(f"array_position(array({distances}), array_min(array({distances})))")
    return (F.lit(len(centroids)) - position).cast("int")


def nearest_arrow(lon: str, lat: str, centroids: Sequence[Centroid]) -> Column:
    """The same on Arrow batches, for many centroids."""
    return _nearest_udf(tuple(centroids))(lon, lat)


def _nearest_udf(centroids: tuple[Centroid, ...]) -> Callable[..., Column]:
    xs = np.array([x for x, _ in reversed(centroids)])
    ys = np.array([y for _, y in reversed(centroids)])
    last = len(centroids) - 1
    rows_at_once = max(1, 1_000_000 // len(centroids))

    @F.pandas_udf("int")
    def nearest(lon: pd.Series, lat: pd.Series) -> pd.Series:
        found = np.empty(len(lon), dtype=np.int32)
        for start in range(0, len(lon), rows_at_once):
            rows = slice(start, start + rows_at_once)
            dx = xs[None, :] - lon.to_numpy()[rows, None]
            dy = ys[None, :] - lat.to_numpy()[rows, None]
            found[rows] = last - np.argmin(np.sqrt(dx * dx + dy * dy), axis=1)
        return pd.Series(found)

    return nearest


def nearest(points: DataFrame, centroids: Sequence[Centroid], method: str = "auto") -> DataFrame:
    """Adds ``cluster``, the index of the nearest centroid of a k-item list."""
    if method == "auto":
        method = "expression" if len(centroids) <= EXPRESSION_CENTROIDS else "arrow"
    forms = {"expression": nearest_expression, "arrow": nearest_arrow}
    placed = points.withColumns(
        {"_lon": degrees(F.col("lon_udeg")), "_lat": degrees(F.col("lat_udeg"))}
    )
    cluster = forms[method]("_lon", "_lat", list(centroids))
    return placed.withColumn("cluster", cluster).drop("_lon", "_lat")


def cluster_means(points: DataFrame, centroids: Sequence[Centroid], method: str = "auto") -> DataFrame:
    """``cluster, lon, lat, n`` of the clusters that have points.

    Sums are exact integers: they neither overflow nor depend on the order.  A
    product of coordinate and weight is summed in two parts, its low bits and the
    rest, and the parts meet as decimals on the k rows.
    """
    grouped = (
        nearest(points.withColumn("n", F.col("n").cast("bigint")), centroids, method)
        .groupBy("cluster")
        .agg(*weighted_parts("lon_udeg"), *weighted_parts("lat_udeg"), F.sum("n").alias("n"))
    )
    return grouped.select(
        "cluster", mean_of_parts("lon_udeg").alias("lon"), mean_of_parts("lat_udeg").alias("lat"), "n"
    )


def moved_centroids(centroids: Sequence[Centroid], means: dict[int, Centroid]) -> list[Centroid]:
    """Each centroid's new place; one without points stays where it is.

    Equal centroids are one: the last of them gets the points and all follow it.
    """
    first = first_equal(centroids)
    by_first = {first[cluster]: mean for cluster, mean in means.items()}
    return [by_first.get(first[i], centroid) for i, centroid in enumerate(centroids)]


def _moved_by(old: Centroid, new: Centroid) -> float:
    dx, dy = new[0] - old[0], new[1] - old[1]
    return math.sqrt(dx * dx + dy * dy)


@dataclass(frozen=True)
class Clustering:
    """Final centroids and what happened on the way; all of size k."""

    spark: SparkSession
    centroids: list[Centroid]
    log: list[tuple[int, int, float, float, float]]
    converged: bool
    #: Distances that pruned updates took, of points and of the boxes of cells.
    distances: int = 0

    def centroid_table(self) -> DataFrame:
        return centroid_table(self.spark, self.centroids)

    def iteration_log(self) -> DataFrame:
        """``iteration, cluster, lon, lat, movement`` after every update."""
        return self.spark.createDataFrame(self.log, ITERATION_LOG)


def centroid_table(spark: SparkSession, centroids: Sequence[Centroid]) -> DataFrame:
    """``cluster, lon, lat`` of all centroids."""
    rows = [(index, lon, lat) for index, (lon, lat) in enumerate(centroids)]
    return spark.createDataFrame(rows, CENTROID)


def _spread(points: DataFrame, k: int) -> DataFrame:
    """The points in enough partitions to keep the cluster busy."""
    slots = 3 * points.sparkSession.sparkContext.defaultParallelism
    wanted = min(math.ceil(points.count() * k / DISTANCES_PER_TASK), slots)
    return points.repartition(wanted) if points.rdd.getNumPartitions() < wanted else points


def _run_of(spark, folder, k, seed, init, given) -> tuple[list[Centroid] | None, list]:
    """The first centroids and the log of the updates a stopped run has written."""
    if folder is None or not exists(spark, f"{folder}/start/_SUCCESS"):
        return None, []
    start = spark.read.schema(RUN).parquet(f"{folder}/start").orderBy("cluster").collect()
    known = (start[0]["k"], start[0]["seed"], start[0]["init"])
    if known != (k, seed, init):
        raise ValueError(f"{folder} holds a run with k, seed, init = {known}")
    first = [(row["lon"], row["lat"]) for row in start]
    if given is not None and first != [(float(lon), float(lat)) for lon, lat in given]:
        raise ValueError(f"{folder} holds a run from other centroids")
    log = []
    while exists(spark, f"{folder}/update-{len(log) // k}/_SUCCESS"):
        rows = spark.read.schema(ITERATION_LOG).parquet(f"{folder}/update-{len(log) // k}")
        log += sorted(map(tuple, rows.collect()))
    return first, log


def _keep(spark, rows, schema, path: str) -> None:
    # What a lost driver left half written has no mark of success and is written anew.
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def kmeans(
    points: DataFrame,
    k: int,
    iterations: int | None = None,
    epsilon: float = 0.01,
    max_iter: int | None = None,
    given: Sequence[Centroid] | None = None,
    seed: int = 0,
    init: str = "distinct",
    method: str = "auto",
    stored: bool = False,
    folder: str | None = None,
) -> Clustering:
    """Clusters ``lon_udeg, lat_udeg, n`` rows.

    With ``iterations`` exactly that many updates are made and ``epsilon`` is not
    looked at; without (or 0) updates go on until no centroid moves more than
    ``epsilon``, at least one.  There is no other end unless ``max_iter`` names one;
    ``converged`` then tells which it was.

    The points are written to a table first, unless they are ``stored`` in one:
    an iteration that loses an executor re-reads them and recomputes nothing else.
    With a ``folder`` each update is written there, a table of k rows, and a run that
    lost its driver goes on behind the last one when it is called again.

    ``method`` is ``expression`` or ``arrow``, which compare all points with all
    centroids, or ``pruned``, which mostly compares cells of a grid; the results are
    equal to the bit.  ``auto`` takes the first up to 32 centroids, and beyond them the last
    for as many points as make a grid worth while.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if epsilon < 0 or (iterations or 0) < 0:
        raise ValueError("iterations and epsilon must not be negative")
    spark = points.sparkSession
    stable = points.select("lon_udeg", "lat_udeg", "n")
    if not stored:
        stable = cut_lineage(stable, "points")
    if method == "auto":
        few = k <= EXPRESSION_CENTROIDS
        method = "expression" if few else "pruned" if stable.count() * k > PRUNED_DISTANCES else "arrow"
    grid = point_grid(stable) if method == "pruned" else None
    stable = (grid.points if grid else _spread(stable, k)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first, log = _run_of(spark, folder, k, seed, init, given)
        if first is None:
            first = initial_centroids(stable, k, seed, init, given)
            if folder is not None:
                _keep(spark, [(c, lon, lat, k, seed, init) for c, (lon, lat) in enumerate(first)], RUN, f"{folder}/start")
        done = len(log) // k
        centroids = [(lon, lat) for _, _, lon, lat, _ in log[-k:]] if done else first
        converged = bool(done) and max(step for *_, step in log[-k:]) <= epsilon
        most = iterations or max_iter
        distances = 0
        for iteration in itertools.count(done):
            if (most and iteration >= most) or (iteration and converged and not iterations):
                break
            means = pruned_means(grid, centroids) if grid else cluster_means(stable, centroids, method)
            rows = means.collect()
            if grid:
                distances += grid.n_cells * k + sum(row["looked_at"] for row in rows)
            means = {row["cluster"]: (row["lon"], row["lat"]) for row in rows}
            moved = moved_centroids(centroids, means)
            steps = [_moved_by(old, new) for old, new in zip(centroids, moved)]
            update = [
                (iteration, cluster, lon, lat, step)
                for cluster, ((lon, lat), step) in enumerate(zip(moved, steps))
            ]
            if folder is not None:
                _keep(spark, update, ITERATION_LOG, f"{folder}/update-{iteration}")
            log += update
            centroids = moved
            converged = max(steps) <= epsilon
    finally:
        stable.unpersist()
    return Clustering(spark, centroids, log, converged, distances)


def assign(points: DataFrame, centroids: Sequence[Centroid], method: str = "auto") -> DataFrame:
    """Adds the final ``cluster``; equal centroids share the lowest of their indexes."""
    assigned = nearest(points, centroids, method)
    first = first_equal(centroids)
    if first == list(range(len(first))):
        return assigned
    lowest = F.array(*[F.lit(index) for index in first])
    return assigned.withColumn("cluster", F.get(lowest, F.col("cluster")))
