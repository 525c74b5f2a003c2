"""The tables behind the maps: pixel counts, markers and legends."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicatlas.functions.points import degrees
from topicatlas.functions.raster import brighter, group_color, pixel_x, pixel_y, rgb
from topicatlas.functions.text import cluster_label, legend_label, spaced
from topicatlas.operators.kmeans import Centroid, centroid_table

WIDTH, HEIGHT = 2000, 1000


def pixel_coords(
    points: DataFrame, width: int = WIDTH, height: int = HEIGHT, clip: bool = False
) -> DataFrame:
    """Adds pixel ``x, y``.  Longitude 180 and latitude -90 fall one pixel outside
    unless ``clip`` moves them in."""
    x = pixel_x(degrees(F.col("lon_udeg")), width)
    y = pixel_y(degrees(F.col("lat_udeg")), height)
    if clip:
        x, y = F.least(x, F.lit(width - 1)), F.least(y, F.lit(height - 1))
    return points.withColumn("x", x).withColumn("y", y)


def pixel_grid(
    assignment: DataFrame, width: int = WIDTH, height: int = HEIGHT, clip: bool = False
) -> DataFrame:
    """``x, y, cluster, n``: occurrences per pixel and cluster."""
    return (
        pixel_coords(assignment, width, height, clip)
        .groupBy("x", "y", "cluster")
        .agg(F.sum("n").alias("n"))
    )


def cluster_colors(centroids: DataFrame, k: int) -> DataFrame:
    """``cluster, red, green, blue`` for a table with a ``cluster`` column."""
    color = group_color(F.col("cluster"), k)
    return centroids.select("cluster", color.alias("_color")).select("cluster", "_color.*")


def paint_grid(grid: DataFrame, colors: DataFrame) -> DataFrame:
    """Adds the point colour of each pixel: its cluster's colour, one step brighter.

    ``colors`` has one row per cluster, k at most.
    """
    shade = colors.select("cluster", brighter(rgb(F.col("red"), F.col("green"), F.col("blue"))).alias("_shade"))
    return grid.join(F.broadcast(shade), "cluster").select(*grid.columns, "_shade.*")


def numbered_super_clusters(super_clusters: DataFrame) -> DataFrame:
    """``category, clusters, position, groups``: super clusters (k at most) by name."""
    # At most k rows, so the single window partition is small.
    order = W.orderBy("category")
    every = W.orderBy("category").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return super_clusters.select(
        "category", "clusters",
        (F.row_number().over(order) - 1).alias("position"),
        F.count("*").over(every).cast("int").alias("groups"),
    )


def super_colors(super_clusters: DataFrame) -> DataFrame:
    """``cluster, category, red, green, blue``: every cluster in its group's colour."""
    color = group_color(F.col("position"), F.col("groups"))
    return numbered_super_clusters(super_clusters).select(
        F.explode("clusters").alias("cluster"), "category", color.alias("_color")
    ).select("cluster", "category", "_color.*")


def pixel_grid_grouped(grid: DataFrame, super_clusters: DataFrame) -> DataFrame:
    """The pixel grid with each pixel's main category and the colour of its group."""
    colors = super_colors(super_clusters)
    shade = colors.select(
        "cluster", "category", brighter(rgb(F.col("red"), F.col("green"), F.col("blue"))).alias("_shade")
    )
    return grid.join(F.broadcast(shade), "cluster").select(*grid.columns, "category", "_shade.*")


def cluster_markers(
    centroids: Sequence[Centroid],
    sizes: DataFrame,
    with_numbers: bool = False,
    width: int = WIDTH,
    height: int = HEIGHT,
) -> DataFrame:
    """``cluster, x, y, red, green, blue, label, n`` of every centroid.

    A centroid without points has no label.
    """
    table = centroid_table(sizes.sparkSession, centroids)
    color = group_color(F.col("cluster"), len(centroids))
    marked = table.join(F.broadcast(sizes), "cluster", "left").select(
        "cluster",
        pixel_x(F.col("lon"), width).alias("x"),
        pixel_y(F.col("lat"), height).alias("y"),
        color.alias("_color"),
        F.when(F.col("n").isNotNull(), cluster_label(F.col("cluster"), F.col("n"), with_numbers))
        .alias("label"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
    return marked.select("cluster", "x", "y", "_color.*", "label", "n")


def grouped_markers(markers: DataFrame, super_clusters: DataFrame) -> DataFrame:
    """The markers with the main category of each and the colour of its group.

    A centroid without points is in no group and has neither.
    """
    colors = super_colors(super_clusters)
    return markers.drop("red", "green", "blue").join(F.broadcast(colors), "cluster", "left")


def _row_offset(position, count, height: int, step: int):
    top = F.when(count <= 15, F.lit(height // 2)).otherwise(F.lit(height // 4))
    return (top + position * step).cast("int")


def legend(main_categories: DataFrame, k: int, height: int = HEIGHT) -> DataFrame:
    """``cluster, red, green, blue, label, y``: one legend row per cluster, in order."""
    # At most k rows, so the single window partition is small.
    every = W.orderBy("cluster").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    position = F.row_number().over(W.orderBy("cluster")) - 1
    return main_categories.select(
        "cluster",
        group_color(F.col("cluster"), k).alias("_color"),
        legend_label(F.col("cluster"), F.col("category"), F.col("n")).alias("label"),
        _row_offset(position, F.count("*").over(every), height, 30).alias("y"),
    ).select("cluster", "_color.*", "label", "y")


def super_legend(super_clusters: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``category, red, green, blue, label, y``: one legend row per super cluster."""
    numbered = numbered_super_clusters(super_clusters)
    return numbered.select(
        "category",
        group_color(F.col("position"), F.col("groups")).alias("_color"),
        spaced(F.col("category")).alias("label"),
        _row_offset(F.col("position"), F.col("groups"), height, 20).alias("y"),
    ).select("category", "_color.*", "label", "y")
