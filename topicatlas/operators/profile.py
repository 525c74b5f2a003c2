"""What the clusters consist of."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicatlas.operators.categories import category_column
from topicatlas.operators.kmeans import Centroid, assign, centroid_table
from topicatlas.operators.skew import BROADCAST_BYTES, ROWS_PER_TASK, balanced_join


def cluster_sizes(assignment: DataFrame) -> DataFrame:
    """``cluster, n``: occurrences per cluster; clusters without points are absent."""
    return assignment.groupBy("cluster").agg(F.sum("n").alias("n"))


def cluster_distinct_points(assignment: DataFrame) -> DataFrame:
    return assignment.select("cluster", "lon_udeg", "lat_udeg").distinct()


def cluster_point_categories(
    assignment: DataFrame,
    category_points: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``cluster, lon_udeg, lat_udeg, category, n``: distinct points with their categories."""
    return balanced_join(
        category_points,
        cluster_distinct_points(assignment),
        ["lon_udeg", "lat_udeg"],
        broadcast_bytes=broadcast_bytes,
        rows_per_task=rows_per_task,
    ).select("cluster", "lon_udeg", "lat_udeg", "category", "n")


def cluster_categories(
    category_points: DataFrame, centroids: Sequence[Centroid], method: str = "auto"
) -> DataFrame:
    """``cluster, category, n``: category totals per cluster.

    The cluster is a function of the coordinates alone, so it is computed on the
    rows at hand; looking it up in the assignment would shuffle both tables.
    """
    return count_categories(assign(category_points, centroids, method))


def count_categories(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster", category_column(clustered)).agg(F.sum("n").alias("n"))


def main_category(cluster_categories: DataFrame) -> DataFrame:
    """``cluster, category, n`` of the most frequent category; ties go to the first by name."""
    first = F.min_by(F.struct("category", "n"), F.struct(-F.col("n"), F.col("category")))
    return cluster_categories.groupBy("cluster").agg(first.alias("_best")).select(
        "cluster", F.col("_best")["category"].alias("category"), F.col("_best")["n"].alias("n")
    )


def super_clusters(main_categories: DataFrame) -> DataFrame:
    """``category, clusters``: clusters (at most k) that share a main category, in order."""
    return main_categories.groupBy("category").agg(
        F.sort_array(F.collect_list("cluster")).alias("clusters")
    )


def with_centroid(per_cluster: DataFrame, centroids: Sequence[Centroid]) -> DataFrame:
    """Adds ``lon, lat`` of the cluster's centroid (k rows, broadcast)."""
    table = centroid_table(per_cluster.sparkSession, centroids)
    return per_cluster.join(F.broadcast(table), "cluster")


def report_lines(cluster_categories: DataFrame, centroids: Sequence[Centroid]) -> DataFrame:
    """``cluster, n, category, line``: the lines of the cluster report.

    A heading ``cluster,lat,lon:`` (with null category) and one ``\\t(category,n)``
    line per category.  Rows instead of one long text per cluster, so that a
    sorted write spreads a large cluster over several tasks.
    """
    heading = F.concat(
        F.concat_ws(",", F.col("cluster"), F.col("lat").cast("string"), F.col("lon").cast("string")),
        F.lit(":"),
    )
    heads = with_centroid(cluster_categories.select("cluster").distinct(), centroids).select(
        "cluster", F.lit(None).cast("bigint").alias("n"),
        F.lit(None).cast("string").alias("category"), heading.alias("line"),
    )
    entry = F.concat(F.lit("\t("), F.col("category"), F.lit(","), F.col("n").cast("string"), F.lit(")"))
    entries = cluster_categories.select("cluster", "n", "category", entry.alias("line"))
    return heads.unionByName(entries)


def main_category_report(main_categories: DataFrame, centroids: Sequence[Centroid]) -> DataFrame:
    """``cluster, lat, lon, category, n``, one row per cluster with points."""
    return with_centroid(main_categories, centroids).select(
        "cluster", "lat", "lon", "category", "n"
    )
