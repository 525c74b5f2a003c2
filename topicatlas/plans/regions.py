"""From category counts per coordinate to regions and their interests."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicatlas.functions import text
from topicatlas.operators import profile, raster
from topicatlas.operators.categories import filter_categories
from topicatlas.operators.dictionary import CategoryDictionary
from topicatlas.operators.kmeans import Centroid, Clustering, assign, kmeans
from topicatlas.operators.lineage import cut_lineage
from topicatlas.operators.points import point_total, weighted_points
from topicatlas.sinks.text import write_cluster_report, write_main_categories


# Names of the report folders.
CLUSTER_REPORT, MAIN_REPORT = "clustersCats.csv", "mainCats.csv"


@dataclass(frozen=True)
class Regions:
    """A clustering with the tables that describe it, each built when asked for."""

    category_points: DataFrame
    points: DataFrame
    clustering: Clustering
    #: Names of the categories where the points have numbers.
    dictionary: CategoryDictionary | None = None

    @property
    def centroids(self) -> list[Centroid]:
        return self.clustering.centroids

    @cached_property
    def assignment(self) -> DataFrame:
        return assign(self.points, self.centroids)

    @cached_property
    def sizes(self) -> DataFrame:
        return profile.cluster_sizes(self.assignment)

    @cached_property
    def categories(self) -> DataFrame:
        """Written once: every table below reads it."""
        counts = profile.cluster_categories(self.category_points, self.centroids)
        if self.dictionary:
            counts = self.dictionary.name(counts).select("cluster", "category", "n")
        return cut_lineage(counts, "cluster-categories")

    @cached_property
    def main_categories(self) -> DataFrame:
        return profile.main_category(self.categories)

    @cached_property
    def super_clusters(self) -> DataFrame:
        return profile.super_clusters(self.main_categories)

    @cached_property
    def summary(self) -> DataFrame:
        """``cluster, lon, lat, size, category, n``: one row per cluster with points."""
        sizes = self.sizes.withColumnRenamed("n", "size")
        # Both sides have at most k rows.
        described = self.main_categories.join(F.broadcast(sizes), "cluster")
        return profile.with_centroid(described, self.centroids).select(
            "cluster", "lon", "lat", "size", "category", "n"
        )

    def pixel_grid(
        self, width: int = raster.WIDTH, height: int = raster.HEIGHT, clip: bool = False
    ) -> DataFrame:
        grid = raster.pixel_grid(self.assignment, width, height, clip)
        table = self.clustering.centroid_table()
        return raster.paint_grid(grid, raster.cluster_colors(table, len(self.centroids)))

    def pixel_grid_grouped(
        self, width: int = raster.WIDTH, height: int = raster.HEIGHT, clip: bool = False
    ) -> DataFrame:
        grid = raster.pixel_grid(self.assignment, width, height, clip)
        return raster.pixel_grid_grouped(grid, self.super_clusters)

    def markers(self, with_numbers: bool = False) -> DataFrame:
        return raster.cluster_markers(self.centroids, self.sizes, with_numbers)

    def markers_grouped(self, with_numbers: bool = False) -> DataFrame:
        return raster.grouped_markers(self.markers(with_numbers), self.super_clusters)

    @property
    def legend(self) -> DataFrame:
        return raster.legend(self.main_categories, len(self.centroids))

    @property
    def super_legend(self) -> DataFrame:
        return raster.super_legend(self.super_clusters)

    def captions(self, words: Sequence[str], iterations: int, epsilon: float) -> DataFrame:
        """One row: the caption lines of the run, its totals, and whether it came to rest."""
        lines = text.run_caption(words, len(self.centroids), iterations, epsilon)
        return point_total(self.points).select(
            lines[0].alias("words"),
            lines[1].alias("settings"),
            text.total_caption(F.col("occurrences")).alias("total"),
            "points",
            "occurrences",
            F.lit(len(self.clustering.log) // len(self.centroids)).alias("updates"),
            F.lit(self.clustering.converged).alias("converged"),
        )

    def write_reports(self, folder: str, mode: str = "errorifexists") -> None:
        """The cluster report and the main categories below ``folder``."""
        report, main = f"{folder}/{CLUSTER_REPORT}", f"{folder}/{MAIN_REPORT}"
        write_cluster_report(self.categories, self.centroids, report, mode=mode)
        write_main_categories(self.main_categories, self.centroids, main, mode=mode)


def find_regions(
    category_points: DataFrame,
    k: int,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    literal: bool = False,
    match: str = "any",
    dictionary: CategoryDictionary | None = None,
    **clustering,
) -> Regions:
    """Clusters the points of the wanted categories.

    With a ``dictionary`` the points carry ``category_id``: words are looked for in the
    dictionary, and names come back on the totals of the clusters.  Further arguments go to :func:`topicatlas.operators.kmeans.kmeans`.  The
    filtered counts are written once: the clustering and every table read them.
    """
    words = {"include": include, "exclude": exclude, "match": match, "literal": literal}
    wanted = dictionary.filter(category_points, **words) if dictionary else filter_categories(category_points, **words)
    wanted = cut_lineage(wanted, "category-points")
    points = cut_lineage(weighted_points(wanted), "weighted-points")
    return Regions(wanted, points, kmeans(points, k, stored=True, **clustering), dictionary)
