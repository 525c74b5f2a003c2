"""Coordinates with counts: per category, over all categories, and as lists."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from topicatlas.operators.categories import category_column
from topicatlas.operators.locate import attach_location
from topicatlas.operators.ranges import RangeIndex
from topicatlas.operators.skew import LIST_LENGTH, content_border_of_text, parted_lists


def count_points(located: DataFrame) -> DataFrame:
    """``category, lon_udeg, lat_udeg, n``: occurrences of a point within a category.

    Ranges with equal coordinates are one point.  Categories may be numbered.
    """
    counted = F.sum("n") if "n" in located.columns else F.count("*")
    return located.groupBy(category_column(located), "lon_udeg", "lat_udeg").agg(counted.alias("n"))


def category_points(
    category_ips: DataFrame, locations: DataFrame | RangeIndex, audit: Observation | None = None
) -> DataFrame:
    """The same from the category index and the location table; ``audit`` as there."""
    return count_points(attach_location(category_ips, locations, audit=audit))


def weighted_points(points: DataFrame) -> DataFrame:
    """``lon_udeg, lat_udeg, n``: distinct points with their multiplicity."""
    return points.groupBy("lon_udeg", "lat_udeg").agg(F.sum("n").alias("n"))


def point_total(points: DataFrame) -> DataFrame:
    """``points, occurrences``: rows of distinct coordinates and what they stand for."""
    distinct = weighted_points(points)
    return distinct.agg(
        F.count("*").alias("points"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")
    )


def point_categories(points: DataFrame, length: int = LIST_LENGTH) -> DataFrame:
    """``lon_udeg, lat_udeg, part, categories``: the categories of a point with counts.

    An export form; :func:`count_points` holds the same in rows.  A list is cut before
    categories whose name says so, about once in ``length`` names.
    """
    return parted_lists(
        points,
        ["lon_udeg", "lat_udeg"],
        order=["category"],
        item=F.struct("category", "n"),
        border=content_border_of_text(F.col("category"), length),
    ).withColumnRenamed("items", "categories")
