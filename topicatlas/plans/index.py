"""From revisions to counts of categories per address class or coordinate."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from topicatlas.operators.categories import category_ips, explode_categories
from topicatlas.operators.clean import clean_revisions, with_long_ip
from topicatlas.operators.dictionary import CategoryDictionary, category_dictionary
from topicatlas.operators.locate import resolve_locations
from topicatlas.operators.points import count_points
from topicatlas.operators.ranges import RangeIndex, index_ranges
from topicatlas.sources.locations import read_locations
from topicatlas.sources.revisions import read_revisions


def prepare_edits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Edits with an integer address, straight from the revision log."""
    return with_long_ip(clean_revisions(read_revisions(spark, path)))


def prepare_locations(
    spark: SparkSession, path: str | list[str], audit: Observation | None = None
) -> RangeIndex:
    """The index of unique ranges, written once: the lookups read it several times.

    ``audit`` is told what :func:`read_locations` tells it.
    """
    return index_ranges(read_locations(spark, path, audit))


def build_index(
    edits: DataFrame,
    locations: DataFrame | RangeIndex,
    method: str = "cells",
    check_upper: bool = False,
    literal: bool = False,
) -> DataFrame:
    """``category, class_ip, n``: the category index.

    ``check_upper`` and ``literal`` as in ``resolve_locations`` and ``explode_categories``.
    """
    resolved = resolve_locations(
        edits.select("categories", "long_ip"), locations, method, check_upper=check_upper
    )
    return category_ips(explode_categories(resolved, literal=literal))


def build_coded_index(
    edits: DataFrame,
    locations: DataFrame | RangeIndex,
    check_upper: bool = False,
    literal: bool = False,
) -> tuple[DataFrame, CategoryDictionary]:
    """The category index by number, ``category_id, class_ip, n``, and its dictionary.

    The names are gathered from the edits by themselves; the counts shuffle numbers.
    """
    exploded = explode_categories(edits.select("categories"), literal=literal)
    dictionary = category_dictionary(exploded)
    resolved = resolve_locations(edits.select("categories", "long_ip"), locations, check_upper=check_upper)
    return category_ips(dictionary.code(explode_categories(resolved, literal=literal))), dictionary


def locate_categories(
    edits: DataFrame,
    locations: DataFrame | RangeIndex,
    check_upper: bool = False,
    literal: bool = False,
) -> DataFrame:
    """``category, lon_udeg, lat_udeg, n`` in one pass, without the index in between.

    The as-of join carries the coordinates along, so the only shuffle of
    edit-sized data is that of the already combined counts.
    """
    resolved = resolve_locations(
        edits.select("categories", "long_ip"),
        locations,
        check_upper=check_upper,
        attach=["lon_udeg", "lat_udeg"],
    )
    placed = resolved.dropna(subset=["class_ip", "lon_udeg", "lat_udeg"])
    return count_points(explode_categories(placed, literal=literal))
