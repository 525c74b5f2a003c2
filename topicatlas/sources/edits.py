"""Pipe-delimited edit files, columns fixed by position."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicatlas.functions.ip import is_digits, safe_long
from topicatlas.functions.points import to_udeg
from topicatlas.schemas import CLEAN_COLUMNS, EDIT_WITH_LOC

# Positions used in each layout; the last one is the fewest a line must have.
LONG_IP_POSITION = 6
CLASS_POSITION = 7
ENRICHED_POSITIONS = {
    "article_id": 0,
    "rev_id": 1,
    "article_title": 2,
    "category": 5,
    "textdata": 7,
    "country_code": 9,
    "country_name": 10,
    "region_name": 11,
    "city_name": 12,
}
ENRICHED_LONG_IP, ENRICHED_LATITUDE, ENRICHED_LONGITUDE = 8, 13, 14


def _cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select("value", F.split("value", r"\|").alias("cells"))


def _cell(position: int) -> Column:
    return F.get("cells", F.lit(position))


def _plain_edits(cells: DataFrame, ip_position: int) -> DataFrame:
    columns = [_cell(i).alias(name) for i, name in enumerate(CLEAN_COLUMNS)]
    columns[1] = F.trim(_cell(1)).alias("rev_id")
    return cells.filter(F.size("cells") > ip_position).select(
        *columns,
        safe_long(_cell(ip_position)).alias("long_ip"),
        (is_digits(_cell(ip_position)) & _cell(ip_position).try_cast("bigint").isNotNull()).alias("valid_ip"),
    )


def read_edits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Seven-column edits; an unreadable address is 0 with ``valid_ip`` false."""
    return _plain_edits(_cells(spark, path), LONG_IP_POSITION)


def read_edits_with_class(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Eight-column edits whose last column is the class address, as ``class_ip``."""
    edits = _plain_edits(_cells(spark, path), CLASS_POSITION)
    return edits.withColumnRenamed("long_ip", "class_ip")


def read_edits_with_location(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Fifteen-column edits already joined to their location."""
    cells = _cells(spark, path).filter(F.size("cells") > ENRICHED_LONGITUDE)
    columns = {name: _cell(position) for name, position in ENRICHED_POSITIONS.items()}
    columns["rev_id"] = F.trim(columns["rev_id"])
    return cells.select(
        *[column.alias(name) for name, column in columns.items()],
        safe_long(_cell(ENRICHED_LONG_IP)).alias("long_ip"),
        to_udeg(_cell(ENRICHED_LATITUDE)).alias("lat_udeg"),
        to_udeg(_cell(ENRICHED_LONGITUDE)).alias("lon_udeg"),
    ).select(*EDIT_WITH_LOC.fieldNames())


def malformed_edits(
    spark: SparkSession, path: str | list[str], last_position: int = LONG_IP_POSITION
) -> DataFrame:
    """Lines too short to hold the column at ``last_position``."""
    return _cells(spark, path).filter(F.size("cells") <= last_position).select("value")
