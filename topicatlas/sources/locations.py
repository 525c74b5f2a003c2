"""The quoted CSV of address ranges with their coordinates."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from topicatlas.functions.ip import IPV4_MAX, digits_to_long
from topicatlas.functions.points import to_udeg

_FILE_COLUMNS = [
    "ip_from", "ip_to", "country_code", "country_name", "region_name", "city_name",
    "latitude", "longitude", "zip",
]
_FILE_SCHEMA = StructType([StructField(name, StringType()) for name in _FILE_COLUMNS])


def _typed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    rows = spark.read.csv(path, schema=_FILE_SCHEMA, quote='"', escape='"', mode="PERMISSIVE")
    return rows.select(
        digits_to_long(F.col("ip_from")).alias("ip_from"),
        digits_to_long(F.col("ip_to")).alias("ip_to"),
        "country_code", "country_name", "region_name", "city_name",
        to_udeg(F.col("latitude")).alias("lat_udeg"),
        to_udeg(F.col("longitude")).alias("lon_udeg"),
    )


def _has_start():
    return F.coalesce(F.col("ip_from").between(0, IPV4_MAX), F.lit(False))


def _usable():
    return _has_start() & F.col("lat_udeg").isNotNull() & F.col("lon_udeg").isNotNull()


def read_locations(
    spark: SparkSession, path: str | list[str], audit: Observation | None = None
) -> DataFrame:
    """Ranges with a readable IPv4 start.

    Unreadable coordinates are null: the range keeps its addresses, which would
    otherwise fall to the range before, and they are located nowhere.  ``audit`` is
    told ``unusable_range``, the rows of :func:`malformed_locations`, by the first
    action that reads the ranges.
    """
    rows = _typed(spark, path)
    if audit is not None:
        rows = rows.observe(audit, F.count_if(~_usable()).alias("unusable_range"))
    return rows.filter(_has_start())


def malformed_locations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Ranges left out for their start, and ranges located nowhere."""
    return _typed(spark, path).filter(~_usable())
