"""Planar points: ``struct<lon: double, lat: double>`` columns.

Equality and grouping of such structs go by value, as Spark does anyway.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICRO = 1_000_000


def degrees(udeg: Column) -> Column:
    """Micro-degrees to degrees; one exact division, so it equals the parsed text."""
    return udeg.cast("double") / F.lit(float(MICRO))


def to_udeg(text: Column) -> Column:
    """Degrees as text to micro-degrees (rounded to six decimals), null if not a number."""
    return F.round(text.try_cast("decimal(18,9)") * MICRO, 0).cast("bigint")


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def add(a: Column, b: Column) -> Column:
    return point(a["lon"] + b["lon"], a["lat"] + b["lat"])


def negate(a: Column) -> Column:
    return point(-a["lon"], -a["lat"])


def subtract(a: Column, b: Column) -> Column:
    return point(a["lon"] - b["lon"], a["lat"] - b["lat"])


def divide(a: Column, by: Column) -> Column:
    return point(a["lon"] / by, a["lat"] / by)


def magnitude(a: Column) -> Column:
    return planar_length(a["lon"], a["lat"])


def distance(a: Column, b: Column) -> Column:
    return planar_length(b["lon"] - a["lon"], b["lat"] - a["lat"])


def planar_length(dx: Column, dy: Column) -> Column:
    # sqrt of the sum, not hypot: hypot may round differently in the last bit.
    return F.sqrt(dx * dx + dy * dy)


def to_text(a: Column) -> Column:
    return F.concat(
        F.lit("("), a["lon"].cast("string"), F.lit(","), a["lat"].cast("string"), F.lit(")")
    )


def random_points(spark: SparkSession, k: int, seed: int = 0, literal: bool = False) -> DataFrame:
    """``k`` random points ``(cluster, lon, lat)`` over the whole map.

    ``literal`` draws from the eastern half only, lon in [0, 181) and lat in
    [-90, 91).
    """
    lon_range, lat_range = ((0.0, 181.0), (-90.0, 91.0)) if literal else ((-180.0, 180.0), (-90.0, 90.0))

    def draw(bounds: tuple[float, float], salt: int) -> Column:
        low, high = bounds
        return F.lit(low) + F.rand(seed * 2 + salt) * (high - low)

    return spark.range(0, k, 1, 1).select(
        F.col("id").cast("int").alias("cluster"),
        draw(lon_range, 0).alias("lon"),
        draw(lat_range, 1).alias("lat"),
    )
