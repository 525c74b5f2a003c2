"""The category index as text: ``category#ip|ip|ip``.

A category may be spread over several lines; every reader here treats its lines
as one bag, so the writer is free to cut very long ones.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select("value", F.split("value", "#").alias("halves"))


def _entries(spark: SparkSession, path: str | list[str], lower: bool) -> DataFrame:
    category = F.get("halves", F.lit(0))
    return (
        _lines(spark, path)
        .filter(F.size("halves") == 2)
        .select(
            (F.lower(category) if lower else category).alias("category"),
            F.explode(F.split(F.get("halves", F.lit(1)), r"\|")).alias("text"),
        )
        .select("category", F.col("text").try_cast("bigint").alias("class_ip"))
        .filter(F.col("class_ip").isNotNull())
    )


def read_category_ips(
    spark: SparkSession, path: str | list[str], lower: bool = True
) -> DataFrame:
    """``category, class_ip, n``; counts add up over lines and, with ``lower``, over cases."""
    return _entries(spark, path, lower).groupBy("category", "class_ip").agg(
        F.count("*").alias("n")
    )


def read_class_ips(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Only the addresses, one row per occurrence."""
    return _entries(spark, path, lower=False).select("class_ip")


def malformed_category_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines without exactly one ``#``, or with an address that is not a number."""
    bad_number = F.exists(
        F.split(F.get("halves", F.lit(1)), r"\|"), lambda ip: ip.try_cast("bigint").isNull()
    )
    usable = (F.size("halves") == 2) & ~bad_number
    return _lines(spark, path).filter(~F.coalesce(usable, F.lit(False))).select("value")
