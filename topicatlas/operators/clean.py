"""From raw revisions to edits with an integer address."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicatlas.functions.ip import (
    ROUTABLE_MAX,
    ROUTABLE_MIN,
    address_of,
    ipv4_to_long,
    is_anonymous_ipv4,
    quad_to_long,
)
from topicatlas.schemas import CLEAN_COLUMNS
from topicatlas.sources.revisions import WHITESPACE


def clean_revisions(
    raw: DataFrame, minor_filter: bool = True, anonymous_only: bool = True
) -> DataFrame:
    """Major edits by anonymous IPv4 users on pages that have a category.

    A revision without a minor flag counts as major.
    """
    kept = raw.filter(F.rtrim("categories", F.lit(WHITESPACE)) != "")
    if minor_filter:
        kept = kept.filter(F.coalesce(F.col("minor"), F.lit("")) != "1")
    if anonymous_only:
        kept = kept.filter(is_anonymous_ipv4(F.col("user_id")))
    return kept.select(*CLEAN_COLUMNS)


def ip_status(edits: DataFrame, lo: int = ROUTABLE_MIN, hi: int = ROUTABLE_MAX) -> DataFrame:
    """Adds ``long_ip`` and ``ip_status``: ok, not_ipv4, bad_octet or out_of_range."""
    parsed = edits.withColumn("long_ip", ipv4_to_long(address_of(F.col("user_id"))))
    return parsed.withColumn(
        "ip_status",
        F.when(~F.coalesce(is_anonymous_ipv4(F.col("user_id")), F.lit(False)), "not_ipv4")
        .when(F.col("long_ip").isNull(), "bad_octet")
        .when(~F.col("long_ip").between(lo, hi), "out_of_range")
        .otherwise("ok"),
    )


def with_long_ip(edits: DataFrame, lo: int = ROUTABLE_MIN, hi: int = ROUTABLE_MAX) -> DataFrame:
    """Edits with a routable address and its integer form ``long_ip``."""
    anonymous = edits.filter(is_anonymous_ipv4(F.col("user_id")))
    long_ip = quad_to_long(address_of(F.col("user_id")), lo, hi)
    return anonymous.withColumn("long_ip", long_ip).filter(F.col("long_ip").isNotNull())


def reject_counts(edits: DataFrame, lo: int = ROUTABLE_MIN, hi: int = ROUTABLE_MAX) -> DataFrame:
    """``reason, n`` of the edits that :func:`with_long_ip` leaves out."""
    return (
        ip_status(edits, lo, hi)
        .filter(F.col("ip_status") != "ok")
        .groupBy(F.col("ip_status").alias("reason"))
        .agg(F.count("*").alias("n"))
    )
