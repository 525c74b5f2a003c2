"""Backward as-of lookup of addresses in the location table.

The class of an address is the greatest ``ip_from`` not above it.  The end of a
range plays no part unless ``check_upper`` asks for it, so addresses in a gap
belong to the range before the gap.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicatlas.operators.lineage import cut_lineage
from topicatlas.operators.ranges import (
    BLOCK_BITS,
    BLOCKS,
    RangeIndex,
    _block,
    _ipv4,
    _within_ipv4,
    dedup_locations,
    index_ranges,
    is_prepared,
    prepare_ranges,
    with_cell,
    with_range_end,
)
from topicatlas.operators.skew import BROADCAST_BYTES, ROWS_PER_TASK, balanced_join

__all__ = [
    "attach_location", "class_of_addresses", "dedup_locations", "index_ranges", "prepare_ranges",
    "range_pieces", "resolve_locations", "unmatched_classes", "with_range_end",
]

def _unique(locations: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``ip_from`` and the wanted columns, one row per ``ip_from``."""
    if is_prepared(locations):
        return locations.select("ip_from", *wanted)
    # Ties between equal starts are decided on all columns, so all must be there
    # when any column of the winner is asked for.
    others = [name for name in locations.columns if name != "ip_from"] if wanted else []
    return dedup_locations(locations.select("ip_from", *others)).select("ip_from", *wanted)


def _ranges(locations: DataFrame, wanted: Sequence[str]) -> DataFrame:
    if is_prepared(locations):
        return locations.select("ip_from", "range_end", *wanted)
    return with_range_end(_unique(locations, wanted))


def bucket_bits(ranges: int) -> int:
    """Bucket width giving at most as many buckets as ranges.

    Cutting the ranges at bucket borders then at most doubles their number, and
    a bucket holds about two pieces on average.
    """
    return min(max(33 - max(ranges, 1).bit_length(), 8), 24)


def range_pieces(locations: DataFrame, bits: int, attach: Sequence[str] = ()) -> DataFrame:
    """``bucket, class_ip, range_end`` and the attached columns, one row per bucket touched."""
    return _ranges(locations, attach).select(
        F.explode(
            F.sequence(F.shiftright("ip_from", bits), F.shiftright("range_end", bits))
        ).alias("bucket"),
        F.col("ip_from").alias("class_ip"),
        "range_end",
        *attach,
    )


def _bucketed(edits, locations, bits, attach, broadcast_bytes, rows_per_task):
    ranges = locations.count()
    if bits is None:
        bits = bucket_bits(ranges)
    probed = edits.withColumn("_probe", _within_ipv4(F.col("long_ip"))).withColumn(
        "bucket", F.shiftright("_probe", bits)
    )
    located = balanced_join(
        probed,
        range_pieces(locations, bits, attach),
        ["bucket"],
        how="left",
        within=F.col("_probe").between(F.col("class_ip"), F.col("range_end")),
        # Every bucket border cuts at most one range in two.
        lookup_rows=ranges + (1 << (32 - bits)),
        broadcast_bytes=broadcast_bytes,
        rows_per_task=rows_per_task,
    )
    return located.drop("bucket", "_probe", "range_end")


def _by_cell(edits, index, attach, broadcast_bytes, rows_per_task):
    probed = with_cell(edits.withColumn("_probe", _within_ipv4(F.col("long_ip"))), "_probe", index.directory)
    pieces = index.cells.select("cell", "class_ip", "range_end", *attach)
    located = balanced_join(
        probed,
        pieces,
        ["cell"],
        how="left",
        within=F.col("_probe").between(F.col("class_ip"), F.col("range_end")),
        lookup_bytes=index.piece_bytes(pieces.columns),
        broadcast_bytes=broadcast_bytes,
        rows_per_task=rows_per_task,
    )
    return located.drop("cell", "_probe", "range_end")


def class_of_addresses(addresses: DataFrame, locations: DataFrame) -> DataFrame:
    """``long_ip, class_ip`` for distinct addresses, by a window over each block.

    A block holds at most 65,536 distinct addresses and as many starts, so no
    window partition grows with the data.  Each block is seeded with the last
    start before it.  Numbers above the last address come out as that address.
    """
    starts = _ipv4(locations).select("ip_from").distinct()
    last_starts = starts.groupBy(_block("ip_from").alias("block")).agg(
        F.max("ip_from").alias("start")
    )
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    seeds = (
        addresses.sparkSession.range(BLOCKS)
        .select(F.col("id").cast("int").alias("block"))
        .join(last_starts, "block", "left")
        .select("block", F.last("start", ignorenulls=True).over(earlier).alias("start"))
        .filter(F.col("start").isNotNull())
    )
    rows = (
        seeds.select(
            "block", F.shiftleft(F.col("block").cast("bigint"), BLOCK_BITS).alias("ip"),
            F.lit(0).alias("kind"), "start", F.lit(None).cast("bigint").alias("long_ip"),
        )
        .unionByName(
            starts.select(
                _block("ip_from").alias("block"), F.col("ip_from").alias("ip"),
                F.lit(1).alias("kind"), F.col("ip_from").alias("start"),
                F.lit(None).cast("bigint").alias("long_ip"),
            )
        )
        .unionByName(
            addresses.select(_within_ipv4(F.col("long_ip")).alias("ip")).distinct().select(
                _block("ip").alias("block"), "ip", F.lit(2).alias("kind"),
                F.lit(None).cast("bigint").alias("start"), F.col("ip").alias("long_ip"),
            )
        )
    )
    upto = W.partitionBy("block").orderBy("ip", "kind").rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("class_ip", F.last("start", ignorenulls=True).over(upto))
        .filter(F.col("long_ip").isNotNull())
        .select("long_ip", "class_ip")
    )


def resolve_locations(
    edits: DataFrame,
    locations: DataFrame | RangeIndex,
    method: str = "cells",
    bits: int | None = None,
    check_upper: bool = False,
    attach: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Edits with the ``class_ip`` of their ``long_ip`` and the ``attach`` columns.

    ``class_ip`` is null below the first range.  ``cells`` joins on cells of at most 17
    ranges, however these crowd; with a :class:`RangeIndex` whose pieces can be broadcast
    it runs no job of its own, and a plain table is indexed first.  ``bucketed`` cuts the
    ranges at borders of equal buckets and joins on the bucket; ``window`` resolves the
    distinct addresses and joins them back.  The results are the same.  ``check_upper``
    also empties it above the ``ip_to`` of its range.
    """
    wanted = list(attach) + (["ip_to"] if check_upper and "ip_to" not in attach else [])
    if method != "cells" and isinstance(locations, RangeIndex):
        locations = locations.ranges
    if method == "cells":
        index = locations if isinstance(locations, RangeIndex) else index_ranges(locations)
        located = _by_cell(edits, index, wanted, broadcast_bytes, rows_per_task)
    elif method == "bucketed":
        located = _bucketed(edits, locations, bits, wanted, broadcast_bytes, rows_per_task)
    elif method == "window":
        # At most one row per IPv4 address; counted and joined from a written table.
        classes = cut_lineage(class_of_addresses(edits, locations), "classes")
        located = balanced_join(
            edits.withColumn("_probe", _within_ipv4(F.col("long_ip"))),
            classes.withColumnRenamed("long_ip", "_probe"), ["_probe"], "left",
            broadcast_bytes=broadcast_bytes, rows_per_task=rows_per_task,
        ).drop("_probe")
        if wanted:
            lookup = _unique(locations, wanted).withColumnRenamed("ip_from", "class_ip")
            located = balanced_join(
                located, lookup, ["class_ip"], "left",
                broadcast_bytes=broadcast_bytes, rows_per_task=rows_per_task,
            )
    else:
        raise ValueError(f"unknown method {method!r}")
    if check_upper:
        inside = F.col("long_ip") <= F.col("ip_to")
        for name in ["class_ip", *attach]:
            if name != "ip_to":
                located = located.withColumn(name, F.when(inside, F.col(name)))
        if "ip_to" not in attach:
            located = located.drop("ip_to")
    return located


def _placed(locations: DataFrame) -> DataFrame:
    named = [c for c in ("lon_udeg", "lat_udeg") if c in locations.columns]
    return locations.dropna(subset=named) if named else locations


def _classes(locations: DataFrame | RangeIndex, columns: Sequence[str]) -> tuple[DataFrame, dict]:
    """``class_ip`` and columns, a row per class with a place, and what is known of the size."""
    if isinstance(locations, RangeIndex):
        lookup = _placed(locations.ranges).select(F.col("ip_from").alias("class_ip"), *columns)
        return lookup, {"lookup_bytes": locations.range_bytes(lookup.columns)}
    placed = _placed(_unique(locations, [c for c in locations.columns if c != "ip_from"]))
    return placed.select(F.col("ip_from").alias("class_ip"), *columns), {"lookup_rows": locations.count()}


def attach_location(
    df: DataFrame,
    locations: DataFrame | RangeIndex,
    columns: Sequence[str] = ("lon_udeg", "lat_udeg"),
    broadcast_bytes: int = BROADCAST_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
    audit: Observation | None = None,
) -> DataFrame:
    """Adds location columns by ``class_ip``; rows without a location are left out.

    A class whose coordinates are null is without one.  ``audit`` is told
    ``without_place``, what these rows stand for, by the first action on the result.
    """
    lookup, known = _classes(locations, columns)
    if audit is None:
        return balanced_join(
            df, lookup, ["class_ip"], broadcast_bytes=broadcast_bytes, rows_per_task=rows_per_task, **known
        )
    if "lookup_bytes" in known:
        known["lookup_bytes"] += locations.n_ranges * 8
    joined = balanced_join(
        df, lookup.withColumn("_placed", F.lit(True)), ["class_ip"], "left",
        broadcast_bytes=broadcast_bytes, rows_per_task=rows_per_task, **known,
    )
    left_out = F.when(F.col("_placed").isNull(), F.col("n") if "n" in df.columns else F.lit(1))
    seen = joined.observe(audit, F.coalesce(F.sum(left_out), F.lit(0)).alias("without_place"))
    return seen.filter("_placed").drop("_placed")


def unmatched_classes(df: DataFrame, locations: DataFrame | RangeIndex) -> DataFrame:
    """The rows :func:`attach_location` leaves out, for auditing."""
    lookup, known = _classes(locations, [])
    return balanced_join(df, lookup, ["class_ip"], "left_anti", **known)
