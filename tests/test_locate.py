import bisect

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import as_tuples
from topicatlas.functions.ip import IPV4_MAX
from topicatlas.operators import locate, ranges

FORMS = {
    "cells": {},
    "bucketed": {"method": "bucketed"},
    "wide buckets": {"method": "bucketed", "bits": 24},
    "narrow buckets": {"method": "bucketed", "bits": 12},
    "shuffled": {"broadcast_bytes": 0},
    "shuffled, all keys hot": {"broadcast_bytes": 0, "rows_per_task": 1},
    "window": {"method": "window"},
    "window, shuffled, all keys hot": {"method": "window", "broadcast_bytes": 0, "rows_per_task": 1},
}

near = st.integers(0, 300)
far = st.integers(0, IPV4_MAX)
edge = st.sampled_from([0, 1, 65535, 65536, 65537, 131072, 16777216, IPV4_MAX - 1, IPV4_MAX])
address = st.one_of(near, far, edge)


@pytest.mark.parametrize("form", FORMS)
@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    starts=st.lists(address, min_size=1, max_size=60),
    asked=st.lists(st.one_of(address, st.integers(0, 2**40)), min_size=1, max_size=80),
)
def test_class_is_the_last_start_not_above(spark, form, starts, asked):
    locations = spark.createDataFrame([(s,) for s in starts], "ip_from long")
    edits = spark.createDataFrame(list(enumerate(asked)), "id int, long_ip long")
    found = locate.resolve_locations(edits, locations, **FORMS[form])
    ordered = sorted(set(starts))

    def lower_bound(value):
        position = bisect.bisect_right(ordered, value)
        return ordered[position - 1] if position else None

    expected = [(i, a, lower_bound(a)) for i, a in enumerate(asked)]
    assert as_tuples(found, "id", "long_ip", "class_ip") == sorted(
        expected, key=lambda row: tuple((v is None, str(v)) for v in row)
    )


@pytest.fixture
def places(rows):
    return rows(
        "ip_from long, ip_to long, city_name string, lat_udeg long, lon_udeg long",
        (100, 199, "a", 1, 1), (300, 399, "b", 2, 2), (300, 350, "b2", 2, 2), (500, 599, "c", 2, 2),
    )


@pytest.mark.parametrize("method", ["cells", "bucketed", "window"])
def test_gaps_upper_bounds_and_attached_columns(rows, places, method):
    edits = rows("long_ip long", (50,), (100,), (250,), (340,), (360,), (600,))
    found = locate.resolve_locations(edits, places, method, attach=["city_name"])
    assert as_tuples(found) == [
        (100, 100, "a"), (250, 100, "a"), (340, 300, "b"), (360, 300, "b"), (50, None, None), (600, 500, "c"),
    ]
    checked = locate.resolve_locations(edits, places, method, check_upper=True, attach=["city_name"])
    assert as_tuples(checked) == [
        (100, 100, "a"), (250, None, None), (340, 300, "b"), (360, 300, "b"), (50, None, None), (600, None, None),
    ]


def test_a_prepared_table_gives_the_same(rows, places):
    edits = rows("long_ip long", (50,), (100,), (250,), (340,), (360,), (600,))
    ranges = locate.prepare_ranges(places)
    assert as_tuples(ranges, "ip_from", "range_end") == [(100, 299), (300, 499), (500, IPV4_MAX)]
    for form in FORMS.values():
        options = {"attach": ["city_name"], **form}
        assert as_tuples(locate.resolve_locations(edits, ranges, **options)) == as_tuples(
            locate.resolve_locations(edits, places, **options)
        )
    plan = locate.resolve_locations(edits, ranges, "bucketed")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lead(") <= 2


@pytest.mark.parametrize("form", FORMS)
def test_no_address_has_no_class(rows, places, form):
    edits = rows("long_ip long", (None,), (-5,), (2**40,))
    found = locate.resolve_locations(edits, places, **FORMS[form])
    assert as_tuples(found) == [(-5, None), (2**40, 500), (None, None)]


def test_empty_location_table(rows):
    edits = rows("long_ip long", (5,))
    for method in ("cells", "bucketed", "window"):
        found = locate.resolve_locations(edits, rows("ip_from long"), method)
        assert as_tuples(found) == [(5, None)]


def test_duplicate_starts_are_decided_by_the_order(rows, places):
    by_city = locate.dedup_locations(places, order=["city_name"])
    assert as_tuples(by_city, "ip_from", "city_name") == [(100, "a"), (300, "b2"), (500, "c")]
    widest = locate.dedup_locations(places)
    assert as_tuples(widest, "ip_from", "city_name") == [(100, "a"), (300, "b"), (500, "c")]


def test_attach_and_unmatched(rows, places):
    df = rows("category string, class_ip long, n long", ("x", 100, 1), ("x", 300, 2), ("y", 7, 3), ("z", None, 4))
    for form in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "rows_per_task": 1}):
        found = locate.attach_location(df, places, ["city_name"], **form)
        assert as_tuples(found) == [("x", 100, 1, "a"), ("x", 300, 2, "b")]
    assert as_tuples(locate.unmatched_classes(df, places)) == [("y", 7, 3), ("z", None, 4)]


def test_unknown_method(rows, places):
    with pytest.raises(ValueError):
        locate.resolve_locations(rows("long_ip long"), places, method="guess")


def test_pieces_stay_within_the_bound_that_allows_a_broadcast(spark):
    starts = spark.range(5000).select(((F.col("id") * 2654435761) % (1 << 32)).alias("ip_from"))
    count = starts.distinct().count()
    bits = locate.bucket_bits(count)
    assert locate.range_pieces(starts.distinct(), bits).count() <= count + (1 << (32 - bits))
    assert (1 << (32 - bits)) <= count


def test_small_ranges_are_broadcast_and_nothing_edit_sized_is_shuffled(spark, tmp_path, places):
    path = str(tmp_path / "edits")
    spark.range(1000).select(
        F.col("id").alias("long_ip"), F.lit("a b").alias("categories"), F.lit("t").alias("unused")
    ).write.parquet(path)
    found = locate.resolve_locations(spark.read.parquet(path).select("long_ip"), places)
    plan = found._jdf.queryExecution().executedPlan().toString()
    probe = plan[: plan.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in probe and "Exchange hashpartitioning" not in probe
    assert "ReadSchema: struct<long_ip:bigint>" in plan


@pytest.fixture
def crowded(spark):
    """4,000 starts in a corner, some alone, and edits of which a third are at one address."""
    corner = spark.range(4000).select((F.lit(167772160) + F.col("id") * 3).alias("ip_from"))
    alone = spark.range(50).select((F.col("id") * 77_777_777).alias("ip_from"))
    hot = F.when(F.col("id") % 3 == 0, 167772167).otherwise(F.lit(167772100) + F.col("id"))
    edits = spark.range(15000).select(hot.alias("long_ip"), "id")
    return corner.unionByName(alone).withColumn("name", F.concat(F.lit("n"), "ip_from")), edits


def test_cells_stay_small_where_ranges_crowd(crowded):
    starts, edits = crowded
    index = ranges.index_ranges(starts)
    sizes = index.cells.groupBy("cell").count().agg(F.max("count")).first()[0]
    assert index.fullest == sizes <= ranges.STARTS_PER_CELL + 1
    assert index.n_ranges == 4050 and index.n_pieces == index.cells.count()
    expected = as_tuples(locate.resolve_locations(edits, starts, "window"), "id", "class_ip")
    for form in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "rows_per_task": 100}):
        found = locate.resolve_locations(edits, index, attach=["name"], **form)
        assert as_tuples(found, "id", "class_ip") == expected
        assert found.filter("name != concat('n', class_ip)").count() == 0


def test_every_address_lies_in_one_cell_of_the_index(spark, crowded):
    starts, _ = crowded
    index = ranges.index_ranges(starts)
    asked = spark.range(2000).select((F.lit(167772160) + F.col("id") * 7).alias("ip")).union(
        spark.range(500).select(F.pmod(F.col("id") * 2654435761, F.lit(1 << 32)).alias("ip"))
    )
    located = ranges.with_cell(asked, "ip", index.directory)
    covering = located.join(index.cells, "cell").filter("ip BETWEEN class_ip AND range_end")
    assert covering.groupBy("ip").count().filter("count != 1").count() == 0
    assert covering.select("ip").distinct().count() == asked.distinct().count()


def test_a_stored_index_is_read_with_its_statistics(spark, crowded, tmp_path):
    starts, edits = crowded
    index = ranges.index_ranges(starts)
    ranges.write_range_index(index, str(tmp_path / "index"))
    stored = ranges.read_range_index(spark, str(tmp_path / "index"))
    for name in ("n_ranges", "n_pieces", "fullest", "text_bytes"):
        assert getattr(stored, name) == getattr(index, name)
    assert as_tuples(stored.ranges) == as_tuples(locate.prepare_ranges(starts).select(stored.ranges.columns))
    text = index.cells.agg(F.sum(F.octet_length("name"))).first()[0]
    assert stored.piece_bytes(["class_ip", "name"]) == index.n_pieces * (32 + 16) + text


def test_a_lookup_is_planned_without_a_job(spark, crowded, rows):
    starts, edits = crowded
    index = ranges.index_ranges(starts.withColumns({"lon_udeg": F.lit(1), "lat_udeg": F.lit(2)}))
    counts = rows("category string, class_ip long, n long", ("x", 0, 1), ("y", 1, 1))
    context = spark.sparkContext
    context.setJobGroup("planning", "planning")
    try:
        found = locate.resolve_locations(edits, index, attach=["name"])
        placed = locate.attach_location(counts, index)
        left = locate.unmatched_classes(counts, index)
        assert list(context.statusTracker().getJobIdsForGroup("planning")) == []
        assert found.count() == 15000 and as_tuples(placed) == [("x", 0, 1, 1, 2)]
        assert as_tuples(left) == [("y", 1, 1)]
        assert list(context.statusTracker().getJobIdsForGroup("planning"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_numbers_above_the_last_address_share_a_row(spark):
    starts = spark.range(3).select((F.col("id") * 1000).alias("ip_from"))
    above = spark.range(1000).select((F.lit(IPV4_MAX) + 1 + F.col("id")).alias("long_ip"))
    assert locate.class_of_addresses(above, starts).collect() == [(IPV4_MAX, 2000)]
    found = locate.resolve_locations(above, starts, "window")
    assert found.filter("class_ip = 2000").count() == 1000
