import pytest
from pyspark.sql import functions as F

from tests.conftest import as_tuples
from topicatlas.operators import skew
from topicatlas.operators.lineage import cut_lineage, shared_folder


@pytest.fixture
def facts(spark):
    """3000 rows, a third of them with key 7, a tenth without a key."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 100)
    return spark.range(3000).select("id", key.cast("long").alias("key"))


@pytest.fixture
def lookup(spark):
    return spark.range(60).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_forms_of_the_join_agree(facts, lookup, how):
    expected = as_tuples(facts.join(lookup, "key", how).select("id", "key", "value"))
    for form in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "rows_per_task": 100}):
        found = skew.balanced_join(facts, lookup, ["key"], how, **form)
        assert as_tuples(found, "id", "key", "value") == expected


def test_size_is_measured_where_no_bound_is_known(spark, lookup):
    assert skew.table_bytes(lookup) == 60 * (32 + 16)
    assert skew.table_bytes(lookup, rows=1000) == 1000 * (32 + 16)
    texts = lookup.select("key", F.repeat(F.lit("é"), F.lit(500)).alias("text"))
    assert skew.table_bytes(texts, rows=1) == 60 * (32 + 16 + 1000)
    assert skew.table_bytes(texts.limit(0)) == 0


def test_hot_keys_are_spread(facts):
    hot = skew.hot_keys(facts, ["key"], rows_per_task=100)
    assert {r["key"]: r["_splits"] for r in hot.collect()} == {7: 11, None: 2}
    salted = skew.with_salt(facts, hot, ["key"])
    sizes = salted.groupBy("key", "_salt").count().collect()
    assert max(r["count"] for r in sizes if r["key"] == 7) < 200
    assert len([r for r in sizes if r["key"] == 7]) == 11
    assert all(r["_salt"] == 0 for r in sizes if r["key"] not in (7, None))
    assert skew.hot_keys(facts, ["key"], rows_per_task=5000) is None


def test_no_key_above_the_bound_stays_unsplit(spark):
    """20,000 hot keys among 100,000; each is found, and split into parts within the bound."""
    rows = spark.range(20_000).select(F.col("id").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k"))
    rows = rows.union(spark.range(20_000, 100_000).select(F.col("id").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")))
    hot = skew.hot_keys(rows, ["key"], rows_per_task=10)
    assert hot.count() == 20_000 and hot.filter("key >= 20000 OR _splits != 2").count() == 0
    lookup = spark.range(100_000).select(F.col("id").alias("key"), (F.col("id") * 3).alias("value"))
    joined = skew.balanced_join(rows, lookup, ["key"], broadcast_bytes=0, rows_per_task=10)
    assert joined.filter("value = 3 * key").count() == 20_000 * 12 + 80_000 * 3


def test_light_keys_are_not_counted_one_by_one(facts, monkeypatch):
    monkeypatch.setattr(skew, "KEY_BUCKETS", 4)
    hot = skew.hot_keys(facts, ["key"], rows_per_task=100)
    assert {r["key"]: r["_splits"] for r in hot.collect()} == {7: 11, None: 2}


def test_equal_rows_of_different_partitions_are_spread(spark):
    same = spark.range(0, 64, 1, 64).select(F.lit(1).alias("key"))
    salted = skew.with_salt(same, skew.hot_keys(same, ["key"], 4), ["key"])
    assert salted.select("_salt").distinct().count() > 8


def test_salts_do_not_depend_on_the_run(facts):
    hot = skew.hot_keys(facts, ["key"], rows_per_task=100)
    once, again = (as_tuples(skew.with_salt(facts, hot, ["key"])) for _ in range(2))
    assert once == again


def test_lists_are_whole_ordered_and_cut_at_borders(facts):
    border = F.col("id") % 40 == 0
    lists = skew.parted_lists(facts, ["key"], ["id"], F.col("id"), border).collect()
    assert all(r["items"] == sorted(r["items"]) for r in lists)
    assert all(i % 40 for r in lists for i in r["items"][1:])
    # Rows without a key are a list as well.
    found = sorted((r["key"] or -1, i) for r in lists for i in r["items"])
    assert found == sorted((r["key"] or -1, r["id"]) for r in facts.collect())
    for key in (7, None, 13):
        own = sorted((r["part"], r["items"][0]) for r in lists if r["key"] == key)
        assert [first for _, first in own] == sorted(first for _, first in own)
        assert own[-1][0] - own[0][0] == len(own) - 1


def test_borders_are_as_often_as_asked(spark):
    ids = spark.range(100_000).withColumn("piece", F.lit(0).cast("long")).withColumn("copies", F.lit(1))
    for step in (1, 256, 65_536):
        at = skew.content_border(F.col("id") * step, F.col("piece"), F.col("copies"), 100)
        assert 500 < ids.filter(at).count() < 2000
    named = skew.content_border_of_text(F.col("id").cast("string"), 100)
    assert 800 < ids.filter(named).count() < 1200


def test_shared_folder_is_that_of_the_session(spark, tmp_path):
    folder = shared_folder(spark)
    assert folder == spark.sparkContext.getCheckpointDir()
    table = cut_lineage(spark.range(5), "five")
    inside = folder.removeprefix("file:").lstrip("/")
    assert table.inputFiles() and all(inside in name for name in table.inputFiles())
    assert as_tuples(table) == [(i,) for i in range(5)]
