"""Numbered categories give what named ones give, and shuffle less."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_tuples
from topicatlas.operators import categories as cat
from topicatlas.operators import dictionary as dic
from topicatlas.plans import build_coded_index, build_index, find_regions

WORDS = [
    {}, {"include": ["Art"]}, {"include": ["art", "war"]}, {"include": ["art", "war"], "match": "all"},
    {"include": ["art"], "exclude": ["war"]}, {"exclude": ["war", "of"]},
    {"literal": True}, {"include": ["art"], "literal": True}, {"include": ["art"], "exclude": ["war", "of"], "literal": True},
    {"include": ["nowhere"]},
]


@pytest.fixture
def counts(rows):
    names = ["art", "art_of_war", "War", "war.", "of", "été_art", "", "_", "very_long_" * 30]
    return rows("category string, class_ip long, n long", *[(c, ip, i + 1) for i, c in enumerate(names) for ip in (1, 5, 9)])


@pytest.mark.parametrize("words", WORDS)
def test_filters_by_dictionary_equal_filters_by_name(counts, words):
    dictionary = dic.category_dictionary(counts)
    expected = as_tuples(cat.filter_categories(counts, **words))
    for form in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "rows_per_task": 1}):
        kept = dictionary.filter(dictionary.code(counts), **words, **form)
        assert as_tuples(dictionary.name(kept)) == expected


def test_two_names_never_share_a_number(counts, monkeypatch):
    number = dic.category_number
    # The first two seeds let names of equal length collide.
    monkeypatch.setattr(
        dic, "category_number", lambda c, seed: F.length(c).cast("bigint") if seed < 2 else number(c, seed)
    )
    dictionary = dic.category_dictionary(counts)
    assert dictionary.seed == 2 and dictionary.n == counts.select("category").distinct().count()
    assert as_tuples(dictionary.name(dictionary.code(counts))) == as_tuples(counts)


def test_nulls_and_no_rows(rows):
    nothing = rows("category string, n long")
    empty = dic.category_dictionary(nothing)
    assert empty.n == 0 and empty.name(empty.filter(empty.code(nothing), ["art"])).count() == 0
    some = rows("category string, n long", (None, 1), ("art", 2))
    dictionary = dic.category_dictionary(some)
    assert as_tuples(dictionary.name(dictionary.code(some))) == [("art", 2)]


def _edits(rows):
    texts = ["art war_of art", "War Art", " music  art_of_war", "music"]
    return rows("categories string, long_ip long", *[(t, 10 * i + j) for i, t in enumerate(texts) for j in range(4)])


def test_the_coded_index_and_regions_equal_the_named_ones(rows):
    places = rows(
        "ip_from long, lat_udeg long, lon_udeg long", *[(7 * i, 10**6 * i, -(10**6) * (i % 3)) for i in range(6)]
    )
    edits = _edits(rows)
    coded, dictionary = build_coded_index(edits, places)
    named = build_index(edits, places)
    assert as_tuples(dictionary.name(coded), "category", "class_ip", "n") == as_tuples(named, "category", "class_ip", "n")
    from topicatlas.operators.points import category_points

    words = {"include": ["art", "music"], "exclude": ["of"]}
    one = find_regions(category_points(named, places), 2, iterations=2, **words)
    two = find_regions(category_points(coded, places), 2, iterations=2, dictionary=dictionary, **words)
    assert two.centroids == one.centroids
    for table in ("categories", "main_categories", "summary", "legend"):
        assert as_tuples(getattr(two, table)) == as_tuples(getattr(one, table))


def test_counts_shuffle_numbers_and_filters_shuffle_no_rows(rows):
    places = rows("ip_from long", (0,), (20,))
    coded, dictionary = build_coded_index(_edits(rows), places)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    keys = plan[plan.index("Exchange hashpartitioning(") :].split("\n")[0]
    assert "category_id" in keys and "category#" not in keys
    stored = coded.sparkSession.createDataFrame(coded.collect(), coded.schema)
    plan = dictionary.filter(stored, ["art"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
