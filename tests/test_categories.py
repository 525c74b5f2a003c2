import pytest

from tests.conftest import as_tuples
from topicatlas.operators import categories as cat
from topicatlas.operators import points as cp

NAMES = [
    "italian_art", "art", "_science_fiction_films", "laser_science", "war-art", "a+b.c^d:e,f",
    "italian_food", "arts", "brand-2_parts",
]


@pytest.fixture
def named(rows):
    return rows("category string", *[(n,) for n in NAMES])


@pytest.mark.parametrize(
    "words, kept",
    [
        ({}, NAMES),
        ({"include": ["art"]}, ["italian_art", "art"]),
        ({"include": ["Art", "FOOD"]}, ["italian_art", "art", "italian_food"]),
        ({"include": ["italian", "art"], "match": "all"}, ["italian_art"]),
        ({"include": ["brand2"]}, ["brand-2_parts"]),
        ({"include": ["abcdef"]}, ["a+b.c^d:e,f"]),
        ({"include": ["science"]}, ["_science_fiction_films", "laser_science"]),
        ({"include": ["art", "italian"], "exclude": ["food"]}, ["italian_art", "art"]),
        ({"include": ["italian"], "exclude": ["food", "nothing"]}, ["italian_art"]),
        ({"exclude": ["art", "italian"]}, [n for n in NAMES if n not in ("italian_art", "art", "italian_food")]),
        # The literal reading of the exclusion.
        ({"include": ["art"], "literal": True}, []),
        ({"exclude": ["art"], "literal": True}, NAMES),
        ({"include": ["italian"], "exclude": ["italian"], "literal": True}, []),
        ({"include": ["italian"], "exclude": ["italian", "art"], "literal": True}, ["italian_food"]),
        ({"include": ["Italian"], "exclude": ["x"], "literal": True}, []),
    ],
)
def test_filter(named, words, kept):
    assert sorted(r[0] for r in cat.filter_categories(named, **words).collect()) == sorted(kept)


def test_unknown_match(named):
    with pytest.raises(ValueError):
        cat.filter_categories(named, ["a"], match="some")


def test_frequency_is_rarest_first(rows):
    edits = rows("categories string", ("b a a",), ("a c",), ("C",))
    found = cat.category_frequency(cat.explode_categories(edits)).collect()
    assert [tuple(r) for r in found] == [("b", 1), ("c", 2), ("a", 3)]


def test_counts_add_up(rows):
    counts = rows("category string, class_ip long, n long", ("a", 1, 2), ("a", 1, 3), ("a", 2, 1))
    assert as_tuples(cat.category_ips(counts)) == [("a", 1, 5), ("a", 2, 1)]


def test_lists_repeat_addresses(rows):
    counts = rows("category string, class_ip long, n long", ("a", 20, 2), ("a", 3, 1), ("b", 1, 1))
    assert as_tuples(cat.category_lists(counts)) == [("a", 0, [3, 20, 20]), ("b", 0, [1])]
    lines = cat.category_lines(counts, separator=":")
    assert as_tuples(lines, "line") == [("a:3|20|20",), ("b:1",)]


def _with_tasks(spark, n, build):
    """What ``build`` gives with so many shuffle partitions, none of them merged."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, (str(n), "false")):
            spark.conf.set(name, value)
        return as_tuples(build())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_a_hot_category_is_cut_but_whole(rows):
    counts = rows("category string, class_ip long, n long", *[("hot", i, i % 5 + 1) for i in range(300)], ("cold", 1, 1))
    lists = cat.category_lists(counts, length=10).collect()
    assert 30 < len(lists) < 150 and max(len(r["ips"]) for r in lists) < 60
    parts = sorted((r["part"], r["ips"]) for r in lists if r["category"] == "hot")
    assert [ip for _, ips in parts for ip in ips] == [i for i in range(300) for _ in range(i % 5 + 1)]


def test_lists_are_the_same_in_any_number_of_tasks(spark, rows):
    counts = rows(
        "category string, class_ip long, n long",
        *[("hot", 256 * i, i % 7 + 1) for i in range(400)], ("copies", 5, 2500), *[(f"c{i}", i, 1) for i in range(20)],
    )
    whole = _with_tasks(spark, 1, lambda: cat.category_lists(counts, length=30))
    assert whole == _with_tasks(spark, 9, lambda: cat.category_lists(counts, length=30))
    assert whole == _with_tasks(spark, 3, lambda: cat.category_lists(counts.repartition(5), length=30))
    # Other categories, or more of them, change no list.
    alone = as_tuples(cat.category_lists(counts.filter("category = 'hot'"), length=30))
    assert alone == [r for r in whole if r[0] == "hot"]


def test_a_category_of_very_many_entries(spark):
    """Lists are bounded by what their items say, not cut at a number of rows."""
    ids = spark.range(180_000)
    counts = ids.selectExpr("'big' AS category", "id * 256 AS class_ip", "1L AS n").union(
        spark.sql("SELECT 'one address', 77L, 180000L")
    )
    lists = cat.category_lists(counts).selectExpr("category", "part", "size(ips) AS n", "ips[0] AS first").collect()
    for category in ("big", "one address"):
        own = sorted((r["part"], r["n"]) for r in lists if r["category"] == category)
        assert sum(n for _, n in own) == 180_000
        assert len(own) == len({p for p, _ in own}) <= 8
    again = cat.category_lists(counts.repartition(7)).selectExpr("category", "part", "size(ips) AS n", "ips[0] AS first")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, lists))


def test_points(rows):
    locations = rows(
        "ip_from long, lat_udeg long, lon_udeg long", (1, 10, 20), (2, 10, 20), (3, -5, 6)
    )
    counts = rows("category string, class_ip long, n long", ("a", 1, 2), ("a", 2, 3), ("b", 2, 1), ("b", 3, 4))
    found = cp.category_points(counts, locations)
    assert as_tuples(found) == [("a", 20, 10, 5), ("b", 20, 10, 1), ("b", 6, -5, 4)]
    assert as_tuples(cp.weighted_points(found)) == [(20, 10, 6), (6, -5, 4)]
    assert tuple(cp.point_total(found).first()) == (2, 10)
    listed = cp.point_categories(found).collect()
    assert {(r["lon_udeg"], r["part"]): [tuple(c) for c in r["categories"]] for r in listed} == {
        (20, 0): [("a", 5), ("b", 1)], (6, 0): [("b", 4)],
    }
    parts = cp.point_categories(found, length=1).filter("lon_udeg = 20").collect()
    assert sorted(r["part"] for r in parts) == [1, 2]


def test_word_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "points")
    spark.createDataFrame([("art", 1, 1, 1)], "category string, lon_udeg long, lat_udeg long, n long").write.parquet(path)
    counted = cp.count_points(spark.read.parquet(path))
    plan = cat.filter_categories(counted, ["art"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")
