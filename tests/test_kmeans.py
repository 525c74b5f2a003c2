import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_tuples
from topicatlas.operators import kmeans as km


def reference_nearest(centroids, point):
    best = 0
    for i, c in enumerate(centroids):
        if i and not math.dist(centroids[best], point) < math.dist(c, point):
            best = i
    return best


@pytest.fixture
def cloud(spark):
    draw = random.Random(5)
    places = {(draw.randrange(-180, 181), draw.randrange(-90, 91)): draw.randrange(1, 9) for _ in range(400)}
    rows = [(x * 10**6, y * 10**6, n) for (x, y), n in places.items()]
    return spark.createDataFrame(rows, "lon_udeg long, lat_udeg long, n long")


@pytest.mark.parametrize("method", ["expression", "arrow", "auto"])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_nearest_prefers_the_last_of_equals(cloud, method, k):
    draw = random.Random(k)
    # Whole degrees make many exact ties; the first centroid comes twice.
    centroids = [(float(draw.randrange(-20, 20)), float(draw.randrange(-20, 20))) for _ in range(k)]
    centroids.append(centroids[0])
    for row in km.nearest(cloud, centroids, method).collect():
        point = (row["lon_udeg"] / 1e6, row["lat_udeg"] / 1e6)
        distances = [math.sqrt((x - point[0]) ** 2 + (y - point[1]) ** 2) for x, y in centroids]
        assert row["cluster"] == max(i for i, d in enumerate(distances) if d == min(distances))


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "lon_udeg long, lat_udeg long, n long")
    for method in ("expression", "arrow"):
        assert km.nearest(nothing, [(0.0, 0.0)], method).count() == 0
    with pytest.raises(ValueError, match="too few"):
        km.kmeans(nothing, 2)


def test_means_are_weighted_and_do_not_overflow(spark):
    rows = [(180_000_000, 90_000_000, 10**12), (-180_000_000, 0, 3 * 10**12)]
    points = spark.createDataFrame(rows, "lon_udeg long, lat_udeg long, n long")
    found = km.cluster_means(points, [(0.0, 0.0)]).first()
    assert tuple(found) == (0, -90.0, 22.5, 4 * 10**12)


def test_weights_equal_repeated_points(cloud):
    repeated = cloud.select(
        "lon_udeg", "lat_udeg", F.explode(F.array_repeat(F.lit(1).cast("long"), F.col("n").cast("int"))).alias("n")
    )
    given = [(0.0, 0.0), (50.0, 20.0), (-100.0, -30.0)]
    both = [km.kmeans(points, 3, iterations=4, given=given) for points in (cloud, repeated)]
    assert both[0].centroids == both[1].centroids and both[0].log == both[1].log


def test_iterations_ignore_epsilon(cloud):
    found = km.kmeans(cloud, 3, iterations=4, epsilon=1e9)
    assert len(found.log) == 4 * 3
    assert {row[0] for row in found.log} == {0, 1, 2, 3}
    log = found.iteration_log()
    assert log.columns == ["iteration", "cluster", "lon", "lat", "movement"] and log.count() == 12
    last = [tuple(r) for r in log.filter("iteration = 3").orderBy("cluster").select("lon", "lat").collect()]
    assert last == found.centroids


def test_epsilon_stops_when_nothing_moves_more(cloud):
    found = km.kmeans(cloud, 4, epsilon=0.5)
    steps = {}
    for iteration, _, _, _, movement in found.log:
        steps[iteration] = max(steps.get(iteration, 0), movement)
    assert found.converged and steps[max(steps)] <= 0.5
    assert all(movement > 0.5 for iteration, movement in steps.items() if iteration < max(steps))
    assert len({row[0] for row in km.kmeans(cloud, 4, epsilon=1e9).log}) == 1
    guarded = km.kmeans(cloud, 4, epsilon=0.0, max_iter=2)
    assert len(guarded.log) == 8 and not guarded.converged


def test_a_centroid_without_points_stays(cloud):
    found = km.kmeans(cloud, 2, iterations=3, given=[(0.0, 0.0), (9000.0, 0.0)])
    assert found.centroids[1] == (9000.0, 0.0)
    assert km.assign(cloud, found.centroids).select("cluster").distinct().collect() == [(0,)]


def test_equal_centroids_move_together(cloud):
    given = [(10.0, 10.0), (-60.0, 0.0), (10.0, 10.0)]
    found = km.kmeans(cloud, 3, iterations=2, given=given)
    alone = km.kmeans(cloud, 2, iterations=2, given=[(-60.0, 0.0), (10.0, 10.0)])
    assert found.centroids == [alone.centroids[1], alone.centroids[0], alone.centroids[1]]
    assigned = {r["cluster"] for r in km.assign(cloud, found.centroids).collect()}
    assert assigned == {0, 1}


def test_against_a_plain_loop(cloud):
    points = [((r["lon_udeg"], r["lat_udeg"]), r["n"]) for r in cloud.collect()]
    centroids = [(-100.0, 10.0), (0.0, 0.0), (100.0, -10.0)]
    found = km.kmeans(cloud, 3, iterations=3, given=centroids)
    for _ in range(3):
        sums = {}
        for (x, y), n in points:
            i = reference_nearest(centroids, (x / 1e6, y / 1e6))
            sx, sy, sn = sums.get(i, (0, 0, 0))
            sums[i] = (sx + x * n, sy + y * n, sn + n)
        centroids = [
            (sums[i][0] / sums[i][2] / 1e6, sums[i][1] / sums[i][2] / 1e6) if i in sums else c
            for i, c in enumerate(centroids)
        ]
    assert found.centroids == centroids


def test_seeds_are_distinct_and_repeatable(cloud):
    once, again = (km.initial_centroids(cloud, 20, seed=4) for _ in range(2))
    assert once == again and len(set(once)) == 20
    assert km.initial_centroids(cloud, 20, seed=5) != once
    assert km.initial_centroids(cloud.repartition(7), 20, seed=4) == once


def test_seeding_by_occurrence_follows_the_weights(spark):
    rows = [(i * 10**6, 0, 1) for i in range(50)] + [(170 * 10**6, 0, 10**6)]
    points = spark.createDataFrame(rows, "lon_udeg long, lat_udeg long, n long")
    drawn = km.initial_centroids(points, 5, init="occurrence")
    assert drawn == [(170.0, 0.0)] * 5
    # Without replacement: a light point comes once at most, all of them in the end.
    all_of_them = km.initial_centroids(points.filter("n = 1"), 50, init="occurrence")
    assert len(set(all_of_them)) == 50


def test_seeding_by_occurrence_draws_each_occurrence_equally(spark):
    points = spark.createDataFrame([(1, 0, 1), (2, 0, 3)], "lon_udeg long, lat_udeg long, n long")
    pairs = [as_tuples(km.seed_occurrences(points, 2, seed), "lon_udeg") for seed in range(60)]
    with_light = sum(1 for pair in pairs if (1,) in pair)
    # Two of four occurrences: the single one is in half of the draws.
    assert 15 <= with_light <= 45 and all(pair != [(1,), (1,)] for pair in pairs)


def test_given_and_random_centroids(cloud):
    assert km.initial_centroids(cloud, 2, given=[(1, 2), (3, 4)]) == [(1.0, 2.0), (3.0, 4.0)]
    with pytest.raises(ValueError, match="given for k=3"):
        km.initial_centroids(cloud, 3, given=[(1, 2)])
    few = cloud.limit(2)
    assert len(km.initial_centroids(few, 6, init="random")) == 6
    with pytest.raises(ValueError, match="too few"):
        km.initial_centroids(few, 6)
    with pytest.raises(ValueError, match="unknown init"):
        km.initial_centroids(few, 1, init="best")


@pytest.mark.parametrize("arguments", [{"k": 0}, {"k": 2, "epsilon": -1.0}, {"k": 2, "iterations": -1}])
def test_arguments_are_checked(cloud, arguments):
    with pytest.raises(ValueError):
        km.kmeans(cloud, **arguments)


def test_work_is_spread_over_the_cluster(cloud, monkeypatch):
    one = cloud.coalesce(1)
    assert km._spread(one, 5).rdd.getNumPartitions() == 1
    monkeypatch.setattr(km, "DISTANCES_PER_TASK", 100)
    slots = 3 * one.sparkSession.sparkContext.defaultParallelism
    assert km._spread(one, 1).rdd.getNumPartitions() == 4
    assert km._spread(one, 500).rdd.getNumPartitions() == slots
    assert km.kmeans(one, 3, iterations=2).centroids == km.kmeans(cloud, 3, iterations=2).centroids


def test_an_update_shuffles_one_row_per_cluster_and_task(cloud):
    plan = km.cluster_means(cloud, [(0.0, 0.0), (1.0, 1.0)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.rindex("partial_sum")


def test_sums_are_exact_for_heavy_points(rows):
    heavy = [(-179999999, 89999999, 10**12 + 7), (-179999998, -89999999, 3), (5, -1, 10**11 + 1)]
    points = rows("lon_udeg long, lat_udeg long, n long", *heavy)
    found = km.cluster_means(points, [(0.0, 0.0)]).collect()[0]
    n = sum(weight for _, _, weight in heavy)
    assert found["n"] == n
    assert found["lon"] == float(sum(x * w for x, _, w in heavy)) / n / 1e6
    assert found["lat"] == float(sum(y * w for _, y, w in heavy)) / n / 1e6
