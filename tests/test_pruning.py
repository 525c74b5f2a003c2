"""Pruned updates and resumed runs give what plain, unbroken ones give, to the bit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicatlas.operators import kmeans as km
from topicatlas.operators import pruning


@pytest.fixture(scope="module")
def places(spark):
    """40,000 places in 300 towns of different sizes, with weights."""
    town = F.floor(F.pow(F.rand(3), 2) * 300).cast("long")
    rows = spark.range(40_000).select(town.alias("t"), F.randn(4).alias("dx"), F.randn(5).alias("dy"), F.col("id"))
    centre = [(F.pmod(F.col("t") * m, F.lit(w * 10**6)) - w * 500_000).cast("double") for m, w in ((104_729_777, 340), (7_919_333, 160))]
    rows = rows.select(
        (centre[0] + F.col("dx") * 400_000).cast("long").alias("lon_udeg"),
        (centre[1] + F.col("dy") * 300_000).cast("long").alias("lat_udeg"),
        (F.col("id") % 7 + 1).alias("n"),
    )
    frame = rows.groupBy("lon_udeg", "lat_udeg").agg(F.sum("n").alias("n")).persist()
    yield frame
    frame.unpersist()


def test_pruned_updates_are_equal_and_look_at_few_distances(places):
    plain = km.kmeans(places, 100, iterations=4, method="arrow")
    pruned = km.kmeans(places, 100, iterations=4, method="pruned")
    assert pruned.log == plain.log and pruned.centroids == plain.centroids
    assert 0 < pruned.distances * 5 < places.count() * 100 * 4


def test_the_grid_is_taken_for_many_distances(places, monkeypatch):
    assert km.kmeans(places, 40, iterations=1).distances == 0
    monkeypatch.setattr(km, "PRUNED_DISTANCES", 1000)
    assert km.kmeans(places, 40, iterations=1).distances > 0


@pytest.mark.parametrize("cell", [1_000_000, 7_000_000, 400_000_000])
def test_ties_and_equal_centroids(spark, cell):
    draw = random.Random(cell)
    rows = {(draw.randrange(-9, 10) * 10**6, draw.randrange(-9, 10) * 10**6): draw.randrange(1, 5) for _ in range(300)}
    points = spark.createDataFrame([(x, y, n) for (x, y), n in rows.items()], "lon_udeg long, lat_udeg long, n long")
    centroids = [(float(draw.randrange(-9, 10)), float(draw.randrange(-9, 10))) for _ in range(30)]
    centroids += [centroids[0], centroids[3], (9000.0, 9000.0)]
    grid = pruning.point_grid(points, cell)
    pruned = pruning.pruned_means(grid, centroids).drop("looked_at").orderBy("cluster").collect()
    assert pruned == km.cluster_means(points, centroids, "arrow").orderBy("cluster").collect()
    assert grid.n_points == len(rows) and grid.n_cells == grid.cells.count()


def test_possible_centroids_hold_the_nearest_of_any_point():
    draw = np.random.default_rng(1)
    low = draw.uniform(-50, 50, (200, 2))
    high = low + draw.uniform(0, 3, (200, 2)) * draw.integers(0, 2, (200, 1))
    x, y = draw.uniform(-60, 60, (2, 50))
    possible = pruning.possible_centroids((low[:, 0], high[:, 0], low[:, 1], high[:, 1]), x, y)
    assert possible.any(axis=1).all() and possible.sum() < possible.size / 5
    for _ in range(50):
        at = low + draw.uniform(0, 1, (200, 2)) * (high - low)
        nearest = np.hypot(at[:, :1] - x, at[:, 1:] - y).argmin(axis=1)
        assert possible[np.arange(200), nearest].all()


def test_no_points(spark):
    nothing = spark.createDataFrame([], "lon_udeg long, lat_udeg long, n long")
    grid = pruning.point_grid(nothing)
    assert (grid.n_points, grid.n_cells) == (0, 0)
    assert pruning.pruned_means(grid, [(0.0, 0.0)]).count() == 0


class Lost(Exception):
    pass


def _stopping_after(monkeypatch, updates):
    """The driver is lost once so many updates are written."""
    moved, count = km.moved_centroids, [0]

    def lost(*arguments):
        count[0] += 1
        if count[0] > updates:
            raise Lost
        return moved(*arguments)

    monkeypatch.setattr(km, "moved_centroids", lost)


@pytest.mark.parametrize("form", [{"iterations": 6}, {"epsilon": 0.5}, {"iterations": 5, "method": "pruned"}])
def test_a_run_goes_on_after_a_lost_driver(places, tmp_path, monkeypatch, form):
    whole = km.kmeans(places, 7, seed=4, **form)
    folder = str(tmp_path / "run")
    with monkeypatch.context() as patch:
        _stopping_after(patch, 3)
        with pytest.raises(Lost):
            km.kmeans(places, 7, seed=4, folder=folder, **form)
    # What the driver was writing when it was lost is no update.
    (tmp_path / "run" / "update-3").mkdir()
    calls = []
    means = km.cluster_means
    monkeypatch.setattr(km, "cluster_means", lambda *a: calls.append(1) or means(*a))
    resumed = km.kmeans(places, 7, seed=4, folder=folder, **form)
    assert (resumed.log, resumed.centroids, resumed.converged) == (whole.log, whole.centroids, whole.converged)
    if form.get("method") != "pruned":
        assert len(calls) == len(whole.log) // 7 - 3
    again = km.kmeans(places, 7, seed=4, folder=folder, **form)
    assert again.centroids == whole.centroids and len(again.log) == len(whole.log)
    with pytest.raises(ValueError, match="holds a run"):
        km.kmeans(places, 8, seed=4, folder=folder, **form)
