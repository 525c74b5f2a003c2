import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_tuples
from topicatlas.__main__ import main
from topicatlas.operators import profile, raster
from topicatlas.operators.kmeans import assign
from topicatlas.plans import build_index, find_regions, locate_categories, prepare_edits

CENTROIDS = [(0.0, 0.0), (100.0, 50.0), (-100.0, -50.0)]


@pytest.fixture
def points(rows):
    return rows(
        "category string, lon_udeg long, lat_udeg long, n long",
        ("art", 1_000_000, 0, 5), ("music", 1_000_000, 0, 5), ("art", 99_000_000, 49_000_000, 1),
        ("food", 99_000_000, 49_000_000, 3), ("art", 2_000_000, 2_000_000, 2),
        ("food", 101_000_000, 49_000_000, 4), ("wine_bars", 98_000_000, 51_000_000, 9),
    )


def test_profile(points):
    assignment = assign(points, CENTROIDS)
    assert as_tuples(profile.cluster_sizes(assignment)) == [(0, 12), (1, 17)]
    assert profile.cluster_distinct_points(assignment).count() == 5
    counts = profile.cluster_categories(points, CENTROIDS)
    expected = [(0, "art", 7), (0, "music", 5), (1, "art", 1), (1, "food", 7), (1, "wine_bars", 9)]
    assert as_tuples(counts) == expected
    main_categories = profile.main_category(counts)
    assert as_tuples(main_categories) == [(0, "art", 7), (1, "wine_bars", 9)]
    report = profile.main_category_report(main_categories, CENTROIDS)
    assert as_tuples(report) == [(0, 0.0, 0.0, "art", 7), (1, 50.0, 100.0, "wine_bars", 9)]


def test_looking_points_up_gives_the_same_as_assigning_them(points):
    assignment = assign(points, CENTROIDS)
    for form in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "rows_per_task": 1}):
        joined = profile.cluster_point_categories(assignment, points, **form)
        assert as_tuples(profile.count_categories(joined)) == as_tuples(
            profile.cluster_categories(points, CENTROIDS)
        )
        assert joined.count() == points.count()


def test_ties_of_the_main_category_go_by_name(rows):
    counts = rows("cluster int, category string, n long", (1, "b", 3), (1, "a", 3), (1, "c", 2))
    assert as_tuples(profile.main_category(counts)) == [(1, "a", 3)]


def test_super_clusters(rows):
    mains = rows("cluster int, category string, n long", (2, "art", 1), (0, "art", 4), (1, "food", 1))
    groups = profile.super_clusters(mains)
    assert as_tuples(groups) == [("art", [0, 2]), ("food", [1])]
    colors = {r["cluster"]: (r["category"], r["red"], r["green"], r["blue"]) for r in raster.super_colors(groups).collect()}
    assert colors[0] == colors[2] and colors[0][1:] != colors[1][1:]
    legend = raster.super_legend(groups).orderBy("y").collect()
    assert [(r["label"], r["y"]) for r in legend] == [("art", 500), ("food", 520)]


def test_grid_and_markers(points):
    assignment = assign(points, CENTROIDS)
    grid = raster.pixel_grid(assignment, 360, 180)
    assert grid.agg(F.sum("n")).first()[0] == 29
    assert as_tuples(grid.filter("cluster = 0"), "x", "y", "n") == [(181, 90, 10), (182, 88, 2)]
    markers = raster.cluster_markers(CENTROIDS, profile.cluster_sizes(assignment), True).orderBy("cluster").collect()
    assert [(r["x"], r["y"], r["label"], r["n"]) for r in markers] == [
        (1000, 500, "(0) 12", 12), (1555, 222, "(1) 17", 17), (444, 777, None, 0),
    ]


def test_grid_edges(rows):
    corner = rows("lon_udeg long, lat_udeg long, n long, cluster int", (180_000_000, -90_000_000, 1, 0))
    assert as_tuples(raster.pixel_grid(corner), "x", "y") == [(2000, 1000)]
    assert as_tuples(raster.pixel_grid(corner, clip=True), "x", "y") == [(1999, 999)]


@pytest.mark.parametrize("count, top", [(15, 500), (16, 250)])
def test_long_legends_start_higher(spark, count, top):
    mains = spark.range(count).selectExpr("cast(id as int) cluster", "'a_b' category", "id * 2 n")
    found = raster.legend(mains, count).orderBy("cluster").collect()
    assert [r["y"] for r in found] == [top + 30 * i for i in range(count)]
    assert found[1]["label"] == "(1) a b 2"


def test_regions_of_filtered_categories(points):
    found = find_regions(points, 2, include=["art", "food"], iterations=2, given=[(0.0, 0.0), (90.0, 40.0)])
    assert as_tuples(found.sizes) == [(0, 7), (1, 8)]
    assert as_tuples(found.main_categories) == [(0, "art", 7), (1, "food", 7)]
    summary = found.summary.orderBy("cluster").collect()
    assert math.isclose(summary[0]["lon"], 9 / 7) and summary[1]["size"] == 8
    assert found.pixel_grid().agg(F.sum("n")).first()[0] == 15
    assert set(found.pixel_grid_grouped().columns) == {"x", "y", "cluster", "n", "category", "red", "green", "blue"}


LOCATIONS = (
    '"0","16777215","-","-","-","-","0.000000","0.000000","-"\n'
    '"16777216","16777471","AU","Australia","Queensland","Brisbane","-27.467940","153.028090","4000"\n'
    '"16777472","16778239","CN","China","Fujian","Fuzhou","26.061390","119.306110","350004"\n'
    '"16778240","16779263","AU","Australia","Victoria","Melbourne","-37.814000","144.963320","3000"\n'
)
REVISIONS = [
    ("1.0.0.7", "Art modern_art"), ("1.0.0.9", "art"), ("1.0.1.5", "food"), ("1.0.4.1", "art wine"),
    ("1.0.1.6", "art"),
]


@pytest.fixture
def inputs(spark, lines):
    log = "\n\n".join(
        f"REVISION 1 {i} T 2008 ip:{a} ip:{a}\nCATEGORY {c}\nMINOR 0\nTEXTDATA 1"
        for i, (a, c) in enumerate(REVISIONS)
    )
    return lines(log, "log.txt"), lines(LOCATIONS, "locations.csv")


def test_index_and_direct_counts_agree(spark, inputs):
    from topicatlas.operators.points import category_points
    from topicatlas.sources import read_locations

    edits, locations = prepare_edits(spark, inputs[0]), read_locations(spark, inputs[1])
    direct = as_tuples(locate_categories(edits, locations))
    for method in ("cells", "bucketed", "window"):
        assert as_tuples(category_points(build_index(edits, locations, method), locations)) == direct
    assert ("art", 153028090, -27467940, 2) in direct and len(direct) == 6


def test_only_combined_counts_are_shuffled(spark, inputs):
    from topicatlas.sources import read_locations

    edits, locations = prepare_edits(spark, inputs[0]), read_locations(spark, inputs[1])
    plan = locate_categories(edits, locations)._jdf.queryExecution().executedPlan().toString()
    edit_side = plan[: plan.index("BroadcastExchange")]
    assert edit_side.count("Exchange") == 1
    assert edit_side.index("Exchange") < edit_side.index("partial_count")


def test_command_line(spark, inputs, tmp_path):
    from topicatlas.sinks import write_edits

    write_edits(prepare_edits(spark, inputs[0]), str(tmp_path / "edits"))
    common = ["--locations", inputs[1], "--index", str(tmp_path / "index"), "--output", str(tmp_path / "out")]
    folder = main(["-a", "--edits", str(tmp_path / "edits"), *common, "-k", "2", "-i", "3", "-p"])
    assert folder.endswith("filters--2-3-0.01")
    report = "".join(sorted(r[0] + "\n" for r in spark.read.text(f"{folder}/clustersCats.csv").collect()))
    assert report.count(":\n") == 2 and "(art," in report
    assert spark.read.parquet(f"{folder}/pixels").agg(F.sum("n")).first()[0] == 7
    assert spark.read.parquet(f"{folder}/markers").filter("label like '(_) _'").count() == 2
    # The index is there now; a second run only reads it.
    again = main([*common, "-w", "art", "-n", "modern", "-k", "1"])
    assert again.endswith("filters-art-modern-1-0-0.01")
    assert [r[0].split(",", 3)[3] for r in spark.read.text(f"{again}/mainCats.csv").collect()] == ["art,4"]
    with pytest.raises(SystemExit):
        main(["-a", *common, "-k", "1"])


def test_command_line_from_the_log(spark, inputs, tmp_path):
    log = tmp_path / "log.txt"
    extra = "\n\n".join(
        f"REVISION 1 9{i} T 2008 {user} {user}\nCATEGORY art\nMINOR 0" for i, user in enumerate(["ip:1.0.999.1", "someone"])
    )
    log.write_text(open(inputs[0]).read() + "\n\n" + extra)
    common = ["--locations", inputs[1], "--index", str(tmp_path / "index"), "--output", str(tmp_path / "out")]
    folder = main(["-a", "--revisions", str(log), *common, "-w", "modern,art", "--match", "all", "-k", "1", "--clip"])
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    audit = dict(map(tuple, read("audit").collect()))
    assert audit == {"unusable_range": 0, "without_class": 0, "without_place": 0, "bad_octet": 1, "not_ipv4": 1}
    caption = read("captions").first()
    assert caption["words"] == "Filter words: modern art" and caption["total"] == "Tot. points: 1" and caption["converged"]
    assert read("legend").first()["label"] == "(0) modern art 1"
    assert read("legend-grouped").first()["label"] == "modern art"
    assert read("markers-grouped").first()["category"] == "modern_art"


def test_what_is_left_out_is_counted_by_the_jobs_that_leave_it_out(spark, inputs, tmp_path, monkeypatch):
    from pyspark.sql import Observation

    from topicatlas.operators import locate
    from topicatlas.operators.points import category_points
    from topicatlas.plans import prepare_locations
    from topicatlas.sources import malformed_locations, read_locations

    bad = '"77","90","X","X","X","X","north","1","0"\n"nowhere","90","X","X","X","X","1","1","0"\n'
    path = tmp_path / "ranges.csv"
    path.write_text(bad + open(inputs[1]).read())
    audit = Observation()
    index = prepare_locations(spark, str(path), audit)
    assert audit.get == {"unusable_range": malformed_locations(spark, str(path)).count()} == {"unusable_range": 2}
    counts = spark.createDataFrame(
        [("a", 77, 3), ("a", 16777216, 2), ("b", 12345, 4), ("b", None, 1)], "category string, class_ip long, n long"
    )
    for places in (index, read_locations(spark, str(path))):
        for form in ({}, {"broadcast_bytes": 0}):
            audit = Observation()
            found = locate.attach_location(counts, places, audit=audit, **form)
            assert as_tuples(found) == as_tuples(locate.attach_location(counts, places))
            left = locate.unmatched_classes(counts, places).agg(F.sum("n")).first()[0]
            assert audit.get == {"without_place": left} and left >= 8
    audit = Observation()
    assert category_points(counts, index, audit).count() == 1 and audit.get["without_place"] == 8


def test_a_run_is_resumed_from_the_command_line(spark, inputs, tmp_path):
    from topicatlas.sinks import write_edits

    write_edits(prepare_edits(spark, inputs[0]), str(tmp_path / "edits"))
    common = ["--locations", inputs[1], "--index", str(tmp_path / "index"), "-k", "2", "--resume", str(tmp_path / "run")]
    main(["-a", "--edits", str(tmp_path / "edits"), *common, "--output", str(tmp_path / "a"), "-i", "2"])
    folder = main([*common, "--output", str(tmp_path / "b"), "-i", "3"])
    log = spark.read.parquet(f"{folder}/iterations")
    assert log.select("iteration").distinct().count() == 3
    updates = [p.name for p in (tmp_path / "run").iterdir()]
    assert sorted(updates) == ["start", "update-0", "update-1", "update-2"]
