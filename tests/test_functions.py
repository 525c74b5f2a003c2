import ipaddress
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import as_tuples
from topicatlas.functions import ip, points, raster, text


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.ip_addresses(v=4), min_size=1, max_size=300))
def test_address_value_is_that_of_the_standard_library(spark, addresses):
    df = spark.createDataFrame([(str(a),) for a in addresses], "dotted string")
    found = df.select("dotted", ip.ipv4_to_long(F.col("dotted"))).collect()
    assert all(value == int(ipaddress.IPv4Address(dotted)) for dotted, value in found)


@pytest.mark.parametrize("bad", ["256.1.1.1", "1.2.3", "1.2.3.4.5", "a.b.c.d", "", "1..2.3", "1.2.3.1000", " 1.2.3.4"])
def test_no_address(rows, bad):
    assert rows("a string", (bad,)).select(ip.ipv4_to_long(F.col("a"))).first()[0] is None


def test_anonymous_users(rows):
    users = ["ip:1.2.3.4", "ip:office.example.com", "1234", "ip:1.2.3", "1.2.3.4", "ip:999.1.1.1"]
    df = rows("u string", *[(u,) for u in users])
    kept = {u for u, in df.filter(ip.is_anonymous_ipv4(F.col("u"))).collect()}
    assert kept == {"ip:1.2.3.4", "ip:999.1.1.1"}


def test_safe_numbers(rows):
    df = rows("t string", (" 42 ",), ("",), ("4x2",), ("-1",), (None,), ("99999999999999999999",))
    found = [tuple(r) for r in df.select(ip.safe_long(F.col("t")), ip.digits_to_long(F.col("t"))).collect()]
    assert found == [(42, 42), (0, None), (0, 42), (0, 1), (0, None), (0, None)]


def test_point_algebra(rows):
    df = rows("x double, y double", (3.0, 4.0)).select(points.point(F.col("x"), F.col("y")).alias("a"))
    a = F.col("a")
    b = points.point(F.lit(1.0), F.lit(-2.0))
    found = df.select(
        points.add(a, b), points.subtract(a, b), points.negate(a), points.divide(a, F.lit(2.0)),
        points.magnitude(a), points.distance(a, b), a == points.point(F.lit(3), F.lit(4)), points.to_text(a),
    ).first()
    assert [tuple(p) for p in found[:4]] == [(4.0, 2.0), (2.0, 6.0), (-3.0, -4.0), (1.5, 2.0)]
    assert found[4:] == (5.0, math.sqrt(4 + 36), True, "(3.0,4.0)")


def test_micro_degrees_keep_the_parsed_double(rows):
    texts = ["12.345678", "-0.000001", "179.999999", "0", "-90", "no", "1e1"]
    df = rows("t string", *[(t,) for t in texts])
    udeg = points.to_udeg(F.col("t"))
    found = df.select("t", udeg.alias("u"), points.degrees(udeg).alias("d")).collect()
    assert {t: d for t, _, d in found if d is not None} == {t: float(t) for t in texts if t != "no"}


@pytest.mark.parametrize("literal, lon, lat", [(False, (-180, 180), (-90, 90)), (True, (0, 181), (-90, 91))])
def test_random_points(spark, literal, lon, lat):
    drawn = points.random_points(spark, 200, seed=3, literal=literal).collect()
    assert len(drawn) == 200 and len({(r["lon"], r["lat"]) for r in drawn}) == 200
    assert all(lon[0] <= r["lon"] < lon[1] and lat[0] <= r["lat"] < lat[1] for r in drawn)
    assert min(r["lon"] for r in drawn) < lon[0] + 20 and max(r["lon"] for r in drawn) > lon[1] - 20


@pytest.mark.parametrize("groups", [1, 3, 7, 15, 50])
def test_colors_are_those_of_the_jvm(spark, groups):
    color = raster.group_color(F.col("i"), groups)
    df = spark.range(groups).select(F.col("id").cast("int").alias("i"))
    found = df.select("i", color.alias("c"), raster.brighter(color).alias("b")).collect()
    jvm = spark._jvm.java.awt.Color
    for i, color, bright in found:
        expected = jvm.getHSBColor(i / groups, 0.8, 0.5)
        assert tuple(color) == (expected.getRed(), expected.getGreen(), expected.getBlue())
        expected = expected.brighter()
        assert tuple(bright) == (expected.getRed(), expected.getGreen(), expected.getBlue())


def test_brighter_of_dark_colors(rows):
    df = rows("r int, g int, b int", (0, 0, 0), (1, 0, 250))
    color = raster.rgb(F.col("r"), F.col("g"), F.col("b"))
    found = [tuple(r[0]) for r in df.select(raster.brighter(color)).collect()]
    assert found == [(3, 3, 3), (4, 0, 255)]


def test_pixels_truncate_and_may_fall_outside(rows):
    df = rows("lon double, lat double", (0.0, 0.0), (-180.0, 90.0), (180.0, -90.0), (-179.99, 89.99))
    found = df.select(raster.pixel_x(F.col("lon"), 2000), raster.pixel_y(F.col("lat"), 1000))
    assert [tuple(r) for r in found.collect()] == [(1000, 500), (0, 0), (2000, 1000), (0, 0)]


def test_labels(rows):
    df = rows("c int, n long, cat string", (3, 1234567, "art_in_italy"))
    c, n = F.col("c"), F.col("n")
    found = df.select(
        text.cluster_label(c, n), text.cluster_label(c, n, True), text.legend_label(c, F.col("cat"), n),
        text.centroid_text(F.lit(1.5), F.lit(-2.25)), text.total_caption(n),
        *text.run_caption(["art", "music"], 7, 0, 0.01),
    ).first()
    assert tuple(found) == (
        "(3)", "(3) 1,234,567", "(3) art in italy 1234567", "1.500000,-2.250000", "Tot. points: 1234567",
        "Filter words: art music", "k: 7,  \tit: 0,  \teps: 0.01000",
    )


def test_tokens_and_distinct(rows):
    df = rows("c string", ("_science-fiction+film.s^x:y,z_b",))
    assert df.select(text.category_tokens(F.col("c"))).first()[0] == ["", "sciencefictionfilmsxyz", "b"]
    df = rows("a array<string>", (["b", "a", "b", "c", "a"],))
    assert df.select(text.reverse_distinct(F.col("a"))).first()[0] == ["c", "a", "b"]


def test_address_expression_names_the_user_once(spark):
    """Pushing the range filter down must not repeat the work behind the address."""
    from topicatlas.operators.clean import with_long_ip

    df = spark.range(5).select(F.concat(F.lit("ip:1.2.3."), F.md5(F.col("id").cast("string"))).alias("user_id"))
    plan = with_long_ip(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") <= 4


def test_as_tuples_orders_nulls_last(rows):
    assert as_tuples(rows("a int", (None,), (1,))) == [(1,), (None,)]
