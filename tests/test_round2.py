"""Cases the first round got wrong."""

import pytest

from topicatlas import sources
from topicatlas.operators import kmeans as km
from topicatlas.operators import locate
from topicatlas.plans import locate_categories


def test_a_range_without_readable_coordinates_keeps_its_addresses(spark, lines, rows):
    path = lines(
        '"100","199","AA","A","A","A","1.0","2.0","-"\n"200","299","BB","B","B","B","n/a","2.0","-"\n'
    )
    ranges = sources.read_locations(spark, path)
    edits = rows("rev_id string, long_ip long", ("a", 150), ("b", 250))
    found = locate.resolve_locations(edits, ranges)
    assert {r["rev_id"]: r["class_ip"] for r in found.collect()} == {"a": 100, "b": 200}
    assert [r["rev_id"] for r in locate.attach_location(found, ranges).collect()] == ["a"]
    assert [r["rev_id"] for r in locate.unmatched_classes(found, ranges).collect()] == ["b"]


def test_occurrences_of_a_repeated_point_add_up(rows):
    points = rows("lon_udeg long, lat_udeg long, n long", *[(x, x, 1) for x in (1, 2) for _ in range(5)])
    drawn = [
        len({(r["lon_udeg"], r["lat_udeg"]) for r in km.seed_occurrences(points, 2, seed).collect()}) for seed in range(12)
    ]
    assert set(drawn) == {1, 2}


def test_given_centroids_must_be_k(rows):
    points = rows("lon_udeg long, lat_udeg long, n long", (1, 1, 1), (2, 2, 1))
    with pytest.raises(ValueError, match="given for k=2"):
        km.initial_centroids(points, 2, given=[(0.0, 0.0)])


def test_an_address_beyond_long_is_not_valid(spark, lines):
    path = lines("1|2|T|ip:1.1.1.1|c|d|99999999999999999999\n1|2|T|ip:1.1.1.1|c|d|77\n")
    found = {r["long_ip"]: r["valid_ip"] for r in sources.read_edits(spark, path).collect()}
    assert found == {0: False, 77: True}


@pytest.mark.parametrize("end, blank", [("\r\n", "\r\n"), ("\n", " \n"), ("\n", "\t\r\n"), ("\n", "\n\n\n")])
def test_no_record_holds_more_than_one_revision(spark, lines, end, blank):
    stanza = "REVISION 1 {0} T 2008 ip:1.1.1.{0} ip:1.1.1.{0}" + end + "CATEGORY c{0}" + end + "MINOR 0" + end
    path = lines(blank.join(stanza.format(i) for i in range(200)))
    assert spark.read.text(path, lineSep=sources.revisions.RECORD_END).count() == 200
    found = {r["rev_id"]: r["categories"] for r in sources.read_revisions(spark, path).collect()}
    assert found == {str(i): f"c{i}" for i in range(200)}
    assert sources.malformed_revisions(spark, path).count() == 0


def test_what_stands_before_the_first_revision_is_malformed(spark, lines):
    path = lines("CATEGORY a b c d e\n\n\nREVISION 1 2 T 2008 u u\nCATEGORY x\n\nMINOR 1\n")
    assert [r["categories"] for r in sources.read_revisions(spark, path).collect()] == ["x"]
    assert sources.malformed_revisions(spark, path).count() == 2


def test_edits_without_a_place_are_no_points(rows):
    ranges = rows(
        "ip_from long, ip_to long, lon_udeg long, lat_udeg long", (100, 199, 1, 1), (200, 299, None, None)
    )
    edits = rows("categories string, long_ip long", ("a", 150), ("a", 250), ("b", 250))
    found = locate_categories(edits, ranges).collect()
    assert [tuple(r) for r in found] == [("a", 1, 1, 1)]
