"""Every registered query, as registered, against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from checks import fixtures as fx
from checks import queries as registry
from checks.compare import connect, difference
from checks.oracle import ORACLE

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    frame = registry.QUERIES[name](spark, SF_DIR)
    assert difference(frame, connection, ORACLE[name]) is None


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    found = entry_points.entry(spark).collect()
    assert 0 < len(found) <= 15


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_the_inputs_can_tell_forms_apart(sf):
    """Range starts are unique, places grow, ranges crowd, an address and a category are hot, octets are bad."""
    db = connect(f"/root/testdata/{sf}")
    one = lambda sql: db.execute(sql).fetchone()
    ranges, starts, places = one(f"SELECT count(*), count(DISTINCT ip_from), count(DISTINCT (lon_udeg, lat_udeg)) FROM ({fx.LOCATIONS_SQL})")
    assert ranges == starts and places > 0.9 * ranges
    crowded = one(f"SELECT max(n) FROM (SELECT count(*) AS n FROM ({fx.LOCATIONS_SQL}) GROUP BY ip_from // 4096)")[0]
    assert crowded > 16 * max(1, ranges * 4096 // 2**32)
    edits, hot, bad, busy = one(
        f"""WITH fx_raw AS ({fx.RAW_SQL}), e AS ({fx.EDITS_SQL})
            SELECT count(*), count_if(long_ip = {fx.HOT_ADDRESS}), count_if(long_ip IS NULL), count_if(contains(categories, 'All_parts')) FROM e"""
    )
    assert hot > edits / 6 and bad > 0 and busy > edits / 4
