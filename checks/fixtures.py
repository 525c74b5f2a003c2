"""Inputs in the engine's layouts, derived from the given tables.

``locations``, ``raw_revisions`` and ``edits`` build them in Spark; ``CTES`` holds
the same as SQL to be put in front of an oracle query.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicatlas.functions.ip import address_of, ipv4_to_long
from topicatlas.operators.clean import clean_revisions

ADDRESS_SPAN = 3741319168
FIRST_ADDRESS = 16777216
CORNER = 1500000001
HOT_ADDRESS = 1500000503


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One range per customer and one at address 0.

    Every third customer's range is in one corner of the address space, 16 addresses
    from the next; places are as many as customers, a quarter of them in one district.
    """
    customer = table(spark, sf_dir, "customer")
    # Fixed tables of 25 and 5 rows.
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    region = F.broadcast(table(spark, sf_dir, "region"))
    step = customer.select(F.floor(F.lit(ADDRESS_SPAN) / F.count("*"))).scalar()
    ranges = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("step", step)
        .selectExpr(
            f"""CASE WHEN c_custkey % 3 = 0 THEN {CORNER} + c_custkey * 16
                ELSE {FIRST_ADDRESS} + c_custkey * step + (c_custkey * 7919) % step END AS ip_from""",
            "concat('N', n_nationkey) AS country_code",
            "n_name AS country_name",
            "r_name AS region_name",
            "replace(c_name, '#', '_') AS city_name",
            """CASE WHEN c_custkey % 4 = 0 THEN 41000000 + (c_custkey * 7919) % 1000000
                ELSE (c_custkey * 7919) % 1801 * 100000 - 90000000 END AS lat_udeg""",
            """CASE WHEN c_custkey % 4 = 0 THEN 12000000 + (c_custkey * 104729) % 1000000
                ELSE (c_custkey * 104729) % 3600 * 100000 - 180000000 END AS lon_udeg""",
        )
    )
    first = spark.range(1).selectExpr(
        "0L AS ip_from", "'-' AS country_code", "'-' AS country_name", "'-' AS region_name",
        "'-' AS city_name", "0L AS lat_udeg", "0L AS lon_udeg",
    )
    return first.unionByName(ranges)


def raw_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One revision per line item.

    A quarter are at one address, some have an octet above 255, and a category is on
    every third.
    """
    lineitem = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    address = (
        f"CASE WHEN l_suppkey % 10 = 2 AND l_linenumber = 1 THEN 3758096384 + l_orderkey"
        f" WHEN l_suppkey % 10 > 6 AND l_partkey % 5 > 0 THEN {HOT_ADDRESS}"
        f" ELSE {FIRST_ADDRESS} + (l_orderkey * 2654435761 + l_linenumber * 40503"
        f" + l_suppkey * 69069) % {ADDRESS_SPAN} END"
    )
    return (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("ipn", F.expr(address))
        .withColumn("title", F.replace("p_name", F.lit(" "), F.lit("_")))
        .selectExpr(
            "cast(l_partkey AS string) AS article_id",
            "cast(l_orderkey * 10 + l_linenumber AS string) AS rev_id",
            "title AS article_title",
            "l_shipdate AS edit_ts",
            """CASE WHEN l_suppkey % 10 = 3 AND l_linenumber = 2 THEN concat('ip:1.', 256 + l_orderkey % 700, '.0.1')
                    WHEN l_suppkey % 10 = 0 THEN concat('ip:host', l_suppkey, '.example.com')
                    WHEN l_suppkey % 10 = 1 THEN cast(l_suppkey AS string)
                    ELSE concat('ip:', ipn div 16777216, '.', (ipn div 65536) % 256, '.',
                                (ipn div 256) % 256, '.', ipn % 256) END AS user_id""",
            """CASE WHEN p_size % 25 = 0 THEN ''
                    ELSE concat(title, ' ', p_type, '_', title, ' ', replace(p_brand, '#', '-'), '_parts',
                                CASE WHEN l_orderkey % 3 = 0 THEN ' All_parts' ELSE '' END) END AS categories""",
            "CASE WHEN l_linenumber = 7 THEN '1' ELSE '0' END AS minor",
            "cast(l_quantity AS bigint) AS textdata",
        )
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned revisions with their address, routable or not."""
    cleaned = clean_revisions(raw_revisions(spark, sf_dir))
    return cleaned.withColumn("long_ip", ipv4_to_long(address_of(F.col("user_id"))))


LOCATIONS_SQL = """
WITH n AS (SELECT CAST(FLOOR(3741319168 / COUNT(*)) AS BIGINT) AS step FROM customer)
SELECT CAST(0 AS BIGINT) AS ip_from, '-' AS country_code, '-' AS country_name, '-' AS region_name, '-' AS city_name,
       CAST(0 AS BIGINT) AS lat_udeg, CAST(0 AS BIGINT) AS lon_udeg
UNION ALL
SELECT CASE WHEN c_custkey % 3 = 0 THEN 1500000001 + c_custkey * 16
            ELSE 16777216 + c_custkey * step + (c_custkey * 7919) % step END AS ip_from,
       CONCAT('N', CAST(n_nationkey AS VARCHAR(10))) AS country_code, n_name AS country_name, r_name AS region_name,
       REPLACE(c_name, '#', '_') AS city_name,
       CASE WHEN c_custkey % 4 = 0 THEN 41000000 + (c_custkey * 7919) % 1000000
            ELSE (c_custkey * 7919) % 1801 * 100000 - 90000000 END AS lat_udeg,
       CASE WHEN c_custkey % 4 = 0 THEN 12000000 + (c_custkey * 104729) % 1000000
            ELSE (c_custkey * 104729) % 3600 * 100000 - 180000000 END AS lon_udeg
FROM customer CROSS JOIN n JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

RAW_SQL = """
WITH b AS (
  SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_shipdate, p_name, p_type, p_brand, p_size,
    CASE WHEN l_suppkey % 10 = 2 AND l_linenumber = 1 THEN 3758096384 + l_orderkey
         WHEN l_suppkey % 10 > 6 AND l_partkey % 5 > 0 THEN 1500000503
         ELSE 16777216 + (l_orderkey * 2654435761 + l_linenumber * 40503 + l_suppkey * 69069) % 3741319168 END AS ipn
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT CAST(l_partkey AS VARCHAR(20)) AS article_id,
  CAST(l_orderkey * 10 + l_linenumber AS VARCHAR(20)) AS rev_id,
  REPLACE(p_name, ' ', '_') AS article_title,
  l_shipdate AS edit_ts,
  CASE WHEN l_suppkey % 10 = 3 AND l_linenumber = 2 THEN CONCAT('ip:1.', CAST(256 + l_orderkey % 700 AS VARCHAR(3)), '.0.1')
       WHEN l_suppkey % 10 = 0 THEN CONCAT('ip:host', CAST(l_suppkey AS VARCHAR(20)), '.example.com')
       WHEN l_suppkey % 10 = 1 THEN CAST(l_suppkey AS VARCHAR(20))
       ELSE CONCAT('ip:', CAST(CAST(FLOOR(ipn / 16777216) AS BIGINT) AS VARCHAR(3)), '.',
                  CAST(CAST(FLOOR(ipn / 65536) AS BIGINT) % 256 AS VARCHAR(3)), '.',
                  CAST(CAST(FLOOR(ipn / 256) AS BIGINT) % 256 AS VARCHAR(3)), '.',
                  CAST(ipn % 256 AS VARCHAR(3))) END AS user_id,
  CASE WHEN p_size % 25 = 0 THEN ''
       ELSE CONCAT(REPLACE(p_name, ' ', '_'), ' ', p_type, '_', REPLACE(p_name, ' ', '_'), ' ', REPLACE(p_brand, '#', '-'), '_parts',
                   CASE WHEN l_orderkey % 3 = 0 THEN ' All_parts' ELSE '' END) END AS categories,
  CASE WHEN l_linenumber = 7 THEN '1' ELSE '0' END AS minor,
  CAST(l_quantity AS BIGINT) AS textdata
FROM b
"""

EDITS_SQL = """
SELECT article_id, rev_id, article_title, user_id, categories, textdata,
  CASE WHEN GREATEST(CAST(o1 AS INT), CAST(o2 AS INT), CAST(o3 AS INT), CAST(o4 AS INT)) <= 255
       THEN CAST(o1 AS BIGINT)*16777216 + CAST(o2 AS BIGINT)*65536 + CAST(o3 AS BIGINT)*256 + CAST(o4 AS BIGINT) END AS long_ip
FROM (SELECT *, SPLIT_PART(SUBSTR(user_id,4),'.',1) o1, SPLIT_PART(SUBSTR(user_id,4),'.',2) o2,
             SPLIT_PART(SUBSTR(user_id,4),'.',3) o3, SPLIT_PART(SUBSTR(user_id,4),'.',4) o4
      FROM fx_raw WHERE minor <> '1' AND categories <> ''
        AND regexp_full_match(user_id, 'ip:[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) t
"""
