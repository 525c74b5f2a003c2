import bz2

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import as_tuples
from topicatlas import sinks, sources
from topicatlas.operators import categories, clean, profile
from topicatlas.schemas import RAW_REVISION
from topicatlas.streaming import stream_edits


def stanza(rev, user="ip:1.2.3.4", category="art music", minor="0", words="5"):
    lines = [f"REVISION 7 {rev} A_title 2008-01-03T00:00:00Z {user} {user}"]
    if category is not None:
        lines.append(f"CATEGORY {category}")
    lines += ["IMAGE", "MAIN Some_page Other_page"]
    if minor is not None:
        lines.append(f"MINOR {minor}")
    lines.append(f"TEXTDATA {words}")
    return "\n".join(lines)


STANZAS = [
    stanza(1),
    stanza(2, minor="1"),
    stanza(3, user="12345"),
    stanza(4, user="ip:office.example.com"),
    stanza(5, category="  "),
    stanza(6, category=None),
    stanza(7, minor=None),
    stanza(8, user="ip:256.1.1.1"),
    stanza(9, user="ip:0.255.255.255"),
    stanza(10, user="ip:1.0.0.0"),
    stanza(11, user="ip:223.255.255.255"),
    stanza(12, user="ip:224.0.0.0"),
    "REVISION too short\nCATEGORY art\nMINOR 0\nTEXTDATA 3",
    "CATEGORY lost\nMINOR 0",
    stanza(13, category="late") ,
]


def test_stanzas_to_edits(spark, lines):
    # One separator has white space in it, one is doubled, and the last record
    # has no blank line behind it.
    text = STANZAS[0] + "\n \t\n" + STANZAS[1] + "\n\n\n" + "\n\n".join(STANZAS[2:])
    path = lines(text)
    raw = sources.read_revisions(spark, path)
    assert raw.schema == RAW_REVISION
    assert raw.count() == 13
    assert sources.malformed_revisions(spark, path).count() == 2
    first = raw.filter("rev_id = '1'").first()
    assert first["main"] == "Some_page Other_page" and first["edit_ts"] == "2008-01-03T00:00:00Z"
    assert first["image"] in (None, "") and first["comment"] is None

    cleaned = clean.clean_revisions(raw)
    assert {r["rev_id"] for r in cleaned.collect()} == {"1", "7", "8", "9", "10", "11", "12", "13"}
    every = clean.clean_revisions(raw, minor_filter=False, anonymous_only=False)
    assert {r["rev_id"] for r in every.collect()} == {str(i) for i in range(1, 14)} - {"5", "6"}
    kept = clean.with_long_ip(cleaned)
    assert {r["rev_id"]: r["long_ip"] for r in kept.collect()} == {
        "1": 16909060, "7": 16909060, "10": 16777216, "11": 3758096383, "13": 16909060,
    }
    rejected = clean.reject_counts(every.unionByName(cleaned.filter("rev_id = '8'")))
    assert dict(map(tuple, rejected.collect())) == {"not_ipv4": 2, "bad_octet": 2, "out_of_range": 2}


def test_last_line_of_a_field_wins(spark, lines):
    path = lines(STANZAS[0] + "\nCATEGORY second one  \n")
    assert sources.read_revisions(spark, path).first()["categories"] == "second one"


def test_bzip2_is_read_in_splits(spark, tmp_path):
    path = tmp_path / "log.bz2"
    text = "\n\n".join(stanza(i, category=f"cat_{i * 7919 % 99991}") for i in range(60000))
    path.write_bytes(bz2.compress(text.encode(), compresslevel=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        raw = sources.read_revisions(spark, str(path))
        assert raw.select(F.spark_partition_id()).distinct().count() > 1
        assert raw.select("rev_id").distinct().count() == raw.count() == 60000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pruned_columns_are_not_computed(spark, lines):
    raw = sources.read_revisions(spark, lines(STANZAS[0])).select("rev_id")
    assert "TEMPLATE" not in raw._jdf.queryExecution().optimizedPlan().toString()


def test_edits(spark, lines):
    path = lines(
        "1| 11 |T|ip:1.1.1.1|a b|9|16843009\n"
        "2|12|T|ip:1.1.1.1|a  b A|9|12x\n"
        "3|13|T|ip:1.1.1.1|a|9| \n"
        "4|14|T|short\n"
        "5|15|T|ip:1.1.1.1|a|9|77|16777216\n"
    )
    edits = sources.read_edits(spark, path)
    assert as_tuples(edits, "rev_id", "long_ip", "valid_ip") == [
        ("11", 16843009, True), ("12", 0, False), ("13", 0, False), ("15", 77, True),
    ]
    assert sources.malformed_edits(spark, path).first()[0] == "4|14|T|short"
    tagged = sources.read_edits_with_class(spark, path)
    assert as_tuples(tagged, "rev_id", "class_ip") == [("15", 16777216)]


def test_edits_with_location(spark, lines):
    path = lines("1| 2 |T|x|y|cat|z|9|77|IT|Italy|Lazio|Rome|41.894740|12.483900\n1|2|3\n")
    found = sources.read_edits_with_location(spark, path).collect()
    assert [tuple(r) for r in found] == [
        ("1", "2", "T", "cat", "9", 77, "IT", "Italy", "Lazio", "Rome", 41894740, 12483900)
    ]


def test_locations(spark, lines):
    path = lines(
        '"0","16777215","-","-","-","-","0.000000","0.000000","-"\n'
        '"16777216","16777471","AU","Australia","Queensland","Brisbane, East","-27.467940","153.028090","4000"\n'
        '"16777472","16778239","CN","China","Fujian","Fuzhou","n/a","119.306110","350004"\n'
        '"short","1"\n'
    )
    found = sources.read_locations(spark, path)
    assert as_tuples(found, "ip_from", "ip_to", "city_name", "lat_udeg", "lon_udeg") == [
        (0, 16777215, "-", 0, 0),
        (16777216, 16777471, "Brisbane, East", -27467940, 153028090),
        (16777472, 16778239, "Fuzhou", None, 119306110),
    ]
    assert sources.malformed_locations(spark, path).count() == 2


def test_category_index(spark, lines):
    path = lines("Art#1|2|1\nart#2\nno separator\na#b#1\nMusic#5|x\n")
    assert as_tuples(sources.read_category_ips(spark, path)) == [
        ("art", 1, 2), ("art", 2, 2), ("music", 5, 1),
    ]
    cased = sources.read_category_ips(spark, path, lower=False)
    assert as_tuples(cased, "category", "n") == [("Art", 1), ("Art", 2), ("Music", 1), ("art", 1)]
    assert sorted(r[0] for r in sources.read_class_ips(spark, path).collect()) == [1, 1, 2, 2, 5]
    bad = {r[0] for r in sources.malformed_category_lines(spark, path).collect()}
    assert bad == {"no separator", "a#b#1", "Music#5|x"}


def test_category_index_round_trip_with_cut_lines(spark, rows, tmp_path):
    counts = rows("category string, class_ip long, n long", ("art", 1, 7), ("art", 9, 1), ("_b", 5, 2))
    path = str(tmp_path / "index")
    sinks.write_category_index(counts, path, length=3)
    written = [r[0] for r in spark.read.text(path).collect()]
    assert max(line.count("|") + 1 for line in written) <= 6 and len(written) == 3
    assert sorted("|".join(l.split("#")[1] for l in written if l.startswith("art")).split("|")) == ["1"] * 7 + ["9"]
    assert as_tuples(sources.read_category_ips(spark, path)) == as_tuples(counts)
    assert any(name.name.endswith(".bz2") for name in (tmp_path / "index").iterdir())
    with pytest.raises(PySparkException):
        sinks.write_category_index(counts, path)


def test_category_with_separator_cannot_be_written(rows, tmp_path):
    counts = rows("category string, class_ip long, n long", ("a#b", 1, 1))
    with pytest.raises(PySparkException, match="category holds"):
        sinks.write_category_index(counts, str(tmp_path / "index"))


def test_edit_lines(rows, tmp_path, spark):
    schema = "article_id string, rev_id string, article_title string, user_id string, categories string, textdata string"
    edits = rows(schema, ("1", "2", "T", "ip:1.1.1.1", "a b", None))
    assert sinks.edit_lines(edits).first()[0] == "1|2|T|ip:1.1.1.1|a b|"
    with_ip = edits.withColumn("long_ip", F.lit(7).cast("bigint"))
    sinks.write_edits(with_ip, str(tmp_path / "edits"))
    assert sources.read_edits(spark, str(tmp_path / "edits")).first()["long_ip"] == 7


def test_cluster_reports(spark, rows, tmp_path):
    counts = rows(
        "cluster int, category string, n long", (1, "art", 5), (1, "music", 9), (0, "b", 2), (1, "a", 5)
    )
    centroids = [(10.5, -3.25), (0.0, 1.0)]
    sinks.write_cluster_report(counts, centroids, str(tmp_path / "report"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "report").glob("part-*")))
    assert text == "0,-3.25,10.5:\n\t(b,2)\n1,1.0,0.0:\n\t(music,9)\n\t(a,5)\n\t(art,5)\n"
    main = profile.main_category(counts)
    sinks.write_main_categories(main, centroids, str(tmp_path / "main"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "main")).collect()] == [
        "0,-3.25,10.5,b,2", "1,1.0,0.0,music,9",
    ]


def test_output_name():
    assert sinks.output_name(["italian", "food"], [], 15, 10, 0.01) == "filters-italian_food-15-10-0.01"
    assert sinks.output_name(["art"], ["war", "x"], 5, 0, 0.5) == "filters-art-war_x-5-0-0.5"


def test_stream_takes_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.txt").write_text("\n\n".join(STANZAS))
    places = [str(source), str(tmp_path / "out"), str(tmp_path / "state")]
    stream_edits(spark, *places).awaitTermination()
    assert spark.read.parquet(places[1]).count() == 5
    (source / "two.txt").write_text(stanza(99))
    stream_edits(spark, *places).awaitTermination()
    table = spark.read.parquet(places[1])
    assert table.count() == 6 and table.filter("rev_id = '99'").count() == 1
    batch = clean.with_long_ip(clean.clean_revisions(sources.read_revisions(spark, places[0])))
    assert as_tuples(table) == as_tuples(batch.select(*table.columns))


def test_repeated_categories_count_twice(rows):
    edits = rows("categories string, class_ip long", ("art  art Music ", 4))
    assert as_tuples(categories.category_ips(categories.explode_categories(edits))) == [
        ("art", 4, 2), ("music", 4, 1),
    ]
    literal = categories.explode_categories(edits, literal=True, lower=False)
    assert sorted(r["category"] for r in literal.collect()) == ["", "Music", "art", "art"]


def test_values_of_a_revision_are_split_once(spark, lines):
    """Filters on several values, pushed down, do not look for the line and split it again."""
    path = lines("REVISION 1 2 t ts u ip:1.2.3.4\nCATEGORY a\nMINOR 0\n\nCATEGORY b\n\n")
    edits = clean.with_long_ip(clean.clean_revisions(sources.read_revisions(spark, path)))
    assert [r["long_ip"] for r in edits.collect()] == [16909060]
    plan = edits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\nREVISION , -1") == 1
