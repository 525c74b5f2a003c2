"""One query per operator, each over whole tables."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from topicatlas.functions import ip, points as pt, text
from topicatlas.operators import categories as cat
from topicatlas.operators import clean, kmeans as km, locate, profile, raster
from topicatlas.operators import points as cp
from topicatlas.operators.lineage import shared_folder
from topicatlas.operators.ranges import index_ranges, read_range_index, write_range_index
from topicatlas.plans import (
    Regions,
    build_coded_index,
    build_index,
    find_regions,
    locate_categories,
)
from topicatlas.sinks import (
    edit_lines,
    output_name,
    write_category_index,
    write_cluster_report,
    write_edits,
    write_main_categories,
)
from topicatlas.sources import (
    read_category_ips,
    read_class_ips,
    read_edits,
    read_edits_with_class,
    read_edits_with_location,
    read_locations,
    read_revisions,
)
from topicatlas.streaming import stream_edits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

K = 5

DENSE_CORNER = 167772160
DENSE_ADDRESS = """CASE WHEN cast(rev_id AS bigint) % 3 = 0 THEN 167772167
    WHEN cast(rev_id AS bigint) % 3 = 1 THEN 167772160 + cast(rev_id AS bigint) div 5 ELSE long_ip END"""


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def routable(spark: SparkSession, sf: str) -> DataFrame:
    return clean.with_long_ip(clean.clean_revisions(fx.raw_revisions(spark, sf)))


def index(spark: SparkSession, sf: str) -> DataFrame:
    return build_index(routable(spark, sf), fx.locations(spark, sf))


def located(spark: SparkSession, sf: str) -> DataFrame:
    return locate_categories(routable(spark, sf), fx.locations(spark, sf))


def weighted(spark: SparkSession, sf: str) -> DataFrame:
    return cp.weighted_points(located(spark, sf))


def regions(spark: SparkSession, sf: str, iterations: int = 3, **options) -> Regions:
    return find_regions(located(spark, sf), K, iterations=iterations, **options)


def scratch(spark: SparkSession, name: str) -> str:
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


# --- cleaning and addresses ---------------------------------------------------


@query
def clean_revisions(spark, sf):
    return clean.clean_revisions(fx.raw_revisions(spark, sf))


@query
def clean_revisions_unfiltered(spark, sf):
    raw = fx.raw_revisions(spark, sf)
    return clean.clean_revisions(raw, minor_filter=False, anonymous_only=False)


@query
def ipv4_to_long(spark, sf):
    return fx.edits(spark, sf).select("rev_id", "user_id", "long_ip")


@query
def routable_edits(spark, sf):
    return routable(spark, sf)


@query
def ip_reject_counts(spark, sf):
    raw = fx.raw_revisions(spark, sf)
    return clean.reject_counts(clean.clean_revisions(raw, anonymous_only=False))


@query
def safe_long_parse(spark, sf):
    return fx.raw_revisions(spark, sf).select(
        F.trim("rev_id").alias("rev_key"),
        "user_id",
        ip.safe_long(F.col("user_id")).alias("safe_value"),
        ip.digits_to_long(F.col("user_id")).alias("digits_value"),
    )


# --- locations ----------------------------------------------------------------


def _resolved(df: DataFrame, *more: str) -> DataFrame:
    return df.select("rev_id", "long_ip", "class_ip", *more)


@query
def resolve_asof_cells(spark, sf):
    return _resolved(locate.resolve_locations(routable(spark, sf), fx.locations(spark, sf)))


@query
def resolve_asof_stored(spark, sf):
    """By an index of an earlier run, with what is known of its size."""
    path = scratch(spark, "range-index")
    write_range_index(index_ranges(fx.locations(spark, sf)), path)
    stored = read_range_index(spark, path)
    return _resolved(locate.resolve_locations(routable(spark, sf), stored, attach=["city_name"]), "city_name")


@query
def range_index_statistics(spark, sf):
    """Ranges, and text to attach, of an index; no cell holds more than 17 pieces."""
    built = index_ranges(_crowded_ranges(spark, sf))
    known = spark.range(1).select(F.lit(built.n_ranges).alias("ranges"), F.lit(built.fullest <= 17).alias("bounded"))
    cells = built.cells.agg(F.count("*").alias("pieces"), F.countDistinct("class_ip").alias("classes"))
    both = known.join(cells)
    return both.select("ranges", "classes", "bounded", (F.col("pieces") == built.n_pieces).alias("counted"))


@query
def resolve_asof_bucketed(spark, sf):
    return _resolved(
        locate.resolve_locations(routable(spark, sf), fx.locations(spark, sf), method="bucketed")
    )


@query
def resolve_asof_window(spark, sf):
    return _resolved(
        locate.resolve_locations(routable(spark, sf), fx.locations(spark, sf), method="window")
    )


@query
def resolve_asof_shuffled(spark, sf):
    """The form for location tables too large to broadcast."""
    return _resolved(
        locate.resolve_locations(
            routable(spark, sf), fx.locations(spark, sf), broadcast_bytes=0, attach=["city_name"]
        ),
        "city_name",
    )


@query
def resolve_check_upper(spark, sf):
    gaps = fx.locations(spark, sf).withColumn("ip_to", F.col("ip_from") + 200000)
    return _resolved(locate.resolve_locations(routable(spark, sf), gaps, check_upper=True))


@query
def resolve_above_first(spark, sf):
    """Addresses below the first range keep a null class."""
    later = fx.locations(spark, sf).filter(F.col("ip_from") > 1000000000)
    return _resolved(locate.resolve_locations(routable(spark, sf), later))


def _crowded_ranges(spark, sf):
    orders = fx.table(spark, sf, "orders")
    corner = orders.select((F.lit(DENSE_CORNER) + F.col("o_orderkey") * 2).alias("ip_from"))
    return fx.locations(spark, sf).select("ip_from").unionByName(corner)


@query
def resolve_asof_dense(spark, sf):
    """As many ranges as orders in one corner, a third of the edits at one address there."""
    starts = _crowded_ranges(spark, sf)
    edits = routable(spark, sf).select("rev_id", F.expr(DENSE_ADDRESS).alias("long_ip"))
    return _resolved(locate.resolve_locations(edits, starts))


@query
def resolve_unreadable_place(spark, sf):
    """Ranges without coordinates keep their addresses; those edits have a class and no place."""
    missing = F.col("ip_from") % 3 == 0
    places = fx.locations(spark, sf).withColumns(
        {name: F.when(~missing, F.col(name)) for name in ("lon_udeg", "lat_udeg")}
    )
    attach = ["lon_udeg", "lat_udeg"]
    return _resolved(locate.resolve_locations(routable(spark, sf), places, attach=attach), *attach)


@query
def range_ends(spark, sf):
    return locate.with_range_end(fx.locations(spark, sf)).select("ip_from", "range_end")


@query
def dedup_locations(spark, sf):
    once = fx.locations(spark, sf)
    twice = once.filter(F.col("ip_from") % 3 == 0).withColumn(
        "city_name", F.concat("city_name", F.lit("_late"))
    )
    return locate.dedup_locations(once.unionByName(twice), order=["city_name"])


@query
def attach_location(spark, sf):
    columns = ["country_code", "city_name", "lon_udeg", "lat_udeg"]
    located_ips = locate.attach_location(index(spark, sf), fx.locations(spark, sf), columns)
    return located_ips.select(
        "category", "class_ip", "n", "country_code", "city_name",
        pt.degrees(F.col("lon_udeg")).alias("lon"), pt.degrees(F.col("lat_udeg")).alias("lat"),
    )


@query
def unmatched_classes(spark, sf):
    known = fx.locations(spark, sf).filter(F.col("region_name") != "ASIA")
    return locate.unmatched_classes(index(spark, sf), known)


# --- categories ---------------------------------------------------------------


@query
def explode_categories(spark, sf):
    return cat.explode_categories(routable(spark, sf)).select("rev_id", "category")


@query
def category_ips(spark, sf):
    return index(spark, sf)


@query
def category_index_lines(spark, sf):
    return cat.category_lines(index(spark, sf))


@query
def category_index_parts(spark, sf):
    """Lists cut about once in a hundred copies, where the addresses say so."""
    return cat.category_lines(index(spark, sf), length=100)


@query
def class_index_lines(spark, sf):
    """Lines ``category:ip|ip``, straight from edits that carry their class."""
    tagged = locate.resolve_locations(routable(spark, sf), fx.locations(spark, sf))
    exploded = cat.explode_categories(tagged.select("categories", "class_ip"), lower=False)
    return cat.category_lines(cat.category_ips(exploded), separator=":")


@query
def category_frequency(spark, sf):
    return cat.category_frequency(cat.explode_categories(routable(spark, sf).select("categories")))


def coded(spark, sf):
    """The category index by number, and its dictionary."""
    return build_coded_index(routable(spark, sf), fx.locations(spark, sf))


def _filtered(spark, sf, **words):
    """Words are looked for in the dictionary; the counts of the rest never get a name."""
    counts, dictionary = coded(spark, sf)
    return dictionary.name(dictionary.filter(cat.category_frequency(counts), **words))


@query
def filter_by_name(spark, sf):
    """The same on rows that carry their names."""
    return cat.filter_categories(category_frequency(spark, sf), include=["red", "parts"], exclude=["bolt", "brand2"])


@query
def filter_any(spark, sf):
    return _filtered(spark, sf, include=["Red", "economy"])


@query
def filter_all(spark, sf):
    return _filtered(spark, sf, include=["red", "widget"], match="all")


@query
def filter_any_exclude(spark, sf):
    return _filtered(spark, sf, include=["red", "parts"], exclude=["bolt", "brand2"])


@query
def filter_exclude_only(spark, sf):
    return _filtered(spark, sf, exclude=["bolt", "Ring"])


@query
def filter_none(spark, sf):
    return _filtered(spark, sf)


@query
def filter_literal(spark, sf):
    return _filtered(spark, sf, include=["red", "widget"], exclude=["red", "bolt"], literal=True)


@query
def filter_literal_no_exclude(spark, sf):
    return _filtered(spark, sf, include=["red", "widget"], literal=True)


@query
def category_tokens(spark, sf):
    return category_frequency(spark, sf).select(
        "category", F.concat_ws("/", text.category_tokens(F.col("category"))).alias("tokens")
    )


# --- points -------------------------------------------------------------------


@query
def category_points(spark, sf):
    return cp.category_points(index(spark, sf), fx.locations(spark, sf))


@query
def category_points_by_number(spark, sf):
    """The same with numbers in the place of names up to the end."""
    counts, dictionary = coded(spark, sf)
    points = cp.category_points(counts, fx.locations(spark, sf))
    return dictionary.name(points).select("category", "lon_udeg", "lat_udeg", "n")


@query
def located_categories(spark, sf):
    """The same without the index in between."""
    return located(spark, sf)


@query
def point_categories(spark, sf):
    return _point_categories(cp.point_categories(located(spark, sf)))


@query
def point_category_parts(spark, sf):
    """Lists cut about once in twenty names, where the names say so."""
    return _point_categories(cp.point_categories(located(spark, sf), length=20))


def _point_categories(listed):
    entries = F.transform("categories", lambda c: F.concat(c["category"], F.lit(":"), c["n"]))
    return listed.select(
        "lon_udeg", "lat_udeg", "part", F.concat_ws("|", entries).alias("categories")
    )


@query
def weighted_points(spark, sf):
    return weighted(spark, sf)


@query
def point_total(spark, sf):
    return cp.point_total(located(spark, sf)).select(
        "points", "occurrences", text.total_caption(F.col("occurrences")).alias("caption")
    )


@query
def point_algebra(spark, sf):
    lon, lat = pt.degrees(F.col("lon_udeg")), pt.degrees(F.col("lat_udeg"))
    pairs = fx.locations(spark, sf).select(
        "ip_from", pt.point(lon, lat).alias("a"), pt.point(lat, lon / 2).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return pairs.select(
        "ip_from",
        pt.add(a, b)["lon"].alias("sum_lon"),
        pt.subtract(a, b)["lat"].alias("difference_lat"),
        pt.negate(a)["lon"].alias("negative_lon"),
        pt.divide(a, F.lit(3.0))["lat"].alias("third_lat"),
        pt.magnitude(a).alias("magnitude"),
        pt.distance(a, b).alias("distance"),
        (a == b).alias("equal"),
        pt.to_text(a).alias("text"),
    )


# --- clustering ---------------------------------------------------------------


@query
def seed_centroids(spark, sf):
    return km.seed_centroids(weighted(spark, sf), K)


@query
def seed_occurrences(spark, sf):
    return km.seed_occurrences(weighted(spark, sf), K)


@query
def seed_occurrences_repeated(spark, sf):
    """The same from a row per category and point: rows of a point add up."""
    points = located(spark, sf).select("lon_udeg", "lat_udeg", "n")
    return km.seed_occurrences(points, K)


def _seeded(spark, sf):
    points = km.cut_lineage(weighted(spark, sf), "weighted-points")
    return points, km.initial_centroids(points, K)


@query
def nearest_centroid(spark, sf):
    points, centroids = _seeded(spark, sf)
    return km.nearest(points, centroids)


@query
def nearest_centroid_arrow(spark, sf):
    points, centroids = _seeded(spark, sf)
    return km.nearest(points, centroids, method="arrow")


@query
def cluster_means(spark, sf):
    points, centroids = _seeded(spark, sf)
    return km.cluster_means(points, centroids)


@query
def kmeans_step(spark, sf):
    return km.kmeans(weighted(spark, sf), K, iterations=1).centroid_table()


@query
def kmeans_n3(spark, sf):
    return km.kmeans(weighted(spark, sf), K, iterations=3).centroid_table()


@query
def kmeans_pruned(spark, sf):
    """The same by cells of a grid, most of which are assigned whole."""
    return km.kmeans(weighted(spark, sf), K, iterations=3, method="pruned").centroid_table()


@query
def kmeans_resumed(spark, sf):
    """The same by a run that goes on from the first update of another."""
    points, folder = weighted(spark, sf), scratch(spark, "run")
    km.kmeans(points, K, iterations=1, folder=folder)
    return km.kmeans(points, K, iterations=3, folder=folder).centroid_table()


EPSILON = 1.0


@query
def kmeans_epsilon(spark, sf):
    return km.kmeans(weighted(spark, sf), K, epsilon=EPSILON).centroid_table()


@query
def kmeans_movement(spark, sf):
    return km.kmeans(weighted(spark, sf), K, iterations=3).iteration_log()


@query
def kmeans_empty_and_equal(spark, sf):
    """Two equal centroids, and one too far off to get any point."""
    given = [(10.0, 10.0), (-60.0, 0.0), (10.0, 10.0), (9000.0, 9000.0)]
    points = km.cut_lineage(weighted(spark, sf), "weighted-points")
    found = km.kmeans(points, 4, iterations=1, given=given)
    return profile.with_centroid(
        profile.cluster_sizes(km.assign(points, found.centroids)), found.centroids
    )


@query
def kmeans_assign(spark, sf):
    return regions(spark, sf).assignment


# --- cluster profiles ---------------------------------------------------------


@query
def cluster_sizes(spark, sf):
    return regions(spark, sf).sizes


@query
def cluster_distinct_points(spark, sf):
    found = regions(spark, sf)
    return profile.cluster_distinct_points(km.assign(found.category_points, found.centroids))


@query
def cluster_point_categories(spark, sf):
    found = regions(spark, sf)
    return profile.cluster_point_categories(found.assignment, found.category_points)


@query
def cluster_categories(spark, sf):
    return regions(spark, sf).categories


@query
def main_category(spark, sf):
    return regions(spark, sf).main_categories


@query
def main_category_report(spark, sf):
    found = regions(spark, sf)
    return profile.main_category_report(found.main_categories, found.centroids)


@query
def main_category_file(spark, sf):
    """The report of main categories, read back from its one file."""
    found, path = regions(spark, sf), scratch(spark, "main")
    write_main_categories(found.main_categories, found.centroids, path)
    read = spark.read.csv(path, schema="cluster int, lat double, lon double, category string, n long")
    files = len(read.inputFiles())
    return read.select(F.lit(files).cast("bigint").alias("files"), "cluster", "lat", "lon", "category", "n")


@query
def run_folder_names(spark, sf):
    """The folder of a run for the words of each region (a fixed table), none of its nations."""
    regions_of, nations = fx.table(spark, sf, "region"), fx.table(spark, sf, "nation")
    grouped = regions_of.join(nations, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "r_regionkey")
    runs = grouped.agg(F.sort_array(F.collect_list(F.lower("n_name"))).alias("names")).collect()
    rows = [
        (r["r_name"], output_name([r["r_name"].lower(), "art"], r["names"], len(r["names"]), r["r_regionkey"], 0.01))
        for r in runs
    ]
    return spark.createDataFrame(rows, "region string, folder string")


@query
def super_clusters(spark, sf):
    return regions(spark, sf).super_clusters.select(
        "category", F.concat_ws("|", F.col("clusters").cast("array<string>")).alias("clusters")
    )


@query
def cluster_report_lines(spark, sf):
    """Category lines only: how doubles print in the headings differs between engines."""
    found = regions(spark, sf)
    return profile.report_lines(found.categories, found.centroids).filter(
        F.col("category").isNotNull()
    )


@query
def cluster_report_headings(spark, sf):
    found = regions(spark, sf)
    heads = profile.report_lines(found.categories, found.centroids).filter(
        F.col("category").isNull()
    )
    cells = F.split(F.rtrim("line", F.lit(":")), ",")
    return heads.select(
        "cluster", F.get(cells, F.lit(1)).cast("double").alias("lat"),
        F.get(cells, F.lit(2)).cast("double").alias("lon"),
        F.endswith("line", F.lit(":")).alias("is_heading"),
    )


@query
def cluster_report(spark, sf):
    """Every line of the report as written."""
    found = regions(spark, sf)
    path = scratch(spark, "report")
    write_cluster_report(found.categories, found.centroids, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def region_interests(spark, sf):
    """Filtered categories: size, place and main interest of every region."""
    return regions(spark, sf, include=["red", "economy"], exclude=["ring"]).summary


@query
def array_dedup_reverse(spark, sf):
    letters = F.split("categories", "_")
    return routable(spark, sf).select(
        "rev_id", F.concat_ws("_", text.reverse_distinct(letters)).alias("words")
    )


# --- map tables ---------------------------------------------------------------


@query
def pixel_coords(spark, sf):
    return raster.pixel_coords(
        fx.locations(spark, sf).select("ip_from", "lon_udeg", "lat_udeg")
    )


@query
def pixel_coords_clipped(spark, sf):
    shifted = fx.locations(spark, sf).select(
        "ip_from", (-F.col("lon_udeg")).alias("lon_udeg"), (-F.col("lat_udeg")).alias("lat_udeg")
    )
    return raster.pixel_coords(shifted, 360, 180, clip=True)


@query
def pixel_grid(spark, sf):
    return regions(spark, sf).pixel_grid()


@query
def pixel_grid_grouped(spark, sf):
    return regions(spark, sf).pixel_grid_grouped()


@query
def cluster_colors(spark, sf):
    return raster.cluster_colors(regions(spark, sf).clustering.centroid_table(), K)


@query
def super_colors(spark, sf):
    return raster.super_colors(regions(spark, sf).super_clusters)


@query
def cluster_markers(spark, sf):
    return regions(spark, sf).markers(with_numbers=True)


@query
def cluster_markers_grouped(spark, sf):
    return regions(spark, sf).markers_grouped(with_numbers=True)


@query
def legend(spark, sf):
    return raster.legend(regions(spark, sf).main_categories, K)


@query
def super_legend(spark, sf):
    return raster.super_legend(regions(spark, sf).super_clusters)


@query
def region_captions(spark, sf):
    lines = text.run_caption(["red", "economy"], K, 3, 0.01)
    return regions(spark, sf).summary.select(
        "cluster", text.centroid_text(F.col("lon"), F.col("lat")).alias("centroid"),
        lines[0].alias("words"), lines[1].alias("settings"),
    )


# --- text layouts, written and read back --------------------------------------


@query
def revisions_round_trip(spark, sf):
    """Raw revisions as bzip2 stanzas, then read, cleaned and given an address."""
    path = scratch(spark, "stanzas")
    stanzas(fx.raw_revisions(spark, sf)).write.text(path, compression="bzip2")
    return clean.with_long_ip(clean.clean_revisions(read_revisions(spark, path)))


@query
def revisions_crlf_round_trip(spark, sf):
    """The same with carriage returns, and a space in the blank lines."""
    path = scratch(spark, "stanzas")
    ended = F.replace("value", F.lit("\n"), F.lit("\r\n"))
    blank = F.lit(" \r")
    stanzas(fx.raw_revisions(spark, sf)).select(F.concat(ended, blank)).write.text(path)
    return clean.with_long_ip(clean.clean_revisions(read_revisions(spark, path)))


def stanzas(raw: DataFrame) -> DataFrame:
    revision = F.concat_ws(
        " ", F.lit("REVISION"), "article_id", "rev_id", "article_title",
        F.date_format("edit_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "user_id", "user_id",
    )
    lines = [
        revision,
        F.concat(F.lit("CATEGORY "), F.col("categories")),
        F.lit("IMAGE"),
        F.concat(F.lit("MINOR "), F.col("minor")),
        F.concat(F.lit("TEXTDATA "), F.col("textdata").cast("string")),
        F.lit(""),
    ]
    return raw.select(F.concat_ws("\n", *lines).alias("value"))


@query
def edits_round_trip(spark, sf):
    path = scratch(spark, "edits")
    write_edits(routable(spark, sf), path)
    return read_edits(spark, path)


@query
def edits_with_class_round_trip(spark, sf):
    tagged = locate.resolve_locations(routable(spark, sf), fx.locations(spark, sf))
    path = scratch(spark, "edits-class")
    lines = edit_lines(tagged, "class_ip")
    lines.select(F.concat_ws("|", "line", F.col("class_ip").cast("string"))).write.text(path)
    return read_edits_with_class(spark, path)


@query
def edits_with_location_round_trip(spark, sf):
    columns = ["country_code", "country_name", "region_name", "city_name", "lat_udeg", "lon_udeg"]
    resolved = locate.resolve_locations(
        routable(spark, sf), fx.locations(spark, sf), attach=columns
    )
    exploded = cat.explode_categories(resolved, lower=False)
    nothing = F.lit("")
    cells = [
        F.col("article_id"), F.col("rev_id"), F.col("article_title"), nothing, F.col("user_id"),
        F.col("category"), nothing, F.col("textdata").cast("string"),
        F.col("long_ip").cast("string"), *[F.col(c) for c in columns[:4]],
        pt.degrees(F.col("lat_udeg")).cast("string"), pt.degrees(F.col("lon_udeg")).cast("string"),
    ]
    path = scratch(spark, "edits-location")
    exploded.select(F.concat_ws("|", *cells)).write.text(path)
    return read_edits_with_location(spark, path)


@query
def locations_round_trip(spark, sf):
    path = scratch(spark, "locations")
    fx.locations(spark, sf).select(
        "ip_from", (F.col("ip_from") + 9).alias("ip_to"), "country_code", "country_name",
        "region_name", "city_name",
        pt.degrees(F.col("lat_udeg")).alias("lat"), pt.degrees(F.col("lon_udeg")).alias("lon"),
        F.lit("00000").alias("zip"),
    ).write.csv(path, quoteAll=True, compression="bzip2")
    return read_locations(spark, path)


@query
def category_index_round_trip(spark, sf):
    path = scratch(spark, "index")
    write_category_index(index(spark, sf), path)
    return read_category_ips(spark, f"{path}/part-*")


@query
def class_ips_round_trip(spark, sf):
    """Every occurrence in the index, without its category."""
    path = scratch(spark, "index")
    write_category_index(index(spark, sf), path)
    return read_class_ips(spark, path).groupBy("class_ip").agg(F.count("*").alias("n"))


@query
def streamed_edits(spark, sf):
    """Stanza files as a stream into a table."""
    source, target = scratch(spark, "arriving"), scratch(spark, "streamed")
    stanzas(fx.raw_revisions(spark, sf)).write.text(source)
    stream = stream_edits(spark, source, target, scratch(spark, "stream-state"))
    stream.awaitTermination()
    return spark.read.parquet(target)


@query
def edit_line_text(spark, sf):
    return edit_lines(routable(spark, sf))
