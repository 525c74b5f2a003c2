"""Headline operators on the tables of $BENCH_SF_DIR; prints one JSON line.

The inputs in the engine's layouts are derived and stored first and not timed
(``end_to_end`` starts from the given tables instead).  Every query runs once to
warm up and twice for the better time; results go to the no-op sink.
"""

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import queries as registry
from checks.compare import session
from topicatlas.operators import categories as cat
from topicatlas.operators import clean, kmeans as km, locate, profile, raster
from topicatlas.operators import points as cp
from topicatlas.operators.lineage import cut_lineage
from topicatlas.operators.ranges import index_ranges
from topicatlas.plans import build_coded_index, build_index, find_regions, locate_categories
from topicatlas.sources import read_revisions

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
ITERATIONS = 10


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(run: Callable[[], None]) -> float:
    run()
    times = []
    for _ in range(2):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def main() -> None:
    spark = session(CORES)

    def stored(df, name):
        # The given tables are one file each; the operators get one per core.
        return cut_lineage(df.repartition(int(CORES)), name)

    raw = stored(fx.raw_revisions(spark, SF_DIR), "raw")
    edits = stored(clean.with_long_ip(clean.clean_revisions(raw)), "edits")
    locations = stored(fx.locations(spark, SF_DIR), "locations")
    prepared = stored(locate.prepare_ranges(locations), "ranges")
    ranges = index_ranges(prepared)
    crowded = index_ranges(registry._crowded_ranges(spark, SF_DIR))
    dense = stored(edits.select("rev_id", F.expr(registry.DENSE_ADDRESS).alias("long_ip")), "dense")
    index = stored(build_index(edits, ranges), "index")
    coded, dictionary = build_coded_index(edits, ranges)
    located = stored(locate_categories(edits, ranges), "located")
    occurrences = stored(
        locate.resolve_locations(edits, ranges, attach=["lon_udeg", "lat_udeg"])
        .selectExpr("lon_udeg", "lat_udeg", "1L AS n", "categories")
        .transform(cat.explode_categories),
        "occurrences",
    )
    stanzas = registry.scratch(spark, "stanzas")
    registry.stanzas(raw).write.text(stanzas, compression="bzip2")
    points = stored(cp.weighted_points(located), "points")
    regions = find_regions(located, 15, iterations=3)
    seeds = km.initial_centroids(points, 15)

    cases = {
        "parse_and_clean_stanzas": lambda: drain(
            clean.with_long_ip(clean.clean_revisions(read_revisions(spark, stanzas)))
        ),
        "clean_edits": lambda: drain(clean.with_long_ip(clean.clean_revisions(raw))),
        "prepare_ranges": lambda: drain(locate.prepare_ranges(locations)),
        "index_ranges": lambda: index_ranges(prepared),
        "resolve_cells": lambda: drain(locate.resolve_locations(edits, ranges)),
        "resolve_cells_dense": lambda: drain(locate.resolve_locations(dense, crowded)),
        "resolve_bucketed": lambda: drain(locate.resolve_locations(edits, prepared, "bucketed")),
        "resolve_shuffled": lambda: drain(
            locate.resolve_locations(edits, ranges, broadcast_bytes=0)
        ),
        "resolve_window": lambda: drain(locate.resolve_locations(edits, ranges, "window")),
        "category_index": lambda: drain(build_index(edits, ranges)),
        "coded_index": lambda: drain(coded),
        "filter_by_dictionary": lambda: drain(dictionary.filter(coded, ["red", "parts"], ["bolt"])),
        "category_index_lines": lambda: drain(cat.category_lines(index)),
        "category_points": lambda: drain(cp.category_points(index, ranges)),
        "located_categories": lambda: drain(locate_categories(edits, ranges)),
        "weighted_points": lambda: drain(cp.weighted_points(located)),
        "nearest_expression": lambda: drain(km.nearest(occurrences, seeds, "expression")),
        "nearest_arrow": lambda: drain(km.nearest(occurrences, seeds, "arrow")),
        "kmeans_10_weighted": lambda: km.kmeans(points, 15, ITERATIONS, stored=True),
        "kmeans_10_occurrences": lambda: km.kmeans(
            occurrences, 15, ITERATIONS, given=seeds, stored=True
        ),
        "kmeans_3_of_100_arrow": lambda: km.kmeans(points, 100, 3, method="arrow", stored=True),
        "kmeans_3_of_100_pruned": lambda: km.kmeans(points, 100, 3, method="pruned", stored=True),
        "cluster_categories": lambda: drain(profile.cluster_categories(located, regions.centroids)),
        "main_category": lambda: drain(profile.main_category(regions.categories)),
        "pixel_grid": lambda: drain(raster.pixel_grid(regions.assignment)),
        "end_to_end": lambda: drain(
            find_regions(registry.located(spark, SF_DIR), 15, iterations=ITERATIONS).summary
        ),
    }
    timings = {name: seconds(run) for name, run in cases.items()}
    counts = {"edits": edits.count(), "occurrences": occurrences.count(), "points": points.count()}
    pruned = km.kmeans(points, 100, 3, method="pruned", stored=True).distances
    rates = {
        "edits_resolved_per_second": round(counts["edits"] / timings["resolve_cells"]),
        "edits_indexed_per_second": round(counts["edits"] / timings["category_index"]),
        "distances_of_100_pruned_to": round(pruned / (3 * 100 * counts["points"]), 4),
        "seconds_per_weighted_iteration": round(timings["kmeans_10_weighted"] / ITERATIONS, 3),
        "seconds_per_plain_iteration": round(timings["kmeans_10_occurrences"] / ITERATIONS, 3),
    }
    print(
        json.dumps(
            {
                "metric": "total of the headline operators",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "rates": rates,
                "rows": counts,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cores": int(CORES),
            }
        )
    )


if __name__ == "__main__":
    main()
