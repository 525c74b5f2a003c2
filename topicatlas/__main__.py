"""Command line: ``spark-submit … -m topicatlas`` or ``python -m topicatlas``."""

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from topicatlas.operators.clean import clean_revisions, ip_status
from topicatlas.operators.lineage import cut_lineage
from topicatlas.operators.points import category_points
from topicatlas.plans import build_index, find_regions, prepare_locations
from topicatlas.sinks import output_name, write_category_index
from topicatlas.sources import read_category_ips, read_edits, read_revisions


def words(text: str) -> list[str]:
    return [word for word in text.split(",") if word]


def parser() -> argparse.ArgumentParser:
    options = argparse.ArgumentParser(prog="topicatlas", description=__doc__)
    add = options.add_argument
    add("-a", "--associate-location", action="store_true", help="build the category index first")
    add("--edits", help="cleaned edit files; these or --revisions are needed with -a")
    add("--revisions", help="the revision log itself, cleaned on the way")
    add("--locations", required=True, help="address ranges with coordinates")
    add("--index", required=True, help="category index folder, written with -a")
    add("--output", required=True, help="folder for the run's own folder")
    add("-w", "--words", type=words, default=[], help="comma-separated required words")
    add("-n", "--no-words", type=words, default=[], help="comma-separated excluded words")
    add("-k", "--k", type=int, required=True, help="number of clusters")
    add("-i", "--iterations", type=int, default=0, help="number of updates; 0: until epsilon")
    add("-e", "--epsilon", type=float, default=0.01, help="movement below which to stop")
    add("-p", "--print-numbers", action="store_true", help="numbers in the marker labels")
    add("--match", choices=("any", "all"), default="any", help="how many required words must be there")
    add("--literal", action="store_true", help="the literal rules for categories and words")
    add("--check-upper", action="store_true", help="no class above the end of a range (with -a)")
    add("--clip", action="store_true", help="points on the far edges stay on the map")
    add("--resume", help="folder that keeps the updates; a run that was lost goes on from there")
    add("--seed", type=int, default=0, help="seed of the first centroids")
    return options


def edits_and_rejects(spark: SparkSession, options: argparse.Namespace) -> tuple[DataFrame, DataFrame | None]:
    """Edits with their address, and counts of those left out if the log itself is read (once)."""
    if options.edits:
        return read_edits(spark, options.edits), None
    if not options.revisions:
        raise SystemExit("-a needs --edits or --revisions")
    cleaned = clean_revisions(read_revisions(spark, options.revisions), anonymous_only=False)
    checked = cut_lineage(ip_status(cleaned).select("categories", "long_ip", "ip_status"), "edits")
    rejects = checked.filter("ip_status != 'ok'").groupBy(F.col("ip_status").alias("reason"))
    return checked.filter("ip_status = 'ok'"), rejects.agg(F.count("*").alias("n"))


def main(arguments: list[str] | None = None) -> str:
    options = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("topicatlas").getOrCreate()
    # What a run leaves out, by reason, is counted by the jobs that leave it out.
    audits = {reason: Observation() for reason in ("unusable_range", "without_class", "without_place")}
    rejects = None
    locations = prepare_locations(spark, options.locations, audits["unusable_range"])
    if options.associate_location:
        edits, rejects = edits_and_rejects(spark, options)
        index = build_index(edits, locations, check_upper=options.check_upper, literal=options.literal)
        without = F.coalesce(F.sum(F.when(F.col("class_ip").isNull(), F.col("n"))), F.lit(0))
        index = cut_lineage(index.observe(audits["without_class"], without.alias("without_class")), "index")
        write_category_index(index.filter("class_ip IS NOT NULL"), options.index)
    else:
        del audits["without_class"]
    counts = read_category_ips(spark, options.index)
    regions = find_regions(
        category_points(counts, locations, audits["without_place"]),
        options.k,
        include=options.words,
        exclude=options.no_words,
        match=options.match,
        literal=options.literal,
        iterations=options.iterations,
        epsilon=options.epsilon,
        seed=options.seed,
        folder=options.resume,
    )
    left_out = spark.createDataFrame([(reason, audits[reason].get[reason]) for reason in audits], "reason string, n long")
    name = output_name(
        options.words, options.no_words, options.k, options.iterations, options.epsilon
    )
    folder = f"{options.output}/{name}"
    regions.write_reports(folder)
    tables = {
        "pixels": regions.pixel_grid(clip=options.clip),
        "pixels-grouped": regions.pixel_grid_grouped(clip=options.clip),
        "markers": regions.markers(options.print_numbers),
        "markers-grouped": regions.markers_grouped(options.print_numbers),
        "legend": regions.legend,
        "legend-grouped": regions.super_legend,
        "captions": regions.captions(options.words, options.iterations, options.epsilon),
        "iterations": regions.clustering.iteration_log(),
        "audit": left_out.unionByName(rejects) if rejects else left_out,
    }
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}")
    return folder


if __name__ == "__main__":
    main()
