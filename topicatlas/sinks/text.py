"""Writers for the text layouts.

Each writes one file per task, but for the table of main categories, which has at
most a line per cluster.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicatlas.operators.categories import category_lines
from topicatlas.operators.skew import LIST_LENGTH
from topicatlas.operators.profile import main_category_report, report_lines
from topicatlas.schemas import CLEAN_COLUMNS


def edit_lines(edits: DataFrame, *keep: str) -> DataFrame:
    """``line``: the six edit columns joined by pipes, and ``long_ip`` if there; ``keep`` stays."""
    names = CLEAN_COLUMNS + (["long_ip"] if "long_ip" in edits.columns else [])
    # concat_ws skips nulls, which would shift the columns behind them.
    cells = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in names]
    return edits.select(F.concat_ws("|", *cells).alias("line"), *keep)


def write_edits(
    edits: DataFrame, path: str, compression: str = "bzip2", mode: str = "errorifexists"
) -> None:
    edit_lines(edits).write.mode(mode).text(path, compression=compression)


def write_category_index(
    counts: DataFrame,
    path: str,
    separator: str = "#",
    compression: str = "bzip2",
    mode: str = "errorifexists",
    length: int = LIST_LENGTH,
) -> None:
    """``category, class_ip, n`` as lines ``category#ip|ip|ip``.

    A category holding the separator fails the write: its line could not be read
    back.  A list is cut into several lines of its category about once in ``length``
    addresses, where the addresses themselves say so.
    """
    message = F.concat(F.lit(f"category holds {separator!r}: "), F.col("category"))
    checked = counts.withColumn(
        "category",
        F.when(F.contains("category", F.lit(separator)), F.raise_error(message)).otherwise(
            F.col("category")
        ),
    )
    lines = category_lines(checked, separator, length).select("line")
    lines.write.mode(mode).text(path, compression=compression)


def write_cluster_report(
    cluster_categories: DataFrame,
    centroids: Sequence[tuple[float, float]],
    path: str,
    mode: str = "errorifexists",
) -> None:
    """Per cluster a line ``cluster,lat,lon:``, then its categories, most frequent first.

    The sort is by ranges of the whole key, so the files in name order read as
    one report even when a cluster is spread over several of them.
    """
    lines = report_lines(cluster_categories, centroids)
    order = [F.col("cluster"), F.desc_nulls_first("n"), F.asc_nulls_first("category")]
    lines.orderBy(*order).select("line").write.mode(mode).text(path)


def write_main_categories(
    main_categories: DataFrame,
    centroids: Sequence[tuple[float, float]],
    path: str,
    mode: str = "errorifexists",
) -> None:
    """``cluster,lat,lon,category,n``: at most k lines, in one file."""
    report = main_category_report(main_categories, centroids)
    report.repartition(1).sortWithinPartitions("cluster").write.mode(mode).csv(path)


def output_name(
    words: Sequence[str], no_words: Sequence[str], k: int, iterations: int, epsilon: float
) -> str:
    """Folder name of a run: ``filters-<words>[-<no words>]-<k>-<iterations>-<epsilon>``."""
    excluded = "-" + "_".join(no_words) if no_words else ""
    return f"filters-{'_'.join(words)}{excluded}-{k}-{iterations}-{epsilon}"
