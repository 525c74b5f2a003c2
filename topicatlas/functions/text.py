"""Category tokens, labels and captions."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters deleted from a category before it is cut into words.
DELETED_CHARACTERS = "-+.^:,"


def category_tokens(category: Column) -> Column:
    """Words of a category: punctuation deleted, then split on underscores."""
    return F.split(F.translate(category, DELETED_CHARACTERS, ""), "_")


def reverse_distinct(values: Column) -> Column:
    """Distinct items of an array, the last first-seen item in front."""
    return F.reverse(F.array_distinct(values))


def cluster_label(cluster: Column, n: Column, with_numbers: bool = False) -> Column:
    """``(3)`` or ``(3) 1,234``."""
    index = F.concat(F.lit("("), cluster.cast("string"), F.lit(")"))
    return F.concat(index, F.lit(" "), F.format_number(n, 0)) if with_numbers else index


def spaced(category: Column) -> Column:
    return F.translate(category, "_", " ")


def legend_label(cluster: Column, category: Column, n: Column) -> Column:
    """``(3) category with spaces 1234``."""
    return F.concat(
        cluster_label(cluster, n), F.lit(" "), spaced(category), F.lit(" "), n.cast("string")
    )


def centroid_text(lon: Column, lat: Column) -> Column:
    return F.format_string("%3f,%3f", lon, lat)


def run_caption(words: Sequence[str], k: int, iterations: int, epsilon: float) -> list[Column]:
    """The two caption lines of a run: filter words, then k, iterations and epsilon."""
    return [
        F.concat(F.lit("Filter words: "), F.lit(" ".join(words))),
        F.format_string(
            "k: %d,  \tit: %d,  \teps: %.5f", F.lit(k), F.lit(iterations), F.lit(float(epsilon))
        ),
    ]


def total_caption(total: Column) -> Column:
    return F.concat(F.lit("Tot. points: "), total.cast("string"))
