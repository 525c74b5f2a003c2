"""Categories: one row each, counted, filtered by words, and written as lines."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicatlas.functions.text import category_tokens
from topicatlas.operators.skew import LIST_LENGTH, content_border, parted_lists

#: Copies of one address that stay together in a list.
COPIES = 1_000


def explode_categories(edits: DataFrame, literal: bool = False, lower: bool = True) -> DataFrame:
    """One row per entry of the space-separated ``categories``, repeats kept.

    ``literal`` also keeps the empty entries that leading and double spaces make.
    """
    others = [name for name in edits.columns if name != "categories"]
    text = F.rtrim(F.lower("categories") if lower else F.col("categories"))
    rows = edits.select(*others, F.explode(F.split(text, " ")).alias("category"))
    return rows if literal else rows.filter(F.col("category") != "")


def category_column(df: DataFrame) -> str:
    return "category_id" if "category_id" in df.columns else "category"


def _occurrences(df: DataFrame):
    return F.sum("n") if "n" in df.columns else F.count("*")


def category_ips(exploded: DataFrame) -> DataFrame:
    """``category, class_ip, n``: how often each class address edits a category.

    Categories may be numbered: ``category_id`` then takes the place of ``category``.
    """
    return exploded.groupBy(category_column(exploded), "class_ip").agg(_occurrences(exploded).alias("n"))


def category_frequency(exploded: DataFrame) -> DataFrame:
    """``category, n``, rarest first."""
    key = category_column(exploded)
    return exploded.groupBy(key).agg(_occurrences(exploded).alias("n")).orderBy("n", key)


def category_lists(counts: DataFrame, length: int = LIST_LENGTH) -> DataFrame:
    """``category, part, ips``: class addresses as often as counted, in order.

    The copies of an address are dealt out in pieces of ``COPIES``.  A list is cut
    before a piece whose address and number say so, about once in ``length`` copies;
    ``part`` counts the cuts.  Whatever else there is, a category has the same lists.
    """
    copies = min(COPIES, length)
    pieces = counts.select(
        "category", "class_ip", "n",
        F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {copies}"))).alias("piece"),
    ).withColumn("copies", F.least(F.lit(copies), F.col("n") - F.col("piece") * copies).cast("int"))
    lists = parted_lists(
        pieces,
        ["category"],
        order=["class_ip", "piece"],
        item=F.struct("class_ip", "copies"),
        border=content_border(F.col("class_ip"), F.col("piece"), F.col("copies"), length),
    )
    ips = F.flatten(
        F.transform("items", lambda item: F.array_repeat(item["class_ip"], item["copies"]))
    )
    return lists.select("category", "part", ips.alias("ips"))


def category_lines(
    counts: DataFrame, separator: str = "#", length: int = LIST_LENGTH
) -> DataFrame:
    """``category, part, line`` with lines like ``category#ip|ip|ip``."""
    lists = category_lists(counts.filter(F.col("class_ip").isNotNull()), length)
    joined = F.concat_ws("|", F.col("ips").cast("array<string>"))
    line = F.concat(F.col("category"), F.lit(separator), joined)
    return lists.select("category", "part", line.alias("line"))


def filter_categories(
    df: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    match: str = "any",
    literal: bool = False,
    tokens: Column | None = None,
) -> DataFrame:
    """Rows whose ``category`` has the wanted words and none of the unwanted.

    Words are compared with whole category words.  ``match`` asks for any or all
    of ``include``.  ``literal`` keeps a row if *some* excluded word is missing
    (so an empty list drops every row), ignores ``exclude`` when there is no
    ``include``, and does not lower-case the words.  ``tokens`` are the words of the category
    where these are at hand.
    """
    if match not in ("any", "all"):
        raise ValueError(f"match must be 'any' or 'all', not {match!r}")
    tokens = category_tokens(F.col("category")) if tokens is None else tokens
    if literal:
        if not include:
            return df
        wanted = _words(include)
        df = df.filter(F.arrays_overlap(tokens, wanted))
        if not exclude:
            return df.filter(F.lit(False))
        return df.filter(F.size(F.array_except(_words(exclude), tokens)) > 0)

    if include:
        wanted = _words([word.lower() for word in include])
        if match == "any":
            df = df.filter(F.arrays_overlap(tokens, wanted))
        else:
            df = df.filter(F.size(F.array_except(wanted, tokens)) == 0)
    if exclude:
        df = df.filter(~F.arrays_overlap(tokens, _words([word.lower() for word in exclude])))
    return df


def _words(words: Sequence[str]):
    return F.array(*[F.lit(word) for word in words])
