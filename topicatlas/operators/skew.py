"""Joins and lists that stay balanced when one key holds a large share of the rows.

In joins every key above ``rows_per_task`` rows is split, so whatever the data, no task
gets more rows of a key; such keys are so few that their list can be broadcast.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicatlas.operators.lineage import cut_lineage

ROWS_PER_TASK = 8_000_000
#: Buckets that keys are counted by before any is counted by itself.
KEY_BUCKETS = 1 << 20
# Three million ranges, cut at bucket borders, with their coordinates take 360 MB.
BROADCAST_BYTES = 400_000_000
ROW_OVERHEAD = 32
#: Items of a list between two cuts, on average.
LIST_LENGTH = 100_000
#: Odd numbers that spread what they multiply over 32 bits.
SPREAD, SPREAD_PIECE = 1_640_531_527, 1_013_904_223


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)``, with neither side passing through the driver.

    For tables that grow with the input.  Spark takes a table to be as small after an
    explode as before it, and a written one as small as its compressed files, so it may
    broadcast what the driver cannot hold, at a size at which it still takes it for small.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def row_bytes(rows: int, columns: int) -> int:
    """Memory of rows of numbers as a broadcast."""
    return rows * (ROW_OVERHEAD + 8 * columns)


def table_bytes(df: DataFrame, rows: int | None = None) -> int:
    """Memory a table takes as a broadcast: measured, or from a known bound on its rows.

    Text is always measured, since no bound on rows bounds it.
    """
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if rows is None or texts:
        lengths = [F.coalesce(F.sum(F.octet_length(name)), F.lit(0)) for name in texts]
        rows, *text_bytes = df.agg(F.count("*"), *lengths).first()
    else:
        text_bytes = []
    return row_bytes(rows, len(df.columns)) + sum(text_bytes)


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """``keys, _splits`` of every key of more than ``rows_per_task`` rows; None if there is none.

    There are at most as many as ``rows_per_task`` goes into the rows of the table, which
    bounds what is broadcast; they stay in a written table and do not pass the driver.
    Counts are combined before the shuffle, and keys are first counted by ``KEY_BUCKETS``
    hash buckets: only those of a bucket above the bound are counted one by one, so a
    table of very many light keys shuffles a row per bucket and task.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int")
    slim = df.select(*keys, bucket.alias("_bucket"))
    heavy = slim.groupBy("_bucket").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > rows_per_task)
    heavy = cut_lineage(heavy.select("_bucket"), "heavy-buckets")
    # At most KEY_BUCKETS numbers.
    if heavy.isEmpty():
        return None
    counted = slim.join(F.broadcast(heavy), "_bucket", "left_semi").groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = cut_lineage(
        counted.filter(F.col("_rows") > rows_per_task).select(
            *keys, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_splits")
        ),
        "hot-keys",
    )
    return None if hot.isEmpty() else hot


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def with_salt(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``_splits`` (1 for ordinary keys) and a ``_salt`` below it.

    The salt is a hash of the row and its partition number, never a random number: a recomputed task sends each row to the same
    place, and equal rows of different partitions are spread.
    """
    marked = df.join(F.broadcast(hot), _same(df, hot, keys), "left").select(
        *[df[name] for name in df.columns], F.coalesce(hot["_splits"], F.lit(1)).alias("_splits")
    )
    hashed = F.xxhash64(F.spark_partition_id(), *df.columns)
    spread = F.pmod(hashed, F.col("_splits")).cast("int")
    return marked.withColumn("_salt", spread)


def balanced_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    within: Column | None = None,
    lookup_rows: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
    lookup_bytes: int | None = None,
) -> DataFrame:
    """Join on ``keys`` (and the condition ``within``) against a lookup table.

    A lookup of at most ``broadcast_bytes`` is broadcast; it is measured unless the
    caller knows its ``lookup_bytes``, or a bound on its rows, ``lookup_rows``, and it
    holds no text.  A
    larger one is shuffled; rows of hot keys are then spread over several tasks
    and their lookup rows repeated once for each.  Key columns of the lookup are
    dropped from the result.
    """
    payload = [name for name in lookup.columns if name not in keys]
    slim = lookup.select(*[F.col(key).alias(f"_key_{key}") for key in keys], *payload)
    condition = F.lit(True) if within is None else within
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"_key_{key}"))
    dropped = [f"_key_{key}" for key in keys]

    if (table_bytes(slim, lookup_rows) if lookup_bytes is None else lookup_bytes) <= broadcast_bytes:
        return facts.join(F.broadcast(slim), condition, how).drop(*dropped)

    hot = hot_keys(facts, keys, rows_per_task)
    if hot is None:
        return facts.join(slim, condition, how).drop(*dropped)

    salted = with_salt(facts, hot, keys)
    splits = hot.select(*[F.col(key).alias(f"_hot_{key}") for key in keys], "_splits")
    is_hot = F.lit(True)
    for key in keys:
        is_hot = is_hot & (F.col(f"_key_{key}") == F.col(f"_hot_{key}"))
    repeated = (
        slim.join(F.broadcast(splits), is_hot, "left")
        .withColumn(
            "_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))
        )
        .drop("_splits", *[f"_hot_{key}" for key in keys])
    )
    joined = salted.join(repeated, condition & (F.col("_salt") == F.col("_copy")), how)
    return joined.drop("_splits", "_salt", "_copy", *dropped)


def content_border(
    number: Column, piece: Column, copies: Column, length: int = LIST_LENGTH
) -> Column:
    """Whether a list is cut before an item, once in ``length`` copies on average.

    Its number, the piece of its copies and how many these are say so alone.  Products
    with odd numbers near 0.382 and 0.236 of 2**32 spread neighbours evenly over 32 bits.
    """
    low = [F.pmod(column, F.lit(1 << 32)) for column in (number, piece)]
    spread = F.pmod(low[0] * F.lit(SPREAD) + low[1] * F.lit(SPREAD_PIECE), F.lit(1 << 32))
    return spread < copies.cast("bigint") * F.lit((1 << 32) // length)


def content_border_of_text(text: Column, length: int = LIST_LENGTH) -> Column:
    """The same of a text, by its MD5 in hexadecimal digits."""
    return F.md5(text) < F.lit(f"{(1 << 32) // length:08x}" if length > 1 else "g")


def parted_lists(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, border: Column
) -> DataFrame:
    """``keys, part, items``: lists per key in ``order``, cut before each item that is a ``border``.

    ``part`` counts the borders up to an item.  Where a list is cut follows from its
    items alone, so the lists are the same whatever the number of rows, keys or tasks.
    A key's items, which ``order`` tells apart, may lie in any number of tasks: rows are
    dealt by ranges of key and order, borders are counted inside a task, and what the
    tasks before it counted is carried in, a row per key and task.
    """
    rows = df.select(*keys, *order, item.alias("_item"), border.cast("bigint").alias("_border"))
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_task", F.spark_partition_id())
    # Written, so that a lost task cannot deal the rows anew.
    ranged = cut_lineage(ranged, "ranged")
    within = W.partitionBy(*keys, "_task")
    counted = ranged.groupBy(*keys, "_task").agg(F.sum("_border").alias("_borders"))
    earlier = W.partitionBy(*keys).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    carried = counted.select(
        *[F.col(key).alias(f"_key_{key}") for key in keys], F.col("_task").alias("_in"),
        F.coalesce(F.sum("_borders").over(earlier), F.lit(0)).alias("_carried"),
    )
    inside = ranged.withColumn("_inside", F.sum("_border").over(within.orderBy(*order)))
    here = F.col("_task") == F.col("_in")
    for key in keys:
        here = here & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    numbered = inside.join(carried, here).select(
        *keys, (F.col("_inside") + F.col("_carried")).alias("part"),
        F.struct(*order, "_item").alias("_item"),
    )
    items = F.transform(F.sort_array(F.collect_list("_item")), lambda entry: entry["_item"])
    return numbered.groupBy(*keys, "part").agg(items.alias("items"))
