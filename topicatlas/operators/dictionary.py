"""Categories by number: one table of names and words, counts that carry eight bytes.

The number of a category is a hash of its name, so rows are numbered where they are,
without a lookup; the dictionary takes the first seed under which no two names share
one.  Counts, joins and totals move numbers, word filters run on the dictionary, once
per name, and reach the rows as a semi-join, and names come back on the last, small rows.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicatlas.functions.text import category_tokens
from topicatlas.operators.categories import filter_categories
from topicatlas.operators.lineage import cut_lineage, discard
from topicatlas.operators.skew import BROADCAST_BYTES, ROWS_PER_TASK, balanced_join

ID = "category_id"


def category_number(category: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), category)


@dataclass(frozen=True)
class CategoryDictionary:
    """``category_id, category, tokens``, a row per category, as a written table of ``n`` rows."""

    names: DataFrame
    seed: int
    n: int

    def code(self, df: DataFrame) -> DataFrame:
        """``category_id`` in place of ``category``."""
        others = [name for name in df.columns if name != "category"]
        return df.select(category_number(F.col("category"), self.seed).alias(ID), *others)

    def name(self, df: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """``category`` in place of ``category_id``."""
        named = balanced_join(df, self.names.select(ID, "category"), [ID], broadcast_bytes=broadcast_bytes)
        return named.select("category", *[c for c in df.columns if c != ID])

    def wanted(
        self, include: Sequence[str] = (), exclude: Sequence[str] = (), match: str = "any", literal: bool = False
    ) -> DataFrame:
        """The numbers of the categories that :func:`filter_categories` keeps."""
        return filter_categories(self.names, include, exclude, match, literal, tokens=F.col("tokens")).select(ID)

    def filter(
        self,
        df: DataFrame,
        include: Sequence[str] = (),
        exclude: Sequence[str] = (),
        match: str = "any",
        literal: bool = False,
        broadcast_bytes: int = BROADCAST_BYTES,
        rows_per_task: int = ROWS_PER_TASK,
    ) -> DataFrame:
        """The rows of numbered ``df`` whose category has the wanted words and none of the unwanted.

        The rows are not shuffled while all numbers of the dictionary can be broadcast.
        """
        if not include and (literal or not exclude):
            return df
        return balanced_join(
            df, self.wanted(include, exclude, match, literal), [ID], "left_semi",
            lookup_rows=self.n, broadcast_bytes=broadcast_bytes, rows_per_task=rows_per_task,
        )


def category_dictionary(categories: DataFrame, seed: int = 0) -> CategoryDictionary:
    """The dictionary of the ``category`` column of a table, null left out.

    Names are combined in the tasks, so each crosses the shuffle once per task at most.
    """
    distinct = cut_lineage(categories.select("category").dropna().distinct(), "categories")
    while True:
        numbered = distinct.select(
            category_number(F.col("category"), seed).alias(ID), "category", category_tokens(F.col("category")).alias("tokens")
        )
        n, ids = numbered.agg(F.count("*"), F.countDistinct(ID)).first()
        if n == ids:
            break
        seed += 1
    names = cut_lineage(numbered, "dictionary")
    discard(distinct)
    return CategoryDictionary(names, seed, n)
