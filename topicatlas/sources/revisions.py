"""Revision stanzas: blocks of ``KEYWORD value`` lines ended by a blank line."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicatlas.schemas import REVISION_COLUMNS, STANZA_FIELDS

# A record is read from one REVISION line to the next: whatever the blank lines look
# like (with carriage returns, with spaces), no record holds more than one revision.
FIRST_WORD = "REVISION"
RECORD_END = f"\n{FIRST_WORD} "
WHITESPACE = " \t\r\n\f\x0b"


def _line_value(stanza: Column, keyword: str) -> Column:
    """Value of the last line starting with ``keyword``; null when there is none.

    Plain substring searches, so a keyword that is not selected costs nothing
    and none needs a regular expression or an array of lines.
    """
    lines = F.concat(F.lit("\n"), stanza)
    marker = f"\n{keyword} "
    tail = F.substring_index(F.substring_index(lines, marker, -1), "\n", 1)
    return F.when(F.contains(lines, F.lit(marker)), F.rtrim(tail, F.lit(WHITESPACE)))


def read_stanzas(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row ``stanza`` per record; bzip2 files are split like plain ones."""
    return split_stanzas(spark.read.text(path, lineSep=RECORD_END))


def split_stanzas(blocks: DataFrame) -> DataFrame:
    """Rows ``stanza`` from records read up to ``RECORD_END``, which lack the word it took.

    Only what stands before the first REVISION line of a file can begin with a keyword,
    a word in capitals; the others begin with the number of an article.  A record with blank lines inside is several stanzas.
    """
    value = F.col("value")
    known = F.rlike(value, F.lit("^[A-Z_]+ "))
    whole = F.when(known, value).otherwise(F.concat(F.lit(f"{FIRST_WORD} "), value))
    suspect = F.lit(False)
    for blank in "\n \t\r":
        suspect = suspect | F.contains(value, F.lit(f"\n{blank}"))
    # Few records have such a line, so few pay for the regular expression.
    parts = F.when(suspect, F.split(whole, r"\n[ \t\r]*(?=\n)")).otherwise(F.array(whole))
    filled = blocks.filter(F.trim("value", F.lit(WHITESPACE)) != "")
    stanzas = filled.select(F.explode(parts).alias("stanza"))
    return stanzas.filter(F.trim("stanza", F.lit(WHITESPACE)) != "")


def _revision_values(stanza: Column) -> Column:
    return F.split(_line_value(stanza, "REVISION"), " ")


def well_formed(stanza: Column) -> Column:
    """The REVISION line is there and carries exactly its six values."""
    return F.coalesce(F.size(_revision_values(stanza)) == len(REVISION_COLUMNS), F.lit(False))


def parse_revisions(stanzas: DataFrame) -> DataFrame:
    """``stanza`` rows to ``RAW_REVISION`` columns; works on streams as well."""
    # An exploded array of one: filters on the values, which would each split the line
    # anew when they are pushed down, stay above it.
    split = stanzas.select("stanza", F.explode(F.array(_revision_values(F.col("stanza")))).alias("_values"))
    values = F.col("_values")
    complete = F.coalesce(F.size(values) == len(REVISION_COLUMNS), F.lit(False))
    return split.filter(complete).select(
        *[F.get(values, F.lit(i)).alias(name) for i, name in enumerate(REVISION_COLUMNS)],
        *[_line_value(F.col("stanza"), word).alias(name) for word, name in STANZA_FIELDS.items()],
    )


def read_revisions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_revisions(read_stanzas(spark, path))


def malformed_revisions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records without a usable REVISION line."""
    return read_stanzas(spark, path).filter(~well_formed(F.col("stanza")))
