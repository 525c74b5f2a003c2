import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("4")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    spark.stop()


@pytest.fixture
def rows(spark):
    """Builds a table from tuples: ``rows("a int, b string", (1, "x"))``."""
    return lambda schema, *values: spark.createDataFrame(list(values), schema)


@pytest.fixture
def lines(spark, tmp_path):
    """Writes text to a new file and returns its path."""

    def write(text: str, name: str = "input.txt") -> str:
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


def as_tuples(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted(map(tuple, chosen.collect()), key=lambda row: tuple((v is None, str(v)) for v in row))
