"""Small tables for the operators on texts."""

import pytest


@pytest.fixture
def docs(spark):
    """Documents with clashing extra columns; ids from 0 unless pairs are given."""

    def build(*texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        schema = "doc_id long, text string, lang string, n_chars long, spans int, component_id int, starts int, fp int"
        return spark.createDataFrame([(i, t, None, len(t or ""), 1, 2, 3, 4) for i, t in pairs], schema)

    return build
