"""What the operators on whole texts share."""

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a task turns into words at a time; a longer text is a slice of its own.
SLICE_CHARS = 2_000_000
#: A piece of an excerpt: up to a line or sentence break, or else white space, or so many characters.
PIECE = re.compile(r".{1,1000}?(?:\n|[.!?]\s|\Z)|.{1,1000}(?<=\s)|.{1,1000}", re.DOTALL)


def documents(docs: DataFrame) -> DataFrame:
    """The two columns the operators use; a null text is an empty one.

    Other columns are left behind, so their names cannot clash with anything an
    operator adds.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text, from different seeds."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def slices(texts: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts of bounded total length, each with its first index."""
    start, taken, size = 0, [], 0
    for i, text in enumerate(texts):
        value = text.as_py() or ""
        if taken and size + len(value) > chars:
            yield start, taken
            start, taken, size = i, [], 0
        taken.append(value)
        size += len(value)
    if taken:
        yield start, taken


def excerpt(text: str, chars: int, wanted: Callable[[str], bool] = lambda piece: False) -> str:
    """The text, or of one over ``chars`` characters as many in whole pieces from all over it.

    Pieces are dealt by a hash and stay in order; those that are ``wanted`` come first,
    up to half of the characters.
    """
    if len(text) <= chars:
        return text
    parts = PIECE.findall(text)
    dealt = sorted(range(len(parts)), key=lambda i: (xxhash.xxh3_64_intdigest(parts[i].encode("utf-8", "surrogatepass"), i), i))
    use, size = set(), 0
    for order, room in (([i for i in dealt if wanted(parts[i])], chars // 2), (dealt, chars)):
        for i in order:
            if i not in use and size + len(parts[i]) + 1 <= room:
                use.add(i)
                size += len(parts[i]) + 1
    # A line break parts what was apart in the text.
    return "".join(parts[i] if i + 1 in use else parts[i].rstrip("\n") + "\n" for i in sorted(use))


def excerpts(rows: DataFrame, chars: int, wanted: Callable[[str], bool] = lambda piece: False) -> DataFrame:
    """``rows`` with ``text`` cut down to its excerpt, in the tasks."""

    def run(batches):
        for batch in batches:
            texts = pa.array([excerpt(t.as_py(), chars, wanted) for t in batch.column("text")], pa.string())
            arrays = [texts if c == "text" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def per_document(
    function: Callable[[list[str]], dict[str, pa.Array | list]], schema: pa.Schema, chars: int = SLICE_CHARS
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over batches of ``doc_id, text``: each text becomes one row.

    ``function`` gets a bounded list of texts and returns a column per field of
    ``schema`` after the leading ``doc_id``.
    """

    def task(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for start, part in slices(texts, chars):
                columns = function(part)
                arrays = [ids.slice(start, len(part))]
                for field in itertools.islice(schema, 1, None):
                    arrays.append(_array(columns[field.name], field.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return task


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)
