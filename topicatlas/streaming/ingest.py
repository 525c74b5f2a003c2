"""Revision files as a stream.

Parsing and cleaning keep no state, so the batch functions apply unchanged and
each file is handled exactly once.
"""

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from topicatlas.operators.clean import clean_revisions, with_long_ip
from topicatlas.sources.revisions import RECORD_END, parse_revisions, split_stanzas


def stream_edits(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Appends the edits of new files below ``source`` to the Parquet table ``target``.

    Handles what is there and stops, unless another ``trigger`` is given.
    """
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    blocks = files.text(source, lineSep=RECORD_END)
    edits = with_long_ip(clean_revisions(parse_revisions(split_stanzas(blocks))))
    return (
        edits.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
