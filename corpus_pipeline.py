"""The corpus pipeline: five stages from the table of documents to packed sequences.

Each stage gets all its predecessor kept and returns a DataFrame; all but the last
return the columns of documents.  A document is rejected, or its text changed, by
the decisions of the stage's operator alone.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicatlas.llm import packing, recompression, secrets, simhash, toxicity
from topicatlas.operators.lineage import cut_lineage


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` in the columns of ``docs``, the count of characters renewed."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.char_length("text").cast(kind))
    return changed.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_documents(docs, toxicity.fitted(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that of the least id."""
    return simhash.first_documents(docs, shingle=4, distance=4)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that occur elsewhere go, in every place."""
    return _with_text(docs, recompression.remove_repeats(docs, window=35))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask."""
    return _with_text(docs, secrets.mask_secrets(docs, secrets.fitted(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is cut into pieces and packed into sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", remove_repeats),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: SQL cannot fit the models or split tokens; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
