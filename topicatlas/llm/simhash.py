"""SimHash near-duplicates: fingerprints that differ in few bits, found by shared blocks."""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicatlas.llm.common import documents, per_document, text_hashes
from topicatlas.llm.components import components
from topicatlas.operators.lineage import cut_lineage
from topicatlas.operators.skew import merge_join

BITS = 64
#: A fingerprint is cut into so many blocks more than bits may differ, and that many agree.
SPARE_BLOCKS = 3
#: Cells of more members are linked through shared neighbours, not pair by pair.
PAIRED_CELL = 1024
#: Shingles whose bits are counted at a time.
COUNT_ROWS = 1 << 16


def fingerprint(text: str, shingle: int) -> int:
    """The 64-bit SimHash of the word shingles of a text; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    if len(words) <= shingle:
        starts, ends = [0], [len(joined)]
    else:
        starts = [0, *ends[:-shingle].tolist()]
        ends = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), COUNT_ROWS):
        part = hashes[k : k + COUNT_ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, fp, text_hash, text_check`` of each row of ``docs``; ``fp`` holds the bits as a long.

    The last two are hashes of the text from two seeds.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def task(texts: list[str]) -> dict:
        return {"fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    source = documents(docs)
    one_hash, other_hash = text_hashes(F.col("text"))
    with_hash = source.withColumn("text_hash", one_hash).withColumn("text_check", other_hash)
    one = per_document(task, schema)

    def run(batches):
        for batch in batches:
            parts = pa.Table.from_batches(one([batch]), schema).combine_chunks()
            for name in ("text_hash", "text_check"):
                parts = parts.append_column(name, batch.column(name))
            yield from parts.to_batches()

    return with_hash.mapInArrow(run, "doc_id long, fp long, text_hash long, text_check long")


def block_masks(distance: int) -> list[int]:
    """The masks of the bits that a pair within ``distance`` agrees on, one of them at least.

    Of ``distance + SPARE_BLOCKS`` blocks, at most ``distance`` hold a differing bit,
    so some ``SPARE_BLOCKS`` of them are equal.
    """
    n = distance + SPARE_BLOCKS
    edges = [BITS * k // n for k in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, SPARE_BLOCKS)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _neighbours(distance: int, masks: list[int]):
    """A task that gives each member of a crowded cell the values within half the distance."""
    flips = {}
    for t, mask in enumerate(masks):
        free = [1 << b for b in range(BITS) if not mask >> b & 1]
        near = [sum(c) for k in range((distance + 1) // 2 + 1) for c in itertools.combinations(free, k)]
        flips[t] = np.array(near, np.uint64)

    def task(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for t, fp in zip(batch.column("t").to_pylist(), fps, strict=True):
                z = (flips[t] ^ fp).view(np.int64)
                yield pa.RecordBatch.from_pydict({"z": z, "fp": np.full(len(z), fp).view(np.int64)})

    return task


def links(fps: DataFrame, distance: int = 4, paired_cell: int = PAIRED_CELL) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints, with the components of all close pairs.

    ``fps`` has a long column ``fp`` without repetition.  Fingerprints that agree on
    some blocks share a cell; in a cell, pairs are verified by their Hamming distance.
    A cell of more than ``paired_cell`` members is not paired: each member names the
    values within half the distance of it, and members that name the same value are
    linked to the least of them.  That links no pair beyond the distance when it is
    even, reaches each pair within it, and costs every member the same.
    An odd distance is verified pair by pair in every cell.
    """
    masks = block_masks(distance)
    cells = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
        ).alias("cell"),
    ).select("cell.t", "cell.key", "fp")
    sizes = cells.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut_lineage(merge_join(cells, sizes, ["t", "key"]), "cells")
    crowded = F.col("n") > (paired_cell if distance % 2 == 0 else 2**62)
    left = shared.where(~crowded).select("t", "key", F.col("fp").alias("a"))
    right = shared.where(~crowded).select("t", "key", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    paired = merge_join(left, right, ["t", "key"]).where(close).select("a", "b")
    if distance % 2 or shared.where(crowded).limit(1).count() == 0:
        return paired
    named = shared.where(crowded).select("t", "fp").mapInArrow(_neighbours(distance, masks), "z long, fp long").distinct()
    named = cut_lineage(named, "neighbours")
    least = cut_lineage(named.groupBy("z").agg(F.min("fp").alias("b")), "least-neighbour")
    return paired.union(merge_join(named, least, "z").where("fp != b").select(F.col("fp").alias("a"), "b"))


def _labelled(docs: DataFrame, shingle: int, distance: int, paired_cell: int) -> DataFrame:
    """The fingerprints of ``docs`` with ``component_id`` and ``label``, the least fingerprint that links reach."""
    found = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    classes = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    joined = components(links(classes.select("fp"), distance, paired_cell))
    labelled = classes.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left")
    labelled = cut_lineage(labelled.select("fp", "first", F.coalesce("component", "fp").alias("label")), "labels")
    least = cut_lineage(labelled.groupBy("label").agg(F.min("first").alias("component_id")), "least-documents")
    by_fp = cut_lineage(merge_join(labelled, least, "label").select("fp", "component_id", "label"), "fingerprint-components")
    return merge_join(found, by_fp, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, paired_cell: int = PAIRED_CELL) -> DataFrame:
    """``doc_id, fp, text_hash, component_id`` of each row of ``docs``.

    Words are what lies between ASCII white space, with A-Z in lower case; the
    shingles of a text count as often as they occur, a text of fewer words is one
    shingle, and a text without words (null, empty, white space) has the
    fingerprint 0, which links like any other.  ``component_id`` is the least
    ``doc_id`` that links reach.  Rows with an equal ``doc_id`` are documents of
    their own; a null ``doc_id`` is linked but names no component, so it is null
    where a component holds no other.  An empty table gives an empty one.
    """
    return _labelled(docs, shingle, distance, paired_cell).select("doc_id", "fp", "text_hash", "component_id")


def first_documents(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does, all columns kept.

    The document of the least id stays, one without an id only where its group has no
    other; of rows with that id, one of the text of the least hash.  Rows of other
    groups stay whatever their ids: a null or repeated id joins nothing.
    """
    found = _labelled(docs, shingle, distance, PAIRED_CELL)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "text_check")
    kept = found.groupBy("label").agg(F.min(first).alias("first"))
    names = {"doc_id": "_kept_id", "text_hash": "_kept_hash", "text_check": "_kept_check"}
    kept = kept.select(F.col("label").alias("_kept_label"), *[F.col(f"first.{k}").alias(v) for k, v in names.items()])
    kept = cut_lineage(kept, "kept")
    one_hash, other_hash = text_hashes(F.coalesce(docs["text"].cast("string"), F.lit("")))
    match = docs["doc_id"].cast("long").eqNullSafe(kept["_kept_id"])
    match &= (one_hash == kept["_kept_hash"]) & (other_hash == kept["_kept_check"])
    one = Window.partitionBy("_kept_label").orderBy("_kept_hash")
    rows = docs.join(kept, match).withColumn("_kept_row", F.row_number().over(one)).where("_kept_row = 1")
    return rows.select(*[docs[c] for c in docs.columns])
