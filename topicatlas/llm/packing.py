"""Packing of documents into sequences: first fit decreasing on a tournament tree of bins."""

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicatlas.llm.common import documents, slices
from topicatlas.operators.lineage import cut_lineage

SEQUENCE = 2048
END = 1
#: Pieces of a randomised group, on average; a group is packed in one task.
GROUP_PIECES = 4096
#: Pieces of one document that stay together in a group.
PIECES_TOGETHER = 1024
#: Characters on which both tokenizer libraries split alike: Latin letters and common signs.
PLAIN = regex.compile(r"[\t\n\r -~ -ɏ‐-‧‰-⁞€]*+")


class Encoder:
    """Token ids of a byte-level vocabulary.

    Plain texts are encoded by the quicker of two libraries with the vocabulary's
    own merge order; all others by ``tokenizers``.  Both give the same ids.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        self.quick = tiktoken.Encoding(
            "own",
            pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
            mergeable_ranks=_ranks(data["model"]["vocab"]),
            special_tokens={},
        )

    def ids(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text):
            return np.array(self.quick.encode_ordinary(text), "<u4")
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


def _ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Bytes of each entry; byte-level vocabularies write a byte as a printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(map(byte_of.__getitem__, k)): v for k, v in vocabulary.items() if all(c in byte_of for c in k)}


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, row`` of each piece of each row of ``docs``.

    A document's ids, and after them one end id, are cut into whole sequences and a
    rest.  A null or empty text is the end id alone.  ``row`` tells the rows apart,
    also those that repeat each other; it is a number by task, to be written before use.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row")])

    def run(batches):
        encoder = Encoder(tokenizer)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for begin, texts in slices(batch.column("text")):
                rows: list[list[int]] = [[], [], [], [], []]
                for k, text in enumerate(texts):
                    ids = np.append(encoder.ids(text), np.uint32(END)).astype("<u4")
                    for start in range(0, len(ids), sequence):
                        part = ids[start : start + sequence]
                        for column, value in zip(rows, (k, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                            column.append(value)
                owner = doc_ids.slice(begin, len(texts)).take(pa.array(rows[0], pa.int64()))
                row = pa.array(np.array(rows[0], np.int64) + first)
                first += len(texts)
                yield pa.RecordBatch.from_arrays([owner, *[pa.array(c, pa.int64()) for c in rows[1:]], row], schema=schema)

    columns = ", ".join(f"{f.name} long" for f in schema)
    return documents(docs).mapInArrow(run, columns)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: the longest first, each into the first bin that has room.

    A complete binary tree holds in each node the most room of the bins below it, so
    the first bin with enough of it is found on one way down, and one way up renews
    the nodes above.
    """
    order = np.argsort(-lengths, kind="stable")
    width = 1 << max(0, int(len(lengths) - 1).bit_length())
    room = [capacity] * (2 * width)
    bins = np.empty(len(lengths), np.int64)
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        node = 1
        while node < width:
            node *= 2
            if room[node] < length:
                node += 1
        bins[i] = node - width
        room[node] -= length
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            most = left if left >= right else right
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id, offset``: where each lies in which sequence.

    Rows are dealt at random into groups of about ``group_pieces`` pieces, a very
    long one in runs of ``PIECES_TOGETHER`` pieces, and each group is packed by
    itself.  Rows that repeat each other are dealt like any others.  ``sequence_id`` is unique among all groups; offsets are gapless from 0.
    Rows that repeat each other, or a ``doc_id``, have pieces of their own; a null
    ``doc_id`` is kept.  An empty table gives an empty one.
    """
    cut = cut_lineage(pieces(docs, tokenizer, sequence), "pieces")
    groups = max(1, cut.count() // group_pieces)
    run_of = F.floor(F.col("start") / (sequence * PIECES_TOGETHER))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("row", run_of), F.lit(groups)).cast("long")).drop("row")

    def one(frame):
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy()
        bins = first_fit_decreasing(lengths, sequence)
        order = np.lexsort((-lengths, bins))
        inside, size = bins[order], lengths[order]
        before = np.cumsum(size) - size
        first = np.flatnonzero(np.append(True, inside[1:] != inside[:-1]))
        offset = np.empty(len(size), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(size))))
        frame["sequence_id"] = (frame["group"].to_numpy() << 32) | bins
        frame["offset"] = offset
        return frame.drop(columns="group").astype({"doc_id": "Int64"})

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return dealt.groupBy("group").applyInPandas(one, ", ".join(f"{n} long" for n in names))
