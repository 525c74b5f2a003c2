"""SentencePiece ids of whole texts from a table of distinct chunks, and back."""

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topicatlas.llm.common import documents, per_document

MARK = "▁"
#: A run of white-space marks and what follows it; no piece crosses the end of one.
CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
#: Distinct chunks a task remembers before it starts anew.
REMEMBERED = 300_000


class Chunks:
    """The ids and the decoded text of each distinct chunk, segmented once.

    A model is refused if a piece holds a mark after another character, or if it
    changes texts before it marks their spaces: then chunks would not be independent.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross white-space marks")
        probe = " a  ﬁ é́\tb \n"
        if self.model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("this model normalizes texts")
        self.ids: dict[str, list[int]] = {}
        self.decoded: dict[str, str] = {}

    def learn(self, keys: set[str]) -> None:
        """Segments the chunks that are new, given without the mark the model puts before a text."""
        new = sorted(keys.difference(self.ids))
        for key, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            self.ids[key] = ids if key else [self.model.piece_to_id(MARK)]
        for key, text in zip(new, self.model.decode([self.ids[k] for k in new], num_threads=1), strict=True):
            self.decoded[key] = text

    def encode(self, texts: list[str]) -> dict:
        if len(self.ids) > REMEMBERED:
            self.ids, self.decoded = {}, {}
        keys = []
        for text in texts:
            chunks = CHUNK.findall(text)
            keys.append(chunks[:1] + [c[1:] for c in itertools.islice(chunks, 1, None)])
        self.learn(set(itertools.chain.from_iterable(keys)))
        flat, ends, decoded = [], [0], []
        for own in keys:
            flat.extend(itertools.chain.from_iterable(map(self.ids.__getitem__, own)))
            ends.append(len(flat))
            decoded.append(" ".join(map(self.decoded.__getitem__, own)))
        ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
        return {"ids": ids, "decoded": decoded}


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, decoded`` of each row of ``docs``: the library's ids of the whole text, and their text.

    Each task keeps a table of the distinct chunks it meets, segments each of them
    once, and joins their ids back by position.  No begin or end ids.  A null or
    empty text has no ids.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        yield from per_document(Chunks(model).encode, schema)(batches)

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
