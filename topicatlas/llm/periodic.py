"""Runs of repeating words: documents split at words too rare to repeat, what is left scanned at each lag.

A run holds each of its words four times at least.  So a word that occurs less often
within a stretch lies in no run inside it and parts the stretch, which can make other
words rare in the parts.  Stretches without rare words are compared with themselves at
each lag.
"""

import zlib
from bisect import bisect_left, bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from topicatlas.llm.common import documents, slices

#: A run is so many times its period, and so many words, at least.
EXPONENT, LEAST_WORDS = 4, 6
#: Rounds of splitting; what then is not yet stable is scanned as it is, with the same runs.
ROUNDS = 64
#: Places behind a multiple of the lag that are compared before an agreement is followed.
PROBES = 16
#: Characters of the texts whose words are numbered and split together.
SLICE_CHARS = 500_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def surviving(ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """The stretches ``start, end`` that may hold a run, by splitting at rare words to stability."""
    place, stretch, kinds = np.arange(len(ids)), doc.astype(np.int64), int(ids.max(initial=0)) + 1
    stable: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        if not len(place):
            return stable
        _, kind, times = np.unique(stretch * kinds + ids[place], return_inverse=True, return_counts=True)
        rare = times[kind] < EXPONENT
        head = np.append(True, stretch[1:] != stretch[:-1])
        part = np.cumsum(head) - 1
        begins = np.flatnonzero(head)
        whole = np.bincount(part, rare, len(begins)) == 0
        ends = np.append(begins[1:], len(place))
        stable += [(int(place[b]), int(place[e - 1]) + 1) for b, e in zip(begins[whole], ends[whole], strict=True) if e - b >= LEAST_WORDS]
        use = ~rare & ~whole[part]
        # What rare words stood between is apart from now on.
        left, old = place[use], stretch[use]
        new = np.append(True, (np.diff(left) > 1) | (old[1:] != old[:-1])) if len(left) else np.zeros(0, bool)
        stretch = np.cumsum(new) - 1
        enough = np.bincount(stretch, minlength=1)[stretch] >= LEAST_WORDS if len(left) else np.zeros(0, bool)
        place, stretch = left[enough], stretch[enough]
    begins = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1])) if len(place) else []
    ends = np.append(begins[1:], len(place)) if len(place) else []
    return stable + [(int(place[b]), int(place[e - 1]) + 1) for b, e in zip(begins, ends, strict=True)]


def lag_scan(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the runs of a stretch.

    A run of period q agrees with itself at lag q over three periods at least (five
    words for one), so at three multiples of q in a row: only these are looked at, and
    agreements there are followed to both ends.  A stretch inside a run whose period divides the lag has
    that lesser period and is passed over whole.
    """
    n = len(ids)
    found: list[tuple[int, int, int]] = []
    ends_of: dict[int, tuple[list[int], list[int]]] = {}
    for q in range(1, n // EXPONENT + 1):
        same = ids[: n - q : q] == ids[q::q]
        many = EXPONENT - 1 if q > 1 else LEAST_WORDS - 1
        hits = same[: len(same) - many + 1].copy()
        for k in range(1, many):
            hits &= same[k : len(same) - many + 1 + k]
        hits = np.flatnonzero(hits) * q
        # All in between agrees as well; a few places tell most that do not.
        for k in range(1, min(q, PROBES)):
            if not len(hits):
                break
            hits = hits[ids[hits + k] == ids[hits + k + q]]
        hits = hits.tolist()
        own: list[tuple[int, int]] = []
        k = 0
        while k < len(hits):
            x = hits[k]
            reach = -1
            for d, (starts, ends) in ends_of.items():
                if q % d == 0:
                    i = bisect_right(starts, x) - 1
                    if i >= 0 and x + q < ends[i]:
                        reach = max(reach, ends[i] - q)
            if x < reach:
                k = bisect_left(hits, reach, k)
                continue
            low, high = _agreement(ids, q, x)
            if high + q - low >= max(LEAST_WORDS, EXPONENT * q):
                own.append((low, high + q))
            k = bisect_left(hits, high, k)
        if own:
            ends_of[q] = ([start for start, _ in own], [end for _, end in own])
            found += [(start, end - start, q) for start, end in own]
    return sorted(found)


def _agreement(ids: np.ndarray, q: int, x: int) -> tuple[int, int]:
    """The places around ``x`` where the words ``q`` apart are the same, as far as they go on."""
    step, high = 64, x + 1
    top = len(ids) - q
    while high < top:
        end = min(top, high + step)
        differ = np.flatnonzero(ids[high:end] != ids[high + q : end + q])
        if len(differ):
            high += int(differ[0])
            break
        high, step = end, 2 * step
    step, low = 64, x
    while low > 0:
        begin = max(0, low - step)
        differ = np.flatnonzero(ids[begin:low] != ids[begin + q : low + q])
        if len(differ):
            low = begin + int(differ[-1]) + 1
            break
        low, step = begin, 2 * step
    return low, high


def runs_of(words: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """``start, length, period`` of the runs of each document, by start and then period."""
    kinds: dict[bytes, int] = {}
    sizes = [len(w) for w in words]
    ids = np.fromiter((kinds.setdefault(w, len(kinds)) for own in words for w in own), np.int64, sum(sizes))
    doc = np.repeat(np.arange(len(words)), sizes)
    bounds = np.cumsum([0, *sizes])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for start, end in surviving(ids, doc):
        d = int(doc[start])
        shift = start - int(bounds[d])
        runs[d] += [(shift + s, length, q) for s, length, q in lag_scan(ids[start:end])]
    for own in runs:
        own.sort(key=lambda r: (r[0], r[2]))
    return runs


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the most periods; of equals the first, then that of the least period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words in no run behind its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        cover[start + q] += 1
        cover[start + length] -= 1
    return [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]


RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with each run cut down to its first period, and ``_n_words, _runs, _best``.

    Words are what lies between ASCII white space.  A run is a stretch with smallest
    period q, of at least ``EXPONENT`` periods and ``LEAST_WORDS`` words, that no word
    beside it extends; runs may overlap.  ``_runs`` are ``start, length, period`` in
    words, by start and then period, ``_best`` the one of most periods or null.  Kept
    words are joined by one space.  A null text is an empty one and has no run; rows are
    judged by themselves, so repeated rows give equal results.  Other columns stay as
    they are; the added names are underscored, so none clashes.
    """
    columns = docs.columns
    source = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    run = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
    named = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))

    def task(batches):
        for batch in batches:
            for begin, texts in slices(batch.column("text"), SLICE_CHARS):
                words = [words_of(t) for t in texts]
                runs = runs_of(words)
                kept = [b" ".join(kept_words(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, runs, strict=True)]
                own = batch.slice(begin, len(texts))
                arrays = [pa.array(kept, pa.string()) if c == "text" else own.column(c) for c in columns]
                added = [
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[named(r) for r in rs] for rs in runs], pa.list_(run)),
                    pa.array([named(best_run(rs)) for rs in runs], run),
                ]
                yield pa.RecordBatch.from_arrays([*arrays, *added], [*columns, "_n_words", "_runs", "_best"])

    schema = source.select(*columns).schema.add("_n_words", "long").add("_runs", ArrayType(RUN)).add("_best", RUN)
    return source.select(*columns).mapInArrow(task, schema)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a period of their own in one of ten documents, dealt by the id; null ids have none."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``docs``, where texts that the id says are made to repeat themselves."""

    def task(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for begin, texts in slices(batch.column("text"), SLICE_CHARS):
                own = ids.slice(begin, len(texts))
                new = [b" ".join(planted(words_of(t), i.as_py())).decode("utf-8", "surrogatepass") for t, i in zip(texts, own, strict=True)]
                yield pa.RecordBatch.from_arrays([own, pa.array(new, pa.string())], ["doc_id", "text"])

    return documents(docs).mapInArrow(task, "doc_id long, text string")
