"""Repeated passages by recompression: rounds that name runs and pairs of word symbols.

Equal stretches of words get equal symbols wherever what the naming looked at lies
inside the stretch.  So a window of words can only occur twice if each symbol that
depends on nothing outside it occurs twice: shared symbols reveal the candidates,
and the candidates' word sequences verify them.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicatlas.llm.common import documents, slices, text_hashes
from topicatlas.operators.lineage import cut_lineage, discard
from topicatlas.operators.skew import merge_join

#: Words of a window.
WINDOW = 35
#: Rounds of naming; what a symbol depends on then spans fourteen words on average.
ROUNDS = 3
#: Symbols of fewer words are common by themselves and reveal nothing.
LEAST_SPAN = 3
#: What tells rows apart: only rows with equal texts under an equal id share it.
IDENTITY = ["doc_id", "text_hash", "text_check"]
SYMBOL_COLUMNS = ["name", "row", "start", *IDENTITY]

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(33))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Symbols:
    """A row of symbols over the words of several documents, laid end to end.

    ``start`` and ``end`` are the words a symbol spans, ``low`` and ``high`` the words
    its naming depends on.  What depends on the edge of a document reaches one word
    beyond it, so it lies in no window.
    """

    def __init__(self, names: np.ndarray, bounds: np.ndarray):
        n = len(names)
        self.bounds = bounds
        self.name = names
        self.start = np.arange(n)
        self.end = self.start + 1
        self.low, self.high = self.start.copy(), self.end.copy()

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a symbol is the first, or the last, of its document."""
        return np.isin(self.start, self.bounds), np.isin(self.end, self.bounds)

    def _beside(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the symbols before and after depend on; one word outside at an edge."""
        low = np.where(first, self.start - 1, np.roll(self.low, 1))
        high = np.where(last, self.end + 1, np.roll(self.high, -1))
        return np.minimum(low, self.low), np.maximum(high, self.high)

    def name_runs(self) -> None:
        first, last = self._edges()
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | first[1:]
        low, high = self._beside(first, last)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(new)) - 1
        length = (tails - heads + 1).astype(np.uint64)
        name = self.name[heads]
        run = length > 1
        name[run] = mix(name[run] + length[run] * np.uint64(0xA24BAED4963EE407))
        self.name, self.start, self.end = name, self.start[heads], self.end[tails]
        self.low, self.high = low[heads], high[tails]

    def name_pairs(self, salt: int) -> None:
        """Joins each symbol of the left half of all names with a following one of the right half."""
        first, last = self._edges()
        right = (mix(self.name ^ np.uint64(salt)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(right), bool)
        joins[:-1] = ~right[:-1] & right[1:] & ~last[:-1]
        joined = np.zeros(len(right), bool)
        joined[1:] = joins[:-1]
        low, high = self._beside(first, last)
        low = np.where(right & ~joined, low, self.low)
        high = np.where(~right & ~joins, high, self.high)
        heads = np.flatnonzero(~joined)
        tails = heads + joins[heads]
        name = self.name[heads]
        pair = joins[heads]
        name[pair] = mix(name[pair] * np.uint64(0x9FB21C651E98DF25) + mix(self.name[tails[pair]]))
        self.name, self.start, self.end = name, self.start[heads], self.end[tails]
        self.low, self.high = low[heads], high[tails]


def symbols(names: np.ndarray, bounds: np.ndarray, rounds: int) -> Symbols:
    """The symbols after some rounds; ``bounds`` are the first words of documents and the end."""
    found = Symbols(names, bounds)
    for k in range(rounds if len(names) else 0):
        found.name_runs()
        found.name_pairs(0x2545F4914F6CDD1D * (2 * k + 1) & (2**64 - 1))
    return found


def window_hashes(names: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of ``window`` words, from two orders of mixing."""
    n = len(names) - window + 1
    found = []
    for base in _BASES:
        powers = np.cumprod(np.full(window, base, np.uint64))[::-1]
        total = np.zeros(max(n, 0), np.uint64)
        own = mix(names ^ np.uint64(base))
        for k in range(window if n > 0 else 0):
            total += own[k : k + n] * powers[k]
        found.append(mix(total))
    return found[0], found[1]


def _laid_out(texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of some texts, their names end to end, and where each text begins."""
    words = [words_of(t) for t in texts]
    bounds = np.cumsum([0, *map(len, words)])
    names = np.concatenate([word_names(w) for w in words]) if words else np.zeros(0, np.uint64)
    return words, names, bounds


def _inner_symbols(names: np.ndarray, bounds: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """``name, start, low, high`` of the symbols that can lie in a window with all they depend on."""
    found = symbols(names, bounds, rounds)
    use = (found.end - found.start >= LEAST_SPAN) & (found.high - found.low <= window)
    return found.name[use], found.start[use], found.low[use], found.high[use]


def _symbol_rows(window: int, rounds: int):
    """The symbols of each row, and one with its id and text hashes in place of a symbol."""

    def task(batches):
        for batch in batches:
            rows = batch.column("row")
            n = batch.num_rows
            own = [batch.column(c) for c in IDENTITY]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), rows, pa.nulls(n, pa.int32()), *own], SYMBOL_COLUMNS)
            for begin, texts in slices(batch.column("text")):
                _, names, bounds = _laid_out(texts)
                name, start, _, _ = _inner_symbols(names, bounds, window, rounds)
                doc = np.searchsorted(bounds, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(name.view(np.int64)),
                        rows.slice(begin, len(texts)).take(pa.array(doc)),
                        pa.array((start - bounds[doc]).astype(np.int32)),
                        *[pa.nulls(len(name), pa.int64()) for _ in IDENTITY],
                    ],
                    SYMBOL_COLUMNS,
                )

    return task


def _window_rows(window: int, rounds: int):
    """Windows all of whose inner symbols are shared, with their two hashes."""

    def task(batches):
        for batch in batches:
            rows, shared = batch.column("row"), batch.column("starts")
            for begin, texts in slices(batch.column("text")):
                _, names, bounds = _laid_out(texts)
                if len(names) < window:
                    continue
                _, start, low, high = _inner_symbols(names, bounds, window, rounds)
                known = np.zeros(len(names) + 1, bool)
                for k, text_start in enumerate(bounds[:-1]):
                    own = shared[begin + k]
                    if own.is_valid:
                        at = own.values.to_numpy(zero_copy_only=False) + text_start
                        known[at[at < bounds[k + 1]]] = True
                alone = ~known[start]
                first = np.maximum(high[alone] - window, 0)
                barred = np.bincount(first, minlength=len(names) + 1) - np.bincount(
                    low[alone] + 1, minlength=len(names) + 1
                )
                free = np.cumsum(barred[: len(names) - window + 1]) == 0
                at = np.flatnonzero(free)
                doc = np.searchsorted(bounds, at, side="right") - 1
                inside = at + window <= bounds[doc + 1]
                at, doc = at[inside], doc[inside]
                one, two = window_hashes(names, window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one[at].view(np.int64)),
                        pa.array((two[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        rows.slice(begin, len(texts)).take(pa.array(doc)),
                        pa.array((at - bounds[doc]).astype(np.int32)),
                    ],
                    ["one", "two", "row", "at"],
                )

    return task


def _of_identity(docs: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """``docs`` (``doc_id, text`` and others) with the columns of ``table`` for their id and text."""
    match = docs["doc_id"].cast("long").eqNullSafe(table["_id"])
    for hashed, name in zip(text_hashes(docs["text"]), ("_text_hash", "_text_check"), strict=True):
        match &= hashed == table[name]
    return docs.join(table, match, how).drop("_id", "_text_hash", "_text_check")


def repeated_windows(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``_id, _text_hash, _text_check, starts``: where windows begin whose word sequence begins anywhere else too.

    There is a row for each id and text with such a window, null ids as well, so
    ``starts`` is never longer than the text.  Rows are numbered where their symbols
    are written; of rows with equal ids and texts (128 bits of hash) the least number
    stands for all.  Counting symbols and windows combines before the shuffle; hot
    symbols and windows meet their counts in joins whose sides are both plain
    exchanges, so Spark can split them.
    """
    source = documents(docs)
    one, other = text_hashes(F.col("text"))
    numbered = source.select("text", F.monotonically_increasing_id().alias("row"), "doc_id", one.alias("text_hash"), other.alias("text_check"))
    kinds = "name long, row long, start int, doc_id long, text_hash long, text_check long"
    written = cut_lineage(numbered.mapInArrow(_symbol_rows(window, rounds), kinds), "symbols")
    identities = written.where("start is null").groupBy(*IDENTITY).agg(F.min("row").alias("row"))
    identities = cut_lineage(identities.select("row", *[F.col(c).alias(k) for c, k in zip(IDENTITY, ("_id", "_text_hash", "_text_check"), strict=True)]), "identities")
    rows = written.where("start is not null").select("name", "row", "start")
    shared = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    shared = cut_lineage(shared, "shared-names")
    found = cut_lineage(merge_join(rows, shared, "name").select("row", "start"), "shared-symbols")
    discard(written, shared)
    by_row = found.groupBy("row").agg(F.collect_list("start").alias("starts"))
    by_row = cut_lineage(merge_join(identities, by_row, "row", "left"), "shared-by-document")
    discard(found)
    candidates = _of_identity(source, by_row, "inner")
    windows = candidates.select("row", "text", "starts").mapInArrow(
        _window_rows(window, rounds), "one long, two int, row long, at int"
    )
    windows = cut_lineage(windows, "windows")
    discard(by_row)
    twice = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
    twice = cut_lineage(twice, "repeated")
    found = cut_lineage(merge_join(windows, twice, ["one", "two"]).select("row", "at"), "repeated-windows")
    discard(windows, twice)
    by_row = found.groupBy("row").agg(F.collect_set("at").alias("starts"))
    by_row = cut_lineage(merge_join(identities, by_row, "row").drop("row"), "repeated-by-document")
    discard(found, identities)
    return by_row


def kept_words(words: list[bytes], starts: np.ndarray, window: int) -> list[bytes]:
    """The words that no window beginning at one of ``starts`` covers."""
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    left = np.cumsum(cover[:-1]) == 0
    return [w for w, stay in zip(words, left.tolist(), strict=True) if stay]


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with the words of repeated windows removed, and ``_n_words, _n_removed``.

    Words are what lies between ASCII white space.  A window is ``window``
    consecutive words of one row; each word is removed that lies in a window whose
    word sequence also begins anywhere else, the same text included, as judged on
    the input.  The kept words are joined by one space.  All columns stay as they
    are but ``text``; a null text is an empty one, and texts shorter than a window
    lose nothing.  Rows that repeat each other repeat their windows, also under the
    same ``doc_id``.  Two leading underscored columns are added, so no name clashes.
    """
    repeated = repeated_windows(docs, window, rounds).withColumnRenamed("starts", "_starts")
    source = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = _of_identity(source, repeated, "left")
    columns = docs.columns

    def task(batches):
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, own in zip(batch.column("text"), batch.column("_starts"), strict=True):
                words = words_of(text.as_py())
                at = own.values.to_numpy(zero_copy_only=False) if own.is_valid else np.zeros(0, np.int64)
                left = kept_words(words, at, window)
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
            arrays = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                [*columns, "_n_words", "_n_removed"],
            )

    schema = source.select(*columns).schema.add("_n_words", "long").add("_n_removed", "long")
    return joined.mapInArrow(task, schema)
