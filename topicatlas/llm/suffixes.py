"""Repeated byte strings by column-wise construction: suffixes sorted by one symbol of each string a round.

A window of ``window`` bytes that occurs twice holds the same anchor, its least hashed
stretch of ``ANCHOR`` bytes, at the same place.  So texts are cut into strings of
consecutive windows with one anchor, and strings aligned at their anchors are the
documents of the construction: each round takes one column of them, the symbols before
the suffixes of the round before, in the order of these (their Burrows-Wheeler
transform).  A stable sort by that column is the order of the longer suffixes, and
their common prefixes are one more than the least common prefix between the places
they come from.  Equal windows stand in the same column, so the round before is all
that a round needs.  The files the strings are read from in turn are written tables
that all machines share.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from topicatlas.llm.common import slices, text_hashes
from topicatlas.operators.lineage import cut_lineage, discard

#: Bytes of a window, and of the stretch that anchors it.
WINDOW, ANCHOR = 100, 20
#: Strings sorted together; a group is cut between anchors only.
STRINGS_AT_ONCE = 150_000
#: An anchor in more different strings than this is cut into pairs of windows, whose
#: common bytes leave 65,536 different ones at most.
STRINGS_OF_ANCHOR = 20_000

#: Bytes of texts a task anchors at a time; a longer text is a slice of its own.
SLICE_BYTES = 300_000

_PLACE_BITS = 34
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def anchor_hashes(data: np.ndarray, anchor: int = ANCHOR) -> np.ndarray:
    """A 64-bit hash of each stretch of ``anchor`` bytes."""
    known, length, done = data.astype(np.uint64) + np.uint64(1), 1, None
    taken, rest = 0, anchor
    while rest:
        if rest & 1:
            part = known[taken:]
            if done is None:
                done = part
            else:
                n = min(len(done), len(part))
                done = done[:n] * np.uint64(pow(_BASE, length, 2**64)) + part[:n]
            taken += length
        rest >>= 1
        if rest:
            known = known[:-length] * np.uint64(pow(_BASE, length, 2**64)) + known[length:]
            length *= 2
    done = done[: max(0, len(data) - anchor + 1)]
    for factor in _MIX:
        done = (done ^ (done >> np.uint64(33))) * factor
    return done ^ (done >> np.uint64(33))


def anchored_strings(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """``doc, at, start, n, name`` of the strings of consecutive windows with one anchor.

    ``data`` are texts end to end and ``bounds`` where they begin, and the end.
    ``at`` is where the anchor begins and ``start`` the first of ``n`` windows, both
    within the text; at equal hashes the first place is the anchor.  A text shorter
    than a window has none.
    """
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    reach = window - anchor + 1
    if len(data) < window:
        return empty
    names = anchor_hashes(data, anchor)
    # The hash above, the place below: the least of them is the first place of the least hash.
    least = (names >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(names), dtype=np.uint64)
    length = 1
    while 2 * length <= reach:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    if reach > length:
        least = np.minimum(least[: -(reach - length)], least[reach - length :])
    at = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int64)
    long = np.diff(bounds) >= window
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - window + 1, -1)
    inside = np.cumsum(inside)[: len(at)] > 0
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new)
    # A run of windows ends where the next begins, or at the last window of its text.
    doc = np.searchsorted(bounds, start, side="right") - 1
    last = np.append(start[1:], len(data))
    n = np.minimum(last, bounds[doc + 1] - window + 1) - start
    return doc, at[start] - bounds[doc], start - bounds[doc], n, names[at[start]]


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _rows_of(batches) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    """The texts (binary) of slices of bounded size, and the slices; a long text is one of its own."""
    for batch in batches:
        for begin, texts in slices(batch.column("text"), SLICE_BYTES):
            yield [t or b"" for t in texts], batch.slice(begin, len(texts))


def _again(texts: list[bytes], doc, start, n, name, window: int) -> np.ndarray:
    """Whether a string begins earlier in its own text too."""
    again = np.zeros(len(doc), bool)
    order = np.lexsort((np.arange(len(doc)), name, doc))
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (name[order][1:] == name[order][:-1])
    # Equal strings have equal anchors, so only groups of those are compared, byte by byte.
    group = np.cumsum(~same)
    crowded = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    seen, before = set(), -1
    for k in crowded.tolist():
        if group[k] != before:
            seen, before = set(), group[k]
        i = order[k]
        string = texts[doc[i]][start[i] : start[i] + n[i] + window - 1]
        again[i] = string in seen
        seen.add(string)
    return again


def _anchor_rows(window: int, anchor: int):
    """``name, row, at`` of each string new to its text; a null name marks a text with others."""

    def task(batches):
        for texts, part in _rows_of(batches):
            doc, at, start, n, name = anchored_strings(*_laid_out(texts), window, anchor)
            again = _again(texts, doc, start, n, name, window)
            new, marked = np.flatnonzero(~again), np.unique(doc[again])
            names = pa.concat_arrays([pa.array(name[new].view(np.int64)), pa.nulls(len(marked), pa.int64())])
            docs = np.concatenate([doc[new], marked])
            ats = np.concatenate([at[new], np.full(len(marked), -1)])
            yield pa.RecordBatch.from_arrays([names, part.column("row").take(pa.array(docs)), pa.array(ats)], ["name", "row", "at"])

    return task


def _string_rows(window: int, anchor: int):
    """The strings of the anchors in ``ats``; those again in their text without bytes or name."""

    def task(batches):
        for texts, part in _rows_of(batches):
            doc, at, start, n, name = anchored_strings(*_laid_out(texts), window, anchor)
            again = _again(texts, doc, start, n, name, window)
            use = again.copy()
            wanted = part.column("ats")
            begins = np.searchsorted(doc, np.arange(len(texts) + 1))
            for k, own in enumerate(wanted):
                mine = slice(begins[k], begins[k + 1])
                use[mine] |= np.isin(at[mine], own.values.to_numpy(zero_copy_only=False))
            at_ = np.flatnonzero(use)
            found = [None if again[i] else texts[doc[i]][start[i] : start[i] + n[i] + window - 1] for i in at_.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(name[at_].view(np.int64), mask=again[at_]),
                    part.column("row").take(pa.array(doc[at_])),
                    pa.array(start[at_]),
                    pa.array((at - start)[at_].astype(np.int32)),
                    pa.array(n[at_].astype(np.int32)),
                    pa.array(found, pa.binary()),
                ],
                ["name", "row", "start", "before", "n", "string"],
            )

    return task


def _range_minimum(lcp: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of ``lcp[first..last]``, both included, for each range."""
    rows = [lcp]
    longest = int((last - first).max(initial=0)) + 1
    while 2 ** len(rows) <= longest:
        half = 2 ** (len(rows) - 1)
        above = rows[-1].copy()
        np.minimum(above[:-half], rows[-1][half:], out=above[:-half])
        rows.append(above)
    table = np.concatenate(rows)
    level = (np.frexp((last - first + 1).astype(np.float64))[1] - 1).astype(np.int64)
    base = level * len(lcp)
    return np.minimum(table[base + first], table[base + last + 1 - (1 << level)])


def columns_of(strings: list[bytes], before: np.ndarray, reach: int, window: int) -> np.ndarray:
    """The strings as rows of a matrix of symbols, aligned at their anchors; a row a column of symbols."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    row = np.repeat(np.arange(len(strings)), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols = np.zeros((reach - 1 + window, len(strings)), np.uint8)
    symbols[reach - 1 - before[row] + within, row] = np.frombuffer(b"".join(strings), np.uint8)
    return symbols


def earlier_windows(strings: list[bytes], before: np.ndarray, n: np.ndarray, rank: np.ndarray, window: int, reach: int) -> np.ndarray:
    """Of each column and string, whether the window that begins there has an equal one of lesser rank.

    ``rank`` orders the strings, so that of equal windows those of the least rank are
    the first.  What lies beyond a string counts as the byte 0, which no window of a
    string reaches.
    """
    m = len(strings)
    symbols = columns_of(strings, before, reach, window)
    first = reach - 1 - before
    order = np.argsort(rank, kind="stable")
    lcp = np.full(m, window, np.uint8 if window < 256 else np.uint16)
    lcp[:1] = 0
    later = np.zeros((reach, m), bool)
    for column in range(len(symbols) - 1, -1, -1):
        transform = symbols[column][order]  # the symbols before the suffixes, in their order
        moved = np.argsort(transform, kind="stable")
        same = transform[moved[1:]] == transform[moved[:-1]]
        longer = np.zeros(m, lcp.dtype)
        known = _range_minimum(lcp, moved[:-1][same] + 1, moved[1:][same])
        longer[1:][same] = np.minimum(known, window - 1) + 1
        order, lcp = order[moved], longer
        if column < reach:
            heads = np.flatnonzero(lcp < window)
            inside = (first <= column) & (column < first + n)
            ranks = np.where(inside, rank, np.iinfo(np.int64).max)[order]
            least = np.repeat(np.minimum.reduceat(ranks, heads), np.diff(np.append(heads, m)))
            later[column, order] = inside[order] & (ranks > least)
    return later


def _later_rows(window: int, anchor: int):
    """Over strings sorted by anchor: ``row, start, n`` of the windows that also begin earlier."""
    reach = window - anchor + 1

    def found(table: pa.Table) -> pa.RecordBatch:
        row, start, before, n = (table.column(c).to_numpy() for c in ("row", "start", "before", "n"))
        # Equal places have equal ranks: a row told twice is not earlier than itself.
        at = start + before
        order = np.lexsort((at, row))
        new = np.ones(len(order), bool)
        new[1:] = (row[order][1:] != row[order][:-1]) | (at[order][1:] != at[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        later = earlier_windows(table.column("string").to_pylist(), before, n, rank, window, reach)
        edge = np.zeros((reach + 1, len(row)), np.int8)
        edge[0], edge[1:-1], edge[-1] = later[0], later[1:].astype(np.int8) - later[:-1], -later[-1].astype(np.int8)
        string, begin = np.nonzero(edge.T == 1)
        _, end = np.nonzero(edge.T == -1)
        begin_at = start[string] + begin - (reach - 1 - before[string])
        return pa.RecordBatch.from_arrays([pa.array(row[string]), pa.array(begin_at), pa.array(end - begin)], ["row", "start", "n"])

    def task(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("name").to_numpy()
            cut = np.flatnonzero(names[1:] != names[:-1]) + 1
            if size and (held[-1].column("name")[-1].as_py() != names[0] or len(cut)):
                # What is held ends with the anchor of its last string.
                whole = 0 if held[-1].column("name")[-1].as_py() != names[0] else int(cut[0])
                if size >= STRINGS_AT_ONCE:
                    yield found(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                    held, size, batch = [], 0, batch.slice(whole)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if size:
            yield found(pa.Table.from_batches(held))

    return task


def _parted(strings: DataFrame, window: int, anchor: int) -> DataFrame:
    """Strings cut at every second column into pairs of windows, named by what both share."""
    reach = window - anchor + 1

    def task(batches):
        for batch in batches:
            out = []
            for name, row, start, before, n, string in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                first = reach - 1 - before
                t = 0
                while t < n:
                    wide = 1 if (first + t) % 2 or t + 1 == n else 2
                    core = string[t + 1 - (first + t) % 2 :][: window - 1]
                    key = xxhash.xxh3_64_intdigest(core, seed=(first + t) // 2) ^ (name & (2**64 - 1))
                    out.append((key - 2**63, row, start + t, before - t, wide, string[t : t + wide + window - 1]))
                    t += wide
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, batch.schema, strict=True)], schema=batch.schema)

    return strings.mapInArrow(task, strings.schema)


def _told_apart(strings: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Of equal strings the first one, and ``row, start, n`` of the others; both are written.

    Equal strings are counted by two hashes, combined before the shuffle, so a passage
    of very many documents goes on as one string.
    """
    one, two = text_hashes(F.col("string"))
    hashed = strings.select("*", one.alias("one"), two.alias("two"))
    first = hashed.groupBy("one", "two").agg(F.min(F.struct("row", "start")).alias("first"))
    first = cut_lineage(first.select("one", "two", F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start")), f"{label}-firsts")
    marked = hashed.join(first, ["one", "two"])
    is_first = (F.col("row") == F.col("first_row")) & (F.col("start") == F.col("first_start"))
    marked = cut_lineage(
        marked.select("name", "row", "start", "before", "n", F.when(is_first, F.col("string")).alias("string")), f"{label}-strings"
    )
    discard(first)
    others = marked.where("string is null").select("row", "start", "n")
    return marked.where("string is not null"), others


def _sorted_windows(strings: DataFrame, window: int, anchor: int) -> DataFrame:
    together = strings.repartition("name").sortWithinPartitions("name")
    return together.mapInArrow(_later_rows(window, anchor), "row long, start long, n long")


def numbered(docs: DataFrame) -> DataFrame:
    """``row, first, _id, _text_hash, _text_check``: a number for each id and text, in order.

    Numbers rise with the id, null ids first, then with the hashes of the text.
    ``first`` is the least number of an equal text.  Written, so numbers stay.
    """
    one, two = text_hashes(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), one.alias("_text_hash"), two.alias("_text_check"))
    ordered = rows.distinct().orderBy(F.col("_id").asc_nulls_first(), "_text_hash", "_text_check")
    ordered = cut_lineage(ordered.withColumn("row", F.monotonically_increasing_id()), "rows")
    first = ordered.groupBy("_text_hash", "_text_check").agg(F.min("row").alias("first"))
    return cut_lineage(ordered.join(first, ["_text_hash", "_text_check"]), "numbered")


def _with_numbers(docs: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    match = docs["doc_id"].cast("long").eqNullSafe(numbers["_id"])
    for hashed, name in zip(text_hashes(docs["text"]), ("_text_hash", "_text_check"), strict=True):
        match &= hashed == numbers[name]
    return docs.join(numbers, match, how).drop("_id", "_text_hash", "_text_check")


def later_windows(docs: DataFrame, numbers: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``row, start, n``: runs of windows that also begin earlier, of the first of equal texts.

    Only strings whose anchor is in another text or string go on; of these, equal ones
    are told apart by hashes and different ones are sorted.  An anchor in more than
    ``STRINGS_OF_ANCHOR`` different strings is cut into pairs of windows first, whose
    groups are bounded by the 65,536 pairs of bytes around what a pair shares.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    firsts = numbers.where("row = first").drop("first")
    texts = _with_numbers(source, firsts, "inner").where(F.octet_length("text") >= window)
    texts = cut_lineage(texts.select("row", F.col("text").cast("binary").alias("text")), "texts")
    anchors = cut_lineage(texts.mapInArrow(_anchor_rows(window, anchor), "name long, row long, at long"), "anchors")
    known = anchors.where("name is not null")
    shared = known.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("name")
    shared = cut_lineage(shared, "shared-anchors")
    wanted = known.join(shared, "name").select("row", "at").unionByName(anchors.where("name is null").select("row", "at"))
    wanted = cut_lineage(wanted.groupBy("row").agg(F.collect_list("at").alias("ats")), "wanted")
    discard(anchors, shared)
    kinds = "name long, row long, start long, before int, n int, string binary"
    strings = texts.join(wanted, "row").mapInArrow(_string_rows(window, anchor), kinds)
    strings = cut_lineage(strings, "strings")
    discard(texts, wanted)
    distinct, found = _told_apart(strings.where("string is not null"), "distinct")
    again = strings.where("string is null").select("row", "start", "n")
    sizes = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    sizes = cut_lineage(sizes, "anchor-sizes")
    crowded = distinct.join(sizes.where(F.col("k") > STRINGS_OF_ANCHOR).select("name"), "name", "left_semi")
    pairs, in_pairs = _told_apart(_parted(crowded.select(*distinct.columns), window, anchor), "pairs")
    usual = distinct.join(sizes.where(F.col("k") <= STRINGS_OF_ANCHOR).select("name"), "name", "left_semi")
    together = _sorted_windows(usual.unionByName(pairs), window, anchor)
    for more in (found, again, in_pairs):
        together = together.unionByName(more.select("row", "start", F.col("n").cast("long")))
    together = cut_lineage(together, "later-windows")
    discard(strings, distinct, sizes, pairs)
    return together


def remove_later(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with ``_n_bytes, _kept`` (binary) and ``_spans`` of the bytes that were removed.

    Texts are UTF-8 bytes, a null one is empty.  Each byte goes that a string of
    ``window`` bytes covers which also starts earlier: in a row of a smaller id, or
    before in the same text.  Null ids come first; rows of one id with different texts
    follow the order of their hashes; rows of equal id and text are one document, and
    all get its result.  Strings are judged on the input and never cross texts.
    ``_spans`` are maximal runs ``start, end`` in bytes, the end exclusive.  Of equal
    texts all but the first are removed whole, unless shorter than a window.  The
    added names are underscored, so none clashes.
    """
    numbers = numbered(docs)
    found = later_windows(docs, numbers, window, anchor)
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("_windows"))
    told = numbers.join(by_row, "row", "left").select(
        *[c for c in numbers.columns if c not in ("row", "first")], (F.col("row") != F.col("first")).alias("_copy"), "_windows"
    )
    told = cut_lineage(told, "windows-by-row")
    columns = docs.columns
    source = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = _with_numbers(source, told, "left").withColumn("_bytes", F.col("text").cast("binary"))

    def task(batches):
        for batch in batches:
            sizes, kept, spans = [], [], []
            for data, copy, own in zip(batch.column("_bytes"), batch.column("_copy"), batch.column("_windows"), strict=True):
                data = data.as_py()
                runs = [(0, len(data))] if copy.as_py() and len(data) >= window else covered(own, window)
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in runs])
                ends = [0, *[b for _, b in runs]]
                kept.append(b"".join(data[a:b] for a, b in zip(ends, [*[a for a, _ in runs], len(data)], strict=True)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            added = [pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *added], [*columns, "_n_bytes", "_kept", "_spans"])

    schema = source.select(*columns).schema.add("_n_bytes", "long").add("_kept", "binary")
    schema = schema.add("_spans", ArrayType(StructType([StructField(name, LongType()) for name in ("start", "end")])))
    return joined.select(*columns, "_bytes", "_copy", "_windows").mapInArrow(task, schema)


def covered(own: pa.Scalar, window: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes under runs of windows."""
    if not own.is_valid or not len(own.values):
        return []
    start = own.values.field("start").to_numpy(zero_copy_only=False)
    end = start + own.values.field("n").to_numpy(zero_copy_only=False) + window - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    return list(zip(start[new].tolist(), end[last].tolist(), strict=True))
