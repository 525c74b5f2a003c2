"""I-Match fingerprints: hashes of the distinct terms that lie in randomised parts of a lexicon."""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicatlas.llm.common import documents, per_document, slices, text_hashes
from topicatlas.operators.lineage import cut_lineage

#: The band of inverse document frequency, ln(documents / documents with the term).  Terms
#: in one of a thousand documents or more can be no more than a thousand times the mean
#: number of distinct terms of a document, so the lexicon does not grow with the corpus.
LEAST_IDF, MOST_IDF = 2.3, 6.9
#: A lexicon of more terms stays a table that texts are joined with; one of fewer goes to every task.
MOST_TERMS = 2_000_000
#: Of each random division of the lexicon into so many parts, so many parts are subsets.
#: The finer ones tell the likeness of longer texts.
DIVISIONS = ((2, 2), (8, 6), (32, 12), (128, 12), (512, 12), (2048, 8))
#: Documents of a range that one task pairs with their next, on average.
RANGE_DOCUMENTS = 4_000
MOST_RANGES = 20_000
#: Rows that one row of a repeated document stands for, at most, when it is multiplied.
REPEATS = 1 << 16
#: What a comparison gives for each document; ``times`` is how many rows it stands for.
COMPARED = (
    "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, times long"
)
COMPARED_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())


def terms(text: str) -> np.ndarray:
    """The sorted distinct terms of a text as hashes: words in lower case between white space."""
    words = set(text.lower().split())
    found = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    found.sort()
    return found


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``term, n``: in how many rows each term occurs; terms are hashes, so rows are short."""

    def task(batches):
        for batch in batches:
            for _, texts in slices(batch.column("text")):
                every = np.concatenate([terms(t) for t in texts])
                term, n = np.unique(every, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])

    partial = documents(docs).mapInArrow(task, "term long, n long")
    return partial.groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, most_terms: int = MOST_TERMS) -> np.ndarray | DataFrame:
    """The terms whose inverse document frequency lies in the band, sorted.

    More than ``most_terms`` of them stay a written table ``term``, which the tasks do
    not hold; the fingerprints are the same.
    """
    rows = documents(docs).count()
    least, most = rows * np.exp(-MOST_IDF), rows * np.exp(-LEAST_IDF)
    band = document_frequencies(docs).where((F.col("n") >= float(max(least, 2))) & (F.col("n") <= float(most))).select("term")
    band = cut_lineage(band, "lexicon")
    if band.count() > most_terms:
        return band
    return np.sort(np.array([r["term"] for r in band.toLocalIterator()], np.int64).view(np.uint64))


def subset_hashes(inside: np.ndarray, text: str) -> list[str]:
    """A hash for each subset of the lexicon, of the sorted terms ``inside`` it that a text has.

    The hash of no term is empty.  A text without any term of the lexicon is
    fingerprinted by all its terms, with one hash.
    """
    if not len(inside):
        return [hashlib.sha256(terms(text).tobytes()).hexdigest()[:16]]
    found = []
    for k, (parts, used) in enumerate(DIVISIONS):
        part = (inside * np.uint64(0x9E3779B97F4A7C15 + 2 * k) >> np.uint64(40)) % np.uint64(parts)
        for p in range(used):
            chosen = inside[part == p]
            found.append(f"{xxhash.xxh3_64_intdigest(chosen.tobytes(), k) & 0xFFFFFFFF:08x}" if len(chosen) else "")
    return found


def fingerprint(text: str, lexicon: np.ndarray) -> list[str]:
    """The hashes of a text for a lexicon that is at hand."""
    own = terms(text)
    at = np.searchsorted(lexicon, own)
    return subset_hashes(own[lexicon[np.minimum(at, len(lexicon) - 1)] == own] if len(lexicon) else own[:0], text)


def likeness(one: list[str], two: list[str]) -> float:
    """The share of equal hashes among those that are of some term in either text."""
    if len(one) != len(two):
        return 0.0
    used = [(a, b) for a, b in zip(one, two, strict=True) if a or b]
    return sum(a == b for a, b in used) / len(used)


def _joined_fingerprints(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``one, two, fingerprint`` of each distinct ``text``, told by two hashes; terms meet the lexicon in a join."""
    one, two = text_hashes(F.col("text"))
    own = texts.groupBy(one.alias("one"), two.alias("two")).agg(F.min("text").alias("text"))
    own = cut_lineage(own, "distinct-texts")

    def split(batches):
        for batch in batches:
            for row, text in enumerate(batch.column("text")):
                found = pa.array(terms(text.as_py()).view(np.int64))
                same = pa.array(np.full(len(found), row))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in ("one", "two")), found], ["one", "two", "term"])

    def hashes(batches):
        for batch in batches:
            found = []
            for text, inside in zip(batch.column("text"), batch.column("inside"), strict=True):
                inside = np.sort(np.array(inside.as_py() or [], np.int64).view(np.uint64))
                found.append(".".join(subset_hashes(inside, text.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column("one"), batch.column("two"), pa.array(found, pa.string())], ["one", "two", "fingerprint"])

    words = own.mapInArrow(split, "one long, two long, term long")
    inside = words.join(lexicon, "term").groupBy("one", "two").agg(F.collect_list("term").alias("inside"))
    inside = cut_lineage(inside, "terms-inside")
    return own.join(inside, ["one", "two"], "left").select("one", "two", "text", "inside").mapInArrow(hashes, "one long, two long, fingerprint string")


def fingerprints(docs: DataFrame, lexicon: np.ndarray | DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of each row of ``docs``; the hashes are joined by dots.

    A null text is an empty one.  Equal texts have equal fingerprints.
    """
    if isinstance(lexicon, DataFrame):
        one, two = text_hashes(F.col("text"))
        rows = documents(docs).select("doc_id", one.alias("one"), two.alias("two"))
        return rows.join(_joined_fingerprints(documents(docs), lexicon), ["one", "two"]).select("doc_id", "fingerprint")
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def one(texts: list[str]) -> dict:
        return {"fingerprint": [".".join(fingerprint(t, lexicon)) for t in texts]}

    return documents(docs).mapInArrow(per_document(one, schema), "doc_id long, fingerprint string")


def _places(doc_ids: pa.Array, hashes: pa.Array, cuts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The range of each row, in descending order of ids (null last), and the key that orders them.

    ``cuts`` are the sorted keys and hashes at which a range begins.
    """
    key = -doc_ids.fill_null(-(2**63 - 1)).to_numpy()
    at, end = np.searchsorted(cuts[0], key, side="left"), np.searchsorted(cuts[0], key, side="right")
    hashes = hashes.to_numpy()
    for k in np.unique(key[end > at]):
        own = np.flatnonzero(key == k)
        a, b = at[own[0]], end[own[0]]
        at[own] = a + np.searchsorted(cuts[1][a:b], hashes[own], side="right")
    return at, key


def with_next(docs: DataFrame, range_documents: int = RANGE_DOCUMENTS) -> tuple[DataFrame, bool]:
    """``doc_id, text, bin, ghost, copies``: rows in ranges of descending ids, and the row after each range.

    Ranges are cut at quantiles of the ids, an id of many rows at hashes of their texts.
    The first row of a range is also sent, as a ghost, to the range before it (the very
    first to the last), so each row finds its next row in its own range, and texts are
    shuffled once.  Null ids come last; rows of one id are in order of two hashes of
    their texts.  Rows that repeat id and text more often than a range has rows are one
    row with so many ``copies``; whether there are any is returned as well.  The driver
    holds one row per range and hot id, of at most ``MOST_RANGES``.
    """
    one, two = text_hashes(F.col("text"))
    source = documents(docs).withColumn("hash", one).withColumn("check", two)
    ids = cut_lineage(source.groupBy("doc_id", "hash", "check").agg(F.count(F.lit(1)).alias("copies")), "document-ids")
    rows = ids.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    n = min(MOST_RANGES, max(1, rows // range_documents))
    most = max(range_documents, rows // MOST_RANGES)
    hot = ids.where(F.col("copies") > most)
    repeated = bool(hot.limit(1).count())
    left = F.when(F.col("copies") > most, 1).otherwise(F.col("copies"))
    hot_ids = ids.groupBy("doc_id").agg(F.sum(left).alias("n")).where(F.col("n") > 2 * most).collect()

    known = source.where("doc_id is not null")
    steps = known.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    least_hash = -(2**63)
    places = {(-int(c), least_hash) for c in steps}
    for row in hot_ids:
        key = 2**63 - 1 if row["doc_id"] is None else -row["doc_id"]
        parts = -(-row["n"] // most)
        places |= {(key, least_hash + p * (2**64 // parts)) for p in range(parts)}
        if key < 2**63 - 1:
            places.add((key + 1, least_hash))
    cuts = tuple(np.array([c[k] for c in sorted(places)], np.int64) for k in (0, 1))

    def keys(batches):
        for batch in batches:
            at, key = _places(batch.column("doc_id"), batch.column("hash"), cuts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(key), batch.column("hash"), batch.column("check")], ["bin", "key", "hash", "check"])

    ordered = ids.select("doc_id", "hash", "check").mapInArrow(keys, "bin long, key long, hash long, check long")
    least = ordered.groupBy("bin").agg(F.min(F.struct("key", "hash", "check")).alias("first")).collect()
    firsts = {r["bin"]: tuple(r["first"]) for r in least}
    bins = sorted(firsts)
    before = {b: bins[k - 1] for k, b in enumerate(bins)}

    if repeated:
        same = [F.col(f"d.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("doc_id", "hash", "check")]
        few = F.broadcast(hot).alias("h")  # fewer than MOST_RANGES rows
        once = source.alias("d").join(few, same, "left_anti").withColumn("copies", F.lit(1).cast("long"))
        many = source.alias("d").join(few, same).select("d.*", "h.copies")
        many = many.groupBy("doc_id", "hash", "check", "copies").agg(F.min("text").alias("text"))
        source = once.unionByName(many)
    else:
        source = source.withColumn("copies", F.lit(1).cast("long"))
    columns = ("doc_id", "text", "hash", "check", "copies")

    def deal(batches):
        for batch in batches:
            at, key = _places(batch.column("doc_id"), batch.column("hash"), cuts)
            names = zip(at.tolist(), key.tolist(), batch.column("hash").to_pylist(), batch.column("check").to_pylist(), strict=True)
            first = [firsts[b] == tuple(name) for b, *name in names]
            own = np.concatenate([np.arange(len(at)), np.flatnonzero(first)])
            ghost = np.arange(len(own)) >= len(at)
            to = np.array([before[b] if g else b for b, g in zip(at[own].tolist(), ghost.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(own)) for c in columns), pa.array(to), pa.array(ghost), pa.array(key[own])],
                [*columns, "bin", "ghost", "key"],
            )

    kinds = "doc_id long, text string, hash long, check long, copies long, bin long, ghost boolean, key long"
    dealt = source.select(*columns).mapInArrow(deal, kinds)
    dealt = dealt.repartition(max(1, len(bins)), "bin").sortWithinPartitions("bin", "ghost", "key", "hash", "check")
    return dealt.select("doc_id", "text", "bin", "ghost", "copies"), repeated


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by as many characters of ``after``, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _followed(batches, value):
    """``doc_id, text, value, next text, its value, times`` of the rows that ``with_next`` dealt.

    All copies of a row but one are followed by a copy.
    """
    before, bin_of, done = None, None, False
    for batch in batches:
        columns = (batch.column(c) for c in ("doc_id", "text", "bin", "ghost", "copies"))
        for row in zip(*columns, strict=True):
            doc_id, text, b, ghost, copies = (x.as_py() for x in row)
            if b != bin_of:
                before, bin_of, done = None, b, False
            if done:
                continue
            own = value(text)
            if before:
                *known, n = before
                yield (*known, text, own, 1)
                if n > 1:
                    yield (*known, *known[1:], n - 1)
            before, done = (doc_id, text, own, copies), ghost


def _in_batches(rows, names, kinds, size_of):
    """Record batches of some two million characters each."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += size_of(row)
        if size > 2_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


COMPARED_NAMES = [c.split()[0] for c in COMPARED.split(", ")]


def _compared_by_joins(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The comparison with a lexicon that no task holds: fingerprints of distinct texts are joined by their hashes."""

    def pair(batches):
        found = ((d, t, edited(t, a), a, times) for d, t, _, a, _, times in _followed(batches, lambda text: None))
        names, kinds = ["doc_id", "text", "edited", "after", "times"], [pa.int64(), *[pa.string()] * 3, pa.int64()]
        yield from _in_batches(found, names, kinds, lambda r: 3 * len(r[1]) + len(r[3]))

    pairs = rows.mapInArrow(pair, "doc_id long, text string, edited string, after string, times long")
    keys = [h.alias(f"{c}_{k}") for c in ("text", "edited", "after") for k, h in zip(("one", "two"), text_hashes(F.col(c)), strict=True)]
    pairs = cut_lineage(pairs.select("doc_id", "times", "text", "edited", F.char_length("text").cast("long").alias("n_chars"), *keys), "pairs")
    prints = _joined_fingerprints(pairs.select("text").union(pairs.select(F.col("edited").alias("text"))), lexicon)
    prints = cut_lineage(prints, "fingerprints")
    joined = pairs.drop("text")
    for c in ("text", "edited", "after"):
        own = prints.select(F.col("one").alias(f"{c}_one"), F.col("two").alias(f"{c}_two"), F.col("fingerprint").alias(f"{c}_print"))
        joined = joined.join(own, [f"{c}_one", f"{c}_two"])

    def like(batches):
        for batch in batches:
            own, other, after = ([x.as_py().split(".") for x in batch.column(f"{c}_print")] for c in ("text", "edited", "after"))
            near = [pa.array([likeness(a, b) for a, b in zip(own, two, strict=True)], pa.float64()) for two in (other, after)]
            columns = [batch.column(c) for c in ("doc_id", "n_chars", "edited", "text_print", "edited_print")]
            yield pa.RecordBatch.from_arrays([*columns, *near, batch.column("times")], COMPARED_NAMES)

    return joined.mapInArrow(like, COMPARED)


def _multiplied(found: DataFrame) -> DataFrame:
    """Each row as often as it says; by parts, dealt over tasks, so no array holds all copies."""
    found = cut_lineage(found, "compared")
    parts = found.where("times > 1").withColumn("part", F.explode(F.expr(f"sequence(0L, (times - 1) div {REPEATS})")))
    parts = parts.withColumn("times", F.least(F.lit(REPEATS), F.col("times") - F.col("part") * REPEATS)).repartition("doc_id", "part")
    rows = parts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return found.where("times = 1").unionByName(rows.drop("part", "copy")).drop("times")


def compare_with_next(docs: DataFrame, lexicon: np.ndarray | DataFrame, range_documents: int = RANGE_DOCUMENTS) -> DataFrame:
    """Each row of ``docs`` with fingerprints of its text and its edited text, and what they are like.

    The next document is that of the next lower id, after the last the first; a lone
    document is its own next.  Rows that repeat an id are next to each other, in order
    of hashes of their texts.
    """
    rows, repeated = with_next(docs, range_documents)
    if isinstance(lexicon, DataFrame):
        found = _compared_by_joins(rows, lexicon)
    else:

        def row(doc_id, text, own, after, next_own, times):
            changed = edited(text, after)
            other = own if changed == text else fingerprint(changed, lexicon)
            return (doc_id, len(text), changed, ".".join(own), ".".join(other), likeness(own, other), likeness(own, next_own), times)

        def task(batches):
            found = (row(*r) for r in _followed(batches, lambda text: fingerprint(text, lexicon)))
            yield from _in_batches(found, COMPARED_NAMES, COMPARED_TYPES, lambda r: r[1])

        found = rows.mapInArrow(task, COMPARED)
    return _multiplied(found) if repeated else found.drop("times")
