"""How the sources of a language differ in their words, by bitmaps of the terms at each count.

For each group (a language and a source) and each count there is a set of bits, one
for each term with that count.  The bits of two groups at two counts, and-ed and
counted, are the terms with these counts, which all differ by the same amount; terms
that a group lacks come out by complement.  Bitmaps are stored in words of 64 terms of
like frequency: rare terms have few counts, so a word has few rows.
"""

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicatlas.operators.lineage import cut_lineage

#: A term is kept that is in so many documents of its language.
LEAST_DOCUMENTS = 30
#: What is added to each count, and the whole that shares are parts of.
ADDED, WHOLE = 5, 1_000_000_000
TOP_TERMS = 50
#: Different terms a task counts before it hands them on.
COUNTED_AT_ONCE = 400_000

#: Letters and whatever is not ASCII, A to Z in lower case; all other bytes part terms.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, documents``: occurrences, and rows of ``docs`` with the term.

    A null language, source or text is an empty one.  Tasks count before the shuffle,
    so a source with a third of all rows sends no more than its different terms.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    texts = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def rows(counts: dict[tuple, Counter], held: dict[tuple, Counter]) -> pa.RecordBatch:
        lang, source, term, n, documents = [], [], [], [], []
        for group, counted in counts.items():
            lang += [group[0]] * len(counted)
            source += [group[1]] * len(counted)
            term += counted.keys()
            n += counted.values()
            documents += map(held[group].__getitem__, counted)
        terms = pa.array(term, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), terms, pa.array(n, pa.int64()), pa.array(documents, pa.int64())],
            ["lang", "source", "term", "n", "documents"],
        )

    def task(batches):
        counts: dict[tuple, Counter] = {}
        held: dict[tuple, Counter] = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                group = lang.as_py(), source.as_py()
                found = Counter(terms_of(text.as_py()))
                counts.setdefault(group, Counter()).update(found)
                held.setdefault(group, Counter()).update(found.keys())
            if sum(map(len, counts.values())) > COUNTED_AT_ONCE:
                yield rows(counts, held)
                counts, held = {}, {}
        yield rows(counts, held)

    counted = texts.mapInArrow(task, "lang string, source string, term string, n long, documents long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, total, word, bit``: terms in enough documents, numbered from the most frequent.

    ``word`` and ``bit`` are the place in the bitmaps.  Numbers are the places in an
    ordered table that is written, 64 to a word, so they need no window over a language.
    """
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("documents").alias("documents"))
    kept = kept.where(F.col("documents") >= least).drop("documents")
    place = F.monotonically_increasing_id()
    ordered = kept.orderBy("lang", F.desc("total"), "term").withColumn("place", place)
    return cut_lineage(
        ordered.select("lang", "term", "total", F.shiftright("place", 6).alias("word"), (F.col("place") % 64).cast("int").alias("bit")),
        "kept-terms",
    )


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(WHOLE * (count + ADDED) / (total + ADDED * terms))``, exact beyond 64 bits; null without terms."""
    whole = (count.cast("decimal(19,0)") + F.lit(ADDED)) * F.lit(WHOLE)
    parts = total.cast("decimal(19,0)") + terms.cast("decimal(18,0)") * F.lit(ADDED)
    return F.lit(1).cast("long") + F.call_function("div", whole, F.nullif(parts, F.lit(0).cast("decimal(19,0)")))


def bitmaps(counted: DataFrame) -> DataFrame:
    """``lang, source, n, word, bits``: the terms of a group with a count, a row a word of 64."""
    return counted.groupBy("lang", "source", "n", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def group_distances(maps: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value``: how far the shares of sources ``a < b`` of a language lie apart.

    ``maps`` are bitmaps with the share ``p`` of their count; ``groups`` are ``lang,
    source, terms`` and the share ``p0`` of a term a source lacks.  With z the distance
    where both lack a term, and g that where one does, a joint cell of k terms at
    distance f adds k * (f - g - g' + z) to what complement gives: z for each term, and
    g - z for each term of either side.
    """
    one = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "terms")
    two = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = one.join(two, "lang").where("a < b").withColumn("z", F.abs(F.col("a0") - F.col("b0")))
    lacking = pairs.select("lang", "a", "b", (F.col("terms") * F.col("z")).alias("value"))

    sizes = maps.groupBy("lang", "source", "p", "p0").agg(F.sum(F.bit_count("bits")).alias("k"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other0"))
    beside = sizes.join(others, "lang").where("source != other")
    one_sided = F.abs(F.col("p") - F.col("other0")) - F.abs(F.col("p0") - F.col("other0"))
    alone = beside.groupBy("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")).agg(
        F.sum(F.col("k") * one_sided).alias("value")
    )

    left = maps.select("lang", "word", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"), F.col("bits").alias("a_bits"))
    right = maps.select("lang", "word", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"), F.col("bits").alias("b_bits"))
    both = F.col("a_bits").bitwiseAND(F.col("b_bits"))
    cells = left.join(right, ["lang", "word"]).where((F.col("a") < F.col("b")) & (both != 0))
    apart = lambda x, y: F.abs(F.col(x) - F.col(y))
    joint = cells.groupBy("lang", "a", "b").agg(
        F.sum(F.bit_count(both) * (apart("pa", "pb") - apart("pa", "b0") - apart("a0", "pb") + apart("a0", "b0"))).alias("value")
    )
    parts = lacking.unionByName(alone).unionByName(joint)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of each language and source of ``docs``.

    Part ``pair``: each other source of the language with the sum of distances between
    the shares of all kept terms.  Part ``term``: the ``top`` terms whose share in the
    group is the furthest above that in the language.  Ranks go by value descending,
    then by name.  All arithmetic is exact.  Groups without kept terms are there; a
    language without any has distances of 0.  Rows that repeat count again.
    """
    counts = cut_lineage(term_counts(docs), "term-counts")
    kept = kept_terms(counts, least)
    counted = cut_lineage(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total", "word", "bit"), "counted")

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    languages = kept.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    groups = docs.select(*named).distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.na.fill(0, ["group_total", "lang_total", "terms"])
    groups = groups.withColumn("p0", F.coalesce(share(F.lit(0), F.col("group_total"), F.col("terms")), F.lit(0)))
    groups = cut_lineage(groups, "groups")

    maps = bitmaps(counted).join(groups.select("lang", "source", "group_total", "terms", "p0"), ["lang", "source"])
    maps = maps.select("lang", "source", "word", "bits", share(F.col("n"), F.col("group_total"), F.col("terms")).alias("p"), "p0")
    distances = group_distances(cut_lineage(maps, "bitmaps"), groups)
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = distances.select("lang", sides.alias("side"), "value").select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")

    shares = counted.join(groups.select("lang", "source", "group_total", "lang_total", "terms"), ["lang", "source"])
    above = share(F.col("n"), F.col("group_total"), F.col("terms")) - share(F.col("total"), F.col("lang_total"), F.col("terms"))
    term = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_pair = pair.withColumn("rank", F.row_number().over(order))
    ranked_term = term.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked_pair.unionByName(ranked_term)
