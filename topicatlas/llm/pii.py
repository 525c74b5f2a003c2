"""Personal data by patterns, and by contexts that such data bootstraps."""

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicatlas.llm.common import documents, per_document
from topicatlas.operators.lineage import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring patterns by instances and instances by patterns.
ROUNDS = 3
#: What a pattern needs to extract: different seed instances, and its score.
LEAST_SEEDS, LEAST_SCORE = 3, 0.6

# Fixed patterns of the base spans.  Those of digits begin where a run of them does;
# any later beginning fails or succeeds with it.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What parts the words of a text and the fields of a record.
PARTS = r"\s\"'`,;=<>(){}\[\]|"
WORD = re.compile(rf"[^{PARTS}]+")
#: What looks like an identifier: groups of digits over single spaces or dashes, after a
#: few letters or not, or else a word that holds a digit or an at sign.
LOOKS = re.compile(
    rf"(?<![^{PARTS}])(?:[A-Za-z]{{0,4}}[0-9]+(?:[\x20-][0-9]+)+(?=[{PARTS}.:!?]|\Z)|(?=[^{PARTS}]*[0-9@])[^{PARTS}]+)"
)
EDGES = ".:!?"
#: An identifier has so many characters at least.
LEAST_CHARS = 5
#: Longer words stand in patterns, and longer identifiers in the graph, by their hash.
LONG = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text.

    The part before an at sign holds none, so each at sign is looked at once: the
    local part is the run before it, as far as the last match or at sign.
    """
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = free + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        free = at + 1
        if domain:
            found.append((begin, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the base spans, by start and then kind."""
    found = [(a, b, "email") for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _short(value: str) -> str:
    """The value, or of a long one a hash: what it is compared by, not what it is cut to."""
    return value if len(value) <= LONG else hashlib.md5(value.encode("utf-8", "surrogatepass")).hexdigest()


def _word(word: str) -> str:
    return _short("".join("0" if c.isdigit() else c for c in word.strip(EDGES).lower()))


def patterns(left: list[str], right: str) -> list[str]:
    """The lexical patterns of a span between words: the words before it, after it, and both."""
    found = []
    if left:
        found.append(f"{left[-1]} _")
    if len(left) == 2:
        found.append(f"{left[0]} {left[1]} _")
    if right:
        found.append(f"_ {right}")
    if left and right:
        found.append(f"{left[-1]} _ {right}")
    return found


def neighbours(text: str, found: list[tuple[int, int]]) -> list[list[str]]:
    """The patterns of spans in a text: up to two words before each, the nearest last, and one after.

    Words that a span touches are none of its neighbours, and those of punctuation alone
    are passed over, however far the next one is.
    """
    if not found:
        return []
    words = [(m.start(), m.end(), w) for m in WORD.finditer(text) if (w := _word(m[0]))]
    ends, starts = [w[1] for w in words], [w[0] for w in words]
    out = []
    for a, b in found:
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        out.append(patterns([w[2] for w in words[max(0, i - 2) : i]], words[j][2] if j < len(words) else ""))
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What looks like an identifier between the base spans, which part a run as quotes and commas do."""
    found, last = [], 0
    for a, b in [*((a, b) for a, b, _ in base), (len(text), len(text))]:
        gap = text[last:a] if last or a < len(text) else text
        for m in LOOKS.finditer(gap):
            value = m[0].strip(EDGES)
            if len(value) >= LEAST_CHARS and any(c.isdigit() or c == "@" for c in value):
                begin = last + m.start() + m[0].index(value)
                found.append((begin, begin + len(value)))
        last = max(last, b)
    return found


def occurrences(text: str) -> list[dict]:
    """Base spans, and beside them what else looks like an identifier, with their patterns."""
    base = base_spans(text)
    others = candidates(text, base)
    around = neighbours(text, [(a, b) for a, b, _ in base] + others)
    kinds = [kind for *_, kind in base] + [None] * len(others)
    return [
        {"start": a, "end": b, "kind": kind, "instance": _short(text[a:b] if kind else text[a:b].lower()), "patterns": own}
        for (a, b), kind, own in zip([(a, b) for a, b, _ in base] + others, kinds, around, strict=True)
    ]


def _scored_patterns(seen: DataFrame) -> DataFrame:
    """``pattern, kind, score`` of the patterns that may extract.

    ``seen`` has a row per occurrence with ``instance, kind, patterns``.  Patterns
    and instances form a graph of distinct edges.  A seed instance has the score 1
    for its kind.  In each round a pattern's score is the mean score of its
    instances, and an instance's score one minus the product of what its patterns
    leave open; only patterns of enough different seeds take part.
    """
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", F.coalesce("kind", F.lit("")).alias("seed"))
    edges = cut_lineage(edges.distinct(), "pattern-edges")
    size = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("size"))
    fit = edges.where("seed != ''").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count(F.lit(1)).alias("seeds"))
    fit = cut_lineage(fit.where(F.col("seeds") >= LEAST_SEEDS).join(size, "pattern"), "patterns")
    seeds = edges.where("seed != ''").select("instance", F.col("seed").alias("kind")).distinct()
    unknown = edges.where("seed = ''").select("pattern", "instance")
    score = fit.withColumn("score", F.col("seeds") / F.col("size"))
    for _ in range(ROUNDS - 1):
        reached = unknown.join(score.select("pattern", "kind", "score"), "pattern")
        open_ = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999))))
        found = reached.groupBy("instance", "kind").agg((1 - F.exp(open_)).alias("own"))
        found = found.join(seeds, ["instance", "kind"], "left_anti")
        more = unknown.join(found, "instance").groupBy("pattern", "kind").agg(F.sum("own").alias("more"))
        score = fit.join(more, ["pattern", "kind"], "left").withColumn(
            "score", F.least(F.lit(1.0), (F.col("seeds") + F.coalesce("more", F.lit(0.0))) / F.col("size"))
        )
        score = cut_lineage(score.select("pattern", "kind", "seeds", "size", "score"), "pattern-scores")
    return score.where(F.col("score") >= LEAST_SCORE).select("pattern", "kind", "score")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, found`` of each row of ``docs``: arrays of structs of start, end and kind.

    ``base`` are the spans of the fixed patterns; a null or empty text has none.
    ``found`` are the others: what looks like an identifier (groups of digits, or a word
    with a digit or an at sign, of any length from five characters on), overlaps no base
    span and stands in a pattern of high confidence, under the kind ``context_`` and that
    of the seeds (the best pattern decides, at equal scores the first kind by name).
    Texts are read once; the graph is built from the identifiers in them.
    """
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    schema = pa.schema([("doc_id", pa.int64()), ("seen", pa.list_(span))])

    def one(texts: list[str]) -> dict:
        return {"seen": [occurrences(t) for t in texts]}

    columns = "doc_id long, seen array<struct<start:int,end:int,kind:string,instance:string,patterns:array<string>>>"
    read = documents(docs).mapInArrow(per_document(one, schema), columns)
    read = cut_lineage(read.withColumn("row", F.monotonically_increasing_id()), "identifiers")
    seen = read.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    good = cut_lineage(_scored_patterns(seen), "good-patterns")
    open_ = seen.where("kind is null").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    best = open_.join(good, "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("score", F.col("kind"))).alias("best"))
    found = best.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", F.concat(F.lit("context_"), F.col("best.kind")).alias("kind")))).alias("found")
    )
    found = cut_lineage(found, "found-in-context")
    base = F.transform(
        F.filter("seen", lambda s: s["kind"].isNotNull()),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    joined = read.join(found, "row", "left")
    return joined.select("doc_id", base.alias("base"), F.coalesce("found", nothing).alias("found"))


def in_text(spans):
    """Spans in the text form ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def merged(base, found):
    """Both lists by start; base spans that begin together keep their order."""
    numbered = lambda spans, k: F.transform(
        spans, lambda s, i: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), i.alias("i"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.sort_array(F.concat(numbered(base, 0), numbered(found, 1)))
