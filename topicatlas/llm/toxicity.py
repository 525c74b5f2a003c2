"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicatlas.llm import crf
from topicatlas.llm.common import documents, excerpts, per_document, slices
from topicatlas.operators.lineage import cut_lineage

#: Bounds of the sample the field is fitted on: toxic and clean documents, characters of each (of a
#: longer text an excerpt is taken), and characters of all toxic and of all clean ones.
SAMPLE_DOCUMENTS = {1: 800, 0: 3_200}
SAMPLE_CHARS = 20_000
SAMPLE_TOTAL = {1: 4_000_000, 0: 14_000_000}
#: Documents of this remainder of crc32(doc_id as text) are never learned from.
HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.3
#: Distinct words whose scores a task remembers before it starts anew.  A partition holds hundreds of
#: thousands, most of them once, and each costs 200 bytes in every task at a time.
REMEMBERED = 100_000
#: Characters scored at a time; a longer text is a slice of its own.
SCORED_CHARS = 500_000

TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
BREAKS = frozenset(".!?\n")


def fold(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def own_features(word: str) -> list[str]:
    w = word.lower()
    if len(word) > 1 and word.isupper():
        shape = "s=caps"
    else:
        shape = "s=digit" if not word.isalpha() and any(map(str.isdigit, word)) else "s=plain"
    return ["w=" + w, shape, "e=" + w[-3:], *["p=" + w[:k] for k in range(3, min(9, len(w)))]]


def near_features(word: str) -> list[str]:
    return [word[:5].lower()]


class Sample:
    """Tokens of some texts as numbers, in chains that end with a sentence or line."""

    def __init__(self, texts: list[str]):
        self.kind: dict[str, int] = {}
        tokens, sizes, lengths = array("i"), [], []
        for text in texts:
            run, before = 0, len(tokens)
            for token in TOKEN.findall(text):
                if token in BREAKS:
                    if run:
                        lengths.append(run)
                    run = 0
                else:
                    tokens.append(self.kind.setdefault(token, len(self.kind)))
                    run += 1
            if run:
                lengths.append(run)
            sizes.append(len(tokens) - before)
        self.token = np.array(tokens, np.int32)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.array(sizes, np.int64))
        self.length = np.array(lengths, np.int64)
        self.n_docs = len(texts)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, the kinds before and after it in its chain; -1 at the ends."""
        begin = np.cumsum(self.length) - self.length
        before, after = np.roll(self.token, 1), np.roll(self.token, -1)
        before[begin] = -1
        after[begin + self.length - 1] = -1
        return before, after


def telling_features(sample: Sample, toxic: np.ndarray, weight: float = 1.0, least: int = 4, precision: float = 0.9) -> set[str]:
    """Words and word beginnings that mark toxic documents.

    Chosen greedily by how many toxic documents they explain that none before does,
    at equal numbers the longer; of the documents that hold one, a share of at least
    ``precision`` must be toxic, where a clean one counts ``weight``-fold.  Words in one of a hundred toxic documents, and in
    hardly a clean one, are chosen whatever else explains these documents.
    """
    words = list(sample.kind)
    n = max(len(words), 1)
    both = np.unique(sample.doc.astype(np.int64) * n + sample.token)
    doc, kind = (both // n).astype(np.int32), (both % n).astype(np.int32)
    del both
    in_toxic = np.unique(kind[toxic[doc] == 1])
    number: dict[str, int] = {}
    marks: dict[int, list[int]] = {}
    for k in in_toxic.tolist():
        marks[k] = [number.setdefault(f, len(number)) for f in own_features(words[k]) if f[0] in "wp"]
    for k, word in enumerate(words):
        if k not in marks:
            fs = [number[f] for f in own_features(word) if f in number]
            if fs:
                marks[k] = fs
    # Which feature is in which document, each pair once, as sorted numbers.
    count = np.zeros(n, np.int64)
    count[list(marks)] = [len(fs) for fs in marks.values()]
    begin = np.cumsum(count) - count
    flat = np.array([f for k in sorted(marks) for f in marks[k]], np.int64)
    del marks
    times = count[kind]
    inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    pairs = flat[np.repeat(begin[kind], times) + inner] * max(sample.n_docs, 1) + np.repeat(doc, times)
    del inner, times, kind, doc
    pairs = np.unique(pairs)
    feature, doc = pairs // max(sample.n_docs, 1), pairs % max(sample.n_docs, 1)
    del pairs
    is_bad = toxic[doc] == 1
    good = np.bincount(feature[is_bad], minlength=len(number))
    share = good / np.maximum(good + weight * np.bincount(feature[~is_bad], minlength=len(number)), 1e-9)
    feature, doc = feature[is_bad], doc[is_bad]
    held = np.searchsorted(feature, np.arange(len(number) + 1))
    docs_of = lambda f: doc[held[number[f]] : held[number[f] + 1]]
    heap = [(-int(good[k]), -len(f), f) for f, k in number.items() if good[k] >= least and share[k] >= precision]
    heapq.heapify(heap)
    chosen, explained = set(), np.zeros(sample.n_docs, bool)
    while heap:
        _, _, f = heapq.heappop(heap)
        new = int((~explained[docs_of(f)]).sum())
        if new < least:
            continue
        if heap and (-new, -len(f), f) > heap[0]:
            heapq.heappush(heap, (-new, -len(f), f))
            continue
        chosen.add(f)
        explained[docs_of(f)] = True
    often = max(5 * least, (toxic == 1).sum() / 100)
    return chosen | {f for f, k in number.items() if f[0] == "w" and good[k] >= often and share[k] >= 0.98}


class Model:
    """Scores of words, by themselves and beside others, moves, and the weights of the document score."""

    def __init__(self, own: dict, before: dict, after: dict, moves: np.ndarray, document: np.ndarray):
        self.own, self.before, self.after, self.moves, self.document = own, before, after, moves, document

    def word_scores(self, word: str) -> tuple[float, float, float]:
        own, near = self.own, near_features(word)
        return (
            own.get("bias", 0.0) + sum([own.get(f, 0.0) for f in own_features(word)]),
            sum([self.before.get(f, 0.0) for f in near]),
            sum([self.after.get(f, 0.0) for f in near]),
        )


def document_features(log_odds: np.ndarray, doc: np.ndarray, n_docs: int, times: np.ndarray | float = 1.0) -> np.ndarray:
    """Per document: one, the greatest marginal as log odds, and the expected toxic tokens (log).

    ``times`` is how many texts of its length an excerpt stands for.
    """
    top = np.full(n_docs, -12.0)
    np.maximum.at(top, doc, np.clip(log_odds, -12, 12))
    expected = np.bincount(doc, 1 / (1 + np.exp(-np.clip(log_odds, -30, 30))), n_docs)
    return np.stack([np.ones(n_docs), top / 4, np.log1p(expected * times)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w)
    return w


def fit(texts: list[str], toxic: list[int], calibrate: list[bool], weight: float = 1.0, times: list[float] | None = None) -> Model:
    """A model from labelled texts; those of ``calibrate`` set the document score alone.

    ``weight`` is how many clean documents each clean one of the sample stands for,
    if a toxic one stands for one; ``times`` the length of each whole text, if that of
    its excerpt is one.
    """
    y, later = np.array(toxic, np.int64), np.array(calibrate, bool)
    early = np.flatnonzero(~later)
    sample = Sample([texts[i] for i in early])
    told = telling_features(sample, y[early], weight)
    marked = np.fromiter((not told.isdisjoint(own_features(w)) for w in sample.kind), bool, len(sample.kind))
    label = (marked[sample.token] if len(sample.token) else np.zeros(0, bool)) & (y[early][sample.doc] == 1)
    chain = np.repeat(np.arange(len(sample.length)), sample.length)
    with_toxic = np.bincount(chain, label, len(sample.length)) > 0 if len(chain) else np.zeros(0, bool)
    others = np.flatnonzero(~with_toxic)
    n_others = max(2 * int(with_toxic.sum()), 2000)
    use = with_toxic.copy()
    use[others[:: max(1, len(others) // n_others)]] = True
    on = use[chain]
    before, after = sample.neighbours()
    token, label, sides = sample.token[on], label[on], (before[on], after[on])
    lengths = sample.length[use]
    words = list(sample.kind)
    del chain, before, after, sample
    # Only the words of the chains learned from get features.
    kinds = np.unique(np.concatenate([token, *sides]))
    kinds = kinds[kinds >= 0]
    place = np.zeros(len(words) + 1, np.int32)
    place[kinds] = np.arange(len(kinds))
    names: dict[tuple[str, str], int] = {}
    own, near = array("i"), array("i")
    counts = np.zeros(len(kinds), np.int64)
    for i, k in enumerate(kinds.tolist()):
        fs = ["bias", *own_features(words[k])]
        counts[i] = len(fs)
        own.extend(names.setdefault(("own", f), len(names)) for f in fs)
        near.extend(names.setdefault((s, f), len(names)) for f in near_features(words[k]) for s in ("before", "after"))
    flat, table = np.array(own, np.int32), np.array(near, np.int32).reshape(-1, 2)
    del own, near, words
    begin = np.cumsum(counts) - counts
    at_kind = place[token]
    count = counts[at_kind]
    at = np.repeat(np.arange(len(token), dtype=np.int32), count)
    inner = np.arange(len(at), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
    features = [[at, flat[begin[at_kind][at] + inner]]]
    del inner
    for k, side in enumerate(sides):
        there = np.flatnonzero(side >= 0).astype(np.int32)
        features.append([there, table[place[side[there]], k]])
    weights, moves = crf.fit(features, len(names), label.astype(np.int64), lengths, 2)
    tables: dict[str, dict] = {"own": {}, "before": {}, "after": {}}
    for (side, f), k in names.items():
        if abs(weights[k, 1]) > 1e-3:
            tables[side][f] = float(weights[k, 1])
    model = Model(tables["own"], tables["before"], tables["after"], moves, np.zeros(3))
    for_score = np.flatnonzero(later) if later.sum() >= 20 else np.arange(len(y))
    odds, doc = Scorer(model).odds([texts[i] for i in for_score])
    scale = 1.0 if times is None else np.array(times)[for_score]
    model.document = logistic(document_features(odds, doc, len(for_score), scale), y[for_score], np.where(y[for_score] == 1, 1.0, weight))
    return model


class Scorer:
    """Marginals of the tokens of texts; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model, self.kind, self.scores = model, {}, array("d")

    def odds(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of being toxic for each token, and the text each belongs to."""
        if len(self.kind) > REMEMBERED:
            self.kind, self.scores = {}, array("d")
        kind, scores = self.kind, self.scores
        rows, sizes = array("i"), []
        for text in texts:
            found = TOKEN.findall(text)
            for word in set(found).difference(kind):
                kind[word] = len(kind)
                scores.extend((0.0, 0.0, 0.0) if word in BREAKS else self.model.word_scores(word))
            rows.extend(map(kind.__getitem__, found))
            sizes.append(len(found))
        ends = {kind[b] for b in BREAKS if b in kind}
        token, doc = np.array(rows, np.int32), np.repeat(np.arange(len(texts)), sizes)
        stop = np.isin(token, list(ends))
        chain = np.cumsum(stop) + doc
        token, doc, chain = token[~stop], doc[~stop], chain[~stop]
        if not len(token):
            return np.zeros(0), doc
        table = np.array(scores).reshape(-1, 3)
        own, before, after = table[token].T
        new = np.append(True, chain[1:] != chain[:-1])
        score = own.copy()
        score[1:] += np.where(new[1:], 0, before[:-1])
        score[:-1] += np.where(new[1:], 0, after[1:])
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(token)))
        return crf.token_marginals(score, self.model.moves, crf.Chains(lengths)), doc

    def score(self, texts: list[str]) -> dict:
        odds, doc = self.odds(texts)
        x = document_features(odds, doc, len(texts)) @ self.model.document
        spans = [[] for _ in texts]
        hot = odds > 0
        for d in np.unique(doc[hot]).tolist():
            flags = hot[doc == d]
            words = (m for m in TOKEN.finditer(texts[d]) if m[0] not in BREAKS)
            spans[d] = [{"start": m.start(), "end": m.end()} for m, flag in zip(words, flags, strict=True) if flag]
        return {"score": 1 / (1 + np.exp(-np.clip(x, -30, 30))), "spans": spans}


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of a bounded sample; none of an empty table.

    Of either label the first documents by a hash of their id are taken, none held
    out, and of a text over ``SAMPLE_CHARS`` an excerpt that counts as the whole.  The
    ids are chosen from the labels of ids in ``docs`` and broadcast, at most twice the
    bound of them, so texts are not shuffled.  A document with several labels is toxic
    if one says so; rows that repeat a text count once.  Documents without a toxic and
    a clean label among them are an error.
    """
    marks = labels.where("doc_id is not null and toxic is not null")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    marks = marks.where(fold(F.col("doc_id")) != HELD_OUT)
    marks = marks.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    marks = cut_lineage(marks, "toxic-marks")
    counts = {r["_toxic"]: r["count"] for r in marks.groupBy("_toxic").count().collect()}
    texts: dict[int, dict[str, float]] = {}
    for label, bound in SAMPLE_DOCUMENTS.items():
        ids = marks.where(F.col("_toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * bound)
        found = documents(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.char_length("text").alias("chars"))
        found = excerpts(found, SAMPLE_CHARS).distinct()
        found = found.withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id", "text", "chars").limit(bound)
        # Rows within the bounds are few; those beyond the bound of all characters are not collected.
        before = W.orderBy("_order", "doc_id", "text", "chars").rowsBetween(W.unboundedPreceding, W.currentRow)
        found = found.withColumn("_size", F.sum(F.char_length("text")).over(before)).where(F.col("_size") <= SAMPLE_TOTAL[label])
        rows = found.select("text", "chars").collect()
        texts[label] = {r["text"]: max(1.0, r["chars"] / max(1, len(r["text"]))) for r in rows}
    if not texts[0] or not texts[1]:
        if docs.limit(1).count():
            raise ValueError("no model: the documents to learn from need toxic and clean labels")
        return None
    whole = sorted(texts[1]) + sorted(texts[0])
    toxic = [1] * len(texts[1]) + [0] * len(texts[0])
    times = [texts[y][t] for t, y in zip(whole, toxic, strict=True)]
    weight = (counts[0] / len(texts[0])) / (counts[1] / len(texts[1]))
    return fit(whole, toxic, [i % 4 == 3 for i in range(len(whole))], weight, times)


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` of each row of ``docs``.

    ``score`` is between 0 and 1 and comes from the marginals of all tokens of the
    whole text; ``spans`` are the offsets, in characters, of the tokens that are
    likelier toxic than not.  An empty or null text has no token and the score of
    none; without a model every score is 0.  Equal texts have equal scores.
    """
    columns = "doc_id long, score double, spans array<struct<start:int,end:int>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", span)])

    def run(batches):
        if model is None:
            one = lambda texts: {"score": [0.0] * len(texts), "spans": [[] for _ in texts]}
        else:
            one = Scorer(model).score
        yield from per_document(one, schema, SCORED_CHARS)(batches)

    scored = documents(docs).mapInArrow(run, columns)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "spans",
    )


def clean_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, all columns kept."""

    def run(batches):
        scorer = Scorer(model) if model else None
        for batch in batches:
            if scorer is None:
                yield batch
                continue
            keep = np.zeros(batch.num_rows, bool)
            for start, texts in slices(batch.column("text"), SCORED_CHARS):
                keep[start : start + len(texts)] = scorer.score(texts)["score"] < THRESHOLD
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
