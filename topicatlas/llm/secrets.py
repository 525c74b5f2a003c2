"""Secrets by patterns and by a linear-chain conditional random field over tokens."""

import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicatlas.llm import crf, spans
from topicatlas.llm.common import documents, excerpts, per_document, slices

KINDS = ("assign", "access", "hex", "tagged")
#: Bounds of the sample the field is fitted on: documents that may hold a secret, as
#: many others, and the characters of each; of a longer text an excerpt is taken.
SAMPLE_DOCUMENTS = 1_000
SAMPLE_CHARS = 20_000
#: A tagged span has so many characters at least, as the value of an assignment has.
LEAST_CHARS = 8
REMEMBERED = 400_000
#: Lines are learned from in parts of so many tokens at most.
FIT_TOKENS = 32
#: Steps of the hash that deals texts into the sample.
DEAL = 1 << 40
MASK = "[SECRET]"

# Fixed patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"[\w+/.-]+|\n|[^\w\s+/.-]")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
HEX_DIGITS = "0123456789abcdef"


def base_spans(text: str) -> list[spans.Span]:
    """Leftmost non-overlapping matches of each kind; matches that fail its length are dropped."""
    found: list[spans.Span] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans.in_order(found, KINDS)


def values(text: str) -> list[tuple[int, int]]:
    """The secrets themselves: the value of an assignment, whole keys, whole numbers."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [m.span() for m in HEX.finditer(text)]


def shape(token: str) -> str:
    """The kinds of characters in order, runs once, at most eight of them."""
    if token.isalpha():
        if token.islower():
            return "a"
        if token[0].isupper() and token[1:].islower():
            return "Aa"
    kinds = []
    for c in token[:64]:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not kinds or kinds[-1] != k:
            kinds.append(k)
    return "".join(kinds[:8])


def is_mixed(form: str) -> bool:
    return "9" in form and ("a" in form or "A" in form)


def form_features(form: str, size: int, mixed: bool) -> list[str]:
    """What follows from the shape and size of a token."""
    return ["bias", f"shape={form}", f"size={size}", f"mixed={mixed},{size}", f"turns={min(len(form), 6)},{mixed}"]


def kind_features(only_hex: bool, various: int, mixed: bool) -> list[str]:
    return [f"hex={only_hex}", f"various={various},{mixed}"]


def own_features(token: str, form: str) -> list[str]:
    mixed, only_hex = is_mixed(form), len(token) > 7 and not token.strip(HEX_DIGITS)
    features = form_features(form, min(len(token) // 4, 10), mixed)
    return features + kind_features(only_hex, min(len(set(token)) // 3, 8), mixed) + [f"start={token[:4]}"]


def near_features(token: str, form: str) -> list[str]:
    return [f"word={token[:12].lower()}", f"shape={form}"]


def file_features(text: str) -> list[str]:
    """What the whole text is like: how many digits, quotes and assignments among its characters."""
    n = max(len(text), 1)
    share = [sum(map(text.count, cs)) / n for cs in ("0123456789", "\"'", "=:", "{};")]
    return [f"{name}={int(np.log2(s * 1000 + 1))}" for name, s in zip(("digits", "quotes", "marks", "code"), share, strict=True)]


SIDES = (("own", 0), ("before", -1), ("before2", -2), ("after", 1))


class Model:
    """Weights by place and feature, each for begin and inside, and moves between labels.

    Outside scores nothing.  What a token is worth to itself and to the tokens around it
    is eight numbers, begin and inside of each of ``SIDES``.  They are the sum of a row
    for its shape and size, which few pairs share, and rows for its other features; row
    0 of a table is that of features without weights.
    """

    def __init__(self, weights: dict[tuple[str, str], np.ndarray], moves: np.ndarray):
        self.moves = moves
        self.file: dict[str, np.ndarray] = {}
        self.weights: dict[str, np.ndarray] = {}
        place = {side: 2 * k for k, (side, _) in enumerate(SIDES)}
        for (side, feature), w in weights.items():
            if side == "file":
                self.file[feature] = w[1:]
            else:
                eight = self.weights.setdefault(feature, np.zeros(8))
                eight[place[side] : place[side] + 2] += w[1:]
        named = lambda kind: [f for f in self.weights if f.startswith(kind)]
        starts, words = named("start="), named("word=")
        self.rows = [np.zeros(8), *[self.weights[f] for f in starts + words]]
        self.starts = {f.removeprefix("start="): 1 + k for k, f in enumerate(starts)}
        self.words = {f.removeprefix("word="): 1 + len(starts) + k for k, f in enumerate(words)}
        self.forms: dict[tuple[str, int, int, bool], int] = {}

    def _form(self, form: str, size: int, various: int, only_hex: bool) -> int:
        """The row of all features that follow from a few properties of a token."""
        mixed = is_mixed(form)
        features = form_features(form, size, mixed) + kind_features(only_hex, various, mixed)
        self.rows.append(sum((self.weights[f] for f in features if f in self.weights), np.zeros(8)))
        self.forms[form, size, various, only_hex] = len(self.rows) - 1
        return len(self.rows) - 1

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        """The eight numbers of each token."""
        rows, forms, starts, words = [], self.forms, self.starts, self.words
        for token in tokens:
            n = len(token)
            key = shape(token), min(n // 4, 10), min(len(set(token)) // 3, 8), n > 7 and not token.strip(HEX_DIGITS)
            form = forms.get(key)
            rows.append(self._form(*key) if form is None else form)
        table, take = np.array(self.rows, np.float32), np.array
        scores = table[take(rows, np.int64)]
        scores += table[take([starts.get(t[:4], 0) for t in tokens], np.int64)]
        scores += table[take([words.get(t[:12].lower(), 0) for t in tokens], np.int64)]
        return scores

    def file_scores(self, text: str) -> np.ndarray:
        return sum((self.file[f] for f in file_features(text) if f in self.file), np.zeros(2))


def fit(texts: list[str], least: int = 3) -> Model:
    """A model that marks base spans as other tokens see them: by shape, neighbours and file.

    A token's label is outside, or begin or inside of a value of a base span.
    Features seen in fewer than ``least`` places are left out.  All lines with a
    secret are learned from, and of the others three times as many, evenly spread.
    In every second line with a secret the words before it are hidden, so the field
    learns what values look like behind words that no pattern names.
    """
    lines: list[tuple[list[str], list[int], list[str]]] = []
    for text in texts:
        inner = sorted(values(text))
        of_file = file_features(text)
        tokens, labels, i = [], [], 0
        for m in TOKEN.finditer(text):
            if m[0] == "\n":
                if tokens:
                    lines.append((tokens, labels, of_file))
                tokens, labels = [], []
                continue
            while i < len(inner) and inner[i][1] <= m.start():
                i += 1
            hit = i < len(inner) and inner[i][0] < m.end()
            starts = hit and (m.start() <= inner[i][0] or not labels or labels[-1] == OUTSIDE)
            labels.append((BEGIN if starts else INSIDE) if hit else OUTSIDE)
            tokens.append(m[0])
        if tokens:
            lines.append((tokens, labels, of_file))
    lines = [(t[k : k + FIT_TOKENS], y[k : k + FIT_TOKENS], f) for t, y, f in lines for k in range(0, len(t), FIT_TOKENS)]
    hot = [x for x in lines if any(x[1])]
    cold = [x for x in lines if not any(x[1])]
    lines = hot + cold[:: max(1, len(cold) // max(3 * len(hot), 500))]
    number: dict[tuple[str, str], int] = {}
    at, which, labels_of = array("q"), array("q"), []
    for i, (tokens, labels, of_file) in enumerate(lines):
        begin = len(labels_of)
        hide = i < len(hot) and i % 2 == 1
        forms = [shape(t) for t in tokens]
        for k, token in enumerate(tokens):
            fs = [("own", f) for f in own_features(token, forms[k])] + [("file", f) for f in of_file]
            for side, step in SIDES[1:]:
                if 0 <= k + step < len(tokens):
                    near = near_features(tokens[k + step], forms[k + step])
                    hidden = hide and step < 0 and tokens[k + step][0].isalpha()
                    fs += [(side, f) for f in (near[1:] if hidden else near)]
            which.extend(number.setdefault(f, len(number)) for f in fs)
            at.extend([begin + k] * len(fs))
        labels_of += labels
    at, which = np.array(at, np.int64), np.array(which, np.int64)
    often = np.bincount(which, minlength=len(number)) >= least
    at, which = at[often[which]], which[often[which]]
    lengths = np.array([len(x[0]) for x in lines], np.int64)
    weights, moves = crf.fit([[at, which]], len(number), np.array(labels_of, np.int64), lengths, 3, steps=40)
    moves[OUTSIDE, INSIDE] = -1e4  # an inside follows a begin or an inside
    used = {f: weights[i] for f, i in number.items() if np.abs(weights[i]).max() > 1e-3}
    return Model(used, moves)


def outside_costs(moves: np.ndarray, label: int) -> tuple[float, float]:
    """The most that moves gain when a token has ``label`` and not outside.

    First if no inside follows the token; then if one does, which has to become a
    begin once the token is outside.  The line may end on either side.
    """
    before = max(0.0, *(moves[p, label] - moves[p, OUTSIDE] for p in range(3)))
    after = max(0.0, *(moves[label, n] - moves[OUTSIDE, n] for n in (OUTSIDE, BEGIN)))
    beyond = max(0.0, *(moves[INSIDE, q] - moves[BEGIN, q] for q in range(3)))
    return before + after, before + moves[label, INSIDE] - moves[OUTSIDE, BEGIN] + beyond


class Tagger:
    """Labels of the tokens of texts by Viterbi, line by line; remembers the scores of tokens."""

    def __init__(self, model: Model):
        self.model, self.kind = model, {}
        self.table = np.zeros((0, 2 * len(SIDES)), np.float32)

    def tagged(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        if len(self.kind) > REMEMBERED:
            self.kind = {}
        kind = self.kind
        if not kind:
            kind["\n"] = 0
            self.table = np.zeros((1, 2 * len(SIDES)), np.float32)
        end, rows, sizes, new = kind["\n"], [], [], []
        for text in texts:
            found = TOKEN.findall(text)
            for token in set(found).difference(kind):
                kind[token] = len(kind)
                new.append(token)
            rows.extend(map(kind.__getitem__, found))
            rows.append(end)
            sizes.append(len(found) + 1)
        if new:
            self.table = np.concatenate([self.table, self.model.token_scores(new)])
        token, doc = np.array(rows, np.int64), np.repeat(np.arange(len(texts)), sizes)
        own, before, before2, after = np.split(self.table, len(SIDES), axis=1)
        total = own[token] + np.array([self.model.file_scores(t) for t in texts], np.float32).reshape(-1, 2)[doc]
        total[1:] += before[token[:-1]]
        total[:-1] += after[token[1:]]
        total[2:] += np.where((token[1:-1] != end)[:, None], before2[token[:-2]], 0)
        moves = self.model.moves
        stop = token == end
        use, first = self._pieces(total, stop)
        result: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(use):
            return result
        part, doc_of = np.zeros((len(use), 3)), doc[use]
        part[:, 1:] = total[use]
        part[first, INSIDE] -= 1e4
        chains = crf.Chains(np.diff(np.append(np.flatnonzero(first), len(use))))
        label = np.zeros(len(token), np.int8)
        label[use] = crf.viterbi(part, moves, chains)
        for d in np.unique(doc_of[label[use] != OUTSIDE]).tolist():
            result[d] = self._offsets(texts[d], label[(doc == d) & ~stop].tolist())
        return result

    def _pieces(self, total: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens to decode, and which of them begin a chain of their own.

        A token that the best path leaves outside whatever stands beside it parts
        its line: what lies on either side is decoded by itself, with one such token
        as its border.  So a text without line breaks costs no more than its lines
        would.  A span is worth the scores of its tokens and the moves in place of
        staying outside, so a piece has none if no token outweighs two such moves.
        """
        moves = self.model.moves
        worth = max(0.0, float(moves.max() - moves[OUTSIDE, OUTSIDE]))
        follows = np.zeros(len(total))  # what an inside after it is worth above a begin
        follows[:-1] = np.where(stop[1:], -np.inf, total[1:, 1] - total[1:, 0])
        free = np.zeros(len(total), bool)
        for label in (BEGIN, INSIDE):
            alone, led = outside_costs(moves, label)
            own = total[:, label - 1]
            free |= (own + alone >= 0) | (own + led + follows >= 0)
        free &= ~stop
        near = free.copy()
        near[1:] |= free[:-1]
        near[:-1] |= free[1:]
        use = np.flatnonzero(near & ~stop)
        first = np.append(True, np.diff(use) > 1)[: len(use)]
        piece = np.cumsum(first) - 1
        possible = np.bincount(piece, total[use].max(axis=1) >= -2 * worth) > 0
        keep = possible[piece]
        return use[keep], first[keep]

    @staticmethod
    def _offsets(text: str, labels: list[int]) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        for m, label in zip((m for m in TOKEN.finditer(text) if m[0] != "\n"), labels, strict=True):
            if label == INSIDE and found:
                found[-1] = (found[-1][0], m.end())
            elif label == BEGIN:
                found.append(m.span())
        return [s for s in found if s[1] - s[0] >= LEAST_CHARS]


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list[spans.Span], list[spans.Span]]]:
    """Of each text its base spans, and these with the tagged spans beside them."""
    tagged = tagger.tagged(texts) if tagger else [[] for _ in texts]
    found = []
    for text, own in zip(texts, tagged, strict=True):
        base = base_spans(text)
        more = [(a, b, "tagged") for a, b in spans.apart(own, base)]
        found.append((base, spans.in_order(base + more, KINDS)))
    return found


def fitted(docs: DataFrame) -> Model | None:
    """The model of a bounded sample of ``docs``: texts that hold a word of the patterns, and others.

    Both halves are the first distinct texts by a hash; of a text over ``SAMPLE_CHARS`` an
    excerpt is taken, with its secrets first.  Without a base span in the sample there
    is none.
    """
    source = documents(docs).select("text")
    low = F.lower("text")
    hint = F.col("text").contains("AKIA") | F.col("text").rlike("[0-9a-f]{32}")
    for h in HINTS:
        hint = hint | low.contains(h)
    dealt = source.select("text", hint.alias("hint"), F.pmod(F.xxhash64("text"), F.lit(DEAL)).alias("deal"))
    # Twice the share that makes up the bound, so what reaches the driver does not grow.
    # Copies of a text are one of it, so no group of them takes the places of others.
    apart = dealt.groupBy("hint").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n"))
    counts = {r["hint"]: max(1, r["n"]) for r in apart.collect()}
    texts = []
    for kind, count in counts.items():
        below = min(DEAL, 2 * DEAL * SAMPLE_DOCUMENTS // count + 1)
        rows = dealt.where((F.col("deal") < below) & (F.col("hint") == kind)).select("text", "deal")
        rows = excerpts(rows, SAMPLE_CHARS, lambda piece: bool(values(piece))).distinct().orderBy("deal", "text")
        texts += sorted({r["text"] for r in rows.limit(SAMPLE_DOCUMENTS).collect()})
    return fit(texts) if any(values(t) for t in texts) else None


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, spans, n_base, base_sha256, all_spans`` of each row of ``docs``.

    ``spans`` are structs of start, end and kind in characters.  A null or empty
    text has none.  Tagged spans that overlap a base span are left out: base spans
    stay as they are.  Without a model there are base spans only.
    """
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    schema = pa.schema(
        [("doc_id", pa.int64()), ("found", pa.list_(span)), ("base_sha256", pa.string()), ("spans", pa.string())]
        + [(f"n_{k}", pa.int64()) for k in KINDS]
    )

    def run(batches):
        tagger = Tagger(model) if model else None

        def one(texts: list[str]) -> dict:
            both = all_spans(texts, tagger)
            counts = [Counter(s[2] for s in whole) for _, whole in both]
            return {
                "found": [[{"start": a, "end": b, "kind": k} for a, b, k in whole] for _, whole in both],
                "base_sha256": [spans.digest(spans.joined(base)) for base, _ in both],
                "spans": [spans.joined(whole) for _, whole in both],
            } | {f"n_{k}": [c[k] for c in counts] for k in KINDS}

        yield from per_document(one, schema)(batches)

    columns = "doc_id long, found array<struct<start:int,end:int,kind:string>>, base_sha256 string, spans string, "
    return documents(docs).mapInArrow(run, columns + ", ".join(f"n_{k} long" for k in KINDS))


def masked(text: str, found: list[spans.Span]) -> str:
    """The text with each stretch that spans cover replaced by a mask."""
    parts, last = [], 0
    for a, b, _ in sorted(found):
        if a >= last:
            parts += [text[last:a], MASK]
        last = max(last, b)
    return "".join([*parts, text[last:]])


def mask_secrets(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with secrets masked in ``text``; all columns stay, null texts become empty."""
    columns = docs.columns

    def run(batches):
        tagger = Tagger(model) if model else None
        for batch in batches:
            texts = []
            for _, part in slices(batch.column("text")):
                texts += [masked(t, whole) for t, (_, whole) in zip(part, all_spans(part, tagger), strict=True)]
            arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(run, docs.schema)
