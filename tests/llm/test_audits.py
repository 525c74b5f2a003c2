"""Divergence, periodic runs and suffix sorting against brute-force versions."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicatlas.llm import divergence, periodic, queries, suffixes

SF_DIR = "/root/testdata/sf0.001"
HARD = [None, "", " \t\n", "a", "a " * 5000, "x" * 20000, "été 日本 🙂 </turn> \\ <" * 9, "same text here now " * 9, "same text here now " * 9]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- divergence ---------------------------------------------------------------


def _plain_divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang or "", source or "", term.findall((text or "").translate(lower))) for lang, source, text in rows]
    out = []
    for lang in {f[0] for f in found}:
        docs, whole, own = Counter(), Counter(), {}
        for _, source, terms in (f for f in found if f[0] == lang):
            docs.update(set(terms))
            own.setdefault(source, Counter()).update(terms)
        kept = [t for t in docs if docs[t] >= least]
        p = {}
        for source, counts in own.items():
            total = sum(counts[t] for t in kept)
            p[source] = {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}
            whole.update({t: counts[t] for t in kept})
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(whole.values()) + 5 * len(kept)) for t in kept}
        for source, counts in own.items():
            pair = [(sum(abs(p[source][t] - p[o][t]) for t in kept), o) for o in own if o != source]
            above = [(p[source][t] - q[t], t) for t in kept if counts[t] and p[source][t] > q[t]]
            for part, values in (("pair", pair), ("term", above)):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                ranked = ranked[:top] if part == "term" else ranked
                out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence_equals_sums_over_all_terms(spark):
    rng = random.Random(3)
    words = ["été", "Été", "a1b", "x-y", "日本", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ß", "hot", None, "hot", "hot"]), " ".join(words[int(rng.random() ** 3 * len(words))] for _ in range(rng.randrange(60)))) for _ in range(400)]
    rows += [("xx", "only", "one two"), ("yy", "s", None), ("yy", "t", "few"), ("yy", "\U0001f642", "\x00few\x7f")] + rows[:5]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("w"))
    got = sorted(map(tuple, divergence.audit(docs, least=4, top=7).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == _plain_divergence(rows, 4, 7)


def test_counts_beyond_64_bits_of_product(spark):
    big = 9 * 10**15
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(10 * big), F.lit(3)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 5) // (10 * big + 15)
    assert spark.range(1).select(divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("p")).first()["p"] is None


def test_tasks_hand_counts_on_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "s", "a b a"), ("en", "s", "b c")] * 3, "lang string, source string, text string").coalesce(1)
    got = {tuple(r) for r in divergence.term_counts(docs).collect()}
    assert got == {("en", "s", "a", 6, 3), ("en", "s", "b", 6, 6), ("en", "s", "c", 3, 3)}


# --- periodic runs ------------------------------------------------------------


def _plain_runs(words):
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                smallest = next(p for p in range(1, q + 1) if all(words[x] == words[x + p] for x in range(i, i + length - p)))
                if smallest == q:
                    found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _periodic_words(rng):
    words = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.randrange(4)
        if kind == 0:
            words += [rng.choice("ab") for _ in range(rng.randrange(40))]
        elif kind == 1:
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
            words += (unit * 9)[: rng.randrange(1, 9 * len(unit) + 1)]
        elif kind == 2:
            words += [f"w{rng.randrange(60)}" for _ in range(rng.randrange(40))]
        else:
            unit = (["a"] * rng.randrange(1, 9) + ["b"] * rng.randrange(3)) or ["c"]
            words += unit * rng.randrange(1, 7)
    return words


def test_runs_equal_all_lags():
    rng = random.Random(5)
    texts = [_periodic_words(rng) for _ in range(600)]
    got = periodic.runs_of([[w.encode() for w in words] for words in texts])
    assert got == [_plain_runs(words) for words in texts]
    assert sum(map(len, got)) > 600


def test_unstable_stretches_are_scanned_with_equal_runs(monkeypatch):
    rng = random.Random(6)
    texts = [[w.encode() for w in _periodic_words(rng)] for _ in range(200)]
    whole = periodic.runs_of(texts)
    monkeypatch.setattr(periodic, "ROUNDS", 1)
    assert periodic.runs_of(texts) == whole


def test_very_long_texts_of_one_word_or_of_two(spark):
    for words in ([b"a"] * 300_000, [b"a", b"b", b"a", b"a"] * 80_000, [b"%d" % (i % 2000) for i in range(200_000)]):
        assert len(periodic.runs_of([words])[0]) in (1, 2)
    many = [w for i in range(30_000) for w in [b"%d" % i] * 6]
    assert len(periodic.runs_of([many])[0]) == 30_000


def _plain_row(doc_id, text):
    words = periodic.planted([w.encode() for w in WORD.findall(text or "")], doc_id)
    runs = _plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *best, milli, digest(lines.encode()), digest(kept)


def test_op12_equals_plain_loops(spark, docs, tmp_path):
    rng = random.Random(8)
    texts = [*HARD[:4], "a " * 500, "été 日本 🙂 " * 9, *[" ".join(_periodic_words(rng)) for _ in range(150)]]
    table = docs(*texts, (None, "b " * 7), (None, None), (7, "c d " * 9), (7, "c d " * 9), (None, "b " * 7))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    got = got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    expected = [_plain_row(r["doc_id"], r["text"]) for r in table.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_op12_on_a_given_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").where(F.length("text") < 3000).select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, SF_DIR).collect()}
    assert any(got[r["doc_id"]]["n_runs"] for r in rows)
    for r in rows:
        assert tuple(got[r["doc_id"]]) == _plain_row(r["doc_id"], r["text"])


def test_collapse_keeps_other_columns(spark, docs):
    out = periodic.collapse_runs(docs("x y " * 5 + "z", None)).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["x y z", ""]
    assert out[0]["_runs"][0].asDict() == {"start": 0, "length": 10, "period": 2}
    assert out[0]["_best"]["period"] == 2 and out[1]["_best"] is None
    assert out[0]["component_id"] == 2 and out[0]["n_chars"] == 21


# --- suffix sorting -----------------------------------------------------------


def _plain_later(docs, window):
    """Bytes kept and removed spans of each ``(order, text)``, by a table of all windows."""
    first = {}
    for order, text in docs:
        for i in range(len(text) - window + 1):
            key = text[i : i + window]
            first[key] = min(first.get(key, (order, i)), (order, i))
    out = []
    for order, text in docs:
        cover = [False] * len(text)
        for i in range(len(text) - window + 1):
            if first[text[i : i + window]] != (order, i):
                cover[i : i + window] = [True] * window
        kept = bytes(b for b, c in zip(text, cover) if not c)
        out.append((len(text), sum(cover), sum(c and not p for c, p in zip(cover, [False, *cover])), kept))
    return out


def _passages(rng, n):
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 90))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.6 else "".join(rng.choice("xyzé日 ") for _ in range(rng.randrange(50))) for _ in range(rng.randrange(8))]
        if rng.random() < 0.2:
            parts.append(rng.choice(["ab", "q", "x y z "]) * rng.randrange(60))
        texts.append("".join(parts))
    return texts + texts[:9]


@pytest.mark.parametrize("window, anchor, at_once, of_anchor", [(30, 8, 150_000, 20_000), (30, 8, 40, 3), (100, 20, 150_000, 20_000)])
def test_removed_bytes_equal_a_table_of_windows(spark, docs, monkeypatch, window, anchor, at_once, of_anchor):
    monkeypatch.setattr(suffixes, "STRINGS_AT_ONCE", at_once)
    monkeypatch.setattr(suffixes, "STRINGS_OF_ANCHOR", of_anchor)
    rng = random.Random(window + of_anchor)
    texts = _passages(rng, 150) + [t for t in HARD]
    ids = rng.sample(range(1000), len(texts))
    got = suffixes.remove_later(docs(*zip(ids, texts)), window, anchor).collect()
    by_id = sorted((i, (t or "").encode()) for i, t in zip(ids, texts))
    expected = dict(zip((i for i, _ in by_id), _plain_later(by_id, window)))
    for r in got:
        spans = [tuple(s) for s in r["_spans"]]
        assert (r["_n_bytes"], sum(b - a for a, b in spans), len(spans), bytes(r["_kept"])) == expected[r["doc_id"]]
        assert r["component_id"] == 2
    assert len(got) == len(texts)


def test_rows_of_one_id_are_one_document_or_follow_each_other(spark, docs):
    a, b = "p" * 50 + "0123456789" * 9, "0123456789" * 9 + "q" * 60
    out = suffixes.remove_later(docs((5, a), (5, a), (None, b), (None, b), (None, "short"), (6, a + b)), 40, 10).collect()
    kept = [(r["doc_id"], bytes(r["_kept"]).decode()) for r in out]
    # Null ids come first, and rows of equal id and text get one result.
    plain = _plain_later([(0, b.encode()), (1, b"short"), (2, a.encode()), (3, (a + b).encode())], 40)
    assert {k for i, k in kept if i is None} == {plain[0][3].decode(), "short"}
    assert [k for i, k in kept if i == 5] == [plain[2][3].decode()] * 2
    assert [k for i, k in kept if i == 6] == [plain[3][3].decode()]


def test_common_prefixes_and_order_of_the_columns():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 99, 12).astype(np.uint8)) for _ in range(300)]
    later = suffixes.earlier_windows(strings, np.full(300, 4), np.full(300, 5), np.arange(300), 8, 5)
    for column in range(5):
        seen = set()
        for k, s in enumerate(strings):
            assert later[column, k] == (s[column : column + 8] in seen)
            seen.add(s[column : column + 8])


def test_a_group_of_pairs_is_bounded(spark):
    """Different strings around what a pair of windows shares differ in their first and last byte alone."""
    rng = random.Random(4)
    rows = [(1, i, 0, 40, 41, bytes(rng.choices(b"ab", k=40)) + b"0123456789" * 6 + bytes(rng.choices(b"ab", k=40))) for i in range(500)]
    table = spark.createDataFrame(rows, "name long, row long, start long, before int, n int, string binary")
    pairs = suffixes._parted(table, 100, 60)
    sizes = pairs.select("name", "string").distinct().groupBy("name").count().agg(F.max("count")).first()[0]
    assert sizes <= 4
    assert pairs.agg(F.sum("n")).first()[0] == 500 * 41
