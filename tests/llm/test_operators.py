"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from checks.compare import connect, difference
from topicatlas.llm import chat, common, components, crf, imatch, lattice, packing, pieces, pii, queries, recompression, secrets, simhash, toxicity

SF_DIR = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [None, "", " \t\n", "a", "a " * 5000, "x" * 20000, "été 日本 🙂 </turn> \\ <", "same text here now", "same text here now"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "embeddings", "labels", "conversations"):
        spark.read.parquet(f"{SF_DIR}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(rows) == (1 if name.startswith("op8_") else 0)


# --- personal data ------------------------------------------------------------


def _plain_pii(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, card = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+")
    found = [(m.start(), m.end(), "email") for m in email.finditer(text)]
    found += [(m.start(), m.end(), "ip") for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in card.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_base_spans_equal_the_plain_patterns():
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab1234567890@.._%+-- ()é٣") for _ in range(60)) for _ in range(4000)]
    texts += ["4111 1111 1111 1111 a@b@c.d_e@f.g 1.2.3.4.5.6.7.8 +1 (555) 123-4567", "1" * 3000, "a" * 3000]
    assert all(pii.base_spans(t) == _plain_pii(t) for t in texts)


def test_pii_contexts_find_unseen_identifiers(docs):
    known = [f"write to reply address u{i}@mail.example.org today" for i in range(6)]
    found = {r["doc_id"]: r for r in pii.find(docs(*known, "write to reply address u9-at-mail9 today", "room b2100 is open", *HARD)).collect()}
    assert len(found) == 8 + len(HARD)
    assert [s["kind"] for s in found[0]["base"]] == ["email"]
    assert [(s["start"], s["kind"]) for s in found[6]["found"]] == [(23, "context_email")]
    assert not found[7]["found"] and not found[8]["base"]


@pytest.mark.parametrize(
    "text, value",
    [
        ("call me at 555 123 4567", "555 123 4567"),
        ("ssn: 078 05 1120", "078 05 1120"),
        ("pay to DE89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 00"),
        ('{"email":"a@b.co","ssn":"078-05-1120"}', "078-05-1120"),
        ("the key " + "k9" * 40 + " is long", "k9" * 40),
        ("id=u1.2.3.4/78051120,x", "/78051120"),
    ],
)
def test_pii_candidates(text, value):
    base = pii.base_spans(text)
    assert value in [text[a:b] for a, b in pii.candidates(text, base)]
    assert all(b <= x or y <= a for a, b in pii.candidates(text, base) for x, y, _ in base)


def test_pii_patterns_look_over_any_white_space():
    text = "reply" + " " * 300 + "address" + "\n" * 200 + "x9 = '5551234567'" + "\t" * 99 + '"today"'
    seen = {s["instance"]: s["patterns"] for s in pii.occurrences(text)}
    assert seen["5551234567"] == ["x0 _", "address x0 _", "_ today", "x0 _ today"]
    long = "w" * 5000
    (own,) = [s["patterns"] for s in pii.occurrences(f"{long} 5551234567")]
    assert own == [f"{hashlib.md5(long.encode()).hexdigest()} _"] and len(own[0]) < 40


def _plain_scores(seen):
    """Pattern scores by rounds over sets, for ``(instance, kind, patterns)`` rows."""
    edges = {(p, i, k or "") for i, k, ps in seen for p in ps}
    size, seeds = {}, {}
    for p, i, k in edges:
        size.setdefault(p, set()).add(i)
        if k:
            seeds.setdefault((p, k), set()).add(i)
    fit = {pk: len(s) for pk, s in seeds.items() if len(s) >= pii.LEAST_SEEDS}
    score = {(p, k): n / len(size[p]) for (p, k), n in fit.items()}
    known = {(i, k) for _, i, k in edges if k}
    for _ in range(pii.ROUNDS - 1):
        own = {}
        for p, i, k in edges:
            for (q, kind), s in score.items():
                if not k and q == p and (i, kind) not in known:
                    own.setdefault((i, kind), []).append(1 - min(s, 0.999))
        own = {ik: 1 - np.prod(left) for ik, left in own.items()}
        more = {}
        for p, i, k in edges:
            for kind in {kk for _, kk in fit}:
                if not k and (i, kind) in own:
                    more[p, kind] = more.get((p, kind), 0.0) + own[i, kind]
        score = {(p, k): min(1.0, (n + more.get((p, k), 0.0)) / len(size[p])) for (p, k), n in fit.items()}
    return {pk: s for pk, s in score.items() if s >= pii.LEAST_SCORE}


def test_pii_graph_scores_equal_plain_rounds(spark):
    rng = random.Random(7)
    seen = []
    for _ in range(500):
        kind = rng.choice(["email", "ip", None, None])
        ps = [f"p{int(rng.random() ** 2 * 25)} _" for _ in range(rng.randrange(0, 4))]
        seen.append((f"i{rng.randrange(60)}" + (kind or ""), kind, ps))
    table = spark.createDataFrame(seen, "instance string, kind string, patterns array<string>")
    got = {(r["pattern"], r["kind"]): r["score"] for r in pii._scored_patterns(table).collect()}
    want = _plain_scores(seen)
    assert got.keys() == want.keys() and got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


# --- packing ------------------------------------------------------------------


def test_first_fit_decreasing_equals_the_plain_search():
    draw = np.random.default_rng(1)
    for _ in range(30):
        lengths = draw.integers(1, 101, draw.integers(1, 80))
        room, want = [100] * len(lengths), np.zeros(len(lengths), int)
        for i in np.argsort(-lengths, kind="stable"):
            want[i] = next(b for b, r in enumerate(room) if r >= lengths[i])
            room[want[i]] -= lengths[i]
        assert (packing.first_fit_decreasing(lengths, 100) == want).all()


def test_packing_holds_each_id_once(docs):
    texts = [*HARD, "lorem ipsum " * 3000, "<|endoftext|> a\u0085b"]
    rows = packing.pack(docs(*texts), BYTES, group_pieces=8).toPandas()
    encoder = packing.Encoder(BYTES)
    for i, text in enumerate(texts):
        ids = np.append(encoder.whole.encode(text or "", add_special_tokens=False).ids, 1).astype("<u4")
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.start.tolist() == list(range(0, len(ids), 2048)) and (own.doc_tokens == len(ids)).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in own.start]
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert (part.offset == part.length.cumsum() - part.length).all() and part.length.sum() <= 2048


def test_rows_that_repeat_are_packed_in_many_groups(docs):
    rows = packing.pack(docs(*[(None, "")] * 300, *[(5, "a b")] * 300, *range_texts(300)), BYTES, group_pieces=30).toPandas()
    group = rows.sequence_id.to_numpy() >> 32
    for own in (rows.doc_id.isna(), rows.doc_id == 5):
        assert own.sum() == 300 and np.unique(group[own], return_counts=True)[1].max() < 40
    assert len(rows) == 900 and np.unique(group, return_counts=True)[1].max() < 60


def range_texts(n):
    return [(100 + i, f"text {i}") for i in range(n)]


# --- sentence pieces ----------------------------------------------------------


def test_pieces_equal_the_library(docs):
    draw = random.Random(2)
    texts = ["".join(draw.choice(" ab▁\n\té日🙂\x01ﬁ") for _ in range(draw.randrange(14))) for _ in range(800)]
    texts += [t for t in HARD if t is not None]
    chunks = pieces.Chunks(PIECES)
    found = sorted(pieces.encode(docs(*texts, None), PIECES).collect(), key=lambda r: r["doc_id"])
    want = chunks.model.encode(texts)
    assert [r["ids"] for r in found] == [*want, []]
    assert [r["decoded"] for r in found] == [*chunks.model.decode(want), ""]


def test_pieces_of_rows_that_repeat_and_a_table_that_starts_anew(docs, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    texts = [f"the same words again {i % 7} and ﬁ日 {'x' * (i * 50)}" for i in range(30)] * 2 + ["the " * 500, " ", None]
    table = docs(*[(None if i % 3 == 0 else i // 2, t) for i, t in enumerate(texts)]).repartition(3)
    model = pieces.Chunks(PIECES).model
    want = sorted((str(None if i % 3 == 0 else i // 2), model.encode(t or ""), model.decode(model.encode(t or ""))) for i, t in enumerate(texts))
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in pieces.encode(table, PIECES).collect()) == want


# --- I-Match ------------------------------------------------------------------


def test_edits_and_fingerprints_equal_a_plain_loop(spark, docs):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(draw.choices(words, k=draw.randrange(60))) for _ in range(40)] + [t for t in HARD if t is not None]
    table = docs(*[(3 * i - 20, t) for i, t in enumerate(texts)])
    lexicon = imatch.lexicon(table)
    rows = {r["doc_id"]: r for r in imatch.compare_with_next(table, lexicon, range_documents=5).collect()}
    order = list(range(len(texts)))[::-1]
    for k, i in enumerate(order):
        after, own = texts[order[(k + 1) % len(order)]], rows[3 * i - 20]
        third = len(texts[i]) // 3
        assert own["edited"] == texts[i][: len(texts[i]) - third] + after[:third]
        one = imatch.fingerprint(texts[i], lexicon)
        assert own["fingerprint"] == ".".join(one)
        assert own["near_next"] == imatch.likeness(one, imatch.fingerprint(after, lexicon))
        changed = imatch.fingerprint(own["edited"], lexicon)
        assert own["edited_fingerprint"] == ".".join(changed) and own["near_edited"] == imatch.likeness(one, changed)
    assert sorted(rows) == sorted(3 * i - 20 for i in range(len(texts)))


def _plain_comparison(pairs, lexicon):
    """What ``compare_with_next`` gives, from a sorted list in the order of ids and of two hashes of texts."""
    found = []
    for k, (doc_id, text) in enumerate(pairs):
        after = pairs[(k + 1) % len(pairs)][1]
        changed = imatch.edited(text, after)
        own, other, following = (imatch.fingerprint(t, lexicon) for t in (text, changed, after))
        found.append((doc_id, len(text), changed, ".".join(own), ".".join(other), imatch.likeness(own, other), imatch.likeness(own, following)))
    return sorted(found, key=str)


def _skewed(docs):
    """A third of the rows without id and text, a third with one id, and some rows that repeat."""
    draw = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    text = lambda: " ".join(draw.choices(words, k=draw.randrange(3, 40)))
    rows = [(None, None)] * 300 + [(7, text()) for _ in range(260)] + [(7, "seven times")] * 40
    rows += [(i, text()) for i in range(-100, 190)] + [(None, text()) for _ in range(10)]
    draw.shuffle(rows)
    return docs(*rows)


def _in_order(table):
    one, two = common.text_hashes(F.col("text"))
    rows = common.documents(table).select("doc_id", "text", one.alias("one"), two.alias("two")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["one"], r["two"]))
    return [(r["doc_id"], r["text"]) for r in rows]


@pytest.mark.parametrize("most_terms", [2_000_000, 10])
def test_imatch_hot_ids_and_large_lexicons_equal_a_plain_loop(docs, monkeypatch, most_terms):
    monkeypatch.setattr(imatch, "REPEATS", 64)
    table = _skewed(docs)
    lexicon = imatch.lexicon(table)
    kept = imatch.lexicon(table, most_terms)
    assert isinstance(kept, np.ndarray) == (most_terms > 10) and len(lexicon) > 10
    want = _plain_comparison(_in_order(table), lexicon)
    found = imatch.compare_with_next(table, kept, range_documents=30).collect()
    assert sorted(map(tuple, found), key=str) == want
    prints = sorted((tuple(r) for r in imatch.fingerprints(table, kept).collect()), key=str)
    assert prints == sorted(((w[0], w[3]) for w in want), key=str)


def test_imatch_ranges_stay_bounded(docs):
    dealt, repeated = imatch.with_next(_skewed(docs), 30)
    rows = dealt.groupBy("bin").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).collect()
    assert repeated and max(r["n"] for r in rows) <= 100 and max(r["copies"] for r in rows) >= 300


# --- recompression ------------------------------------------------------------


def _plain_removal(texts, window):
    words = [(t or "").encode().split() for t in texts]
    at = {}
    for d, own in enumerate(words):
        for i in range(len(own) - window + 1):
            at.setdefault(tuple(own[i : i + window]), []).append((d, i))
    gone = {(d, i + k) for places in at.values() if len(places) > 1 for d, i in places for k in range(window)}
    return [b" ".join(w for i, w in enumerate(own) if (d, i) not in gone).decode() for d, own in enumerate(words)]


@pytest.mark.parametrize("size", [2, 40])
def test_repeats_equal_a_plain_search(docs, size):
    draw = random.Random(size)
    texts = [" ".join(draw.choices([f"w{i}" for i in range(size)], k=draw.randrange(120))) for _ in range(30)]
    texts += [texts[0], texts[1] + " tail " + texts[2], "run " * 90, *HARD]
    table = docs(*texts)
    kept = recompression.remove_repeats(table, window=12)
    assert kept.columns == [*table.columns, "_n_words", "_n_removed"]
    rows = sorted(kept.collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in rows] == _plain_removal(texts, 12)


def test_repeated_ids_keep_their_own_texts(docs):
    long = " ".join(f"w{i}" for i in range(40))
    rows = recompression.remove_repeats(docs((1, long), (1, "other words"), (None, long), (2, "end")), window=12).collect()
    assert sorted(r["text"] for r in rows) == ["", "", "end", "other words"]


def test_many_texts_of_a_null_id_keep_their_own_windows(docs):
    again = " ".join(f"p{i}" for i in range(12))
    texts = [f"{again} a{i} {again}" if i % 2 else " ".join(f"w{i}x{k}" for k in range(13 + i % 5)) for i in range(6000)]
    rows = recompression.remove_repeats(docs(*[(None, t) for t in texts]), window=12).collect()
    assert sorted(r["text"] for r in rows) == sorted(_plain_removal(texts, 12))


# --- lattice ------------------------------------------------------------------


def test_nearest_lattice_point():
    x = np.random.default_rng(0).uniform(-3, 3, (3000, 8))
    p = lattice.nearest_point(x)
    beside = ((x[:, None] - (p[:, None] + lattice.ROOTS)) ** 2).sum(axis=2)
    assert len(lattice.ROOTS) == 240 and (((x - p) ** 2).sum(axis=1)[:, None] <= beside + 1e-9).all()


@pytest.mark.parametrize("block", [256, 16])
def test_links_equal_all_pairs(spark, block):
    draw = np.random.default_rng(7)
    centres = draw.standard_normal((12, 16))
    x = np.concatenate([centres[draw.integers(0, 12, 300)] + 0.05 * draw.standard_normal((300, 16)), draw.standard_normal((100, 16))])
    x = np.concatenate([x, x[:20], np.zeros((2, 16))])
    labels = [int(v) for v in draw.integers(0, 3, len(x))]
    rows = [(i, [float(c) for c in v], y) for i, (v, y) in enumerate(zip(x, labels))]
    odd = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in lattice.near_duplicates(table, block=block).collect()}
    norm = np.linalg.norm(x, axis=1)
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    near = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(near, False)
    want = near.sum()
    assert want * 0.9 <= sum(r["n_links"] for r in found.values()) <= want
    assert all(r["n_links"] <= near[i].sum() for i, r in found.items() if i < len(x))
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in (900, 901, 902, 903, 904))


def test_recall_at_the_threshold():
    draw = np.random.default_rng(5)
    a, b = draw.standard_normal((2, 2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    label = np.zeros(2000, np.int64)
    home, near = lattice.cells(a, label, lattice.TABLES, lattice.PROBES)
    home2, near2 = lattice.cells(0.93 * a + (1 - 0.93**2) ** 0.5 * b, label, lattice.TABLES, lattice.PROBES)
    met = (home == home2) | (near == home2[:, :, None]).any(axis=2) | (near2 == home[:, :, None]).any(axis=2)
    assert met.any(axis=0).mean() > 0.97


# --- fields -------------------------------------------------------------------


def _plain_chain(scores, moves):
    paths = list(itertools.product(range(scores.shape[1]), repeat=len(scores)))
    value = np.array([sum(scores[i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)) for p in paths])
    share = np.exp(value - value.max())
    share /= share.sum()
    each = np.array([[sum(s for s, p in zip(share, paths) if p[i] == y) for y in range(scores.shape[1])] for i in range(len(scores))])
    return each, paths[int(value.argmax())]


def test_marginals_and_viterbi_equal_all_paths():
    draw = np.random.default_rng(2)
    lengths = np.array([3, 1, 5, 2])
    scores, moves = draw.standard_normal((11, 3)), draw.standard_normal((3, 3))
    chains = crf.Chains(lengths)
    log_p, expected = crf.marginals(scores, moves, chains)
    labels = crf.viterbi(scores, moves, chains)
    two = crf.token_marginals(scores[:, 1], moves[:2, :2], chains)
    flat = np.stack([np.zeros(11), scores[:, 1]], axis=1)
    at = 0
    for n in lengths:
        each, best = _plain_chain(scores[at : at + n], moves)
        pair, _ = _plain_chain(flat[at : at + n], moves[:2, :2])
        assert np.allclose(np.exp(log_p[at : at + n]), each) and labels[at : at + n].tolist() == list(best)
        assert np.allclose(1 / (1 + np.exp(-two[at : at + n])), pair[:, 1])
        at += n
    assert np.isclose(expected.sum(), (lengths - 1).sum())


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ranks = rows.score.rank()
    bad = int(rows.toxic.sum())
    auc = (ranks[rows.toxic == 1].sum() - bad * (bad + 1) / 2) / (bad * (len(rows) - bad))
    assert auc > 0.92 and rows[rows.toxic == 0].predicted.mean() < 0.03
    assert rows.score.between(0, 1).all()


def test_toxic_words_are_located(docs):
    model = toxicity.fit([f"you are a blarg number {i}" for i in range(40)] + [f"you are a friend number {i}" for i in range(160)], [1] * 40 + [0] * 160, [i % 4 == 3 for i in range(200)])
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs("well. you are a blarg", "good day", *HARD), model).collect()}
    assert rows[0]["predicted"] == 1 and [(s["start"], s["end"]) for s in rows[0]["spans"]] == [(16, 21)]
    assert rows[1]["predicted"] == rows[2]["predicted"] == 0 and rows[9]["score"] == rows[10]["score"]
    kept = toxicity.clean_documents(docs("you are a blarg", "good day"), model)
    assert [r["text"] for r in kept.collect()] == ["good day"]
    assert {r["score"] for r in toxicity.score_documents(docs("a"), None).collect()} == {0.0}


LONG = " ".join(f"plain words number {i} follow here." for i in range(900))


def test_long_texts_are_learned_from(spark, docs):
    assert len(LONG) > toxicity.SAMPLE_CHARS
    insult = " ".join(f"you are a blarg number {i} now." for i in range(900))
    table = docs(*[(i, f"{i} {insult if i % 3 == 0 else LONG}") for i in range(120)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(i, i % 2) for i in range(1000, 9000)], "doc_id long, toxic int")
    model = toxicity.fitted(table, labels)
    rows = toxicity.score_documents(table, model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in rows) and len(rows) == 120
    with pytest.raises(ValueError, match="labels"):
        toxicity.fitted(table, labels.where("toxic = 0"))


def test_secrets_of_long_texts_are_learned(docs):
    key = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:18]
    table = docs(*[f"{i} {LONG} some words here password={key(i)} and more. {LONG}" for i in range(60)], *[f"{i} {LONG}" for i in range(60)])
    model = secrets.fitted(table)
    assert secrets.mask_secrets(docs(f"some words here passphrase={key(99)} and more."), model).first()["text"] == "some words here passphrase=[SECRET] and more."


def test_copies_take_no_places_of_the_sample(docs, monkeypatch):
    monkeypatch.setattr(secrets, "SAMPLE_DOCUMENTS", 20)
    monkeypatch.setattr(secrets, "fit", lambda texts: texts)
    texts = [f"password=abcdefgh{i}" for i in range(60)] + [f"nothing {i}" for i in range(60)]
    found = secrets.fitted(docs(*texts, *texts[:20] * 100, *texts[-20:] * 100))
    assert len(found) == len(set(found)) == 40 and sum(t.startswith("password") for t in found) == 20


def test_excerpts_are_whole_pieces_from_all_over():
    for text in (LONG, LONG.replace(". ", "\n"), LONG.replace(".", ""), "x" * 50_000):
        cut = common.excerpt(text, 5000, lambda piece: "number 880 " in piece)
        assert 4000 <= len(cut) <= 5000 and all(line.strip() in text for line in cut.split("\n"))
        assert ("number 880 " in cut) == ("number 880 " in text) and common.excerpt(text, len(text)) == text


def _plain_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_secrets_base_spans_and_tags(docs):
    draw = random.Random(6)
    parts = ["password", "PassWd=", "API_key", "apikey:", ' = "', "AKIA", "ABCD1234EFGH5678", "0a1b2c3d" * 4, " ", "é", "tokEn :", "zz9_9-x.y/"]
    texts = ["".join(draw.choices(parts, k=9)) for _ in range(2000)]
    assert all(secrets.base_spans(t) == _plain_secrets(t) for t in texts)
    key = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:18]
    model = secrets.fit([f"some words here password={key(i)} and more words" for i in range(60)] + [f"only words here and more {i}" for i in range(200)])
    unseen = f"some words here passphrase={key(99)} and more words"
    rows = {r["doc_id"]: r for r in secrets.scan(docs(unseen, "only words here", texts[0], *HARD), model).collect()}
    assert rows[0]["spans"] == f"tagged:27:{27 + 18}" and rows[1]["spans"] == "" and rows[0]["n_assign"] == 0
    assert rows[2]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in _plain_secrets(texts[0])).encode()).hexdigest()
    assert secrets.mask_secrets(docs(unseen), model).first()["text"] == "some words here passphrase=[SECRET] and more words"


# --- chat ---------------------------------------------------------------------


def test_conversations_are_read_back(spark):
    texts = [r"\b \l </turn>", "<turn user>", "<next/>", "", None, "\\", "é🙂>"]
    turns = [(c, t, ["user", "assistant", "a>b<\\"][(c + t // 2) % 3], texts[(c * 3 + t) % 7]) for c in range(6) for t in range(7)]
    turns += [(None, 0, "assistant", "x"), (9, None, None, "y"), (9, 1, "assistant", "y"), (9, 1, "assistant", "y")]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, pieces int")
    found = chat.format_conversations(table)
    rows = found.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss"), "pieces")
    for r in rows.collect():
        own = sorted((t for t in turns if t[0] == r["conv_id"]), key=lambda t: (t[1] is not None, t[1] or 0))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(t[2] or "", t[3] or "") for t in own]
        assert r["loss"] == "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert "".join(p["piece"] for p in r["pieces"]) == r["formatted"]


# --- SimHash ------------------------------------------------------------------


def _plain_fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_components(nodes, linked):
    label = {n: n for n in nodes}
    for a, b in linked:
        x, y = label[a], label[b]
        label = {n: min(x, y) if v in (x, y) else v for n, v in label.items()}
    return label


@pytest.mark.parametrize("paired_cell", [1024, 1])
def test_simhash_groups_equal_all_pairs(docs, paired_cell):
    draw = random.Random(8)
    base = [" ".join(draw.choices([f"w{i}" for i in range(500)], k=400)) for _ in range(6)]
    texts = list(HARD)
    for text in base:
        for _ in range(8):
            words = text.split()
            words[draw.randrange(400)] = "changed"
            texts.append(" ".join(words))
    want = [_plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (want[i] ^ want[j]).bit_count() <= 4]
    label = _plain_components(range(len(texts)), pairs)
    table = docs(*texts)
    found = {r["doc_id"]: r for r in simhash.near_duplicates(table, paired_cell=paired_cell).collect()}
    assert [found[i]["fp"] % 2**64 for i in range(len(texts))] == want
    assert {i: r["component_id"] for i, r in found.items()} == label
    if paired_cell > 1:
        kept = simhash.first_documents(table.union(table.limit(1)))
        assert kept.columns == table.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label.values()))


@pytest.mark.parametrize("paired_cell", [1024, 64])
def test_simhash_cell_of_many_fingerprints(spark, paired_cell):
    draw = np.random.default_rng(4)
    low = np.unique(draw.integers(0, 1 << 18, 700))
    fps = [int(v) for v in low]
    table = spark.createDataFrame([(v,) for v in fps], "fp long")
    found = components.components(simhash.links(table, 4, paired_cell))
    label = {r["node"]: r["component"] for r in found.collect()}
    bits = np.bitwise_count(low[:, None] ^ low)
    pairs = [(fps[i], fps[j]) for i, j in zip(*np.nonzero(np.triu(bits <= 4, 1)))]
    want = _plain_components(fps, pairs)
    assert {v: label.get(v, v) for v in fps} == want


def test_one_row_of_each_group_stays_whatever_the_ids(docs):
    draw = random.Random(9)
    far = [" ".join(draw.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(8)]
    table = docs((None, far[0]), (None, far[1]), (None, far[1]), (7, far[2]), (7, far[3]), (None, far[2]), (7, far[4]), (3, far[4]), (7, far[5]), (7, far[5]), (None, None), (None, ""))
    kept = sorted(((r["doc_id"], r["text"] or "") for r in simhash.first_documents(table).collect()), key=str)
    assert kept == sorted([(None, far[0]), (None, far[1]), (7, far[2]), (7, far[3]), (3, far[4]), (7, far[5]), (None, "")], key=str)


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = components.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(i, 100) for i in range(100, 161)} | {(200, 200), (201, 200)}


def _plans(monkeypatch, module, *modules):
    """Names and plans of the tables that ``modules`` write, if Spark takes every table for small."""
    plans, write = [], module.cut_lineage

    def recorded(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    for m in (module, *modules):
        monkeypatch.setattr(m, "cut_lineage", recorded)
    return plans


@pytest.fixture
def all_small(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("paired_cell", [1024, 1])
def test_simhash_broadcasts_no_table_that_grows(docs, monkeypatch, all_small, paired_cell):
    draw = random.Random(8)
    base = draw.choices([f"w{i}" for i in range(500)], k=400)
    texts = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in range(0, 400, 20)]
    plans = _plans(monkeypatch, simhash, components)
    found = simhash.near_duplicates(docs(*texts), paired_cell=paired_cell)
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    joined = dict(plans)
    names = ("cells", "links", "fingerprint-components", "result")
    assert not [name for name in names if "Broadcast" in joined[name] or "SortMergeJoin" not in joined[name]]
    assert all(r["component_id"] is not None for r in found.collect())


def test_substring_dedup_broadcasts_no_table_of_symbols_or_windows(docs, monkeypatch, all_small):
    words = " ".join(f"w{i}" for i in range(60))
    plans = _plans(monkeypatch, recompression)
    kept = recompression.remove_repeats(docs(words, "x " + words + " y", "a b c"))
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {0: "", 1: "x y", 2: "a b c"}
    joined = dict(plans)
    names = ("shared-symbols", "shared-by-document", "repeated-windows", "repeated-by-document")
    assert not [name for name in names if "Broadcast" in joined[name] or "SortMergeJoin" not in joined[name]]
