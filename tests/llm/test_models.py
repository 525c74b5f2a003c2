"""The fitted models: shortcuts equal plain forms, and what is found beyond what was learned."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from topicatlas.llm import common, crf, secrets, spans, toxicity

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    return [t or "" for t in pq.read_table(f"{SF_DIR}/documents.parquet", columns=["text"]).column("text").to_pylist()]


@pytest.fixture(scope="module")
def model(texts):
    return secrets.fit([t for t in texts if secrets.values(t)] + [t for t in texts if not secrets.values(t)][:300])


def _plain_scores(model, tokens, text):
    """Begin and inside of each token of a line, feature by feature."""
    forms = [secrets.shape(t) for t in tokens]
    total = np.zeros((len(tokens), 3))
    total[:, 1:] += model.file_scores(text)
    for k, token in enumerate(tokens):
        for side, (_, step) in enumerate(secrets.SIDES):
            if 0 <= k + step < len(tokens):
                features = secrets.own_features(token, forms[k]) if not step else secrets.near_features(tokens[k + step], forms[k + step])
                for f in features:
                    if f in model.weights:
                        total[k, 1:] += model.weights[f][2 * side : 2 * side + 2]
    return total


def _plain_tags(model, text):
    found, begin = [], 0
    for line in text.split("\n"):
        matches = list(secrets.TOKEN.finditer(line))
        if matches:
            scores = _plain_scores(model, [m[0] for m in matches], text)
            scores[0, secrets.INSIDE] -= 1e4
            labels = crf.viterbi(scores, model.moves, crf.Chains(np.array([len(matches)])))
            own = []
            for m, label in zip(matches, labels.tolist()):
                if label == secrets.BEGIN:
                    own.append((begin + m.start(), begin + m.end()))
                elif label == secrets.INSIDE and own:
                    own[-1] = (own[-1][0], begin + m.end())
            found += [s for s in own if s[1] - s[0] >= secrets.LEAST_CHARS]
        begin += len(line) + 1
    return found


def test_pieces_and_tables_equal_plain_viterbi(texts, model):
    rng = random.Random(2)
    value = lambda: "".join(rng.choices("0123456789abcdef", k=rng.randrange(6, 50)))
    made = [" ".join(rng.choice(["token", "=", '"', "words", value(), ":", "key", value()]) for _ in range(60)) for _ in range(80)]
    some = [t for t in texts if len(t) < 6000][:300] + made + ["", "\n\n", "x"]
    tagger = secrets.Tagger(model)
    assert [f for i in range(0, len(some), 40) for f in tagger.tagged(some[i : i + 40])] == [_plain_tags(model, t) for t in some]
    assert sum(bool(tagger.tagged([t])[0]) for t in made) > 20


def test_secrets_behind_words_no_pattern_names(texts, model):
    """Recall on held-out words and values, and what is tagged in documents without a secret."""
    rng = random.Random(3)
    tagger = secrets.Tagger(model)
    clean = [t for t in texts if not secrets.values(t)]
    hits = 0
    for i in range(200):
        value = "".join(rng.choices("0123456789abcdef", k=28))
        word = rng.choice(["passphrase", "credential", "signature", "bearer", "pin"])
        text = f'{clean[i][:150]} {word} = "{value}" {clean[i + 1][:80]}'
        hits += any(text[a:b] == value for a, b in tagger.tagged([text])[0])
    assert hits >= 190
    wrong = sum(bool(spans.apart(f, secrets.base_spans(t))) for t, f in zip(clean, tagger.tagged(clean)))
    assert wrong <= len(clean) / 200


def test_a_keyword_that_was_not_learned(texts):
    """Lines of one keyword are left out of the fit; its values are found all the same."""
    rng = random.Random(5)
    key = lambda: "".join(rng.choices("ABCDEFGHJKabcdefghjk0123456789", k=24))
    clean = [t for t in texts if not secrets.values(t)]
    learned = [f"{clean[i][:120]} {rng.choice(['password', 'secret', 'token'])} = {key()} {clean[i + 1][:90]}" for i in range(150)]
    model = secrets.fit(learned + clean[:300])
    tagger = secrets.Tagger(model)
    asked = [(f"{clean[i + 200][:120]} api_key = {v} {clean[i + 201][:90]}", v) for i, v in ((i, key()) for i in range(150))]
    hits = sum(any(v in text[a:b] for a, b in tagger.tagged([text])[0]) for text, v in asked)
    assert hits >= 140
    assert sum(bool(f) for f in tagger.tagged(clean)) <= len(clean) / 100


# --- toxicity -----------------------------------------------------------------


def _plain_telling(sample, toxic, weight, least, precision):
    words = list(sample.kind)
    docs_of = {}
    for d, k in zip(sample.doc.tolist(), sample.token.tolist()):
        for f in toxicity.own_features(words[k]):
            if f[0] in "wp":
                docs_of.setdefault(f, set()).add(d)
    bad = {d for d in range(sample.n_docs) if toxic[d]}
    good = {f: ds & bad for f, ds in docs_of.items()}
    share = {f: len(good[f]) / (len(good[f]) + weight * len(ds - bad)) for f, ds in docs_of.items() if good[f]}
    chosen, explained = set(), set()
    rest = {f for f, p in share.items() if len(good[f]) >= least and p >= precision}
    while rest:
        best = min(rest, key=lambda f: (-len(good[f] - explained), -len(f), f))
        if len(good[best] - explained) < least:
            break
        rest.remove(best)
        chosen.add(best)
        explained |= good[best]
    often = max(5 * least, len(bad) / 100)
    return chosen | {f for f, p in share.items() if f[0] == "w" and len(good[f]) >= often and p >= 0.98}


@pytest.mark.parametrize("seed", range(4))
def test_telling_features_equal_sets_of_documents(seed):
    rng = random.Random(seed)
    stems = ["vile", "rot", "ugly", "plain", "house", "tree", "river"]
    texts, toxic = [], []
    for i in range(150):
        toxic.append(i % 3 == 0)
        pool = stems if toxic[-1] else stems[3:]
        texts.append(" ".join(rng.choice(pool) + rng.choice(["", "s", "ness", "ing"]) for _ in range(rng.randrange(1, 12))))
    sample, y = toxicity.Sample(texts), np.array(toxic, int)
    for weight, least, precision in ((1.0, 2, 0.9), (3.0, 4, 0.6)):
        assert toxicity.telling_features(sample, y, weight, least, precision) == _plain_telling(sample, y, weight, least, precision)


def test_no_texts_and_no_words():
    assert toxicity.telling_features(toxicity.Sample([]), np.zeros(0, int)) == set()
    assert toxicity.telling_features(toxicity.Sample(["", "!"]), np.array([1, 0])) == set()
    model = toxicity.fit(["bad words", "", "fine words"], [1, 1, 0], [False] * 3)
    assert len(toxicity.Scorer(model).score(["", "bad"])["score"]) == 2


def test_toxicity_of_many_distinct_words_in_little_memory():
    """A task that meets 300,000 words once holds a bounded part of their scores."""
    model = toxicity.fit(["bad words", "", "fine words"], [1, 1, 0], [False] * 3)
    texts = [" ".join(f"word{i * 3_000 + j}x" for j in range(3_000)) for i in range(100)]
    scorer = toxicity.Scorer(model)
    scorer.score(["bad"])
    tracemalloc.start()
    scores = [scorer.score(part)["score"] for _, part in common.slices(pa.array(texts), 500_000)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000
    assert (np.concatenate(scores) == [toxicity.Scorer(model).score([t])["score"][0] for t in texts]).all()
