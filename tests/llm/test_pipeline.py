"""The pipeline against the same five decisions made by plain loops."""

import itertools
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers

import corpus_pipeline
from topicatlas.llm import packing, secrets, toxicity

sys.path.insert(0, str(Path(__file__).parent))

from test_operators import SF_DIR, _plain_components, _plain_fingerprint, _plain_removal  # noqa: E402


def test_pipeline_equals_plain_loops(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    score = toxicity.Scorer(model).score([t for _, t in rows])["score"]
    rows = [r for r, s in zip(rows, score) if s < toxicity.THRESHOLD]
    prints = {i: _plain_fingerprint(t) for i, t in rows}
    near = [p for p in itertools.combinations(prints, 2) if (prints[p[0]] ^ prints[p[1]]).bit_count() <= 4]
    label = _plain_components(prints, near)
    rows = [(i, t) for i, t in rows if label[i] == i]
    texts = _plain_removal([t for _, t in rows], 35)
    spark_rows = spark.createDataFrame(list(zip([i for i, _ in rows], texts)), "doc_id long, text string")
    tagger = secrets.Tagger(found) if (found := secrets.fitted(spark_rows)) else None
    texts = [secrets.masked(t, whole) for t, (_, whole) in zip(texts, secrets.all_spans(texts, tagger))]
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for (i, _), text in zip(rows, texts):
        ids = np.append(encoder.whole.encode(text, add_special_tokens=False).ids, 1).astype("<u4")
        want |= {(i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)}
    result = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {tuple(r)[:5] for r in result} == want and len(result) == len(want)
    for _, own in itertools.groupby(sorted(result, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        end = 0
        for r in own:
            assert r["offset"] == end
            end += r["length"]
        assert end <= 2048


def test_stages_keep_the_columns(spark, docs):
    table = docs(None, "", "a b c", "a b c", ("x " * 50))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, table, SF_DIR).columns == table.columns
