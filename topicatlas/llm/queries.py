"""One query per operator, each over its whole table, and the SQL where SQL can say it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicatlas.llm import chat, divergence, imatch, lattice, packing, periodic, pieces, pii
from topicatlas.llm import recompression, secrets, simhash, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hex_digest(text):
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query
def op1_pii(spark, sf):
    found = pii.find(table(spark, sf, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        hex_digest(pii.in_text(F.col("base"))).alias("base_sha256"),
        pii.in_text(pii.merged(F.col("base"), F.col("found"))).alias("spans"),
        F.size("found").cast("long").alias("n_context"),
    )


@query
def op2_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_sentencepiece(spark, sf):
    encoded = pieces.encode(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        hex_digest(F.col("decoded")).alias("decoded_sha256"),
    )


@query
def op4_imatch(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = imatch.compare_with_next(docs, imatch.lexicon(docs))
    return found.select(
        "doc_id",
        "n_chars",
        hex_digest(F.col("edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query
def op5_substring_dedup(spark, sf):
    kept = recompression.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), window=35)
    return kept.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        hex_digest(F.col("text")).alias("kept_sha256"),
    )


@query
def op6_lattice(spark, sf):
    return lattice.near_duplicates(table(spark, sf, "embeddings"), threshold=0.93)


@query
def op7_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fitted(docs, table(spark, sf, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


@query
def op8_chat_format(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))])).alias("t"),
    )
    turns = turns.unionByName(extra.select("conv_id", "t.turn", "t.role", "t.text"))
    read = chat.format_conversations(turns).select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("pieces")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_digest(whole).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        hex_digest(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op9_secret_scan(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fitted(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_tagged")


@query
def op10_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_divergence(spark, sf):
    return divergence.audit(table(spark, sf, "documents").select("lang", "source", "text"))


@query
def op12_periodic_runs(spark, sf):
    found = periodic.collapse_runs(periodic.with_planted_runs(table(spark, sf, "documents")))
    lines = F.transform("_runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.col("_best")
    return found.select(
        "doc_id",
        F.size("_runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        hex_digest(F.array_join(lines, "")).alias("runs_sha256"),
        hex_digest(F.col("text")).alias("collapsed_sha256"),
    )


@query
def op13_suffix_dedup(spark, sf):
    kept = suffixes.remove_later(table(spark, sf, "documents").select("doc_id", "text"))
    removed = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return kept.select(
        "doc_id",
        F.col("_n_bytes").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


ORACLE: dict[str, str] = {
    "op5_substring_dedup": r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT r, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
h AS (SELECT r, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h FROM s),
twice AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT r, i + unnest(range(35)) AS i FROM h WHERE h IN (SELECT h FROM twice)),
k AS (SELECT r, list(i) AS gone FROM covered GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, j: gone IS NULL OR NOT list_contains(gone, j)), ' ')) AS kept_sha256
FROM w LEFT JOIN k USING (r)
""",
    "op8_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS role_before,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS text_chars,
    length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) AS role_chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN role_before = role THEN 7 ELSE 15 + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op11_divergence": r"""
WITH w AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM w),
c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
  FROM (SELECT r, lang, source, unnest(terms) AS term FROM w) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
k AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, t.n AS lang_n
  FROM groups g JOIN kept t ON g.lang = t.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
s AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER g + 5 * count(*) OVER g) AS q
  FROM k WINDOW g AS (PARTITION BY lang, source)),
pair AS (
  SELECT g.lang, g.source, o.source AS item,
    coalesce((SELECT sum(abs(a.p - b.p)) FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term
              WHERE a.lang = g.lang AND a.source = g.source AND b.source = o.source), 0) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op13_suffix_dedup": r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, strlen(h) // 2 - 99 AS n, h, unnest(range(0, strlen(h) // 2 - 99, 1000)) AS c FROM d WHERE strlen(h) >= 200),
p AS (SELECT r, c, substr(h, 2 * c + 1, 2198) AS part, least(1000, n - c) AS n FROM b),
s AS (SELECT r, c, part, unnest(range(0, n)) AS j FROM p),
m AS (SELECT r, c + j AS i, row_number() OVER (PARTITION BY sha256(substr(part, 2 * j + 1, 200)) ORDER BY r, c + j) AS k FROM s),
later AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM m WHERE k > 1),
runs AS (SELECT r, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM later),
spans AS (SELECT r, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY r, run),
pieces AS (
  SELECT r, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1,
    2 * (a - coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0))) AS before FROM spans JOIN d USING (r)),
k AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(before, '' ORDER BY a) AS before, max(b) AS b
  FROM pieces GROUP BY r)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
""",
}
