"""The registered query of each operator, with production parameters, and SQL where there is one."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    decontamination, languages, licenses, mixing, near_duplicates, neighbours, quality, scoring, search, sharding, spellings,
    substrings, tokens,
)
from ledgerloom.llm.common import is_held_out, table

# shares of expected tokens that training is to see
TARGETS = {"good": 0.90, "low": 0.09, "toxic": 0.01}
TOKENIZER = "piece_bpe_32k.model"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of all documents for the target shares of labelled domains."""
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mix_rates(table(spark, sf_dir, "documents"), labelled, TARGETS)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.decontaminate(documents, benchmark).drop("text_key")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = substrings.remove_repeats(table(spark, sf_dir, "documents"), width=400, keep="none")
    return substrings.digest(removed)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_tokens(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """``model`` is the path of the tokenizer file; by default that of the public vocabulary."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(TOKENIZER)
    return tokens.count_tokens(table(spark, sf_dir, "documents"), Path(model).read_bytes(), limit=4096)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.predict_languages(table(spark, sf_dir, "documents"), is_held_out(5, 0))


def op10_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_texts(table(spark, sf_dir, "documents"), is_held_out(7, 2))


def op11_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.spelling_forms(table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return neighbours.score_quality(table(spark, sf_dir, "documents"), labelled, is_held_out(4, 2))


def queries() -> dict:
    found = [
        op1_mixing, op2_licenses, op3_decontamination, op4_substrings, op5_sharding, op6_near_duplicates,
        op7_tokens, op8_quality, op9_languages, op10_scoring, op11_spellings, op12_search, op13_neighbours,
    ]
    return {query.__name__: query for query in found}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(u=UPPER, l=LOWER)


def _license_sql() -> str:
    phrase_rows, block_rows = [], []
    for phrase, label in licenses.PHRASES.items():
        n = len(phrase.split(" "))
        phrase_rows.append(
            f"SELECT doc_id, '{label}' AS label, i FROM d, unnest(range(len(w) - {n - 1})) AS t(i)"
            f" WHERE array_to_string(w[i + 1:i + {n}], ' ') = '{phrase}'"
        )
    for label, text in licenses.TEMPLATES.items():
        distinct = sorted(set(text.split(" ")))
        listed = ", ".join(f"'{t}'" for t in distinct)
        needed = ", ".join(f"'{t}'" for t in licenses.REQUIRED.get(label, []))
        block_rows.append(f"('{label}', [{listed}], CAST([{needed}] AS VARCHAR[]))")
    half = licenses.BLOCK_WORDS // 2
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS ({' UNION ALL '.join(phrase_rows)}),
b AS (
  SELECT doc_id, i, list_distinct(w[i * {half} + 1:i * {half} + {licenses.BLOCK_WORDS}]) AS own
  FROM d, unnest(range(greatest(1, CAST(ceil((len(w) - {half}) / {half}.0) AS BIGINT)))) AS t(i)
),
t(label, tokens, required) AS (VALUES {', '.join(block_rows)}),
m AS (
  SELECT doc_id, i, label, len(list_intersect(own, tokens)) / CAST(len(tokens) AS DOUBLE) AS containment
  FROM b, t WHERE len(list_intersect(own, tokens)) >= ceil(round({licenses.THRESHOLD} * len(tokens), 6))
    AND len(list_intersect(own, required)) = len(required)
),
ps AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id
),
ms AS (SELECT doc_id, max(containment) AS best, count(DISTINCT i) AS n_blocks FROM m GROUP BY doc_id),
ls AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN ps USING (doc_id) LEFT JOIN ms USING (doc_id) LEFT JOIN ls USING (doc_id)
"""


DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k + 1:k + least(len(w), 13)], ' ') AS g
  FROM i, unnest(range(greatest(len(w) - 12, 1))) AS t(k) WHERE len(w) > 0
),
places AS (
  SELECT doc_id, k, n, array_to_string(w[k + 1:k + n], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS k FROM d, (SELECT DISTINCT n FROM grams))
),
hits AS (SELECT doc_id, k, n, item_id FROM places JOIN grams USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS spot FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed
  FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(u=UPPER, l=LOWER)
SEARCH_SQL = f"""
WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM d WHERE len(w) > 0),
q AS (SELECT item_id, t, count(*) AS r FROM (SELECT item_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
p AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t
),
v AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY t, n_docs
),
g AS (
  SELECT item_id, doc_id,
    CAST(sum(r * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN v USING (t), s GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM g WHERE score > 0 QUALIFY rank <= 10
"""

# the jump of each key: state before the jump, shard, next place
SHARDING_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, text, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM documents
),
k AS (SELECT DISTINCT key FROM d),
jumps AS (
  SELECT key, n, CAST(key AS HUGEINT) AS state, CAST(-1 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS ahead
  FROM k, (VALUES (40), (41)) AS s(n)
  UNION ALL
  SELECT key, n, next, ahead,
    CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / CAST(next // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (
    SELECT key, n, shard, ahead, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS next
    FROM jumps WHERE ahead < n
  )
),
found AS (SELECT key, n, shard FROM jumps WHERE ahead >= n),
sized AS (
  SELECT doc_id, key, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, text,
    a.shard AS shard, b.shard AS grown
  FROM d JOIN found a USING (key) JOIN found b USING (key) WHERE a.n = 40 AND b.n = 41
)
SELECT doc_id, size, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM sized
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB has no crc32, so the queries that need one are tested against brute-force versions."""
    return {"op2_licenses": _license_sql(), "op3_decontamination": DECONTAMINATION_SQL, "op12_search": SEARCH_SQL}
