"""SQL for retrieval and evaluation."""

from __future__ import annotations

WORDS = "regexp_extract_all(lower(text), '\\w+')"


def bm25(docs: str, queries: str, k: int = 5) -> str:
    """Common table expressions that end in ``ranked(query_id, id, score, rank)``; docs (id, tenant, text)."""
    return f"""docs AS ({docs}), queries AS ({queries}),
    dw AS MATERIALIZED (SELECT id, tenant, {WORDS} AS words FROM docs),
    st AS (SELECT tenant, COUNT(*) AS n, AVG(LEN(words)) AS avgdl FROM dw GROUP BY 1),
    tk AS (SELECT id, tenant, LEN(words) AS dl, unnest(words) AS term FROM dw),
    tf AS MATERIALIZED (SELECT tenant, term, id, dl, COUNT(*) AS tf FROM tk GROUP BY 1, 2, 3, 4),
    dfs AS MATERIALIZED (SELECT tenant, term, COUNT(*) AS df FROM tf GROUP BY 1, 2),
    qt AS (SELECT query_id, tenant, term, COUNT(*) AS repeats FROM (SELECT query_id, tenant, unnest({WORDS}) AS term FROM queries) GROUP BY 1, 2, 3),
    sc AS MATERIALIZED (SELECT qt.query_id, tf.id, SUM(qt.repeats * LN((st.n - dfs.df + 0.5) / (dfs.df + 0.5) + 1) * (tf.tf * 2.5)
        / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * tf.dl / st.avgdl))) AS score
      FROM qt JOIN tf ON qt.tenant = tf.tenant AND qt.term = tf.term JOIN dfs ON dfs.tenant = tf.tenant AND dfs.term = tf.term
      JOIN st ON st.tenant = tf.tenant GROUP BY 1, 2),
    ranked AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ROUND(score, 6) DESC, id) AS rank FROM sc) WHERE rank <= {k})"""


DOCS = "SELECT doc_id AS id, lang AS tenant, text FROM documents"
ASKED = """SELECT l.lang || ':' || b.item_id AS query_id, l.lang AS tenant, b.text
      FROM benchmark b, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l"""
BOTH_DOCS = "SELECT doc_id AS id, 'all' AS tenant, text FROM documents"
BOTH_ASKED = "SELECT b.item_id AS query_id, 'all' AS tenant, b.text FROM benchmark b WHERE b.item_id % 10 IN (SELECT label FROM embeddings)"
MEANS = """means AS MATERIALIZED (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, AVG(x) AS x FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""
PAIRS = f"""{MEANS},
    cs AS MATERIALIZED (SELECT m.label AS query_id, e.vec_id AS id, list_cosine_similarity(m.v, e.embedding::DOUBLE[]) AS score FROM means m, embeddings e)"""


ITEM_PAIRS = f"""{MEANS},
    cs AS MATERIALIZED (SELECT b.item_id AS query_id, e.vec_id AS id, list_cosine_similarity(m.v, e.embedding::DOUBLE[]) AS score
      FROM benchmark b JOIN means m ON m.label = b.item_id % 10, embeddings e)"""


def dense(k: int, pairs: str = PAIRS, docs: str = "") -> str:
    limits = f" AND id IN (SELECT id FROM {docs})" if docs else ""
    return f"""{pairs},
    near AS MATERIALIZED (SELECT * FROM (SELECT query_id, id, ROUND(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY ROUND(score, 6) DESC, id) AS rank
      FROM cs WHERE TRUE{limits}) WHERE rank <= {k})"""


def fused(k: int) -> str:
    return f"""{bm25(BOTH_DOCS, BOTH_ASKED, 10)}, {dense(10, ITEM_PAIRS, 'docs')},
    fu AS MATERIALIZED (SELECT query_id, id, ROUND(COALESCE(SUM(1E0 / (60 + dr)), 0) + COALESCE(SUM(1E0 / (60 + lr)), 0), 12) AS fused, MAX(dr) AS dr, MAX(lr) AS lr FROM (
      SELECT query_id, id, rank AS dr, NULL AS lr FROM near UNION ALL SELECT query_id, id, NULL, rank FROM ranked) GROUP BY 1, 2),
    rrf AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dr NULLS LAST, lr NULLS LAST) AS rank FROM fu) WHERE rank <= {k})"""


# the three rankers' results as results(ranker, query_id, rank, id, score)
RESULTS = f"""{fused(5)},
    results AS MATERIALIZED (
      SELECT 'bm25' AS ranker, query_id, rank, id, ROUND(score / MAX(score) OVER (PARTITION BY query_id), 4) AS score FROM ranked WHERE rank <= 5
      UNION ALL SELECT 'dense', query_id, rank, id, ROUND(GREATEST(0, score), 4) FROM near WHERE rank <= 5
      UNION ALL SELECT 'rrf', r.query_id, r.rank, r.id, ROUND(GREATEST(0, COALESCE(c.score, 0)), 4) FROM rrf r LEFT JOIN cs c ON r.query_id = c.query_id AND r.id = c.id)"""


def bands(results: str, keys: str) -> str:
    """``keys`` lists every (ranker, query_id) that was asked."""
    return f"""h AS (SELECT ranker, query_id, MAX(CASE WHEN rank = 1 THEN score END) AS t1, MAX(CASE WHEN rank = 2 THEN score END) AS t2,
        AVG(CASE WHEN rank <= 5 THEN score END) AS m5 FROM {results} GROUP BY 1, 2),
    b AS (SELECT k.ranker, k.query_id, COALESCE(t1, 0) AS t1, COALESCE(t1 - COALESCE(t2, 0), 0) AS gap, CASE WHEN m5 > 0 THEN t1 / m5 ELSE 0 END AS ratio
      FROM ({keys}) k LEFT JOIN h ON k.ranker = h.ranker AND k.query_id = h.query_id),
    bands AS (SELECT ranker, query_id, ROUND(t1, 4) AS top1_absolute, ROUND(gap, 4) AS top1_minus_top2_gap, ROUND(ratio, 4) AS top1_to_top5_avg_ratio,
      CASE WHEN gap >= 0.15 AND t1 >= 0.3 THEN 'HIGH' WHEN gap >= 0.08 AND t1 >= 0.2 THEN 'MEDIUM' WHEN gap >= 0.03 OR t1 >= 0.15 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence_band FROM b)"""


KEYS = "SELECT r.ranker, q.query_id FROM (VALUES ('bm25'), ('dense'), ('rrf')) r(ranker), queries q"
SUMMARY = f"""WITH {RESULTS}, {bands('results', KEYS)},
    hit AS (SELECT r.ranker, r.query_id, MAX(CASE WHEN r.rank = 1 AND e.label = r.query_id % 10 THEN 1 ELSE 0 END) AS t1,
      MAX(CASE WHEN e.label = r.query_id % 10 THEN 1 ELSE 0 END) AS t5 FROM results r JOIN embeddings e ON r.id = e.vec_id GROUP BY 1, 2),
    pq AS (SELECT b.*, COALESCE(t1, 0) AS top1, COALESCE(t5, 0) AS top5, CASE WHEN b.query_id % 2 = 0 THEN 'HARD' ELSE 'EASY' END AS difficulty, b.query_id * 3 + 10E0 AS ms
      FROM bands b LEFT JOIN hit ON b.ranker = hit.ranker AND b.query_id = hit.query_id)
    SELECT ranker, COALESCE(difficulty, 'all') AS difficulty, COUNT(*) AS questions, ROUND(SUM(top1) * 100E0 / COUNT(*), 4) AS top1_accuracy,
      ROUND(SUM(top5) * 100E0 / COUNT(*), 4) AS top5_recall, COUNT(CASE WHEN confidence_band = 'HIGH' THEN 1 END) AS high_confidence,
      COUNT(CASE WHEN confidence_band = 'VERY_LOW' THEN 1 END) AS very_low_confidence, COUNT(CASE WHEN query_id % 4 = 3 AND confidence_band = 'VERY_LOW' THEN 1 END) AS correct_refusals,
      ROUND(AVG(ms), 4) AS mean_millis FROM pq GROUP BY GROUPING SETS ((ranker), (ranker, difficulty))"""
DUEL = f"""WITH {RESULTS},
    w AS (SELECT r.query_id, MAX(CASE WHEN ranker = 'dense' THEN 1 ELSE 0 END) AS a, MAX(CASE WHEN ranker = 'bm25' THEN 1 ELSE 0 END) AS b
      FROM results r JOIN embeddings e ON r.id = e.vec_id AND e.label = r.query_id % 10 WHERE r.rank = 1 GROUP BY 1)
    SELECT q.query_id, CASE WHEN a = 1 AND b = 1 THEN 'Tie' WHEN a = 1 THEN 'dense' WHEN b = 1 THEN 'bm25' ELSE 'none' END AS winner
    FROM queries q LEFT JOIN w ON q.query_id = w.query_id"""

ANSWERS = """f AS (SELECT o_custkey::BIGINT AS n, YEAR(o_orderdate) AS y, ROUND(SUM(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2),
    md AS (SELECT * FROM (VALUES ('bm25', 0), ('dense', 1), ('rrf', 2), ('schema', 3)) t(mode, m)),
    met AS (SELECT f.n, md.mode, md.m, COUNT(*) AS total, COUNT(CASE WHEN (f.n + md.m + f.y) % 3 <> 0 THEN 1 END) AS good,
      CAST(ROUND(SUM(f.v) / 1000) AS BIGINT) AS size FROM f, md GROUP BY 1, 2, 3),
    sr AS (SELECT CAST(n AS VARCHAR) AS id, n, mode, m, size, CASE WHEN n % 5 = 4 THEN 'C' WHEN n % 2 = 0 THEN 'S' ELSE 'H' END AS tier, n % 7 = m AS refused,
      'metric_' || ((n + m) % 4) AS i1, 'table_' || (n % 3) AS i2, 'metric_' || (n % 4) AS p, 'table_' || (n % 3) AS t1, 'table_' || (n % 2) AS t2, 'metric_1' AS x,
      CASE WHEN n % 7 = m THEN 0 WHEN good >= 0.99 * total THEN 3 WHEN good >= 0.5 * total THEN 2 ELSE 1 END AS a FROM met),
    sc AS (SELECT *, CASE WHEN n % 5 = 4 THEN NULL ELSE a END AS a_score, CASE WHEN n % 5 = 4 OR mode = 'schema' THEN NULL
      WHEN i1 = p THEN CASE WHEN i1 IN (p, t1, t2, x) AND i2 IN (p, t1, t2, x) THEN 5 ELSE 4 END
      WHEN t1 = i2 AND t2 IN (i1, i2) THEN 3 WHEN t1 = i2 OR t2 = i2 THEN 2 WHEN i1 = x THEN 1 ELSE 0 END AS r_score FROM sr)"""


def sql() -> dict[str, str]:
    one_source = "SELECT doc_id AS id, lang AS tenant, text FROM documents WHERE source = 'src1'"
    first_texts = "SELECT MIN(doc_id) AS query_id, lang AS tenant, arg_min(text, doc_id) AS text FROM documents WHERE lang IS NOT NULL GROUP BY lang, source"
    blank_keys = "SELECT 'bm25' AS ranker, query_id FROM queries UNION ALL SELECT 'bm25', MIN(doc_id) - 1 FROM documents"
    return {
        "retrieval_corpus_statistics": f"SELECT lang AS tenant, COUNT(*) AS n_docs, ROUND(AVG(LEN({WORDS})), 6) AS avgdl FROM documents GROUP BY 1",
        "retrieval_vocabulary_weights": f"""WITH {bm25(DOCS, ASKED)} SELECT dfs.tenant, dfs.term, dfs.df, ROUND(LN((st.n - dfs.df + 0.5) / (dfs.df + 0.5) + 1), 6) AS idf
          FROM dfs JOIN st ON dfs.tenant = st.tenant WHERE dfs.term IN (SELECT term FROM qt)""",
        "retrieval_bm25": f"""WITH {bm25(DOCS, ASKED)} SELECT query_id, rank, id, ROUND(score, 4) AS score,
          ROUND(score / MAX(score) OVER (PARTITION BY query_id), 4) AS normalized FROM ranked""",
        "retrieval_bm25_of_one_source": f"""WITH {bm25(one_source, ASKED)} SELECT query_id, rank, id,
          ROUND(score / MAX(score) OVER (PARTITION BY query_id), 4) AS score FROM ranked""",
        "retrieval_dense": f"WITH {dense(5)} SELECT query_id, rank, id, ROUND(score, 4) AS score FROM near",
        "retrieval_fused": f"WITH {fused(5)} SELECT query_id, rank, id, ROUND(fused, 6) AS fused FROM rrf",
        "retrieval_all_rankers": f"WITH {RESULTS} SELECT ranker, query_id, rank, id, score FROM results",
        "retrieval_confidence": f"WITH {RESULTS}, {bands('results', KEYS)} SELECT ranker, query_id, confidence_band FROM bands",
        "retrieval_blank_query": f"""WITH {bm25(DOCS + " WHERE lang IS NOT NULL", first_texts)},
          res AS (SELECT 'bm25' AS ranker, query_id, rank, ROUND(score / MAX(score) OVER (PARTITION BY query_id), 4) AS score FROM ranked),
          {bands('res', blank_keys)} SELECT query_id, top1_absolute, top1_minus_top2_gap, top1_to_top5_avg_ratio, confidence_band FROM bands""",
        "retrieval_reranked": f"""WITH {bm25(BOTH_DOCS, BOTH_ASKED, 10)}, {ITEM_PAIRS},
          rr AS (SELECT r.query_id, r.id, 1 / (1 + EXP(-(ROUND(COALESCE(c.score, 0), 6) * 10 - 3))) AS score FROM ranked r LEFT JOIN cs c ON r.query_id = c.query_id AND r.id = c.id)
          SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ROUND(score, 9) DESC, id) AS rank, id, ROUND(score, 5) AS score FROM rr) WHERE rank <= 5""",
        "retrieval_pair_cosine": f"WITH {PAIRS} SELECT c.id, ROUND(c.score, 5) AS similarity FROM cs c JOIN embeddings e ON c.id = e.vec_id AND e.label = c.query_id",
        "evaluation_retrieval_summary": SUMMARY,
        "evaluation_head_to_head": DUEL,
        "evaluation_score_bands": f"""WITH docs AS ({BOTH_DOCS}), queries AS ({BOTH_ASKED}), {dense(5, ITEM_PAIRS, 'docs')},
          t AS (SELECT query_id, ROUND(GREATEST(0, score), 4) AS s FROM near WHERE rank = 1)
          SELECT COUNT(s) AS answered, COUNT(CASE WHEN s > 0.4 THEN 1 END) AS high_scores, COUNT(CASE WHEN s < 0.38 THEN 1 END) AS low_scores,
            COUNT(*) - COUNT(s) AS empty FROM queries q LEFT JOIN t ON q.query_id = t.query_id""",
        "evaluation_run_scores": f"WITH {ANSWERS} SELECT id, mode, tier, CAST(r_score AS DOUBLE) AS r_score, CAST(a_score AS DOUBLE) AS a_score FROM sc",
        "evaluation_controls": f"""WITH {ANSWERS} SELECT id, mode, CASE WHEN n % 2 = 0 THEN 'no_foreign' ELSE 'refuse' END AS control,
          CASE WHEN n % 2 = 0 THEN TRUE ELSE refused END AS passed FROM sc WHERE n % 5 = 4""",
        "evaluation_tier_mode_summary": f"""WITH {ANSWERS} SELECT COALESCE(tier, 'all') AS tier, mode, COUNT(*) AS n, ROUND(AVG(r_score), 4) AS mean_r,
          ROUND(AVG(a_score), 4) AS mean_a, ROUND(COUNT(CASE WHEN NOT refused THEN 1 END) * 100E0 / COUNT(*), 4) AS valid_pct,
          CAST(SUM(size) AS BIGINT) AS tokens_in, ROUND(SUM(size / 1e6), 4) AS cost_usd FROM sc GROUP BY GROUPING SETS ((tier, mode), (mode))""",
        "evaluation_pending_runs": f"WITH {ANSWERS} SELECT mode, id FROM sc WHERE NOT refused",
    }
