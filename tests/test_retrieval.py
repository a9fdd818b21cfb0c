import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.retrieval import evaluation as e
from ledgerloom.retrieval import ranking as r
from ledgerloom.retrieval.dense import dense_top_k
from ledgerloom.retrieval.lexical import bm25

DOCS = [
    (1, "a", "Revenue revenue by month"), (2, "a", "orders by month and customer"), (3, "a", "late suppliers"),
    (4, "b", "revenue of the other tenant"), (5, "a", ""),
]
DOC = "id bigint, tenant string, text string"
QUERY = "query_id bigint, tenant string, text string"


def brute(docs, text, tenant):
    words = {i: re.findall(r"\w+", t.lower(), re.ASCII) for i, ten, t in docs if ten == tenant}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    scores = {}
    for i, ws in words.items():
        tf = Counter(ws)
        s = sum(
            math.log((n - df[q] + 0.5) / (df[q] + 0.5) + 1) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))
            for q in re.findall(r"\w+", text.lower(), re.ASCII)
        )
        if s > 0:
            scores[i] = s
    return scores


def test_bm25_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, DOC)
    asked = [(1, "a", "Revenue, revenue month"), (2, "b", "revenue month"), (3, "a", "nothing shared"), (4, "a", " ")]
    rows = bm25(docs, spark.createDataFrame(asked, QUERY), 10).collect()
    for query_id, tenant, text in asked:
        ours = {x["id"]: x["score"] for x in rows if x["query_id"] == query_id}
        assert ours == pytest.approx(brute(DOCS, text, tenant))
    assert max(x["normalized"] for x in rows if x["query_id"] == 1) == 1.0


def test_bm25_of_one_document(spark):
    docs = spark.createDataFrame([(1, "a", "only one")], DOC)
    rows = bm25(docs, spark.createDataFrame([(1, "a", "one")], QUERY)).collect()
    assert len(rows) == 1 and rows[0]["score"] > 0


def test_dense_with_text_ids_and_missing_vectors(spark):
    corpus = spark.createDataFrame(
        [("t:b", "t", [1.0, 0.0]), ("t:a", "t", [2.0, 0.0]), ("t:c", "t", [0.0, 1.0]), ("t:d", "t", None), ("u:a", "u", [1.0, 0.0])],
        "id string, tenant string, vector array<double>",
    )
    asked = spark.createDataFrame(
        [("q", "t", [1.0, 0.0]), ("none", "t", None)], "query_id string, tenant string, vector array<double>"
    )
    rows = dense_top_k(corpus, asked, 2).orderBy("rank").collect()
    assert [(x["query_id"], x["rank"], x["id"]) for x in rows] == [("q", 1, "t:a"), ("q", 2, "t:b")]
    assert dense_top_k(corpus, asked.where("query_id = 'none'"), 2).collect() == []


@pytest.mark.parametrize("block", [2, 4096])
def test_dense_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(200, 8))
    vectors[7] = 0
    vectors[11] = vectors[12]
    corpus = spark.createDataFrame(
        [(i, "ab"[i % 2], [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, tenant string, vector array<double>"
    ).repartition(5)
    queries = rng.normal(size=(5, 8))
    asked = spark.createDataFrame(
        [(q, "ab"[q % 2], [float(x) for x in v]) for q, v in enumerate(queries)], "query_id bigint, tenant string, vector array<double>"
    )
    rows = dense_top_k(corpus, asked, 6, block).collect()
    length = np.linalg.norm(vectors, axis=1)
    for q, v in enumerate(queries):
        cos = np.divide(vectors @ v, length * np.linalg.norm(v), out=np.zeros(200), where=length > 1e-9).round(6)
        best = sorted((i for i in range(200) if i % 2 == q % 2), key=lambda i: (-cos[i], i))[:6]
        assert [x["id"] for x in sorted(rows, key=lambda x: x["rank"]) if x["query_id"] == q] == best


def test_fusion_keeps_dense_order_on_ties(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i + 1, d) for i, d in enumerate(ids)], "query_id int, rank int, id int")
    rows = r.fuse(ranked([10, 20]), ranked([30, 40]), 4).orderBy("rank").collect()
    assert [x["id"] for x in rows] == [10, 30, 20, 40]
    both = r.fuse(ranked([10, 20]), ranked([20, 30]), 1).collect()
    assert both[0]["id"] == 20


def test_confidence_bands(spark):
    scores = {1: [0.9, 0.5], 2: [0.3, 0.21], 3: [0.16, 0.16], 4: [0.1, 0.09], 5: [0.4]}
    rows = [(q, i + 1, s) for q, ss in scores.items() for i, s in enumerate(ss)]
    results = spark.createDataFrame(rows, "query_id int, rank int, score double")
    asked = spark.createDataFrame([(q,) for q in range(1, 7)], "query_id int")
    found = {x["query_id"]: x for x in r.confidence(asked, results).collect()}
    assert [found[q]["confidence_band"] for q in range(1, 7)] == ["HIGH", "MEDIUM", "LOW", "VERY_LOW", "HIGH", "VERY_LOW"]
    assert found[1]["top1_to_top5_avg_ratio"] == pytest.approx(1.2857)
    assert found[6]["top1_absolute"] == 0.0


def test_unknown_tenant_and_ranker(spark):
    docs = spark.createDataFrame(DOCS, DOC)
    asked = spark.createDataFrame([(1, "a", "month"), (2, "z", "month")], QUERY)
    assert r.retrieve(docs, asked.where("query_id = 1"), 5, "bm25", tenants=["a", "b"]).count() == 2
    with pytest.raises(Exception, match="unknown tenant z"):
        r.retrieve(docs, asked, 5, "bm25", tenants=["a", "b"]).collect()
    with pytest.raises(ValueError, match="unknown ranker"):
        r.retrieve(docs, spark.createDataFrame([(1, "a", "x")], QUERY), ranker="guess")


def answer(spark, truth, run, valid=True):
    schema = "t array<struct<texts: array<string>, numbers: array<double>>>, r array<struct<texts: array<string>, numbers: array<double>>>, v boolean"
    df = spark.createDataFrame([(truth, run, valid)], schema)
    return df.select(e.answer_score(F.col("t"), F.col("r"), F.col("v"))).collect()[0][0]


def row(texts, *numbers):
    return (texts, [float(n) for n in numbers])


def test_answer_scores(spark):
    truth = [row([], 100)]
    assert answer(spark, truth, [row([], 100.9)]) == 3
    assert answer(spark, truth, [row([], 101.1)]) == 1
    assert answer(spark, truth, [row(["x"], 100), row(["y"], 7)]) == 2
    assert answer(spark, truth, [row([], 100)], valid=False) == 0
    assert answer(spark, truth, None) == 0
    assert answer(spark, [row(["only text"])], [row(["only text"])]) == 1
    many = [row(["North"], 10, 1), row(["South"], 20, 2)]
    assert answer(spark, many, [row(["the NORTH"], 10), row(["south"], 2)]) == 3
    assert answer(spark, many, [row(["north"], 10), row(["south"], 99)]) == 2
    assert answer(spark, many, [row(["east"], 10)]) == 1
    numbers_only = [row([], 2024, 5), row([], 2023, 6)]
    assert answer(spark, numbers_only, [row([], 5, 2024), row([], 6, 2023)]) == 3
    assert answer(spark, numbers_only, [row([], 5), row([], 6)]) == 1


def test_retrieval_scores(spark):
    cases = [
        (["m", "t1"], 5), (["m", "zz"], 4), (["t1", "t2", "zz"], 3), (["t1"], 2), (["x"], 1), (["zz"], 0), (None, 0),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "ids array<string>")
    a = lambda *xs: F.array(*[F.lit(x) for x in xs])
    scores = df.select(e.retrieval_score(F.col("ids"), a("m"), a("t1", "t2"), a("x")))
    assert [x[0] for x in scores.collect()] == [s for _, s in cases]


def test_controls_and_empty_results(spark):
    schema = "k string, ids array<string>, refused boolean, rows array<struct<texts: array<string>, numbers: array<double>>>"
    cases = [
        (("no_foreign", ["mine:a"], False, None), True), (("no_foreign", ["mine:a", "other:b"], True, None), False),
        (("no_foreign_no_answer", ["mine:a"], False, [row([], 0)]), True),
        (("no_foreign_no_answer", ["mine:a"], False, [row([], 5)]), False),
        (("refuse", ["mine:a"], False, []), False), (("refuse", None, True, None), True),
    ]
    df = spark.createDataFrame([c for c, _ in cases], schema)
    empty = e.is_empty_result(F.col("rows"), F.lit(True))
    found = df.select(e.control_passed(F.col("k"), F.col("ids"), "mine", F.col("refused"), empty))
    assert [x[0] for x in found.collect()] == [p for _, p in cases]


def test_refusals_are_counted(spark):
    results = spark.createDataFrame([("a", 1, 1, 10), ("a", 2, 1, 99)], "ranker string, query_id int, rank int, id int")
    bands = spark.createDataFrame(
        [("a", 1, "HIGH", 5.0), ("a", 2, "LOW", 7.0), ("a", 3, "VERY_LOW", 100.0)],
        "ranker string, query_id int, confidence_band string, millis double")
    questions = spark.createDataFrame(
        [(1, "HARD", False, True), (2, "EASY", False, True), (3, "EDGE", True, False)],
        "query_id int, difficulty string, blank boolean, expects_answer boolean",
    )
    truth = spark.createDataFrame([(1, 10), (2, 11)], "query_id int, id int")
    rows = {x["difficulty"]: x for x in e.retrieval_summary(results, bands, questions, truth).collect()}
    overall = rows["all"]
    assert (overall["questions"], overall["correct_refusals"], overall["high_confidence"], overall["mean_millis"]) == (3, 1, 1, 6.0)
    assert overall["top1_accuracy"] == pytest.approx(100 / 3) and rows["HARD"]["top1_accuracy"] == 100.0


def test_ten_thousand_queries_are_planned_without_a_job(spark):
    draw = np.random.default_rng(4)
    corpus, asked = draw.integers(-3, 4, (300, 6)).astype(float), draw.integers(-3, 4, (10_000, 6)).astype(float)
    docs = spark.createDataFrame([(f"d{i:03}", "a" if i % 3 else "b", v.tolist()) for i, v in enumerate(corpus)], "id string, tenant string, vector array<double>")
    queries = spark.createDataFrame([(i, "a" if i % 2 else "b", v.tolist()) for i, v in enumerate(asked)], "query_id long, tenant string, vector array<double>")
    context = spark.sparkContext
    context.setJobGroup("planning", "planning")
    found = dense_top_k(docs, queries, 3)
    assert list(context.statusTracker().getJobIdsForGroup("planning")) == []
    context.setJobGroup("other", "other")
    rows = {}
    for r in found.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append(r.id)
    unit = lambda x: np.divide(x, (n := np.linalg.norm(x, axis=1, keepdims=True)), out=np.zeros_like(x), where=n > 1e-9)
    scores = np.round(unit(asked) @ unit(corpus).T, 6)
    for q in range(0, 10_000, 37):
        own = [i for i in range(300) if bool(i % 3) == bool(q % 2)]
        assert rows[q] == [f"d{i:03}" for i in sorted(own, key=lambda i: (-scores[q, i], i))[:3]]
    assert len(rows) == 10_000


def test_all_rankers_rank_each_corpus_once(spark, monkeypatch):
    calls = []
    for name in ("bm25", "dense_top_k"):
        monkeypatch.setattr(r, name, lambda *a, f=getattr(r, name), n=name: calls.append(n) or f(*a))
    docs = spark.createDataFrame(
        [(i, "a", f"word{i % 3} other{i}", [1.0, float(i)]) for i in range(30)] + [(99, "a", None, None)], "id long, tenant string, text string, vector array<double>"
    )
    asked = spark.createDataFrame([(1, "a", "word1 other4", [1.0, 4.0]), (2, "a", " ", [1.0, 1.0])], "query_id long, tenant string, text string, vector array<double>")
    rows = r.retrieve_all(docs, asked, 4).collect()
    assert sorted(calls) == ["bm25", "dense_top_k"]
    for name in ("bm25", "dense", "rrf"):
        one = [tuple(x) for x in r.retrieve(docs, asked, 4, name).collect()]
        assert sorted(one) == sorted((x.query_id, x["rank"], x.id, x.score) for x in rows if x.ranker == name)


def test_bm25_moves_only_the_best_of_a_block(spark):
    """One word in every document: what is shuffled is packed blocks and k rows a query, not pairs."""
    docs = spark.range(3000).selectExpr("id", "'a' AS tenant", "concat('common word', id % 7) AS text")
    asked = spark.range(200).selectExpr("id AS query_id", "'a' AS tenant", "concat('common word', id % 9) AS text")
    found = bm25(docs, asked, 2)
    rows = found.collect()
    assert len(rows) == 400 and all(x.id == x.query_id % 9 + 7 * (x["rank"] - 1) for x in rows if x.query_id % 9 < 7)
    text = found._jdf.queryExecution().executedPlan().toString()
    joined = text[text.index("MapInArrow") :]
    assert "WindowGroupLimit" in text and not re.search(r"(Sort|Hash)Aggregate\(keys=\[query_id#\d+L?, id#", joined)


def test_the_probe_notices_a_retrieval_without_tenants(spark):
    from ledgerloom.operators.quality import tenant_probe

    docs = spark.createDataFrame([(f"{t}:{i}", t, f"shared word{i}") for t in ("a", "b") for i in range(4)], "id string, tenant string, text string")
    asked = spark.createDataFrame([("q1", "a", "shared word1"), ("q2", "b", "shared word2"), ("q3", "c", "shared")], "query_id string, tenant string, text string")
    owners = docs.select("id", "tenant")
    good = {x.check_id: x.passed for x in tenant_probe(r.retrieve(docs, asked, 3, "bm25"), asked, owners).collect()}
    assert good == {"isolation:a": True, "isolation:b": True, "isolation:c": False}  # c finds nothing
    open_to_all = docs.withColumn("tenant", F.explode(F.array(F.lit("a"), F.lit("b"))))
    bad = {x.check_id: x.passed for x in tenant_probe(r.retrieve(open_to_all, asked, 3, "bm25"), asked, owners).collect()}
    assert not bad["isolation:a"] and not bad["isolation:b"]
