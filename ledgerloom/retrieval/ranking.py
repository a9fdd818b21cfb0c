"""One interface over the rankers, rank fusion, re-ranking and confidence bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import sigmoid
from ledgerloom.operators.ranking import top_n_per_group
from ledgerloom.retrieval.dense import dense_top_k, pair_cosine
from ledgerloom.retrieval.lexical import bm25
from ledgerloom.session import kept

RRF_K = 60
FUSE_DEPTH = 10


def fuse(dense: DataFrame, lexical: DataFrame, k: int = 5, depth: int = FUSE_DEPTH, constant: int = RRF_K) -> DataFrame:
    """``query_id, rank, id, fused``: reciprocal ranks summed over both rankers' top ``depth``.

    Equal sums keep the dense order, then the lexical order.
    """
    sides = dense.where(F.col("rank") <= depth).select("query_id", "id", F.col("rank").alias("dense_rank")).unionByName(
        lexical.where(F.col("rank") <= depth).select("query_id", "id", F.col("rank").alias("lexical_rank")),
        allowMissingColumns=True,
    )
    both = sides.groupBy("query_id", "id").agg(F.max("dense_rank").alias("dense_rank"), F.max("lexical_rank").alias("lexical_rank"))
    term = lambda c: F.coalesce(1.0 / (F.col(c) + constant), F.lit(0.0))
    summed = both.withColumn("fused", F.round(term("dense_rank") + term("lexical_rank"), 12))
    ranked = top_n_per_group(
        summed, ["query_id"], k,
        F.col("fused").desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(),
    )
    return ranked.select("query_id", "rank", "id", "fused")


def known_tenants_only(queries: DataFrame, tenants: Sequence[str]) -> DataFrame:
    """The queries; one of a tenant that is not listed raises when they are read."""
    unknown = F.raise_error(F.concat(F.lit("unknown tenant "), F.coalesce("tenant", F.lit("NULL"))))
    return queries.withColumn("tenant", F.when(F.col("tenant").isin(list(tenants)), F.col("tenant")).otherwise(unknown))


def retrieve(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 5,
    ranker: str = "rrf",
    metadata: Mapping[str, str] | None = None,
    tenants: Sequence[str] | None = None,
) -> DataFrame:
    """``query_id, rank, id, score`` with the chosen ranker.

    ``docs`` is ``(id, tenant, text, vector, ...)`` and ``queries`` ``(query_id, tenant,
    text, vector)``. The tenant and the ``metadata`` equalities cut the corpus before it is
    ranked; with ``tenants`` given, a query of any other tenant is an error. A blank query gets
    no results. ``rrf`` reports the cosine, in fused order, so
    its scores need not fall.
    """
    for column, wanted in (metadata or {}).items():
        docs = docs.where(F.col(column) == F.lit(wanted))
    asked = queries.where(F.trim("text") != "")
    if tenants is not None:
        asked = known_tenants_only(asked, tenants)
    if ranker == "bm25":
        return bm25(docs, asked, k).select("query_id", "rank", "id", F.round("normalized", 4).alias("score"))
    if ranker == "dense":
        return dense_top_k(docs, asked, k).withColumn("score", F.round(F.greatest(F.lit(0.0), F.col("score")), 4))
    if ranker != "rrf":
        raise ValueError(f"unknown ranker {ranker!r}")
    depth = max(FUSE_DEPTH, k)
    fused = fuse(dense_top_k(docs, asked, depth), bm25(docs, asked, depth), k)
    scored = pair_cosine(fused, docs, asked)
    return scored.select("query_id", "rank", "id", F.round(F.greatest(F.lit(0.0), F.col("score")), 4).alias("score"))


def retrieve_all(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``ranker, query_id, rank, id, score`` of the three rankers, as ``retrieve`` gives them.

    Each corpus is ranked once: the fused ranking follows from the other two, and all three are
    kept as one small table, from which truth, bands and summaries are derived.
    """
    asked = queries.where(F.trim("text") != "")
    depth = max(FUSE_DEPTH, k)
    lexical = bm25(docs, asked, depth).select(F.lit("bm25").alias("ranker"), "query_id", "rank", "id", F.col("normalized").alias("score"))
    dense = dense_top_k(docs, asked, depth).select(F.lit("dense").alias("ranker"), "query_id", "rank", "id", "score")
    ranked = kept(lexical.unionByName(dense))
    fused = fuse(ranked.where("ranker = 'dense'"), ranked.where("ranker = 'bm25'"), k)
    scored = pair_cosine(fused, docs, asked).select(F.lit("rrf").alias("ranker"), "query_id", "rank", "id", "score")
    every = ranked.where(F.col("rank") <= k).unionByName(scored)
    return kept(every.withColumn("score", F.round(F.greatest(F.lit(0.0), F.col("score")), 4)))


def rerank(results: DataFrame, pair_scores: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """Order the top ``depth`` by a supplied ``(query_id, id, logit)`` and keep k; score is its sigmoid."""
    scored = results.where(F.col("rank") <= depth).select("query_id", "id").join(pair_scores, ["query_id", "id"])
    scored = scored.select("query_id", "id", sigmoid(F.col("logit")).alias("score"))
    return top_n_per_group(scored, ["query_id"], k, F.round("score", 9).desc(), F.col("id"))


def confidence(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: best score, gap to the second, ratio to the mean of five, and a band.

    A query without results is ``VERY_LOW``.
    """
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("score")))
    heads = results.groupBy("query_id").agg(
        at(1).alias("top1"), at(2).alias("top2"), F.avg(F.when(F.col("rank") <= 5, F.col("score"))).alias("mean5")
    )
    top1, gap = F.coalesce("top1", F.lit(0.0)), F.coalesce(F.col("top1") - F.coalesce("top2", F.lit(0.0)), F.lit(0.0))
    ratio = F.when(F.col("mean5") > 0, F.col("top1") / F.col("mean5")).otherwise(F.lit(0.0))
    band = (
        F.when((gap >= 0.15) & (top1 >= 0.3), "HIGH")
        .when((gap >= 0.08) & (top1 >= 0.2), "MEDIUM")
        .when((gap >= 0.03) | (top1 >= 0.15), "LOW")
        .otherwise("VERY_LOW")
    )
    return queries.select("query_id").join(heads, "query_id", "left").select(
        "query_id",
        F.round(top1, 4).alias("top1_absolute"),
        F.round(gap, 4).alias("top1_minus_top2_gap"),
        F.round(ratio, 4).alias("top1_to_top5_avg_ratio"),
        band.alias("confidence_band"),
    )
