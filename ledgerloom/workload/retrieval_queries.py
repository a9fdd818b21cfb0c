"""Lexical, dense and fused retrieval, and the scoring of retrieval and answers.

Lexical queries are the ``benchmark`` texts, each asked of the ``documents`` of every language;
dense queries are the mean vector of each label over all ``embeddings``; fused queries are all
``benchmark`` texts with such a vector each, over all ``documents`` with or without a vector.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import cosine
from ledgerloom.retrieval import evaluation as e
from ledgerloom.retrieval import ranking as r
from ledgerloom.retrieval.dense import dense_top_k, mean_vectors, pair_cosine
from ledgerloom.retrieval.lexical import bm25, corpus_statistics, postings, query_terms, term_weights
from ledgerloom.sources import files
from ledgerloom.workload.common import Query, on_distributor, on_raw


LABELS = 10


def documents(t: Any) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("tenant"), "text", "source")


def text_queries(t: Any) -> DataFrame:
    """Every benchmark text, once for each language of the documents."""
    languages = t("documents").agg(F.array_sort(F.collect_set("lang")).alias("languages"))
    asked = t("benchmark").select("item_id", "text", languages.scalar().alias("languages"))
    spread = asked.select("item_id", "text", F.explode("languages").alias("tenant"))
    return spread.select(F.concat_ws(":", "tenant", F.col("item_id").cast("string")).alias("query_id"), "tenant", "text")


def vectors(t: Any) -> DataFrame:
    return t("embeddings").select(
        F.col("vec_id").alias("id"), F.lit("all").alias("tenant"), F.col("embedding").alias("vector"), "label"
    )


def label_queries(t: Any) -> DataFrame:
    means = mean_vectors(t("embeddings"), "label", "embedding")
    return means.select(F.col("label").cast("bigint").alias("query_id"), F.lit("all").alias("tenant"), "vector")


def both_documents(t: Any) -> DataFrame:
    """All documents as one tenant; one without a vector is found by its text alone."""
    texts = documents(t).select("id", F.lit("all").alias("tenant"), "text", "source")
    return texts.join(vectors(t).drop("tenant"), "id", "left")


def both_queries(t: Any) -> DataFrame:
    """Every benchmark text, with the mean vector of a label: the labels are dealt out in turn."""
    means = label_queries(t).withColumnRenamed("query_id", "label")
    texts = t("benchmark").select(F.col("item_id").alias("query_id"), "text", (F.col("item_id") % LABELS).alias("label"))
    return texts.join(means, "label").select("query_id", "tenant", "text", "vector", "label")


def truth(t: Any, results: DataFrame) -> DataFrame:
    """The retrieved documents that carry their query's label."""
    labelled = t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"))
    wanted = both_queries(t).select("query_id", "label")
    return results.select("query_id", "id").distinct().join(labelled, "id").join(wanted, ["query_id", "label"]).select("query_id", "id")


def lexical_statistics(spark: Any, t: Any) -> DataFrame:
    return corpus_statistics(documents(t))


def vocabulary_weights(spark: Any, t: Any) -> DataFrame:
    docs = documents(t)
    vocabulary = query_terms(text_queries(t)).select("tenant", "term").distinct()
    return term_weights(postings(docs, vocabulary), corpus_statistics(docs)).select("tenant", "term", "df", "idf")


def all_rankers(t: Any) -> DataFrame:
    return r.retrieve_all(both_documents(t), both_queries(t), 5)


def reranked(spark: Any, t: Any) -> DataFrame:
    """Re-rank fused results by a supplied pair score: here ten times the cosine less three."""
    docs, asked = both_documents(t), both_queries(t)
    first = r.retrieve(docs, asked, 10, "bm25")
    logits = pair_cosine(first.select("query_id", "id"), docs, asked).select(
        "query_id", "id", (F.round("score", 6) * 10 - 3).alias("logit")
    )
    return r.rerank(first, logits, 5).select("query_id", "rank", "id", "score")


def blank_and_known(spark: Any, t: Any) -> DataFrame:
    """The first text of each language and source as a query, next to a blank one that finds nothing."""
    docs = documents(t).where("tenant is not null")
    asked = t("documents").where("lang is not null").groupBy("lang", "source").agg(
        F.min("doc_id").alias("query_id"), F.min_by("text", "doc_id").alias("text")
    ).select("query_id", F.col("lang").alias("tenant"), "text")
    blank = t("documents").agg((F.min("doc_id") - 1).alias("query_id"), F.min("lang").alias("tenant")).select(
        "query_id", "tenant", F.lit("  ").alias("text")
    )
    every = asked.unionByName(blank)
    return r.confidence(every, r.retrieve(docs, every, 5, "bm25"))


def _bands(t: Any, results: DataFrame) -> DataFrame:
    asked = both_queries(t)
    parts = []
    for name in ("bm25", "dense", "rrf"):
        bands = r.confidence(asked, results.where(F.col("ranker") == name))
        parts.append(bands.select(F.lit(name).alias("ranker"), "query_id", "confidence_band", (F.col("query_id") * 3 + 10.0).alias("millis")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _questions(t: Any) -> DataFrame:
    hard = F.when(F.col("query_id") % 2 == 0, "HARD").otherwise("EASY")
    return both_queries(t).select(
        "query_id", hard.alias("difficulty"), F.lit(False).alias("blank"), (F.col("query_id") % 4 != 3).alias("expects_answer")
    )


def summary(spark: Any, t: Any) -> DataFrame:
    results = all_rankers(t)
    return e.retrieval_summary(results, _bands(t, results), _questions(t), truth(t, results))


def duel(spark: Any, t: Any) -> DataFrame:
    results = all_rankers(t)
    return e.head_to_head(results, truth(t, results), _questions(t), "dense", "bm25")


# --- answer scoring: one question per customer, its revenue by year is the truth --------------


def customer_years(wh: Any) -> DataFrame:
    """Revenue per customer and year: as many rows per customer as it has years with orders."""
    return wh["orders"].groupBy(
        F.col("o_custkey").cast("bigint").alias("customer"), F.year("o_orderdate").alias("year")
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


def _rows(label: Any, revenue: Any) -> Any:
    return F.struct(F.array(label).alias("texts"), F.array(revenue).alias("numbers"))


def answers(wh: Any) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, questions and truth. A run's figures are off by an amount its mode, customer and year decide.

    A question is asked in every mode, so runs grow with the customers. Result rows are gathered
    once per customer, in one shuffle, and turned into each mode's answer inside the row.
    """
    customer = F.col("customer")
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    # a customer has one row per year, so these lists are short
    facts = customer_years(wh).groupBy("customer").agg(
        F.sort_array(F.collect_list(F.struct("year", "revenue"))).alias("years"), F.sum("revenue").alias("total")
    )
    truth_rows = facts.select(
        customer.cast("string").alias("id"),
        F.transform("years", lambda y: _rows(text("Year ", y["year"]), y["revenue"])).alias("truth_rows"),
    )
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(i).alias("m")) for i, m in enumerate(("bm25", "dense", "rrf", "schema"))])
    m = F.col("m")
    off = lambda year: F.when((customer + m + year) % 3 == 0, 1.05).otherwise(1.005)
    size = F.round(F.col("total") / 1000).cast("bigint")
    runs = facts.select("customer", "years", "total", F.inline(modes)).select(
        customer.cast("string").alias("id"), "mode",
        F.array(text("distributor:metric_", (customer + m) % 4), text("distributor:table_", customer % 3)).alias("retrieved_chunk_ids"),
        F.transform("years", lambda y: _rows(text("year ", y["year"]), y["revenue"] * off(y["year"]))).alias("result_rows"),
        (customer % 7 == m).alias("refused"), (customer % 7 != m).alias("sql_valid"),
        size.alias("tokens_in"), (size / 1e6).alias("cost_usd"),
        F.when(customer % 5 == 4, "C").when(customer % 2 == 0, "S").otherwise("H").alias("tier"),
    )
    questions = facts.select(
        customer.cast("string").alias("id"),
        F.when(customer % 5 == 4, F.when(customer % 2 == 0, "no_foreign").otherwise("refuse")).alias("control"),
        F.array(text("distributor:metric_", customer % 4)).alias("primary"),
        F.array(text("distributor:table_", customer % 3), text("distributor:table_", customer % 2)).alias("tables"),
        F.array(F.lit("distributor:metric_1")).alias("extra"),
    )
    return runs, questions, truth_rows


def scored_answers(wh: Any) -> DataFrame:
    scored = e.score_runs(*answers(wh))
    return scored.select("id", "mode", "tier", F.col("r_score").cast("double"), F.col("a_score").cast("double"))


def controls(wh: Any) -> DataFrame:
    runs, questions, _ = answers(wh)
    asked = runs.join(questions.where("control is not null").select("id", "control"), "id")
    empty = e.is_empty_result(F.col("result_rows"), F.col("sql_valid"))
    passed = e.control_passed(F.col("control"), F.col("retrieved_chunk_ids"), "distributor", F.col("refused"), empty)
    return asked.select("id", "mode", "control", passed.alias("passed"))


def resumed(wh: Any) -> DataFrame:
    """Write the refused runs to a log, read it back, and list what is left to run."""
    runs, _, _ = answers(wh)
    log = files.shared_folder(wh.spark, "runs")
    files.append_run_log(runs.where("refused"), log)
    return e.pending_runs(runs.select("mode", "id"), files.read_run_log(wh.spark, log))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "retrieval_corpus_statistics": on_raw(lexical_statistics),
        "retrieval_vocabulary_weights": on_raw(vocabulary_weights),
        "retrieval_bm25": on_raw(
            lambda spark, t: bm25(documents(t), text_queries(t), 5).select("query_id", "rank", "id", "score", "normalized"), 4
        ),
        "retrieval_bm25_of_one_source": on_raw(
            lambda spark, t: r.retrieve(documents(t), text_queries(t), 5, "bm25", {"source": "src1"}), 4
        ),
        "retrieval_dense": on_raw(lambda spark, t: dense_top_k(vectors(t), label_queries(t), 5), 4),
        "retrieval_fused": on_raw(
            lambda spark, t: r.fuse(
                dense_top_k(both_documents(t), both_queries(t), 10), bm25(both_documents(t), both_queries(t), 10), 5
            )
        ),
        "retrieval_all_rankers": on_raw(lambda spark, t: all_rankers(t), 4),
        "retrieval_confidence": on_raw(lambda spark, t: _bands(t, all_rankers(t)).drop("millis")),
        "retrieval_blank_query": on_raw(blank_and_known, 4),
        "retrieval_reranked": on_raw(reranked, 5),
        "retrieval_pair_cosine": on_raw(
            lambda spark, t: vectors(t).join(label_queries(t).select(F.col("query_id").alias("label"), F.col("vector").alias("mean")), "label").select(
                "id", cosine(F.col("vector"), F.col("mean")).alias("similarity")
            ), 5,
        ),
        "evaluation_retrieval_summary": on_raw(summary, 4),
        "evaluation_head_to_head": on_raw(duel),
        "evaluation_score_bands": on_raw(
            lambda spark, t: e.score_bands(r.retrieve(both_documents(t), both_queries(t), 5, "dense"), both_queries(t), 0.4, 0.38)
        ),
        "evaluation_run_scores": on_distributor(scored_answers),
        "evaluation_controls": on_distributor(controls),
        "evaluation_tier_mode_summary": on_distributor(lambda wh: e.tier_mode_summary(e.score_runs(*answers(wh)))),
        "evaluation_pending_runs": on_distributor(resumed),
    }
    return found

