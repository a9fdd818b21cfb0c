"""Scoring of retrieval and answers from run logs.

A run is one row; its retrieved ids and result rows are arrays inside that row (a captured
result holds at most a hundred rows), so runs and truths meet one to one per question and
no pairs of result rows are built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import top_n_per_group

# Relative tolerance of a number, and the matched fractions for scores 3 and 2.
TOLERANCE = 0.01
FULL_MATCH = 0.99
HALF_MATCH = 0.5


def retrieval_summary(results: DataFrame, bands: DataFrame, questions: DataFrame, truth: DataFrame) -> DataFrame:
    """Per ranker, over all questions and per difficulty.

    ``results (ranker, query_id, rank, id)``, ``bands (ranker, query_id, confidence_band,
    millis)``, ``questions (query_id, difficulty, blank, expects_answer)``, ``truth (query_id,
    id)`` holds acceptable ids, at least those among the results. A question that expects no
    answer expects a refusal.
    """
    hits = (
        results.where(F.col("rank") <= 5)
        .join(truth.withColumn("good", F.lit(True)), ["query_id", "id"], "left")
        .groupBy("ranker", "query_id")
        .agg(
            F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("good"))), F.lit(False)).alias("top1"),
            F.coalesce(F.max("good"), F.lit(False)).alias("top5"),
        )
    )
    per_query = bands.join(questions, "query_id").join(hits, ["ranker", "query_id"], "left")
    n = F.count(F.lit(1))
    count_if = lambda c: F.count(F.when(c, 1))
    share = lambda c: F.try_divide(count_if(c) * 100.0, n)
    refused = ~F.col("expects_answer") & (F.col("confidence_band") == "VERY_LOW")
    return (
        per_query.groupingSets([["ranker"], ["ranker", "difficulty"]], "ranker", "difficulty")
        .agg(
            n.alias("questions"),
            share(F.col("top1")).alias("top1_accuracy"),
            share(F.col("top5")).alias("top5_recall"),
            count_if(F.col("confidence_band") == "HIGH").alias("high_confidence"),
            count_if(F.col("confidence_band") == "VERY_LOW").alias("very_low_confidence"),
            count_if(refused).alias("correct_refusals"),
            F.avg(F.when(~F.col("blank"), F.col("millis"))).alias("mean_millis"),
        )
        .withColumn("difficulty", F.coalesce("difficulty", F.lit("all")))
    )


def head_to_head(results: DataFrame, truth: DataFrame, questions: DataFrame, first: str, second: str) -> DataFrame:
    """Per question: whose best hit is acceptable: both (``Tie``), one, or neither (``none``)."""
    best = results.where("rank = 1").join(truth, ["query_id", "id"], "left_semi")
    right = lambda who: F.max(F.col("ranker") == who)
    won = best.groupBy("query_id").agg(right(first).alias("a"), right(second).alias("b"))
    return questions.select("query_id").join(won, "query_id", "left").select(
        "query_id",
        F.when(F.col("a") & F.col("b"), "Tie").when(F.col("a"), first).when(F.col("b"), second).otherwise("none").alias("winner"),
    )


def retrieval_score(ids: Column, primary: Column, tables: Column, extra: Column) -> Column:
    """0 nothing, 1 domain only, 2 some tables, 3 all tables, 4 the metric, 5 only what belongs."""
    ids = F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))
    accepted = F.array_union(F.array_union(primary, tables), F.coalesce(extra, F.array().cast("array<string>")))
    only_accepted = F.size(F.array_except(ids, accepted)) == 0
    all_tables = (F.size(tables) > 0) & (F.size(F.array_except(tables, ids)) == 0)
    return (
        F.when(F.arrays_overlap(ids, primary), F.when(only_accepted, 5).otherwise(4))
        .when(all_tables, 3)
        .when(F.arrays_overlap(ids, tables), 2)
        .when(F.arrays_overlap(ids, accepted), 1)
        .otherwise(0)
    )


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= TOLERANCE * F.greatest(F.abs(b), F.lit(1e-9))


def answer_score(truth_rows: Column, run_rows: Column, sql_valid: Column) -> Column:
    """0 failed, 1 wrong, 2 at least half matched or another grain, 3 matched.

    Rows are ``struct<texts: array<string>, numbers: array<double>>``. A single-row truth is
    matched number by number against all numbers of the run. Otherwise a truth row is met
    when one run row carries all its texts (either containing the other) and a close number;
    a truth row without texts needs all its numbers in one run row.
    """
    seen = F.flatten(F.transform(run_rows, lambda r: r["numbers"]))
    targets = F.element_at(truth_rows, 1)["numbers"]
    matched = F.size(F.filter(targets, lambda t: F.exists(seen, lambda m: _close(m, t))))
    one_row = (
        F.when(F.size(targets) == 0, 1)
        .when(matched == F.size(targets), F.when(F.size(run_rows) == 1, 3).otherwise(2))
        .when(matched >= F.greatest(F.lit(1.0), F.size(targets) / 2), 2)
        .otherwise(1)
    )

    def met(wanted: Column) -> Column:
        texts, numbers = wanted["texts"], wanted["numbers"]

        def by(row: Column) -> Column:
            named = F.forall(
                texts,
                lambda e: F.exists(
                    row["texts"],
                    lambda m: F.contains(F.lower(m), F.lower(e)) | F.contains(F.lower(e), F.lower(m)),
                ),
            )
            found = lambda t: F.exists(row["numbers"], lambda m: _close(m, t))
            any_number = (F.size(numbers) == 0) | F.exists(numbers, found)
            all_numbers = F.forall(numbers, found)
            return F.when((F.size(texts) == 0) & (F.size(numbers) > 0), all_numbers).otherwise(named & any_number)

        return F.exists(run_rows, by)

    fraction = F.size(F.filter(truth_rows, met)) / F.size(truth_rows)
    many_rows = F.when(fraction >= FULL_MATCH, 3).when(fraction >= HALF_MATCH, 2).otherwise(1)
    return F.when(~sql_valid | run_rows.isNull(), 0).when(F.size(truth_rows) == 1, one_row).otherwise(many_rows)


def control_passed(expectation: Column, ids: Column, tenant: str, refused: Column, empty: Column) -> Column:
    """``no_foreign``: only the tenant's ids; ``no_foreign_no_answer``: and refused or empty; else refused."""
    foreign = F.exists(F.coalesce(ids, F.array().cast("array<string>")), lambda i: ~F.startswith(i, F.lit(f"{tenant}:")))
    return (
        F.when(expectation == "no_foreign", ~foreign)
        .when(expectation == "no_foreign_no_answer", ~foreign & (refused | empty))
        .otherwise(refused)
    )


def is_empty_result(run_rows: Column, sql_valid: Column) -> Column:
    """Ran, and returned no row or only zeros and NULLs."""
    blank = F.forall(
        run_rows, lambda r: (F.size(r["texts"]) == 0) & F.forall(r["numbers"], lambda x: x.isNull() | (x == 0))
    )
    return sql_valid & run_rows.isNotNull() & blank


def score_runs(runs: DataFrame, questions: DataFrame, truth: DataFrame) -> DataFrame:
    """Runs with ``r_score`` and ``a_score``; NULL where a score does not apply.

    ``questions (id, control, primary, tables, extra)``; ``truth (id, truth_rows)``. Runs
    that read the whole schema have no retrieval score.
    """
    joined = runs.join(questions, "id").join(truth, "id", "left")
    control = F.col("control").isNotNull()
    r = retrieval_score(F.col("retrieved_chunk_ids"), F.col("primary"), F.col("tables"), F.col("extra"))
    a = answer_score(F.col("truth_rows"), F.col("result_rows"), F.col("sql_valid"))
    return joined.withColumn("r_score", F.when(~control & (F.col("mode") != "schema"), r)).withColumn(
        "a_score", F.when(~control, a)
    )


def tier_mode_summary(scored: DataFrame) -> DataFrame:
    """Runs, mean scores, valid share, tokens and cost per tier and mode, and over all tiers."""
    return (
        scored.groupingSets([["tier", "mode"], ["mode"]], "tier", "mode")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("r_score").alias("mean_r"),
            F.avg("a_score").alias("mean_a"),
            F.try_divide(F.count(F.when(F.col("sql_valid"), 1)) * 100.0, F.count(F.lit(1))).alias("valid_pct"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("cost_usd").alias("cost_usd"),
        )
        .withColumn("tier", F.coalesce("tier", F.lit("all")))
    )


def pending_runs(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned ``(mode, id)`` that have no run yet."""
    return planned.join(done.select("mode", "id"), ["mode", "id"], "left_anti")


def score_bands(results: DataFrame, queries: DataFrame, high: float = 0.7, low: float = 0.4) -> DataFrame:
    """One row: answered queries, best scores above and below the bounds, queries left empty."""
    best = top_n_per_group(results, ["query_id"], 1, F.col("rank"), rank="first").select("query_id", "score")
    return queries.join(best, "query_id", "left").agg(
        F.count("score").alias("answered"),
        F.count(F.when(F.col("score") > high, 1)).alias("high_scores"),
        F.count(F.when(F.col("score") < low, 1)).alias("low_scores"),
        F.count(F.when(F.col("score").isNull(), 1)).alias("empty"),
    )
