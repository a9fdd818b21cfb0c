"""Quality rules and robust multivariate outliers."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, SPACES, join_keyed, space_words, stored, text_hash

WINDOW = 5
SYMBOLS = "#*$%&|<>"
# statistics, each a smoothed rate on a scale on which clean text is roughly normal; a column
# of clean text may well be constant, so no spread counts as less than FLOORS
FLOORS = {"x_length": 0.15, "x_symbols": 0.12, "x_lines": 0.12, "x_repeats": 0.12}
STATS = list(FLOORS)
SHARE = 0.5  # of each group in the subset whose determinant is least; any more breaks under fewer outliers
MOST_STEPS = 30
SETTLED = 0.01  # relative change of a group's limit below which its C-steps are at their end
LEAST_ROWS = 50
CUTOFF = 40.0  # chi-square of four degrees: one clean document in some ten million


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts of the contract and the transformed statistics of every text, row by row."""
    def later(col: str, by: int, other: str | None = None) -> Column:
        moved = F.slice(other or col, by + 1, F.greatest(F.size(other or col) - by, F.lit(0)))
        return F.zip_with(F.slice(col, 1, F.size(moved)), moved, lambda a, b: F.xxhash64(a, b))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", "lang", "source", text_hash().alias("text_key"), space_words(F.col("text")).alias("words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
    )
    rows = (
        rows.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines")))
        .withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
        .drop("words", "lines")
        .withColumn("h2", later("h1", 1))
        .withColumn("h4", later("h2", 2))
        .withColumn("grams", later("h4", 4, "h1"))
        .drop("h1", "h2", "h4")
    )
    # a gram found twice stands beside its equal once the places are sorted by gram; few texts
    # have any, so the pairs are sorted only where two hashes are equal
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    pairs = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("pairs", F.when(repeated, pairs)).drop("grams")
    beside = F.zip_with(
        F.slice("pairs", 1, F.greatest(F.size("pairs") - 1, F.lit(0))),
        F.slice("pairs", 2, F.greatest(F.size("pairs") - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    rows = rows.withColumn(
        "places", F.when(F.col("pairs").isNotNull(), F.array_sort(F.array_distinct(F.flatten(beside))))
    ).drop("pairs")
    gaps = F.zip_with(
        F.slice("places", 1, F.greatest(F.size("places") - 1, F.lit(0))),
        F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0))),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    covered = F.aggregate(gaps, F.lit(0), lambda a, b: a + b) + WINDOW
    rows = rows.withColumn(
        "n_repeat_words", F.when(F.col("places").isNotNull(), covered).otherwise(0).cast("long")
    ).drop("places")

    def rate(count: str, of: str, prior: int) -> Column:
        return F.asinh(10.0 * F.col(count) / (F.col(of) + prior))

    return rows.select(
        "doc_id", "text_key", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("word_chars") + 250) / (F.col("n_words") + 50)).alias("x_length"),
        rate("n_symbols", "n_words", 50).alias("x_symbols"),
        rate("n_dup_lines", "n_lines", 10).alias("x_lines"),
        rate("n_repeat_words", "n_words", 50).alias("x_repeats"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )


def _few(df: DataFrame, name: str) -> DataFrame:
    """A stored table of groups, broadcast while it is small; a hot group is one row of it."""
    kept = stored(df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def _consistency(share: float) -> float:
    """What a subset's covariance is multiplied by, for four normal statistics."""
    low, high = 0.0, 100.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if 1 - math.exp(-x / 2) * (1 + x / 2) < share else (low, x)
    return share / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


def _estimates(rows: DataFrame, centre: bool) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each group's rows (or their spread alone)."""
    p = range(len(STATS))
    if centre:
        quartiles = [F.percentile_approx(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(s) for s in STATS]
        out = rows.groupBy("group").agg(*quartiles)
        # the narrower side of the median: outliers on one side do not widen it, up to half of the rows
        sides = [F.least(F.get(s, F.lit(2)) - F.get(s, F.lit(1)), F.get(s, F.lit(1)) - F.get(s, F.lit(0))) for s in STATS]
        spread = [F.greatest(side * 2 / 1.349, F.lit(FLOORS[s])) for side, s in zip(sides, STATS)]
        return out.select(
            "group", *[F.get(s, F.lit(1)).alias(f"m{k}") for k, s in enumerate(STATS)],
            *[(spread[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in p for j in range(i + 1)],
        )
    sums = [F.avg(s).alias(f"m{k}") for k, s in enumerate(STATS)]
    sums += [F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i in p for j in range(i + 1)]
    out = rows.groupBy("group").agg(*sums)
    factor = _consistency(SHARE)
    for i in p:
        for j in range(i + 1):
            total = factor * F.col(f"c{i}{j}")
            if i == j:
                total = total + FLOORS[STATS[i]] ** 2
            for k in range(j):
                total = total - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # the floor keeps every pivot at least its square
            value = F.sqrt(F.greatest(total, F.lit(FLOORS[STATS[i]] ** 2))) if i == j else total / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    return out.select("group", *[f"m{k}" for k in p], *[f"l{i}{j}" for i in p for j in range(i + 1)])


def _with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance to the group's estimate."""
    out = rows.join(estimates, "group")
    for i, name in enumerate(STATS):
        value = F.col(name) - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", value / F.col(f"l{i}{i}"))
    distance = sum((F.col(f"y{i}") ** 2 for i in range(len(STATS))), F.lit(0.0))
    return out.select(*rows.columns, distance.alias("distance"))


def _moved(before: DataFrame, limits: DataFrame) -> float:
    """The largest relative change of a group's limit."""
    was = before.withColumnRenamed("limit", "was")
    change = F.abs(F.col("limit") - F.col("was")) / F.greatest(F.col("limit"), F.col("was"), F.lit(1e-9))
    return limits.join(was, "group").agg(F.max(change)).first()[0] or 0.0


def judge_quality(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The contract's counts and base rule, and the verdict of the robust outlier test.

    Statistics (mean word length and the rates of symbols, repeated lines and repeated words,
    smoothed and transformed) are compared within their group by the minimum covariance
    determinant: starting from medians and quartiles, C-steps keep the ``SHARE`` of each group
    nearest to the last estimate and estimate mean and covariance anew, until the distance
    that bounds the share settles in every group. Up to half of a group's rows may be outliers
    before its estimate breaks. Quantiles are mergeable sketches over all rows. A row is rejected where its squared distance exceeds
    ``cutoff``. Groups are language and source; one of fewer than LEAST_ROWS rows takes its
    language's rows, or all rows. Only rows that pass the base rule are used to estimate,
    where a group has them.

    Null text counts as empty: no words, ``base_failed``. Null language and source are values
    like any other. Repeated rows are counted and keep a row each.
    """
    stats = stored(text_statistics(docs), "statistics")
    sizes = stats.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    langs = stats.where(~F.col("base_failed")).groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang"))
    name = F.to_json(F.struct("lang", "source"))
    own, coarse = F.col("n") >= LEAST_ROWS, F.col("n_lang") >= LEAST_ROWS
    groups = sizes.join(langs.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left").select(
        F.col("lang").alias("__lang"), F.col("source").alias("__source"),
        F.when(own, name).when(coarse, F.to_json(F.struct("lang"))).otherwise("{}").alias("own_group"),
    )
    groups = _few(groups, "groups")
    rows = stats.join(
        groups, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left"
    ).withColumn("group", F.coalesce("own_group", F.lit("{}")))
    # each row is also evidence for its language and for all rows, where those are used
    passing = rows.where(~F.col("base_failed"))
    used = passing.select(
        F.explode(F.array_distinct(F.array(F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang")), F.lit("{}")))).alias("group"),
        *STATS,
    )
    wanted = F.broadcast(groups.select(F.col("own_group").alias("group")).distinct())
    fallback = used.sparkSession.createDataFrame([("{}",)], "group string")
    evidence = stored(used.join(wanted.unionByName(fallback).distinct(), "group", "left_semi"), "evidence")
    estimates = _few(_estimates(evidence, centre=True), "estimates")
    moved, last = 1.0, None
    for _ in range(MOST_STEPS):
        near = _with_distance(evidence, estimates)
        limit = _few(near.groupBy("group").agg(F.percentile_approx("distance", SHARE, 10_000).alias("limit")), "limits")
        subset = near.join(limit, "group").where("distance <= limit")
        estimates = _few(_estimates(subset, centre=False), "estimates")
        if last is not None:
            moved = _moved(last, limit)
        last = limit
        if moved <= SETTLED:
            break
    else:
        warnings.warn(f"limits still move by {moved:.3f} after {MOST_STEPS} C-steps", stacklevel=2)
    judged = rows.join(estimates, "group", "left")
    for i, stat in enumerate(STATS):
        value = F.col(stat) - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * F.col(f"y{j}")
        judged = judged.withColumn(f"y{i}", value / F.col(f"l{i}{i}"))
    distance = sum((F.col(f"y{i}") ** 2 for i in range(len(STATS))), F.lit(0.0))
    outlier = F.coalesce(distance > cutoff, F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(distance, F.lit(0.0)).alias("distance"), (~F.col("base_failed") & ~outlier).alias("kept"),
    )
