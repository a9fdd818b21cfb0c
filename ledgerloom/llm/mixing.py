"""Mixing to target weights by document rates over soft domain membership."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import alnum_words, bounded_sample, positions, stored, text_hash, with_row

BINS = 4096
LABELLED = 20_000  # labelled rows of each domain that the classifier learns from, at most
SAMPLE_CLASSES = 40
EVIDENCE = 100.0  # a text counts as at most so many words
MOST_DOMAINS = 64
ROUNDS = 60
CELL_DIGITS = 3  # documents are fitted together when their posteriors agree to so many digits
TOLERANCE = 1e-4


def label_domains(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``domain`` from a table of quality and toxicity labels."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())


def _bins(text: Column) -> Column:
    return F.transform(alnum_words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BINS)).cast("int"))


@dataclass(frozen=True)
class DomainModel:
    """Naive Bayes over hashed words: at most MOST_DOMAINS rows of BINS weights."""

    domains: list[str]
    priors: list[float]
    weights: list[list[float]]

    def posteriors(self, bins: Column) -> Column:
        """Log-scores of each domain, in the order of ``domains``, for hashed words."""
        scale = F.lit(EVIDENCE) / F.greatest(F.size(bins).cast("double"), F.lit(EVIDENCE))
        scores = []
        for prior, weight in zip(self.priors, self.weights):
            # one literal; Catalyst folds it to an array once
            row = F.split(F.lit(" ".join(f"{w:.6f}" for w in weight)), " ").cast("array<double>")
            scores.append(F.lit(prior) + scale * _sum_of(row, bins))
        return F.array(*scores)


def _sum_of(row: Column, bins: Column) -> Column:
    return F.aggregate(bins, F.lit(0.0), lambda total, b: total + F.get(row, b))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def domain_sizes(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``domain`` and ``n``, its labelled documents among ``docs``.

    Both sides are counted by id before they meet, so a repeated id arrives as one row.
    """
    times = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    given = labelled.groupBy("doc_id", "domain").agg(F.count(F.lit(1)).alias("given"))
    return given.join(times, "doc_id").groupBy("domain").agg(F.sum(F.col("given") * F.col("times")).alias("n"))


def fit_domains(docs: DataFrame, labelled: DataFrame, most: int = LABELLED) -> DomainModel:
    """Learn the domains of the labelled table.

    The words of at most ``most`` labelled rows of a domain are used, drawn by hashed ids: a
    bounded, repeatable sample. Their number bounds what is broadcast. The priors count all
    labelled documents, whatever ``most`` is. Labels of unknown documents have no effect; a
    document labelled twice counts twice.
    """
    known = labelled.where(F.col("doc_id").isNotNull()).select("doc_id", "domain")
    sample = stored(bounded_sample(known, "domain", F.col("doc_id"), most, SAMPLE_CLASSES), "labelled")
    domains = sorted(r.domain for r in sample.select("domain").distinct().take(MOST_DOMAINS + 1))
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    if not domains:
        domains = ["all"]
    words = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(
        "domain", F.explode(_bins(F.col("text"))).alias("bin")
    )
    counts = words.groupBy("domain", "bin").agg(F.count(F.lit(1)).alias("n"))
    rows = {d: np.ones(BINS) for d in domains}
    for row in counts.collect():  # at most MOST_DOMAINS x BINS rows
        rows[row.domain][row.bin] += row.n
    n = {r.domain: r.n for r in domain_sizes(docs, known).collect()}  # at most MOST_DOMAINS rows
    return DomainModel(
        domains, [float(np.log(n.get(d, 0) + 1.0)) for d in domains],
        [np.log(rows[d] / rows[d].sum()).tolist() for d in domains],
    )


@dataclass(frozen=True)
class Mix:
    """Fitted rates: the rate of a document follows from its posteriors and the steps taken."""

    model: DomainModel
    steps: list[list[float]]
    least: Column
    most: float
    expected: dict[str, float]
    targets: dict[str, float]

    def rate(self, posterior: Column) -> Column:
        return _rate(posterior, self.steps, self.least, self.most)


def _rate(posterior: Column, steps: list[list[float]], least: Column, most: float) -> Column:
    start = F.lit(1.0)
    if not steps:
        return start
    taken = F.array(*[F.array(*map(F.lit, step)) for step in steps])
    size = len(steps[0])

    def move(rate: Column, step: Column) -> Column:
        for k in range(size):
            rate = rate - F.get(posterior, F.lit(k)) * F.get(step, F.lit(k))
        return F.least(F.greatest(rate, least), F.lit(most))

    return F.aggregate(taken, start, move)


def with_posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """Add ``__bins``, then ``__p``; every other column is kept."""
    rows = docs.withColumn("__bins", _bins(F.col("text")))
    return rows.withColumn("__p", model.posteriors(F.col("__bins"))).withColumn("__p", softmax(F.col("__p")))


def cells(rows: DataFrame, k: int) -> DataFrame:
    """Documents of nearly equal posteriors as one row: their tokens and their mean posteriors.

    The means are weighted by tokens, so the domain totals of all rows stay what they are. A
    cell is a sum over any number of documents; a common one combines before it is shuffled.
    """
    near = F.transform("p", lambda x: F.round(x, CELL_DIGITS))
    sums = [F.sum(F.col("n") * F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k)]
    grouped = rows.groupBy(near.alias("near")).agg(F.sum("n").alias("n"), *sums).where("n > 0")
    return grouped.select("n", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(k)]).alias("p"))


def fit_mix(rows: DataFrame, model: DomainModel, weights: dict[str, float], anchor: str | None = None,
            protect: str | None = None, most: float = 4.0) -> Mix:
    """Rates whose expected domain token totals come nearest to the target weights.

    ``rows`` holds tokens ``n`` and posteriors ``p`` of each document. The targets are
    ``weights`` times all tokens, or times what makes the target of the domain ``anchor`` the
    tokens it has. Projected gradient steps start from one copy of each document and minimise
    the squared residuals of the totals, each divided by its domain's tokens; with that
    weighting a step of 1 never overshoots. A step needs one number per domain from all
    documents, so an iteration is one aggregation, of the stored ``cells``. Rates stay between
    0 and ``most``; documents whose likeliest domain is ``protect`` stay at 1 or more. Domains
    without a weight get target 0.
    """
    k = len(model.domains)
    fitted = stored(cells(rows, k), "cells")
    have = fitted.agg(*[F.sum(F.col("n") * F.get("p", F.lit(i))).alias(f"t{i}") for i in range(k)]).first()
    have = [float(x or 0.0) for x in have]
    scale = sum(weights.get(d, 0.0) for d in model.domains) or 1.0
    share = [weights.get(d, 0.0) / scale for d in model.domains]
    total = sum(have)
    if anchor in model.domains and share[model.domains.index(anchor)] > 0:
        total = have[model.domains.index(anchor)] / share[model.domains.index(anchor)]
    targets = [total * s for s in share]
    least = lower_bound(model.domains, protect, F.col("p"))
    steps: list[list[float]] = []
    totals = have
    for _ in range(ROUNDS):
        residual = [(a - t) / max(h, 1.0) for a, t, h in zip(totals, targets, have)]
        if max((abs(r) for r in residual), default=0.0) < TOLERANCE:
            break
        steps.append([round(r, 9) for r in residual])
        rated = fitted.select("n", "p", _rate(F.col("p"), steps, least, most).alias("r"))
        found = rated.agg(*[F.sum(F.col("n") * F.col("r") * F.get("p", F.lit(i))).alias(f"t{i}") for i in range(k)]).first()
        before, totals = totals, [float(x or 0.0) for x in found]
        if max(abs(a - b) / max(h, 1.0) for a, b, h in zip(totals, before, have)) < TOLERANCE / 10:
            break  # bounds keep the targets out of reach
    return Mix(
        model, steps, lower_bound(model.domains, protect, F.col("__p")), most,
        dict(zip(model.domains, totals)), dict(zip(model.domains, targets)),
    )


def lower_bound(domains: list[str], protect: str | None, posterior: Column) -> Column:
    if protect not in domains:
        return F.lit(0.0)
    safe = F.get(posterior, F.lit(domains.index(protect))) >= F.array_max(posterior)
    return F.when(safe, 1.0).otherwise(0.0)


def with_copies(rows: DataFrame, mix: Mix, draw: Column) -> DataFrame:
    """Add ``__rate`` and ``__copies``: the rate rounded down, or up by the document's draw."""
    rated = rows.withColumn("__rate", F.round(mix.rate(F.col("__p")), 6))
    whole = F.floor("__rate")
    return rated.withColumn("__copies", (whole + F.when(draw < F.col("__rate") - whole, 1).otherwise(0)).cast("long"))


def draw_of() -> Column:
    """A number in [0, 1) that follows from id and text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.pmod(F.xxhash64(key, text_hash()), F.lit(1 << 24)) / float(1 << 24)


def mix_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], **options) -> DataFrame:
    """Tokens, domain posteriors, rate and copies of every document.

    A null or empty text has no tokens: its posterior is the prior, and its rate follows from
    that. Repeated rows have equal rates and draws. An empty table gives no rows.
    """
    model = fit_domains(docs, labelled)
    rows = with_posteriors(docs.select("doc_id", "text"), model).select(
        "doc_id", F.size("__bins").cast("long").alias("n"), F.col("__p").alias("p"), draw_of().alias("draw")
    )
    rows = stored(rows, "posteriors")
    mix = fit_mix(rows, model, weights, **options)
    names = [F.get("__p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(mix.model.domains)]
    return with_copies(rows.withColumnRenamed("p", "__p"), mix, F.col("draw")).select(
        "doc_id", F.col("n").alias("n_tokens"), *names, F.col("__rate").alias("rate"), F.col("__copies").alias("copies")
    )


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], **options) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, with all their columns."""
    model = fit_domains(docs, labelled)
    rows = with_posteriors(with_row(docs), model)
    mix = fit_mix(rows.select(F.size("__bins").alias("n"), F.col("__p").alias("p")), model, weights, **options)
    rows = with_copies(rows, mix, draw_of())
    return rows.withColumn("__i", F.explode(positions(F.col("__copies")))).select("row.*")
