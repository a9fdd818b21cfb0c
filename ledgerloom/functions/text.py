"""Tokens, vectors and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased ASCII word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(1))


def token_count(text: Column) -> Column:
    """How many tokens there are, without making them."""
    return F.regexp_count(F.lower(text), F.lit(r"\w+"))


def token_estimate(text: Column) -> Column:
    """About four characters per token."""
    return F.ceil(F.length(text) / 4)


def run_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Cost of a run at prices per million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, term: total + term,
    )


def cosine(left: Column, right: Column) -> Column:
    """0 when either vector has (almost) no length."""
    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(norms > 1e-9, dot(left, right) / norms).otherwise(F.lit(0.0))


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def strip_code_fences(text: Column) -> Column:
    opened = F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", "")
    return F.regexp_replace(opened, r"\s*```$", "")


def truncate_text(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def referenced_names(text: Column, names: str) -> Column:
    """Sorted distinct whole words that match the pattern ``names``.

    Word edges are spelled out as ASCII, so the result does not depend on the Java version.
    """
    pattern = rf"(?<![A-Za-z0-9_])({names})(?![A-Za-z0-9_])"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))
