"""License scans: phrases, and a set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import alnum_words, join_keyed, positions, text_hash

BLOCK_WORDS = 64
THRESHOLD = 0.85

# Phrases of the contract and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Short notices by which licenses are stated. A template has at most
# BLOCK_WORDS / 2 words, so that an overlapping block holds every place of it whole.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "dedicated to the public domain under cc0 1 0 universal",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license version 3",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "reserved": "copyright all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

# tokens that tell a template from related ones: a block without them does not match it
REQUIRED = {
    "apache-2.0": ["apache"], "cc-by-nc": ["nc"], "cc-by-sa": ["sa"], "cc0": ["cc0"], "gpl": ["gnu"], "lgpl": ["lesser"],
    "mpl-2.0": ["mozilla"],
}


def phrase_places(words: Column, joined: Column, phrase: str) -> Column:
    """Starts of all places where the phrase's words follow each other."""
    parts = phrase.split(" ")

    def stands_at(i: Column) -> Column:
        hit = F.lit(True)
        for k, part in enumerate(parts):
            hit = hit & (F.get(words, i + k) == part)
        return hit

    places = F.filter(positions(F.size(words) - (len(parts) - 1)), stands_at)
    # most texts hold no such phrase: ask the string before the words
    return F.when(joined.contains(f" {phrase} "), places).otherwise(F.array().cast("array<int>"))


def _tokens(text: str) -> set[str]:
    return set(text.split(" "))


def _needed(text: str, threshold: float) -> int:
    return math.ceil(round(threshold * len(_tokens(text)), 6))


def frequency_order(words: DataFrame, vocabulary: set[str]) -> list[str]:
    """The template tokens, those in the fewest documents first.

    One count per token of the templates comes to the driver: their list bounds it.
    """
    known = F.array(*map(F.lit, sorted(vocabulary)))
    held = words.select(F.explode(F.array_intersect(known, F.col("words"))).alias("token"))
    counts = {r.token: r.n for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda token: (counts.get(token, 0), token))


def matching_blocks(
    words: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
    required: dict[str, list[str]] = REQUIRED,
) -> DataFrame:
    """Every (block, template) with at least ``threshold`` of the template's tokens in the block.

    Tokens that ``required`` names for a template must all be among them.

    ``words`` has ``doc_id``, ``text_key`` and ``words``. Blocks are runs of BLOCK_WORDS words,
    each beginning half a block after the one before. The join is exact:

    * tokens are ordered by the number of documents that hold them, over all documents, rarest
      first; only template tokens matter;
    * prefix: a block meeting the need ``o`` of a template of ``m`` tokens holds one of the
      template's first ``m - o + 1``; only those are joined;
    * length: the block needs ``o`` template tokens at all;
    * position: when a prefix token matches at place i of the template and j of the block, at
      most 1 + what follows both is still to come, plus what came before in both.

    The templates are a list in the code, so broadcasting their rows is bounded.
    """
    order = frequency_order(words, set().union(*map(_tokens, templates.values())))
    rows, least = [], len(order)
    for label, text in templates.items():
        template = sorted(_tokens(text), key=order.index)
        needed = _needed(text, threshold)
        least = min(least, needed)
        for place, token in enumerate(template[: len(template) - needed + 1]):
            rows.append((token, label, template, needed, place, required.get(label, [])))
    prefix = words.sparkSession.createDataFrame(
        rows, "token string, label string, template array<string>, needed int, place int, required array<string>"
    )
    known = F.array(*map(F.lit, order))
    half = BLOCK_WORDS // 2
    n_blocks = F.greatest(F.lit(1), F.ceil((F.size("words") - half) / half))

    def block(i: Column) -> Column:
        # the order of the first array is kept: rarest first
        return F.struct(i.alias("at"), F.array_intersect(known, F.slice("words", i * half + 1, BLOCK_WORDS)).alias("own"))

    blocks = F.filter(F.transform(positions(n_blocks), block), lambda b: F.size(b["own"]) >= least)
    # explode_outer: a plain explode would compute the blocks twice, once to ask whether there are any
    own = words.select("doc_id", "text_key", F.explode_outer(blocks).alias("b"))
    at = own.select(
        "doc_id", "text_key", F.col("b.at").alias("block"), F.col("b.own").alias("own"),
        F.posexplode("b.own").alias("j", "token"),
    )
    size, total = F.size("own"), F.size("template")
    before = F.least(F.col("place"), F.col("j"))
    after = F.least(total - 1 - F.col("place"), size - 1 - F.col("j"))
    joined = at.join(F.broadcast(prefix), "token").where(
        (size >= F.col("needed")) & (before + 1 + after >= F.col("needed")) & (F.size(F.array_except("required", "own")) == 0)
    )
    overlap = F.size(F.array_intersect("own", "template"))
    return (
        joined.select("doc_id", "text_key", "block", "label", "needed", total.alias("total"), overlap.alias("overlap"))
        .where("overlap >= needed")
        .select("doc_id", "text_key", "block", "label", (F.col("overlap") / F.col("total")).alias("containment"))
    )


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """License phrases and template matches of every text.

    ``base_labels`` come from phrases (all places), ``labels`` also from templates that a block
    holds to ``threshold``, with the tokens that tell related templates apart. ``score`` is the best containment, 1 where a phrase stands, 0 where
    nothing does. A null or empty text has no words and no labels; rows with the same id keep
    a row each.
    """
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    base = docs.select("doc_id", text_hash().alias("text_key"), alnum_words(F.col("text")).alias("words"))
    with_text = base.select("*", joined.alias("joined"))
    places = with_text.select(
        "doc_id", "text_key", F.size("words").cast("long").alias("n_words"),
        *[phrase_places(F.col("words"), F.col("joined"), p).alias(label) for p, label in PHRASES.items()],
    )
    labels = list(PHRASES.values())
    found = places.select(
        "doc_id", "text_key", "n_words",
        F.concat(*[F.col(f"`{name}`") for name in labels]).alias("starts"),
        F.filter(
            F.array(*[F.when(F.size(F.col(f"`{name}`")) > 0, F.lit(name)) for name in labels]),
            lambda x: x.isNotNull(),
        ).alias("base"),
    )
    matches = matching_blocks(base, templates, threshold).groupBy("doc_id", "text_key").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best"),
        F.count_distinct("block").alias("n_blocks"),
    )
    both = join_keyed(found, matches)
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )
