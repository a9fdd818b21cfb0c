"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import (
    BROADCAST_ROWS, alnum_words, join_keyed, n_alnum_words, only, positions, stored, text_hash, with_row,
)

SPAN = 13  # words of a window
GRAM = 6  # words of a fingerprint
REACH = SPAN - GRAM  # words of a window before or after a fingerprint
PLACE_BITS = 30


def with_grams(rows: DataFrame) -> DataFrame:
    """Add ``grams`` (hashes of GRAM words) step by step, so that no step is computed twice."""
    def pairs(col: str, apart: int, other: str | None = None) -> Column:
        moved = F.slice(other or col, apart + 1, F.greatest(F.size(other or col) - apart, F.lit(0)))
        return F.zip_with(F.slice(col, 1, F.size(moved)), moved, lambda a, b: F.xxhash64(a, b))

    return (
        rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("h2", pairs("h1", 1))
        .withColumn("h4", pairs("h2", 2))
        .withColumn("grams", pairs("h4", 4, "h2"))
        .drop("h1", "h2", "h4")
    )


def winnowed(rows: DataFrame) -> DataFrame:
    """Add ``chosen``: places of the least gram of every window of SPAN words.

    The choice depends on the window's words only (top bits of the hash, then the leftmost), so
    two equal windows choose the same place: any shared run of SPAN words shares a fingerprint
    at the same offset.
    """
    mask = (1 << PLACE_BITS) - 1
    ranked = F.transform(
        "grams", lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))
    )
    out = rows.withColumn("__v", ranked)
    step = 1
    while step < REACH + 1:  # REACH + 1 = 8 grams to a window
        moved = F.slice("__v", step + 1, F.greatest(F.size("__v") - step, F.lit(0)))
        out = out.withColumn("__v", F.zip_with("__v", moved, lambda a, b: F.least(a, b)))
        step *= 2
    return out.withColumn(
        "chosen", F.transform(F.array_distinct("__v"), lambda v: v.bitwiseAND(F.lit(mask)).cast("int"))
    ).drop("__v")


def _item_index(items: DataFrame) -> DataFrame:
    """Fingerprints of items of SPAN words or more, with the words around each."""
    rows = winnowed(with_grams(items.where(F.size("words") >= SPAN)))
    exploded = rows.select("item_id", "words", "grams", F.explode_outer("chosen").alias("q"))
    return exploded.select(
        "item_id", F.get("grams", F.col("q")).alias("gram"),
        F.slice("words", F.col("q") + 1, GRAM).alias("i_gram"),
        F.transform(F.sequence(F.lit(1), F.lit(REACH)), lambda j: F.when(F.col("q") - j >= 0, F.get("words", F.col("q") - j))).alias("i_left"),
        F.transform(F.sequence(F.lit(0), F.lit(REACH - 1)), lambda j: F.get("words", F.col("q") + GRAM + j)).alias("i_right"),
    )


def _run_length(doc_words: Column, item_words: str, first: Column, step: int) -> Column:
    """How many words from ``first`` on, left or right, equal the item's."""
    differs = F.transform(
        item_words,
        lambda w, j: ~F.coalesce(
            F.when(first + j * step >= 0, F.get(doc_words, (first + j * step).cast("int"))) == w, F.lit(False)
        ),
    )
    at = F.array_position(differs, True)
    return F.when(at == 0, F.size(item_words)).otherwise(at - 1)


def _around(p: Column) -> Column:
    """The words of every window that holds the fingerprint at ``p``."""
    return F.slice("words", F.greatest(p - REACH, F.lit(0)) + 1, F.least(p, F.lit(REACH)) + GRAM + REACH)


def _long_hits(words: DataFrame, items: DataFrame) -> DataFrame:
    """Runs of SPAN or more words shared with an item, found at fingerprints and extended.

    A fingerprint carries the few words around it, never its document: a long text would
    otherwise be copied for each of its fingerprints.
    """
    index = _item_index(items)
    chosen = winnowed(with_grams(words))
    small = index.count() <= BROADCAST_ROWS

    def fingerprint(p: Column) -> Column:
        fields = [p.alias("p"), F.get("grams", p).alias("gram")]
        return F.struct(*fields, _around(p).alias("around")) if small else F.struct(*fields)

    # explode_outer: a plain explode infers a filter that Catalyst pushes below every step of
    # the hashing, which would compute each step again; the join drops the null rows
    prints = chosen.withColumn("prints", F.transform("chosen", fingerprint)).select(
        "doc_id", "text_key", F.explode_outer("prints").alias("f")
    ).select("doc_id", "text_key", "f.*")
    if small:
        met = prints.join(F.broadcast(index), "gram")
    else:
        # a benchmark beyond the bound: move fingerprints, then fetch the words of hit documents
        hits = prints.join(index, "gram")
        met = join_keyed(hits, words.dropDuplicates(["doc_id", "text_key"]), "inner")
        met = met.withColumn("around", _around(F.col("p"))).drop("words")
    p, at = F.col("p"), F.least(F.col("p"), F.lit(REACH))
    extended = met.where(F.slice("around", at + 1, GRAM) == F.col("i_gram")).select(
        "doc_id", "text_key", "item_id", "p",
        _run_length(F.col("around"), "i_left", at - 1, -1).alias("left"),
        _run_length(F.col("around"), "i_right", at + GRAM, 1).alias("right"),
    )
    return extended.where(F.col("left") + GRAM + F.col("right") >= SPAN).select(
        "doc_id", "text_key", "item_id",
        (p - F.col("left")).cast("int").alias("start"), (p + GRAM - 1 + F.col("right")).cast("int").alias("stop"),
    )


def _short_hits(words: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """Places of whole items of fewer than SPAN words, by the hash of their words."""
    short = items.where((F.size("words") > 0) & (F.size("words") < SPAN)).withColumnRenamed("words", "i_words")
    parts = words.select("doc_id", "text_key", "words", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    runs = F.transform(
        positions(F.size("words") - F.col("n") + 1),
        lambda p: F.struct(p.alias("p"), F.array_join(F.slice("words", p + 1, F.col("n")), " ").alias("run")),
    )
    starts = parts.select("doc_id", "text_key", "n", F.explode_outer(runs).alias("r")).select(
        "doc_id", "text_key", "n", F.col("r.p").alias("p"), F.xxhash64("r.run").alias("gram"), F.col("r.run").alias("run")
    )
    index = short.select("item_id", F.array_join("i_words", " ").alias("i_run")).withColumn("gram", F.xxhash64("i_run"))
    side = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
    return starts.join(side, "gram").where("run = i_run").select(
        "doc_id", "text_key", "item_id", F.col("p").alias("start"), (F.col("p") + F.col("n") - 1).cast("int").alias("stop")
    )


def benchmark_hits(words: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every run of a document's words that an item's windows cover: (start, stop) inclusive."""
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("words"))
    hits = _long_hits(words, items)
    sizes = items.select(F.size("words").alias("n")).where((F.col("n") > 0) & (F.col("n") < SPAN)).distinct()
    lengths = sorted(r.n for r in sizes.collect())  # at most SPAN - 1 numbers
    if lengths:
        hits = hits.unionByName(_short_hits(words, items, lengths))
    return hits


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, words hit by a benchmark window, items, and the verdict.

    A window is SPAN consecutive words of an item (a shorter item is one window). A document is
    contaminated where at least one word in twenty is hit. Null and empty texts have no words
    and no hits; items without words hit nothing; repeated rows keep a row each. The index is
    broadcast while it has at most ``BROADCAST_ROWS`` rows; beyond that the fingerprints are
    shuffled, and the words of documents with hits follow.
    """
    words = docs.select("doc_id", text_hash().alias("text_key"), alnum_words(F.col("text")).alias("words"))
    hits = benchmark_hits(words, benchmark)
    runs = hits.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "stop")).alias("runs"), F.collect_set(F.col("item_id").cast("string")).alias("items")
    )
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["stop"]))))
    summary = runs.select(
        "doc_id", "text_key", F.size(covered).cast("long").alias("hit"), F.array_sort("items").alias("items")
    )
    counted = docs.select("doc_id", text_hash().alias("text_key"), n_alnum_words(F.col("text")).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    items = F.coalesce("items", none)
    n_hit = F.coalesce("hit", F.lit(0))
    return join_keyed(counted, summary).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "text_key",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = decontaminate(docs, benchmark).where("contaminated").select("doc_id", "text_key").distinct()
    own = with_row(docs).withColumn("text_key", text_hash())
    return only(own, stored(bad, "contaminated"), anti=True).select("row.*")
