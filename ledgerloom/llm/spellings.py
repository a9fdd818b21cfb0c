"""Spelling variants: words one edit apart, found by asymmetric chunks and grams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import lowered, stored

# fixed pattern of the contract, on text whose A-Z are lower-cased
GAP = r"[^a-zÀ-ÿ]+"
SHORTEST = 6  # code points: a shorter word has no two chunks of three


def corpus_words(docs: DataFrame, thinned: int = 199, least: int = 5) -> DataFrame:
    """``word`` and ``n``: the runs of letters of all texts, counted.

    One run in ``thinned`` loses a code point, which the crc32 of ``<doc_id>:<run>`` names (a
    null id counts as the text ``null``). Words under SHORTEST code points or with fewer than
    ``least`` occurrences go. Null and empty texts have no words; repeated rows count again.
    Counts are combined on the map side, so a frequent word costs a row for each task.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"),
        F.explode(F.split(lowered(F.coalesce("text", F.lit(""))), GAP)).alias("run"),
    ).where(F.length("run") >= SHORTEST)
    marked = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    gone = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.expr("left(run, cast(h % length(run) as int))"), F.col("run").substr(gone + 2, F.length("run")))
    word = F.when(F.col("h") % thinned == 0, shorter).otherwise(F.col("run"))
    counted = marked.select(word.alias("word")).where(F.length("word") >= SHORTEST).groupBy("word")
    return counted.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _ends(part: str, length: Column, width: str) -> Column:
    """The grams of a width at both ends of a part of a word, each with what is left."""
    text, cut = F.col(part), F.col(width)
    return F.explode(
        F.array(
            F.struct(F.lit(0).alias("side"), text.substr(F.lit(1), cut).alias("gram"), text.substr(cut + 1, length - cut).alias("rest")),
            F.struct(F.lit(1).alias("side"), text.substr(length - cut + 1, cut).alias("gram"), text.substr(F.lit(1), length - cut).alias("rest")),
        )
    )


def _keyed(words: DataFrame, cuts: Column) -> DataFrame:
    """``words`` with a ``key`` for each way to cut a word, to meet words of ``target`` code points.

    A key hashes a gram at one end and, of the rest, again one at one end, with their places.
    """
    cut = words.select("word", "n", F.explode(F.array_distinct(cuts)).alias("cut")).select("word", "n", "cut.*")
    outer = cut.select("word", "n", "target", "half", "quarter", _ends("word", F.length("word"), "half").alias("o"))
    inner = outer.select(
        "word", "n", "target", F.col("o.side").alias("side"), F.col("o.gram").alias("gram"), "quarter", F.col("o.rest").alias("rest")
    ).select("word", "n", "target", "side", "gram", _ends("rest", F.length("rest"), "quarter").alias("i"))
    return inner.select("word", "n", F.xxhash64("target", "side", "gram", "i.side", "i.gram").alias("key"))


def _cut(length: Column, target: Column) -> Column:
    half = F.floor(length / 2).cast("int")
    return F.struct(target.alias("target"), half.alias("half"), F.floor((length - half) / 2).cast("int").alias("quarter"))


def chunks(words: DataFrame) -> DataFrame:
    """Two disjoint chunks of a word, its first and last half; with each, two disjoint chunks of the rest.

    One replaced or inserted code point leaves a half alone: the first one at its place, or the
    last one at its place from the end, which is shifted by one in a longer word. The rest then
    differs by that edit, so one of its two chunks is left alone as well.
    """
    length = F.length("word")
    return _keyed(words, F.array(_cut(length, length), _cut(length, length + 1)))


def grams(words: DataFrame) -> DataFrame:
    """The positional grams of a word that can equal a chunk of a word as long or shorter by one.

    Of all its positional grams the others fail the place filter, so they are not sent.
    """
    length = F.length("word")
    return _keyed(words, F.array(_cut(length, length), _cut(length - 1, length)))


def _merged(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join that sorts both sides and broadcasts neither.

    Both grow with the vocabulary. Spark sizes a side by its compressed file and takes no account
    of the rows an explode makes (7.6 MB for 20 million), so it would send them through the driver.
    """
    return left.join(right.hint("merge"), key, how)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a``, ``na``, ``b``, ``nb``: each two words one inserted, deleted or replaced code point apart, once.

    ``a`` is the shorter word, or the lesser of equally long ones, and gives its chunks; ``b`` gives
    its grams. Words that share a key are compared in full. A common beginning or ending, which
    thousands of words share, is split by the chunks of the rest, so no key holds many words.
    """
    one = chunks(words).withColumnsRenamed({"word": "a", "n": "na"})
    other = grams(words).withColumnsRenamed({"word": "b", "n": "nb"})
    met = _merged(one, other, "key").where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
    near = met.where(F.levenshtein("a", "b", 1) == 1)
    # a pair may have met at several keys
    return near.select("a", "na", "b", "nb").distinct()


def followed(links: DataFrame, most_n: int, ratio: int, least: int) -> DataFrame:
    """``word`` and ``root``, the end of the chain ``word`` -> ``form`` -> ....

    Counts grow ``ratio``-fold with each link, which bounds the length of a chain; each round
    doubles the links a row has followed and is a stored table.
    """
    links = stored(links.select("word", F.col("form").alias("root")), "forms")
    length = math.log(max(most_n / least, 1), ratio) + 1
    for _ in range(math.ceil(math.log2(max(length, 1)))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(
            _merged(links, ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots"
        )
    return links


def spelling_forms(docs: DataFrame, ratio: int = 5, thinned: int = 199, least: int = 5) -> DataFrame:
    """The commoner spelling of every word of a corpus, and the last one of its chain.

    ``form`` is the near word of largest count (ties: least in code-point order), if that is at
    least ``ratio`` times the word's own count; ``root`` is the word itself where there is none.
    An empty table, or one without words, gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    words = stored(corpus_words(docs, thinned, least), "words")
    pairs = stored(near_pairs(words), "near-words")
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m"))
    )
    best = ways.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best")
    )
    large = -F.col("best.less") >= ratio * F.col("n")
    judged = stored(
        _merged(words, best, "word", "left").select(
            "word", F.when(large, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(large, -F.col("best.less")).alias("form_n"),
        ),
        "judged-words",
    )
    most_n = words.agg(F.max("n")).first()[0] or 0
    roots = followed(judged.where(F.col("form").isNotNull()), most_n, ratio, least)
    return _merged(judged, roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
