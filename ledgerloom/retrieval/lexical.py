"""BM25 over a corpus for a batch of queries, with statistics per tenant.

The corpus is tokenised once into blocks of term maps. A block meets tiles of queries, and the
task scores each of its documents for all queries at once: no row is made for a document and a
query that share a word. No step sorts or collects a whole tenant.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import token_count, tokens
from ledgerloom.retrieval.tiles import best_pairs, packed
from ledgerloom.session import bounded_batches, kept

WORD = re.compile(r"\w+", re.ASCII)
K1 = 1.5
B = 0.75
DOCUMENT_BLOCK = 256
QUERY_TILE = 256


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """``tenant, n_docs, avgdl``."""
    # a grouping key that is a literal would be folded away, and with it the key of later joins
    found = docs.groupBy("tenant").agg(
        F.max("tenant").alias("owner"), F.count(F.lit(1)).alias("n_docs"), F.avg(token_count(F.col("text"))).alias("avgdl")
    )
    return found.select(F.col("owner").alias("tenant"), "n_docs", "avgdl")


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, tenant, term, repeats``: a repeated query term counts again."""
    return (
        queries.select("query_id", "tenant", F.explode_outer(tokens(F.col("text"))).alias("term"))
        .where("term is not null")
        .groupBy("query_id", "tenant", "term")
        .agg(F.count(F.lit(1)).alias("repeats"))
    )


def postings(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``tenant, term, id, dl, tf``, cut to a ``(tenant, term)`` vocabulary when one is given."""
    words = docs.select("id", "tenant", tokens(F.col("text")).alias("words"))
    # an outer explode: for an inner one Spark adds a filter that tokenises the text again
    exploded = words.select("id", "tenant", F.size("words").alias("dl"), F.explode_outer("words").alias("term"))
    exploded = exploded.where("term is not null")
    if vocabulary is not None:
        exploded = exploded.join(vocabulary, ["tenant", "term"])
    return exploded.groupBy("tenant", "term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def term_weights(found: DataFrame, statistics: DataFrame) -> DataFrame:
    """``tenant, term, df, idf, avgdl``."""
    frequency = found.groupBy("tenant", "term").agg(F.max("tenant").alias("owner"), F.count(F.lit(1)).alias("df"))
    frequency = frequency.select(F.col("owner").alias("tenant"), "term", "df")
    return frequency.join(statistics, "tenant").select(
        "tenant", "term", "df", _idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl"
    )


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def term_maps(docs: DataFrame, size: int = DOCUMENT_BLOCK) -> DataFrame:
    """Blocks of documents as the terms they hold: ``ids``, lengths, and terms with their counts.

    ``sizes`` tells how many of ``terms`` each document has. A document without text has length
    null and no terms.
    """
    # the words of functions.text.tokens: JVM and task agree on what is lower case
    texts = docs.select("id", "tenant", F.lower("text").alias("text"))

    def pack(held: list) -> dict:
        counts = [Counter(WORD.findall(r["text"] or "")) for r in held]
        return {
            "ids": [r["id"] for r in held],
            "lengths": [None if r["text"] is None else c.total() for r, c in zip(held, counts)],
            "sizes": [len(c) for c in counts], "terms": [t for c in counts for t in c],
            "tfs": [n for c in counts for n in c.values()],
        }

    kind = docs.schema["id"].dataType.simpleString()
    return packed(texts, size, pack, f"ids array<{kind}>, lengths array<long>, sizes array<int>, terms array<string>, tfs array<long>")


def _tiles(weights: DataFrame, size: int) -> DataFrame:
    """Tiles of queries: each query's terms and what one saturated occurrence of them is worth."""
    asked = weights.groupBy("query_id", "tenant").agg(
        F.max("avgdl").alias("avgdl"), F.collect_list(F.struct("term", "weight")).alias("terms")
    ).withColumnRenamed("query_id", "id")

    def pack(held: list) -> dict:
        return {
            "ids": [r["id"] for r in held], "avgdl": held[0]["avgdl"], "sizes": [len(r["terms"]) for r in held],
            "terms": [t["term"] for r in held for t in r["terms"]], "weights": [t["weight"] for r in held for t in r["terms"]],
        }

    kind = asked.schema["id"].dataType.simpleString()
    return packed(asked, size, pack, f"ids array<{kind}>, avgdl double, sizes array<int>, terms array<string>, weights array<double>")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, rank, id, score, normalized`` of the k best documents per query.

    ``docs`` is ``(id, tenant, text)`` and ``queries`` ``(query_id, tenant, text)``; a query
    sees its own tenant only. A document that shares no term with the query is not ranked.
    ``normalized`` is the score over the query's best score. The corpus is tokenised once, into
    ``term_maps`` that are kept; a document is scored for all queries of a tile at once, and only
    the k best of a block leave the task.
    """
    bounded_batches(docs.sparkSession)
    maps = kept(term_maps(docs))
    terms = query_terms(queries)
    # a grouping key that is a literal would be folded away, and with it the key of later joins
    statistics = maps.select("tenant", F.explode("lengths").alias("dl")).groupBy("tenant").agg(
        F.max("tenant").alias("owner"), F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")
    ).select(F.col("owner").alias("tenant"), "n_docs", "avgdl")
    frequency = maps.select("tenant", F.explode("terms").alias("term")).groupBy("tenant", "term").agg(
        F.max("tenant").alias("owner"), F.count(F.lit(1)).alias("df")
    ).select(F.col("owner").alias("tenant"), "term", "df")
    weighed = terms.join(frequency, ["tenant", "term"]).join(statistics, "tenant").select(
        "query_id", "tenant", "term", "avgdl", (F.col("repeats") * _idf(F.col("n_docs"), F.col("df"))).alias("weight")
    )

    def score(block: dict, tile: dict) -> np.ndarray:
        words = tile["terms"].dictionary_encode()
        weight = np.zeros((len(words.dictionary), len(tile["ids"])))
        asker = np.repeat(np.arange(len(tile["ids"])), tile["sizes"].to_numpy())
        weight[words.indices.to_numpy(), asker] = tile["weights"].to_numpy()
        at = pc.index_in(block["terms"], value_set=words.dictionary)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(block["ids"])), block["sizes"].to_numpy())[known]
        tf = block["tfs"].to_numpy().astype(float)[known]
        length = block["lengths"].fill_null(0).to_numpy().astype(float)[owner]
        part = np.zeros((len(block["ids"]), len(weight)))
        part[owner, at.drop_null().to_numpy()] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / tile["avgdl"]))
        found = part @ weight
        return np.where(found > 0, found, -np.inf)

    top = best_pairs(maps, _tiles(weighed, QUERY_TILE), k, score)
    # at most k rows per query reach this window
    best = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1e-9))
    return top.select(
        "query_id", "rank", "id", "score", F.greatest(F.lit(0.0), F.col("score") / best).alias("normalized")
    )
