"""Exact cosine top-k of a batch of query vectors over a distributed corpus.

Vectors of the corpus are packed into blocks and those of the queries into tiles, both as rows of
a table; a task that has a block and a tile multiplies them and keeps k rows for each query. The
corpus is read once, whatever the number of queries, and no vector passes the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import cosine
from ledgerloom.retrieval.tiles import best_pairs, packed
from ledgerloom.session import bounded_batches

QUERY_TILE = 1024
CORPUS_BLOCK = 2048


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERY_TILE) -> DataFrame:
    """``query_id, rank, id, score``.

    ``corpus`` is ``(id, tenant, vector)``, ``queries`` ``(query_id, tenant, vector)``; a
    query sees its own tenant only. Ids are of any type that has an order. A document or query
    without a vector is not ranked. Scores are compared at six decimals, then by id. Planning
    runs no job.
    """
    bounded_batches(corpus.sparkSession)
    documents = corpus.where(F.col("vector").isNotNull()).select("id", "tenant", "vector")
    asked = queries.where(F.col("vector").isNotNull()).select(F.col("query_id").alias("id"), "tenant", "vector")
    return best_pairs(_packed(documents, CORPUS_BLOCK), _packed(asked, block), k, _cosines)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    def pack(held: list) -> dict:
        vectors = _unit(np.array([r["vector"] for r in held], np.float64))
        return {"ids": [r["id"] for r in held], "width": vectors.shape[1], "vectors": vectors.tobytes()}

    return packed(rows, size, pack, f"ids array<{rows.schema['id'].dataType.simpleString()}>, width int, vectors binary")


def _cosines(block: dict, tile: dict) -> np.ndarray:
    sides = [np.frombuffer(side["vectors"]).reshape(len(side["ids"]), side["width"]) for side in (block, tile)]
    return np.round(sides[0] @ sides[1].T, 6)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; a row of (almost) no length becomes zero."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 1e-9)


def pair_cosine(pairs: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of given ``(query_id, id)`` pairs."""
    documents = corpus.select("id", F.col("vector").alias("document_vector"))
    asked = queries.select("query_id", F.col("vector").alias("query_vector"))
    return pairs.join(documents, "id").join(asked, "query_id").withColumn(
        "score", cosine(F.col("query_vector"), F.col("document_vector"))
    ).drop("document_vector", "query_vector")


def mean_vectors(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """One mean vector per group, averaged element by element."""
    elements = vectors.select(group, F.posexplode(vector).alias("position", "x"))
    means = elements.groupBy(group, "position").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # a vector's own width bounds this list
    ordered = F.array_sort(F.collect_list(F.struct("position", "x")))
    return means.groupBy(group).agg(F.transform(ordered, lambda e: e["x"]).alias("vector"))
