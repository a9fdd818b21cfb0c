"""Ranked lexical search: posting lists in blocks of similar documents, skipped by exact bounds."""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored

# fixed values of the contract
LENGTH_SHARE = 75  # of 100: how much a document's length counts
SCALE, TF_SCALE, LENGTH_SCALE = 10**9, 1000, 8

QUERIES = 512  # queries that are answered in one pass over the corpus
SLICE = 2048  # documents that are indexed at a time in a task
BLOCK = 16  # documents of a block of a posting list
SKETCH = 16  # dimensions in which documents of a list are compared
PIECE = 1 << 20  # bytes of a long text that are split at a time

_KEEP = (string.ascii_lowercase + string.digits).encode()
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEEP else 32 for b in range(256)
)  # A-Z to a-z; every other ASCII byte that is no letter or digit to a gap


def terms_in(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; a long text is cut between terms."""
    folded = text.translate(_FOLD)
    begin = 0
    while len(folded) - begin > 2 * PIECE:
        end = folded.find(b" ", begin + PIECE)
        if end < 0:
            break
        yield folded[begin:end].split()
        begin = end
    yield folded[begin:].split()


def _raw(value) -> bytes:
    buffer = value.as_buffer()
    return b"" if buffer is None else buffer.to_pybytes()


@dataclass(frozen=True)
class Queries:
    """A block of queries: its vocabulary, and of each query the terms with their repeats."""

    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[str | None]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        terms, repeats = [], []
        for text in texts:
            count: Counter = Counter()
            for part in terms_in((text or "").encode("utf-8", "surrogatepass")):
                count.update(part)
            own = [vocabulary.setdefault(t, len(vocabulary)) for t in count]
            terms.append(np.array(own, np.int64))
            repeats.append(np.fromiter(count.values(), np.int64, len(count)))
        return cls(vocabulary, terms, repeats)


def term_counts(docs: DataFrame, queries: Queries) -> DataFrame:
    """``doc_id``, ``n`` (terms of the text), and which terms of the queries it holds how often."""
    known = queries.vocabulary

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, often = [], [], []
            for value in batch.column("text"):
                n, hits = 0, []
                for part in terms_in(_raw(value)):
                    n += len(part)
                    hits += [at for at in map(known.get, part) if at is not None]
                terms, tf = np.unique(np.array(hits, np.int32), return_counts=True)
                sizes.append(n)
                found.append(terms)
                often.append(tf)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()),
                    pa.array(found, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


@dataclass(frozen=True)
class Corpus:
    """What scores need of the whole corpus: N, L, and the weight of every term of the queries."""

    documents: int
    length: int
    weights: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, n_terms: int) -> Corpus:
        documents, length = counts.select(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(n_terms, np.int64)
        for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[row.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * row["count"] + 1)))
        return cls(documents, length, weights)

    def parts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What a term adds to a score for each unit of weight; at most a million."""
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * self.documents // max(self.length, 1)
        return (SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * m)).astype(np.int32)


class Blocks:
    """The posting list of a term over a slice of documents, clustered by likeness.

    Each document goes to the likest of some documents picked from the list, by their cosine in
    a random projection; clusters are cut into blocks. A block's summary holds, for each term
    that queries with this term can have, the largest part that any of its documents has: no
    document of the block scores above the summary. A likeness that is off costs time only.
    """

    def __init__(self, members: np.ndarray, columns: np.ndarray, matrix: np.ndarray, sketch: np.ndarray):
        if len(members) > BLOCK:
            seeds = sketch[members[:: BLOCK]]
            own = (sketch[members] @ seeds.T).argmax(axis=1)
            order = np.argsort(own, kind="stable")
            members, own = members[order], own[order]
            place = np.arange(len(own)) - np.searchsorted(own, own)
            self.starts = np.flatnonzero(place % BLOCK == 0)
        else:
            self.starts = np.zeros(1, np.int64)
        self.members = members
        self.ends = np.append(self.starts[1:], len(members))
        self.columns = columns
        self.summaries = np.maximum.reduceat(matrix[np.ix_(members, columns)], self.starts, axis=0)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The most that a document of each block can score by these terms."""
        return self.summaries[:, np.searchsorted(self.columns, terms)].astype(np.int64) @ weights

    def documents(self, chosen: np.ndarray) -> np.ndarray:
        return np.concatenate([self.members[self.starts[b] : self.ends[b]] for b in chosen])


class Searcher:
    """Answers a block of queries over slices of documents; keeps the best ``k`` of each query.

    A query visits the lists of its terms from the largest weight on. A document is judged in the
    list of its weightiest term, so in each list only that term and those after it count. A block
    is skipped where its bound is below the ``k``-th best score found; the rest of the lists, where
    even the largest parts of the remaining terms are. Equal bounds are visited: an equal score with
    a smaller id wins.
    """

    def __init__(self, queries: Queries, corpus: Corpus, k: int):
        self.corpus, self.k = corpus, k
        self.terms, self.weights = [], []
        columns: dict[int, set] = {}
        for terms, repeats in zip(queries.terms, queries.repeats):
            weights = corpus.weights[terms] * repeats
            order = np.argsort(-corpus.weights[terms], kind="stable")
            order = order[weights[order] > 0]
            self.terms.append(terms[order])
            self.weights.append(weights[order])
            for i, term in enumerate(terms[order]):
                columns.setdefault(int(term), set()).update(terms[order][i:].tolist())
        self.columns = {t: np.array(sorted(c), np.int64) for t, c in columns.items()}
        self.n_terms = len(queries.vocabulary)
        self.best: list[list[tuple]] = [[] for _ in self.terms]
        draw = np.random.default_rng(1)
        self.projection = draw.standard_normal((self.n_terms, SKETCH)).astype(np.float32)

    def least(self, query: int) -> int:
        best = self.best[query]
        return -best[-1][0] if len(best) == self.k else 1

    def add(self, ids: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Search a slice: document ids and lengths, and their terms, ``sizes`` of each."""
        owner = np.repeat(np.arange(len(ids)), sizes)
        matrix = np.zeros((len(ids), self.n_terms), np.int32)
        matrix[owner, terms] = self.corpus.parts(n[owner], tfs)
        sketch = (matrix * self.corpus.weights.astype(np.float32)).astype(np.float32) @ self.projection
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        order = np.argsort(terms, kind="stable")
        edges = np.searchsorted(terms[order], np.arange(self.n_terms + 1))
        lists: dict[int, Blocks] = {}
        largest = matrix.max(axis=0).astype(np.int64)
        for query, (own, weights) in enumerate(zip(self.terms, self.weights)):
            seen = np.zeros(len(ids), bool)
            left = np.cumsum((largest[own] * weights)[::-1])[::-1]
            for i, term in enumerate(own):
                if left[i] < self.least(query):
                    break
                if edges[term] == edges[term + 1]:
                    continue
                if term not in lists:
                    lists[term] = Blocks(owner[order[edges[term] : edges[term + 1]]], self.columns[term], matrix, sketch)
                self._visit(query, lists[term], own, weights, i, ids, matrix, seen)

    def _visit(self, query, blocks, own, weights, i, ids, matrix, seen) -> None:
        bounds = blocks.bounds(own[i:], weights[i:])
        # the most promising blocks first: they raise the score that others must reach
        order = np.argsort(-bounds, kind="stable")
        first = 1
        while len(order):
            order = order[bounds[order] >= self.least(query)]
            chosen, order = order[:first], order[first:]
            first = 4 * first
            if not len(chosen):
                break
            documents = blocks.documents(chosen)
            documents = documents[~seen[documents]]
            seen[documents] = True
            scores = matrix[np.ix_(documents, own)].astype(np.int64) @ weights
            good = scores >= self.least(query)
            if good.any():
                found = [(-int(s), ids[d] is None, ids[d]) for s, d in zip(scores[good], documents[good])]
                self.best[query] = sorted(self.best[query] + found, key=lambda f: f[:2] if f[1] else f)[: self.k]


def best_of_slices(counts: DataFrame, queries: Queries, corpus: Corpus, k: int) -> DataFrame:
    """``query``, ``doc_id``, ``score``: the best ``k`` of every query in each task."""
    kind = counts.schema["doc_id"].dataType.simpleString()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(queries, corpus, k)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                terms, tfs = part.column("terms"), part.column("tfs")
                searcher.add(
                    part.column("doc_id").to_pylist(), part.column("n").to_numpy(), terms.value_lengths().to_numpy(),
                    terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(),
                )
        if id_type is not None:
            rows = [(query, f[2], -f[0]) for query, best in enumerate(searcher.best) for f in best]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type),
                    pa.array([r[2] for r in rows], pa.int64()),
                ],
                names=["query", "doc_id", "score"],
            )

    # documents without a term of the queries score 0
    return counts.where(F.size("terms") > 0).mapInArrow(searched, f"query int, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Items are answered in blocks of about QUERIES, by the hash of their text; the corpus is split
    into terms once for each block, and only the terms of the block are kept of a document. A
    task indexes its documents a slice at a time, so its memory does not grow with the corpus, and
    sends ``k`` rows for each query. The driver and the tasks hold one block of queries and a number
    for each of its terms.

    Every row of ``docs`` is a document; equal scores rank by id, a null id last. Repeated rows of
    ``items`` are asked once; different texts under one id have a ranking each. Null and empty
    texts hold no terms: such an item has no rows. Empty tables give no rows.
    """
    asked = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    blocks = math.ceil(asked.count() / QUERIES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    spark = docs.sparkSession
    found = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    for block in range(blocks):
        chosen = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        queries = Queries.of([r.text for r in chosen])
        counts = stored(term_counts(docs, queries), "term-counts")
        corpus = Corpus.of(counts, len(queries.vocabulary))
        best = best_of_slices(counts, queries, corpus, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(chosen)], f"query int, item_id {item_kind}")
        found = found.unionByName(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return found
