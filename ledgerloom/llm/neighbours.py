"""Quality by the votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import keyed, only, stored, text_hash
from ledgerloom.llm.numeric import GOLDEN, RangeHash, in_batches, joined, words_of

SAMPLE = 6000  # labelled documents that vote, at most; about 1.5 MB as latent vectors
LATENT = 64  # dimensions of the latent space
ROUNDS = 6  # of the subspace iteration that finds it
NEIGHBOURS = 9
BLOCK = 2048  # labelled vectors compared with a batch of documents at a time
PIECE = 1 << 19  # bytes of a long text that are counted at a time
BATCH = 1 << 21  # bytes of the texts counted together

GRAMS, SHAPES, STEPS = 4096, 512, 6
# byte classes: letters, digits and bytes of other scripts fold; each symbol is its own
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 128
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
# shares of words equal to the one before, of upper-case letters, of symbols and of digits
MARKS = 4
WIDTH = GRAMS + SHAPES + MARKS * STEPS


def pieces(text: bytes) -> list[bytes]:
    """A long text cut at spaces (after twice PIECE anywhere), so that no array grows with it."""
    found, begin = [], 0
    while len(text) - begin > 2 * PIECE:
        end = text.find(b" ", begin + PIECE, begin + 2 * PIECE)
        end = begin + 2 * PIECE if end < 0 else end
        found.append(text[begin:end])
        begin = end
    return [*found, text[begin:]]


def _binned(codes: np.ndarray, owner: np.ndarray, n: int, bits: int) -> np.ndarray:
    bins = ((codes * GOLDEN) >> np.uint64(64 - bits)).astype(np.int64) + (owner[: len(codes)] << bits)
    return np.bincount(bins, minlength=n << bits).reshape(n, 1 << bits)


def _profile(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of letter triples and of class quadruples; and the counts that shares are made of."""
    n = len(texts)
    buffer, starts, _ = joined(texts)
    owner = np.repeat(np.arange(n), np.diff(np.append(starts, len(buffer))))
    folded, kind = _LOWER[buffer], _CLASS[buffer]
    base = np.uint64(257)
    triple = (folded[:-2] * base + folded[1:-1]) * base + folded[2:]
    shape = ((kind[:-3] * base + kind[1:-2]) * base + kind[2:-1]) * base + kind[3:]
    counts = np.hstack([_binned(triple, owner, n, 12), _binned(shape, owner, n, 9)])
    word_starts, word_ends, word_owner = words_of(buffer, starts)
    words = RangeHash(buffer)(word_starts, word_ends)
    again = (words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])
    upper, lower = kind == 65, (kind == 97) | (kind == 128)
    digit, blank = kind == 48, (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    prose = upper | lower | digit | blank | (buffer == 44) | (buffer == 46)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=n)

    sums = [
        np.bincount(word_owner[1:][again], minlength=n), np.bincount(word_owner, minlength=n),
        per_text(upper), per_text(upper | lower), per_text(~prose), per_text(~blank), per_text(digit), per_text(~blank),
    ]
    return counts, np.array(sums).T


def profiles(texts: list[bytes]) -> np.ndarray:
    """One row of WIDTH counts per text: hashed letter triples, class quadruples, classes of shares."""
    parts = [pieces(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    flat = [p for own in parts for p in own]
    counts = np.zeros((len(texts), GRAMS + SHAPES), np.int64)
    sums = np.zeros((len(texts), 2 * MARKS), np.int64)
    sizes = np.fromiter((len(p) for p in flat), np.int64, len(flat))
    for begin, end in in_batches(sizes, BATCH):
        own_counts, own_sums = _profile(flat[begin:end])
        np.add.at(counts, owner[begin:end], own_counts)
        np.add.at(sums, owner[begin:end], own_sums)
    share = sums[:, 0::2] / np.maximum(sums[:, 1::2], 1)
    # steps of a share: none, up to 1/64, 1/32, 1/16, 1/8, more
    step = np.where(share > 0, np.clip(np.ceil(np.log2(np.maximum(share, 1e-9))) + 7, 1, STEPS - 1), 0).astype(np.int64)
    marks = np.zeros((len(texts), MARKS, STEPS), np.int64)
    np.put_along_axis(marks, step[:, :, None], 1, axis=2)
    marks[sums[:, 1] == 0] = 0
    return np.hstack([counts, marks.reshape(len(texts), MARKS * STEPS)])


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF; letters, shapes and shares have an equal part in the length of a vector."""
    x = (np.log1p(counts) * idf).astype(np.float32)
    edges = [0, GRAMS, GRAMS + SHAPES, WIDTH]
    return unit_rows(np.hstack([unit_rows(x[:, a:b]) for a, b in zip(edges, edges[1:])]))


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Texts whose profiles are made together: by bytes, with a row of counts each."""
    return in_batches(np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 8 * WIDTH, 2 * BATCH)


@dataclass(frozen=True)
class Voters:
    """The latent space and the labelled vectors in it: bounded, so they travel with the tasks."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit_rows(weighted(counts, self.idf) @ self.axes)

    def votes(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Mean label of the ``k`` nearest labelled vectors, weighted by their cosine.

        A vector of no length, of an empty text, is as far from all: it gets the mean of all labels.
        """
        own = self.latent(counts)
        best = np.zeros((len(own), 0), np.float32)
        label = np.zeros((len(own), 0))
        for begin in range(0, len(self.vectors), BLOCK):
            best = np.hstack([best, own @ self.vectors[begin : begin + BLOCK].T])
            label = np.hstack([label, np.broadcast_to(self.labels[begin : begin + BLOCK], (len(own), best.shape[1] - label.shape[1]))])
            if best.shape[1] > k:
                at = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, label = np.take_along_axis(best, at, 1), np.take_along_axis(label, at, 1)
        weight = np.maximum(best, 0.0).astype(float)
        total = weight.sum(axis=1)
        mean = self.labels.mean() if len(self.labels) else 0.5
        return np.clip(np.where(total > 0, (weight * label).sum(axis=1) / np.maximum(total, 1e-12), mean), 0.0, 1.0)


def _raw(column: pa.Array) -> list[bytes]:
    buffers = [value.as_buffer() for value in column]
    return [b"" if b is None else b.to_pybytes() for b in buffers]


def _unpacked(column: pd.Series) -> np.ndarray:
    return np.array([np.frombuffer(c, np.float32) for c in column]).reshape(-1, WIDTH)


def labelled_profiles(docs: DataFrame, labelled: DataFrame, sample: int) -> DataFrame:
    """``key``, ``label``, ``counts`` of at most ``sample`` labelled documents, drawn by hash.

    The draw is uniform, so labels keep their shares at every size. Equal rows count once; a
    document with two labels votes with both.
    """
    wanted = labelled.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "label").distinct()
    narrow = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_hash().alias("text_key")).distinct()
    drawn = narrow.join(wanted, "doc_id").withColumn("key", F.xxhash64("text_key", "doc_id", F.lit(13)))
    chosen = stored(drawn.orderBy("key", "doc_id", "label").limit(sample), "label-sample")
    texts = only(keyed(docs), chosen).dropDuplicates(["doc_id", "text_key"]).join(
        F.broadcast(chosen), ["doc_id", "text_key"]
    ).select("key", "label", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _raw(batch.column("text"))
            for begin, end in batches_of(raw):
                rows = [c.tobytes() for c in profiles(raw[begin:end]).astype(np.float32)]
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("label"), pa.array(rows, pa.binary())], names=["key", "label", "counts"]
                )

    return stored(texts.mapInArrow(counted, "key long, label int, counts binary"), "label-profiles")


def fit_voters(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Voters:
    """The latent space of the labelled sample, by subspace iteration, and its vectors.

    ``labelled`` has ``doc_id`` and ``label`` (0 or 1). Tasks send the driver sums of WIDTH by
    LATENT numbers for each of at most 8 partitions of the sample, and its latent vectors.
    """
    rows = labelled_profiles(docs, labelled, sample).coalesce(8)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(WIDTH), 0
        for pdf in batches:
            total += (_unpacked(pdf.counts) > 0).sum(axis=0)
            n += len(pdf)
        yield pd.DataFrame({"n": [n], "sums": [total.tobytes()]})

    found = rows.mapInPandas(frequencies, "n long, sums binary").collect()
    n = sum(r.n for r in found)
    df = np.sum([np.frombuffer(r.sums) for r in found], axis=0) if found else np.zeros(WIDTH)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    axes = np.random.default_rng(7).standard_normal((WIDTH, LATENT)).astype(np.float32)
    for _ in range(ROUNDS if n else 0):

        def turned(batches: Iterator[pd.DataFrame], axes: np.ndarray = axes) -> Iterator[pd.DataFrame]:
            total = np.zeros((WIDTH, LATENT), np.float32)
            for pdf in batches:
                x = weighted(_unpacked(pdf.counts), idf)
                total += x.T @ (x @ axes)
            yield pd.DataFrame({"sums": [total.tobytes()]})

        parts = rows.mapInPandas(turned, "sums binary").collect()
        total = np.sum([np.frombuffer(p.sums, np.float32) for p in parts], axis=0, dtype=float)
        axes = np.linalg.qr(total.reshape(WIDTH, LATENT))[0].astype(np.float32)

    space = Voters(idf, axes, np.zeros((0, LATENT), np.float32), np.zeros(0))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = space.latent(_unpacked(pdf.counts))
            yield pd.DataFrame({"key": pdf.key, "label": pdf.label, "vector": [v.tobytes() for v in own]})

    members = rows.mapInPandas(placed, "key long, label int, vector binary").collect()
    members.sort(key=lambda r: (r.key, r.label))
    vectors = np.array([np.frombuffer(r.vector, np.float32) for r in members], np.float32).reshape(-1, LATENT)
    return Voters(idf, axes, vectors, np.array([r.label for r in members], float))


def score_quality(docs: DataFrame, labelled: DataFrame, held_out: Column, sample: int = SAMPLE, limit: float = 0.7) -> DataFrame:
    """How likely label 1 is for every text, by the labels of the documents most like it.

    Only documents that are not held out vote, at most ``sample`` of them; only the text decides
    a score. A null or empty text gets the mean label of the voters, as does every text without
    a likeness above 0; without any voter that is 0.5. Repeated rows keep a row each; an empty
    table gives no rows. Long texts are counted in pieces.
    """
    voters = fit_voters(docs.where(~held_out).select("doc_id", "text"), labelled, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _raw(batch.column("text"))
            score = np.zeros(len(raw))
            for begin, end in batches_of(raw):
                score[begin:end] = voters.votes(profiles(raw[begin:end]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"]
            )

    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    found = rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= limit).cast("int"))
