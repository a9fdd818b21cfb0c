"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_sample, only, small_batches, stored, text_hash, with_row
from ledgerloom.llm.numeric import as_bytes, in_batches

DIMENSIONS = 4096
SAMPLE = 1000  # labelled documents of each language that are learned from, at most
SAMPLE_CLASSES = 8
CENTROIDS = 4
PIECE = 1 << 20  # bytes of a long text that are counted at a time
ITERATIONS = 8
# a text is rejected below this part of what all but REJECT_SHARE of the sample of its length reach
REJECT_PART = 0.5
REJECT_SHARE = 0.01
UNKNOWN = "und"

_SYMBOL = np.arange(256, dtype=np.uint64)
_SYMBOL[:128] = 32  # every ASCII character but a letter counts as a gap
for _c in range(97, 123):
    _SYMBOL[_c] = _SYMBOL[_c - 32] = _c


def has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def ngram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte pairs and triples of each text; a gap is added around it.

    A text of over two PIECEs is counted by the piece; pieces share two bytes, so none is lost
    and only the pair that both hold counts twice.
    """
    if len(texts) == 1 and len(texts[0]) > 2 * PIECE:
        text = texts[0]
        return sum(_ngram_counts([text[at : at + PIECE + 2]]) for at in range(0, len(text), PIECE))
    return _ngram_counts(texts)


def _ngram_counts(texts: list[bytes]) -> np.ndarray:
    buffer = np.frombuffer(b" ".join(texts).join([b" ", b"  "]), np.uint8)
    symbol = _SYMBOL[buffer]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths) * DIMENSIONS
    pair = symbol[:-1] * np.uint64(257) + symbol[1:]
    triple = pair[:-1] * np.uint64(257) + symbol[2:] + np.uint64(1 << 40)
    shift = np.uint64(64 - 12)
    total = np.zeros(len(texts) * DIMENSIONS, np.int64)
    for codes in (pair, triple):
        bins = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)[: len(owner)]
        total += np.bincount(owner[: len(bins)] + bins, minlength=len(total))
    return total.reshape(len(texts), DIMENSIONS)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit_rows((np.log1p(counts) * idf).astype(np.float32))


def length_class(n_bytes: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_bytes, 1)), 12).astype(np.int64)


@dataclass(frozen=True)
class Centroids:
    """A few unit vectors per language: what is learned fits a closure."""

    languages: list[str]
    owners: np.ndarray  # language of each centroid
    vectors: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # similarity by length class below which a text is rejected

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Nearest language and cosine of each text."""
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        for begin, end in in_batches(sizes + (1 << 14)):
            likeness = tf_idf(ngram_counts(texts[begin:end]), self.idf) @ self.vectors.T
            at = likeness.argmax(axis=1)
            best[begin:end] = self.owners[at]
            score[begin:end] = likeness[np.arange(len(at)), at]
        return best, np.clip(score, 0.0, 1.0)


def _clustered(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from seeds that are far from each other."""
    seeds = [unit_rows(vectors.sum(axis=0, keepdims=True))[0]]
    while len(seeds) < min(k, len(vectors)):
        nearest = (vectors @ np.array(seeds).T).max(axis=1)
        # not the farthest, which may be junk: one at the lower quarter
        seeds.append(vectors[np.argsort(nearest, kind="stable")[len(nearest) // 4]])
    centres = np.array(seeds)
    for _ in range(ITERATIONS):
        own = (vectors @ centres.T).argmax(axis=1)
        centres = np.array([vectors[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = unit_rows(centres)
    return centres


def fit_languages(docs: DataFrame, usable: Column, sample: int = SAMPLE, k: int = CENTROIDS) -> Centroids:
    """Learn centroids from the rows with a language that ``usable`` admits.

    Of each language at most ``sample`` documents are used, drawn by text hashes: a bounded,
    repeatable sample. Documents without a letter teach nothing. The driver gets one
    vector of DIMENSIONS for each partition (document frequencies) and for each centroid.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    narrow = rows.select("doc_id", "lang", text_hash().alias("text_key"))
    chosen = bounded_sample(narrow, "lang", F.col("text_key"), sample, SAMPLE_CLASSES)
    chosen = stored(chosen.select("doc_id", "text_key"), "language-sample")
    texts = only(rows.select("doc_id", "text", "lang", text_hash().alias("text_key")), chosen).select("lang", "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf.text.map(has_letter)]
            raw = as_bytes(pdf.text)
            for begin, end in in_batches(np.array([len(t) + (1 << 14) for t in raw], np.int64)):
                counts = ngram_counts(raw[begin:end])
                yield pd.DataFrame(
                    {
                        "lang": pdf.lang.iloc[begin:end].to_numpy(), "n_bytes": [len(t) for t in raw[begin:end]],
                        "counts": [np.minimum(c, 65535).astype(np.uint16).tobytes() for c in counts],
                    }
                )

    vectors = stored(texts.mapInPandas(counted, "lang string, n_bytes long, counts binary"), "language-vectors")

    def unpacked(column: pd.Series) -> np.ndarray:
        return np.array([np.frombuffer(c, np.uint16) for c in column]).reshape(-1, DIMENSIONS)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for pdf in batches:
            total += (unpacked(pdf.counts) > 0).sum(axis=0)
            n += len(pdf)
        yield pd.DataFrame({"n": [n], "df": [total.tobytes()]})

    parts = vectors.coalesce(8).mapInPandas(frequencies, "n long, df binary").collect()
    n = sum(p.n for p in parts)
    df = np.sum([np.frombuffer(p.df, np.int64) for p in parts], axis=0) if parts else np.zeros(DIMENSIONS)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def clustered(pdf: pd.DataFrame) -> pd.DataFrame:
        centres = _clustered(tf_idf(unpacked(pdf.counts), idf), k).astype(np.float32)
        return pd.DataFrame({"lang": pdf.lang.iloc[0], "centre": [c.tobytes() for c in centres]})

    found = vectors.groupBy("lang").applyInPandas(clustered, "lang string, centre binary").collect()
    found.sort(key=lambda r: (r.lang, r.centre))
    languages = sorted({r.lang for r in found})
    owners = np.array([languages.index(r.lang) for r in found], np.int64)
    centres = np.array([np.frombuffer(r.centre, np.float32) for r in found]).reshape(-1, DIMENSIONS)
    model = Centroids(languages, owners, centres, idf, np.zeros(13))
    if not languages:
        return model

    def nearness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            likeness = (tf_idf(unpacked(pdf.counts), idf) @ centres.T).max(axis=1)
            yield pd.DataFrame({"length": length_class(pdf.n_bytes.to_numpy()), "likeness": likeness.astype(float)})

    limits = vectors.mapInPandas(nearness, "length long, likeness double").groupBy("length").agg(
        F.percentile_approx("likeness", REJECT_SHARE, 10_000).alias("least")
    ).collect()
    least = np.zeros(13)
    for row in limits:
        least[row.length] = REJECT_PART * row.least
    return Centroids(languages, owners, centres, idf, least)


def identify(text: Column, model: Centroids) -> Column:
    """``lang_pred``, ``score`` (cosine) and ``rejected`` of a text, as one struct.

    A text that is null or has no letter is UNKNOWN with score 0 and rejected; so is every text
    where nothing was learned. Others get the language of the nearest centroid, however far;
    ``rejected`` tells where it is too far for a text of that length.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array([*model.languages, UNKNOWN], object)
        for series in batches:
            letters = series.map(has_letter).to_numpy(bool) & bool(model.languages)
            raw = as_bytes(series[letters])
            best, score = np.full(len(series), -1), np.zeros(len(series))
            far = np.ones(len(series), bool)
            if len(raw):
                best[letters], score[letters] = model.judge(raw)
                sizes = np.fromiter((len(t) for t in raw), np.int64, len(raw))
                far[letters] = score[letters] < model.least[length_class(sizes)]
            yield pd.DataFrame({"lang_pred": names[best], "score": score, "rejected": far})

    return judged(text)


def predict_languages(docs: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """Language of every text, learned from the rows that are not held out.

    Only the text decides a prediction. Repeated rows keep a row each; an empty table gives
    no rows.
    """
    model = fit_languages(docs, ~held_out, sample)
    rows = docs.select("doc_id", held_out.alias("held_out"), identify(F.col("text"), model).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


def keep_identified(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns."""
    model = fit_languages(docs, usable, sample)
    judged = with_row(docs).withColumn("found", identify(F.col("text"), model))
    return judged.where(~F.col("found.rejected")).select("row.*")
