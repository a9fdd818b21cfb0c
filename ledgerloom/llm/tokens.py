"""Token counts of whole texts, long ones encoded in overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_PIECE = "▁"


class ChunkedCounter:
    """Counts tokens as one encoding of the whole text would.

    A long text is encoded in chunks that overlap. Two neighbouring encodings are spliced at a
    character both of them cut at, just before a space that follows a letter or digit. The
    vocabulary proves that cut: no piece but the runs of spaces holds a space mark after its
    first character, so no merge reaches across it, on either side, whatever stands farther
    away. Where an overlap has no such cut it is widened, to the rest of the text if need be.
    A vocabulary or a normaliser without this property is used on whole texts only.
    """

    def __init__(self, model: bytes, chunk: int = 50_000, overlap: int = 200):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.proven = not any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in pieces) and self._keeps_spaces()

    def _keeps_spaces(self) -> bool:
        """Whether normalising keeps a run of spaces between words as it is."""
        return self.model.decode(self.model.encode("a  b c")) == "a  b c"

    @staticmethod
    def _is_cut(raw: bytes, at: int) -> bool:
        return at > 0 and raw[at : at + 1] == b" " and raw[at - 1 : at].isalnum()

    def _cuts(self, raw: bytes, start: int, end: int) -> dict[int, int]:
        """The proven cuts of an encoding of ``raw[start:end]``: place, tokens before it."""
        part = raw[start:end]
        encoded = self.model.encode(part.decode("utf-8"), return_type="proto").pieces
        found = {start + p.begin: i for i, p in enumerate(encoded) if self._is_cut(part, p.begin)}
        return found | {end: len(encoded)}

    def count_long(self, text: str) -> int:
        raw = text.encode("utf-8")

        def whole(at: int) -> int:
            """The next place, from ``at`` on, where a character begins."""
            while at < len(raw) and raw[at] & 0xC0 == 0x80:
                at += 1
            return min(at, len(raw))

        total, start, end = 0, 0, whole(self.chunk)
        here = self._cuts(raw, start, end)
        done = 0  # tokens of the present chunk that were counted with the one before
        while end < len(raw):
            overlap, splice = self.overlap, None
            while splice is None:
                # a chunk begins at a cut as well: its first token is then no half of one
                begin = end - overlap
                while begin > start and not self._is_cut(raw, begin):
                    begin -= 1
                if begin <= start:
                    break
                stop = whole(end + self.chunk)
                after = self._cuts(raw, begin, stop)
                splice = max((at for at in here if begin < at < end and at in after), default=None)
                overlap *= 2
            if splice is None:  # no common cut anywhere: the chunk itself grows
                end = whole(end + (end - start))
                here = self._cuts(raw, start, end)
                continue
            total += here[splice] - done
            done, here, start, end = after[splice], after, begin, stop
        return total + here[len(raw)] - done

    def count(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if not self._is_long(t)]
        encoded = iter(self.model.encode(short, num_threads=1)) if short else iter(())
        return [self.count_long(t) if self._is_long(t) else len(next(encoded)) for t in texts]

    def _is_long(self, text: str) -> bool:
        return self.proven and len(text) > self.chunk


def count_tokens(
    docs: DataFrame, model: bytes, limit: int = 4096, chunk: int = 50_000, overlap: int = 200
) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``.

    ``model`` is the content of a sentencepiece model file; it travels with the tasks, so no
    executor needs the file. A null text counts as empty. Rows are neither moved nor joined;
    repeated ids keep a row each.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = ChunkedCounter(model, chunk, overlap)
        for series in batches:
            texts = series.fillna("").tolist()
            found: list[int] = []
            for at in range(0, len(texts), 256):  # bounds the lists of ids held at once
                found += counter.count(texts[at : at + 256])
            yield pd.Series(found, dtype="int64")

    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        counted("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
