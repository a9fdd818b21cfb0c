"""Language-model scoring with Elias-Fano n-gram tries, sharded over the corpus."""

from __future__ import annotations

import math
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored
from ledgerloom.llm.numeric import GOLDEN, RangeHash, as_bytes, joined, mixed, words_of

BLOCK_BYTES = 12 << 20  # text whose n-grams are counted and scored together
SHARD_BYTES = 48 << 20  # text to a shard of the model
WORD_BITS = 32  # of each word in a bigram's key: successors of a context that has n share a count at a rate of n / 2**32
WEIGHT = 0.6  # of the bigram level against the unigram level
STEP = 2048  # codes to a factor of ten
BEGIN, END = np.uint64(0x0B5E), np.uint64(0x0E4D)


class EliasFano:
    """A strictly increasing sequence: low bytes as they are, high bits in unary.

    ``find`` goes to the bucket of the high bits and searches the low ones inside it.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, width: int, n: int):
        self.low, self.width, self.n = low, width, n
        ones = np.flatnonzero(np.unpackbits(high, count=None)) if n else np.empty(0, np.int64)
        parts = (ones - np.arange(n)).astype(np.uint64)  # zeros before the i-th one
        self.start = np.searchsorted(parts, np.arange(int(parts[-1]) + 2 if n else 1, dtype=np.uint64))

    @staticmethod
    def encode(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Low bytes (n x width), packed unary high bits, width in bytes."""
        n = len(values)
        width = max(0, min(7, round((bits - math.log2(n + 1)) / 8)))
        width = max(width, (bits - 25 + 7) // 8)  # no more than 2**25 buckets
        low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :width]
        parts = (values >> np.uint64(8 * width)).astype(np.int64)
        flags = np.zeros(int(parts[-1]) + n if n else 0, np.uint8)
        flags[parts + np.arange(n) if n else []] = 1
        return np.ascontiguousarray(low), np.packbits(flags) if n else np.empty(0, np.uint8), width

    @staticmethod
    def to_bytes(values: np.ndarray, bits: int) -> bytes:
        low, high, width = EliasFano.encode(values, bits)
        # planes of equal bytes beside each other
        return np.array([len(values), width], "<u4").tobytes() + low.T.tobytes() + high.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> np.ndarray:
        n, width = (int(x) for x in np.frombuffer(data, "<u4", 2))
        low = np.frombuffer(data, np.uint8, n * width, 8).reshape(width, n)
        if not n:
            return np.empty(0, np.uint64)
        high = np.frombuffer(data, np.uint8, offset=8 + n * width)
        values = (np.flatnonzero(np.unpackbits(high))[:n] - np.arange(n)).astype(np.uint64) << np.uint64(8 * width)
        for k in range(width):
            values |= low[k].astype(np.uint64) << np.uint64(8 * k)
        return values

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(self.width):
            out |= self.low[at, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """Where each value stands, -1 where it does not."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        shift = np.uint64(8 * self.width)
        part = np.minimum(values >> shift, np.uint64(len(self.start) - 2)).astype(np.int64)
        rest = values - ((values >> shift) << shift)
        left, end = self.start[part].copy(), self.start[part + 1]
        right = end.copy()
        while True:  # successor search inside all buckets at once
            open_ = np.flatnonzero(left < right)
            if not len(open_):
                break
            middle = (left[open_] + right[open_]) // 2
            less = self._low(middle) < rest[open_]
            left[open_] = np.where(less, middle + 1, left[open_])
            right[open_] = np.where(less, right[open_], middle)
        met = (left < end) & ((values >> shift) == part.astype(np.uint64))
        met[met] = self._low(left[met]) == rest[met]
        return np.where(met, left, -1)


class Trie:
    """Bigram levels in memory-mapped files: contexts, and their successors.

    A successor is stored as rank of its context and its own bits, which rises over the whole
    level: the high part of the code points into the level, the low part is searched within
    the context. Values are quantised logarithms of weighted frequencies.
    """

    def __init__(self, folder: str, keys: np.ndarray, counts: np.ndarray):
        seen = counts > 0
        keys, counts = keys[seen], counts[seen]
        bits = np.uint64(WORD_BITS)
        contexts, rank = np.unique(keys >> bits, return_inverse=True)
        words = keys & np.uint64((1 << WORD_BITS) - 1)
        self.levels = []
        relative = (rank.astype(np.uint64) << bits) | words
        for name, values in (("contexts", contexts), ("successors", relative)):
            top = int(values[-1]).bit_length() if len(values) else 1
            low, high, width = EliasFano.encode(values, max(top, 1))
            low, high = self._mapped(folder, f"{name}-low", low), self._mapped(folder, f"{name}-high", high)
            self.levels.append(EliasFano(low, high, width, len(values)))
        codes = 1 + np.round(STEP * np.log10(counts)).astype(np.int64)
        self.codes = self._mapped(folder, "codes", np.minimum(codes, 65535).astype("<u2"))

    @staticmethod
    def _mapped(folder: str, name: str, values: np.ndarray) -> np.ndarray:
        path = Path(folder) / name
        if not values.size:
            return values
        values.tofile(path)
        return np.memmap(path, values.dtype, "r", shape=values.shape)

    def codes_of(self, keys: np.ndarray) -> np.ndarray:
        """Codes of the bigrams; 0 for one never seen."""
        bits = np.uint64(WORD_BITS)
        found = np.zeros(len(keys), np.uint16)
        if not len(self.codes):
            return found
        rank = self.levels[0].find(keys >> bits)
        known = np.flatnonzero(rank >= 0)
        at = self.levels[1].find((rank[known].astype(np.uint64) << bits) | (keys[known] & np.uint64((1 << WORD_BITS) - 1)))
        found[known[at >= 0]] = self.codes[at[at >= 0]]
        return found


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight beside each other: nearly all but the first are zero."""
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind)[:, 0]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), minlength=len(found)).astype(np.int64)


class Block:
    """The tokens of some documents: distinct words and bigrams, and which stand where."""

    def __init__(self, texts: list[bytes], shards: int):
        buffer, text_starts, _ = joined(texts, lower=True)
        starts, ends, owner = words_of(buffer, text_starts)
        words = RangeHash(buffer)(starts, ends)
        self.length = np.bincount(owner, minlength=len(texts)) + 1  # with the end
        last = np.cumsum(self.length) - 1
        tokens = np.empty(int(self.length.sum()), np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[last] = True
        tokens[is_end], tokens[~is_end] = END, words
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[last - self.length + 1] = BEGIN
        self.owner = np.repeat(np.arange(len(texts)), self.length)
        self.first = last - self.length + 1
        bits = np.uint64(64 - WORD_BITS)
        pairs = ((mixed(before + GOLDEN) >> bits) << np.uint64(WORD_BITS)) | (mixed(tokens) >> bits)
        self.levels = [np.unique(x, return_inverse=True) for x in (tokens, pairs)]
        self.shard = [(mixed(keys * GOLDEN) % np.uint64(shards)).astype(np.int64) for keys, _ in self.levels]

    def _cells(self, level: int):
        """Each shard that holds keys of the level, and where those keys stand."""
        order = np.argsort(self.shard[level], kind="stable")
        held, begin = np.unique(self.shard[level][order], return_index=True)
        yield from zip(held.tolist(), np.split(order, begin[1:]))

    def requests(self, held_out: np.ndarray):
        """Level, shard, keys and counts in training texts, for the shards that hold any of the block's keys.

        There are never more of these than distinct n-grams, however many shards there are.
        """
        training = ~held_out[self.owner]
        for level, (keys, at) in enumerate(self.levels):
            counts = np.bincount(at[training], minlength=len(keys)).astype("<u4")
            for s, own in self._cells(level):
                yield level, s, EliasFano.to_bytes(keys[own], 64 if level == 0 else 2 * WORD_BITS), _planes(counts[own])

    def values(self, level: int, answers: dict[tuple[int, int], bytes], kind: str) -> np.ndarray:
        """The answers of all shards in the order of the level's keys."""
        out = np.zeros(len(self.levels[level][0]), kind)
        for s, own in self._cells(level):
            out[own] = _from_planes(answers[level, s], kind)
        return out


def _answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """What one shard of one level knows about the n-grams each block asks for."""
    level = group.column("level")[0].as_py()
    asked = [EliasFano.from_bytes(b) for b in group.column("keys").to_pylist()]
    counts = [_from_planes(b, "<u4") for b in group.column("counts").to_pylist()]
    keys, total = _summed(asked, counts)
    if level == 0:
        low, high, width = EliasFano.encode(keys, 64)
        known = EliasFano(low, high, width, len(keys))
        replies = [_planes(total[known.find(a)].astype("<u4")) for a in asked]
    else:
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(folder, keys, total)
            replies = [_planes(trie.codes_of(a)) for a in asked]
    n = len(replies)
    return pa.table(
        {
            "block": group.column("block"), "level": group.column("level"), "shard": group.column("shard"),
            "reply": pa.array(replies, pa.binary()),
            "tokens": pa.array(np.full(n, total.sum() if level == 0 else 0)),
            "types": pa.array(np.full(n, (total > 0).sum() if level == 0 else 0)),
        }
    )


def score_texts(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Log-probability of every text under a model of the texts that are not held out.

    Documents are dealt to blocks of about ``block_bytes``. A block sends its distinct words
    and bigrams with their training counts to shards of the model, by key hash, so no word or
    context gathers in one task. A shard sums them, builds its part of the trie, and answers
    each block's own keys; the block then scores its documents. The model is never whole
    anywhere. A block writes to the shards that hold its n-grams, so rows and bytes that move
    grow as the distinct n-grams of the blocks. Replies are a stored table: an executor lost
    later costs no new count.

    ``base_score`` adds one to the exact word counts. ``score`` mixes that with the quantised
    bigram level: p = WEIGHT * count(context, word) / count(context) + (1 - WEIGHT) * base;
    after a context never seen, base alone. Every text has an end token, so a null or empty
    text has one token. Rows are scored one by one; repeated ids keep a row each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks, shards = max(1, math.ceil(size / block_bytes)), max(4, math.ceil(size / shard_bytes))
    block = F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(blocks))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"), block.cast("int").alias("block"))

    def asked(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        own = Block(as_bytes(group.column("text").to_pylist()), shards)
        held = group.column("held_out").to_numpy(zero_copy_only=False)
        level, shard, keys, counts = zip(*own.requests(np.asarray(held, bool)))
        n = len(level)
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * n, pa.int32()), "level": pa.array(level, pa.int32()),
                "shard": pa.array(shard, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary()),
            }
        )

    def scored(key: tuple[pa.Scalar, ...], group: pa.Table, replies: pa.Table) -> pa.Table:
        own = Block(as_bytes(group.column("text").to_pylist()), shards)
        names = zip(replies.column("level").to_pylist(), replies.column("shard").to_pylist())
        answers = dict(zip(names, replies.column("reply").to_pylist()))
        words, at_word = own.levels[0]
        count = own.values(0, answers, "<u4").astype(np.float64)
        code = own.values(1, answers, "<u2")[own.levels[1][1]].astype(np.float64)
        here = count[at_word]
        base = (here + 1) / (total + types + 1)
        context = np.empty_like(here)
        context[1:] = here[:-1]
        context[own.first] = count[np.searchsorted(words, END)]  # every text has a beginning and an end
        seen = np.where(code > 0, 10.0 ** ((code - 1) / STEP), 0.0)
        mix = np.where(context > 0, WEIGHT * np.minimum(seen / np.maximum(context, 1), 1.0) + (1 - WEIGHT) * base, base)
        n = len(group)
        sums = [np.bincount(own.owner, np.log10(p), minlength=n) for p in (base, mix)]
        return pa.table(
            {
                "doc_id": group.column("doc_id"), "held_out": group.column("held_out"),
                "n_tokens": pa.array(own.length.astype(np.int64)),
                "n_known": pa.array(np.bincount(own.owner, here > 0, minlength=n).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, total, np.int64)),
                "base_score": pa.array(sums[0]), "score": pa.array(sums[1]),
            }
        )

    requests = rows.groupBy("block").applyInArrow(asked, "block int, level int, shard int, keys binary, counts binary")
    answered = requests.groupBy("level", "shard").applyInArrow(
        _answer, "block int, level int, shard int, reply binary, tokens long, types long"
    )
    replies = stored(answered, "replies")
    # a shard says the same in each of its replies
    own = replies.where("level = 0").groupBy("shard").agg(F.max("tokens").alias("tokens"), F.max("types").alias("types"))
    total, types = own.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    replies = replies.select("block", "level", "shard", "reply")
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        scored,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
