"""Near duplicates: SuperMinHash signatures, banding, verified links, union of groups."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import keyed, only, small_batches, stored, text_hash, with_row
from ledgerloom.llm.numeric import GOLDEN, RangeHash, as_bytes, in_batches, joined, mixed, words_of

SPACE = re.compile(rb"[\x20\x09-\x0D]")
COMPONENTS = 128
BANDS = 32  # of four components: a pair of similarity 0.8 shares none once in 20 million times
SLICE = 1 << 19  # bytes of texts that are hashed together
PERMUTED = 4 << 20  # bytes of the permutations that are held together
PIECE = 1 << 19  # bytes of a long text that are hashed at a time
PAIRED = 16  # members of a bucket that are all compared with each other


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int = COMPONENTS) -> np.ndarray:
    """SuperMinHash signatures (Ertl) of many sets at once.

    Step j visits, for every element, the j-th place of the element's own random permutation,
    with the rank j plus a random fraction; a component keeps the least it is offered. A set
    whose components are all below j + 1 is finished: later ranks are larger.
    """
    out = np.full(n_sets * m, np.iinfo(np.int64).max, np.int64)
    order = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
    row = np.arange(len(elements))
    for j in range(m):
        if not len(row):
            break
        draw = mixed(elements[row] + np.uint64((j + 1) * int(GOLDEN) % 2**64))
        swap = j + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(m - j)).astype(np.int64)
        here, there = order[row, j], order[row, swap]
        order[row, swap], order[row, j] = here, there
        rank = (np.int64(j) << 32) + (draw >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, owner[row] * m + there, rank)
        open_sets = out.reshape(n_sets, m).max(axis=1) >= (np.int64(j + 1) << 32)
        row = row[open_sets[owner[row]]]
    return out.reshape(n_sets, m)


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One number per band, different bands never alike by design."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), bands, -1)
    found = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, parts.shape[:2])
    for k in range(parts.shape[2]):
        found = mixed(found + parts[:, :, k])
    return found.astype(np.int64)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct hashes of k-word shingles of each text; one for fewer words, none for none.

    Texts are hashed by the slice, a long text by the piece: of a text of any length only one
    hash for each word and each shingle is held.
    """
    found: list[np.ndarray] = []
    for begin, end in in_batches(np.fromiter((len(t) for t in texts), np.int64, len(texts)), SLICE):
        words, first = _word_hashes(texts[begin:end])
        grams = np.full(max(len(words) - k + 1, 0), 7, np.uint64)
        for i in range(k):
            grams = mixed(grams * GOLDEN + words[i : i + len(grams)])
        for i in range(end - begin):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                found.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                value = np.array([b - a], np.uint64)
                for w in range(a, b):
                    value = mixed(value * GOLDEN + words[w : w + 1])
                found.append(value)
            else:
                found.append(np.empty(0, np.uint64))
    return found


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and where the words of each text begin (and the last end)."""
    if len(texts) > 1 or len(texts[0]) <= 2 * PIECE:
        buffer, text_starts, _ = joined(texts, lower=True)
        starts, ends, owner = words_of(buffer, text_starts)
        return RangeHash(buffer)(starts, ends), np.searchsorted(owner, np.arange(len(texts) + 1))
    text, begin, parts = texts[0], 0, []
    while begin < len(text):
        # a piece ends at a space, however far the next one is
        blank = SPACE.search(text, begin + PIECE)
        end = blank.start() if blank else len(text)
        buffer, starts, _ = joined([text[begin:end]], lower=True)
        parts.append(RangeHash(buffer)(*words_of(buffer, starts)[:2]))
        begin = end
    words = np.concatenate(parts)
    return words, np.array([0, len(words)])


def _sequence(text: bytes) -> bytes | None:
    """A digest of the words in order; None without words."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _signed_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of some sets; of one large set by parts, whose least ranks are those of the whole."""
    if len(sets) > 1 or COMPONENTS * len(sets[0]) <= 2 * PERMUTED:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return super_minhash(np.concatenate(sets), owner, len(sets))
    step = PERMUTED // COMPONENTS
    parts = [sets[0][i : i + step] for i in range(0, len(sets[0]), step)]
    return np.min([super_minhash(p, np.zeros(len(p), np.int64), 1) for p in parts], axis=0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of about SLICE bytes of text, with their texts; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
        for begin, end in in_batches(sizes + 64, SLICE):
            part = batch.slice(begin, end - begin)
            yield part, as_bytes(part.column("text").to_pylist())


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id``, ``text_key``, digest of the words, size of the set, band hashes."""
    rows = keyed(docs)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches):
            sets = shingle_sets(texts, k)
            bands: list = [None] * len(sets)
            # the permutations of a batch take COMPONENTS bytes for each element
            for begin, end in in_batches(np.array([COMPONENTS * len(s) for s in sets]), PERMUTED):
                part = sets[begin:end]
                marks = band_hashes(_signed_sets(part))
                for i, s in enumerate(part):
                    bands[begin + i] = marks[i] if len(s) else None
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"),
                    pa.array([_sequence(t) for t in texts], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "words", "n_shingles", "bands"],
            )

    return rows.mapInArrow(signed, f"{kinds}, words binary, n_shingles long, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The whole shingle set of each node, computed from one of its documents."""
    wanted = nodes.select("doc_id", "text_key", "words")
    rows = only(keyed(docs), wanted)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(texts, k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_sequence(t) for t in texts], pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
                names=["words", "set"],
            )

    return rows.mapInArrow(built, "words binary, set array<long>").dropDuplicates(["words"])


def _pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs of the buckets: all pairs of small ones, pairs with the first member of others."""
    small = members.where(F.col("n") <= PAIRED).groupBy("band").agg(F.array_sort(F.collect_set("node")).alias("all"))
    rest = F.transform(
        "all",
        lambda a, i: F.transform(
            F.slice("all", i + 2, F.greatest(F.size("all") - i - 1, F.lit(0))),
            lambda b: F.struct(a.alias("a"), b.alias("b")),
        ),
    )
    close = small.select(F.explode(F.flatten(rest)).alias("p")).select("p.a", "p.b")
    star = members.where((F.col("n") > PAIRED) & (F.col("node") != F.col("centre"))).select(
        F.col("centre").alias("a"), F.col("node").alias("b")
    )
    return close.unionByName(star).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    one = sets.select(F.col("words").alias("wa"), F.col("set").alias("sa"))
    two = sets.select(F.col("words").alias("wb"), F.col("set").alias("sb"))
    both = pairs.join(one, F.col("a") == F.col("wa")).join(two, F.col("b") == F.col("wb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    measured = both.select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return measured.where(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b")


def grouped(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node that links reach: union-find in rounds.

    Each round takes the least label among a node and its neighbours, then the label of that
    label (path halving). Rounds end when nothing changes; each is a stored table.
    """
    ab = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    edges = stored(ab.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "edges")
    labels = stored(
        edges.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")),
        "labels",
    )
    while True:
        known = labels.select(F.col("node").alias("other"), F.col("label").alias("seen"))
        offered = edges.join(known, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        taken = labels.join(offered, "node").select("node", "label", F.least("label", "seen").alias("next"))
        roots = labels.select(F.col("node").alias("next"), F.col("label").alias("root"))
        after = stored(taken.join(roots, "next", "left").select("node", "label", F.coalesce("root", "next").alias("next")), "labels")
        changed = after.where(F.col("label") != F.col("next")).limit(1).count()
        labels = after.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def _rest(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of large buckets that hold more than one group after the first links."""
    large = members.where(F.col("n") > PAIRED).select("band", "node")
    tagged = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = tagged.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y")
    return tagged.join(split.select("band"), "band", "left_semi").select("node", "label").distinct()


def _rest_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates among those members, exactly: similar sets share a token of their prefixes.

    Tokens are ordered by the number of sets that hold them, rarest first. Of sets of x and y
    tokens, ``percent`` similar, the first x - ceil(percent x) + 1 and the same of y meet. A
    pair counts at its first common token, at places i and j: it then shares at most the lesser
    of x - i and y - j, which must be enough. Groups that are already one are left out.
    """
    own = rest.join(sets, F.col("node") == sets["words"]).select("node", "label", "set", F.size("set").alias("size"))
    tokens = own.select("node", "label", "size", F.explode("set").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = tokens.join(counts, "token", "left").groupBy("node", "label", "size").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "token"))).alias("tokens")
    )
    least = F.ceil(F.col("size") * percent / 100).cast("int")
    placed = F.transform(F.slice("tokens", 1, F.col("size") - least + 1), lambda t, i: F.struct(t["n"].alias("n"), t["token"].alias("token"), i.alias("i")))
    # a token of one set only meets nothing
    prefix = F.filter(placed, lambda t: t["n"] > 1)
    at = ranked.select("node", "label", "size", prefix.alias("prefix")).select(
        "node", "label", "size", F.col("prefix.token").alias("own"), F.explode("prefix").alias("t")
    ).select("node", "label", "size", "own", F.col("t.token").alias("token"), F.col("t.i").alias("i"))
    other = at.select(
        "token", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("size").alias("nb"), F.col("own").alias("ob"),
        F.col("i").alias("j"),
    )
    most = F.least(F.col("size") - F.col("i"), F.col("nb") - F.col("j"))
    met = at.withColumnRenamed("node", "a").join(other, "token").where(
        (F.col("a") < F.col("b")) & (F.col("label") != F.col("lb"))
        & (100 * most >= percent * (F.col("size") + F.col("nb") - most))
        & (F.get(F.array_intersect("own", "ob"), F.lit(0)) == F.col("token"))
    )
    return met.select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by ``percent`` similarity of their k-word shingle sets.

    Texts of equal words are one node, so copies cost one signature in the search. Nodes that
    share a band are candidates: all pairs in small buckets; in a larger one every member is
    compared with the first, and where that leaves more than one group in the bucket, its
    members are joined exactly by prefix and length filters. Links are confirmed on whole sets.

    ``component_id`` is the smallest id that links reach, null where all members have none. A null
    or empty text has no set and links with nothing. ``kept`` marks the rows of that id; ``first``
    those that also have the least text among them, which are equal rows.
    """
    small_batches(docs.sparkSession)
    signed = stored(signatures(docs, k), "signatures")
    nodes = stored(
        # rows without an id are the last of a group
        signed.where(F.col("words").isNotNull()).groupBy("words").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")).alias("first"),
            F.first("bands").alias("bands"),
        ).select(F.col("words").alias("node"), "first", "bands"),
        "nodes",
    )
    at = nodes.select("node", F.explode("bands").alias("band"))
    buckets = at.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).where("n > 1")
    members = stored(at.join(buckets, "band"), "members")
    pairs = stored(_pairs(members), "pairs")
    involved = nodes.join(members.select("node").distinct(), "node", "left_semi").select(
        "first.doc_id", "first.text_key", F.col("node").alias("words")
    )
    sets = stored(full_sets(docs, involved, k), "sets")
    links = stored(_confirmed(pairs, sets, percent), "links")
    labels = grouped(links)
    rest = stored(_rest(members, labels), "rest")
    if rest.limit(1).count():
        more = stored(_confirmed(_rest_pairs(rest, sets, percent), sets, percent), "links")
        labels = grouped(links.unionByName(more))
    placed = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = placed.groupBy("label").agg(F.min("first").alias("first"))
    groups = placed.select(F.col("node").alias("words"), "label").join(heads, "label").select("words", F.col("first").alias("label"))
    found = signed.drop("bands").join(groups, "words", "left")
    alone = F.col("words").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("label.doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    return found.select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"), kept.alias("kept"),
        (alone | (kept & (F.col("text_key") == F.col("label.text_key")))).alias("first"),
    )


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each group of ``docs``, with all its columns.

    Of rows with the same id and text one stays, whatever their other columns. Texts without
    words are in no group: they stay, those of one id once, those without an id all.
    """
    found = stored(near_duplicates(docs, k, percent), "groups")
    dropped = stored(found.where(~F.col("first")).select("doc_id", "text_key").distinct(), "dropped")
    repeated = found.where(F.col("first") & (F.col("doc_id").isNotNull() | (F.col("n_shingles") > 0)))
    twice = stored(
        repeated.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "twice"
    )
    rows = only(with_row(docs).withColumn("text_key", text_hash()), dropped, anti=True)
    if twice.limit(1).count():
        again = only(rows, twice).dropDuplicates(["doc_id", "text_key"])
        rows = only(rows, twice, anti=True).unionByName(again)
    return rows.select("row.*")
