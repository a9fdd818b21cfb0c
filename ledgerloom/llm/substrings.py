"""Repeated substrings by longest-previous-factor arrays over anchored pieces of the texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import join_keyed, keyed, only, stored
from ledgerloom.llm.numeric import RangeHash, as_bytes, in_batches, joined

WIDTH = 400  # bytes of a repeated string
GRAM = 64  # bytes of an anchor
CROWD = 256  # different pieces of one anchor that are put in suffix order together
SLICE_STEPS = 48  # windows to a slice
BATCH_WINDOWS = 40_000
COMPARED = 4096  # windows compared with their neighbours at once
HOT_PART = 1000  # a class of more than one HOT_PARTth of all pieces is joined by broadcast


def anchored_pieces(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Cut the texts into pieces by anchors: text, start, end, anchor hash, two hashes, anchor place.

    The anchor of a window of ``width`` bytes is its least hashed GRAM, the leftmost of equal
    ones. A piece is a longest run of windows with one anchor. The anchor follows from the
    window's bytes, so equal windows, wherever they stand, have equal anchors.
    """
    buffer, text_starts, text_ends = joined(texts)
    n_windows = len(buffer) - width
    if n_windows < 1:
        return [np.empty(0, np.int64)] * 7
    one, two = RangeHash(buffer, 1), RangeHash(buffer, 2)
    at = np.arange(len(buffer) - GRAM + 1)
    grams = one(at, at + GRAM)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span, reach = width - GRAM + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    anchor = (least[:n_windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), text_ends - text_starts + 1)[:n_windows]
    inside = np.arange(n_windows) + width <= text_ends[owner]
    new = np.ones(n_windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n_windows) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    ends = last + width
    text = owner[first]
    where = [text, first - text_starts[text], ends - text_starts[text]]
    hashes = (grams[anchor[first]], one(first, ends), two(first, ends))
    return [*where, *(h.view(np.int64) for h in hashes), anchor[first] - text_starts[text]]


def _shared_with_smaller(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each suffix in order, what it shares with the nearest one before it of a smaller place; else 0.

    Runs of suffixes at greater places are skipped in steps of falling powers of two, whose least
    place and least shared length are known beforehand.
    """
    least, common = [order], [shared]  # of the 2 ** k suffixes that end here
    reach = 1
    while 2 * reach <= len(order):
        ends = slice(reach, None), slice(None, -reach)
        least.append(np.concatenate([np.full(reach, -1), np.minimum(least[-1][ends[0]], least[-1][ends[1]])]))
        common.append(np.concatenate([np.zeros(reach, np.int64), np.minimum(common[-1][ends[0]], common[-1][ends[1]])]))
        reach *= 2
    at = np.arange(len(order)) - 1
    found = shared.copy()
    for k in reversed(range(len(least))):
        # a run that would begin before the first suffix has the least place -1
        skipped = np.flatnonzero((at >= 0) & (least[k][at] > order))
        found[skipped] = np.minimum(found[skipped], common[k][at[skipped]])
        at[skipped] -= 1 << k
    return np.where(at >= 0, found, 0)


def longest_previous(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """LPF: the longest string at each place that also starts at a smaller place.

    ``order`` lists the places 0 to n - 1 in suffix order; ``shared[i]`` is what the suffixes
    ``order[i - 1]`` and ``order[i]`` share. Only the nearest smaller places before and after
    in suffix order can share most.
    """
    order, shared = np.asarray(order, np.int64), np.asarray(shared, np.int64)
    back = np.concatenate([np.zeros(1, np.int64), shared[1:][::-1]])
    longest = np.maximum(_shared_with_smaller(order, shared), _shared_with_smaller(order[::-1], back)[::-1])
    found = np.empty(len(order), np.int64)
    found[order] = longest
    return found


def longest_next(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The mirror: the longest string at each place that also starts at a greater place."""
    return longest_previous(len(order) - 1 - np.asarray(order, np.int64), shared)[::-1]


def repeated_windows(pieces: list[tuple[bytes, bytes, int]], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """For every window of the pieces: piece, start, found elsewhere, found at a smaller place.

    A piece is (anchor, bytes, rank of its first occurrence); only windows with one anchor are
    compared. Places are ordered by rank, then start. A window is found at a smaller place where
    its longest previous factor is whole, and elsewhere where that or its longest next one is.
    """
    sizes = np.array([max(0, len(text) - width + 1) for _, text, _ in pieces])
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    start = np.arange(len(piece)) - (ends - sizes)[piece]
    head = max(len(anchor) for anchor, _, _ in pieces)
    table = np.empty((len(piece), head + width), np.uint8)
    for (anchor, text, _), size, end in zip(pieces, sizes, ends):
        if size:
            table[end - size : end, :head] = np.frombuffer(anchor, np.uint8)
            raw = np.frombuffer(text, np.uint8)
            table[end - size : end, head:] = np.lib.stride_tricks.sliding_window_view(raw, width)
    rank = np.array([p[2] for p in pieces])[piece]
    place = np.empty(len(table), np.int64)
    place[np.lexsort((start, rank))] = np.arange(len(table))
    by_bytes = np.argsort(table.view(f"V{table.shape[1]}")[:, 0], kind="stable")
    whole = table.shape[1]
    common = np.empty(max(0, len(table) - 1), np.int64)
    for begin in range(0, len(common), COMPARED):  # a few at a time: the table itself is the largest thing held
        at = by_bytes[begin : begin + COMPARED + 1]
        differs = table[at[1:]] != table[at[:-1]]
        common[begin : begin + COMPARED] = np.where(differs.any(axis=1), differs.argmax(axis=1), whole)
    del table
    shared = np.concatenate([[0], common])
    earlier = longest_previous(place[by_bytes], shared)[place] >= whole
    later = longest_next(place[by_bytes], shared)[place] >= whole
    return piece, start, earlier | later, earlier


def _pieces(docs: DataFrame, width: int) -> DataFrame:
    rows = keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text").to_pylist())
            for begin, end in in_batches(np.fromiter((len(t) for t in texts), np.int64, len(texts))):
                text, *columns = anchored_pieces(texts[begin:end], width)
                rows_of = pa.array(text + begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows_of), batch.column("text_key").take(rows_of), *map(pa.array, columns)],
                    names=["doc_id", "text_key", "start", "stop", "anchor", "h1", "h2", "middle"],
                )

    names = "start long, stop long, anchor long, h1 long, h2 long, middle long"
    return rows.mapInArrow(cut, f"doc_id {kind}, text_key long, {names}")


def _texts_of(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of each class of pieces, cut from the document of its first occurrence."""
    rows = only(keyed(docs), classes).dropDuplicates(["doc_id", "text_key"])
    per_doc = classes.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("start", "stop", "middle", "anchor", "h1", "h2", "n", "crowd")).alias("cuts")
    )
    whole = join_keyed(rows, per_doc, "inner")
    cut = F.transform("cuts", lambda c: F.struct(
        c["start"].alias("start"), c["middle"].alias("middle"), c["anchor"].alias("anchor"), c["h1"].alias("h1"), c["h2"].alias("h2"), c["n"].alias("n"),
        c["crowd"].alias("crowd"),
        F.substring("raw", (c["start"] + 1).cast("int"), (c["stop"] - c["start"]).cast("int")).alias("bytes"),
    ))
    with_bytes = whole.select("doc_id", "text_key", F.col("text").cast("binary").alias("raw"), "cuts")
    return with_bytes.select("doc_id", "text_key", F.explode(cut).alias("c")).select("doc_id", "text_key", "c.*")


def _by_suffix(pieces: DataFrame, width: int) -> DataFrame:
    """LPF over the pieces of each anchor; windows found elsewhere and earlier, as runs."""
    ranked = pieces.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "text_key", "start")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(group: list[tuple]) -> pa.RecordBatch:
            given = [(int(a).to_bytes(8, "big", signed=True), t, i) for i, (a, _, _, t) in enumerate(group)]
            piece, start, elsewhere, earlier = repeated_windows(given, width)
            out: dict[str, list] = {"h1": [], "h2": [], "from": [], "to": [], "earlier": []}
            # every window of a piece holds its anchor, so those found cover one run
            for flag, mark in ((elsewhere, False), (earlier, True)):
                at = np.flatnonzero(flag)
                first = np.flatnonzero(np.diff(piece[at], prepend=-1))
                last = np.append(first, len(at))[1:] - 1
                for a, b in zip(at[first], at[last]):
                    out["h1"].append(group[piece[a]][1])
                    out["h2"].append(group[piece[a]][2])
                    out["from"].append(int(start[a]))
                    out["to"].append(int(start[b]) + width)
                    out["earlier"].append(mark)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

        windows = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "h1", "h2", "bytes")]
            for row in zip(*columns):
                if windows > BATCH_WINDOWS and held[-1][0] != row[0]:  # anchors stay whole
                    yield solve(held)
                    held, windows = [], 0
                held.append(row)
                windows += len(row[3]) - width + 1
        if held:
            yield solve(held)

    return ranked.select("anchor", "h1", "h2", "bytes").mapInArrow(
        compared, "h1 long, h2 long, `from` long, `to` long, earlier boolean"
    )


def _slices(pieces: DataFrame, width: int) -> DataFrame:
    """Cut pieces at fixed distances from their anchors.

    Windows that begin SLICE_STEPS or fewer bytes apart share all but the ends; the hash of
    that core, with the slice's number, takes the place of the anchor. Equal windows are at
    equal distances and so in slices of one core. Slices keep the piece they are of.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            kind = [batch.column(c).to_pylist() for c in ("bytes", "start", "middle")]
            for i, (text, start, middle) in enumerate(zip(*kind)):
                distance = middle - start  # of the first window
                last = distance - (len(text) - width)  # of the last one
                for k in range(last // SLICE_STEPS, distance // SLICE_STEPS + 1):
                    begin = max(0, distance - (SLICE_STEPS * (k + 1) - 1))
                    end = min(len(text) - width, distance - SLICE_STEPS * k)
                    core = text[distance - SLICE_STEPS * k : distance - SLICE_STEPS * (k + 1) + 1 + width]
                    whole = text[begin : end + width]
                    digest = hashlib.blake2b(core, digest_size=8, salt=k.to_bytes(4, "big")).digest()
                    own = hashlib.blake2b(whole, digest_size=16).digest()
                    numbers = [int.from_bytes(h, "big", signed=True) for h in (digest, own[:8], own[8:])]
                    for column, value in zip(columns, [i, begin, *numbers, whole]):
                        column.append(value)
            rows = pa.array(columns[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(rows) for c in ("doc_id", "text_key", "start", "h1", "h2")),
                    *(pa.array(c, pa.int64()) for c in columns[1:5]), pa.array(columns[5], pa.binary()),
                ],
                names=["doc_id", "text_key", "piece_start", "p1", "p2", "skip", "anchor", "h1", "h2", "bytes"],
            )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    names = "piece_start long, p1 long, p2 long, skip long, anchor long, h1 long, h2 long, bytes binary"
    rows = pieces.select("doc_id", "text_key", "start", "middle", "h1", "h2", "bytes")
    return rows.mapInArrow(cut, f"doc_id {kind}, text_key long, {names}").withColumn("start", F.col("piece_start") + F.col("skip"))


def _by_slice(pieces: DataFrame, width: int) -> DataFrame:
    """The same for crowded anchors, slice by slice; equal slices are settled by their hashes.

    Slices that crowd one core again are settled by ``_by_window``.
    """
    slices = stored(_slices(pieces, width), "slices")
    place = F.struct("doc_id", "text_key", "start")
    alike = slices.groupBy("anchor", "h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "start", "bytes")).alias("first")
    )
    alike = stored(alike.select("anchor", "h1", "h2", "n", "first.*"), "slice-classes")
    crowds = stored(alike.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1"), "slice-crowds")
    several = stored(alike.join(crowds, "anchor"), "slice-texts")
    few = several.where(F.col("crowd") <= CROWD)
    many = several.where(F.col("crowd") > CROWD)
    found = stored(_by_suffix(few, width).unionByName(_by_window(many, width)), "slice-found")
    at_first = place == F.struct(*[F.col(f"f_{c}") for c in ("doc_id", "text_key", "start")])
    known = slices.withColumn("stop", F.octet_length("bytes")).drop("bytes").join(
        alike.select("h1", "h2", "anchor", "n", *[F.col(c).alias(f"f_{c}") for c in ("doc_id", "text_key", "start")]),
        ["anchor", "h1", "h2"],
    ).withColumn("is_first", F.coalesce(at_first, F.lit(False)))
    equal = known.where("n > 1")
    spread = [F.col("skip").alias("from"), (F.col("skip") + F.col("stop")).alias("to")]
    runs = equal.select("p1", "p2", *spread, F.lit(False).alias("earlier")).unionByName(
        equal.where("not is_first").select("p1", "p2", *spread, F.lit(True).alias("earlier"))
    )
    other = known.join(found, ["h1", "h2"]).where((F.col("earlier") & F.col("is_first")) | (~F.col("earlier") & (F.col("n") == 1)))
    runs = runs.unionByName(other.select(
        "p1", "p2", (F.col("skip") + F.col("from")).alias("from"), (F.col("skip") + F.col("to")).alias("to"), "earlier"
    ))
    # every window of a piece holds its anchor, so those found cover one run
    return runs.groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2"), "earlier").agg(
        F.min("from").alias("from"), F.max("to").alias("to")
    ).select("h1", "h2", "from", "to", "earlier")


def _by_window(pieces: DataFrame, width: int) -> DataFrame:
    """The same for crowded anchors: each window is a row of its own and equal ones combine.

    A window holds all that decides; nothing of the crowd has to be in one task.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("bytes").to_pylist()):
                raw = np.frombuffer(text, np.uint8)
                at = np.arange(len(raw) - width + 1)
                hashes = [RangeHash(raw, s)(at, at + width).view(np.int64) for s in (3, 4)]
                same = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(same) for c in ("doc_id", "text_key", "start", "h1", "h2")), pa.array(at), *map(pa.array, hashes)],
                    names=["doc_id", "text_key", "start", "h1", "h2", "at", "w1", "w2"],
                )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    rows = pieces.select("doc_id", "text_key", "start", "h1", "h2", "bytes").mapInArrow(
        spread, f"doc_id {kind}, text_key long, start long, h1 long, h2 long, at long, w1 long, w2 long"
    )
    rows = stored(rows.withColumn("place", F.struct("doc_id", "text_key", (F.col("start") + F.col("at")).alias("at"))), "windows")
    classes = rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least")).where("n > 1")
    met = rows.join(classes, ["w1", "w2"]).select("h1", "h2", "at", (F.col("place") != F.col("least")).alias("earlier"))
    # every window of a piece holds its anchor, so those found cover one run
    run = [F.min("at").alias("from"), (F.max("at") + width).alias("to")]
    anywhere = met.groupBy("h1", "h2").agg(*run).withColumn("earlier", F.lit(False))
    return anywhere.unionByName(met.where("earlier").groupBy("h1", "h2").agg(*run).withColumn("earlier", F.lit(True)))


def repeated_spans(docs: DataFrame, width: int = WIDTH, keep: str = "first") -> DataFrame:
    """Spans covered by strings of ``width`` bytes that occur more than once, by document.

    ``keep="first"`` gives every later occurrence (documents in order of id, then text hash);
    ``keep="none"`` gives all. Spans are (start, stop) in bytes, merged where they touch.
    Occurrences may overlap; none crosses a document. A null text is empty. Rows that are
    equal in id and text count as occurrences of each other under ``keep="none"``; under
    ``keep="first"`` they cannot be told apart and are treated alike.

    Pieces that occur once by anchor are settled by counts. Equal pieces are settled by their
    two hashes. Of the others one per class goes, with its bytes, to the suffix order of its
    anchor; an anchor of more than CROWD different pieces is cut finer, to slices and windows.
    """
    pieces = stored(_pieces(docs, width), "pieces")
    shared = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("anchor")
    # stored on its own: a join of two plain exchanges can split a hot anchor
    shared = stored(shared, "shared-anchors")
    pieces = stored(pieces.join(shared, "anchor", "left_semi"), "shared-pieces")
    place = F.struct("doc_id", "text_key", "start", "stop", "middle")
    classes = pieces.groupBy("anchor", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    classes = stored(classes, "classes")
    crowds = stored(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd")), "crowds")
    classes = stored(
        classes.join(crowds, "anchor").select("anchor", "h1", "h2", "n", "crowd", "first.*"), "piece-classes"
    )
    several = classes.where("crowd > 1")
    texts = stored(_texts_of(several, docs), "piece-texts")
    found = _by_suffix(texts.where(F.col("crowd") <= CROWD), width).unionByName(_by_slice(texts.where(F.col("crowd") > CROWD), width))
    found = stored(found, "found")
    own = ["doc_id", "text_key"]
    members = pieces.select("doc_id", "text_key", "start", "stop", "h1", "h2")
    # fewer than HOT_PART classes can be so large; their members are not shuffled by class
    limit = pieces.count() // HOT_PART + 1
    first = [F.col(c).alias(f"f_{c}") for c in ("doc_id", "text_key", "start")]
    named = classes.select("h1", "h2", "n", "crowd", *first)
    hot = stored(named.where(F.col("n") > limit), "hot-classes")
    large = members.join(F.broadcast(hot), ["h1", "h2"])
    small = members.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    known = small.join(named.where(F.col("n") <= limit), ["h1", "h2"]).unionByName(large)
    if keep == "none":
        full = known.where("n > 1")
        part = known.where("n = 1 and crowd > 1").join(found.where("not earlier"), ["h1", "h2"])
    else:
        is_first = F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("text_key") == F.col("f_text_key")) & (F.col("start") == F.col("f_start"))
        full = known.where(~is_first)
        part = known.where(is_first).join(found.where("earlier"), ["h1", "h2"])
    spans = full.select(*own, "start", "stop").unionByName(
        part.select(*own, (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("stop"))
    )
    grouped = spans.groupBy(*own).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("all"))
    kind = grouped.schema["doc_id"].dataType.simpleString()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans_of in batch.column("all").to_pylist():
                runs: list[list[int]] = []
                for s in spans_of:
                    if runs and s["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["stop"])
                    else:
                        runs.append([s["start"], s["stop"]])
                out.append([{"start": a, "stop": b} for a, b in runs])
            kept = pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), kept], names=[*own, "spans"])

    return grouped.mapInArrow(merged, f"doc_id {kind}, text_key long, spans array<struct<start: long, stop: long>>")


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep: str = "first") -> DataFrame:
    """``doc_id``, ``text_key``, ``n_bytes``, ``spans`` and ``kept``, the bytes that stay, of every row."""
    spans = stored(repeated_spans(docs, width, keep), "spans")
    rows = keyed(docs)
    count = spans.count()
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    none = F.array().cast("array<struct<start: long, stop: long>>")
    whole = only(rows, spans, count, anti=True).select("doc_id", "text_key", F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("spans"), raw.alias("kept"))
    touched = join_keyed(only(rows, spans, count), spans, "inner").select("doc_id", "text_key", F.octet_length(raw).cast("long").alias("n_bytes"), "spans", raw.alias("raw"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.stop"))
    stops = F.concat(F.col("spans.start"), F.array("n_bytes"))
    left = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cut = F.transform(left, lambda s: F.substring("raw", (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))
    kept = F.aggregate(cut, F.lit(b""), lambda a, b: F.concat(a, b))
    return whole.unionByName(touched.select("doc_id", "text_key", "n_bytes", "spans", kept.alias("kept")))


def digest(removed: DataFrame) -> DataFrame:
    """Counts and the hash of what stays, for every document."""
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return removed.select(
        "doc_id", "n_bytes", total.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
