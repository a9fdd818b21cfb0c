"""Blocks of documents met by tiles of queries, without a broadcast and without the driver.

Documents and queries are packed into rows of many; a block and a tile of one tenant meet in a
join, and the task that has both keeps the ``k`` best documents for each query of the tile. What
is shuffled is the packed rows once, and ``k`` rows for each query and block, of which each task
passes on the ``k`` best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import top_n_per_group

# tiles are dealt to so many lanes, so that the blocks of one large tenant lie in as many partitions
LANES = 32

Packed = dict[str, Any]


def packed(rows: DataFrame, size: int, pack: Callable[[list], dict], schema: str) -> DataFrame:
    """``tenant`` and what ``pack`` makes of at most ``size`` rows of one tenant and partition.

    A task holds fewer than ``8 * size`` rows at a time, however many tenants it sees.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        n = 0

        def flush(tenants: list) -> pa.RecordBatch:
            made = [{"tenant": t, **pack(held.pop(t))} for t in tenants]
            return pa.RecordBatch.from_pylist(made, schema=target)

        target = None
        for batch in batches:
            if target is None:
                target = _arrow(schema, batch)
            for row in batch.to_pylist():
                own = held.setdefault(row["tenant"], [])
                own.append(row)
                n += 1
                if len(own) >= size:
                    n -= len(own)
                    yield flush([row["tenant"]])
                elif n >= 8 * size:
                    n = 0
                    yield flush(list(held))
        if held:
            yield flush(list(held))

    return rows.mapInArrow(blocks, f"tenant {rows.schema['tenant'].dataType.simpleString()}, {schema}")


def _arrow(schema: str, batch: pa.RecordBatch) -> pa.Schema:
    """The packed columns in Arrow; ``ids`` are of the type of the ``id`` that went in."""
    kinds = {"binary": pa.binary(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()),
             "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
    fields = [batch.schema.field("tenant")]
    for column in schema.split(", "):
        name, kind = column.split(" ")
        fields.append(pa.field(name, pa.list_(batch.schema.field("id").type) if name == "ids" else kinds[kind]))
    return pa.schema(fields)


def _side(column: pa.StructArray, i: int) -> Packed:
    """One packed row: its lists as Arrow arrays, without a copy."""
    fields = {f.name: column.field(f.name)[i] for f in column.type}
    return {name: v.values if isinstance(v, pa.ListScalar) else v.as_py() for name, v in fields.items()}


def best_pairs(
    blocks: DataFrame, tiles: DataFrame, k: int, score: Callable[[Packed, Packed], np.ndarray], tie_digits: int = 6
) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` best documents of each query.

    ``blocks`` and ``tiles`` are packed; ``score`` gives documents by queries, minus infinity where
    a document is not to be ranked. Scores are compared at ``tie_digits``, then by id.
    """
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    query_type = tiles.schema["ids"].dataType.elementType.simpleString()
    block_columns, tile_columns = [c for c in blocks.columns if c != "tenant"], [c for c in tiles.columns if c != "tenant"]
    left = blocks.select("tenant", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(LANES)).alias("lane"), F.struct(*block_columns).alias("block"))
    right = tiles.select("tenant", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"), F.struct(*tile_columns).alias("tile"))
    met = left.join(right.withColumn("lane", F.col("lane").cast("long")), ["tenant", "lane"]).select("block", "tile")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, tile = _side(batch.column("block"), i), _side(batch.column("tile"), i)
                scores = score(block, tile)
                ids, asked = block["ids"].to_pylist(), tile["ids"].to_pylist()
                order = sorted(range(len(ids)), key=ids.__getitem__)
                scores = scores[order]
                shown = np.round(scores, tie_digits)
                edge = np.partition(shown, -k, axis=0)[-k] if len(ids) > k else np.full(shown.shape[1], -np.inf)
                found: list[tuple[int, int]] = []
                for q in range(shown.shape[1]):
                    near = np.flatnonzero((shown[:, q] >= edge[q]) & np.isfinite(shown[:, q]))
                    found += [(q, d) for d in near[np.argsort(-shown[near, q], kind="stable")][:k]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([asked[q] for q, _ in found], batch.schema.field("tile").type.field("ids").type.value_type),
                        pa.array([ids[order[d]] for _, d in found], batch.schema.field("block").type.field("ids").type.value_type),
                        pa.array([float(scores[d, q]) for q, d in found], pa.float64()),
                    ],
                    names=["query_id", "id", "score"],
                )

    candidates = met.mapInArrow(scored, f"query_id {query_type}, id {id_type}, score double")
    order = [F.round("score", tie_digits).desc(), F.col("id")]
    return top_n_per_group(candidates, ["query_id"], k, *order).select("query_id", "rank", "id", "score")
