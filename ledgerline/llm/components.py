"""Connected components: in one task as long as the links are few, else by alternating large-star and small-star rounds.

Up to FEW links (16 bytes each) one task finds all components by minimum labels and pointer jumping. Beyond it no neighbourhood is ever gathered: each round takes the minimum neighbour of a node (a partial
aggregate) and joins it back. That join is skewed on hubs, so the minima are materialised first;
both of its inputs are then plain shuffles, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut_in_loop


#: Links that one task takes: 16 MB.
FEW = 1 << 20


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes in order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = np.split(at, 2)
    least = np.arange(len(nodes))
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least != least[least]).any():
            least = least[least]
        if (least == before).all():
            return nodes, nodes[least]


def _in_one_task(links: DataFrame) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            yield from pa.Table.from_arrays([pa.array(x) for x in labels(*(np.concatenate(x) for x in zip(*held)))], schema=schema).to_batches(1 << 16)

    return links.coalesce(1).mapInArrow(run, "node long, root long")


def _minima(pairs: DataFrame) -> DataFrame:
    return cut_in_loop(pairs.groupBy("u").agg(F.min("v").alias("m")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)``: every node of an edge with the smallest node reachable.

    Self-loops, repeated and mirrored edges and nulls are ignored; no edges give no rows.
    """
    links = cut_in_loop(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    if links.count() <= FEW:
        return _in_one_task(links)
    seen = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minima(both).withColumn("m", F.least("u", "m"))
        large = cut_in_loop(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = _minima(large)
        near = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_in_loop(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
