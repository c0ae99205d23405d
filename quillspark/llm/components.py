"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps.

Each step takes minima by a grouped aggregate (combined before the shuffle) and joins them back, so that a node with very
many edges is spread like any other skewed join key. Edges are written to the shared folder between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.base import drop_materialized, materialize


def components(edges: DataFrame, max_rounds: int = 60, one_task: int = 1_000_000) -> DataFrame:
    """edges (a, b; longs) -> (node, root): for each node with an edge to another, the smallest node it reaches.

    Up to ``one_task`` different edges (16 MB for a million), a single task finds all components; beyond, rounds do.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    size = _state(now)
    if size[0] <= one_task:
        return materialize(now.coalesce(1).mapInArrow(_in_one_task, "node long, root long"))
    for _ in range(max_rounds):
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").filter("y <> m").select(F.col("y").alias("v"), F.col("m").alias("u"))
        # Edges now lead from larger to smaller nodes; each node hands its smallest neighbour to the others.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").filter("v <> u").distinct()
        after = materialize(small)
        drop_materialized(now)
        now, before, size = after, size, _state(after)
        if before == size:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if len(b)]
    if not pairs:
        return
    names, ends = np.unique(np.concatenate(pairs, 1), return_inverse=True)
    left, right = ends.reshape(2, -1)
    label = np.arange(len(names))
    while True:
        least = label.copy()
        np.minimum.at(least, left, label[right])
        np.minimum.at(least, right, label[left])
        np.minimum.at(least, label[left], least[left])  # a root hears from all of its members
        np.minimum.at(least, label[right], least[right])
        while (least != least[least]).any():
            least = least[least]
        if (least == label).all():
            break
        label = least
    own = np.flatnonzero(label != np.arange(len(names)))
    for a in range(0, len(own), 100_000):
        part = own[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(names[label[part]])], ["node", "root"])


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets (a count and two sums of hashes)."""
    h = F.xxhash64("v", "u")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit(0xFFFFF)))).first())
