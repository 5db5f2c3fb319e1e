"""Connected components of an edge table, by alternating stars.

Every round links all neighbours of a vertex to the smallest of them (large star: only the greater ones; small star: the
smaller ones and the vertex itself). The smallest vertex of each component ends as the centre of one star. The rounds
needed grow with the logarithm of the largest component. Each round is written to the shared folder, so lineage stays
short and lost executors don't matter; the two counters that tell the fixed point are observed while it is written.

Aggregates are partial before the shuffle and hold one number a vertex: no list of neighbours is ever gathered. The joins
bring the edges of a centre together with that one number; a hot centre's edges are split by adaptive skew handling.

A graph of at most ``FEW`` edges is joined by one task instead, which is the same result without rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mosaiq.session import save


#: Edges (16 bytes each) that one task may hold.
FEW = 2_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50, few: int = FEW) -> DataFrame:
    """``vertex, component``: the smallest vertex that each vertex is linked to, directly or through others.

    Ends are integers. Null ends are left out; a loop makes its vertex a component of its own; direction and repetition
    don't matter.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = both.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v"))
    e, (n, _) = _counted(e.distinct())
    if n <= few:
        return e.coalesce(1).mapInArrow(_join_all, "vertex bigint, component bigint")
    loops = e.where("u = v").select("u")
    e = e.where("u <> v")
    state = None
    for _ in range(rounds):
        e, now = _counted(_small_star(_large_star(e)))
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    stars = e.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    centres = e.select(F.col("v").alias("vertex"), F.col("v").alias("component"))
    own = loops.select(F.col("u").alias("vertex"), F.col("u").alias("component"))
    return stars.unionByName(centres).unionByName(own).groupBy("vertex").agg(F.min("component").alias("component"))


def _counted(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, their number and the sum of their hashes."""
    seen = Observation()
    kept = save(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    got = seen.get
    return kept, (got["n"], got["h"])


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of all vertices, by lowering both ends of every edge to the smaller label until nothing changes."""
    ends = [np.c_[b.column(0).to_numpy(), b.column(1).to_numpy()] for b in batches if b.num_rows]
    if not ends:
        return
    names, at = np.unique(np.concatenate(ends), return_inverse=True)
    x, y = at.reshape(-1, 2).T
    label = np.arange(len(names))
    while True:
        low, before = np.minimum(label[x], label[y]), label.copy()
        for ends_of in (x, y, before[x], before[y]):
            np.minimum.at(label, ends_of, low)
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], ["vertex", "component"])


def _large_star(e: DataFrame) -> DataFrame:
    """Greater neighbours of each vertex -> its smallest neighbour (or itself)."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # only pairs where the neighbour is greater than the centre: these are the edges turned round
    turned = e.select(F.col("v").alias("u"), F.col("u").alias("w"))
    return turned.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Smaller neighbours of each vertex, and itself -> the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    j = e.join(least, "u")
    out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
