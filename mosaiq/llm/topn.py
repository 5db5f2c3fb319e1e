"""Top N items of every group by sorted runs and a loser-tree merge.

1. Every input partition is sorted by (group, score descending, ties ascending) on the JVM, which spills, and written
   as a run: after N items of a group the writer seeks to the next group, so a run holds at most N rows of a group,
   however many there are.
2. A run is cut into buckets by the group's hash, of about ``PER_BUCKET`` rows; each bucket of a run is one block of
   columns. Runs are stored in the shared folder; blocks are shuffled by bucket.
3. In each bucket the blocks of all runs are merged through a loser tree, which reads them some rows at a time; after N
   outputs of a group every run seeks to its next group by binary search.

Defined cases: rows whose group or item is null, or whose score is null, NaN or outside the given range, are not
ranked; -0.0 equals 0.0; an item delivered several times counts once, with its best rank; null tie columns come last;
an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.session import save

#: Rows for which a bucket is made (32 bytes each, before runs leave any out), and the fewest buckets.
PER_BUCKET, BUCKETS = 500_000, 128
#: Rows of a block that are unpacked at a time in a merge.
READ = 2048
#: Rows that a run writer holds before it flushes its blocks.
FLUSH = 1_000_000
LAST = (1 << 63) - 1


class LoserTree:
    """Tournament of k sources; ``keys`` hold their current heads, None when exhausted. ``winner`` is the smallest."""

    def __init__(self, keys: list):
        self.k = k = len(keys)
        self.keys = keys
        self.loser = [-1] * max(1, k)
        up = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = up[2 * node], up[2 * node + 1]
            if self._less(b, a):
                a, b = b, a
            up[node], self.loser[node] = a, b
        self.winner = up[1] if k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or x < y)

    def replay(self) -> None:
        """After the winner's head has changed: one way up to the root."""
        keys, loser, w = self.keys, self.loser, self.winner
        node = (w + self.k) >> 1
        while node:
            other = loser[node]
            x = keys[other]
            if x is not None and (keys[w] is None or x < keys[w]):
                loser[node], w = w, other
            node >>= 1
        self.winner = w


class Run:
    """A sorted run (groups, scores, ties, items) as arrays, read from the front."""

    def __init__(self, cols: tuple[np.ndarray, ...]):
        self.cols, self.at, self.base, self.rows = cols, 0, 0, []

    def head(self) -> tuple | None:
        """(group, -score, tie, item), None at the end."""
        k = self.at - self.base
        if k >= len(self.rows):
            if self.at >= len(self.cols[0]):
                return None
            g, s, t, i = (c[self.at : self.at + READ] for c in self.cols)
            self.rows, self.base, k = [*zip(g.tolist(), (-s).tolist(), t.tolist(), i.tolist())], self.at, 0
        return self.rows[k]

    def after(self, group: int) -> None:
        """On to the next group."""
        self.at += int(np.searchsorted(self.cols[0][self.at :], group, side="right"))


def merge_top(runs: list[tuple], n: int) -> Iterator[tuple[int, float, int, int]]:
    """Multiway merge of sorted runs, each (groups, scores, ties, items) as arrays; N distinct items of each group."""
    heads = [Run(r) for r in runs if len(r[0])]
    if not heads:
        return
    tree = LoserTree([r.head() for r in heads])
    keys = tree.keys
    group, seen = None, set()
    while True:
        w = tree.winner
        head = keys[w]
        if head is None:
            return
        run = heads[w]
        if head[0] != group:
            group, seen = head[0], set()
        if len(seen) < n:
            if head[3] not in seen:
                seen.add(head[3])
                yield head[0], -head[1], head[2], head[3]
            run.at += 1
        else:
            run.after(group)
        keys[w] = run.head()
        tree.replay()


def _bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    x = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _blocks(parts: list[tuple], run: int, buckets: int) -> Iterator[pa.RecordBatch]:
    g, s, t, i = (np.concatenate(c) for c in zip(*parts))
    b = _bucket(g, buckets)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(b[order]) != 0, True])
    rows = [(b[order[x]], order[x:y]) for x, y in zip(cut[:-1], cut[1:])]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([run] * len(rows), pa.int64())]
        + [pa.array([c[r[1]].tobytes() for r in rows], pa.binary()) for c in (g, s, t, i)],
        ["bucket", "run", "g", "s", "t", "i"],
    )


def _write_runs(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    parts: list[tuple] = []
    held, run = 0, 0
    group, taken = None, []  # the group that the stream is in, and its items so far, N at most
    for batch in batches:
        g, s, t, i = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(g):
            continue
        # of an item's rows only the first in a group counts; the others are repeated deliveries
        order = np.lexsort((np.arange(len(g)), i, g))
        again = np.zeros(len(g), bool)
        again[order[1:]] = (g[order[1:]] == g[order[:-1]]) & (i[order[1:]] == i[order[:-1]])
        if g[0] == group:
            again |= (g == group) & np.isin(i, taken)
        else:
            taken = []
        lead = len(taken)
        g, s, t, i = g[~again], s[~again], t[~again], i[~again]
        if not len(g):
            continue
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
        if g[0] == group:
            rank[: start[1] if len(start) > 1 else len(g)] += lead
        keep = rank < n
        own = i[keep & (g == g[-1])].tolist()
        taken = taken + own if g[-1] == group else own
        group = g[-1]
        parts.append((g[keep], s[keep], t[keep], i[keep]))
        held += int(keep.sum())
        if held >= FLUSH:
            yield from _blocks(parts, run, buckets)
            parts, held, run = [], 0, run + 1
    if held:
        yield from _blocks(parts, run, buckets)


def top_n(
    df: DataFrame, group: str, score: str, tie: str, item: str, n: int,
    low: float = float("-inf"), high: float = float("inf"), buckets: int | None = None,
) -> DataFrame:
    """``group, item, tie, score, rank``: the ``n`` distinct items with the highest score of each group.

    Group, tie and item are integers; among equal scores the smaller tie, then the smaller item comes first.
    """
    buckets = buckets or max(BUCKETS, -(-df.count() // PER_BUCKET))
    sc = F.col(score).cast("double") + F.lit(0.0)
    rows = df.select(
        F.col(group).cast("bigint").alias("g"), sc.alias("s"),
        F.coalesce(F.col(tie).cast("bigint"), F.lit(LAST)).alias("t"), F.col(item).cast("bigint").alias("i"),
    ).where(F.expr("g is not null and i is not null and s is not null and not isnan(s)") & F.col("s").between(low, high))
    rows = rows.sortWithinPartitions("g", F.desc("s"), "t", "i")
    runs = save(rows.mapInArrow(
        lambda it: _write_runs(it, n, buckets), "bucket int, run bigint, g binary, s binary, t binary, i binary"
    ))

    def merge(table: pa.Table) -> pa.Table:
        cols = [table.column(c) for c in ("g", "s", "t", "i")]
        kinds = (np.int64, np.float64, np.int64, np.int64)
        blocks = [tuple(np.frombuffer(c[k].as_py(), kind) for c, kind in zip(cols, kinds)) for k in range(table.num_rows)]
        out = np.fromiter(merge_top(blocks, n), np.dtype([*zip("gsti", kinds)]))
        g, s, t, i = (out[c] for c in "gsti")
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
        rank = np.arange(1, len(g) + 1) - np.repeat(start, np.diff(np.r_[start, len(g)]))
        return pa.table(
            [pa.array(g, pa.int64()), pa.array(i, pa.int64()), pa.array(t, pa.int64(), mask=t == LAST),
             pa.array(s, pa.float64()), pa.array(rank, pa.int32())],
            names=["g", "i", "t", "s", "rank"],
        )

    top = runs.groupBy("bucket").applyInArrow(merge, "g bigint, i bigint, t bigint, s double, rank int")
    return top.select(
        F.col("g").alias(group), F.col("i").alias(item), F.col("t").alias(tie), F.col("s").alias(score), "rank"
    )
