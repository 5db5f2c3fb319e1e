"""Exact similarity of many vectors: block kernels on numpy matrices, Arrow in and out.

``knn`` is a stated query set against all rows. A query set under ``QUERY_BYTES`` is shipped to every partition of the
gallery; a larger one is cut into blocks and shuffled with the gallery's blocks. ``pair_histogram`` and ``class_bests``
go over all pairs of a table in blocks and give aggregates only; no pair is emitted.

Scores are double precision dot products of the given vectors (unit vectors: cosines). Rows with a null id or vector are
left out; ties are ordered by the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which a query set is sent along with the code.
QUERY_BYTES = 64 << 20
BLOCK = 4096
#: Rows of a block where all pairs are gone over: each row is sent to as many tasks as there are blocks.
PAIRS = 16_384
#: Rows of such a block that are compared at a time.
STRIP = 256


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], a.type)
    flat = np.asarray(a.flatten(), dtype=np.float64)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 1))


NO_HITS = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _top(ids: np.ndarray, q: np.ndarray, gid: np.ndarray, g: np.ndarray, k: int, digits: int, lq: np.ndarray | None = None, lg: np.ndarray | None = None, held: tuple | None = None) -> tuple:
    """The k best of g for each row of q, not itself nor (with labels) one of its label: (place in q, id, score), in order.
    ``held``: those of rows seen before, which compete."""
    s = np.round(q @ g.T, digits)
    s[ids[:, None] == gid[None, :]] = -np.inf
    if lq is not None:
        s[lq[:, None] == lg[None, :]] = -np.inf
    n = min(k, len(gid))
    if n < len(gid):  # all that tie with the k-th are kept, so that the smaller id can win
        least = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
        r, c = np.nonzero(s >= least)
    else:
        r, c = np.nonzero(np.ones(s.shape, bool))
    ok = np.isfinite(s[r, c])
    r, c = r[ok], c[ok]
    i, v = gid[c], s[r, c]
    if held is not None:
        r, i, v = np.r_[held[0], r], np.r_[held[1], i], np.r_[held[2], v]
    order = np.lexsort((i, -v, r))
    r, i, v = r[order], i[order], v[order]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    return r[rank < k], i[rank < k], v[rank < k]


def _rows_of(ids: np.ndarray, top: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[top[0]]), pa.array(top[1]), pa.array(top[2])], schema=NO_HITS)


HITS = "qid bigint, id bigint, score double"


def knn(queries: DataFrame, gallery: DataFrame, k: int, qid: str = "qid", qv: str = "qv", gid: str = "face_id", gv: str = "vector", digits: int = 6, limit: int = QUERY_BYTES, apart: tuple[str, str] | None = None) -> DataFrame:
    """``qid, id, score, rank``: the ``k`` rows of the gallery with the highest score for each query; ids equal to the
    query's own are left out. Scores are rounded before ranking. ``apart``: labels (integers) of queries and of the gallery;
    rows of the query's label are left out, null being no label. A partition of the gallery gives ``k`` rows for each query
    at most, whatever its size."""
    lq, lg = (F.coalesce(F.col(x).cast("bigint"), F.lit(none)) for x, none in zip(apart, (-(1 << 62), -(1 << 62) - 1))) if apart else (F.lit(0), F.lit(0))
    q = queries.select(F.col(qid).cast("bigint").alias("qid"), F.col(qv).cast("array<double>").alias("v"), lq.cast("bigint").alias("l")).where("qid is not null and v is not null")
    g = gallery.select(F.col(gid).cast("bigint").alias("id"), F.col(gv).cast("array<double>").alias("v"), lg.cast("bigint").alias("l")).where("id is not null and v is not null")
    size = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    masked = apart is not None
    if size.n * size.d * 8 <= limit:
        t = q.toArrow()
        ids, m, labels = t.column("qid").to_numpy(), matrix(t.column("v")), t.column("l").to_numpy()

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}
            for b in batches:
                if b.num_rows and len(ids):
                    gm, gi, gl = matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                    for s in range(0, len(ids), BLOCK):
                        e = slice(s, s + BLOCK)
                        held[s] = _top(ids[e], m[e], gi, gm, k, digits, labels[e] if masked else None, gl, held.get(s))
            for s, top in held.items():
                yield _rows_of(ids[s : s + BLOCK], top)

        hits = g.mapInArrow(local, HITS)
    else:
        blocks = max(1, math.ceil(size.n * size.d * 8 / limit))
        parts = max(1, g.rdd.getNumPartitions())
        a = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("gb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        b = g.withColumn("gb", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

        def meet(x: pa.Table, y: pa.Table) -> pa.Table:
            if not x.num_rows or not y.num_rows:
                return NO_HITS.empty_table()
            gi, gm, gl = y.column("id").to_numpy(), matrix(y.column("v")), y.column("l").to_numpy()
            qi, qm, ql = x.column("qid").to_numpy(), matrix(x.column("v")), x.column("l").to_numpy()
            out = []
            for s in range(0, len(qi), BLOCK):
                e = slice(s, s + BLOCK)
                out.append(_rows_of(qi[e], _top(qi[e], qm[e], gi, gm, k, digits, ql[e] if masked else None, gl)))
            return pa.Table.from_batches(out)

        hits = a.groupBy("qb", "gb").cogroup(b.groupBy("qb", "gb")).applyInArrow(meet, HITS)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_within(queries: DataFrame, gallery: DataFrame, k: int, label: str, ident: str = "face_id", vector: str = "vector", digits: int = 6, block: int = BLOCK) -> DataFrame:
    """``label, qid, id, score, rank``: as ``knn``, among the rows of the gallery with the query's label. A label's rows
    are cut into blocks, and every pair of blocks is a task. Rows without a label are left out."""
    rows = lambda x: x.select(F.col(label).cast("bigint").alias("c"), F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("c is not null and id is not null and v is not null")
    blocks = lambda x, n: x.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    q, g = rows(queries), rows(gallery)
    sizes = blocks(q, "nq").join(blocks(g, "ng"), "c")
    a = q.join(sizes, "c").select("c", "id", "v", own("nq").alias("i"), every("ng").alias("j"))
    b = g.join(sizes, "c").select("c", "id", "v", own("ng").alias("j"), every("nq").alias("i"))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.schema([("c", pa.int64()), ("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]).empty_table()
        gi, gm = y.column("id").to_numpy(), matrix(y.column("v"))
        qi, qm = x.column("id").to_numpy(), matrix(x.column("v"))
        t = pa.Table.from_batches([_rows_of(qi[s : s + 1024], _top(qi[s : s + 1024], qm[s : s + 1024], gi, gm, k, digits)) for s in range(0, len(qi), 1024)])
        return t.add_column(0, "c", pa.array(np.full(t.num_rows, x.column("c")[0].as_py()), pa.int64()))

    hits = a.groupBy("c", "i", "j").cogroup(b.groupBy("c", "i", "j")).applyInArrow(meet, f"c bigint, {HITS}")
    w = Window.partitionBy("c", "qid").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("c", label)


def _block_pairs(df: DataFrame, ident: str, vector: str, label: str, block: int) -> DataFrame:
    rows = df.select(F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("bigint").alias("c"))
    rows = rows.where("id is not null and v is not null")
    n = max(1, math.ceil(rows.count() / block))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    r = rows.withColumn("own", own).select("*", other)
    return r.select("id", "v", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")


def _sides(t: pa.Table):
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    own = t.column("own").to_numpy()
    ids, m = t.column("id").to_numpy(), matrix(t.column("v"))
    c = t.column("c").to_numpy()
    a = np.flatnonzero(own == i)
    b = np.flatnonzero(own == j)
    return ids, m, c, a, b, i == j


def pair_histogram(df: DataFrame, ident: str = "face_id", vector: str = "vector", label: str = "identity", digits: int = 4, block: int = PAIRS) -> DataFrame:
    """``score, same, n``: over all pairs of rows, how often each rounded score occurs among pairs of equal and of
    different label. At most 2 * 10^digits + 1 scores each, whatever the table's size."""
    scale = 10**digits

    def count(t: pa.Table) -> pa.Table:
        ids, m, c, a, b, diag = _sides(t)
        out: dict[tuple[int, bool], int] = {}
        for s in range(0, len(a), STRIP):
            rows = a[s : s + STRIP]
            k = np.rint(m[rows] @ m[b].T * scale).astype(np.int64)
            use = ids[rows][:, None] < ids[b][None, :] if diag else np.ones(k.shape, bool)
            same = c[rows][:, None] == c[b][None, :]
            for flag in (False, True):
                u, n = np.unique(k[use & (same == flag)], return_counts=True)
                for x, y in zip(u.tolist(), n.tolist()):
                    out[(x, flag)] = out.get((x, flag), 0) + y
        keys = list(out)
        return pa.table([pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.bool_()), pa.array([out[x] for x in keys], pa.int64())], names=["k", "same", "n"])

    counted = _block_pairs(df, ident, vector, label, block).groupBy("i", "j").applyInArrow(count, "k bigint, same boolean, n bigint")
    return counted.groupBy("k", "same").agg(F.sum("n").alias("n")).select((F.col("k") / F.lit(float(scale))).alias("score"), "same", "n")


def class_bests(df: DataFrame, ident: str = "face_id", vector: str = "vector", label: str = "identity", digits: int = 6, block: int = PAIRS) -> DataFrame:
    """``id, same, other``: for each row its highest score with another row of its label and with one of another label."""

    def best(t: pa.Table) -> pa.Table:
        ids, m, c, a, b, diag = _sides(t)
        got = []
        for x, y in ((a, b),) if diag else ((a, b), (b, a)):
            for s in range(0, len(x), STRIP):
                r = x[s : s + STRIP]
                k = np.round(m[r] @ m[y].T, digits)
                same = c[r][:, None] == c[y][None, :]
                k[ids[r][:, None] == ids[y][None, :]] = np.nan
                with np.errstate(all="ignore"):
                    hi = lambda z: np.where(np.isfinite(z), z, -np.inf).max(axis=1, initial=-np.inf)
                    got.append((ids[r], hi(np.where(same, k, -np.inf)), hi(np.where(same, -np.inf, k))))
        if not got:
            return pa.schema([("id", pa.int64()), ("same", pa.float64()), ("other", pa.float64())]).empty_table()
        i, s1, o1 = (np.concatenate(z) for z in zip(*got))
        null = lambda z: pa.array(z, pa.float64(), mask=~np.isfinite(z))
        return pa.table([pa.array(i), null(s1), null(o1)], names=["id", "same", "other"])

    found = _block_pairs(df, ident, vector, label, block).groupBy("i", "j").applyInArrow(best, "id bigint, same double, other double")
    return found.groupBy("id").agg(F.max("same").alias("same"), F.max("other").alias("other"))


def vector_sums(df: DataFrame, key: str, vector: str, weight: Callable | None = None) -> DataFrame:
    """``key, sum, weight``: (weighted) sums of the vectors of each key. Summed in every batch first, so a hot key costs
    one row a batch; then per position."""
    w = weight if weight is not None else F.lit(1.0)
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v"), w.cast("double").alias("w"))
    rows = rows.where("key is not null and v is not null and w is not null")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k, m, wt = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
            u, at = np.unique(k, return_inverse=True)
            s = np.zeros((len(u), m.shape[1]))
            np.add.at(s, at, m * wt[:, None])
            n = np.bincount(at, weights=wt, minlength=len(u))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(list(s), pa.list_(pa.float64())), pa.array(n)], ["key", "s", "w"])

    part = rows.mapInArrow(partial, "key bigint, s array<double>, w double")
    at = part.select("key", "w", F.posexplode("s").alias("pos", "x")).groupBy("key", "pos").agg(F.sum("x").alias("x"), F.sum("w").alias("w"))
    # a vector's length bounds what is gathered for a key
    g = at.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("z"), F.max("w").alias("weight"))
    return g.select("key", F.transform("z", lambda e: e["x"]).alias("sum"), "weight")


def scores_to_means(df: DataFrame, ident: str, label: str, vector: str, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """``ident, label, other, score``: cosine of each row to the mean of each label, without the row itself in its own. The
    sums of the labels are cut into blocks that meet every partition's rows as matrices; no join of rows by rows."""
    rows = df.select(F.col(ident).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and c is not null and v is not null")
    sums = vector_sums(rows, "c", "v").select(F.col("key").alias("o"), "sum")
    n = max(1, math.ceil(sums.count() / block))
    parts = max(1, rows.rdd.getNumPartitions())
    a = rows.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    b = sums.withColumn("b", F.pmod(F.xxhash64("o"), F.lit(n)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def score(x: pa.Table, y: pa.Table) -> pa.Table:
        names = [ident, label, "other", "score"]
        if not x.num_rows or not y.num_rows:
            return pa.schema([*((k, pa.int64()) for k in names[:3]), ("score", pa.float64())]).empty_table()
        i, c, m = x.column("id").to_numpy(), x.column("c").to_numpy(), matrix(x.column("v"))
        o, t = y.column("o").to_numpy(), matrix(y.column("sum"))
        dot, own = m @ t.T, np.einsum("ij,ij->i", m, m)
        long = np.einsum("ij,ij->i", t, t)[None, :]
        mine = c[:, None] == o[None, :]
        # without the row itself: x(t - x), and |t - x|^2 = |t|^2 - 2tx + |x|^2
        length = np.sqrt(np.maximum(np.where(mine, long - 2 * dot + own[:, None], long), 0))
        with np.errstate(all="ignore"):
            s = np.round((dot - mine * own[:, None]) / length, digits)
        k = len(o)
        return pa.table([pa.array(i.repeat(k)), pa.array(c.repeat(k)), pa.array(np.tile(o, len(i))), pa.array(s.ravel(), mask=~np.isfinite(s.ravel()))], names=names)

    out = a.groupBy("p", "b").cogroup(b.groupBy("p", "b")).applyInArrow(score, f"{ident} bigint, {label} bigint, other bigint, score double")
    return out


def positions(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.posexplode(vector).alias("pos", "x"))


def gather_positions(at: DataFrame, value: str = "x") -> DataFrame:
    """``key, vector`` of rows (key, pos, value)."""
    g = at.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("x")))).alias("z"))
    return g.select("key", F.transform("z", lambda e: e["x"]).alias("vector"))


def label_pair_bests(df: DataFrame, ident: str = "face_id", vector: str = "vector", label: str = "person_id", digits: int = 6, block: int = PAIRS) -> DataFrame:
    """``p, q, score``: the highest score between any member of label p and any of label q, p < q."""

    def best(t: pa.Table) -> pa.Table:
        ids, m, c, a, b, diag = _sides(t)
        names = np.unique(c)
        at = np.searchsorted(names, c)
        top = np.full((len(names), len(names)), -np.inf)
        for s in range(0, len(a), STRIP):
            rows = a[s : s + STRIP]
            k = np.round(m[rows] @ m[b].T, digits)
            np.maximum.at(top, (at[rows][:, None].repeat(len(b), 1), at[b][None, :].repeat(len(rows), 0)), k)
        top = np.maximum(top, top.T)
        p, q = np.nonzero(np.triu(np.isfinite(top), 1))
        return pa.table([pa.array(names[p]), pa.array(names[q]), pa.array(top[p, q])], names=["p", "q", "score"])

    pairs = _block_pairs(df.where(F.col(label).isNotNull()), ident, vector, label, block)
    found = pairs.groupBy("i", "j").applyInArrow(best, "p bigint, q bigint, score double")
    return found.groupBy("p", "q").agg(F.max("score").alias("score"))


def residuals(df: DataFrame, key: str, vector: str, centroids: np.ndarray) -> DataFrame:
    """``key, residual``: each vector less its nearest centroid (squared distance to 9 digits, first wins). The
    centroids are a bounded input, sent along with the code."""
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(1))
                dist = np.stack([((m - c) ** 2).sum(axis=1) for c in centroids], axis=1).round(9)
                r = m - centroids[dist.argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(r), pa.list_(pa.float64()))], ["key", "residual"])

    return rows.mapInArrow(run, "key bigint, residual array<double>")
