"""The k most similar vectors of every vector, by a permutation index.

Every vector is represented by its nearest pivots in order (``PREFIX`` of them). It is posted in the inverted files of
its first ``POSTINGS`` pivots. A vector alike to pivots (cosine ``least`` or more) is posted to all of those, and to its
first ``POSTINGS`` only if none of its cosines is ``least + EDGE`` or more. Within a posting list, vectors are sorted by
permutation and cut into tiles; for every tile the others are visited in the order of their footrule distance, so the
k-th best cosine found so far is high from early on and little of the farther tiles is left. Single precision only
excludes; what is within its error of the k-th best is ranked by the exact cosine, rounded, and the id, however many are
alike. Lists too long for one task are cut into chunks, and every pair of chunks is a task (see ``vectors``); nothing is
capped or dropped.

What is approximate: two alike vectors without a common list don't meet. That is so for two that are not alike to a pivot
and share none of their first ``POSTINGS``, and also for one well inside a pivot's group (``least + EDGE``) and another
that has none of the first one's pivots among its own. Measured recall is in the README.

Defined cases: see ``vectors`` for rows that don't take part; repeated rows count once; ties are ordered by the smaller
id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm import vectors as V
from mosaiq.session import spread

PREFIX = 8
POSTINGS = 4
TILE = 2048
#: Cosines above ``least`` in which a vector alike to a pivot is posted as if it weren't, too.
EDGE = 0.05
#: What a cosine of 128 elements in single precision may be off the exact one, rounded to 6 decimals.
ERROR = 1e-5
#: Candidates of a row in a tile from which they are compared as a matrix.
MANY = 64
NOBODY = np.iinfo(np.int64).max


def _lists(v: np.ndarray, mv: np.ndarray, p: V.Pivots, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings (row, pivot) and the permutation prefixes."""
    top, _, own = V.nearest(v, mv, p, PREFIX)
    best = own.max(axis=1)
    wide = min(POSTINGS, top.shape[1])
    loose = np.flatnonzero(best < least + EDGE)
    r, q = np.nonzero(own >= least)
    both = np.unique(np.r_[r * own.shape[1] + q, (loose[:, None] * own.shape[1] + top[loose, :wide]).ravel()])
    row, key = np.divmod(both, own.shape[1])
    perm = np.full((len(v), PREFIX), -1, np.int16)
    perm[:, : top.shape[1]] = top
    return row, key, perm


def chunks_of_lists(p: V.Pivots, least: float, chunk: int) -> np.ndarray:
    """Number of chunks of each posting list, from its length in the sample."""
    n = np.zeros(max(1, len(p.vectors)))
    if len(p.sample):
        by = {m: np.zeros(len(n), np.int64) for m in set(p.sample_versions)}
        for e in V.blocks(len(p.sample), len(p.vectors)):
            row, key, _ = _lists(p.sample[e], p.sample_versions[e], p, least)
            for m, count in by.items():
                count += np.bincount(key[p.sample_versions[e][row] == m], minlength=len(n))
        n = np.max(list(by.values()), axis=0)
    return np.maximum(1, np.ceil(n / max(p.rate, 1e-12) / chunk)).astype(np.int32)


def _post(batches: Iterator[pa.RecordBatch], p: V.Pivots, chunks: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    for ids, mv, x in V.held(batches):
        v = V.unit32(x)
        cut = list(V.blocks(len(v), len(p.vectors)))
        parts = [_lists(v[e], mv[e], p, least) for e in cut]
        row = np.concatenate([r + e.start for e, (r, _, _) in zip(cut, parts)])
        key, perm = (np.concatenate([q[c] for q in parts]) for c in (1, 2))
        yield from V.emit(ids, x, mv, row, key, chunks, perm)


def _profiles(perm: np.ndarray, tiles: list[slice]) -> np.ndarray:
    """Mean place weights of each tile: PREFIX for the nearest pivot, 0 for one outside the prefix."""
    names, at = np.unique(perm, return_inverse=True)
    at = at.reshape(perm.shape)
    out = np.zeros((len(tiles), len(names)), np.float32)
    for t, s in enumerate(tiles):
        for place in range(perm.shape[1]):
            np.add.at(out[t], at[s, place], PREFIX - place)
        out[t] /= max(1, s.stop - s.start)
    out[:, names < 0] = 0
    return out


def _unit32(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length in single precision, and the norms in double precision."""
    n = np.empty(len(x))
    for s in range(0, len(x), 1 << 14):
        d = x[s : s + (1 << 14)].astype(np.float64)
        n[s : s + (1 << 14)] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return (x / n[:, None]).astype(np.float32) if len(x) < TILE else np.concatenate([(x[s : s + TILE] / n[s : s + TILE, None]).astype(np.float32) for s in range(0, len(x), TILE)]), n


def nearest_in(a: np.ndarray, b: np.ndarray, ida: np.ndarray, idb: np.ndarray, pa_: np.ndarray, pb: np.ndarray, k: int, least: float):
    """Both ways between the raw vectors ``a`` and ``b``, or within ``a`` if they are the same: ids of the rows of a and
    of their neighbours in b, and the other way round, with cosines rounded to 6 decimals. Every pair of tiles is
    multiplied once."""
    own = a is b
    x = _Side(a, ida, k, least)
    y = x if own else _Side(b, idb, k, least)
    ranked = len(x.tiles) > 1 or len(y.tiles) > 1
    if ranked:
        every = _profiles(np.r_[pa_, pb], x.tiles + [slice(s.start + len(a), s.stop + len(a)) for s in y.tiles])
        wa, wb = every[: len(x.tiles)], every[len(x.tiles) :]
    for ta, sa in enumerate(x.tiles):
        for tb in np.argsort(np.abs(wa[ta] - wb).sum(axis=1), kind="stable") if ranked else range(len(y.tiles)):
            if own and tb < ta:
                continue
            sb = y.tiles[tb]
            s = x.unit[sa] @ y.unit[sb].T
            if own and tb == ta:
                np.fill_diagonal(s, -2)
            _merge(s, x, sa, y, sb, k, least)
            if not own or tb != ta:
                _merge(np.ascontiguousarray(s.T), y, sb, x, sa, k, least)
    return [x.found()] if own else [x.found(), y.found()]


class _Side:
    """Raw vectors with their ids, and the k best of each row so far: exact cosines and ids, in order."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int, least: float) -> None:
        self.raw, self.ids = x, ids
        self.unit, self.norm = _unit32(x)
        self.tiles = [slice(s, min(s + TILE, len(x))) for s in range(0, len(x), TILE)]
        self.best = np.full((len(x), k), least - 1e-5)
        self.who = np.full((len(x), k), NOBODY)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(self.who != NOBODY)
        return self.ids[row], self.who[row, place], self.best[row, place]


def _exact(x: _Side, row: np.ndarray, y: _Side, col: np.ndarray) -> np.ndarray:
    out = np.empty(len(row))
    for s in range(0, len(row), 1 << 14):
        e = slice(s, s + (1 << 14))
        out[e] = np.einsum("ij,ij->i", x.raw[row[e]].astype(np.float64), y.raw[col[e]].astype(np.float64))
    return np.round(out / (x.norm[row] * y.norm[col]), 6)


def _merge(s: np.ndarray, x: _Side, sx: slice, y: _Side, sy: slice, k: int, least: float) -> None:
    """Put the cosines of a tile into the best so far of x, in place. Single precision only leaves out what can't be
    among the k best by a margin of ``ERROR``; all others are ranked by the exact cosine and the id."""
    last, top = x.best[sx, -1], x.who[sx, -1]
    hit = s >= (last - ERROR).astype(np.float32)[:, None]
    full = np.flatnonzero(last >= 1)  # no cosine is higher: only smaller ids count
    if len(full):
        hit[full] &= y.ids[sy][None, :] < top[full, None]
    n = hit.sum(axis=1)
    many = np.flatnonzero(n > MANY)
    if len(many):
        z = np.where(hit[many], s[many], np.float32(-2))
        kth = min(k, z.shape[1] - 1)
        hit[many] &= z >= -np.partition(-z, kth, axis=1)[:, kth : kth + 1] - np.float32(2 * ERROR)
        n[many] = hit[many].sum(axis=1)
    tied = np.flatnonzero(n > MANY)  # too many alike for single precision: all of the tile in double precision
    if len(tied):
        hit[tied] = False
        _place(*_ranked(tied + sx.start, x, y, sy, k), x, k, least)
    r, c = np.nonzero(hit)
    if len(r):
        order = np.lexsort((-s[r, c], r))
        r, c = r[order], c[order]
        v = s[r, c]
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        length = np.diff(np.r_[start, len(r)])
        kth = v[np.minimum(start + k, start + length - 1)]  # one more than k, as a row may meet its own id
        ok = v >= np.repeat(np.where(length > k, kth, -2), length) - np.float32(2 * ERROR)
        r, c = r[ok] + sx.start, c[ok] + sy.start
        ok = x.ids[r] != y.ids[c]
        r, c = r[ok], c[ok]
        _place(r, y.ids[c], _exact(x, r, y, c), x, k, least)


def _ranked(rows: np.ndarray, x: _Side, y: _Side, sy: slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of x its k best in a tile of y, by cosine and smaller id: (row, id, cosine)."""
    by_id = np.argsort(y.ids[sy]) + sy.start
    b = (y.raw[by_id].astype(np.float64) / y.norm[by_id, None]).T
    k = min(k, len(by_id))
    out = []
    for s in range(0, len(rows), 512):
        r = rows[s : s + 512]
        key = np.rint((x.raw[r].astype(np.float64) / x.norm[r, None]) @ b * 1e6)
        key[x.ids[r][:, None] == y.ids[by_id][None, :]] = -2e6
        key = key * TILE - np.arange(len(by_id))  # whole numbers, all different in a row
        out.append(by_id[np.argpartition(-key, k - 1, axis=1)[:, :k]])
    row, col = rows.repeat(k), np.concatenate(out).ravel()
    ok = x.ids[row] != y.ids[col]
    row, col = row[ok], col[ok]
    return row, y.ids[col], _exact(x, row, y, col)


def _place(r: np.ndarray, ids: np.ndarray, val: np.ndarray, x: _Side, k: int, least: float) -> None:
    ok = val >= least
    r, ids, val = r[ok], ids[ok], val[ok]
    rows = np.unique(r)
    allr = np.r_[rows.repeat(k), r]
    allv = np.r_[x.best[rows].ravel(), val]
    alli = np.r_[x.who[rows].ravel(), ids]
    order = np.lexsort((alli, -allv, allr))
    allr, allv, alli = allr[order], allv[order], alli[order]
    start = np.flatnonzero(np.r_[True, allr[1:] != allr[:-1]]) if len(allr) else np.zeros(0, int)
    rank = np.arange(len(allr)) - np.repeat(start, np.diff(np.r_[start, len(allr)]))
    top = rank < k
    x.best[allr[top], rank[top]] = allv[top]
    x.who[allr[top], rank[top]] = alli[top]


def _search(table: pa.Table, k: int, least: float) -> pa.Table:
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()

    def sorted_side(side):
        ids, x, perm = V.gather(table, side, PREFIX)
        if len(ids) > TILE:
            order = np.lexsort(perm[:, 3::-1].T)
            ids, x, perm = ids[order], x[order], perm[order]
        return ids, x, perm

    if i == j:
        x = y = sorted_side(None)
    else:
        x, y = sorted_side(0), sorted_side(1)
    out_id, out_nb, out_c = [], [], []
    if len(x[0]) and len(y[0]) and (x is not y or len(x[0]) > 1):
        for ident, near, cos in nearest_in(x[1], y[1], x[0], y[0], x[2], y[2], k, least):
            out_id.append(ident)
            out_nb.append(near)
            out_c.append(np.rint(cos * 1e6).astype(np.int32))
    if not out_id or not sum(map(len, out_id)):
        return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], NEAR)})
    ident, nb, c = (np.concatenate(z) for z in (out_id, out_nb, out_c))
    order = np.lexsort((nb, -c, ident))
    ident, nb, c = ident[order], nb[order], c[order]
    cut = np.flatnonzero(np.r_[True, ident[1:] != ident[:-1], True]).astype(np.int32)
    near = pa.ListArray.from_arrays(
        pa.array(cut), pa.StructArray.from_arrays([pa.array(-c, pa.int32()), pa.array(nb, pa.int64())], names=["c", "n"])
    )
    return pa.table({"id": pa.array(ident[cut[:-1]]), "near": near.cast(NEAR)})


NEAR = pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64())]))


def neighbours(df: DataFrame, k: int = 5, least: float = 0.75, chunk: int = V.CHUNK, sample: int = V.SAMPLE, pivots: int = V.PIVOTS) -> DataFrame:
    """``face_id, rank, neighbour, cosine``: the ``k`` other faces of the same version with the highest cosine (rounded
    to 6 decimals), among those with ``least`` or more."""
    rows = V.faces(df)
    p = V.choose_pivots(rows, sample, pivots)
    if not len(p.vectors):
        return df.sparkSession.createDataFrame([], "face_id bigint, rank int, neighbour bigint, cosine double")
    chunks = chunks_of_lists(p, least, chunk)
    p = p.bare()
    posts = spread(rows).mapInArrow(lambda it: _post(it, p, chunks, least), V.BLOCK_SCHEMA)
    found = posts.groupBy("mv", "k", "i", "j").applyInArrow(
        lambda t: _search(t, k, least), "id bigint, near array<struct<c:int,n:bigint>>"
    )
    # of each face as many lists as it has postings and chunk pairs, of k each
    best = found.groupBy("id").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near")
    )
    return best.select(F.col("id").alias("face_id"), F.posexplode("near").alias("pos", "x")).select(
        "face_id", (F.col("pos") + 1).alias("rank"), F.col("x.n").alias("neighbour"), (-F.col("x.c") / 1e6).alias("cosine")
    )


def pairs(found: DataFrame) -> DataFrame:
    """``face_a, face_b``: pairs of which at least one is a neighbour of the other, face_a < face_b."""
    a, b = F.least("face_id", "neighbour").alias("face_a"), F.greatest("face_id", "neighbour").alias("face_b")
    return found.select(a, b).distinct()
