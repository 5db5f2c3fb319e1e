"""Groups of mutually similar vectors, and what describes them.

A vector's set is its ``TOKENS`` nearest pivots (see ``vectors``); similar vectors have similar sets. MinHash banding
generates the candidates: in each of ``BANDS`` bands a vector falls into the bucket of the token with the smallest hash.
Candidates of a bucket are verified by the exact Jaccard of their sets (``JACCARD`` or more) and by what TESTDATA.md
defines as likeness, the exact cosine. Verified links go to connected components.

A pivot is a vector of the table itself. A vector whose cosine to a pivot is ``least`` or more is linked to it before
anything is shuffled; those within ``INNER`` of a pivot have that pivot as their *hub*. All vectors are banded, those with
a hub in ``INNER_BANDS`` bands. In a bucket, members of one hub are joined from the start, and tiles of members that are
joined already are not multiplied, so a hot group costs no pairs of its own. Buckets that are still long are cut into
chunks, every pair of chunks being a task; nothing is capped.

What is approximate: a pair of vectors that share no bucket in any band isn't seen. A cluster breaks only if all of its
links across the break are missed. Measured recall is in the README.

Defined cases: rows that don't take part and repeated rows as in ``vectors``; clusters of one are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm import vectors as V
from mosaiq.operators.components import components
from mosaiq.session import save, spread

TOKENS = 12
BANDS = 8
#: Jaccard of two sets from which a candidate is looked at.
JACCARD = 0.1
#: Cosine to a pivot from which the pivot is a vector's hub, and the bands of a vector with a hub.
INNER = 0.8
INNER_BANDS = 2
#: Rows of a tile: small, as only tiles on and above the diagonal are multiplied.
TILE = 512


def _permutations(pivots: int) -> np.ndarray:
    """Hash ranks of every token in every band."""
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(pivots) for _ in range(BANDS)]) if pivots else np.zeros((BANDS, 0), int)


def _buckets(top: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Bucket (band * pivots + token) of each vector in each band."""
    out = []
    for b in range(BANDS):
        pick = h[b][top].argmin(axis=1)
        out.append(b * h.shape[1] + top[np.arange(len(top)), pick])
    return np.stack(out, axis=1)


def _banded(v: np.ndarray, mv: np.ndarray, p: V.Pivots, h: np.ndarray, least: float):
    """Postings (row, bucket), what goes with each row (its tokens and its hub or -1), and links (row, pivot)."""
    top, _, own = V.nearest(v, mv, p, TOKENS)
    best = own.argmax(axis=1)
    inner = own[np.arange(len(v)), best] >= max(INNER, least)
    row, piv = np.nonzero(own >= least)
    main = piv == best[row]
    # vectors with a hub hang on it; border vectors and second pivots are graph edges
    hang = np.c_[row, piv][main & inner[row]]
    edge = np.c_[row, piv][main & ~inner[row]]
    second = np.c_[best[row], piv][~main]
    key = _buckets(top, h)
    on = ~inner[:, None] | (np.arange(BANDS) < INNER_BANDS)[None, :]
    beside = np.full((len(v), TOKENS + 1), -1, np.int16)
    beside[:, : top.shape[1]] = top
    beside[:, -1] = np.where(inner, best, -1)
    return np.nonzero(on)[0], key[on], beside, (hang, edge, second)


def _chunks(p: V.Pivots, h: np.ndarray, least: float, chunk: int) -> np.ndarray:
    n = np.zeros(max(1, h.size))
    if len(p.sample):
        by = {m: np.zeros(len(n), np.int64) for m in set(p.sample_versions)}
        for e in V.blocks(len(p.sample), len(p.vectors)):
            row, key, _, _ = _banded(p.sample[e], p.sample_versions[e], p, h, least)
            for m, count in by.items():
                count += np.bincount(key[p.sample_versions[e][row] == m], minlength=len(n))
        n = np.max(list(by.values()), axis=0)
    return np.maximum(1, np.ceil(n / max(p.rate, 1e-12) / chunk)).astype(np.int32)


def _post(batches: Iterator[pa.RecordBatch], p: V.Pivots, h: np.ndarray, chunks: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Blocks for the buckets. Links to pivots travel as blocks of their own, two for each flush: k = -1 for vectors that
    hang on a pivot, k = -2 for graph edges."""
    for ids, mv, x in V.held(batches):
        v = V.unit32(x)
        rows, keys, beside, hang, edge = [], [], [], [], []
        for e in V.blocks(len(v), len(p.vectors)):
            s = e.start
            r, k, z, (a, b, c) = _banded(v[e], mv[e], p, h, least)
            rows.append(r + s)
            keys.append(k)
            beside.append(z)
            hang.append(np.c_[ids[a[:, 0] + s], a[:, 1]])
            edge.append(np.r_[np.c_[ids[b[:, 0] + s], b[:, 1]], np.unique(np.c_[p.ids[c[:, 0]], c[:, 1]], axis=0)])
        yield from V.emit(ids, x, mv, np.concatenate(rows), np.concatenate(keys), chunks, np.concatenate(beside))
        yield from _link_block(np.concatenate(hang), -1, int(ids[0] % (1 << 31)))
        yield from _link_block(np.concatenate(edge), -2, int(ids[0] % (1 << 31)))


def _link_block(link: np.ndarray, kind: int, name: int) -> Iterator[pa.RecordBatch]:
    """A block of links (id, pivot); its name only keeps blocks of several tasks apart."""
    if len(link):
        ints = [pa.array([c], pa.int32()) for c in (kind, name, 0, 0)]
        blobs = [pa.array([c], pa.binary()) for c in (link[:, 0].astype("<i8").tobytes(), b"", b"", link[:, 1].astype("<i4").tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([""]), *ints, *blobs], ["mv", "k", "i", "j", "side", "ids", "q", "f", "perm"])


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard of the sets in each row of a and b; -1 stands for no token."""
    out = np.empty(len(a))
    for s in range(0, len(a), 1 << 14):
        x, y = a[s : s + (1 << 14)], b[s : s + (1 << 14)]
        both = ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).sum(axis=(1, 2))
        out[s : s + (1 << 14)] = both / np.maximum(1, (x >= 0).sum(axis=1) + (y >= 0).sum(axis=1) - both)
    return out


def link_block(a: np.ndarray, b: np.ndarray, label_a: np.ndarray, label_b: np.ndarray, ta: np.ndarray, tb: np.ndarray, least: float, same: bool) -> None:
    """Union by Jaccard of the sets ta and tb and by cosine: labels (places of the smallest member) of the rows of a and b
    are lowered in place. Rows of one label should be neighbours: tiles of one label only are passed over."""
    fa, fb = V.unit32(a), V.unit32(b) if not same else None
    fb = fa if same else fb
    for s in range(0, len(a), TILE):
        for t in range(s if same else 0, len(b), TILE):
            la, lb = label_a[s : s + TILE], label_b[t : t + TILE]
            if la.min() == la.max() == lb.min() == lb.max():
                continue
            c = fa[s : s + TILE] @ fb[t : t + TILE].T
            hit = c >= least - 1e-5
            n = np.count_nonzero(hit)
            if not n:
                continue
            if n > hit.size // 16:  # what is joined already needn't be listed
                hit &= la[:, None] != lb[None, :]
            r, q = np.nonzero(hit)
            new = la[r] != lb[q]
            r, q = r[new], q[new]
            if len(r):
                alike = jaccard(ta[s + r], tb[t + q]) >= JACCARD
                r, q = r[alike], q[alike]
            if not len(r):
                continue
            near = np.flatnonzero(c[r, q] < least + 1e-5)
            if len(near):  # too close for single precision
                exact = np.einsum("ij,ij->i", V.unit(a[s + r[near]]), V.unit(b[t + q[near]]))
                ok = np.ones(len(r), bool)
                ok[near] = exact >= least
                r, q = r[ok], q[ok]
            _union(label_a, label_b, label_a[s + r], label_b[t + q])


def _union(label_a: np.ndarray, label_b: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the labels x[k] and y[k]; both arrays then show the smallest label of their set."""
    names, at = np.unique(np.r_[x, y], return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    root = np.arange(len(names))
    while True:
        m = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, x, m)
        np.minimum.at(root, y, m)
        np.minimum.at(root, before[x], m)
        np.minimum.at(root, before[y], m)
        root = root[root]
        if (root == before).all():
            break
    for lab in (label_a, label_b) if label_b is not label_a else (label_a,):
        k = np.searchsorted(names, lab)
        k[k == len(names)] = 0
        on = names[k] == lab
        lab[on] = names[root[k[on]]]


EDGES = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _side(table: pa.Table, side: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors, tokens and hubs of a group's blocks, in the order of hubs."""
    ids, x, beside = V.gather(table, side, TOKENS + 1)
    order = np.argsort(beside[:, -1], kind="stable")
    return ids[order], x[order], beside[order, :-1], beside[order, -1]


def _verify(table: pa.Table, p_ids: np.ndarray, least: float) -> pa.Table:
    k, i, j = (table.column(c)[0].as_py() for c in "kij")
    if k < 0:
        ids = np.concatenate([np.frombuffer(b.as_py(), "<i8") for b in table.column("ids")])
        piv = np.concatenate([np.frombuffer(b.as_py(), "<i4") for b in table.column("perm")])
        kind = np.full(len(ids), 0 if k == -1 else 1, np.int32)
        return pa.table([pa.array(kind), pa.array(ids), pa.array(p_ids[piv])], schema=EDGES)
    sides = [_side(table)] if i == j else [_side(table, 0), _side(table, 1)]
    ids, hub = (np.concatenate([s[c] for s in sides]) for c in (0, 3))
    # members of one hub are joined already: its first member stands for them
    start = np.arange(len(ids))
    _, first, at = np.unique(hub, return_index=True, return_inverse=True)
    start = np.where(hub >= 0, first[at], start)
    label = start.copy()
    if len(ids) > 1 and all(len(s[0]) for s in sides):
        (_, xa, ta, _), (_, xb, tb, _) = sides[0], sides[-1]
        if len(sides) == 1:
            link_block(xa, xa, label, label, ta, ta, least, True)
        else:
            link_block(xa, xb, label[: len(xa)], label[len(xa) :], ta, tb, least, False)
    on = np.flatnonzero(label != start)
    ends = np.unique(np.c_[ids[start[on]], ids[label[on]]], axis=0)
    return pa.table([pa.array(np.ones(len(ends), np.int32)), pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=EDGES)


def clusters(df: DataFrame, least: float = 0.75, chunk: int = V.CHUNK, sample: int = V.SAMPLE, pivots: int = V.PIVOTS) -> DataFrame:
    """``cluster_id, face_id``: all faces linked by likeness, directly or through others; the smallest face names them."""
    rows = V.faces(df)
    p = V.choose_pivots(rows, sample, pivots)
    if not len(p.vectors):
        return df.sparkSession.createDataFrame([], "cluster_id bigint, face_id bigint")
    h = _permutations(len(p.vectors))
    chunks = _chunks(p, h, least, chunk)
    p, p_ids = p.bare(), p.ids
    posts = spread(rows).mapInArrow(lambda it: _post(it, p, h, chunks, least), V.BLOCK_SCHEMA)
    links = save(posts.groupBy("mv", "k", "i", "j").applyInArrow(lambda t: _verify(t, p_ids, least), "kind int, a bigint, b bigint"))
    # faces that hang on pivots need no rounds: a pivot stands for them, by the smallest one linked to it
    star = links.where("kind = 0 and a <> b")
    hub = star.groupBy("b").agg(F.min("a").alias("a"))
    graph = links.where("kind = 1").select("a", "b").unionByName(hub.select("a", "b"))
    comp = save(components(graph))
    hubs = comp.join(F.broadcast(hub.select(F.col("b").alias("vertex"))), "vertex")  # at most ``pivots`` rows
    hung = star.join(F.broadcast(hubs), star.b == hubs.vertex).select(F.col("component"), F.col("a").alias("vertex"))
    every = hung.unionByName(comp.select("component", "vertex")).groupBy("vertex").agg(F.min("component").alias("component"))
    return every.select(F.col("component").alias("cluster_id"), F.col("vertex").alias("face_id"))
