"""Embeddings as blocks: cleaning, lossless packing, pivots and posting lists.

Rows that take part have an id, a model version and an embedding of ``DIM`` finite elements that are not all zero; all
others are left out. Rows of one id are one face (they are taken to be equal but for their time of delivery).

Pivots are faces of a bounded sample (``SAMPLE`` rows, chosen by a hash of the id), no two of them similar, those with
the most similar faces in the sample first. So every large group of alike faces has a pivot, and a face that is alike to
a pivot (*covered*) needs no other posting list. The sample also tells how long a posting list will be: long ones are cut
into chunks of ``CHUNK`` faces, and every pair of chunks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 128
SAMPLE = 8192
PIVOTS = 1024
#: Rows from which the pivots, and the sample with them, grow with the square root of the number of rows.
MANY_ROWS = 400_000
#: Pivots are sent along as 16-bit numbers.
MOST_PIVOTS = 32_000
#: Cosine from which two sampled faces can't both be pivots.
APART = 0.6
CHUNK = 65_536
#: Rows that a map task holds before it emits blocks.
FLUSH = 65_536
#: Cosines with the pivots or the sample that are held at once, on the driver and in a task: they don't grow with the table.
CELLS = 1 << 22
#: Pivots of a group, of which only the highest cosine is looked at first.
GROUP = 32
BLOCK_SCHEMA = "mv string, k int, i int, j int, side int, ids binary, q binary, f binary, perm binary"


@dataclass
class Pivots:
    vectors: np.ndarray  # unit length, float32
    ids: np.ndarray
    versions: np.ndarray
    rate: float  # share of all rows that the sample holds
    sample: np.ndarray
    sample_versions: np.ndarray

    @cached_property
    def codes(self) -> tuple[dict[str, int], np.ndarray]:
        """A number for each version, and the pivots' numbers."""
        names = {m: c for c, m in enumerate(dict.fromkeys(self.versions))}
        return names, np.fromiter((names[m] for m in self.versions), np.int32, len(self.versions))

    def bare(self) -> Pivots:
        """Without the sample, which only the driver needs: what is sent to the tasks."""
        return replace(self, sample=self.sample[:0], sample_versions=self.sample_versions[:0])


def blocks(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows, in each of which at most ``CELLS`` cosines with ``width`` vectors arise."""
    step = max(1, CELLS // max(1, width))
    return (slice(s, min(s + step, n)) for s in range(0, n, step))


def clean(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, versions and raw float32 vectors of the rows of (id, embedding, version) that take part."""
    emb = batch.column(1)
    n = len(emb)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, object), np.zeros((0, DIM), np.float32)
    off = emb.offsets.to_numpy()
    values = emb.values
    hole = np.asarray(values.is_null()) if values.null_count else None
    flat = values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    ok = (np.diff(off) == DIM) & np.asarray(emb.is_valid())
    ok &= np.asarray(batch.column(0).is_valid()) & np.asarray(batch.column(2).is_valid())
    rows = np.flatnonzero(ok)
    at = off[rows][:, None] + np.arange(DIM)[None, :]
    x = flat[at]
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    if hole is not None:
        good &= ~hole[at].any(axis=1)
    rows, x = rows[good], x[good]
    pick = pa.array(rows, pa.int64())
    ids = batch.column(0).take(pick).to_numpy(zero_copy_only=False)
    versions = batch.column(2).take(pick).to_numpy(zero_copy_only=False)
    return ids, versions, x


def unit(x: np.ndarray) -> np.ndarray:
    """Unit length, in double precision."""
    d = x.astype(np.float64)
    d /= np.abs(d).max(axis=1, keepdims=True)  # against overflow
    return d / np.sqrt(np.einsum("ij,ij->i", d, d))[:, None]


def unit32(x: np.ndarray) -> np.ndarray:
    """As ``unit``, in single precision; double precision is held for a block only."""
    out = np.empty(x.shape, np.float32)
    for e in blocks(len(x), 16 * DIM):
        out[e] = unit(x[e])
    return out


def pack(x: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
    """Lossless: vectors on a grid of 1/1000 as 16-bit planes, the others as float32. The order is that of the result."""
    g = np.rint(x.astype(np.float64) * 1000)
    on = (np.abs(g) < 32768).all(axis=1) & ((g / 1000).astype(np.float32) == x).all(axis=1)
    z = zstandard.ZstdCompressor(level=1)
    q = np.ascontiguousarray(g[on].astype("<i2"))
    planes = q.view(np.uint8).reshape(-1, 2).T if len(q) else np.zeros((2, 0), np.uint8)
    order = np.r_[np.flatnonzero(on), np.flatnonzero(~on)]
    return z.compress(np.ascontiguousarray(planes).tobytes()), z.compress(x[~on].astype("<f4").tobytes()), order


def unpack(q: bytes, f: bytes) -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    planes = np.frombuffer(z.decompress(q), np.uint8).reshape(2, -1)
    grid = np.ascontiguousarray(planes.T).view("<i2").reshape(-1, DIM)
    grid = (grid.astype(np.float64) / 1000).astype(np.float32)
    return np.concatenate([grid, np.frombuffer(z.decompress(f), "<f4").reshape(-1, DIM)])


def faces(df: DataFrame, ident: str = "face_id", vector: str = "embedding", version: str = "model_version") -> DataFrame:
    return df.select(
        F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("e"), F.col(version).cast("string").alias("mv")
    )


def _alike(a: np.ndarray, b: np.ndarray, ma: np.ndarray, mb: np.ndarray) -> np.ndarray:
    return (a @ b.T >= APART) & (ma[:, None] == mb[None, :])


def _apart(v: np.ndarray, mv: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the pivots in the sample: in the order of similar vectors (counted in at most 2 * SAMPLE rows of the
    sample), each that isn't similar to one taken before."""
    n = len(v)
    mv = _codes(mv)[0]
    step = max(1, n // SAMPLE)
    degree = np.zeros(n, np.int64)
    for e in blocks(n, -(-n // step)):
        degree[e] = _alike(v[e], v[::step], mv[e], mv[::step]).sum(axis=1)
    order = np.lexsort((ids, -degree))
    free = np.ones(n, bool)
    taken: list[int] = []
    for s in range(0, n, 512):
        next_ = order[s : s + 512][free[order[s : s + 512]]]
        if not len(next_):
            continue
        near = _alike(v[next_], v[next_], mv[next_], mv[next_])
        new, ok = [], np.ones(len(next_), bool)
        for k in range(len(next_)):
            if ok[k]:
                new.append(next_[k])
                ok &= ~near[k]
        taken += new
        if len(taken) >= most:
            break
        left = order[s + 512 :][free[order[s + 512 :]]]  # those before have been looked at
        for e in blocks(len(left), len(new)):
            free[left[e]] = ~_alike(v[left[e]], v[new], mv[left[e]], mv[new]).any(axis=1)
    return np.array(taken[:most], int)


def choose_pivots(rows: DataFrame, sample: int = SAMPLE, pivots: int = PIVOTS) -> Pivots:
    """Sample and pivots. Beyond ``MANY_ROWS`` rows both grow with the square root of their number, so that posting lists
    and the work for each row do, too. The sample is every id whose hash lies in a range, so about ``sample`` ids reach
    the driver at most, however often an id is delivered. Where few of them take part, the range is made wider, up to
    all ids: a table with any row that takes part has a sample."""
    total = rows.count()
    grow = max(1.0, (total / MANY_ROWS) ** 0.5)
    sample, pivots = int(sample * grow), min(int(pivots * grow), MOST_PIVOTS)
    mask = (1 << 30) - 1
    part = min(1.0, sample / max(1, total))
    h = F.xxhash64(F.col("id"), F.lit(11)).bitwiseAND(F.lit(mask))
    able = rows.where(F.col("id").isNotNull() & F.col("mv").isNotNull() & (F.size("e") == DIM))
    while True:
        table = able.where(h <= int(part * mask)).dropDuplicates(["id"]).toArrow()
        parts = [clean(b) for b in table.to_batches()]
        ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        if part >= 1 or len(ids) >= sample // 8:
            break
        part = min(1.0, 8 * part)
    mv = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, object)
    x = np.concatenate([p[2] for p in parts]) if parts else np.zeros((0, DIM), np.float32)
    del table, parts
    order = np.argsort(ids)
    ids, mv, v = ids[order], mv[order], unit32(x)[order]
    del x
    taken = _apart(v, mv, ids, pivots)
    return Pivots(v[taken], ids[taken], mv[taken], part, v, mv)


def nearest(v: np.ndarray, mv: np.ndarray, p: Pivots, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Permutation prefixes: the ``m`` nearest pivots in order, their cosines; and all cosines, -2 for other versions.
    The caller gives rows by ``blocks``, as all cosines are held."""
    d = v @ p.vectors.T
    m = min(m, d.shape[1])
    top = _highest(d, m)
    s = np.take_along_axis(d, top, axis=1)
    order = np.argsort(-s, axis=1, kind="stable")
    names, codes = p.codes
    own = d
    if len(set(mv) | set(names)) > 1:
        mine = np.fromiter((names.get(x, -1) for x in mv), np.int32, len(mv))
        own = np.where(codes[None, :] == mine[:, None], d, np.float32(-2))
    return np.take_along_axis(top, order, axis=1), np.take_along_axis(s, order, axis=1), own


def _highest(d: np.ndarray, m: int) -> np.ndarray:
    """Places of the m highest of each row. They lie in the m groups of columns whose highest are the highest."""
    n, width = d.shape
    if m >= width:
        return np.tile(np.arange(width), (n, 1))
    groups = -(-width // GROUP)
    if groups <= m:
        return np.argpartition(-d, m - 1, axis=1)[:, :m]
    high = d[:, :groups].copy()  # a group's columns lie ``groups`` apart
    for s in range(groups, width, groups):
        part = d[:, s : s + groups]
        np.maximum(high[:, : part.shape[1]], part, out=high[:, : part.shape[1]])
    pick = np.argpartition(-high, m - 1, axis=1)[:, :m]
    at = (pick[:, :, None] + groups * np.arange(GROUP)[None, None, :]).reshape(n, -1)
    some = np.where(at < width, np.take_along_axis(d, np.minimum(at, width - 1), axis=1), np.float32(-3))
    return np.take_along_axis(at, np.argpartition(-some, m - 1, axis=1)[:, :m], axis=1)


def chunk_of(ids: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    h = (ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
    return (h % chunks.astype(np.uint64)).astype(np.int32)


def emit(ids: np.ndarray, x: np.ndarray, mv: np.ndarray, row: np.ndarray, key: np.ndarray, chunks: np.ndarray, perm: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of the postings (row, key). ``chunks``: of each key. A face goes to every pair of chunks with its own."""
    codes, mvs = _codes(mv)
    c = chunk_of(ids[row], chunks[key])
    order = np.lexsort((c, key, codes[row]))
    row, key, c, code = row[order], key[order], c[order], codes[row[order]]
    if not len(row):
        return
    new = (np.diff(key) != 0) | (np.diff(c) != 0) | (np.diff(code) != 0)
    cut = np.flatnonzero(np.r_[True, new, True])
    out: list[list] = [[] for _ in range(9)]
    for a, b in zip(cut[:-1], cut[1:]):
        r = row[a:b]
        q, f, o = pack(x[r])
        blob = ids[r][o].astype("<i8").tobytes()
        places = b"" if perm is None else perm[r][o].astype("<i2").tobytes()
        own, k = int(c[a]), int(key[a])
        for other in range(int(chunks[k])):
            i, j = min(own, other), max(own, other)
            for col, val in zip(out, (mvs[code[a]], k, i, j, int(own == j), blob, q, f, places)):
                col.append(val)
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = ["mv", "k", "i", "j", "side", "ids", "q", "f", "perm"]
    for s in range(0, len(out[0]), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 2000], t) for c, t in zip(out, kinds)], names)


def _codes(mv: np.ndarray) -> tuple[np.ndarray, list[str]]:
    names = sorted(set(mv))
    at = {m: k for k, m in enumerate(names)}
    return np.fromiter((at[m] for m in mv), np.int32, len(mv)), names


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cleaned rows, some FLUSH at a time."""
    parts, n = [], 0
    for b in batches:
        parts.append(clean(b))
        n += len(parts[-1][0])
        if n >= FLUSH:
            yield tuple(np.concatenate(c) for c in zip(*parts))
            parts, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*parts))


def gather(table: pa.Table, side: int | None = None, width: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, raw vectors and permutation prefixes of a group's blocks, each id once, in the order of ids."""
    ids, xs, ps = [], [], []
    sides = table.column("side").to_pylist()
    for k in range(table.num_rows):
        if side is None or sides[k] == side:
            ids.append(np.frombuffer(table.column("ids")[k].as_py(), "<i8"))
            xs.append(unpack(table.column("q")[k].as_py(), table.column("f")[k].as_py()))
            ps.append(np.frombuffer(table.column("perm")[k].as_py(), "<i2").reshape(len(ids[-1]), width))
    if not ids:
        return np.zeros(0, np.int64), np.zeros((0, DIM), np.float32), np.zeros((0, width), np.int16)
    u, first = np.unique(np.concatenate(ids), return_index=True)
    return u, np.concatenate(xs)[first], np.concatenate(ps)[first]
