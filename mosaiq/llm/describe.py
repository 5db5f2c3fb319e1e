"""Groups of similar vectors described: loose clusters split around medoids, sizes, typical members, persons.

A cluster is loose if the mean cosine of its pairs is under ``tight``. It is split around its highest-degree members: the
degree is the number of members whose cosine is ``least`` or more; in the order of degree, a member that isn't taken yet
becomes a medoid and takes all free members that it is linked to. Typical members are those with the highest mean cosine
to all members, which needs the sum of the vectors only, no pairs.

Clusters of more than ``PART`` members are spread over several tasks; their sums, at most one for each ``PART`` rows of
the table, go back to the driver between two passes. Loose ones among them are split all the same: degrees are counted in
pairs of chunks of ``PART`` members; then, in rounds, the first ``ROUND`` free members in the order of degree go to the
driver, those that become medoids are sent to all chunks, and each chunk's free members go to the first medoid that they
are linked to. When the free members of a cluster fit one task, they are split there. ``AT_ONCE`` clusters go through the
rounds together, which bounds what reaches the driver. A round settles ``ROUND`` members of a cluster at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions import vectors as C
from mosaiq.llm import vectors as V
from mosaiq.operators.similarity import vector_sums
from mosaiq.session import save

PART = 50_000
ROUND = 1000
AT_ONCE = 16
TYPICAL = 3
GROUP = "cluster_id bigint, face_id bigint, group_id bigint, size bigint, mean_cosine double, loose boolean, centrality double"
TILE = 2048


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which unit vectors of a and b have a cosine of ``least`` or more; double precision decides close ones."""
    c = a @ b.T
    hit = c >= least
    r, q = np.nonzero(np.abs(c - least) < 1e-5)
    for s in range(0, len(r), 1 << 14):
        e = slice(s, s + (1 << 14))
        hit[r[e], q[e]] = np.einsum("ij,ij->i", a[r[e]].astype(np.float64), b[q[e]].astype(np.float64)) >= least
    return hit


def degrees(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of a with b, and of each row of b with a."""
    n, m = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    for s in range(0, len(a), TILE):
        for t in range(0, len(b), TILE):
            hit = linked(a[s : s + TILE], b[t : t + TILE], least)
            n[s : s + TILE] += hit.sum(axis=1)
            m[t : t + TILE] += hit.sum(axis=0)
    return n, m


def split(x: np.ndarray, ids: np.ndarray, least: float, degree: np.ndarray | None = None) -> np.ndarray:
    """Medoid (its place) of every row of the unit vectors ``x``."""
    n = len(x)
    if degree is None:
        degree = degrees(x, x, least)[0]
    medoid = np.full(n, -1)
    for k in np.lexsort((ids, -degree)):
        if medoid[k] < 0:
            near = linked(x, x[k : k + 1], least)[:, 0] & (medoid < 0)
            near[k] = True
            medoid[near] = k
    return medoid


def _groups(cid: int, ids: np.ndarray, x: np.ndarray, least: float, tight: float) -> list[tuple]:
    total = x.sum(axis=0)
    n = len(x)
    mean = (total @ total - n) / (n * (n - 1)) if n > 1 else 1.0
    if mean >= tight:
        c = (x @ total - 1) / max(1, n - 1)
        return [(cid, int(i), cid, n, float(mean), False, float(v)) for i, v in zip(ids, c)]
    medoid = split(x, ids, least)
    out = []
    for k in np.unique(medoid):
        own = np.flatnonzero(medoid == k)
        t = x[own].sum(axis=0)
        m = len(own)
        inner = (t @ t - m) / (m * (m - 1)) if m > 1 else 1.0
        c = (x[own] @ t - 1) / max(1, m - 1)
        out += [(cid, int(ids[i]), int(ids[own].min()), m, float(inner), True, float(v)) for i, v in zip(own, c)]
    return out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 7
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["cluster_id", "face_id", "group_id", "size", "mean_cosine", "loose", "centrality"])


def _unit_rows(batches: Iterator[pa.RecordBatch]):
    """Cluster, ids and unit vectors of batches (cluster_id, id, e, mv), each id once."""
    cs, ids, xs = [], [], []
    for b in batches:
        i, _, x = V.clean(pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3)], ["id", "e", "mv"]))
        if len(i):
            at = {v: k for k, v in enumerate(b.column(1).to_pylist())}
            cl = b.column(0).to_numpy(zero_copy_only=False)
            cs.append(cl[[at[v] for v in i.tolist()]])
            ids.append(i)
            xs.append(V.unit(x).astype(np.float32))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, V.DIM), np.float32)
    i, first = np.unique(np.concatenate(ids), return_index=True)
    c, x = np.concatenate(cs)[first], np.concatenate(xs)[first]
    order = np.argsort(c, kind="stable")
    return c[order], i[order], x[order]


def _spans(c: np.ndarray):
    cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True]) if len(c) else np.zeros(0, int)
    return zip(cut[:-1], cut[1:])


FREE = "c bigint, id bigint, e array<float>, degree bigint, medoid bigint"


def _free(c: int, ids: np.ndarray, x: np.ndarray, degree: np.ndarray, medoid: np.ndarray) -> pa.RecordBatch:
    """Members with the id of their medoid, -1 for none yet."""
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.int64(), pa.int64())
    cols = [np.full(len(ids), c), ids, list(x.astype(np.float32)), degree, pa.array(medoid, pa.int64(), mask=medoid < 0)]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], ["c", "id", "e", "degree", "medoid"])


def _matrix(e: pa.Array | pa.ChunkedArray) -> np.ndarray:
    e = e.combine_chunks() if isinstance(e, pa.ChunkedArray) else e
    return e.flatten().to_numpy(zero_copy_only=False).reshape(len(e), -1)


def _members(batches: Iterator[pa.RecordBatch]):
    """Cluster, ids, unit vectors and degrees of each cluster in each batch of FREE."""
    for b in batches:
        if b.num_rows:
            c, ids, d = (b.column(k).to_numpy() for k in (0, 1, 3))
            order = np.argsort(c, kind="stable")
            x = _matrix(b.column(2))[order]
            for s, t in _spans(c[order]):
                yield int(c[order[s]]), ids[order[s:t]], x[s:t], d[order[s:t]]


def _with_degrees(members: DataFrame, chunks: dict[int, int], least: float) -> DataFrame:
    """Unit vectors of (cluster_id, id, e, mv) with their degrees, as FREE."""

    def posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, i, x = _unit_rows(batches)
        for s, t in _spans(c):
            m = chunks[int(c[s])]
            own = V.chunk_of(i[s:t], np.full(t - s, m))
            for u in range(0, t - s, TILE):
                r = slice(u, min(u + TILE, t - s))
                n = r.stop - r.start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, c[s])), pa.array(i[s:t][r]), pa.array(list(x[s:t][r]), pa.list_(pa.float32())), pa.array(own[r], pa.int32()), pa.array(np.full(n, m), pa.int32())],
                    ["c", "id", "e", "own", "m"],
                )

    unit = save(members.mapInArrow(posts, "c bigint, id bigint, e array<float>, own int, m int"))

    def count(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        own, ids, x = t.column("own").to_numpy(), t.column("id").to_numpy(), _matrix(t.column("e"))
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        n, m = degrees(x[a], x[b], least)
        if i == j:
            return pa.table([pa.array(ids[a]), pa.array(n)], names=["id", "n"])
        return pa.table([pa.array(np.r_[ids[a], ids[b]]), pa.array(np.r_[n, m])], names=["id", "n"])

    pairs = unit.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    pairs = pairs.select("c", "id", "e", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    degree = pairs.groupBy("c", "i", "j").applyInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("degree"))
    return save(unit.join(degree, "id").select("c", "id", "e", "degree", F.lit(None).cast("bigint").alias("medoid")))


def _taken(free: DataFrame, least: float, part: int, step: int) -> DataFrame:
    """All members of FREE with their medoids."""
    done = []
    while True:
        left = {r.c: r.n for r in free.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        large = [c for c, n in left.items() if n > part]
        small = free.where(~F.col("c").isin(large)) if large else free

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [*_members(batches)]
            for c in sorted({g[0] for g in got}):
                ids, x, d = (np.concatenate(z) for z in zip(*[g[1:] for g in got if g[0] == c]))
                yield _free(c, ids, x, d, ids[split(x, ids, least, d)])

        done.append(small.repartition("c").mapInArrow(rest, FREE))
        if not large:
            break
        free = free.where(F.col("c").isin(large))
        w = Window.partitionBy("c").orderBy(F.desc("degree"), "id")
        head = free.withColumn("k", F.row_number().over(w)).where(F.col("k") <= step).drop("k").toArrow()
        medoids = {}
        for c, ids, x, d in _members(iter([head.combine_chunks().to_batches()[0]])):
            order = np.lexsort((ids, -d))
            ids, x = ids[order], x[order]
            first = np.unique(split(x, ids, least, d[order]))
            medoids[c] = ids[first], x[first]

        def take(batches: Iterator[pa.RecordBatch], medoids=medoids) -> Iterator[pa.RecordBatch]:
            for c, ids, x, d in _members(batches):
                mid, mx = medoids[c]
                got = np.full(len(ids), -1)
                for s in range(0, len(ids), TILE):
                    hit = linked(x[s : s + TILE], mx, least) | (ids[s : s + TILE, None] == mid[None, :])
                    got[s : s + TILE] = np.where(hit.any(axis=1), mid[hit.argmax(axis=1)], -1)
                yield _free(c, ids, x, d, got)

        now = save(free.mapInArrow(take, FREE))
        done.append(now.where("medoid is not null"))
        free = now.where("medoid is null")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return save(out)


def _split_heavy(members: DataFrame, chunks: dict[int, int], least: float, part: int, step: int) -> DataFrame:
    """The groups of loose clusters of any size, as GROUP."""
    rows = _taken(_with_degrees(members, chunks, least), least, part, step)
    total = vector_sums(rows, "medoid", "e").select(F.col("key").alias("medoid"), F.col("sum").alias("t"))
    named = rows.groupBy("medoid").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("size"))
    about = named.join(total, "medoid").withColumn("inner", (C.dot("t", "t") - F.col("size")) / (F.col("size") * (F.col("size") - 1.0)))
    alone = F.col("size") == 1
    j = rows.join(about, "medoid")
    return j.select(
        F.col("c").alias("cluster_id"), F.col("id").alias("face_id"), "group_id", "size", F.when(alone, F.lit(1.0)).otherwise(F.col("inner")).alias("mean_cosine"),
        F.lit(True).alias("loose"), ((C.dot("e", "t") - 1) / F.greatest(F.lit(1), F.col("size") - 1)).alias("centrality"),
    )


def groups(faces: DataFrame, clusters: DataFrame, least: float = 0.75, tight: float = 0.6, part: int = PART, step: int = ROUND) -> DataFrame:
    """One row for each clustered face: its group (the cluster, or a part of a loose one, named by its smallest face),
    the group's size and mean cosine, and the face's mean cosine to the other members."""
    rows = V.faces(faces)
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    heavy = {r.cluster_id: int(r.n) for r in sizes.where(F.col("n") > part).collect()}  # at most one for each PART rows
    j = rows.join(clusters.select("cluster_id", F.col("face_id").alias("id")), "id").select("cluster_id", "id", "e", "mv")

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, i, x = _unit_rows(batches)
        for s, t in _spans(c):
            yield _table(_groups(int(c[s]), i[s:t], x[s:t], least, tight))

    is_heavy = F.col("cluster_id").isin(list(heavy)) if heavy else F.lit(False)
    out = j.where(~is_heavy).repartition("cluster_id").mapInArrow(light, GROUP)
    if not heavy:
        return out
    big = j.where(is_heavy).repartition("cluster_id", F.pmod(F.xxhash64("id"), F.lit(max(heavy.values()) // part + 1)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _, x = _unit_rows(batches)
        for s, t in _spans(c):
            yield pa.RecordBatch.from_arrays([pa.array([int(c[s])]), pa.array([x[s:t].sum(axis=0, dtype=np.float64)], pa.list_(pa.float64())), pa.array([int(t - s)])], ["c", "s", "n"])

    total: dict[int, list] = {}
    for r in big.mapInArrow(sums, "c bigint, s array<double>, n bigint").toLocalIterator():
        a = total.setdefault(r.c, [np.zeros(V.DIM), 0])
        a[0] += np.array(r.s)
        a[1] += r.n

    mean = {c: float((s @ s - n) / (n * (n - 1))) for c, (s, n) in total.items()}
    loose = sorted(c for c in mean if mean[c] < tight)

    def central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, i, x = _unit_rows(batches)
        for s, t in _spans(c):
            sm, n = total[int(c[s])]
            yield _table([(int(c[s]), int(a), int(c[s]), n, mean[int(c[s])], False, float(v)) for a, v in zip(i[s:t], (x[s:t] @ sm - 1) / (n - 1))])

    out = out.unionByName((big.where(~F.col("cluster_id").isin(loose)) if loose else big).mapInArrow(central, GROUP))
    for s in range(0, len(loose), AT_ONCE):
        some = loose[s : s + AT_ONCE]
        chunks = {c: -(-total[c][1] // part) for c in some}
        out = out.unionByName(_split_heavy(big.where(F.col("cluster_id").isin(some)), chunks, least, part, step))
    return out


def describe(faces: DataFrame, clusters: DataFrame, assignments: DataFrame, least: float = 0.75, tight: float = 0.6, part: int = PART) -> DataFrame:
    """``group_id, cluster_id, size, mean_cosine, loose, typical, n_persons, persons``: the ``TYPICAL`` most typical
    faces of each group, the number of persons its faces are assigned to and the ``TYPICAL`` most frequent of them."""
    g = groups(faces, clusters, least, tight, part)
    w = Window.partitionBy("group_id").orderBy(F.desc(F.round("centrality", 5)), "face_id")
    top = g.withColumn("k", F.row_number().over(w)).where(F.col("k") <= TYPICAL)
    about = top.groupBy("group_id").agg(
        F.first("cluster_id").alias("cluster_id"), F.first("size").alias("size"), F.round(F.first("mean_cosine"), 4).alias("mean_cosine"),
        F.first("loose").alias("loose"), F.transform(F.array_sort(F.collect_list(F.struct("k", "face_id"))), lambda x: x["face_id"]).alias("typical"),
    )
    a = assignments.where("person_id is not null").select("face_id", "person_id").distinct()
    per = g.select("group_id", "face_id").join(a, "face_id").groupBy("group_id", "person_id").agg(F.count(F.lit(1)).alias("n"))
    wp = Window.partitionBy("group_id").orderBy(F.desc("n"), "person_id")
    best = per.withColumn("k", F.row_number().over(wp)).where(F.col("k") <= TYPICAL).groupBy("group_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "person_id"))), lambda x: x["person_id"]).alias("persons")
    )
    many = per.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_persons"))
    out = about.join(many, "group_id", "left").join(best, "group_id", "left")
    return out.withColumn("n_persons", F.coalesce("n_persons", F.lit(0)).cast("bigint"))
