import tracemalloc

import numpy as np
import pytest

from mosaiq.llm import clusters, describe, permknn
from mosaiq.llm import vectors as V

SCHEMA = "face_id bigint, embedding array<float>, model_version string, id int, mv string"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 128))
    who = np.r_[np.zeros(700, int), rng.integers(1, 40, 300), np.arange(40)]  # one group holds most
    x = centres[who] + rng.normal(size=(len(who), 128)) * 0.35
    x[:100] = np.round(x[:100] / np.linalg.norm(x[:100], axis=1)[:, None], 3)  # on the grid of the packing
    x[100] = x[0]
    x[101] = x[0] * 20
    rows = [(k, [float(z) for z in v], f"m@{k % 7 == 0}", 1, "y") for k, v in enumerate(x)]
    good = len(rows)
    bad = [None, [], [0.0] * 128, [1.0] * 127, [float("nan")] * 128, [float("inf")] + [1.0] * 127, [None] + [1.0] * 127]
    rows += [(5000 + k, e, "m@False", 1, "y") for k, e in enumerate(bad)]
    rows += [(None, rows[5][1], "m@False", 1, "y"), (6000, rows[5][1], None, 1, "y")]
    rows += rows[:50]  # delivered again
    ok = {r[0]: (np.array(r[1], np.float32).astype(np.float64), r[2]) for r in rows[:good]}
    return rows, ok


def cosines(ok):
    ids = np.array(sorted(ok))
    x = np.stack([ok[i][0] for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    mv = np.array([ok[i][1] for i in ids])
    s = x @ x.T
    s[mv[:, None] != mv[None, :]] = -9
    np.fill_diagonal(s, -9)
    return ids, s


@pytest.mark.parametrize("chunk", [V.CHUNK, 150])
def test_neighbours(spark, data, chunk):
    rows, ok = data
    ids, s = cosines(ok)
    r = np.round(s, 6)
    want = set()
    for k in range(len(ids)):
        near = sorted((-r[k, j], ids[j]) for j in np.flatnonzero(r[k] >= 0.75))[:5]
        want |= {(int(ids[k]), int(j), n + 1) for n, (_, j) in enumerate(near)}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(x.face_id, x.neighbour, x["rank"]) for x in permknn.neighbours(df, chunk=chunk).collect()}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


@pytest.mark.parametrize("chunk,sample,pivots", [(V.CHUNK, V.SAMPLE, V.PIVOTS), (60, V.SAMPLE, V.PIVOTS), (40, 90, 30)])
def test_clusters(spark, data, chunk, sample, pivots):
    rows, ok = data
    ids, s = cosines(ok)
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.where(s >= 0.75, label[None, :], label[:, None]).min(axis=1)
        if (new == label).all():
            break
        label = new
    n = np.bincount(label, minlength=len(ids))
    want = {(int(ids[label[k]]), int(ids[k])) for k in range(len(ids)) if n[label[k]] > 1}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {tuple(x) for x in clusters.clusters(df, chunk=chunk, sample=sample, pivots=pivots).collect()}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert permknn.neighbours(df).collect() == [] and clusters.clusters(df).collect() == []
    df = spark.createDataFrame([(1, None, None, 1, "y")], SCHEMA)
    assert permknn.neighbours(df).collect() == [] and clusters.clusters(df).collect() == []


def test_packing_is_lossless():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 128)).astype(np.float32)
    x[::2] = np.round(x[::2], 3)
    q, f, order = V.pack(x)
    assert (V.unpack(q, f) == x[order]).all()


def test_split_of_a_chain():
    """A chain of alike vectors is one cluster, but loose: it is split around its medoids."""
    a = np.linspace(0, np.pi, 30)
    x = np.stack([np.cos(a), np.sin(a)], axis=1)
    m = describe.split(x, np.arange(30), 0.75)
    assert len(set(m)) > 2 and all(x[k] @ x[m[k]] >= 0.75 for k in range(30))


@pytest.mark.parametrize("part", [describe.PART, 100])
def test_description(spark, data, part):
    rows, ok = data
    df = spark.createDataFrame(rows, SCHEMA)
    cl = clusters.clusters(df).persist()
    a = spark.createDataFrame([(0, 5), (2, 5), (2, 5), (2, 6), (3, None)], "face_id bigint, person_id bigint")
    d = {r.group_id: r for r in describe.describe(df, cl, a, part=part).collect()}
    sizes = {r.cluster_id: r["n"] for r in cl.groupBy("cluster_id").agg({"face_id": "count"}).withColumnRenamed("count(face_id)", "n").collect()}
    assert sum(r["size"] for r in d.values()) == sum(sizes.values())
    big = max(d.values(), key=lambda r: r["size"])
    ids, s = cosines(ok)
    own = [x.face_id for x in cl.where(f"cluster_id = {big.cluster_id}").collect()]
    at = {int(i): k for k, i in enumerate(ids)}
    k = [at[i] for i in own]
    c = np.where(s[np.ix_(k, k)] < -1, 0, s[np.ix_(k, k)]).sum(axis=1)
    assert big.typical[0] in {own[j] for j in np.argsort(-c)[:3]}
    assert d[min(x for x in d if d[x].n_persons)].n_persons >= 1
    cl.unpersist()


@pytest.mark.parametrize("noise", [0, 1e-4])
def test_neighbours_among_thousands_of_copies(noise):
    """All cosines of a group round to few values, so the smaller ids decide, across tiles too."""
    rng = np.random.default_rng(5)
    n = 2 * permknn.TILE + 900
    x = (rng.normal(size=(4, 128))[rng.integers(0, 2, n)] + noise * rng.normal(size=(n, 128))).astype(np.float32)
    ids = rng.permutation(10 * n)[:n].astype(np.int64)
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1)[:, None]
    perm = np.zeros((n, permknn.PREFIX), np.int16)
    half = n // 3
    for a, b in ((slice(None), slice(None)), (slice(0, half), slice(half, n))):
        xa, ia = x[a], ids[a]
        xb, ib = (xa, ia) if a == b else (x[b], ids[b])
        out = permknn.nearest_in(xa, xb, ia, ib, perm[a], perm[b], 5, 0.75)
        for (da, ja, db, jb), (who, near, cos) in zip(((d[a], ia, d[b], ib), (d[b], ib, d[a], ia)), out):
            got = {}
            for w, m, v in zip(who.tolist(), near.tolist(), cos.tolist()):
                got.setdefault(w, []).append((-v, m))
            for k in range(0, len(ja), 37):
                c = np.round(db @ da[k], 6)
                want = sorted((-v, int(m)) for v, m in zip(c, jb) if v >= 0.75 and m != ja[k])[:5]
                assert sorted(got[int(ja[k])]) == want


def test_loose_clusters_are_split_at_any_size(spark):
    """Two chained clusters over several chunks give the groups that they give in one task."""
    rng = np.random.default_rng(3)
    rows = []
    for c, n in ((0, 400), (1000, 300)):
        a = np.sort(rng.uniform(0, 1.5 * np.pi, n))
        x = np.zeros((n, 128))
        x[:, c // 1000 * 2], x[:, c // 1000 * 2 + 1] = np.cos(a), np.sin(a)
        x += 0.02 * rng.normal(size=x.shape)
        rows += [(c + int(k), [float(z) for z in x[k]], "m", c) for k in range(n)]
    rows += [(5000 + k, [1.0] * 127 + [0.001 * k], "m", 5000) for k in range(150)]  # heavy, but not loose
    f = spark.createDataFrame([r[:3] for r in rows], "face_id bigint, embedding array<float>, model_version string").repartition(3)
    cl = spark.createDataFrame([(r[3], r[0]) for r in rows], "cluster_id bigint, face_id bigint")
    small = {r.face_id: r for r in describe.groups(f, cl).collect()}
    assert len({r.group_id for r in small.values()}) > 6
    for part, step in ((100, 4), (350, 1000)):
        got = {r.face_id: r for r in describe.groups(f, cl, part=part, step=step).collect()}
        assert len(got) == len(rows)
        for i, r in got.items():
            want = small[i]
            assert (r.cluster_id, r.group_id, r["size"], r.loose) == (want.cluster_id, want.group_id, want["size"], want.loose)
            assert abs(r.mean_cosine - want.mean_cosine) < 1e-4 and abs(r.centrality - want.centrality) < 1e-4


def test_alike_vectors_of_two_pivots_meet():
    """Two alike vectors, each nearest to another of two pivots that both are alike to."""
    at = lambda *deg: np.array([[np.cos(np.radians(d)), np.sin(np.radians(d))] + [0.0] * 126 for d in deg], np.float32)
    mv = lambda n: np.array(["m"] * n, object)
    p = V.Pivots(at(0, 55), np.arange(2), mv(2), 1.0, at(0, 55), mv(2))
    row, key, _ = permknn._lists(at(25, 30, 0), mv(3), p, 0.75)
    assert {(int(r), int(k)) for r, k in zip(row, key)} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)}


@pytest.fixture(scope="module")
def wide():
    """Pivots and a sample as they are beyond MANY_ROWS: 32 million cosines between them."""
    rng = np.random.default_rng(11)
    v = V.unit(rng.normal(size=(16_000, 128))).astype(np.float32)
    mv = np.array(["a", "b"], object)[(np.arange(len(v)) % 8 == 0).astype(int)]
    return V.Pivots(v[:2000], np.arange(2000), mv[:2000], 0.01, v, mv)


def peak_mb(f):
    tracemalloc.start()
    out = f()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_chunks_of_clusters_hold_blocks_only(wide):
    """The driver's memory doesn't grow with sample x pivots."""
    h = clusters._permutations(len(wide.vectors))
    got, peak = peak_mb(lambda: clusters._chunks(wide, h, 0.75, 1000))
    assert peak < 150 and len(got) == h.size
    row, key, _, _ = clusters._banded(wide.sample, wide.sample_versions, wide, h, 0.75)
    n = [np.bincount(key[wide.sample_versions[row] == m], minlength=h.size) for m in "ab"]
    assert (got == np.maximum(1, np.ceil(np.max(n, axis=0) / 0.01 / 1000))).all() and got.max() > 1


def test_pivots_hold_blocks_only(wide):
    taken, peak = peak_mb(lambda: V._apart(wide.sample, wide.sample_versions, np.arange(16_000), 1500))
    assert peak < 100 and len(taken) == 1500
    a = V._alike(wide.sample[taken], wide.sample[taken], wide.sample_versions[taken], wide.sample_versions[taken])
    assert a.sum() == 1500
    assert not len(wide.bare().sample) and wide.bare().vectors is wide.vectors


def test_nearest_pivots_by_groups(wide):
    for pivots in (1, 12, 33, 400, 1999):
        p = V.Pivots(wide.vectors[:pivots], wide.ids[:pivots], wide.versions[:pivots], 0.01, wide.sample, wide.sample_versions)
        v, mv = wide.sample[5000:5300], wide.sample_versions[5000:5300]
        top, s, own = V.nearest(v, mv, p, 12)
        d = v @ p.vectors.T
        assert (s == -np.sort(-d, axis=1)[:, :12]).all() and (np.take_along_axis(d, top, axis=1) == s).all()
        assert (own == np.where(p.versions[None, :] == mv[:, None], d, np.float32(-2))).all()


def test_chunks_of_lists_hold_blocks_only(wide):
    got, peak = peak_mb(lambda: permknn.chunks_of_lists(wide, 0.75, 1000))
    assert peak < 150 and len(got) == 2000
    row, key, _ = permknn._lists(wide.sample, wide.sample_versions, wide, 0.75)
    n = [np.bincount(key[wide.sample_versions[row] == m], minlength=2000) for m in "ab"]
    assert (got == np.maximum(1, np.ceil(np.max(n, axis=0) / 0.01 / 1000))).all() and got.max() > 1
