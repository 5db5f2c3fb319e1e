import random

import numpy as np
import pytest

from mosaiq.operators import sequential as K


def boxes(n=400, seed=1):
    r = random.Random(seed)
    return [(r.choice([1, 1, 2, 3, r.randint(4, 60)]), k, round(r.random(), 2), r.uniform(0, 60), r.uniform(0, 60), r.uniform(5, 40), r.uniform(5, 40)) for k in range(n)] + [(5, 9999, None, 1.0, 1.0, 1.0, 1.0)]


def iou(a, b):
    w = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    h = max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
    u = a[5] * a[6] + b[5] * b[6] - w * h
    return w * h / u if u > 0 else 0


SCHEMA = "image_id bigint, face_id bigint, score double, x double, y double, w double, h double"


def test_hard_nms(spark):
    rows = boxes()
    want = set()
    for g in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: (-r[2], r[1])):
            if all(iou(r, k) <= 0.4 for k in kept):
                kept.append(r)
        want |= {r[:3] for r in kept}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    got = {tuple(r) for r in K.hard_nms(spark.createDataFrame(rows, SCHEMA), "image_id", "face_id", "score").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_soft_nms(spark):
    rows = boxes(150, 2)
    want = set()
    for g in {r[0] for r in rows}:
        left = {r[1]: (r[2], r) for r in rows if r[0] == g and r[2] is not None and r[2] >= 0.1}
        while left:
            k = min(left, key=lambda i: (-left[i][0], i))
            s, box = left.pop(k)
            want.add((g, k, round(s, 6)))
            for i in list(left):
                o = iou(box, left[i][1])
                if o > 0.3:
                    left[i] = (left[i][0] * (1 - o), left[i][1])
                if left[i][0] < 0.1:
                    del left[i]
    got = {tuple(r) for r in K.soft_nms(spark.createDataFrame(rows, SCHEMA), "image_id", "face_id", "score").collect()}
    assert got == want


def test_cell_nms_keeps_no_close_pair(spark):
    rows = boxes()
    got = K.cell_nms(spark.createDataFrame(rows, SCHEMA), "image_id", "face_id", 100.0, 100.0).collect()
    by = {r[1]: r for r in rows}
    for a in got:
        for b in got:
            if a.face_id < b.face_id and a.image_id == b.image_id:
                assert iou(by[a.face_id], by[b.face_id]) <= 0.5


def test_ransac_finds_the_map():
    rng = np.random.default_rng(1)
    src = rng.uniform(0, 100, (40, 2))
    h = np.array([[1.1, 0.1, 3], [-0.1, 0.9, 5], [0.0005, 0.0002, 1]])
    q = np.c_[src, np.ones(40)] @ h.T
    dst = q[:, :2] / q[:, 2:]
    dst[:12] += rng.uniform(20, 60, (12, 2))
    got, ok = K.ransac(src, dst)
    assert ok[12:].all() and not ok[:12].any() and np.allclose(got, h, atol=1e-6)
    assert K.homography(src[:3], dst[:3]) is None and K.homography(np.ones((5, 2)), dst[:5]) is None


@pytest.mark.parametrize("n", [0, 1, 30])
def test_online_clusters(spark, n):
    rng = np.random.default_rng(2)
    rows = [(1, k, float(rng.random()), [float(x) for x in v / np.linalg.norm(v)]) for k, v in enumerate(rng.normal(size=(n, 3)))]
    df = spark.createDataFrame(rows, "day bigint, face_id bigint, quality double, vector array<double>")
    got = {r.face_id: r.cluster for r in K.online_clusters(df, "day", K.by_votes(0.8, 0.02, 10)).collect()}
    own, done = {}, []
    for _, k, _, v in sorted(rows, key=lambda r: (-r[2], r[1])):
        near = sorted(((round(float(np.dot(v, w)), 6), -j) for j, w in done), reverse=True)[:10]
        votes = {}
        for s, j in near:
            votes[own[-j]] = votes.get(own[-j], 0) + s
        best = sorted(((max(round(float(np.dot(v, w)), 6) for j, w in done if own[j] == c), -c) for c in sorted(votes, key=lambda c: (-votes[c], c))[:3]), reverse=True)
        join = best and best[0][0] >= 0.8 and (len(best) < 2 or best[0][0] - best[1][0] >= 0.02)
        own[k] = -best[0][1] if join else k
        done.append((k, v))
    assert got == own


def test_policies_of_online_clusters(spark):
    """Faces along an arc: the nearest joins; by prototypes, a face of low quality needs more and one under the least stays
    alone."""
    at = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    rows = [(1, 10, 0.9, at(0)), (1, 11, 0.8, at(30)), (1, 12, 0.7, at(90)), (1, 13, 0.4, at(121)), (1, 14, 0.05, at(0)), (1, None, 0.5, at(0)), (1, 15, None, at(0))]
    df = spark.createDataFrame(rows, "day bigint, face_id bigint, quality double, vector array<double>")
    run = lambda p: {r.face_id: r.cluster for r in K.online_clusters(df, "day", p).collect()}
    assert run(K.by_nearest(0.85)) == {10: 10, 11: 10, 12: 12, 13: 12, 14: 10}
    assert run(K.by_prototypes(0.85, 0.02)) == {10: 10, 11: 10, 12: 12, 13: 13, 14: 14}
    assert run(K.by_prototypes(0.85, 0.02, penalty=0.0)) == {10: 10, 11: 10, 12: 12, 13: 12, 14: 14}


def test_grey_figures():
    assert np.allclose(K.grey_figures(np.full((8, 8), 7, np.uint8)), 0)
    lap, ent, _ = K.grey_figures((np.indices((8, 8)).sum(0) % 2 * 255).astype(np.uint8))
    assert lap > 1e5 and abs(ent - 1) < 1e-12
