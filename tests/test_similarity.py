import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaiq.functions import geometry as G
from mosaiq.functions import vectors as V
from mosaiq.operators import similarity as S
from mosaiq.operators import tables as T


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, x, label=None):
    rows = [(k, [float(z) for z in v], int(k % 4 if label is None else label[k])) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "face_id bigint, vector array<double>, identity bigint")


def test_knn_both_ways(spark, points):
    f = frame(spark, points).unionByName(spark.createDataFrame([(None, [1.0] * 8, 0), (900, None, 0)], "face_id bigint, vector array<double>, identity bigint"))
    q = f.where("face_id % 50 = 0").select(F.col("face_id").alias("qid"), F.col("vector").alias("qv"))
    s = np.round(points @ points.T, 6)
    want = set()
    for k in range(0, 300, 50):
        order = sorted((x for x in range(300) if x != k), key=lambda x: (-s[k, x], x))[:5]
        want |= {(k, x, s[k, x], r + 1) for r, x in enumerate(order)}
    for limit in (S.QUERY_BYTES, 100):
        got = {tuple(r) for r in S.knn(q, f.repartition(3), 5, limit=limit).collect()}
        assert got == want


def test_ties_go_to_the_smaller_id(spark):
    f = frame(spark, np.ones((40, 2)) / np.sqrt(2))
    q = f.where("face_id = 7").select(F.col("face_id").alias("qid"), F.col("vector").alias("qv"))
    assert [r.id for r in S.knn(q, f.repartition(4), 3).orderBy("rank").collect()] == [0, 1, 2]


def test_pair_aggregates(spark, points):
    f = frame(spark, points)
    s, lab = points @ points.T, np.arange(300) % 4
    h = S.pair_histogram(f, block=64).toPandas()
    i, j = np.triu_indices(300, 1)
    assert h["n"].sum() == len(i)
    assert h.loc[h["same"], "n"].sum() == (lab[i] == lab[j]).sum()
    assert abs((h["score"] * h["n"]).sum() - s[i, j].sum()) < 5
    b = S.class_bests(f, block=64).toPandas().sort_values("id")
    np.fill_diagonal(s, -9)
    same = lab[:, None] == lab[None, :]
    assert np.allclose(b["same"], np.where(same, s, -9).max(1), atol=1e-6)
    assert np.allclose(b["other"], np.where(~same, s, -9).max(1), atol=1e-6)


def test_vector_sums(spark, points):
    f = frame(spark, points)
    for r in S.vector_sums(f, "identity", "vector").collect():
        assert np.allclose(r["sum"], points[np.arange(300) % 4 == r.key].sum(0))


def test_zero_and_null_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([3.0, 4.0], None), ([3.0, None], [1.0, 5.0]), ([1.0, 2.0, 9.0], [1.0, 2.0])], "a array<double>, b array<double>")
    r = df.select(V.cosine("a", "b").alias("c"), V.cosine01("a", "b").alias("z"), V.dot("a", "b").alias("d"), V.normalise("a").alias("n")).collect()
    assert (r[0].c, r[0].z, r[0].n) == (0.0, 0.0, [0.0, 0.0])
    assert r[1].c is None and r[1].n == [0.6000000000000001, 0.8]
    assert r[2].d == 3.0 and r[3].d == 5.0


def test_checked_dimension(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "a array<float>")
    with pytest.raises(Exception, match="expected 3 elements"):
        df.select(V.checked("a", 3).alias("v")).collect()


boxes = st.tuples(*[st.floats(0, 50)] * 2, *[st.floats(0.5, 40)] * 2)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(boxes, boxes), min_size=1, max_size=20))
def test_iou_symmetry_and_range(spark, pairs):
    df = spark.createDataFrame([(*a, *b) for a, b in pairs], ",".join(f"{s}{c} double" for s in "ab" for c in "xywh"))
    a, b = (tuple(F.col(s + c) for c in "xywh") for s in "ab")
    for r in df.select(G.iou(a, b).alias("p"), G.iou(b, a).alias("q"), G.iou(a, a).alias("o")).collect():
        assert abs(r.p - r.q) < 1e-12 and 0 <= r.p <= 1 + 1e-12 and abs(r.o - 1) < 1e-9


def test_gap_to_next_lower(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.9), (1, 0.7), (1, 0.2)], "g int, s double")
    got = sorted((r.s, None if r.margin is None else round(r.margin, 6)) for r in T.gap_to_next_lower(df, "g", "s").collect())
    assert got == [(0.2, None), (0.7, 0.5), (0.9, 0.2), (0.9, 0.2)]


def test_label_pair_bests_of_all_rows(spark):
    """The whole query's score of every pair of persons is the best of all of their faces."""
    import __spark_entry__ as entry
    from mosaiq.plans import fixtures

    d = "/root/testdata/sf0.001"
    f = [r for r in fixtures.faces(spark, d).select("person_id", "vector").collect() if r.person_id is not None]
    x, p = np.array([r.vector for r in f]), np.array([r.person_id for r in f])
    s = x @ x.T
    names = np.unique(p).tolist()
    want = {(a, b): max(0.0, s[np.ix_(p == a, p == b)].max()) for a in names for b in names if a < b}
    got = {(r.p, r.q): r.score for r in entry.queries()["v25_set_similarity"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_knn_within_labels(spark, points):
    f = frame(spark, points).unionByName(spark.createDataFrame([(900, [1.0] * 8, None), (901, [1.0] * 8, 77)], "face_id bigint, vector array<double>, identity bigint"))
    s = np.round(points @ points.T, 6)
    want = set()
    for k in range(0, 300, 3):
        order = sorted((x for x in range(300) if x % 3 and x % 4 == k % 4), key=lambda x: (-s[k, x], x))[:2]
        want |= {(k % 4, k, x, s[k, x], r + 1) for r, x in enumerate(order)}
    for block in (S.BLOCK, 7):
        got = S.knn_within(f.where("face_id % 3 = 0"), f.where("face_id % 3 > 0"), 2, "identity", block=block)
        assert {tuple(r) for r in got.collect()} == want


def test_ratio_match_of_every_identity(spark):
    import __spark_entry__ as entry
    from mosaiq.plans import fixtures

    d = "/root/testdata/sf0.001"
    f = fixtures.faces(spark, d).select("identity", "face_id", "vector").collect()
    want = set()
    for label in {r.identity for r in f}:
        a = sorted((r.face_id, r.vector) for r in f if r.identity == label and r.face_id % 2 == 0)
        b = sorted((r.face_id, r.vector) for r in f if r.identity == label and r.face_id % 2)
        if not a or not b:
            continue
        s = np.round(np.array([v for _, v in a]) @ np.array([v for _, v in b]).T, 6)
        for k, row in enumerate(s):
            order = np.argsort(-row, kind="stable")
            best = order[0]
            back = np.argsort(-s[:, best], kind="stable")[0]
            far = lambda x: np.sqrt(max(2 - 2 * x, 0.0))
            if back == k and (len(order) < 2 or round(far(row[best]), 6) < round(0.98 * far(row[order[1]]), 6)):
                want.add((label, a[k][0], b[best][0], row[best]))
    got = {tuple(r) for r in entry.queries()["k07_ratio_match"](spark, d).select("identity", "a", "b", "score").collect()}
    assert got == want and len({r[0] for r in got}) > 1


def test_knn_apart_keeps_a_running_top(spark, points):
    """Rows of the query's label can't push others out, over many small batches of a partition."""
    s = np.round(points @ points.T, 6)
    f = frame(spark, points).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        q = f.where("face_id % 10 = 0").selectExpr("face_id as qid", "vector as qv", "identity as l")
        for limit in (S.QUERY_BYTES, 100):
            got = {(r.qid, r.id, r.score, r["rank"]) for r in S.knn(q, f, 3, apart=("l", "identity"), limit=limit).collect()}
            want = set()
            for k in range(0, 300, 10):
                order = sorted((x for x in range(300) if x % 4 != k % 4), key=lambda x: (-s[k, x], x))[:3]
                want |= {(k, x, s[k, x], r + 1) for r, x in enumerate(order)}
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scores_to_means(spark, points):
    got = {(r.face_id, r.other): r.score for r in S.scores_to_means(frame(spark, points), "face_id", "identity", "vector", block=2).collect()}
    for k in (0, 7, 133):
        for o in range(4):
            own = [x for x in range(300) if x % 4 == o and x != k]
            m = points[own].sum(axis=0)
            assert abs(got[k, o] - points[k] @ m / np.linalg.norm(m)) < 2e-6
    assert len(got) == 1200
