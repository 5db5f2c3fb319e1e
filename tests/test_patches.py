import numpy as np

from mosaiq.operators import patches as P


def test_match():
    a = np.array([[0.0, 0], [5, 5], [9, 9]])
    assert P.match(a, a + 0.1).tolist() == [[0, 0], [1, 1], [2, 2]]
    assert P.match(a[:1], np.array([[50.0, 50]])).tolist() == [[0, 0]]
    assert P.match(a[:1], np.array([[1.0, 0], [0, 1.0]])).tolist() == []
    assert len(P.match(a[:0], a)) == 0


def test_patch_search_finds_the_moved_copy(spark):
    rng = np.random.default_rng(4)

    def image(k, x, v):
        return [(k, float(a), float(b), [float(z) for z in u]) for (a, b), u in zip(x, v)]

    x, v = rng.uniform(0, 100, (40, 2)), rng.normal(size=(40, 8))
    rows = image(2, x * 1.1 + 5, v + rng.normal(size=v.shape) * 0.01)
    for k in range(3, 8):
        rows += image(k, rng.uniform(0, 100, (40, 2)), rng.normal(size=(40, 8)))
    schema = "image_id bigint, x double, y double, vector array<double>"
    got = P.patch_search(spark.createDataFrame(image(1, x, v), schema), spark.createDataFrame(rows, schema), rng.normal(size=(4, 8))).collect()
    best = max(got, key=lambda r: r.score)
    assert (best.query_image, best.image_id, best.matches, best.inliers) == (1, 2, 40, 40) and best.score == 0.4
