import math
import random

from mosaiq.operators import hotkeys


def brute(rows, probs, distinct):
    by = {}
    for k, v in rows:
        if k is not None and v is not None and not (isinstance(v, float) and math.isnan(v)):
            by.setdefault(k, []).append(v + 0.0 if isinstance(v, float) else v)
    out = set()
    for k, vs in by.items():
        vs = sorted(set(vs) if distinct else vs)
        for p in probs:
            out.add((k, len(vs), p, vs[max(1, math.ceil(p * len(vs))) - 1]))
    return out


def test_quantiles_of_a_hot_key(spark):
    r = random.Random(1)
    rows = [(1 if r.random() < 0.6 else r.randint(2, 30), r.choice([r.uniform(-5, 5), 0.0, -0.0, 2.0**r.randint(-40, 40), -1e300, 1e-310])) for _ in range(3000)]
    rows += [(None, 1.0), (2, None), (2, float("nan")), (3, float("inf")), (3, float("-inf"))]
    df = spark.createDataFrame(rows, "k int, v double").withColumnRenamed("k", "key0")
    got = {tuple(x) for x in hotkeys.key_quantiles(df, "key0", "v", (0.0, 0.25, 0.5, 1.0)).collect()}
    assert got == brute(rows, (0.0, 0.25, 0.5, 1.0), False)


def test_distinct_ranks(spark):
    r = random.Random(2)
    rows = [(1 if r.random() < 0.6 else r.randint(2, 30), r.choice([r.randint(-100, 5000), r.randint(-(2**62), 2**62), 7])) for _ in range(3000)]
    rows += [(None, 1), (2, None), (4, 2**63 - 1), (4, -(2**63))]
    df = spark.createDataFrame(rows, "key int, v bigint")
    got = {tuple(x) for x in hotkeys.distinct_ranks(df, "key", "v", (0.1, 0.5, 1.0)).collect()}
    assert got == brute(rows, (0.1, 0.5, 1.0), True)


def test_empty(spark):
    df = spark.createDataFrame([], "key int, v double")
    assert hotkeys.key_quantiles(df, "key", "v", (0.5,)).collect() == []
    assert hotkeys.distinct_ranks(df, "key", "v", (0.5,)).collect() == []


def test_stale_counts(spark):
    p = spark.createDataFrame(
        [(1, 2, 10, "x"), (1, 3, 20, "x"), (2, None, 1, "x"), (3, 0, None, "x"), (None, 1, 1, "x")], "person_id int, face_count int, updated_at int, status string"
    )
    a = spark.createDataFrame(
        [(1, 5, None), (1, 5, "ok"), (1, 6, " Rejected "), (1, 7, "candidate"), (1, None, "ok"), (None, 9, "ok"), (9, 9, "ok")], "person_id int, face_id int, status string"
    )
    got = {tuple(x) for x in hotkeys.stale_counts(p, a).collect()}
    assert got == {(1, 3, 2), (2, None, 0), (3, 0, 0)}
