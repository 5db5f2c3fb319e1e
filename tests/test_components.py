import random

from mosaiq.operators.components import components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in up}


def check(spark, edges):
    for few in (0, 2_000_000):  # in rounds, and by one task
        got = {tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), few=few).collect()}
        assert got == brute(edges)


def test_random_graph(spark):
    r = random.Random(4)
    check(spark, [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(None, 3), (4, None), (1000, 1000), (-5, -6)])


def test_long_chain_and_star(spark):
    check(spark, [(k, k + 1) for k in range(60)] + [(500, k) for k in range(600, 900)])


def test_empty(spark):
    check(spark, [])
