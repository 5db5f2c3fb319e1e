import math
import random

import numpy as np
import pyarrow as pa

from mosaiq.llm import topn

SCHEMA = "person_id bigint, assignment_id bigint, face_id bigint, confidence float, note string, g int"


def brute(rows, n):
    best = {}
    for p, a, f, s, *_ in rows:
        if p is None or a is None or s is None or math.isnan(s) or not 0 <= s <= 1:
            continue
        key = (-np.float64(np.float32(s)) + 0.0, f if f is not None else topn.LAST, a)
        d = best.setdefault(p, {})
        d[a] = min(d.get(a, key), key)
    return {(p, a, r + 1) for p, d in best.items() for r, (_, _, a) in enumerate(sorted(d.values())[:n])}


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for k in range(6000):
        p = 7 if r.random() < 0.5 else r.randint(-20, 200)
        rows.append((p, k // 2 if r.random() < 0.4 else k, r.randint(0, 50), r.choice([round(r.random(), 1), 0.5, -0.0, 0.0, 1.0, 1.5, -0.1]), "x", 1))
    rows += rows[:500]  # delivered again
    rows += [(None, 1, 1, 0.5, None, 1), (7, None, 1, 0.5, None, 1), (7, 1, None, None, None, 1), (8, 3, None, float("nan"), None, 1), (9, 4, None, 0.9, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {tuple(x) for x in topn.top_n(df, "person_id", "confidence", "face_id", "assignment_id", 10, 0.0, 1.0).select("person_id", "assignment_id", "rank").collect()}
    assert got == brute(rows, 10)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topn.top_n(df, "person_id", "confidence", "face_id", "assignment_id", 10).collect() == []


def test_run_writer_across_batches():
    """A group that spans batches, with an item delivered at several scores."""
    rows = [(1, 0.9 - k * 0.01, 0, k // 3) for k in range(60)] + [(2, 0.5, 0, 1)]
    cols = list(zip(*rows))
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["g", "s", "t", "i"])
    blocks = list(topn._write_runs((whole.slice(k, 7) for k in range(0, len(rows), 7)), 5, 1))
    g = np.frombuffer(blocks[0].column(2)[0].as_py(), np.int64)
    i = np.frombuffer(blocks[0].column(5)[0].as_py(), np.int64)
    assert g.tolist() == [1] * 5 + [2] and i.tolist() == [0, 1, 2, 3, 4, 1]


def test_loser_tree_merge_is_sorted():
    r = random.Random(5)
    runs = []
    for _ in range(7):
        x = sorted((r.randint(0, 5), -r.random(), r.randint(0, 9), r.randint(0, 1000)) for _ in range(r.randint(0, 40)))
        runs.append((np.array([a[0] for a in x]), np.array([-a[1] for a in x]), np.array([a[2] for a in x]), np.array([a[3] for a in x])))
    out = [(g, -s, t, i) for g, s, t, i in topn.merge_top(runs, 10**6)]
    assert out == sorted(out)


def test_millions_of_small_groups_in_little_memory():
    """A bucket of three million groups of one row in 20 runs: the merge holds some rows of each run only."""
    import tracemalloc

    n = 3_000_000
    g = np.arange(n)
    runs = [(g[k::20].copy(), np.full(n // 20, 0.5), np.zeros(n // 20, np.int64), g[k::20].copy()) for k in range(20)]
    tracemalloc.start()
    out = topn.merge_top(runs, 10)
    first = [next(out) for _ in range(100_000)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[0] for r in first] == list(range(100_000)) and most < 200 << 20


def test_buckets_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(topn, "PER_BUCKET", 10)
    df = spark.range(5000).selectExpr("id % 1700 as g", "id as i", "cast(id % 7 as double) as s", "id as t")
    got = topn.top_n(df, "g", "s", "t", "i", 2).collect()
    rows = [(k % 1700, k, k, float(k % 7) / 10) for k in range(5000)]
    assert {(r.g, r.i, r["rank"]) for r in got} == brute(rows, 2)
