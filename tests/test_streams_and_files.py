from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mosaiq.sources import files
from mosaiq.streaming import events as E

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def rows(n=200):
    t = datetime(2024, 1, 1)
    return [(k, t + timedelta(minutes=7 * k), k % 5, "ab"[k % 2], float(k)) for k in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    for k in range(3):  # files in the order of time: late rows would be dropped
        df.where(f"event_id div 67 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = spark.read.parquet(E.run_available(E.deduplicated(stream, ["event_id"])))
    assert {r.event_id for r in seen.collect()} == set(range(200)) and seen.count() == 200
    root = str(tmp_path / "state")
    E.run_available(stream, "append", E.upsert_batches(root, ["user_id"], ["ts"]))
    got = {(r.user_id, r.event_id) for r in E.latest(spark, root, ["user_id"], ["ts"]).collect()}
    assert got == {(u, 195 + u) for u in range(5)}


def test_windows_and_sessions(spark):
    df = spark.createDataFrame(rows(10), SCHEMA)
    assert sum(r.n for r in E.windowed(df, "30 minutes").collect()) == 10
    assert all(r.n == 2 for r in E.sessions(df, "1 hour").collect())
    assert E.windowed(df.limit(0)).collect() == []


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("x.JPG", "y.png", "z.txt"):
        (tmp_path / "a" / n).write_bytes(b"12345")
    got = {(r.ext, r["size"], r.mime) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {("jpg", 5, "image/jpeg"), ("png", 5, "image/png")}
    paths = files.scan_files(spark, str(tmp_path)).select("path").union(spark.createDataFrame([("/no/such.jpg",)], "path string"))
    out = files.export_files(spark, paths, str(tmp_path / "out")).collect()
    assert sorted(r.ok for r in out) == [False, True, True] and len(list((tmp_path / "out").iterdir())) == 2
    (tmp_path / "p.tsv").write_text("1\t/a b\n\n2\t/c\td\n")
    assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / "p.tsv")).collect()] == [(1, "/a b"), (2, "/c\td")]
    assert files.newest_index(spark, str(tmp_path / "none")) is None
    assert "| 1 |" in files.markdown(spark.range(1, 2))


def test_states_of_tasks(spark):
    """Against the rules played one by one; commands that don't fit change nothing."""
    import random

    from mosaiq.streaming import events as E

    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.randint(0, 50), k, r.choice(["enqueue", "claim", "complete", "fail", "fail", "cancel", None])) for k in range(400)]
    want = {}
    for t, _, _, x in sorted((x for x in rows if x[0] is not None), key=lambda x: x[1:3]):
        s, n, m = want.get(t, (None, 0, 0))
        want[t] = (*E.next_state(s, n, x), m + 1)
    got = {x[0]: tuple(x[1:]) for x in E.run_tasks(spark.createDataFrame(rows, "task_id bigint, ts bigint, event_id bigint, command string")).collect()}
    assert got == want
    s = ("pending", 0)
    for n in range(3):
        s = E.next_state(*E.next_state(*s, "claim"), "fail")
        assert s == ("pending", n + 1)
    assert E.next_state(*E.next_state(*s, "claim"), "fail") == ("failed", 3)
    assert E.run_tasks(spark.createDataFrame([], "task_id bigint, ts bigint, event_id bigint, command string")).collect() == []


def test_reports_keep_all_rows(spark):
    assert files.markdown(spark.range(2500)).count("\n") == 2501


def test_places_and_inserted_rows(spark):
    from mosaiq.operators import tables as T

    d = spark.range(5000).selectExpr("(id * 7919) % 5000 as a", "id as b").repartition(7)
    assert [(r.a, r.k) for r in T.numbered(d, ["a"], "k").orderBy("a").collect()] == [(k, k + 1) for k in range(5000)]
    out = T.insert(spark.range(3, 6).toDF("id").withColumn("x", F.lit("old")), spark.createDataFrame([("b",), ("a",)], "x string").withColumn("id", F.lit(None).cast("bigint")), "id", ["x"])
    assert {(r.id, r.x) for r in out.collect()} == {(3, "old"), (4, "old"), (5, "old"), (6, "a"), (7, "b")}
