import numpy as np

from mosaiq.operators import visual as I


def decode(data):
    return np.frombuffer(data, np.uint8).reshape(8, 8)


def test_figures_and_hooks(spark):
    a = (np.indices((8, 8)).sum(0) % 2 * 255).astype(np.uint8).tobytes()
    df = spark.createDataFrame([("a", bytearray(a)), ("b", bytearray(b"xx")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in I.image_figures(df, decode).collect()}
    assert got["a"].colours == 2 and got["a"].blur_score == 1.0 and got["b"].width is None and got["c"].entropy is None
    e = I.embed(df, "content", lambda: lambda xs: np.array([[len(x), 1.0] for x in xs]), ["path"]).collect()
    assert {(r.path, None if r.embedding is None else tuple(r.embedding)) for r in e} == {("a", (64.0, 1.0)), ("b", (2.0, 1.0)), ("c", None)}


def test_resize_and_colours():
    a = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert I.resize(a, 4).shape == (4, 4) and I.resize(a, 9) is a
    assert I.saturation(np.zeros((2, 2, 3), np.uint8)) == 0.0
    red = np.zeros((2, 2, 3), np.uint8)
    red[..., 0] = 255
    assert abs(I.saturation(red) - 1) < 1e-6 and I.colours(red) == 1


def test_regions():
    g = np.zeros((40, 60), np.uint8)
    g[5:25, 5:25] = 200
    g[15:35, 40:55] = 120
    assert I.segments(g, 50, 10).max() == 2
    assert (5, 5, 20, 20) in I.regions(g, 50, 10, 5) and (40, 15, 15, 20) in I.regions(g, 50, 10, 5)


def test_head_pose():
    front = I.FACE_MODEL[:, :2] * 100 + 50
    y, p, r = I.head_pose(front)
    assert abs(y) < 1e-6 and abs(p) < 1e-6 and abs(r) < 1e-6
    t = np.radians(20)
    turn = np.array([[np.cos(t), 0, np.sin(t)], [0, 1, 0], [-np.sin(t), 0, np.cos(t)]])
    assert abs(I.head_pose((I.FACE_MODEL @ turn.T)[:, :2] * 100)[0] - 20) < 1e-6
    roll = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    assert abs(I.head_pose(front @ roll.T)[2] - 20) < 1e-6
    assert I.head_pose(np.zeros((5, 2))) is None


def test_sizes_of_files_too_large_for_a_row(spark, tmp_path):
    """Files are opened where they are measured; 3 GB (a hole) can't be the content of a row."""
    from mosaiq.plans import sequences
    from mosaiq.sources import files
    from mosaiq.session import share_code

    share_code(spark)
    for name, n in (("a b%20.parquet", 5), ("huge.parquet", 3 << 30), ("bad.parquet", 9)):
        with open(tmp_path / name, "wb") as f:
            f.truncate(n)

    def measure(f):
        at = f.seek(0, 2)
        return at >> 20, 7 // (9 - at)

    got = {r.path.rsplit("/", 1)[1]: (r["size"], r.mime is None, r.width, r.height) for r in I.image_sizes(files.scan_files(spark, str(tmp_path), ["parquet"]), measure).collect()}
    mime = got["huge.parquet"][1]
    assert got == {"a b%20.parquet": (5, mime, 0, 1), "huge.parquet": (3 << 30, mime, 3072, -1), "bad.parquet": (9, mime, 0, 0)}
    rows = sequences.queries()["src01_src03_file_scan"](spark, str(tmp_path)).collect()
    assert {(r["name"], r["size"], r.width, r.height) for r in rows} == {("a b%20.parquet", 5, 0, 0), ("huge.parquet", 3 << 30, 0, 0), ("bad.parquet", 9, 0, 0)}
    gone = spark.createDataFrame([("file:/no/such.jpg",), (None,)], "path string")
    assert [(r.width, r.height) for r in I.image_sizes(gone, measure).collect()] == [(0, 0), (0, 0)]
