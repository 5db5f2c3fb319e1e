import random

import pytest

from mosaiq.llm import history
from mosaiq.llm.shotpaths import content_hash, same_words, shot

IMAGES = "image_id bigint, path string, hash string, size bigint, first string, kind int"
NEW = "new_image_id bigint, path string, hash string, size bigint, first string, kind int"


@pytest.mark.parametrize("path", [
    "/mnt/nas/photos/2016/2016-10-12_lakeside_hike_foggy/PXQ_5950.png", "\\volume1\\2016\\2016-10-12 foggy lakeside hike\\pxq 5950-copie.jpg",
    "file:///srv/2016/20161012+lakeside+hike+foggy/PXQ-005950 (1).jpeg", "/x/./2016//LAKESIDE-HIKE-FOGGY-12.10.2016/PXQ5950~2.JPG",
    "/x/2016/10/12/lakeside%20hike%20foggy/PXQ_5950_1600px.webp", "/x/2016/2016-10-12LakesideHikeFoggy/PXQ_5950.bak.jpg", "/x/2016/2016-10-12LAKESIDEHIKEFOGGY/PXQ_5950.jpg",
    "/x/2016/2016-10-12 lakesdie hike fogggy/PXQ_5950.jpg",
])
def test_one_shot(path):
    want = shot("/a/2016/2016-10-12_lakeside_hike_foggy/PXQ_5950.png")
    got = shot(path)
    assert got[0] == want[0] and same_words(got[1], want[1]) and same_words(want[1], got[1])


@pytest.mark.parametrize("path", [
    "/a/2016/2016-10-13_lakeside_hike_foggy/PXQ_5950.png", "/a/2016/2016-10-12_lakeside_hike_windy/PXQ_5950.png",
    "/a/2016/2016-10-12_lakeside_hike_foggy/PXQ_5951.png", "/a/2016/2016-10-12_lakeside_hike_foggy/IMG_5950.png", "/a/2016/2016-10-12_lakeside_foggy/PXQ_5950.png",
])
def test_another_shot(path):
    want, got = shot("/a/2016/2016-10-12_lakeside_hike_foggy/PXQ_5950.png"), shot(path)
    assert got[0] != want[0] or not same_words(got[1], want[1])


def test_no_shot():
    for p in (None, "", "/backup/blob/ad161a459fc1", "/var/spool/upload/cd/cd2dc43ab9cb.bin", "/x/attachment.jpg", "C:\\unsorted e8bdf4729ab0.JPG", "/x/msg-531564473079.jpg"):
        assert shot(p) is None


def test_hashes():
    h = "0062f71ecfc3dbaa" * 4
    for v in (h, h.upper(), f" {h} ", f"b3:{h}", f"BLAKE3-{h.upper()}", "-".join(h[k : k + 8] for k in range(0, 64, 8))):
        assert content_hash(v, 5) == h
    assert content_hash(h, 0) is None and content_hash("", 5) is None and content_hash(None, 5) is None and content_hash("  ", None) is None


def brute(images, new):
    every = [(r[0], *r[1:4]) for r in images + new if r[0] is not None]
    out = set()
    for d in {r[0] for r in new if r[0] is not None}:
        mine = [r for r in every if r[0] == d]
        best = d
        for k, p, h, n in every:
            if k >= best:
                continue
            for _, q, g, m in mine:
                a, b = content_hash(h, n), content_hash(g, m)
                s, t = shot(p), shot(q)
                if (a is not None and a == b) or (p is not None and p == q) or (s and t and s[0] == t[0] and same_words(s[1], t[1])):
                    best = k
                    break
        if best < d:
            out.add((best, d))
    return out


def test_against_brute_force(spark):
    r = random.Random(8)
    words = ["lakeside", "hike", "foggy", "windy", "wedding", "museum"]

    def path():
        w = r.sample(words, 3)
        if r.random() < 0.3:
            k = r.randrange(3)
            w[k] = w[k][:2] + w[k][3:]
        z = r.random()
        if z < 0.1:
            return r.choice([None, "", "/x/blob/1", "/x/blob/2"])
        return f"/r{r.randint(0, 2)}/2016-0{r.randint(1, 2)}-11 {' '.join(w)}/{r.choice(['IMG', 'CAM'])}_{r.randint(10, 14)}.jpg"

    def rows(lo, n):
        return [(r.choice([lo + k, lo + k, lo + k // 2]), path(), r.choice([None, "", f"{r.randint(0, 99):064x}", f"b3:{r.randint(0, 99):064x}", "nohex!"]), r.choice([0, 5, None]), "x", 1) for k in range(n)]

    images, new = rows(1, 120), rows(1000, 200)
    images += [(None, "/x/blob/1", None, 1, "x", 1)]
    new += [(None, "/x/blob/1", None, 1, "x", 1), (50, "/x/blob/1", None, 1, "x", 1)]
    got = {tuple(x) for x in history.find_repeats(spark.createDataFrame(images, IMAGES), spark.createDataFrame(new, NEW)).collect()}
    assert got == brute(images, new)


def _batches(r, n, lo):
    """Rows with repeats of one another, by content and by shot."""
    words = ["lakeside", "hike", "foggy", "windy", "wedding", "museum"]
    out = []
    for k in range(n):
        w = [r.choice(words), r.choice(words)]
        if r.random() < 0.3:
            w[0] = w[0][:2] + w[0][3:]
        path = f"/r/20{r.randint(10, 19)}-0{r.randint(1, 9)}-1{r.randint(0, 9)} {' '.join(w)}/IMG_{r.randint(10, 14)}.jpg"
        out.append((lo + k, path, r.choice([None, f"{r.randint(0, 3 * n):064x}"]), 5, "", 1))
    return out


def test_batches_and_merge(spark):
    """Batch by batch against the forest in its folder, opened anew each time, gives the same as all at once; runs are
    merged on the way."""
    r = random.Random(3)
    img = _batches(r, 300, 1)
    batches = [_batches(r, 60, 1000 * k) for k in range(1, 5)]
    new = [x for b in batches for x in b]
    want = {tuple(x) for x in history.find_repeats(spark.createDataFrame(img, IMAGES), spark.createDataFrame(new, NEW)).collect()}
    assert want == brute(img, new)
    forest = history.HashForest(spark).append(history.statements(spark.createDataFrame(img, IMAGES), "image_id"))
    found = set()
    for k, b in enumerate(batches):
        said = history.statements(spark.createDataFrame(b, NEW), "new_image_id")
        hits, forest = history.HashForest.load(spark, forest.root).accept(said)
        found |= {tuple(x) for x in hits.collect()}
        if k == 1:
            forest = forest.merge()
            assert len(forest.runs) == 1
    assert found == want and len(history.HashForest.load(spark, forest.root).runs) == 3


def test_second_batch_reads_few_bytes(spark):
    """Only the ranges that a batch names are read; nothing of the history is parsed again."""
    import os

    n = 200_000
    img = spark.range(1, n + 1).selectExpr("id as image_id", "concat('/blob/', id) as path", "sha2(cast(id as string), 256) as hash", "cast(5 as bigint) as size")
    forest = history.HashForest(spark).append(history.statements(img, "image_id"), 2 * n)
    b = spark.createDataFrame([(n + 5, "/blob/77", None, 5, "", 1)], NEW)
    batch = history.entries(history.statements(b, "new_image_id"))
    size = lambda files: sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in files)
    read = size([f for e in forest.located(batch, 1) for f in e.inputFiles()])
    whole = size([f"{d}/{f}" for d, _, fs in os.walk(forest.root.removeprefix("file:")) for f in fs if f.endswith(".parquet")])
    assert 0 < read < 0.1 * whole
    assert [tuple(x) for x in history.HashForest.load(spark, forest.root).search(history.statements(b, "new_image_id")).collect()] == [(77, n + 5)]


@pytest.mark.parametrize("target,depth", [(0.999, 1), (0.5, 2)])
def test_prefix_is_widened_until_the_target(spark, target, depth):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(900)]
    path = lambda k, w: f"/r/2011-01-11 {w}/IMG_{1000 + k}.jpg"
    img = [(k, path(k, w), None, 5, "", 1) for k, w in enumerate(words)]
    new = [(5000 + k, path(k, w[:3] + w[4:]), None, 5, "", 1) for k, w in enumerate(words)]
    forest = history.HashForest(spark, target=target).append(history.statements(spark.createDataFrame(img, IMAGES), "image_id"))
    got = {tuple(x) for x in forest.search(history.statements(spark.createDataFrame(new, NEW), "new_image_id")).collect()}
    assert forest.depth == depth and got <= {(k, 5000 + k) for k in range(900)}
    assert len(got) == 900 if depth == 1 else len(got) > 400


def test_many_readings_of_one_shot(spark):
    """Beyond WIDE entries of a shot nothing is lost: slips, words run together, hot words over several chunks."""
    r = random.Random(2)
    base = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(150)]
    slip = lambda w: r.choice([w[:2] + w[3:], w[:2] + "z" + w[3:], w[:1] + w[2] + w[1] + w[3:], w[:3] + w[2:]])
    path = lambda w: f"/r/2011-01-11 {w}/IMG_1000.jpg"
    img = [(k, path(f"{w} hike"), None, 5, "", 1) for k, w in enumerate(base)]
    new = [(1000 + k, path(r.choice([f"{slip(w)} hike", f"hike{w}", f"{w}hike", f"hike{slip(w)}"])), None, 5, "", 1) for k, w in enumerate(base)]
    new += [(2000 + k, path(f"{w} tour"), None, 5, "", 1) for k, w in enumerate(base[:30])]
    got = {tuple(x) for x in history.find_repeats(spark.createDataFrame(img, IMAGES), spark.createDataFrame(new, NEW), wide=40).collect()}
    assert got == brute(img, new) and len(got) >= 150
    for i, n in zip(img, new):
        a, b = shot(i[1]), shot(n[1])
        assert not same_words(a[1], b[1]) or history.locators(a[1]) & history.locators(b[1])


def test_empty(spark):
    e1, e2 = spark.createDataFrame([], IMAGES), spark.createDataFrame([], NEW)
    assert history.find_repeats(e1, e2).collect() == []
