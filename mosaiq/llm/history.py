"""Repeats of new records in everything accepted before, by a prefix-tree hash forest.

A record says up to two things: the hash of its content and the shot that its path names (see ``shotpaths``), or the path
as it is. Each statement has a signature. Its first symbol is a digest of what must be equal (the content, the path, or the
shot's day, camera and number); a shot's further symbols are MinHashes of the letter pairs of its album words. Equal
statements become one *entry* with the smallest id that makes them, so copies cost one entry however many there are.

The forest is a folder of *runs*. A run holds several sorted permutations of the signatures of its entries: tree 0 in the
order of the first symbol, tree t of the shots in the order of the first symbol and the t-th MinHash. A tree is cut into
buckets by ranges of the first symbol, a directory each; the manifest names the runs. ``load`` opens a forest again, in
another session too: what was accepted is never parsed or hashed again, nor written again except when runs are merged.

A batch is located by range search: only the buckets of its own first symbols are read, and of these the entries that share
a prefix with the batch. The prefix is as long as the recall target allows: on a part of the batch's shots the links found
below the long prefix (first symbol and a MinHash, in any tree) are measured against those below the first symbol, where
recall is 1; if they are fewer than ``TARGET``, or too few to tell, the prefix is widened to the first symbol for all. What is located is
verified by reading the words as a person would.

Entries of one shot are compared in one task up to ``WIDE`` of them. More are spread by locators (``locators``): two
readings of the same words always share one, so nothing is lost, and locators with many entries are cut into chunks, every
pair of chunks being a task.

Defined cases: a null hash, an empty one, and any hash of a file of size 0 say nothing; a null path says nothing; a path
that names no shot is compared as it is; rows of one id are one record, which says what any of its rows says; rows without
id are left out; an empty history or batch gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import shotpaths
from mosaiq.session import save, shared_dir, spread

#: Permutations beside the order of the first symbol.
TREES = 2
#: Share of the links below the first symbol that a longer prefix must find.
TARGET = 0.999
#: One in so many of a batch's shots is measured.
MEASURE = 16
#: Entries of a shot, or of a locator, that are compared in one task.
WIDE = 500
#: Entries for which a bucket is made, and the most and fewest buckets of a tree.
PER_BUCKET, BUCKETS, FEWEST = 16_384, 4096, 8
#: Runs from which they are merged.
RUNS = 8
#: Rows of which equal statements are put together before any shuffle.
FLUSH = 65_536

SYMBOLS = [f"m{t + 1}" for t in range(TREES)]
STATEMENT = "id bigint, s bigint, s2 bigint, words string, " + ", ".join(f"{m} int" for m in SYMBOLS)
ENTRY = "s bigint, s2 bigint, m int, words string, first bigint"
KEY = ["s", "s2", "words"]


@lru_cache(maxsize=100_000)
def symbols(words: str, trees: int = TREES) -> tuple[int, ...]:
    """MinHash symbols of the letters' pairs, words taken together, so that separators and the order of pairs don't count."""
    w = words.replace(" ", "")
    grams = {w[k : k + 2] for k in range(max(1, len(w) - 1))}
    return tuple(min(xxhash.xxh32_intdigest(g, t) for g in grams) >> 1 for t in range(trees))


def _said(path: str | None, content: str | None, size: int | None) -> Iterator[tuple[bytes, str]]:
    """What must be equal, as a digest, and the words."""
    h = shotpaths.content_hash(content, size)
    if h is not None:
        yield xxhash.xxh3_128_digest(b"h" + h.encode("utf-8", "surrogatepass")), ""
    shot = shotpaths.shot(path)
    if shot is not None:
        yield xxhash.xxh3_128_digest(b"s" + shot[0].encode("utf-8", "surrogatepass")), shot[1]
    elif path is not None:
        yield xxhash.xxh3_128_digest(b"p" + path.encode("utf-8", "surrogatepass")), ""


def _parse(batches: Iterator[pa.RecordBatch], each: bool) -> Iterator[pa.RecordBatch]:
    """Statements of rows (id, path, hash, size). ``each``: all ids; otherwise equal statements of about ``FLUSH`` rows
    are one, with the smallest id."""
    parts, held = [], 0
    for b in batches:
        ids, digests, words = [], [], []
        for i, p, h, n in zip(*(b.column(k).to_pylist() for k in range(4))):
            for d, w in _said(p, h, n):
                ids.append(i)
                digests.append(d)
                words.append(w)
        key = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        marks = np.array([symbols(w) if w else (0,) * TREES for w in words], np.int32).reshape(-1, TREES)
        cols = [pa.array(ids, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(words, pa.string())]
        t = pa.Table.from_arrays([*cols, *(pa.array(marks[:, k]) for k in range(TREES))], ["id", *KEY, *SYMBOLS])
        names = ["id", *KEY, *SYMBOLS]
        one = t.group_by(names[1:] if not each else names, use_threads=False)
        parts.append(one.aggregate([] if each else [("id", "min")]).rename_columns({} if each else {"id_min": "id"}).select(names))
        held += b.num_rows
        if held >= FLUSH:
            yield from _joined(parts, each)
            parts, held = [], 0
    yield from _joined(parts, each)


def _joined(parts: list[pa.Table], each: bool) -> Iterator[pa.RecordBatch]:
    if not parts:
        return
    t, names = pa.concat_tables(parts), ["id", *KEY, *SYMBOLS]
    if not each:
        t = t.group_by(names[1:], use_threads=False).aggregate([("id", "min")]).rename_columns({"id_min": "id"}).select(names)
    yield from t.combine_chunks().to_batches()


def statements(df: DataFrame, ident: str, each: bool = True) -> DataFrame:
    """``id, s, s2, words, m1, ...``: what each row says; without ``each``, only the smallest ids are sure to be there."""
    rows = df.where(F.col(ident).isNotNull()).select(
        F.col(ident).cast("bigint").alias("id"), F.col("path").cast("string"), F.col("hash").cast("string"), F.col("size").cast("bigint")
    )
    return spread(rows).mapInArrow(lambda it: _parse(it, each), STATEMENT)


def entries(said: DataFrame) -> DataFrame:
    """One row for each distinct statement: ``s, s2, words, m1, ..., first`` with the smallest id."""
    return said.groupBy(*KEY).agg(F.min("id").alias("first"), *[F.first(m).alias(m) for m in SYMBOLS])


def _bucket(bits: int):
    """Range of the first symbol."""
    return F.expr(f"cast(shiftrightunsigned(s, {64 - bits}) as int)") if bits else F.lit(0)


class HashForest:
    """Persisted runs of entries in a folder. ``append`` adds a run, ``merge`` makes one of all, ``search`` locates a batch,
    ``accept`` does both for the next batch."""

    def __init__(self, spark: SparkSession, root: str | None = None, runs: list[dict] | None = None, target: float = TARGET, wide: int = WIDE):
        self.spark, self.target, self.wide = spark, target, wide
        self.root = root or f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
        self.runs = runs or []
        self.depth = 0  # of the last search: symbols of the prefix

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> "HashForest":
        """The newest complete state of the forest in a folder."""
        marks = _glob(spark, f"{root}/manifest-*/_SUCCESS")
        if not marks:
            return cls(spark, root)
        newest = max(marks).rsplit("/", 1)[0]
        return cls(spark, root, json.loads(spark.read.text(newest).first()[0]))

    def _with(self, runs: list[dict]) -> "HashForest":
        n = len(_glob(self.spark, f"{self.root}/manifest-*")) + 1
        self.spark.createDataFrame([(json.dumps(runs),)], "value string").coalesce(1).write.text(f"{self.root}/manifest-{n:08d}")
        return HashForest(self.spark, self.root, runs, self.target, self.wide)

    def append(self, said: DataFrame, rows: int | None = None) -> "HashForest":
        """A run of the statements. ``rows``: about how many there are, for the number of buckets."""
        bits = _bits(said.count() if rows is None else rows)
        # statements are put together in their tasks, then by bucket: a bucket is a range of digests, so hot statements
        # meet as one row for each task
        b = said.withColumn("bucket", _bucket(bits)).repartition("bucket")
        e = b.groupBy("bucket", *KEY).agg(F.min("id").alias("first"), *[F.first(m).alias(m) for m in SYMBOLS])
        trees = [F.struct(F.lit(0).alias("tree"), F.lit(0).alias("m"))]
        trees += [F.when(F.col("words") != "", F.struct(F.lit(t + 1).alias("tree"), F.col(m).alias("m"))) for t, m in enumerate(SYMBOLS)]
        e = e.select("*", F.explode(F.filter(F.array(*trees), lambda x: x.isNotNull())).alias("x"))
        return self._write(e.select("x.tree", "bucket", "s", "s2", "x.m", "words", "first"), bits)

    def _write(self, rows: DataFrame, bits: int) -> "HashForest":
        path = f"run-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("tree", "bucket", "s", "m", "words").write.partitionBy("tree", "bucket").parquet(f"{self.root}/{path}")
        dirs = sorted(d.split(f"{path}/")[1] for d in _glob(self.spark, f"{self.root}/{path}/tree=*/bucket=*"))
        forest = self._with([*self.runs, {"path": path, "bits": bits, "dirs": dirs}])
        return forest.merge() if len(forest.runs) > RUNS else forest

    def merge(self) -> "HashForest":
        """Merge runs: equal entries become one, with the smallest id. The old runs stay for readers of older states."""
        if len(self.runs) < 2:
            return self
        bits = min(_bits(1 << 60), max(r["bits"] for r in self.runs) + (len(self.runs) - 1).bit_length())
        every = None
        for r in self.runs:
            part = self.spark.read.schema(f"{ENTRY}, tree int, bucket int").parquet(f"{self.root}/{r['path']}") if r["dirs"] else None
            every = part if every is None else every.unionByName(part) if part is not None else every
        if every is None:
            return self
        b = every.withColumn("bucket", _bucket(bits)).repartition("tree", "bucket")
        one = b.groupBy("tree", "bucket", "s", "s2", "m", "words").agg(F.min("first").alias("first"))
        return HashForest(self.spark, self.root, [], self.target, self.wide)._write(one, bits)

    def located(self, batch: DataFrame, depth: int) -> list[DataFrame]:
        """Entries of the runs that may share a prefix of ``depth`` symbols with the batch's: ``s, s2, words, first``. Only
        the buckets of the batch are read; their numbers, ``BUCKETS`` at most, reach the driver."""
        out = []
        for bits in sorted({r["bits"] for r in self.runs}):
            own = {r.b for r in batch.select(_bucket(bits).alias("b")).distinct().collect()}
            for r in (r for r in self.runs if r["bits"] == bits):
                for t in range(TREES + 1) if depth > 1 else [0]:
                    dirs = [d for d in r["dirs"] if d.startswith(f"tree={t}/") and int(d.rsplit("=", 1)[1]) in own]
                    if not dirs:
                        continue
                    e = self.spark.read.schema(ENTRY).parquet(*[f"{self.root}/{r['path']}/{d}" for d in dirs])
                    if t:
                        keys = batch.where("words != ''").select("s", F.col(SYMBOLS[t - 1]).alias("m")).distinct()
                        e = e.join(keys, ["s", "m"], "left_semi")
                    elif depth > 1:
                        e = e.where("words = ''")
                    out.append(e.select(*KEY, "first"))
        return out

    def _linked(self, batch: DataFrame, depth: int) -> DataFrame:
        """``s, s2, words, own, best`` of the batch's entries: the smallest id of equal entries, and of linked ones too."""
        every = batch.select(*KEY, "first", F.lit(True).alias("new"))
        for e in self.located(batch, depth):
            every = every.unionByName(e.withColumn("new", F.lit(False)))
        g = every.repartition("s").groupBy(*KEY).agg(F.min("first").alias("first"), F.max("new").alias("new"))
        most = self.wide
        return g.sortWithinPartitions(*KEY).mapInArrow(lambda it: scan(it, most), SCANNED)

    def _prefix(self, batch: DataFrame) -> int:
        """Symbols of the longest prefix that meets the recall target."""
        if not self.runs:
            return 1
        some = batch.where((F.col("words") != "") & (F.pmod("s2", F.lit(MEASURE)) == 0))
        wide = self._linked(some, 1).where("best < own and not wide").select(*KEY, "best")
        narrow = self._linked(some, 2).select(*KEY, F.col("best").alias("found"))
        n, hit = wide.join(narrow, KEY, "left").agg(F.count(F.lit(1)), F.count_if(F.col("found") == F.col("best"))).first()
        # too few links prove nothing: with 3 / (1 - target) of them, a share that low would show with 95 % probability
        return 2 if n * (1 - self.target) >= 3 and hit >= self.target * n else 1

    def search(self, said: DataFrame) -> DataFrame:
        """``kept_id, dup_id`` of the records in ``said`` that repeat a smaller id of any run, or of ``said`` itself."""
        said = save(said)
        batch = save(entries(said))
        self.depth = self._prefix(batch)
        best = save(self._linked(batch, self.depth))
        wide = best.where("wide")
        best = best.where("new").select(*KEY, "best")
        if not wide.isEmpty():
            best = best.unionByName(link_wide(wide, self.wide)).groupBy(*KEY).agg(F.min("best").alias("best"))
        # one row of ``best`` for many of ``said``: a hot statement is split by adaptive skew handling
        hit = said.join(best, KEY).where("best < id")
        return hit.groupBy("id").agg(F.min("best").alias("kept_id")).select("kept_id", F.col("id").alias("dup_id"))

    def accept(self, said: DataFrame) -> tuple[DataFrame, "HashForest"]:
        """The repeats of the next batch, and the forest with it."""
        said = save(said)
        return save(self.search(said)), self.append(said)


def _bits(rows: int) -> int:
    return min(BUCKETS, max(FEWEST, -(-rows // PER_BUCKET))).bit_length() - 1


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [m.getPath().toString() for m in fs.globStatus(path) or []]


SCANNED = "s bigint, s2 bigint, words string, own bigint, best bigint, new boolean, wide boolean"


def scan(batches: Iterator[pa.RecordBatch], most: int = WIDE) -> Iterator[pa.RecordBatch]:
    """Range scan of entries (s, s2, words, first, new) in the order of signatures. Of each group with the same first
    symbol the new entries come out, with the smallest id of themselves and of those linked to them. Of a group of more
    than ``most`` readings all come out, marked; no more than that is held."""
    held: pa.Table | None = None
    open_wide = None  # first symbol of a wide group that goes on
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        s, s2 = (t.column(k).to_numpy() for k in (0, 1))
        cut = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (s2[1:] != s2[:-1])])
        last = int(cut[-1])
        if t.num_rows - last > most:  # the last group is wide already: let go of it
            yield from _scanned(t, cut, most, open_wide, True)
            open_wide, held = (s[-1], s2[-1]), None
            continue
        if open_wide == (s[last], s2[last]):
            yield from _scanned(t, cut, most, open_wide, True)
            held = None
            continue
        if last:
            yield from _scanned(t.slice(0, last), cut[:-1], most, open_wide, False)
        held = t.slice(last).combine_chunks()
    if held is not None:
        yield from _scanned(held, np.array([0]), most, open_wide, False)


def _scanned(t: pa.Table, cut: np.ndarray, most: int, open_wide, last_wide: bool) -> Iterator[pa.RecordBatch]:
    n = t.num_rows
    s, s2, first = (t.column(k).to_numpy() for k in (0, 1, 3))
    new = t.column(4).to_numpy(zero_copy_only=False).astype(bool)
    own, best, wide = first, first.copy(), np.zeros(n, bool)
    size = np.diff(np.r_[cut, n])
    some_new = np.logical_or.reduceat(new, cut)
    words = t.column(2)
    for a, m in zip(cut[(size > 1) & some_new].tolist(), size[(size > 1) & some_new].tolist()):
        if m > most:
            wide[a : a + m] = True
        else:
            got = linked([*zip(words.slice(a, m).to_pylist(), first[a : a + m].tolist())])
            best[a : a + m] = got
    if open_wide is not None and (s[0], s2[0]) == open_wide:
        wide[: size[0]] = True
    if last_wide:  # the old ones of a wide group count, whether new ones have come yet or not
        wide[cut[-1] :] = True
    out = pa.RecordBatch.from_arrays(
        [pa.array(s), pa.array(s2), words.combine_chunks(), pa.array(own), pa.array(best), pa.array(new), pa.array(wide)],
        ["s", "s2", "words", "own", "best", "new", "wide"],
    )
    yield out.filter(pa.array(new | wide))


def linked(group: list[tuple[str, int]]) -> list[int]:
    """For each of the entries (words, first) of one shot, the smallest first of it and of those with the same words, as a
    person reads them."""
    best = [f for _, f in group]
    for k, (w, f) in enumerate(group):
        for j in range(k):
            v, g = group[j]
            if (best[k] > g or best[j] > f) and shotpaths.same_words(v, w):
                best[k], best[j] = min(best[k], g), min(best[j], f)
    return best


def locators(words: str) -> set[str]:
    """Strings of which two readings of the same words always share one: each word, each word without one letter (a slip
    of the pen leaves one of these in common), and each beginning and end of a word (of words run together, with one slip
    at most, the first or the last is whole)."""
    out = set()
    for w in words.split(" "):
        out.add(w)
        if len(w) > 2:
            out.update(w[:k] + w[k + 1 :] for k in range(len(w)))
        for k in range(1, len(w)):
            out.update((w[:k], w[k:]))
    return out


def link_wide(rows: DataFrame, wide: int = WIDE) -> DataFrame:
    """``s, s2, words, best`` of the new ones among many readings (``SCANNED``) of a shot."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                names = [sorted(locators(w)) for w in part.column(2).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(names)), [len(x) for x in names]))
                cols = [part.column(k).take(at) for k in (0, 1, 2, 3, 5)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x for y in names for x in y], pa.string())], ["s", "s2", "words", "first", "new", "name"])

    place = ["s", "s2", "name"]
    posts = save(rows.mapInArrow(locate, "s bigint, s2 bigint, words string, first bigint, new boolean, name string"))
    chunks = posts.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("any")).where("n > 1 and any")
    p = posts.join(chunks.select(*place, F.ceil(F.col("n") / wide).cast("int").alias("m")), place)
    p = p.withColumn("own", F.pmod(F.xxhash64("words"), F.col("m")).cast("int"))
    p = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    p = p.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("m", "other")

    def compare(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        every = [*zip(t.column("words").to_pylist(), t.column("first").to_pylist(), t.column("new").to_pylist(), t.column("own").to_pylist())]
        a = [r for r in every if r[3] == i]
        b = [r for r in every if r[3] == j]
        best: dict[str, int] = {}
        for w, f, n, _ in a:
            for v, g, m, _ in b:
                if (n or m) and f != g and shotpaths.same_words(v, w):
                    for x, is_new in ((w, n), (v, m)):
                        if is_new:
                            best[x] = min(best.get(x, f), f, g)
        k = len(best)
        key = [pa.array([t.column(c)[0].as_py()] * k, pa.int64()) for c in ("s", "s2")]
        return pa.table([*key, pa.array([*best], pa.string()), pa.array([*best.values()], pa.int64())], names=["s", "s2", "words", "best"])

    found = p.groupBy(*place, "i", "j").applyInArrow(compare, "s bigint, s2 bigint, words string, best bigint")
    return found.groupBy(*KEY).agg(F.min("best").alias("best"))


def find_repeats(images: DataFrame, new: DataFrame, wide: int = WIDE) -> DataFrame:
    """``kept_id, dup_id``: each record of ``new`` that repeats a record of smaller id, of ``images`` or ``new``. All of
    ``new`` is searched as one batch; batch by batch (``HashForest.accept``) gives the same rows."""
    forest = HashForest(new.sparkSession, wide=wide).append(statements(images, "image_id", each=False), 2 * images.count())
    return forest.search(statements(new, "new_image_id"))
