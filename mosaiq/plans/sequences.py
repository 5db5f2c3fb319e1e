"""Queries of order-dependent algorithms, matching, streams and files."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions import geometry as G
from mosaiq.functions import quality as Q
from mosaiq.functions import vectors as V
from mosaiq.operators import patches as P
from mosaiq.operators import sequential as K
from mosaiq.operators import similarity as S
from mosaiq.operators import tables as T
from mosaiq.operators import visual as W
from mosaiq.plans import fixtures as X
from mosaiq.plans.evaluations import LOO as MEANS
from mosaiq.plans.evaluations import to_means
from mosaiq.plans.registry import Registry
from mosaiq.plans.relational import VIEWS, ff
from mosaiq.plans.searches import H, hist
from mosaiq.session import read, shared_dir
from mosaiq.sources import files
from mosaiq.streaming import events as E

R = Registry()
queries = lambda: R.functions
oracle_sql = lambda: R.sql
c = F.col


def boxes(s, d) -> DataFrame:
    """Boxes of each image; the detectors' boxes are few for an image."""
    f = ff(s, d).where("image_id is not null")
    return f.selectExpr("image_id", "face_id", "detector_score as score", *[f"cast(bbox_{k} as double) as {k}" for k in "xywh"])


@R.query()
def k05_hard_nms(s, d):
    return K.hard_nms(boxes(s, d), "image_id", "face_id", "score")


@R.query()
def k03_cell_nms(s, d):
    return K.cell_nms(boxes(s, d), "image_id", "face_id", 4032.0, 3024.0)


@R.query()
def k04_soft_nms(s, d):
    return K.soft_nms(boxes(s, d), "image_id", "face_id", "score")


@R.query()
def k06_point_nms(s, d):
    return K.point_nms(X.faces(s, d).select("identity", "face_id", "det", "x", "y"), "identity", "face_id", "det")


def gallery(s, d) -> DataFrame:
    return X.faces(s, d).withColumn("kind", Q.prototype_type(c("yaw"), c("quality")))


@R.query()
def k08_select_prototypes(s, d):
    return K.select_prototypes(gallery(s, d))


@R.query()
def k09_fill_prototypes(s, d):
    return K.fill_prototypes(gallery(s, d))


@R.query()
def k10_rebuild(s, d):
    """The table of prototypes after a rebuild: the old ones (three of each person) stay, retired; the new ones have ids
    after them."""
    f = gallery(s, d)
    old = T.best_per_group(f.where("person_id is not null"), ["person_id"], [c("face_id")], 3)
    old = T.numbered(old.select("person_id", "face_id"), ["person_id", "face_id"], "prototype_id").withColumn("is_active", F.lit(False))
    new = K.select_prototypes(f).select("person_id", "face_id", F.lit(None).cast("bigint").alias("prototype_id"), F.lit(True).alias("is_active"))
    return T.insert(old, new, "prototype_id", ["person_id", "face_id"]).select("prototype_id", "person_id", "face_id", "is_active")


@R.query()
def k01_online_clusters(s, d):
    return K.online_clusters(X.faces(s, d), "image_id", K.by_votes(0.7, 0.02, 10))


@R.query()
def k02_clusters_by_prototypes(s, d):
    return K.online_clusters(X.faces(s, d), "image_id", K.by_prototypes(0.7, 0.02))


@R.query()
def k02_clusters_by_nearest(s, d):
    return K.online_clusters(X.faces(s, d), "image_id", K.by_nearest(0.3))


CHAIN = f"""with recursive {X.FACES}, pos as (select identity, generate_subscripts(vector, 1) as pos, unnest(vector) as x from faces), m as (select identity, pos, avg(x) as m from pos group by all),
l as (select identity, sqrt(sum(m * m)) as l from m group by 1), st as (select identity as pair, list(m / l order by pos) as c0 from m join l using (identity) group by 1),
v as (select (identity + 9) % 10 as pair, row_number() over (partition by identity order by face_id) as step, vector from faces),
r as (select pair, 0::bigint as step, false as captured, c0, c0 as c from st union all
select r.pair, v.step, round(list_dot_product(r.c, v.vector), 6) >= 0.3, r.c0, case when round(list_dot_product(r.c, v.vector), 6) >= 0.3 then
 list_transform(list_zip(r.c, v.vector), lambda z: (0.9 * z[1] + 0.1 * z[2]) / sqrt(0.81 * list_dot_product(r.c, r.c) + 0.18 * list_dot_product(r.c, v.vector) + 0.01 * list_dot_product(v.vector, v.vector))) else r.c end
from r join v on v.pair = r.pair and v.step = r.step + 1)
select pair, step, captured, round(1 - list_dot_product(c0, c), 5) as drift from r where step > 0"""


@R.query(CHAIN)
def k12_chain_capture(s, d):
    """The faces of every identity come one by one to the cluster of the identity before it."""
    f = X.faces(s, d)
    g = S.vector_sums(f, "identity", "vector").select(c("key").alias("pair"), c("sum").alias("vector"))
    return K.chain_capture(f, (c("identity") + 9) % 10, g, 0.3).withColumn("drift", F.round("drift", 5))


def _ratio_matches(ab: DataFrame, ba: DataFrame, *keys: str) -> DataFrame:
    """``ab``: the two best of each a, ``ba``: the best of each b; ``keys`` are the columns that both have beside."""
    pick = lambda k, v: F.max(F.when(c("rank") == k, c(v)))
    near = ab.groupBy(*keys, c("qid").alias("a")).agg(pick(1, "id").alias("b"), pick(1, "score").alias("s1"), pick(2, "score").alias("s2"))
    j = near.join(ba.select(*keys, c("qid").alias("b"), c("id").alias("a")), [*keys, "a", "b"])
    dist = lambda x: F.sqrt(F.greatest(2 - 2 * x, F.lit(0.0)))
    ok = F.round(dist(c("s1")), 6) < F.round(0.98 * dist(F.coalesce("s2", F.lit(-1e9))), 6)
    return j.where(ok).select(*keys, "a", "b", c("s1").alias("score"))


MATCH = f"""with {X.FACES}, p as (select a.identity, a.face_id as a, b.face_id as b, round(list_dot_product(a.vector, b.vector), 6) as s from faces a join faces b on a.identity = b.identity and a.face_id % 2 = 0 and b.face_id % 2 = 1),
x as (select *, row_number() over (partition by a order by s desc, b) as ra, row_number() over (partition by b order by s desc, a) as rb from p),
f as (select a, max(b) filter (where ra = 1) as b, max(s) filter (where ra = 1) as s1, max(s) filter (where ra = 2) as s2 from x group by a)
select x.identity, f.a, f.b, f.s1 as score from f join x on x.a = f.a and x.b = f.b where x.rb = 1 and round(sqrt(greatest(2 - 2 * f.s1, 0)), 6) < round(0.98 * sqrt(greatest(2 - 2 * coalesce(f.s2, -1e9), 0)), 6)"""


@R.query(MATCH)
def k07_ratio_match(s, d):
    """Mutual nearest neighbours between the two halves of every identity whose distance is under .98 of the second one's; a
    single candidate always passes."""
    f = X.faces(s, d)
    a, b = f.where("face_id % 2 = 0"), f.where("face_id % 2 = 1")
    return _ratio_matches(S.knn_within(a, b, 2, "identity"), S.knn_within(b, a, 1, "identity"), "identity")


CENT = f"""with {X.FACES}, {X.QUERIES}, cen as (select person_id as cluster, vector as cv from faces where person_id is not null qualify row_number() over (partition by person_id order by quality desc, face_id) = 1)
select qid, cluster, round(list_dot_product(qv, cv), 6) as score from q, cen qualify row_number() over (partition by qid order by round(list_dot_product(qv, cv), 6) desc, cluster) = 1"""


@R.query(CENT)
def k14_best_centroid(s, d):
    f = X.faces(s, d)
    cen = T.best_per_group(f.where("person_id is not null"), ["person_id"], [F.desc("quality"), c("face_id")])
    # centroids get ids of their own below all faces', so that none is taken for the query itself
    g = cen.select((-1 - c("person_id")).alias("face_id"), "vector")
    h = S.knn(X.face_queries(f), g, 1)
    return h.select("qid", (-1 - c("id")).cast("bigint").alias("cluster"), "score")


LOO = f"""with {X.FACES}, pos as (select person_id, face_id, generate_subscripts(vector, 1) as pos, unnest(vector) as x from faces where person_id is not null),
m as (select *, (sum(x) over (partition by person_id, pos) - x) / (count(*) over (partition by person_id, pos) - 1) as o from pos)
select person_id, face_id, round(sum(x * o) / sqrt(sum(o * o)), 6) as score, round(sum(x * o) / sqrt(sum(o * o)), 6) >= 0.8 as accepted from m group by all"""


@R.query(LOO)
def k15_e15_leave_one_out(s, d):
    """Cosine of each face to the mean of the person's others, from sums: (sum - x) / (n - 1)."""
    f = X.faces(s, d).where("person_id is not null")
    g = S.vector_sums(f, "person_id", "vector").select(c("key").alias("person_id"), "sum", "weight")
    j = f.join(g, "person_id").where("weight > 1").withColumn("o", V.subtract("sum", "vector"))
    score = F.round(V.dot("vector", "o") / V.norm("o"), 6)
    return j.select("person_id", "face_id", score.alias("score")).withColumn("accepted", c("score") >= 0.8)


CASC = f"""with {VIEWS}, a as (select * from ff where detector_origin = 'Primary'), b as (select * from ff where detector_origin <> 'Primary'),
m as (select a.face_id as pa, b.face_id as pb from a join b using (image_id) where a.bbox_x is not null and
 greatest(0, least(a.bbox_x::double + a.bbox_w::double, b.bbox_x::double + b.bbox_w::double) - greatest(a.bbox_x::double, b.bbox_x::double)) * greatest(0, least(a.bbox_y::double + a.bbox_h::double, b.bbox_y::double + b.bbox_h::double) - greatest(a.bbox_y::double, b.bbox_y::double))
 >= 0.3 * (a.bbox_w::double * a.bbox_h::double + b.bbox_w::double * b.bbox_h::double) / 1.3)
select 'both' as origin, count(*) as n from m union all select 'primary', count(*) from a where face_id not in (select pa from m) union all select 'secondary', count(*) from b where face_id not in (select pb from m)"""


@R.query(CASC)
def k16_two_detectors(s, d):
    """Boxes of two detectors joined by an overlap of .3 or more within an image."""
    f = ff(s, d).where("image_id is not null")
    side = lambda p, cond: f.where(cond).select("image_id", c("face_id").alias(p), *[c(f"bbox_{k}").cast("double").alias(p + k) for k in "xywh"])
    a, b = side("a", "detector_origin = 'Primary'"), side("b", "detector_origin <> 'Primary'")
    iou = G.iou(tuple(c("a" + k) for k in "xywh"), tuple(c("b" + k) for k in "xywh"))
    m = a.join(b, "image_id").where(iou >= 0.3)
    n = lambda df, name: df.agg(F.lit(name).alias("origin"), F.count(F.lit(1)).alias("n"))
    left = lambda x, p: x.join(m.select(p), p, "left_anti")
    every = ff(s, d)
    pa = left(every.where("detector_origin = 'Primary'").select(c("face_id").alias("a")), "a")
    pb = left(every.where("detector_origin <> 'Primary'").select(c("face_id").alias("b")), "b")
    return T.union_all([n(m, "both"), n(pa, "primary"), n(pb, "secondary")])


@R.query()
def s14_patch_search(s, d):
    """Faces as descriptors with their boxes' corners as points; queries are each hundredth image."""
    f = X.faces(s, d).select("image_id", "face_id", "x", "y", "vector")
    cen = np.array([r.vector for r in f.where("face_id < 8").orderBy("face_id").collect()])
    return P.patch_search(f.where("image_id % 100 = 0"), f, cen, ratio=0.99, least=1)


@R.query()
def g14_g15_ransac(s, d):
    """Point pairs of each identity: the second point is the first under a fixed map, for two in three."""
    f = X.faces(s, d)
    u = F.when(c("face_id") % 3 > 0, 1.1 * c("x") + 0.2 * c("y") + 3).otherwise(c("w"))
    v = F.when(c("face_id") % 3 > 0, -0.1 * c("x") + 0.9 * c("y") - 2).otherwise(c("h"))
    return K.match_geometry(f.select("identity", c("face_id").alias("ident"), "x", "y", u.alias("u"), v.alias("v")), "identity")


@R.query(H + " select same, cast(sum(n) as bigint) as pairs, cast(coalesce(sum(n) filter (where score >= 0.5), 0) as bigint) as over from h group by 1")
def k13_pair_counts(s, d):
    """Pairs of equal and of different identity, and those of a score of .5 or more, by the block kernel."""
    return hist(s, d).groupBy("same").agg(F.sum("n").alias("pairs"), F.sum(F.when(c("score") >= 0.5, c("n")).otherwise(0)).alias("over"))


# ---- streams
@R.query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by all")
def st11_windows(s, d):
    return E.windowed(read(s, d, "events"))


def stream_of(s, d) -> DataFrame:
    """The events table as a stream of files."""
    e = read(s, d, "events")
    rows = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/[e]vents.parquet")
    return rows.withColumn("ts", c("ts").cast("timestamp"))


@R.query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by all")
def st06_stream_windows(s, d):
    """The same by a stream that keeps its counts and writes them after every micro-batch; the last one holds."""
    root = f"{shared_dir(s)}/windows-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    E.run_available(E.windowed(stream_of(s, d)), "update", write)
    rows = s.read.parquet(root)
    w = Window.partitionBy("start", "event_type").orderBy(F.desc("batch"))
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select("start", "event_type", "n", "value")


@R.query("select distinct event_id, event_type from events")
def st08_stream_dedup(s, d):
    return s.read.parquet(E.run_available(E.deduplicated(stream_of(s, d), ["event_id"]).select("event_id", "event_type")))


TASKS = """with recursive e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as k from events),
r as (select user_id, 0::bigint as k, null::varchar as status, 0 as retries from (select distinct user_id from events) union all
select r.user_id, e.k, case when e.event_type = 'signup' and (r.status is null or r.status in ('completed', 'failed', 'cancelled')) then 'pending' when e.event_type = 'view' and r.status = 'pending' then 'running'
 when e.event_type = 'click' and r.status = 'running' then 'completed' when e.event_type = 'error' and r.status = 'running' then case when r.retries < 3 then 'pending' else 'failed' end
 when e.event_type = 'purchase' and r.status in ('pending', 'running') then 'cancelled' else r.status end,
case when e.event_type = 'signup' and (r.status is null or r.status in ('completed', 'failed', 'cancelled')) then 0 when e.event_type = 'error' and r.status = 'running' and r.retries < 3 then r.retries + 1 else r.retries end
from r join e on e.user_id = r.user_id and e.k = r.k + 1)
select user_id as task_id, status, retries, k as events from r qualify row_number() over (partition by user_id order by k desc) = 1"""


@R.query(TASKS)
def st01_task_states(s, d):
    """A user's events as commands of a task: signup enqueues, view claims, click completes, error fails (tried again three
    times), purchase cancels."""
    commands = {"signup": "enqueue", "view": "claim", "click": "complete", "error": "fail", "purchase": "cancel"}
    e = read(s, d, "events").select(c("user_id").alias("task_id"), "ts", "event_id", F.create_map(*[F.lit(x) for kv in commands.items() for x in kv])[c("event_type")].alias("command"))
    return E.run_tasks(e)


@R.query("select user_id, event_type, ts from (select user_id as user_id, max(struct_pack(a := ts, b := event_id, c := event_type)) as z from events group by 1) t, lateral (select z.c as event_type, z.a as ts)")
def st01_last_events(s, d):
    return E.task_states(read(s, d, "events")).select(c("task_id").alias("user_id"), c("status").alias("event_type"), "ts")


@R.query("select user_id, ts, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_type desc) = 1")
def st07_idempotent_upsert(s, d):
    """Micro-batches under their own numbers; the newest row of each key on reading."""
    root = f"{shared_dir(s)}/upserts-{uuid.uuid4().hex}"
    rows = stream_of(s, d).select("user_id", "ts", "event_type")
    E.run_available(rows, "append", E.upsert_batches(root, ["user_id"], ["ts", "event_type"]))
    return E.latest(s, root, ["user_id"], ["ts", "event_type"])


@R.query("select " + ", ".join(f"count(*) filter (where event_id % 5 = {k}) as {n}" for k, n in enumerate(["queued", "processing", "completed", "failed", "finished"])) + " from events")
def st06_progress(s, d):
    return E.progress(read(s, d, "events"))


@R.query(MEANS + ", k as (select face_id, row_number() over (order by face_id) as k from faces), b as (select face_id, max(score) as best from r group by 1) select cast((k - 1) // 5 as bigint) as run, count(*) as faces, count(*) filter (where best >= 0.5) as assigned, count(*) = 5 as complete from k join b using (face_id) group by 1")
def st05_count_triggers(s, d):
    """Every five new faces a run: how many of them are near enough to an identity's mean to be assigned. The last run may
    not have been triggered."""
    best = to_means(s, d).groupBy("face_id").agg(F.max("score").alias("best"))
    k = T.numbered(best, ["face_id"], "k")
    g = k.groupBy(F.floor((c("k") - 1) / 5).alias("run")).agg(F.count(F.lit(1)).alias("faces"), F.count_if(c("best") >= 0.5).alias("assigned"))
    return g.withColumn("complete", c("faces") == 5)


@R.query("select event_id, cast((k - 1) % 4 as bigint) as worker, k as place from (select event_id, row_number() over (order by ts, event_id) as k from events)")
def st10_round_robin(s, d):
    """Events dealt to four workers by their place, worked on apart, and put back in order."""
    dealt = T.numbered(read(s, d, "events").select("event_id", "ts"), ["ts", "event_id"], "k")
    worked = dealt.withColumn("worker", F.pmod(c("k") - 1, F.lit(4))).repartition(4, "worker")
    return T.numbered(worked, ["k"], "place").select("event_id", "worker", "place")


@R.query("select start, event_type, count(*) as n, round(sum(value), 4) as value from (select time_bucket(interval '12 hours', ts) - interval '12 hours' * o.o as start, event_type, value from events, (select unnest([0, 1]) as o) o) group by all")
def st11_sliding_windows(s, d):
    return E.windowed(read(s, d, "events"), "1 day", "12 hours")


JOINED = "select a.event_id as view_id, b.event_id as purchase_id from events a join events b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'purchase' and b.ts >= a.ts and b.ts < a.ts + interval '1 hour'"


@R.query(JOINED)
def st11_stream_join(s, d):
    """Views and the purchases of the same user within an hour, by two streams with watermarks."""
    return s.read.parquet(E.run_available(E.within(stream_of(s, d), stream_of(s, d), "view", "purchase")))


@R.query("select count(*) as kept from events where ts >= (select max(ts) from events) - interval '1 hour'")
def st11_late_rows(s, d):
    """A second delivery of all events after the first one: what is later than the watermark allows is dropped."""
    e = read(s, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return E.kept_of_second_delivery(e)


@R.query("select batch_id as generation, count(*) as n from new_images where batch_id = (select max(batch_id) from new_images) group by 1")
def st09_newest_generation(s, d):
    n = read(s, d, "new_images")
    last = n.agg(F.max("batch_id").alias("batch_id"))
    return T.lookup(n, last, "batch_id").groupBy(c("batch_id").alias("generation")).agg(F.count(F.lit(1)).alias("n"))


SESS = """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new from events),
h as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g) select user_id, min(ts) as start, max(ts) + interval '30 minutes' as "end", count(*) as n from h group by user_id, k"""


@R.query(SESS)
def st11_sessions(s, d):
    return E.sessions(read(s, d, "events"))


# ---- files
@R.query()
def src01_src03_file_scan(s, d):
    """The tables' files with what a scan of images notes; no decoder knows them, so width and height are 0."""
    def measure(file):  # reads all of it, in pieces
        while file.read(1 << 20):
            pass
        raise ValueError("no image")

    f = W.image_sizes(files.scan_files(s, d, ["parquet"]), measure)
    return f.select(Q.base_name(c("path")).alias("name"), "size", "ext", "mime", c("modified_at").alias("captured_at"), "width", "height")


@R.query("""with px as (select vec_id, k, cast(round_even(greatest(least((embedding[k + 1]::double + 4) * 32, 255), 0), 0) as bigint) as g from embeddings, range(0, 64) t(k)),
l as (select a.vec_id, 4 * a.g - (select sum(b.g) from px b where b.vec_id = a.vec_id and b.k in (a.k - 1, a.k + 1, a.k - 8, a.k + 8)) as l from px a where a.k % 8 between 1 and 6 and a.k // 8 between 1 and 6),
h as (select vec_id, -sum(n / 64.0::double * log2(n / 64.0::double)) as entropy from (select vec_id, g, count(*) as n from px group by all) group by 1),
v as (select vec_id, var_pop(l) as v from l group by 1)
select vec_id, 8 as width, 8 as height, round(v.v, 4) as laplacian, round(least(1.0, v.v / 100), 6) as blur_score, round(entropy, 6) as entropy, round((select var_pop(g / 255.0::double) from px where px.vec_id = v.vec_id), 6) as variance, (select count(distinct g) from px where px.vec_id = v.vec_id) as colours, 0.0::double as saturation from v join h using (vec_id)""")
def f06_f18_pixel_figures(s, d):
    """Embeddings of 64 elements read as grey images of 8 x 8 pixels."""
    e = read(s, d, "embeddings").select("vec_id", c("embedding").alias("content"))
    f = W.image_figures(e, lambda x: np.rint(np.clip((np.asarray(x, float) + 4) * 32, 0, 255)).reshape(8, 8), "vec_id")
    return f.select("vec_id", "width", "height", F.round("laplacian", 4).alias("laplacian"), *[F.round(k, 6).alias(k) for k in ("blur_score", "entropy", "variance")], "colours", "saturation")


@R.query("select face_id, len(vector) as n from (select vec_id as face_id, embedding as vector from embeddings)")
def src08_src09_index_round_trip(s, d):
    root = f"{shared_dir(s)}/indexes-{uuid.uuid4().hex}"
    e = read(s, d, "embeddings").select(c("vec_id").alias("face_id"), c("embedding").alias("vector"))
    files.save_index(e.limit(1), root)
    files.save_index(e, root)
    return files.newest_index(s, root).select("face_id", F.size("vector").cast("bigint").alias("n"))


@R.query("select image_id as id, path from images where path is not null group by all")
def src14_tsv_round_trip(s, d):
    root = f"{shared_dir(s)}/pairs-{uuid.uuid4().hex}"
    i = read(s, d, "images").where("path is not null").select("image_id", "path").distinct()
    i.select(F.concat_ws("\t", "image_id", "path").alias("value")).write.text(root)
    return files.read_pairs(s, root)


@R.query("select lower(scan_status) as status, count(*) as n from images group by 1")
def src11_json_report(s, d):
    root = f"{shared_dir(s)}/report-{uuid.uuid4().hex}"
    files.write_report(read(s, d, "images").groupBy(F.lower("scan_status").alias("status")).agg(F.count(F.lit(1)).alias("n")), root)
    return s.read.schema("status string, n bigint").json(root)
