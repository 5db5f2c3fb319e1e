"""Queries of sources, predicates, joins, aggregates, rankings, sets and changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators import tables as T
from mosaiq.plans import fixtures as X
from mosaiq.plans.registry import Registry
from mosaiq.session import norm_text, read, save, shared_dir
from mosaiq.sources import files

R = Registry()
queries = lambda: R.functions
oracle_sql = lambda: R.sql
c = F.col


class _Rows:
    """Number of rows, made when it is used: no session is needed to import this."""

    def alias(self, name: str):
        return F.count(F.lit(1)).alias(name)


N = _Rows()

#: One row a face, image, person and assignment; the newest delivery holds.
VIEWS = """
ff as (select * exclude (embedding, ingested_at), embedding from face_features qualify row_number() over (partition by face_id order by ingested_at desc) = 1),
im as (select * from images qualify row_number() over (partition by image_id order by updated_at desc) = 1),
pe as (select * from persons qualify row_number() over (partition by person_id order by updated_at desc) = 1),
fa as (select distinct assignment_id, face_id, person_id, similarity, confidence, method, status, model_version, created_at from face_person_assignments)
"""


def ff(s, d) -> DataFrame:
    return T.best_per_group(read(s, d, "face_features"), ["face_id"], [F.desc("ingested_at")]).drop("ingested_at")


def im(s, d) -> DataFrame:
    return T.best_per_group(read(s, d, "images"), ["image_id"], [F.desc("updated_at")])


def pe(s, d) -> DataFrame:
    return T.best_per_group(read(s, d, "persons"), ["person_id"], [F.desc("updated_at")])


def fa(s, d) -> DataFrame:
    return read(s, d, "face_person_assignments").drop("ingested_at").distinct()


def q(sql: str):
    return R.query(f"with {X.FACES}, {VIEWS} {sql}" if "faces" in sql.split() else f"with {VIEWS} {sql}")


# ---- sources
@q("select image_id, path, size from im")
def src04_table_scan(s, d):
    return im(s, d).select("image_id", "path", "size")


@q("select image_id, path, hash from im where hash = (select min(hash) from im where length(hash) = 64)")
def src05_point_lookup(s, d):
    i = im(s, d)
    key = i.where("length(hash) = 64").agg(F.min("hash").alias("hash"))
    return T.lookup(i, key, "hash").select("image_id", "path", "hash")


@q("select image_id, path from im where image_id in (select image_id from ff where status = 'failed')")
def src06_batch_lookup(s, d):
    return T.lookup(im(s, d), ff(s, d).where("status = 'failed'"), "image_id").select("image_id", "path")


@q("select face_id, image_id, len(embedding) as n from ff where model_version = 'facenetlike-r50@v1.4.2' and embedding is not null")
def src07_embedding_scan(s, d):
    f = ff(s, d).where("model_version = 'facenetlike-r50@v1.4.2' and embedding is not null")
    return f.select("face_id", "image_id", F.size("embedding").cast("bigint").alias("n"))


@q("select image_id, path from im order by path, image_id limit 50 offset 100")
def src02_paged_listing(s, d):
    return T.page(im(s, d), [c("path"), c("image_id")], 100, 50).select("image_id", "path")


@q("select event_id, ts, user_id % 4 as priority, case when event_id = (select event_id from events where event_id % 5 = 0 order by user_id % 4 desc, ts, event_id limit 1) then 'running' else 'pending' end as status from events where event_id % 5 = 0")
def src12_claim_task(s, d):
    """The task of the highest priority, the oldest of these, changes its state; the queue after it."""
    e = read(s, d, "events").where("event_id % 5 = 0").select("event_id", "ts", (c("user_id") % 4).alias("priority"), F.lit("pending").alias("status"))
    claimed = e.orderBy(F.desc("priority"), "ts", "event_id").limit(1).select("event_id", F.lit("running").alias("status"))
    return T.update(e, F.broadcast(claimed), "event_id", ["status"])


# ---- predicates
@q("select face_id, status from ff where status = 'indexed'")
def pred01_equality(s, d):
    return ff(s, d).where("status = 'indexed'").select("face_id", "status")


@q("select (select count(*) from fa where person_id is null) as missing, (select count(*) from fa where person_id is not null) as present")
def pred02_null_tests(s, d):
    return fa(s, d).agg(F.count(F.when(c("person_id").isNull(), 1)).alias("missing"), F.count("person_id").alias("present"))


@q("select face_id from ff where status = 'pending' and model_version = 'facenetlike-r50@v2.1.0'")
def pred03_composite(s, d):
    return ff(s, d).where("status = 'pending' and model_version = 'facenetlike-r50@v2.1.0'").select("face_id")


@q("select assignment_id, person_id, similarity from fa where similarity::double >= 0.5 and confidence::double >= 0.6")
def pred04_thresholds(s, d):
    return fa(s, d).where("similarity >= 0.5 and confidence >= 0.6").select("assignment_id", "person_id", "similarity")


@q("select method, status, count(*) as n from fa where method <> status group by all")
def pred05_inequality(s, d):
    return fa(s, d).where("method != status").groupBy("method", "status").agg(N.alias("n"))


@q("select fa.assignment_id, ff.image_id from fa join ff using (face_id) where ff.image_id <> 1278 and fa.person_id = 17")
def pred06_exclude_image(s, d):
    return fa(s, d).where("person_id = 17").join(ff(s, d), "face_id").where("image_id != 1278").select("assignment_id", "image_id")


@q("select assignment_id from fa where coalesce(lower(trim(status)), '') <> 'rejected'")
def pred07_active_only(s, d):
    return fa(s, d).where(F.coalesce(norm_text(c("status")), F.lit("")) != "rejected").select("assignment_id")


@q("select a.face_id, b.face_id as other from ff a join ff b on a.image_id = b.image_id and a.face_id <> b.face_id")
def pred08_not_itself(s, d):
    a, b = ff(s, d).select("face_id", "image_id"), ff(s, d).selectExpr("face_id as other", "image_id")
    return a.join(b, "image_id").where("face_id != other").select("face_id", "other")


@q("select image_id from im where lower(scan_status) = 'indexed' and captured_at between timestamp '2015-01-01' and timestamp '2016-01-01' and face_count >= 2")
def pred09_optional_filter(s, d):
    i = im(s, d).where(F.lower("scan_status") == "indexed")
    return i.where("captured_at between timestamp '2015-01-01' and timestamp '2016-01-01' and face_count >= 2").select("image_id")


@q("select face_id, round(case when abs(yaw) > 45 then detector_score::double * 0.7 else detector_score::double end, 6) as score from ff where detector_score::double >= 0.5 and bbox_w > 20 and bbox_h > 20 and bbox_x >= 0 and bbox_y >= 0")
def pred10_detector_filter(s, d):
    f = ff(s, d).where("detector_score >= 0.5 and bbox_w > 20 and bbox_h > 20 and bbox_x >= 0 and bbox_y >= 0")
    sc = F.when(F.abs("yaw") > 45, c("detector_score").cast("double") * 0.7).otherwise(c("detector_score").cast("double"))
    return f.select("face_id", F.round(sc, 6).alias("score"))


@q("select face_id from ff where detector_score::double >= 0.3 and face_area_score::double >= 0.15 and pose_score::double >= 0.15 and quality_score::double >= 0.45")
def pred11_f07_quality_filter(s, d):
    return ff(s, d).where("detector_score >= 0.3 and face_area_score >= 0.15 and pose_score >= 0.15 and quality_score >= 0.45").select("face_id")


# ---- joins
@q("select fa.assignment_id, ff.image_id, fa.person_id from fa join ff using (face_id)")
def j01_hits_with_faces(s, d):
    return fa(s, d).join(ff(s, d), "face_id").select("assignment_id", "image_id", "person_id")


@q("select ff.face_id, im.path, im.object_count from ff join im using (image_id)")
def j02_j03_with_images(s, d):
    return ff(s, d).select("face_id", "image_id").join(im(s, d), "image_id").select("face_id", "path", "object_count")


@q("select ff.face_id, coalesce(im.path, '') as path from ff left join im using (image_id)")
def j04_left_with_default(s, d):
    return ff(s, d).select("face_id", "image_id").join(im(s, d), "image_id", "left").select("face_id", F.coalesce("path", F.lit("")).alias("path"))


@q("select ff.face_id, fa.assignment_id from ff join fa using (face_id) where fa.person_id is null and ff.embedding is not null and ff.model_version = fa.model_version")
def j05_unassigned_with_vectors(s, d):
    f = ff(s, d).where("embedding is not null").select("face_id", "model_version")
    return f.join(fa(s, d).where("person_id is null").select("face_id", "model_version", "assignment_id"), ["face_id", "model_version"]).select("face_id", "assignment_id")


@q("select fa.assignment_id, ff.face_id from fa join ff on ff.face_id = fa.face_id and ff.image_id <> fa.person_id where fa.method = 'prototype'")
def j06_prototypes_with_faces(s, d):
    return fa(s, d).where("method = 'prototype'").join(ff(s, d), "face_id").where("image_id != person_id").select("assignment_id", "face_id")


@q("select fa.assignment_id, ff.quality_score, im.size from fa left join ff using (face_id) left join im using (image_id)")
def j07_two_left(s, d):
    f = ff(s, d).select("face_id", "image_id", "quality_score")
    return fa(s, d).join(f, "face_id", "left").join(im(s, d).select("image_id", "size"), "image_id", "left").select("assignment_id", "quality_score", "size")


@q("select pe.person_id, count(*) as n, round(avg(ff.quality_score::double), 6) as quality from pe join fa using (person_id) join ff using (face_id) group by 1")
def j08_persons_faces(s, d):
    f = ff(s, d).select("face_id", "quality_score")
    j = pe(s, d).select("person_id").join(fa(s, d), "person_id").join(f, "face_id")
    return j.groupBy("person_id").agg(N.alias("n"), F.round(F.avg(c("quality_score").cast("double")), 6).alias("quality"))


@q("select fa.assignment_id, ff.image_id, len(ff.embedding) as n from fa join ff using (face_id) where fa.person_id = 17")
def j09_one_person(s, d):
    j = fa(s, d).where("person_id = 17").join(ff(s, d), "face_id")
    return j.select("assignment_id", "image_id", F.when(c("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("n"))


@q("select face_id from ff where not exists (select 1 from fa where fa.face_id = ff.face_id)")
def j10_anti(s, d):
    return T.delete(ff(s, d), fa(s, d), "face_id").select("face_id")


@q("select face_id from ff where exists (select 1 from im where im.image_id = ff.image_id and im.size > 5000000)")
def j11_semi(s, d):
    return T.lookup(ff(s, d), im(s, d).where("size > 5000000"), "image_id").select("face_id")


@q("select fa.assignment_id, pe.person_id from fa left join pe using (person_id)")
def j12_orphan_repair(s, d):
    return T.set_null_where_missing(fa(s, d), pe(s, d), "person_id", "person_id").select("assignment_id", "person_id")


FULL = """, a as (select person_id, max(similarity) as face from fa where method = 'prototype' group by 1),
b as (select person_id, max(similarity) as body from fa where method = 'centroid' group by 1)
select coalesce(a.person_id, b.person_id) as person_id, a.face, b.body from a full join b on a.person_id = b.person_id where coalesce(a.person_id, b.person_id) is not null"""


@R.query(f"with {VIEWS}{FULL}")
def j13_full_outer(s, d):
    x = fa(s, d).where("person_id is not null")
    a = x.where("method = 'prototype'").groupBy("person_id").agg(F.max("similarity").alias("face"))
    b = x.where("method = 'centroid'").groupBy("person_id").agg(F.max("similarity").alias("body"))
    return a.join(b, "person_id", "full_outer").select("person_id", "face", "body")


EXPAND = """, h as (select image_id, max(score) as score from (select ff.image_id, fa.person_id, fa.confidence as score from fa join ff using (face_id) where fa.confidence between 0.97 and 1) group by 1),
p as (select fa.person_id, max(fa.confidence) as score from fa where fa.confidence between 0.97 and 1 and fa.person_id is not null group by 1),
e as (select ff.image_id, max(p.score) as score from fa join p using (person_id) join ff using (face_id) where ff.image_id not in (select image_id from h) group by 1)
select image_id, round(score::double, 6) as score, 'hit' as kind from h union all select image_id, round(score::double, 6), 'expanded' from e"""


@R.query(f"with {VIEWS}{EXPAND}")
def j14_person_expansion(s, d):
    f = ff(s, d).select("face_id", "image_id")
    strong = fa(s, d).where("confidence between 0.97 and 1")
    hits = strong.join(f, "face_id").groupBy("image_id").agg(F.max("confidence").alias("score"))
    persons = strong.where("person_id is not null").groupBy("person_id").agg(F.max("confidence").alias("score"))
    more = fa(s, d).join(persons, "person_id").join(f, "face_id").groupBy("image_id").agg(F.max("score").alias("score"))
    more = T.delete(more, hits, "image_id")
    both = hits.withColumn("kind", F.lit("hit")).unionByName(more.withColumn("kind", F.lit("expanded")))
    return both.select("image_id", F.round(c("score").cast("double"), 6).alias("score"), "kind")


PAIRS = """, p as (select least(face_id, person_id) as a, greatest(face_id, person_id) as b, max(similarity) as score from fa where person_id is not null group by all)
select fa.assignment_id, round(coalesce(p.score, 0)::double, 6) as score from fa left join p on p.a = least(fa.face_id, fa.person_id) and p.b = greatest(fa.face_id, fa.person_id)"""


@R.query(f"with {VIEWS}{PAIRS}")
def j17_symmetric_lookup(s, d):
    a, b = F.least("face_id", "person_id").alias("a"), F.greatest("face_id", "person_id").alias("b")
    x = fa(s, d)
    p = x.where("person_id is not null").groupBy(a, b).agg(F.max("similarity").alias("score"))
    # rows without a person have no second key and can't match
    j = x.select("assignment_id", F.when(c("person_id").isNotNull(), a).alias("a"), F.when(c("person_id").isNotNull(), b).alias("b"))
    return j.join(p, ["a", "b"], "left").select("assignment_id", F.round(F.coalesce(c("score").cast("double"), F.lit(0.0)), 6).alias("score"))


R.sql["j17_symmetric_lookup"] = R.sql["j17_symmetric_lookup"] + " and fa.person_id is not null"


@q("select im.image_id, ff.face_id, ff.bbox_x, ff.bbox_y from im left join ff using (image_id)")
def j18_boxes(s, d):
    return im(s, d).select("image_id").join(ff(s, d).select("image_id", "face_id", "bbox_x", "bbox_y"), "image_id", "left")


# ---- aggregates
@q("select (select count(*) from im) as images, (select count(*) from ff) as faces, (select count(*) from pe) as persons, (select count(*) from fa) as assignments")
def a01_counts(s, d):
    def n(df, name):
        return df.agg(N.alias(name))

    return n(im(s, d), "images").join(n(ff(s, d), "faces")).join(n(pe(s, d), "persons")).join(n(fa(s, d), "assignments"))


@q("select person_id, count(*) filter (where status = 'confirmed') as confirmed, count(*) filter (where confidence::double > 0.8) as sure from fa where person_id is not null group by 1")
def a02_conditional_counts(s, d):
    return fa(s, d).where("person_id is not null").groupBy("person_id").agg(
        F.count_if(c("status") == "confirmed").alias("confirmed"), F.count_if(c("confidence") > 0.8).alias("sure")
    )


@q("select coalesce(status, '<NULL>') as status, count(*) as n from ff group by 1")
def a03_by_status(s, d):
    return ff(s, d).groupBy(F.coalesce("status", F.lit("<NULL>")).alias("status")).agg(N.alias("n"))


@q("select distinct coalesce(model_version, '<NULL>') as version from face_features")
def a04_distinct_versions(s, d):
    return read(s, d, "face_features").select(F.coalesce("model_version", F.lit("<NULL>")).alias("version")).distinct()


@q("select coalesce(max(batch_id), 0) as generation, coalesce(max(case when path is null then batch_id end), 0) as pathless, coalesce(max(batch_id) filter (where batch_id < 0), 0) as none from new_images")
def a05_max_or_zero(s, d):
    top = lambda x, name: F.coalesce(F.max(x), F.lit(0)).cast("bigint").alias(name)
    b = c("batch_id")
    return read(s, d, "new_images").agg(top(b, "generation"), top(F.when(c("path").isNull(), b), "pathless"), top(F.when(b < 0, b), "none"))


@q("select pe.person_id, coalesce(n, 0) as n from pe left join (select person_id, count(*) as n from fa group by 1) using (person_id)")
def a06_recomputed_counts(s, d):
    n = fa(s, d).where("person_id is not null").groupBy("person_id").agg(N.alias("n"))
    return pe(s, d).join(n, "person_id", "left").select("person_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@q("select hash, count(*) as n from im where hash <> '' group by 1 having count(*) > 1")
def a07_m02_duplicate_groups(s, d):
    return im(s, d).where("hash != ''").groupBy("hash").agg(N.alias("n")).where("n > 1")


@q("select (select count(*) from im) as images, (select sum(size) from im) as bytes, (select count(*) from ff where status = 'indexed') as indexed, (select count(distinct person_id) from fa) as persons")
def a08_library_statistics(s, d):
    i = im(s, d).agg(N.alias("images"), F.sum("size").cast("decimal(38,0)").alias("bytes"))
    f = ff(s, d).agg(F.count_if(c("status") == "indexed").alias("indexed"))
    return i.join(f).join(fa(s, d).agg(F.countDistinct("person_id").alias("persons")))


@q("select count(*) filter (where event_id % 5 = 0) as pending, count(*) filter (where event_id % 5 = 1) as running, count(*) filter (where event_id % 5 = 2) as done, count(*) filter (where event_id % 5 = 3) as failed, count(*) filter (where event_id % 5 = 4) as cancelled from events")
def a09_task_counts(s, d):
    names = ["pending", "running", "done", "failed", "cancelled"]
    return read(s, d, "events").agg(*[F.count_if(c("event_id") % 5 == k).alias(n) for k, n in enumerate(names)])


@q("select face_id, person_id, round(sum(similarity::double), 6) as votes, round(max(similarity::double), 6) as best from fa where person_id is not null group by all")
def a10_votes(s, d):
    v = c("similarity").cast("double")
    return fa(s, d).where("person_id is not null").groupBy("face_id", "person_id").agg(F.round(F.sum(v), 6).alias("votes"), F.round(F.max(v), 6).alias("best"))


@q("select person_id, count(*) as n, min(confidence) as least, median(confidence::double) as mid, max(confidence) as most from fa where person_id is not null and confidence between 0 and 1 group by 1")
def a12_dataset_statistics(s, d):
    x = fa(s, d).where("person_id is not null and confidence between 0 and 1")
    return x.groupBy("person_id").agg(N.alias("n"), F.min("confidence").alias("least"), F.median(c("confidence").cast("double")).alias("mid"), F.max("confidence").alias("most"))


PROBS = {"p01": 0.01, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}


def _ranks(k: str) -> str:
    return ", ".join(f"round(max(case when k = {k.format(p=p)} then v end), 6) as {n}" for n, p in PROBS.items())


DIST = "with {views}, x as (select method, confidence::double as v, row_number() over (partition by method order by confidence) - 1 as k, count(*) over (partition by method) as n from fa where confidence between 0 and 1) select method, n, round(avg(v), 6) as mean, {r} from x group by method, n"


@R.query(DIST.format(views=VIEWS, r=_ranks("floor({p} * (n - 1) + 0.5)")))
def a13_distribution(s, d):
    x = fa(s, d).where("confidence between 0 and 1").select("method", c("confidence").cast("double").alias("v"))
    r = T.nearest_rank(x, ["method"], "v", PROBS)
    return r.select("method", "n", *[F.round(k, 6).alias(k) for k in ("mean", *PROBS)])


@q("select case when quality_score::double < 0.3 then 'a' when quality_score::double < 0.5 then 'b' when quality_score::double < 0.7 then 'c' else 'd' end as bucket, count(*) as n, round(median(detector_score::double), 6) as det from ff where quality_score is not null group by 1 having count(*) >= 10")
def a14_buckets(s, d):
    x = c("quality_score")
    b = F.when(x < 0.3, "a").when(x < 0.5, "b").when(x < 0.7, "c").otherwise("d")
    g = ff(s, d).where(x.isNotNull()).groupBy(b.alias("bucket")).agg(N.alias("n"), F.round(F.median(c("detector_score").cast("double")), 6).alias("det"))
    return g.where("n >= 10")


@q("select count(*) as candidates, count(*) filter (where size = 0) as empty, count(*) filter (where hash is null or hash = '') as unhashed, count(distinct batch_id) as batches from new_images")
def a15_scan_summary(s, d):
    n = read(s, d, "new_images")
    return n.agg(N.alias("candidates"), F.count_if(c("size") == 0).alias("empty"), F.count_if(c("hash").isNull() | (c("hash") == "")).alias("unhashed"), F.countDistinct("batch_id").alias("batches"))


@q("select least(count(distinct hash), 1001) as colours from im")
def a16_capped_distinct(s, d):
    return im(s, d).agg(F.least(F.countDistinct("hash"), F.lit(1001)).alias("colours"))


# ---- rankings
@q("select image_id, face_id, quality_score from ff where quality_score is not null qualify row_number() over (partition by image_id order by quality_score desc, face_id) = 1")
def a11_w01_best_per_group(s, d):
    f = ff(s, d).where("quality_score is not null").select("image_id", "face_id", "quality_score")
    return T.best_per_group(f, ["image_id"], [F.desc("quality_score"), c("face_id")])


@q("select person_id, row_number() over (order by n desc, person_id) as rank, n from (select person_id, count(*) as n from fa where person_id is not null group by 1) order by n desc, person_id limit 100")
def w02_numbering(s, d):
    top = fa(s, d).where("person_id is not null").groupBy("person_id").agg(N.alias("n")).orderBy(F.desc("n"), "person_id").limit(100)
    return T.ranked(top, [], [F.desc("n"), c("person_id")]).select("person_id", c("rank").cast("bigint").alias("rank"), "n")


@q("select image_id, face_id, detector_score from ff where detector_score is not null qualify row_number() over (partition by image_id order by detector_score::double * case when detector_origin = 'Primary' then 1.0 else 0.85 end desc, face_id) = 1")
def w03_weighted_best(s, d):
    f = ff(s, d).where("detector_score is not null").select("image_id", "face_id", "detector_score", "detector_origin")
    w = c("detector_score").cast("double") * F.when(c("detector_origin") == "Primary", 1.0).otherwise(0.85)
    return T.best_per_group(f, ["image_id"], [w.desc(), c("face_id")]).drop("detector_origin")


@q("select face_id, count(*) as candidates, round((max(similarity) filter (where r = 1))::double - (max(similarity) filter (where r = 2))::double, 6) as gap from (select *, row_number() over (partition by face_id order by similarity desc) as r from fa where similarity is not null) group by 1")
def w04_top_two_gap(s, d):
    x = fa(s, d).where("similarity is not null").withColumn("v", c("similarity").cast("double"))
    return T.top_two_gap(x, ["face_id"], "v").select("face_id", "candidates", F.round("gap", 6).alias("gap"))


@q("select assignment_id, round(similarity::double - (select max(b.similarity)::double from fa b where b.face_id = fa.face_id and b.similarity < fa.similarity), 6) as margin from fa where similarity is not null")
def w05_gap_to_next_lower(s, d):
    x = fa(s, d).where("similarity is not null").select("assignment_id", "face_id", c("similarity").cast("double").alias("v"))
    return T.gap_to_next_lower(x, "face_id", "v").select("assignment_id", F.round("margin", 6).alias("margin"))


@q("select face_id, assignment_id, row_number() over (partition by face_id order by similarity desc, assignment_id) as rank from fa where similarity is not null qualify rank <= 3")
def w07_top_candidates(s, d):
    x = fa(s, d).where("similarity is not null").select("face_id", "assignment_id", "similarity")
    o = [F.desc("similarity"), c("assignment_id")]
    return T.ranked(T.best_per_group(x, ["face_id"], o, 3), ["face_id"], o).select("face_id", "assignment_id", c("rank").cast("bigint").alias("rank"))


@q("select image_id, detector_origin, face_id from ff qualify row_number() over (partition by image_id, detector_origin order by face_id) <= 2")
def w08_quota(s, d):
    return T.best_per_group(ff(s, d).select("image_id", "detector_origin", "face_id"), ["image_id", "detector_origin"], [c("face_id")], 2)


@q("select person_id, count(*) filter (where k <= floor(0.6 * n)) as gallery, count(*) filter (where k > floor(0.6 * n)) as query from (select person_id, row_number() over (partition by person_id order by md5(assignment_id::varchar), assignment_id) as k, count(*) over (partition by person_id) as n from fa where person_id is not null) group by 1")
def w09_gallery_split(s, d):
    x = fa(s, d).where("person_id is not null").select("person_id", "assignment_id")
    n = x.groupBy("person_id").agg(N.alias("n"))
    r = T.ranked(x, ["person_id"], [F.md5(c("assignment_id").cast("string")), c("assignment_id")], "k").join(n, "person_id")
    g = c("k") <= F.floor(F.lit(0.6) * c("n"))
    return r.groupBy("person_id").agg(F.count_if(g).alias("gallery"), F.count_if(~g).alias("query"))


# ---- order, pages, sets
@q("select face_id, quality_score from ff order by quality_score desc nulls last, face_id limit 100")
def l01_l03_ordered_top(s, d):
    return ff(s, d).select("face_id", "quality_score").orderBy(F.desc_nulls_last("quality_score"), "face_id").limit(100)


@q("select image_id, (select count(*) from im) as total from im order by image_id limit 20 offset 40")
def l02_page_with_total(s, d):
    return T.page_with_total(im(s, d).select("image_id"), [c("image_id")], 40, 20)


@q("select face_id from ff order by image_id, bbox_w::double * bbox_h::double desc, face_id limit 200")
def l04_multi_key(s, d):
    return ff(s, d).orderBy("image_id", (c("bbox_w").cast("double") * c("bbox_h").cast("double")).desc(), "face_id").limit(200).select("face_id")


@q("select event_id from (select * from events where event_id % 5 = 0 order by event_id limit 500) where event_type = (select min(event_type) from events)")
def l06_filter_after_limit(s, d):
    e = read(s, d, "events")
    kind = e.agg(F.min("event_type").alias("event_type"))
    return T.lookup(e.where("event_id % 5 = 0").orderBy("event_id").limit(500), kind, "event_type").select("event_id")


@q("select face_id, 'a' as kind from ff where quality_score::double > 0.8 union all select face_id, 'b' from ff where detector_score::double > 0.8")
def u01_bag_union(s, d):
    f = ff(s, d)
    return T.union_all([f.where("quality_score > 0.8").select("face_id", F.lit("a").alias("kind")), f.where("detector_score > 0.8").select("face_id", F.lit("b").alias("kind"))])


@q("select face_id from ff where quality_score::double > 0.8 union select face_id from ff where detector_score::double > 0.8")
def u02_union(s, d):
    f = ff(s, d)
    return f.where("quality_score > 0.8").select("face_id").union(f.where("detector_score > 0.8").select("face_id")).distinct()


@q("select image_id, hash from im where hash is not null qualify row_number() over (partition by hash order by image_id) = 1")
def u03_first_by_key(s, d):
    return T.best_per_group(im(s, d).where("hash is not null").select("image_id", "hash"), ["hash"], [c("image_id")])


@q("select face_id from ff except select face_id from fa")
def u04_difference(s, d):
    return ff(s, d).select("face_id").subtract(fa(s, d).select("face_id"))


@q("select face_id from ff where quality_score::double > 0.5 intersect select face_id from fa where confidence::double > 0.9")
def u05_intersection(s, d):
    return ff(s, d).where("quality_score > 0.5").select("face_id").intersect(fa(s, d).where("confidence > 0.9").select("face_id"))


# ---- changes
@q("select image_id, path from im union all select (select max(image_id) from im) + row_number() over (order by new_image_id), path from (select new_image_id, min(path) as path from new_images group by 1)")
def m01_insert(s, d):
    i = im(s, d).select("image_id", "path")
    rows = read(s, d, "new_images").groupBy("new_image_id").agg(F.min("path").alias("path"))
    return T.insert(i, rows, "image_id", ["new_image_id"])


@q("select person_id, name, face_count from persons qualify row_number() over (partition by person_id order by updated_at desc) = 1")
def m03_insert_or_replace(s, d):
    p = read(s, d, "persons")
    return T.upsert(p.where("person_id % 2 = 0"), p.where("person_id % 2 = 1"), ["person_id"], [F.desc("updated_at")]).select("person_id", "name", "face_count")


@q("select image_id, case when image_id in (select image_id from ff where status = 'failed') then 'failed' else scan_status end as scan_status from im")
def m04_m05_update(s, d):
    failed = ff(s, d).where("status = 'failed'").select("image_id", F.lit("failed").alias("scan_status")).distinct()
    return T.update(im(s, d), failed, "image_id", ["scan_status"]).select("image_id", "scan_status")


@q("select fa.assignment_id from fa join ff using (face_id) where ff.image_id not in (select image_id from im where size = 0)")
def m06_delete_cascade(s, d):
    faces = T.delete(ff(s, d), im(s, d).where("size = 0"), "image_id")
    return T.lookup(fa(s, d), faces, "face_id").select("assignment_id")


@q("select person_id, name, face_count, not (face_count is null or face_count = 0) as is_active, case when face_count is null or face_count = 0 then 'deleted' else status end as status from pe")
def m07_soft_delete(s, d):
    """Persons without faces stay, marked; reading the active ones leaves them out."""
    p = pe(s, d).select("person_id", "name", "face_count", "status").withColumn("is_active", F.lit(True))
    gone = p.where("face_count is null or face_count = 0").select("person_id", F.lit(False).alias("is_active"), F.lit("deleted").alias("status"))
    return T.update(p, gone, "person_id", ["is_active", "status"]).select("person_id", "name", "face_count", "is_active", "status")


@q("select 'active' as state, count(*) as n from pe where face_count <> 0 union all select 'deleted', count(*) from pe where face_count is null or face_count = 0 union all select 'visible faces', count(*) from fa join pe using (person_id) where pe.face_count <> 0")
def m07_reading_after_soft_delete(s, d):
    p = m07_soft_delete(s, d)
    faces = T.lookup(fa(s, d).where("person_id is not null"), p.where("is_active"), "person_id")
    n = lambda x, name: x.agg(F.lit(name).alias("state"), N.alias("n"))
    return T.union_all([n(p.where("is_active"), "active"), n(p.where("not is_active"), "deleted"), n(faces, "visible faces")])


GOOD = "embedding is not null and len(embedding) = 128 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))"


def _index(s, d):
    """Three phases: all rows pending; what can be inserted goes to a new index in the shared folder; then the states
    follow from what the index holds. The index and the states."""
    pending = ff(s, d).select("face_id", "embedding", F.lit("pending").alias("status"))
    e = c("embedding")
    good = (F.size(e) == 128) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    root = f"{shared_dir(s)}/indexes-{uuid.uuid4().hex}"
    files.save_index(pending.where(e.isNotNull() & good).select("face_id", c("embedding").alias("vector")), root)
    index = files.newest_index(s, root)
    in_it = index.select("face_id", F.lit("indexed").alias("status"))
    states = T.update(pending.select("face_id", "status"), in_it, "face_id", ["status"])
    return index, states.withColumn("status", F.when(c("status") == "pending", "failed").otherwise(c("status")))


@q(f"select face_id, case when coalesce({GOOD}, false) then 'indexed' else 'failed' end as status from ff")
def m08_m09_index_write(s, d):
    return _index(s, d)[1]


@q(f"select face_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total from ff where {GOOD} and face_id not in (select face_id from fa where lower(trim(status)) = 'rejected' and face_id is not null)")
def m09_index_rebuild(s, d):
    """A new version of the index from the indexed rows, without the faces of rejected assignments; readers find the newest
    version."""
    index, states = _index(s, d)
    root = f"{shared_dir(s)}/indexes-{uuid.uuid4().hex}"
    files.save_index(index, root)
    rejected = fa(s, d).where(norm_text(c("status")) == "rejected").select("face_id")
    kept = T.delete(T.lookup(index, states.where("status = 'indexed'"), "face_id"), rejected, "face_id")
    files.save_index(kept, root)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return files.newest_index(s, root).select("face_id", F.round(total, 4).alias("total"))


@q("select image_id, path, 0::bigint as face_count, 0::bigint as object_count, 'pending' as scan_status, (select max(generation) from (select coalesce(max(batch_id), 0) + 1 as generation from new_images)) as generation from im")
def m10_reset(s, d):
    """Everything is to be indexed anew, under the next generation; nothing else of the images is lost."""
    g = read(s, d, "new_images").agg((F.coalesce(F.max("batch_id"), F.lit(0)) + 1).alias("generation"))
    zero = F.lit(0).cast("bigint")
    return im(s, d).select("image_id", "path", zero.alias("face_count"), zero.alias("object_count"), F.lit("pending").alias("scan_status")).join(F.broadcast(g))


@q("select count(*) as rows, 0::bigint as left_over, count(distinct face_id) as ids from ff")
def m11_migration_copies_all(s, d):
    """The new table holds a row for each old one, and none is left over."""
    old, new = ff(s, d), m11_migration(s, d)
    lost = T.delete(old.select("face_id"), new, "face_id").agg(N.alias("left_over"))
    return new.agg(N.alias("rows"), F.countDistinct("face_id").alias("ids")).join(lost).select("rows", "left_over", "ids")


@q("select face_id, image_id, bbox_x as x, bbox_y as y, bbox_w as w, bbox_h as h, 1 as schema_version from ff")
def m11_migration(s, d):
    """Copied into a table of the new schema, which is then read."""
    return save(ff(s, d).selectExpr("face_id", "image_id", "bbox_x as x", "bbox_y as y", "bbox_w as w", "bbox_h as h", "1 as schema_version"))
