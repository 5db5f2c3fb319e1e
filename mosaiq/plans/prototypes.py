"""Queries of vectors that stand for a group: means, medians, medoids, residual sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators import similarity as S
from mosaiq.operators import tables as T
from mosaiq.operators.hotkeys import key_ranks
from mosaiq.plans import fixtures as X
from mosaiq.plans.registry import Registry

R = Registry()
queries = lambda: R.functions
oracle_sql = lambda: R.sql
c = F.col

POS = "pos as (select person_id, face_id, quality, det, blur, w, h, generate_subscripts(vector, 1) - 1 as pos, unnest(vector) as x from faces where person_id is not null)"


def _out(df: DataFrame, vec) -> DataFrame:
    return df.select(c("key").alias("person_id"), F.posexplode(vec).alias("pos", "v")).select("person_id", "pos", F.round("v", 6).alias("v"))


def _unit(inner: str) -> str:
    """SQL: rows (person_id, pos, v) to unit length."""
    return f"with {X.FACES}, {POS}, r as ({inner}), n as (select person_id, sqrt(sum(v * v)) as n from r group by 1) select person_id, cast(pos as int) as pos, round(case when n > 0 then v / n else v end, 6) as v from r join n using (person_id)"


def assigned(s, d):
    return X.faces(s, d).where("person_id is not null")


def means(f: DataFrame, weight=None) -> DataFrame:
    g = S.vector_sums(f, "person_id", "vector", weight)
    return g.select("key", V.scale("sum", 1.0 / c("weight")).alias("vector"))


@R.query(_unit("select person_id, pos, avg(x) as v from pos group by all"))
def v10_v22_mean(s, d):
    return _out(means(assigned(s, d)), V.normalise("vector"))


@R.query(f"with {X.FACES}, {POS} select person_id, cast(pos as int) as pos, round(avg(x), 6) as v from pos group by all")
def v20_plain_mean(s, d):
    return _out(means(assigned(s, d)), c("vector"))


@R.query(_unit("select person_id, pos, avg(x) as v from pos where face_id in (select face_id from faces where person_id is not null qualify row_number() over (partition by person_id order by quality desc, face_id) <= 5) group by all"))
def v20_first_k_mean(s, d):
    w = Window.partitionBy("person_id").orderBy(F.desc("quality"), "face_id")
    f = assigned(s, d).withColumn("k", F.row_number().over(w)).where("k <= 5")
    return _out(means(f), V.normalise("vector"))


WEIGHT = "det * (0.5 + blur) * (0.5 + least(w, h) / 200)"


@R.query(_unit(f"select person_id, pos, sum(x * {WEIGHT}) / sum({WEIGHT}) as v from pos group by all"))
def v11_weighted_fusion(s, d):
    return _out(means(assigned(s, d), F.expr(WEIGHT)), V.normalise("vector"))


def _per_position(s, d, agg):
    at = S.positions(assigned(s, d), "person_id", "vector").groupBy("key", "pos").agg(agg.alias("x"))
    return S.gather_positions(at)


@R.query(_unit("select person_id, pos, x as v from (select *, row_number() over (partition by person_id, pos order by x) - 1 as k, count(*) over (partition by person_id, pos) as n from pos) where k = n // 2"))
def v17_median(s, d):
    at = _ranked(s, d, {"median": F.floor(c("n") / 2) + 1}).select("key", "pos", c("value").alias("x"))
    return _out(S.gather_positions(at), V.normalise("vector"))


def _ranked(s, d, ranks: dict) -> DataFrame:
    """``key, pos, prob, value`` of the elements of each person and position; no task gathers a person's."""
    p = S.positions(assigned(s, d), "person_id", "vector").withColumn("at", c("key") * 4096 + c("pos"))
    return key_ranks(p, "at", "x", ranks).select((c("key") / 4096).cast("bigint").alias("key"), (c("key") % 4096).cast("int").alias("pos"), "prob", "value")


@R.query(_unit("select person_id, pos, exp(avg(ln(greatest(abs(x), 1e-10)))) as v from pos group by all"))
def v18_geometric_mean(s, d):
    return _out(_per_position(s, d, F.exp(F.avg(F.log(F.greatest(F.abs("x"), F.lit(1e-10)))))), V.normalise("vector"))


@R.query(f"with {X.FACES}, {POS} select person_id, cast(pos as int) as pos, round(exp(avg(ln(greatest(x, 1e-8)))), 6) as v from pos group by all")
def v28_signed_geometric_mean(s, d):
    return _out(_per_position(s, d, F.exp(F.avg(F.log(F.greatest(c("x"), F.lit(1e-8)))))), c("vector"))


@R.query(f"with {X.FACES}, {POS}, k as (select *, row_number() over (partition by person_id, pos order by x, face_id) - 1 as k, count(*) over (partition by person_id, pos) as n from pos) select person_id, cast(pos as int) as pos, round(avg(x), 6) as v from k where k >= greatest(1, cast(floor(n * 0.1) as bigint)) and k < n - greatest(1, cast(floor(n * 0.1) as bigint)) group by all")
def v27_trimmed_mean(s, d):
    # between the first and the last value kept: those inside count once, the two ends as often as they are needed
    cut = F.greatest(F.lit(1), F.floor(c("n") * 0.1))
    ends = _ranked(s, d, {"first": cut + 1, "last": c("n") - cut})
    ends = ends.groupBy("key", "pos").agg(*[F.max(F.when(c("prob") == k, c("value"))).alias(k) for k in ("first", "last")])
    p = S.positions(assigned(s, d), "person_id", "vector").join(ends.where("first is not null and last is not null"), ["key", "pos"])
    x, one = c("x"), lambda cond: F.count_if(cond)
    g = p.groupBy("key", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.first("first").alias("a"), F.first("last").alias("z"), F.sum(F.when((x > c("first")) & (x < c("last")), x).otherwise(0.0)).alias("inside"),
        one((x > c("first")) & (x < c("last"))).alias("m"), one(x < c("first")).alias("below"), one(x <= c("first")).alias("upto"),
    )
    left = c("n") - 2 * cut
    low = F.when(c("a") == c("z"), left).otherwise(c("upto") - cut)
    mean = (c("inside") + c("a") * low + c("z") * F.when(c("a") == c("z"), 0).otherwise(left - c("m") - low)) / left
    return _out(S.gather_positions(g.select("key", "pos", mean.alias("x"))), c("vector"))


MEDOID = f"""with {X.FACES}, {POS}, m as (select person_id, pos, avg(x) as m from pos group by all),
s as (select p.person_id, face_id, round(sum(x * m), 6) as score from pos p join m using (person_id, pos) group by all)
select person_id, face_id, score from s qualify row_number() over (partition by person_id order by score desc, face_id) = 1"""


@R.query(MEDOID)
def v19_medoid(s, d):
    f = assigned(s, d)
    j = f.join(means(f).select(c("key").alias("person_id"), c("vector").alias("m")), "person_id")
    j = j.select("person_id", "face_id", F.round(V.dot("vector", "m"), 6).alias("score"))
    w = Window.partitionBy("person_id").orderBy(F.desc("score"), "face_id")
    return j.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


PAIR_MEDOID = f"""with {X.FACES}, s as (select a.person_id, a.face_id, round(avg(list_dot_product(a.vector, b.vector)), 6) as score
from faces a join faces b on a.person_id = b.person_id and a.face_id <> b.face_id group by all)
select person_id, face_id, score from s qualify row_number() over (partition by person_id order by score desc, face_id) = 1"""


@R.query(PAIR_MEDOID)
def v29_pairwise_medoid(s, d):
    # the mean over the others in closed form: (x . sum - x . x) / (n - 1); no pairs are formed
    f = assigned(s, d)
    g = S.vector_sums(f, "person_id", "vector").select(c("key").alias("person_id"), "sum", "weight")
    j = f.join(g, "person_id").where("weight > 1")
    score = (V.dot("vector", "sum") - V.dot("vector", "vector")) / (c("weight") - 1)
    j = j.select("person_id", "face_id", F.round(score, 6).alias("score"))
    w = Window.partitionBy("person_id").orderBy(F.desc("score"), "face_id")
    return j.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


VLAD = f"""with {X.FACES}, cen as (select face_id as cid, vector as cv from faces where face_id < 8),
a as (select f.face_id, f.image_id, f.vector, cid, cv, row_number() over (partition by f.face_id order by round(list_sum(list_transform(list_zip(f.vector, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), cid) as k from faces f, cen),
r as (select image_id, generate_subscripts(vector, 1) - 1 as pos, unnest(list_transform(list_zip(vector, cv), lambda z: z[1] - z[2])) as x from a where k = 1),
v as (select image_id, pos, sum(x) as v from r group by all), n as (select image_id, sqrt(sum(v * v)) as n from v group by 1)
select image_id, cast(pos as int) as pos, round(case when n > 0 then v / n else v end, 6) + 0.0 as v from v join n using (image_id)"""


@R.query(VLAD)
def v21_vlad(s, d):
    """Residuals to the nearest centroid, summed for each image; the centroids are a bounded input."""
    f = X.faces(s, d)
    cen = f.where("face_id < 8").select(c("face_id").alias("cid"), c("vector").alias("cv")).orderBy("cid").collect()
    r = S.residuals(f, "image_id", "vector", np.array([r.cv for r in cen]))
    g = S.vector_sums(r, "key", "residual")
    out = g.select(c("key").alias("image_id"), F.posexplode(V.normalise("sum")).alias("pos", "v"))
    return out.select("image_id", "pos", (F.round("v", 6) + 0.0).alias("v"))


SETS = f"""with {X.FACES} select a.person_id as p, b.person_id as q, round(greatest(max(list_dot_product(a.vector, b.vector)), 0), 6) as score
from faces a join faces b on a.person_id < b.person_id group by all"""


@R.query(SETS)
def v25_set_similarity(s, d):
    """Best pair between the galleries of two persons, of all of their faces."""
    g = assigned(s, d).select("face_id", "person_id", "vector")
    return S.label_pair_bests(g).select("p", "q", F.greatest("score", F.lit(0.0)).alias("score"))


@R.query(f"with {X.FACES}, {X.QUERIES}, s as (select qid, f.face_id, round(list_dot_product(qv, f.vector), 6) as score from q join faces f on f.person_id = q.qidentity and f.face_id <> qid) select qid, face_id, score from s qualify row_number() over (partition by qid order by score desc, face_id) = 1")
def v26_best_of_set(s, d):
    q = X.face_queries(X.faces(s, d))
    j = q.join(assigned(s, d), q.qidentity == c("person_id")).where("face_id != qid")
    j = j.select("qid", "face_id", F.round(V.dot("qv", "vector"), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "face_id")
    return j.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


KINDS = f"""with {X.FACES}, pos as (select person_id, face_id, quality, generate_subscripts(vector, 1) - 1 as pos, unnest(vector) as x from faces where person_id is not null),
k as (select *, row_number() over (partition by person_id, pos order by x, face_id) - 1 as r, count(*) over (partition by person_id, pos) as n, sum(x) over (partition by person_id, pos) as s, sum(ln(greatest(abs(x), 1e-10))) over (partition by person_id, pos) as l from pos),
z as (select person_id, pos, max(x) filter (where r = (n - 1) // 2) as lo, max(x) filter (where r = (n - 1) // 2 + 1) as hi from k group by all),
b as (select person_id, face_id as best, row_number() over (partition by person_id order by quality desc, face_id) as q from faces where person_id is not null),
o as (select k.person_id, k.face_id, k.pos, k.x, case when k.x <= z.lo then z.hi else z.lo end as median, (s - k.x) / (n - 1) as mean, exp((l - ln(greatest(abs(k.x), 1e-10))) / (n - 1)) as geomean from k join z using (person_id, pos) where n > 1),
f as (select o.*, p.x as single from o join b b1 on b1.person_id = o.person_id and b1.q = 1 join b b2 on b2.person_id = o.person_id and b2.q = 2 join pos p on p.person_id = o.person_id and p.pos = o.pos and p.face_id = case when b1.best = o.face_id then b2.best else b1.best end),
c as (select person_id, face_id, round(sum(x * single) / sqrt(sum(single * single)), 6) as single, round(sum(x * mean) / sqrt(sum(mean * mean)), 6) as mean, round(sum(x * median) / sqrt(sum(median * median)), 6) as median, round(sum(x * geomean) / sqrt(sum(geomean * geomean)), 6) as geomean from f group by all)
"""


@R.query(KINDS + " union all ".join(f"select '{k}' as kind, count(*) as n, round(avg({k}), 5) as score, round(avg(case when {k} >= 0.5 then 1.0 else 0.0 end), 6) as pass_rate from c" for k in ("single", "mean", "median", "geomean")))
def e15_leave_one_out_by_kind(s, d):
    """How often a face is alike to a prototype of the person's other faces: the best of them, their mean, median and
    geometric mean. The others' figures follow from the person's sums and from the two middle values, so none is worked
    out for each face."""
    f = assigned(s, d).select("person_id", "face_id", "quality", "vector")
    floor = lambda x: F.log(F.greatest(F.abs(x), F.lit(1e-10)))
    g = S.vector_sums(f, "person_id", "vector").select(c("key").alias("person_id"), "sum", c("weight").alias("n"))
    logs = S.vector_sums(f.withColumn("logs", F.transform("vector", floor)), "person_id", "logs").select(c("key").alias("person_id"), c("sum").alias("l"))
    mid = _ranked(s, d, {"lo": F.floor((c("n") - 1) / 2) + 1, "hi": F.floor((c("n") - 1) / 2) + 2})
    arrays = [S.gather_positions(mid.where(c("prob") == k), "value").select(c("key").alias("person_id"), c("vector").alias(k)) for k in ("lo", "hi")]
    two = T.best_per_group(f, ["person_id"], [F.desc("quality"), c("face_id")], 2)
    two = T.ranked(two, ["person_id"], [F.desc("quality"), c("face_id")], "q")
    best = two.groupBy("person_id").agg(F.max(F.when(c("q") == 1, c("face_id"))).alias("first"), F.max(F.when(c("q") == 1, c("vector"))).alias("v1"), F.max(F.when(c("q") == 2, c("vector"))).alias("v2"))
    j = f.join(g, "person_id").where("n > 1").join(logs, "person_id").join(best, "person_id")
    for a in arrays:
        j = j.join(a, "person_id")
    kinds = {
        "single": F.when(c("first") == c("face_id"), c("v2")).otherwise(c("v1")), "mean": V.subtract("sum", "vector"),
        "median": F.transform(F.arrays_zip("vector", "lo", "hi"), lambda e: F.when(e["vector"] <= e["lo"], e["hi"]).otherwise(e["lo"])),
        "geomean": F.transform(F.arrays_zip("vector", "l", F.array_repeat("n", F.size("l")).alias("n")), lambda e: F.exp((e["l"] - floor(e["vector"])) / (e["n"] - 1))),
    }
    for k, p in kinds.items():
        j = j.withColumn(f"p_{k}", p).withColumn(k, F.round(V.dot("vector", f"p_{k}") / V.norm(f"p_{k}"), 6))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c(k).alias("score")) for k in kinds])).alias("x")
    return j.select(each).groupBy("x.kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x.score"), 5).alias("score"), F.round(F.avg(F.when(c("x.score") >= 0.5, 1.0).otherwise(0.0)), 6).alias("pass_rate"))


@R.query()
def v23_kmeans(s, d):
    """Size of each of 10 clusters; k-means|| starts are not those of other engines, so there is no SQL."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    f = X.faces(s, d).select("face_id", array_to_vector("vector").alias("features"))
    model = KMeans(k=10, seed=3, maxIter=20).fit(f)
    return model.transform(f).groupBy(c("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
