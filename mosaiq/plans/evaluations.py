"""Queries of evaluation analytics over groups, rankings, evidence and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators import similarity as S
from mosaiq.operators import tables as T
from mosaiq.plans import fixtures as X
from mosaiq.plans.registry import Registry
from mosaiq.plans.relational import VIEWS, fa, ff

R = Registry()
queries = lambda: R.functions
oracle_sql = lambda: R.sql
c = F.col

#: Predicted clusters of the faces: the label, wrong for each ninth face; each 23rd face alone.
CLUSTER = "case when face_id % 23 = 0 then -face_id when face_id % 9 = 0 then (identity + 1) % 10 else identity end"
PRED = f"with {X.FACES}, p as (select face_id, identity, {CLUSTER} as cluster from faces), n as (select cluster, identity, count(*) as n from p group by all)"


def predicted(s, d) -> DataFrame:
    return X.faces(s, d).selectExpr("face_id", "identity", f"{CLUSTER} as cluster")


def cells(s, d) -> DataFrame:
    """``cluster, identity, n``: the table of counts that all cluster measures follow from; pairs are never formed."""
    return predicted(s, d).groupBy("cluster", "identity").agg(F.count(F.lit(1)).alias("n"))


@R.query(PRED + ", c as (select cluster, sum(n) as nc from n group by 1), i as (select identity, sum(n) as ni from n group by 1), b as (select sum(n * (n / nc)) / sum(n) as p, sum(n * (n / ni)) / sum(n) as r from n join c using (cluster) join i using (identity)) select round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1 from b")
def e05_b_cubed(s, d):
    n = cells(s, d)
    j = n.join(n.groupBy("cluster").agg(F.sum("n").alias("nc")), "cluster").join(n.groupBy("identity").agg(F.sum("n").alias("ni")), "identity")
    b = j.agg((F.sum(c("n") * c("n") / c("nc")) / F.sum("n")).alias("p"), (F.sum(c("n") * c("n") / c("ni")) / F.sum("n")).alias("r"))
    return b.select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(2 * c("p") * c("r") / (c("p") + c("r")), 6).alias("f1"))


@R.query(PRED + " select (select count(*) from (select cluster from n group by 1 having count(*) > 1)) as merged_clusters, (select count(*) from (select identity from n group by 1 having count(*) > 1)) as split_identities, (select count(distinct cluster) from n) as clusters")
def e06_merges_and_splits(s, d):
    n = cells(s, d)
    m = n.groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(c("k") > 1).alias("merged_clusters"), F.count(F.lit(1)).alias("clusters"))
    i = n.groupBy("identity").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(c("k") > 1).alias("split_identities"))
    return m.join(i)


@R.query(PRED + ", t as (select sum(n * (n - 1) / 2) as tp from n), c as (select sum(k * (k - 1) / 2) as pp from (select sum(n) as k from n group by cluster)), i as (select sum(k * (k - 1) / 2) as ap from (select sum(n) as k from n group by identity)), u as (select sum(m) / sum(k) as purity from (select max(n) as m, sum(n) as k from n group by cluster)) select round(purity, 6) as purity, round(tp / pp, 6) as precision, round(tp / ap, 6) as recall from t, c, i, u")
def e07_purity_and_pairs(s, d):
    n = cells(s, d)
    pairs = lambda x: F.sum(x * (x - 1) / 2)
    t = n.agg(pairs(c("n")).alias("tp"))
    by = n.groupBy("cluster").agg(F.sum("n").alias("k"), F.max("n").alias("m"))
    p = by.agg(pairs(c("k")).alias("pp"), (F.sum("m") / F.sum("k")).alias("purity"))
    a = n.groupBy("identity").agg(F.sum("n").alias("k")).agg(pairs(c("k")).alias("ap"))
    return t.join(p).join(a).select(F.round("purity", 6).alias("purity"), F.round(c("tp") / c("pp"), 6).alias("precision"), F.round(c("tp") / c("ap"), 6).alias("recall"))


# ---- scores against the means of identities
LOO = f"""with {X.FACES}, pos as (select face_id, identity, generate_subscripts(vector, 1) as pos, unnest(vector) as x from faces),
s as (select identity, pos, sum(x) as s, count(*) as n from pos group by all),
m as (select p.face_id, p.identity, s.identity as other, p.x, case when s.identity = p.identity then (s.s - p.x) / (s.n - 1) else s.s / s.n end as v from pos p join s using (pos)),
r as (select face_id, identity, other, round(sum(x * v) / sqrt(sum(v * v)), 6) as score from m group by all)"""


def to_means(s, d) -> DataFrame:
    """``face_id, identity, other, score``: cosine of each face to the mean of each identity, without the face itself in
    its own. The query is about every identity, so there are as many rows as faces x identities; they are made where the
    faces are, against blocks of means."""
    f = X.faces(s, d).select("face_id", "identity", "vector")
    return S.scores_to_means(f, "face_id", "identity", "vector")


@R.query(LOO + ", k as (select face_id, identity = other as hit, row_number() over (partition by face_id order by score desc, other) as rank from r) select " + ", ".join(f"round(avg(case when rank <= {k} then 1.0 else 0.0 end), 6) as top{k}" for k in (1, 3, 5, 10)) + " from k where hit")
def e13_leave_one_out_identification(s, d):
    w = Window.partitionBy("face_id").orderBy(F.desc("score"), "other")
    k = to_means(s, d).withColumn("rank", F.row_number().over(w)).where("identity = other")
    return k.agg(*[F.round(F.avg(F.when(c("rank") <= n, 1.0).otherwise(0.0)), 6).alias(f"top{n}") for n in (1, 3, 5, 10)])


RULES = {"score": "o >= t", "margin": "m >= g", "both": "o >= t and m >= g", "either": "o >= t or m >= g", "strict": "(o >= t and m >= g) or o >= 90"}


@R.query(LOO + ", g0 as (select face_id, identity, max(score) filter (where identity = other) as own, max(score) filter (where identity <> other) as rest from r group by all), x as (select floor(round(own * 1e6) / 1e4) as o, floor(round((own - rest) * 1e6) / 1e4) as m from g0), j as (select * from x, range(50, 101) a(t), range(0, 21) b(g)) "
         + " union all ".join(f"select '{n}' as rule, t / 100.0::double as threshold, g / 100.0::double as margin, count(*) filter (where {x}) as accepted from j group by all" for n, x in RULES.items()))
def e18_rule_grid(s, d):
    """Faces accepted by five rules at 51 thresholds and 21 margins. Faces are counted by hundredths of score and margin
    first, a bounded table; only that meets the grid."""
    g = to_means(s, d).groupBy("face_id").agg(F.max(F.when(c("identity") == c("other"), c("score"))).alias("own"), F.max(F.when(c("identity") != c("other"), c("score"))).alias("rest"))
    hundredths = lambda x: F.floor(F.round(x * 1e6) / 1e4)
    n = g.groupBy(hundredths(c("own")).alias("o"), hundredths(c("own") - c("rest")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    grid = s.range(50, 101).select(c("id").alias("t")).join(F.broadcast(s.range(0, 21).select(c("id").alias("g"))))
    j = n.join(F.broadcast(grid)).groupBy("t", "g").agg(*[F.sum(F.when(F.expr(x), c("n")).otherwise(0)).alias(k) for k, x in RULES.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c(k).alias("accepted")) for k in RULES]))
    return j.select((c("t") / 100.0).alias("threshold"), (c("g") / 100.0).alias("margin"), each.alias("x")).select("x.rule", "threshold", "margin", "x.accepted")


SWEEP = f"""with {X.FACES}, a as (select t / 20.0::double as alpha from range(0, 21) g(t)), f as (select face_id, det, blur, quality >= 0.5 as good, alpha, round(alpha * det + (1 - alpha) * blur, 4) as s from faces, a),
k as (select alpha, s, count(*) filter (where good) as p, count(*) filter (where not good) as q from f group by all),
r as (select *, sum(p) over (partition by alpha order by s desc) / sum(p) over (partition by alpha)::double as tpr, sum(q) over (partition by alpha order by s desc) / sum(q) over (partition by alpha)::double as fpr from k),
l as (select *, lag(tpr, 1, 0.0) over (partition by alpha order by s desc) as t0, lag(fpr, 1, 0.0) over (partition by alpha order by s desc) as f0 from r),
u as (select alpha, round(sum((fpr - f0) * (tpr + t0) / 2), 6) as auc, round(min((1 - tpr + fpr) / 2), 6) as eer from l group by 1),
w as (select alpha, round(s - 0.6, 4) as m, row_number() over (partition by alpha order by s) - 1 as k, count(*) over (partition by alpha) as n from f where good),
m as (select alpha, max(m) filter (where k = floor(0.5 * (n - 1) + 0.5)) as margin_median, max(m) filter (where k = floor(0.1 * (n - 1) + 0.5)) as margin_p10 from w group by 1),
z as (select alpha, round(avg(s) filter (where good), 5) as good, round(avg(s) filter (where not good), 5) as bad, round(avg(case when not good and s >= 0.6 then 1.0 when not good then 0.0 end), 6) as far, round(avg(case when good and s < 0.6 then 1.0 when good then 0.0 end), 6) as frr from f group by 1)
select alpha, good, bad, far, frr, auc, eer, margin_median, margin_p10 from z join u using (alpha) join m using (alpha)"""


@R.query(SWEEP)
def e16_fusion_sweep(s, d):
    """Two scores fused with each weight of a fixed grid: false acceptance and rejection, AUC, EER, and the margin of the
    good ones over the threshold. Faces are counted by weight and score, a bounded table; the rest follows from it."""
    f = X.faces(s, d).select("det", "blur", (c("quality") >= 0.5).alias("good"))
    j = f.join(F.broadcast(s.range(0, 21).select((c("id") / 20.0).alias("alpha"))))
    j = j.withColumn("s", F.round(c("alpha") * c("det") + (1 - c("alpha")) * c("blur"), 4))
    k = j.groupBy("alpha", "s").agg(F.count_if("good").alias("p"), F.count_if(~c("good")).alias("q"))
    w, up, every = Window.partitionBy("alpha").orderBy(F.desc("s")), Window.partitionBy("alpha").orderBy("s"), Window.partitionBy("alpha")
    k = k.withColumn("np", F.sum("p").over(every)).withColumn("tpr", F.sum("p").over(w) / c("np")).withColumn("fpr", F.sum("q").over(w) / F.sum("q").over(every))
    k = k.withColumn("t0", F.lag("tpr", 1, 0.0).over(w)).withColumn("f0", F.lag("fpr", 1, 0.0).over(w)).withColumn("upto", F.sum("p").over(up))
    at = lambda p: F.max(F.when((c("upto") > F.floor(p * (c("np") - 1) + 0.5)) & (c("upto") - c("p") <= F.floor(p * (c("np") - 1) + 0.5)), F.round(c("s") - 0.6, 4)))
    mean = lambda n: F.round(F.sum(c("s") * c(n)) / F.sum(n), 5)
    rate = lambda n, hit: F.round(F.sum(F.when(hit, c(n)).otherwise(0)) / F.sum(n), 6)
    return k.groupBy("alpha").agg(
        mean("p").alias("good"), mean("q").alias("bad"), rate("q", c("s") >= 0.6).alias("far"), rate("p", c("s") < 0.6).alias("frr"),
        F.round(F.sum((c("fpr") - c("f0")) * (c("tpr") + c("t0")) / 2), 6).alias("auc"), F.round(F.min((1 - c("tpr") + c("fpr")) / 2), 6).alias("eer"),
        at(0.5).alias("margin_median"), at(0.1).alias("margin_p10"),
    )


HARD = f"""with {X.FACES}, {X.QUERIES}, h as (select qid, face_id, identity, qidentity, round(list_dot_product(qv, vector), 6) as score from q, faces where identity <> qidentity)
select qid, face_id, score, case when score >= 0.4 then 'close' else 'far' end as kind from h qualify row_number() over (partition by qid order by score desc, face_id) <= 5"""


@R.query(HARD)
def e19_hard_negatives(s, d):
    """The five most similar faces of other identities for each query. Rows of its own are left out within the search, so
    they can't push others out."""
    f = X.faces(s, d)
    h = S.knn(X.face_queries(f), f, 5, apart=("qidentity", "identity"))
    return h.select("qid", c("id").alias("face_id"), "score", F.when(c("score") >= 0.4, "close").otherwise("far").alias("kind"))


@R.query(f"with {X.FACES}, g as (select identity, count(*) as n, count(*) * (count(*) - 1) // 2 as pairs, count(*) filter (where person_id is null) as unassigned, round(median(quality), 6) as quality, count(distinct image_id) as images from faces group by 1) "
         "select *, concat_ws(',', case when n < 45 then 'few_faces' end, case when unassigned * 4 >= n then 'many_unassigned' end, case when quality < 0.5 then 'low_quality' end, case when images < 10 then 'few_images' end) as reasons, n >= 45 and unassigned * 4 < n as usable from g")
def e20_dataset_verdict(s, d):
    """Positive pairs of each identity, and whether it is of use, with the reasons against it."""
    n = F.count(F.lit(1))
    g = X.faces(s, d).groupBy("identity").agg(n.alias("n"), F.count_if(c("person_id").isNull()).alias("unassigned"), F.round(F.median("quality"), 6).alias("quality"), F.countDistinct("image_id").alias("images"))
    why = {"few_faces": c("n") < 45, "many_unassigned": c("unassigned") * 4 >= c("n"), "low_quality": c("quality") < 0.5, "few_images": c("images") < 10}
    reasons = F.concat_ws(",", F.array_compact(F.array(*[F.when(x, k) for k, x in why.items()])))
    return g.select("identity", "n", F.expr("n * (n - 1) div 2").alias("pairs"), "unassigned", "quality", "images", reasons.alias("reasons"), ((c("n") >= 45) & (c("unassigned") * 4 < c("n"))).alias("usable"))


@R.query(f"with {X.FACES} select case when quality >= 0.7 then 'high' when quality >= 0.4 then 'mid' else 'low' end as class, count(*) as n, count(*) filter (where face_id % 6 = 5) as no_body, count(*) filter (where yaw is null) as no_pose from faces group by 1")
def e21_missing_channels(s, d):
    k = F.when(c("quality") >= 0.7, "high").when(c("quality") >= 0.4, "mid").otherwise("low")
    return X.faces(s, d).groupBy(k.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("face_id") % 6 == 5).alias("no_body"), F.count_if(c("yaw").isNull()).alias("no_pose"))


DIL = f"""with {X.FACES}, k as (select *, row_number() over (partition by identity order by quality desc, face_id) as rk from faces),
pos as (select identity, rk, generate_subscripts(vector, 1) as pos, unnest(vector) as x from k where rk <= 20),
m as (select identity, n, pos, avg(x) as m from pos, (select unnest([1, 3, 5, 10, 20]) as n) where rk <= n group by all)
select identity, n, round(sqrt(sum(m * m)), 6) as length from m group by all"""


@R.query(DIL)
def e23_dilution(s, d):
    """Length of the mean of the first 1, 3, 5, 10 and 20 faces: the more it shrinks, the less they agree."""
    f = X.faces(s, d).select("identity", "face_id", "quality", "vector")
    k = T.ranked(f, ["identity"], [F.desc("quality"), c("face_id")], "rk").where("rk <= 20")
    parts = []
    for n in (1, 3, 5, 10, 20):
        g = S.vector_sums(k.where(c("rk") <= n), "identity", "vector")
        parts.append(g.select(c("key").alias("identity"), F.lit(n).alias("n"), F.round(V.norm("sum") / c("weight"), 6).alias("length")))
    return T.union_all(parts)


POL = f"""with {X.FACES}, k as (select *, row_number() over (partition by identity order by face_id) as rk from faces),
pos as (select identity, rk, generate_subscripts(vector, 1) as pos, unnest(vector) as x from k),
b as (select identity, pos, sum(x) as s, count(*) as n from pos group by all),
w as (select (identity + 1) % 10 as identity, n as wrong, pos, sum(x) as w from pos, (select unnest([1, 2, 5, 10]) as n) where rk <= n group by all)
select identity, wrong, round(sqrt(sum(power((s + w) / (n + wrong) - s / n, 2))), 6) as drift from b join w using (identity, pos) group by all"""


@R.query(POL)
def e24_pollution_drift(s, d):
    """How far the mean moves when 1, 2, 5 or 10 faces of the next identity come in."""
    f = X.faces(s, d).select("identity", "face_id", "vector")
    base = S.vector_sums(f, "identity", "vector")
    k = T.ranked(f, ["identity"], [c("face_id")], "rk")
    parts = []
    for n in (1, 2, 5, 10):
        w = S.vector_sums(k.where(c("rk") <= n), "identity", "vector").select(((c("key") + 1) % 10).alias("key"), c("sum").alias("w"), c("weight").alias("wn"))
        j = base.join(w, "key")
        moved = V.subtract(V.scale(V.add("sum", "w"), 1.0 / (c("weight") + c("wn"))), V.scale("sum", 1.0 / c("weight")))
        parts.append(j.select(c("key").alias("identity"), F.lit(n).alias("wrong"), F.round(V.norm(moved), 6).alias("drift")))
    return T.union_all(parts)


@R.query(f"with {X.FACES}, m as (select md5(face_id::varchar || '-' || seed) < '99' as pick, seed, quality from faces, (select unnest([1, 2, 3, 4, 5]) as seed)), v as (select seed, avg(quality) as v from m where pick group by 1) select round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(min(v), 6) as least, round(max(v), 6) as most from v")
def e27_seed_stability(s, d):
    f = X.faces(s, d).select("face_id", "quality", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])).alias("seed"))
    f = f.where(F.md5(F.concat_ws("-", c("face_id").cast("string"), c("seed").cast("string"))) < "99")
    v = f.groupBy("seed").agg(F.avg("quality").alias("v"))
    return v.agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("most"))


@R.query(f"with {X.FACES}, l as (select identity, vector, " + ", ".join(f"lead(vector, {k}) over (partition by identity order by face_id) as v{k}" for k in (1, 2, 5, 10, 20)) + " from faces) select identity, " + ", ".join(f"round(avg(list_dot_product(vector, v{k})), 6) as step{k}" for k in (1, 2, 5, 10, 20)) + " from l group by 1")
def e28_chain_steps(s, d):
    w = Window.partitionBy("identity").orderBy("face_id")
    f = X.faces(s, d).select("identity", "vector", *[F.lead("vector", k).over(w).alias(f"v{k}") for k in (1, 2, 5, 10, 20)])
    return f.groupBy("identity").agg(*[F.round(F.avg(V.dot("vector", f"v{k}")), 6).alias(f"step{k}") for k in (1, 2, 5, 10, 20)])


@R.query(f"with {X.FACES} select face_id, round(1 - (row_number() over (partition by identity order by quality desc, face_id) - 1) / greatest(count(*) over (partition by identity) - 1, 1), 6) as r, round(case when max(det) over w - min(det) over w < 1e-8 then 0.5 else (det - min(det) over w) / (max(det) over w - min(det) over w) end, 6) as m from faces window w as (partition by identity)")
def e30_e31_normalised(s, d):
    w, o = Window.partitionBy("identity"), Window.partitionBy("identity").orderBy(F.desc("quality"), "face_id")
    n, lo, hi = F.count(F.lit(1)).over(w), F.min("det").over(w), F.max("det").over(w)
    r = 1 - (F.row_number().over(o) - 1) / F.greatest(n - 1, F.lit(1))
    m = F.when(hi - lo < 1e-8, 0.5).otherwise((c("det") - lo) / (hi - lo))
    return X.faces(s, d).select("face_id", F.round(r, 6).alias("r"), F.round(m, 6).alias("m"))


@R.query(f"with {X.FACES} select identity, round(coalesce(corr(quality, det), 0), 6) as r from faces group by 1")
def e32_pearson(s, d):
    return X.faces(s, d).groupBy("identity").agg(F.round(F.coalesce(F.corr("quality", "det"), F.lit(0.0)), 6).alias("r"))


SPEAR = f"""with {X.FACES}, k as (select identity, rank() over (partition by identity order by quality) + (count(*) over (partition by identity, quality) - 1) / 2.0::double as a,
rank() over (partition by identity order by det) + (count(*) over (partition by identity, det) - 1) / 2.0::double as b from faces) select identity, round(corr(a, b), 6) as rho from k group by 1"""


@R.query(SPEAR)
def e33_spearman(s, d):
    """Average ranks for ties."""
    p = Window.partitionBy("identity")

    def rank(x: str) -> Column:
        return F.rank().over(p.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy("identity", x)) - 1) / 2.0

    return X.faces(s, d).select("identity", rank("quality").alias("a"), rank("det").alias("b")).groupBy("identity").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


FUSE = f"""with {X.FACES}, k as (select identity, face_id, count(*) over (partition by identity) as n, case when face_id % 5 > 0 then row_number() over (partition by identity, face_id % 5 > 0 order by quality desc, face_id) - 1 end as ra,
case when face_id % 7 > 0 then row_number() over (partition by identity, face_id % 7 > 0 order by det desc, face_id) - 1 end as rb from faces)
select identity, face_id, -(coalesce(ra, n) + coalesce(rb, n)) / 2 as mean_rank, round(0.7 * (n - coalesce(ra, n)) + 0.3 * (n - coalesce(rb, n)), 6) as weighted from k"""


@R.query(FUSE)
def e42_rank_fusion(s, d):
    f = X.faces(s, d).select("identity", "face_id", "quality", "det")
    n = f.groupBy("identity").agg(F.count(F.lit(1)).alias("n"))
    a = T.ranked(f.where("face_id % 5 > 0"), ["identity"], [F.desc("quality"), c("face_id")], "ra").select("face_id", (c("ra") - 1).alias("ra"))
    b = T.ranked(f.where("face_id % 7 > 0"), ["identity"], [F.desc("det"), c("face_id")], "rb").select("face_id", (c("rb") - 1).alias("rb"))
    j = f.join(n, "identity").join(a.join(b, "face_id", "full_outer"), "face_id", "left")
    ra, rb = F.coalesce("ra", "n"), F.coalesce("rb", "n")
    return j.select("identity", "face_id", (-(ra + rb) / 2).alias("mean_rank"), F.round(0.7 * (c("n") - ra) + 0.3 * (c("n") - rb), 6).alias("weighted"))


# ---- two decisions about a face: by the best similarity and by the best confidence
SHADOW = f"""with {VIEWS}, l as (select face_id, person_id, similarity as score from fa where person_id is not null and similarity is not null qualify row_number() over (partition by face_id order by similarity desc, assignment_id) = 1),
n as (select face_id, person_id, confidence as score from fa where person_id is not null and confidence between 0 and 1 qualify row_number() over (partition by face_id order by confidence desc, assignment_id) = 1),
d as (select l.face_id, l.person_id as p1, n.person_id as p2, case when l.score::double >= 0.7 then 'match' when l.score::double >= 0.5 then 'weak' else 'new' end as d1, case when n.score::double >= 0.7 then 'match' when n.score::double >= 0.5 then 'weak' else 'new' end as d2, abs(l.score::double - n.score::double) as delta from l join n using (face_id)),
k as (select *, case when p1 = p2 and d1 = d2 then 'agree' when p1 <> p2 then 'different_person' else 'different_decision' end as kind from d)"""


def two_decisions(s, d) -> DataFrame:
    a = fa(s, d).where("person_id is not null")
    best = lambda col, cond: T.best_per_group(a.where(cond), ["face_id"], [F.desc(col), c("assignment_id")])
    label = lambda x: F.when(x >= 0.7, "match").when(x >= 0.5, "weak").otherwise("new")
    x1, x2 = c("similarity").cast("double"), c("confidence").cast("double")
    old = best("similarity", "similarity is not null").select("face_id", c("person_id").alias("p1"), label(x1).alias("d1"), x1.alias("s1"))
    new = best("confidence", "confidence between 0 and 1").select("face_id", c("person_id").alias("p2"), label(x2).alias("d2"), x2.alias("s2"))
    j = old.join(new, "face_id")
    kind = F.when((c("p1") == c("p2")) & (c("d1") == c("d2")), "agree").when(c("p1") != c("p2"), "different_person").otherwise("different_decision")
    return j.select("face_id", "p1", "p2", "d1", "d2", "s1", "s2", F.abs(c("s1") - c("s2")).alias("delta"), kind.alias("kind"))


@R.query(SHADOW + " select face_id, p1, p2, d1, d2, round(delta, 6) as delta, kind from k")
def d12_d13_disagreement(s, d):
    return two_decisions(s, d).drop("s1", "s2").withColumn("delta", F.round("delta", 6))


@R.query(SHADOW + " select kind, count(*) as n, round(avg(delta), 6) as delta from k group by 1")
def a17_a18_shadow_metrics(s, d):
    return two_decisions(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta"), 6).alias("delta"))


@R.query(SHADOW + " select d1, count(*) filter (where d2 = 'match') as match, count(*) filter (where d2 = 'weak') as weak, count(*) filter (where d2 = 'new') as new from k group by 1")
def e44_contingency(s, d):
    return two_decisions(s, d).groupBy("d1").pivot("d2", ["match", "weak", "new"]).agg(F.count(F.lit(1))).na.fill(0)


SIDES = SHADOW + """, x as (select k.*, round(least(s1, s2), 6) as low, round(s1 - s2, 6) as step, f.quality_score::double as quality from k join (select face_id, l.score::double as s1, n.score::double as s2 from l join n using (face_id)) using (face_id) left join ff f using (face_id))"""


@R.query(SIDES + " select face_id, 'delta' as list, round(delta, 6) as value from x where kind <> 'agree' qualify row_number() over (order by round(delta, 6) desc, face_id) <= 50 union all select face_id, 'margin', round(delta, 6) from x qualify row_number() over (order by round(delta, 6), face_id) <= 20 union all select face_id, 'quality', round(quality, 6) from x where quality is not null qualify row_number() over (order by round(quality, 6), face_id) <= 10")
def d20_e38_worst_cases(s, d):
    """The 50 greatest differences among disagreements, the 20 smallest margins, the 10 lowest qualities."""
    k = two_decisions(s, d).join(ff(s, d).select("face_id", c("quality_score").cast("double").alias("quality")), "face_id", "left")

    def first(x: DataFrame, name: str, value: str, order: Column, n: int) -> DataFrame:
        x = x.select("face_id", F.lit(name).alias("list"), F.round(value, 6).alias("value")).where("value is not null")
        return x.orderBy(order, "face_id").limit(n)

    return T.union_all([first(k.where("kind != 'agree'"), "delta", "delta", F.desc("value"), 50), first(k, "margin", "delta", F.asc("value"), 20), first(k, "quality", "quality", F.asc("value"), 10)])


@R.query(SIDES + " select case when low >= 0.7 then 'high' when low >= 0.5 then 'middle' else 'low' end as band, count(*) as n, round(avg(case when p1 <> p2 then 1.0 else 0.0 end), 6) as conflict, round(avg(case when p1 = p2 and step < 0 then 1.0 else 0.0 end), 6) as aggressive, round(avg(case when p1 = p2 and step > 0 then 1.0 else 0.0 end), 6) as conservative, count(*) filter (where abs(low - 0.7) < 0.02 or abs(low - 0.5) < 0.02) as near_threshold from x group by 1")
def e38_shares_by_band(s, d):
    """By band of the lower score: shares of other persons, of the same person with a higher and with a lower new score,
    and the number of scores near a threshold."""
    k = two_decisions(s, d).withColumn("low", F.round(F.least("s1", "s2"), 6)).withColumn("step", F.round(c("s1") - c("s2"), 6))
    band = F.when(c("low") >= 0.7, "high").when(c("low") >= 0.5, "middle").otherwise("low").alias("band")
    share = lambda x: F.round(F.avg(F.when(x, 1.0).otherwise(0.0)), 6)
    same = c("p1") == c("p2")
    near = (F.abs(c("low") - 0.7) < 0.02) | (F.abs(c("low") - 0.5) < 0.02)
    return k.groupBy(band).agg(F.count(F.lit(1)).alias("n"), share(~same).alias("conflict"), share(same & (c("step") < 0)).alias("aggressive"), share(same & (c("step") > 0)).alias("conservative"), F.count_if(near).alias("near_threshold"))


#: Candidates of each face scored anew: half of the two old scores each, the old similarity where there is no confidence.
REPLAY = f"""with {VIEWS}, x as (select face_id, person_id, max(similarity::double) as old, max(round(case when confidence between 0 and 1 then 0.5 * similarity::double + 0.5 * confidence::double else similarity::double end, 6)) as new from fa where person_id is not null and similarity is not null group by all),
o as (select face_id, person_id as old_person, old as old_score from x qualify row_number() over (partition by face_id order by old desc, person_id) = 1),
n as (select face_id, person_id as new_person, new as new_score from x qualify row_number() over (partition by face_id order by new desc, person_id) = 1),
k as (select *, case when old_score >= 0.7 then 'match' when old_score >= 0.5 then 'weak' else 'new' end as old_decision, case when new_score >= 0.7 then 'match' when new_score >= 0.5 then 'weak' else 'new' end as new_decision from o join n using (face_id))"""


def replayed(s, d) -> DataFrame:
    a = fa(s, d).where("person_id is not null and similarity is not null")
    old, conf = c("similarity").cast("double"), c("confidence").cast("double")
    new = F.round(F.when(c("confidence").between(0, 1), 0.5 * old + 0.5 * conf).otherwise(old), 6)
    x = a.groupBy("face_id", "person_id").agg(F.max(old).alias("old"), F.max(new).alias("new"))
    top = lambda k: F.min(F.struct((-c(k)).alias("s"), c("person_id").alias("p")))
    g = x.groupBy("face_id").agg(top("old").alias("o"), top("new").alias("n"))
    g = g.select("face_id", c("o.p").alias("old_person"), (-c("o.s")).alias("old_score"), c("n.p").alias("new_person"), (-c("n.s")).alias("new_score"))
    label = lambda v: F.when(v >= 0.7, "match").when(v >= 0.5, "weak").otherwise("new")
    return g.withColumn("old_decision", label(c("old_score"))).withColumn("new_decision", label(c("new_score")))


@R.query(REPLAY + " select face_id, old_person, round(old_score, 6) as old_score, old_decision, new_person, new_score, new_decision, old_person = new_person as same_person from k")
def d12_replay(s, d):
    """Candidates scored anew: the first one before and after, by fixed cut-offs."""
    return replayed(s, d).withColumn("old_score", F.round("old_score", 6)).withColumn("same_person", c("old_person") == c("new_person"))


@R.query(REPLAY + " select (select count(distinct face_id) from fa) as faces, count(*) as replayed, round(sum(case when old_person = new_person then 1.0 else 0.0 end) / (select count(distinct face_id) from fa), 6) as agreement, round(sum(old_score) / (select count(distinct face_id) from fa), 6) as old_mean, round(sum(new_score) / (select count(distinct face_id) from fa), 6) as new_mean, round(sum(new_score - old_score) / (select count(distinct face_id) from fa), 6) as delta from k")
def a18_replay_means(s, d):
    """Sums are divided by all faces, also by those that nothing was replayed for."""
    g = fa(s, d).agg(F.countDistinct("face_id").alias("faces"))
    k = replayed(s, d).agg(F.count(F.lit(1)).alias("replayed"), F.sum(F.when(c("old_person") == c("new_person"), 1.0).otherwise(0.0)).alias("a"), F.sum("old_score").alias("o"), F.sum("new_score").alias("n"), F.sum(c("new_score") - c("old_score")).alias("d"))
    mean = lambda x, name: F.round(c(x) / c("faces"), 6).alias(name)
    return k.join(g).select("faces", "replayed", mean("a", "agreement"), mean("o", "old_mean"), mean("n", "new_mean"), mean("d", "delta"))


@R.query(f"with {VIEWS}, v as (select * from fa order by created_at desc, assignment_id limit 1000) select method, count(*) as n, round(avg(similarity::double), 6) as mean from v group by 1")
def e41_latest_summary(s, d):
    v = fa(s, d).orderBy(F.desc("created_at"), "assignment_id").limit(1000)
    return v.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(c("similarity").cast("double")), 6).alias("mean"))


#: Evidence of candidates, by face: the three best scores of a face's assignments in two channels.
GAPS = f"""with {VIEWS}, x as (select face_id, person_id, max(similarity::double) as a, max(case when confidence between 0 and 1 then confidence::double end) as b from fa where person_id is not null group by all),
g as (select face_id, count(*) as n, coalesce(max(a) - max(a) filter (where ra = 2), 0) as ga, coalesce(max(b) - max(b) filter (where rb = 2), 0) as gb from
 (select *, row_number() over (partition by face_id order by a desc nulls last, person_id) as ra, row_number() over (partition by face_id order by b desc nulls last, person_id) as rb from x) group by 1)"""


@R.query(GAPS + " select face_id, n, round(ga, 6) as gap_a, round(gb, 6) as gap_b, n >= 2 and round(ga, 6) < 0.05 and round(gb, 6) < 0.05 as ambiguous, case when round(ga, 6) > round(gb, 6) then 'a' when round(gb, 6) > round(ga, 6) then 'b' else 'both' end as signal from g")
def d03_d04_two_channel_gaps(s, d):
    """Gap of the two best candidates in each of two channels; ambiguous if both are small."""
    b = F.when(c("confidence").between(0, 1), c("confidence").cast("double"))
    x = fa(s, d).where("person_id is not null").groupBy("face_id", "person_id").agg(F.max(c("similarity").cast("double")).alias("a"), F.max(b).alias("b"))
    w = lambda k: Window.partitionBy("face_id").orderBy(F.desc_nulls_last(k), "person_id")
    x = x.withColumn("ra", F.row_number().over(w("a"))).withColumn("rb", F.row_number().over(w("b")))
    gap = lambda k: F.round(F.coalesce(F.max(k) - F.max(F.when(c(f"r{k}") == 2, c(k))), F.lit(0.0)), 6)
    g = x.groupBy("face_id").agg(F.count(F.lit(1)).alias("n"), gap("a").alias("gap_a"), gap("b").alias("gap_b"))
    amb = (c("n") >= 2) & (c("gap_a") < 0.05) & (c("gap_b") < 0.05)
    sig = F.when(c("gap_a") > c("gap_b"), "a").when(c("gap_b") > c("gap_a"), "b").otherwise("both")
    return g.select("face_id", "n", "gap_a", "gap_b", amb.alias("ambiguous"), sig.alias("signal"))


@R.query(f"with {VIEWS}, r as (select person_id, similarity::double as s, row_number() over (partition by person_id order by similarity desc, assignment_id) as k from fa where person_id is not null and similarity is not null) select person_id, count(*) filter (where s >= 0.78) as support, round(avg(s), 6) as mean from r where k <= 5 group by 1")
def d11_individual_support(s, d):
    a = fa(s, d).where("person_id is not null and similarity is not null")
    top = T.best_per_group(a, ["person_id"], [F.desc("similarity"), c("assignment_id")], 5).withColumn("s", c("similarity").cast("double"))
    return top.groupBy("person_id").agg(F.count_if(c("s") >= 0.78).alias("support"), F.round(F.avg("s"), 6).alias("mean"))


@R.query(f"with {X.FACES} select face_id, round(case when face_id % 3 = 0 then 0.0 when det >= 0.7 then det when det >= 0.55 and face_id % 4 > 0 then 0.85 * det + 0.15 * blur else det end, 6) as confidence, round(case when face_id % 3 > 0 and face_id % 4 > 0 then 0.5 * quality + 0.5 * blur when face_id % 3 > 0 then quality when face_id % 4 > 0 then blur else 0 end, 6) as margin from faces")
def d05_d06_fused_evidence(s, d):
    """Confidence of face evidence helped by the body in the grey zone, and the margin of the channels that are there."""
    face, body = c("face_id") % 3 > 0, c("face_id") % 4 > 0
    conf = F.when(~face, 0.0).when(c("det") >= 0.7, c("det")).when((c("det") >= 0.55) & body, 0.85 * c("det") + 0.15 * c("blur")).otherwise(c("det"))
    margin = F.when(face & body, 0.5 * c("quality") + 0.5 * c("blur")).when(face, c("quality")).when(body, c("blur")).otherwise(0.0)
    return X.faces(s, d).select("face_id", F.round(conf, 6).alias("confidence"), F.round(margin, 6).alias("margin"))
