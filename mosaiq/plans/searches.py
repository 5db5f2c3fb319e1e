"""Queries of the search family. Each hundredth face is a query, against all faces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mosaiq.operators import search as S
from mosaiq.operators import tables as T
from mosaiq.operators.hotkeys import key_ranks
from mosaiq.operators.similarity import class_bests, knn, pair_histogram
from mosaiq.plans import fixtures as X
from mosaiq.plans.registry import Registry
from mosaiq.session import shared_dir

R = Registry()
queries = lambda: R.functions
oracle_sql = lambda: R.sql
c = F.col

HITS = f"""with {X.FACES}, {X.QUERIES}, hits as (select qid, face_id as id, round(list_dot_product(qv, vector), 6) as score,
row_number() over (partition by qid order by round(list_dot_product(qv, vector), 6) desc, face_id) as rank from q, faces where face_id <> qid)"""


def fq(s, d):
    f = X.faces(s, d)
    return X.face_queries(f), f


@R.query(HITS + " select qid, id, score, rank from hits where rank <= 10")
def s01_knn(s, d):
    q, f = fq(s, d)
    return knn(q, f, 10).select("qid", "id", "score", c("rank").cast("bigint").alias("rank"))


@R.query(HITS + " select qid, id, score, rank from hits where rank <= 10")
def s01_knn_in_blocks(s, d):
    """The way for query sets that are too large to be sent along."""
    q, f = fq(s, d)
    return knn(q, f.repartition(3), 10, limit=1000).select("qid", "id", "score", c("rank").cast("bigint").alias("rank"))


def _images(weight: str = "1.0", k: int = 10, tail: str = "select qid, rank, image_id, target_id, score from r") -> str:
    return HITS + f""", j as (select qid, image_id, id as target_id, score, row_number() over (partition by qid, image_id order by score * {weight} desc, id) as b
    from hits join faces on face_id = id where rank <= {k} and score >= 0.5),
    r as (select qid, image_id, target_id, score, row_number() over (partition by qid order by score desc, image_id) as rank from j where b = 1) {tail}"""


@R.query(_images())
def s04_face_search(s, d):
    return S.image_search(*fq(s, d))


@R.query(_images("(case when face_id % 5 = 0 then 0.85 else 1.0 end)"))
def s10_object_search(s, d):
    return S.image_search(*fq(s, d), weight=F.when(c("face_id") % 5 == 0, 0.85).otherwise(1.0))


@R.query(f"with {X.FACES}, p as (select person_id as person, face_id as proto_id, vector as pv from faces where person_id is not null qualify row_number() over (partition by person_id order by quality desc, face_id) <= 5), h as (select person, proto_id, face_id, image_id, person_id, round(list_dot_product(pv, vector), 6) as score from p, faces where face_id <> proto_id qualify row_number() over (partition by proto_id order by round(list_dot_product(pv, vector), 6) desc, face_id) <= 40), b as (select person, image_id, score from h where person = person_id and score >= 0.5 qualify row_number() over (partition by person, image_id order by score desc, face_id) = 1) select person, row_number() over (partition by person order by score desc, image_id) as rank, image_id, score from b qualify rank <= 10")
def s06_person_search(s, d):
    f = X.faces(s, d)
    proto = T.best_per_group(f.where("person_id is not null"), ["person_id"], [F.desc("quality"), c("face_id")], 5)
    return S.person_search(proto.select("person_id", c("face_id").alias("proto_id"), "vector"), f)


DUAL = HITS + """, bh as (select qid, face_id as id, round(list_dot_product(qv, list_concat(vector[2:], vector[:1])), 6) as score,
row_number() over (partition by qid order by round(list_dot_product(qv, list_concat(vector[2:], vector[:1])), 6) desc, face_id) as rank from q, faces where face_id <> qid),
a as (select qid, person_id, score, rank from hits join faces on face_id = id where rank <= 20 and person_id is not null qualify row_number() over (partition by qid, person_id order by rank) = 1),
b as (select qid, person_id, score, rank from bh join faces on face_id = id where rank <= 20 and person_id is not null qualify row_number() over (partition by qid, person_id order by rank) = 1)
select coalesce(a.qid, b.qid) as qid, coalesce(a.person_id, b.person_id) as person_id, coalesce(a.score, 0) as face_score, coalesce(a.rank, 0) as face_rank, coalesce(b.score, 0) as body_score, coalesce(b.rank, 0) as body_rank
from a full join b on a.qid = b.qid and a.person_id = b.person_id"""


@R.query(DUAL)
def s07_dual_channel(s, d):
    q, f = fq(s, d)
    who = f.select(c("face_id").alias("id"), "person_id")
    rotated = F.concat(F.slice("vector", 2, 1000), F.slice("vector", 1, 1))
    big = lambda h: h.join(who, "id").withColumn("rank", c("rank").cast("bigint"))
    return S.dual_channel(big(knn(q, f, 20)), big(knn(q, f.withColumn("vector", rotated), 20)))


TWO = HITS + """, j as (select qid, image_id, id, score, round(score * case when face_id % 5 = 0 then 0.85 else 1.0 end, 6) as weighted from hits join faces on face_id = id where rank <= 200),
b as (select * from j qualify row_number() over (partition by qid, image_id order by weighted desc, id) = 1),
f as (select * from b where score >= 0.3 qualify row_number() over (partition by qid order by weighted desc, image_id) <= 50)
select qid, row_number() over (partition by qid order by weighted desc, image_id) as rank, image_id, id as target_id, score, weighted from f where score >= 0.5 and weighted >= 0.5 qualify rank <= 10"""


@R.query(TWO)
def s11_s13_two_stage(s, d):
    q, f = fq(s, d)
    return S.two_stage(q, f, F.when(c("face_id") % 5 == 0, 0.85).otherwise(1.0))


CLASS = f"with {X.FACES} select identity as class_id, face_id, det, row_number() over (partition by identity order by det desc, face_id) as rank from faces qualify rank <= 10"


@R.query(CLASS)
def s16_list_by_class(s, d):
    f = X.faces(s, d).select(c("identity").alias("class_id"), "face_id", "det")
    o = [F.desc("det"), c("face_id")]
    return T.ranked(T.best_per_group(f, ["class_id"], o, 10), ["class_id"], o).withColumn("rank", c("rank").cast("bigint"))


EXP = _images(tail=""", p as (select r.qid, f.person_id, max(r.score) as score from r join faces f on f.face_id = r.target_id where f.person_id is not null group by all),
m as (select p.qid, f.image_id, max(p.score) as score from p join faces f on f.person_id = p.person_id group by all)
select qid, image_id, score, 'hit' as kind from r union all select m.qid, m.image_id, m.score, 'person' from m anti join r on r.qid = m.qid and r.image_id = m.image_id""")


@R.query(EXP)
def s17_with_expansion(s, d):
    q, f = fq(s, d)
    return S.with_person_expansion(S.image_search(q, f), f)


@R.query(_images(tail=""", t as (select qid, count(*) as total from r group by 1) select qid, image_id, score, total from r join t using (qid) where rank > 2 and rank <= 5"""))
def s18_page_of_results(s, d):
    found = S.image_search(*fq(s, d))
    total = found.groupBy("qid").agg(F.count(F.lit(1)).alias("total"))
    return found.where("rank > 2 and rank <= 5").join(total, "qid").select("qid", "image_id", "score", "total")


@R.query(_images(tail=" select r.qid, r.image_id, r.score, f.x, f.y, f.w, f.h from r join faces f on f.face_id = r.target_id"))
def s19_enriched(s, d):
    q, f = fq(s, d)
    box = f.select(c("face_id").alias("target_id"), "x", "y", "w", "h")
    return S.image_search(q, f).join(box, "target_id").select("qid", "image_id", "score", "x", "y", "w", "h")


@R.query(f"with {X.FACES}, {X.QUERIES} select face_id as id from faces where face_id not in (select qid from q)")
def s02_s03_index_remove(s, d):
    q, f = fq(s, d)
    return T.delete(f.select(c("face_id").alias("id")), q.select(c("qid").alias("id")), "id")


# ---- evaluation on the hits
REC = HITS + """, w as (select h.qid, h.rank, f.identity = q.qidentity as hit from hits h join faces f on f.face_id = h.id join q using (qid)),
f as (select qid, min(rank) filter (where hit) as first from w group by 1)"""


def first_correct(s, d, k: int = 20):
    """``qid, first``: rank of the first hit of the query's own identity among ``k``; null without one."""
    q, f = fq(s, d)
    h = knn(q, f, k).join(f.select(c("face_id").alias("id"), "identity"), "id").join(q.select("qid", "qidentity"), "qid")
    return h.groupBy("qid").agg(F.min(F.when(c("identity") == c("qidentity"), c("rank"))).alias("first"))


@R.query(REC + " select " + ", ".join(f"round(avg(case when first <= {k} then 1.0 else 0.0 end), 6) as r{k}" for k in (1, 5, 10, 20)) + " from f")
def e01_recall_at_k(s, d):
    f = first_correct(s, d)
    return f.agg(*[F.round(F.avg(F.when(c("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"r{k}") for k in (1, 5, 10, 20)])


@R.query(REC + " select round(avg(case when first <= 10 then 1.0 / first else 0.0 end), 6) as mrr from f")
def e02_w06_mrr(s, d):
    return first_correct(s, d).agg(F.round(F.avg(F.when(c("first") <= 10, 1.0 / c("first")).otherwise(0.0)), 6).alias("mrr"))


PQ = HITS + """, w as (select h.qid, h.rank, h.score, f.identity = q.qidentity as pos from hits h join faces f on f.face_id = h.id join q using (qid) where h.rank <= 50)"""


@R.query(PQ + """ select qid, round(avg(score) filter (where pos), 6) as pos_mean, min(score) filter (where pos) as pos_min, max(score) filter (where pos) as pos_max,
round(avg(score) filter (where not pos), 6) as neg_mean, max(score) filter (where not pos) as neg_max, round(min(score) filter (where pos) - max(score) filter (where not pos), 6) as margin,
coalesce(min(rank) filter (where pos), 999) as first, count(*) filter (where pos and rank <= 5) as in5 from w group by 1""")
def e34_per_query(s, d):
    q, f = fq(s, d)
    h = knn(q, f, 50).join(f.select(c("face_id").alias("id"), "identity"), "id").join(q.select("qid", "qidentity"), "qid")
    pos = c("identity") == c("qidentity")
    p, n = F.when(pos, c("score")), F.when(~pos, c("score"))
    return h.groupBy("qid").agg(
        F.round(F.avg(p), 6).alias("pos_mean"), F.min(p).alias("pos_min"), F.max(p).alias("pos_max"), F.round(F.avg(n), 6).alias("neg_mean"),
        F.max(n).alias("neg_max"), F.round(F.min(p) - F.max(n), 6).alias("margin"),
        F.coalesce(F.min(F.when(pos, c("rank").cast("bigint"))), F.lit(999)).alias("first"), F.count_if(pos & (c("rank") <= 5)).alias("in5"),
    )


@R.query(PQ + ", g as (select qid, score, row_number() over (partition by qid order by score desc) as k from w where not pos), t as (select qid, max(score) filter (where k = 1) - max(score) filter (where k = 2) as gap from g where k <= 2 group by 1) select round(avg(case when round(gap, 6) < 0.05 then 1.0 else 0.0 end), 6) as ambiguous from t")
def e35_ambiguity_rate(s, d):
    q, f = fq(s, d)
    h = knn(q, f, 50).join(f.select(c("face_id").alias("id"), "identity"), "id").join(q.select("qid", "qidentity"), "qid")
    g = T.top_two_gap(h.where("identity != qidentity"), ["qid"], "score")
    return g.agg(F.round(F.avg(F.when(F.round("gap", 6) < 0.05, 1.0).otherwise(0.0)), 6).alias("ambiguous"))


# ---- evaluation on all pairs, by their histogram
H = f"""with {X.FACES}, h as (select round(list_dot_product(a.vector, b.vector), 4) as score, a.identity = b.identity as same, count(*) as n
from faces a join faces b on a.face_id < b.face_id group by all)"""


def hist(s, d):
    return pair_histogram(X.faces(s, d))


@R.query(H + " select same, sum(n)::bigint as pairs, round(sum(score * n) / sum(n), 5) as mean, min(score) as least, max(score) as most from h group by 1")
def e03_j15_pair_distribution(s, d):
    return hist(s, d).groupBy("same").agg(
        F.sum("n").alias("pairs"), F.round(F.sum(c("score") * c("n")) / F.sum("n"), 5).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most")
    )


SWEEP = H + """, t as (select unnest(range(30, 91)) / 100.0::double as threshold),
m as (select threshold, sum(n) filter (where same and score >= threshold) as tp, sum(n) filter (where not same and score >= threshold) as fp, sum(n) filter (where same and score < threshold) as fn, sum(n) filter (where not same and score < threshold) as tn from h, t group by 1),
z as (select threshold, coalesce(tp, 0)::double as tp, coalesce(fp, 0)::double as fp, coalesce(fn, 0)::double as fn, coalesce(tn, 0)::double as tn from m)"""


def sweep(h, lo: int = 30, hi: int = 90):
    """Counts of true and false pairs at each threshold (hundredths): a bounded histogram against a fixed grid."""
    t = h.sparkSession.range(lo, hi + 1).select((c("id") / 100.0).alias("threshold"))
    j = h.join(F.broadcast(t))
    over = c("score") >= c("threshold")
    n = lambda cond: F.sum(F.when(cond, c("n")).otherwise(0)).cast("double")
    return j.groupBy("threshold").agg(
        n(c("same") & over).alias("tp"), n(~c("same") & over).alias("fp"), n(c("same") & ~over).alias("fn"), n(~c("same") & ~over).alias("tn")
    )


def safe(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


@R.query(SWEEP + " select threshold, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy from z")
def e04_e17_threshold_sweep(s, d):
    z = sweep(hist(s, d))
    tp, fp, fn, tn = (c(x) for x in ("tp", "fp", "fn", "tn"))
    return z.select(
        "threshold", F.round(safe(tp, tp + fp), 6).alias("precision"), F.round(safe(tp, tp + fn), 6).alias("recall"),
        F.round(safe(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round((tp + tn) / (tp + tn + fp + fn), 6).alias("accuracy"),
    )


@R.query(SWEEP + " select threshold, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from z order by round(2 * tp / (2 * tp + fp + fn), 6) desc, threshold limit 1")
def e04_best_f1(s, d):
    z = e04_e17_threshold_sweep(s, d)
    return z.orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")


@R.query(SWEEP + " select threshold, round(fp / (fp + tn), 6) as far, round(fn / (tp + fn), 6) as frr from z where threshold in (0.8, 0.9, 0.5, 0.6, 0.7)")
def e10_far_frr(s, d):
    z = sweep(hist(s, d)).where("threshold in (0.5D, 0.6D, 0.7D, 0.8D, 0.9D)")
    return z.select("threshold", F.round(c("fp") / (c("fp") + c("tn")), 6).alias("far"), F.round(c("fn") / (c("tp") + c("fn")), 6).alias("frr"))


ROC = H + """, s as (select score, coalesce(sum(n) filter (where same), 0) as p, coalesce(sum(n) filter (where not same), 0) as q from h group by 1),
r as (select score, sum(p) over (order by score desc) / sum(p) over ()::double as tpr, sum(q) over (order by score desc) / sum(q) over ()::double as fpr from s),
k as (select *, lag(tpr, 1, 0.0) over (order by score desc) as t0, lag(fpr, 1, 0.0) over (order by score desc) as f0 from r)"""


def roc(h):
    """``score, tpr, fpr, t0, f0``: rates at each score and at the next higher one. Over the histogram, whose size is
    bounded, so the one-partition window is too."""
    from pyspark.sql import Window

    g = h.groupBy("score").agg(F.sum(F.when(c("same"), c("n")).otherwise(0)).alias("p"), F.sum(F.when(~c("same"), c("n")).otherwise(0)).alias("q"))
    w, every = Window.orderBy(F.desc("score")), Window.partitionBy()
    r = g.withColumn("tpr", F.sum("p").over(w) / F.sum("p").over(every)).withColumn("fpr", F.sum("q").over(w) / F.sum("q").over(every))
    return r.withColumn("t0", F.lag("tpr", 1, 0.0).over(w)).withColumn("f0", F.lag("fpr", 1, 0.0).over(w))


@R.query(ROC + " select round(sum((fpr - f0) * (tpr + t0) / 2), 6) as auc from k")
def e08_roc_auc(s, d):
    return roc(hist(s, d)).agg(F.round(F.sum((c("fpr") - c("f0")) * (c("tpr") + c("t0")) / 2), 6).alias("auc"))


@R.query(ROC + " select round(min((1 - tpr + fpr) / 2), 6) as eer from k")
def e09_eer(s, d):
    return roc(hist(s, d)).agg(F.round(F.min((1 - c("tpr") + c("fpr")) / 2), 6).alias("eer"))


@R.query(ROC + " select f as far, round(max(tpr) filter (where fpr <= f), 6) as tar from k, (select unnest([0.001, 0.01, 0.1])::double as f) group by 1")
def e11_tar_at_far(s, d):
    k = roc(hist(s, d))
    return k.withColumn("far", F.explode(F.array(*[F.lit(x) for x in (0.001, 0.01, 0.1)]))).groupBy("far").agg(F.round(F.max(F.when(c("fpr") <= c("far"), c("tpr"))), 6).alias("tar"))


@R.query(H + " select cast(floor(round(score * 10, 6)) as int) as bin, same, sum(n)::bigint as n from h group by all")
def e37_histogram(s, d):
    return hist(s, d).groupBy(F.floor(F.round(c("score") * 10, 6)).cast("int").alias("bin"), "same").agg(F.sum("n").alias("n"))


GRID = ROC + " select t / 100.0::double as threshold, round(coalesce(max(tpr) filter (where score >= t / 100.0::double), 0), 6) as tpr, round(coalesce(max(fpr) filter (where score >= t / 100.0::double), 0), 6) as fpr from k, range(0, 101) g(t) group by t"


@R.query(GRID)
def e12_e40_roc_on_grid(s, d):
    k = roc(hist(s, d))
    t = s.range(0, 101).select((c("id") / 100.0).alias("threshold"))
    j = k.join(F.broadcast(t))
    at = lambda x: F.round(F.coalesce(F.max(F.when(c("score") >= c("threshold"), c(x))), F.lit(0.0)), 6).alias(x)
    return j.groupBy("threshold").agg(at("tpr"), at("fpr"))


MARG = f"""with {X.FACES}, p as (select a.face_id, max(round(list_dot_product(a.vector, b.vector), 6)) filter (where a.identity = b.identity) as same,
max(round(list_dot_product(a.vector, b.vector), 6)) filter (where a.identity <> b.identity) as other from faces a join faces b on a.face_id <> b.face_id group by 1)"""


@R.query(MARG + " select face_id, same, other, round(same - other, 6) as margin from p")
def e14_margins(s, d):
    b = class_bests(X.faces(s, d))
    return b.select(c("id").alias("face_id"), "same", "other", F.round(c("same") - c("other"), 6).alias("margin"))


@R.query(MARG + " select count(*) filter (where same > other) as intact, count(*) filter (where other >= 0.75 and other > same) as wrong, count(*) filter (where same < 0.75 and other < 0.75) as alone from p")
def e43_join_simulation(s, d):
    b = class_bests(X.faces(s, d))
    return b.agg(F.count_if(c("same") > c("other")).alias("intact"), F.count_if((c("other") >= 0.75) & (c("other") > c("same"))).alias("wrong"), F.count_if((c("same") < 0.75) & (c("other") < 0.75)).alias("alone"))


@R.query(MARG + ", m as (select round(same - other, 6) as m, row_number() over (order by round(same - other, 6)) - 1 as k, count(*) over () as n from p) select count(*) as n, round(avg(m), 6) as mean, max(m) filter (where k = floor(0.1 * (n - 1) + 0.5)) as p10, max(m) filter (where k = floor(0.5 * (n - 1) + 0.5)) as p50, max(m) filter (where k = floor(0.9 * (n - 1) + 0.5)) as p90 from m")
def e14_e22_e25_margin_percentiles(s, d):
    m = class_bests(X.faces(s, d)).select(F.lit(0).alias("g"), F.round(c("same") - c("other"), 6).alias("m"))
    r = T.nearest_rank(m, ["g"], "m", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return r.select("n", F.round("mean", 6).alias("mean"), "p10", "p50", "p90")


SEPARATION = MARG + """, k as (select same, other, round(same - other, 6) as m from p), q as (select *, row_number() over (order by other) - 1 as ko, row_number() over (order by m) - 1 as km, count(*) over () as n from k),
e as (select v, row_number() over (order by v) as r, count(*) over () as t from (select same as v from k union all select other from k))
select count(*) as n, round(avg(m), 6) as mean, min(m) as least, max(m) as most, round(max(m) - min(m), 6) as range, round(avg(case when same <= (select max(other) from q where ko = n // 2) then 1.0 else 0.0 end), 6) as overlap,
(select round(max(v) filter (where r = t // 2 + 1) - max(v) filter (where r = t // 2), 6) from e) as central_gap, concat_ws('', """ + ", ".join(f"max(case when km = floor({x / 10} * (n - 1) + 0.5) then case when m > 0 then '+' else '-' end end)" for x in range(1, 10)) + ") as deciles from q"


@R.query(SEPARATION)
def e22_e25_separation(s, d):
    """Margins of all faces, the share of own scores that don't exceed the upper median of the others', the gap in the
    middle of both lists taken together, and which deciles of the margins are positive."""
    b = class_bests(X.faces(s, d)).select("same", "other", F.round(c("same") - c("other"), 6).alias("m"), F.lit(0).alias("g")).where("m is not null")
    one = {name: F.floor(x / 10 * (c("n") - 1) + 0.5) + 1 for name, x in ((f"d{x}", x) for x in range(1, 10))}
    dec = key_ranks(b, "g", "m", one).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prob", "value"))), lambda x: F.when(x["value"] > 0, "+").otherwise("-")), "").alias("deciles"))
    mid = key_ranks(b, "g", "other", {"mid": F.floor(c("n") / 2) + 1}).select(c("value").alias("mid"))
    both = b.select("g", F.explode(F.array("same", "other")).alias("v"))
    gap = key_ranks(both, "g", "v", {"a": F.floor(c("n") / 2), "b": F.floor(c("n") / 2) + 1}).agg(F.round(F.max(F.when(c("prob") == "b", c("value"))) - F.max(F.when(c("prob") == "a", c("value"))), 6).alias("central_gap"))
    about = b.join(F.broadcast(mid)).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 6).alias("mean"), F.min("m").alias("least"), F.max("m").alias("most"), F.round(F.max("m") - F.min("m"), 6).alias("range"),
        F.round(F.avg(F.when(c("same") <= c("mid"), 1.0).otherwise(0.0)), 6).alias("overlap"),
    )
    return about.join(gap).join(dec)


def _on_grid(steps: int) -> str:
    return ROC + f""", g as (select t / {steps}.0::double as t, coalesce(max(tpr) filter (where score >= t / {steps}.0::double), 0) as tpr, coalesce(max(fpr) filter (where score >= t / {steps}.0::double), 0) as fpr from k, range(0, {steps} + 1) x(t) group by t),
w as (select *, lag(tpr, 1, 0.0) over (order by t desc) as t0, lag(fpr, 1, 0.0) over (order by t desc) as f0 from g)"""


def on_grid(h, steps: int):
    """``threshold, tpr, fpr, t0, f0``: rates at fixed thresholds, and at the next higher one."""
    from pyspark.sql import Window

    j = roc(h).join(F.broadcast(h.sparkSession.range(0, steps + 1).select((c("id") / float(steps)).alias("threshold"))))
    at = lambda x: F.coalesce(F.max(F.when(c("score") >= c("threshold"), c(x))), F.lit(0.0)).alias(x)
    w = Window.orderBy(F.desc("threshold"))  # as many rows as the grid has steps
    g = j.groupBy("threshold").agg(at("tpr"), at("fpr"))
    return g.withColumn("t0", F.lag("tpr", 1, 0.0).over(w)).withColumn("f0", F.lag("fpr", 1, 0.0).over(w))


@R.query(_on_grid(1000) + ", m as (select round(max(round(list_dot_product(a.vector, b.vector), 6)) filter (where a.identity = b.identity) - max(round(list_dot_product(a.vector, b.vector), 6)) filter (where a.identity <> b.identity), 6) as m from faces a join faces b on a.face_id <> b.face_id group by a.face_id), mr as (select m, row_number() over (order by m) - 1 as k, count(*) over () as n from m) select (select round(sum((fpr - f0) * (tpr + t0) / 2), 6) from w) as auc, (select round(avg(case when m > 0 then 1.0 else 0.0 end), 6) from mr) as positive, (select max(m) filter (where k = floor(0.1 * (n - 1) + 0.5)) from mr) as p10")
def e12_auc_and_margins(s, d):
    auc = on_grid(hist(s, d), 1000).agg(F.round(F.sum((c("fpr") - c("f0")) * (c("tpr") + c("t0")) / 2), 6).alias("auc"))
    m = class_bests(X.faces(s, d)).select(F.round(c("same") - c("other"), 6).alias("m")).where("m is not null")
    share = m.agg(F.round(F.avg(F.when(c("m") > 0, 1.0).otherwise(0.0)), 6).alias("positive"))
    return auc.join(share).join(T.nearest_rank(m, [], "m", {"p10": 0.1}).select("p10"))


@R.query(_on_grid(100) + " select (select round(sum((fpr - f0) * (tpr + t0) / 2), 6) from w) as auc, t as threshold, round((fpr + 1 - tpr) / 2, 6) as eer from w order by round(abs(fpr - (1 - tpr)), 9), t limit 1")
def e40_eer_on_grid(s, d):
    """AUC from a hundred points, and the error rate where false acceptance and rejection are nearest."""
    g = on_grid(hist(s, d), 100)
    auc = g.agg(F.round(F.sum((c("fpr") - c("f0")) * (c("tpr") + c("t0")) / 2), 6).alias("auc"))
    best = g.orderBy(F.round(F.abs(c("fpr") - (1 - c("tpr"))), 9), "threshold").limit(1)
    return best.join(auc).select("auc", "threshold", F.round((c("fpr") + 1 - c("tpr")) / 2, 6).alias("eer"))


@R.query(f"with {X.FACES} select face_id, round(sum_v, 4) as total, copies from (select face_id, list_sum(vector) as sum_v, case when face_id % 10 = 0 then 2 else 1 end as copies from faces)")
def s02_batch_insert(s, d):
    """An index in the shared folder: half of the faces at first, then batches of others; an id may be there twice."""
    f = X.faces(s, d).select("face_id", "vector")
    root = f"{shared_dir(s)}/index-{uuid.uuid4().hex}"
    f.where("face_id % 2 = 0").write.parquet(root)
    for batch in ("face_id % 2 = 1 and face_id % 3 = 0", "face_id % 2 = 1 and face_id % 3 > 0", "face_id % 10 = 0"):
        f.where(batch).write.mode("append").parquet(root)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    index = s.read.schema(f.schema).parquet(root)
    return index.groupBy("face_id").agg(F.round(F.max(total), 4).alias("total"), F.count(F.lit(1)).cast("int").alias("copies"))


@R.query(_images(tail=""", p as (select *, count(*) over (partition by qid) as total from r) select qid, rank, image_id, (image_id + qid) % 3 = 0 as selected, total from p where rank > 3 and rank <= 6 or (image_id + qid) % 3 = 0"""))
def l05_pages_and_selection(s, d):
    """The second page of three of each query's images, beside those of other pages that are selected: a selection outlives
    the page."""
    found = S.image_search(*fq(s, d))
    chosen = found.where("(image_id + qid) % 3 = 0").select("qid", "image_id", F.lit(True).alias("selected"))
    total = found.groupBy("qid").agg(F.count(F.lit(1)).alias("total"))
    j = found.join(chosen, ["qid", "image_id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False))).join(total, "qid")
    return j.where("(rank > 3 and rank <= 6) or selected").select("qid", "rank", "image_id", "selected", "total")


# ---- queries made of several vectors
FUSED = f"""with {X.FACES}, {X.QUERIES}, pos as (select q.qid, f.det * (0.5 + f.blur) * (0.5 + f.quality) as wt, generate_subscripts(f.vector, 1) as pos, unnest(f.vector) as x from q join faces f on f.image_id = q.qimage),
m as (select qid, pos, sum(x * wt) / sum(wt) as v from pos group by all having sum(wt) > 0), n as (select qid, sqrt(sum(v * v)) as n from m group by 1),
v as (select qid, list(v / n order by pos) as qv from m join n using (qid) group by 1),
hits as (select v.qid, face_id as id, round(list_dot_product(v.qv, f.vector), 6) as score from v, faces f where face_id <> v.qid)
select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from hits qualify rank <= 10"""


@R.query(FUSED)
def s05_s12_search_by_image(s, d):
    """All faces on the query's image fused into one vector by their weights, then the nearest faces."""
    from mosaiq.functions import vectors as V
    from mosaiq.operators.similarity import vector_sums

    q, f = fq(s, d)
    j = f.join(q.select("qid", c("qimage").alias("image_id")), "image_id")
    g = vector_sums(j, "qid", "vector", F.expr("det * (0.5 + blur) * (0.5 + quality)")).where("weight > 0")
    fused = g.select(c("key").alias("qid"), V.normalise(V.scale("sum", 1.0 / c("weight"))).alias("qv"))
    return knn(fused, f, 10).select("qid", "id", "score", c("rank").cast("bigint").alias("rank"))


CAT = f"""with {X.FACES}, b as (select identity, vector from faces qualify row_number() over (partition by identity order by det desc, face_id) <= 3),
pos as (select identity, generate_subscripts(vector, 1) as pos, unnest(vector) as x from b), m as (select identity, pos, avg(x) as v from pos group by all),
n as (select identity, sqrt(sum(v * v)) as n from m group by 1), p as (select identity, list(v / n order by pos) as qv from m join n using (identity) group by 1),
h as (select -1 - p.identity as k, p.identity, face_id, round(list_dot_product(qv, f.vector), 6) as score from p, faces f)
select identity as category, face_id as id, score from h qualify row_number() over (partition by identity order by score desc, face_id) <= 5"""


@R.query(CAT)
def s15_category_search(s, d):
    """Mean of each category's three best detections, then the nearest faces."""
    from mosaiq.functions import vectors as V
    from mosaiq.operators.similarity import vector_sums

    f = X.faces(s, d)
    b = T.best_per_group(f.select("identity", "face_id", "det", "vector"), ["identity"], [F.desc("det"), c("face_id")], 3)
    g = vector_sums(b, "identity", "vector")
    q = g.select((-1 - c("key")).alias("qid"), V.normalise(V.scale("sum", 1.0 / c("weight"))).alias("qv"))
    return knn(q, f, 5).select((-1 - c("qid")).cast("bigint").alias("category"), "id", "score")


@R.query(f"with {X.FACES}, {X.QUERIES} select qid, round(avg(list_dot_product(qv, vector)) filter (where identity = qidentity), 6) as within, round(avg(list_dot_product(qv, vector)) filter (where identity <> qidentity), 6) as across from q, faces where face_id <> qid group by 1")
def j16_query_and_gallery(s, d):
    """Mean score of each query within and across identities, from sums of vectors: no pairs are formed."""
    from mosaiq.functions import vectors as V
    from mosaiq.operators.similarity import vector_sums

    q, f = fq(s, d)
    g = vector_sums(f, "identity", "vector").select(c("key").alias("qidentity"), "sum", "weight")
    every = vector_sums(f.withColumn("one", F.lit(0)), "one", "vector").select(c("sum").alias("all"), c("weight").alias("n"))
    j = q.join(g, "qidentity").join(F.broadcast(every))
    own, total = V.dot("qv", "sum"), V.dot("qv", "all")
    return j.select("qid", F.round((own - V.dot("qv", "qv")) / (c("weight") - 1), 6).alias("within"), F.round((total - own) / (c("n") - c("weight")), 6).alias("across"))


@R.query(MARG + ", x as (select p.*, f.quality >= 0.5 as good from p join faces f using (face_id)), m as (select good, round(same - other, 6) as m, row_number() over (partition by good order by round(same - other, 6)) - 1 as k, count(*) over (partition by good) as n from x) select good, count(*) as n, round(avg(case when m > 0 then 1.0 else 0.0 end), 6) as positive, max(m) filter (where k = floor(0.1 * (n - 1) + 0.5)) as p10 from m group by 1")
def e29_quality_filter(s, d):
    """Margins of the faces that pass a quality filter beside those that don't."""
    f = X.faces(s, d)
    m = class_bests(f).select(c("id").alias("face_id"), F.round(c("same") - c("other"), 6).alias("m"))
    x = m.join(f.select("face_id", (c("quality") >= 0.5).alias("good")), "face_id").withColumn("pos", F.when(c("m") > 0, 1.0).otherwise(0.0))
    share = x.groupBy("good").agg(F.round(F.avg("pos"), 6).alias("positive"))
    return T.nearest_rank(x, ["good"], "m", {"p10": 0.1}).join(share, "good").select("good", "n", "positive", "p10")
