"""Queries of identity search: evidence of candidates, the search, and the whole evaluation of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators import evidence as V
from mosaiq.operators import tables as T
from mosaiq.operators.similarity import knn
from mosaiq.plans import fixtures as X
from mosaiq.plans.registry import Registry
from mosaiq.plans.searches import DUAL, HITS, fq, s07_dual_channel

R = Registry()
queries = lambda: R.functions
oracle_sql = lambda: R.sql
c = F.col

def channels() -> dict:
    """The vectors of a channel; the body's are the face's elements moved by one place."""
    return {"face": c("vector"), "body": F.concat(F.slice("vector", 2, 1000), F.slice("vector", 1, 1))}


def prototypes(f: DataFrame) -> DataFrame:
    """The five faces of highest quality of each person."""
    return T.best_per_group(f.where("person_id is not null"), ["person_id"], [F.desc("quality"), c("face_id")], 5)


def _scores(n: str, v: str) -> str:
    s = f"round(list_dot_product(qv, {v}), 6)"
    return f"""{n}0 as (select cand.qid, cand.person_id, {s} as s, row_number() over (partition by cand.qid, cand.person_id order by {s} desc) as k from cand join q using (qid) join proto p on p.person_id = cand.person_id and p.image_id <> q.qimage),
{n}1 as (select qid, person_id, count(*) as n, max(s) as best, coalesce(max(s) filter (where k = 2), 0) as second from {n}0 group by all)"""


def _evidence(candidates: str) -> str:
    """Evidence of the candidates ``cand`` (qid, person_id, face_rank, body_rank)."""
    return f"""{candidates}, proto as (select * from faces where person_id is not null qualify row_number() over (partition by person_id order by quality desc, face_id) <= 5),
{_scores('f', 'vector')}, {_scores('b', 'list_concat(vector[2:], vector[:1])')},
e0 as (select cand.qid, cand.person_id, face_rank, body_rank, coalesce(f1.n, 0) as face_prototypes, coalesce(f1.best, 0) as face_score, coalesce(f1.second, 0) as face_second,
coalesce(b1.n, 0) as body_prototypes, coalesce(b1.best, 0) as body_score, coalesce(b1.second, 0) as body_second from cand left join f1 using (qid, person_id) left join b1 using (qid, person_id)),
e as (select *, round(face_score - (select max(o.face_score) from e0 o where o.qid = e0.qid and o.face_score < e0.face_score), 6) as face_margin,
round(body_score - (select max(o.body_score) from e0 o where o.qid = e0.qid and o.body_score < e0.body_score), 6) as body_margin from e0),
g0 as (select *, row_number() over (partition by qid order by face_score desc, person_id) as rf, row_number() over (partition by qid order by body_score desc, person_id) as rb from e),
g as (select qid, count(*) as candidates, round(coalesce(max(face_score) - max(face_score) filter (where rf = 2), 0), 6) as face_gap, round(coalesce(max(body_score) - max(body_score) filter (where rb = 2), 0), 6) as body_gap from g0 group by 1),
amb as (select *, candidates >= 2 and face_gap < 0.05 and body_gap < 0.05 as ambiguous, case when face_gap > body_gap then 'face' when body_gap > face_gap then 'body' else 'both' end as signal,
case when candidates < 2 or face_gap >= 0.05 or body_gap >= 0.05 then 'use_top1' when face_gap >= 0.02 or body_gap >= 0.02 then 'review' else 'conflict' end as suggestion from g)"""


_HEAD, _TAIL = DUAL.rsplit("\nselect coalesce", 1)
SEARCH = _evidence(f"{_HEAD}, cand as (select coalesce{_TAIL})")


def candidate_evidence(s, d) -> DataFrame:
    q, f = fq(s, d)
    return V.identity_evidence(s07_dual_channel(s, d), q, prototypes(f), channels())


@R.query(SEARCH + " select qid, person_id, face_rank, body_rank, face_prototypes, face_score, face_second, body_prototypes, body_score, body_second, face_margin, body_margin from e")
def s08_candidate_evidence(s, d):
    return candidate_evidence(s, d).withColumn("face_rank", c("face_rank").cast("bigint")).withColumn("body_rank", c("body_rank").cast("bigint"))


@R.query(SEARCH + """, k as (select e.*, ambiguous, round(case when face_prototypes = 0 then 0 when face_score >= 0.55 and face_score < 0.7 and body_prototypes > 0 then 0.85 * face_score + 0.15 * body_score else face_score end, 6) as confidence from e join amb using (qid))
select qid, row_number() over (partition by qid order by confidence desc, person_id) as rank, person_id, confidence, face_score, body_score, face_margin, body_margin, ambiguous from k""")
def s09_identity_search(s, d):
    return V.identity_search(candidate_evidence(s, d))


@R.query(SEARCH + " select qid, candidates, face_gap, body_gap, ambiguous, signal, suggestion from amb")
def d04_suggestions(s, d):
    return V.ambiguity(candidate_evidence(s, d))


#: First check of a query's face that fails.
GATE = "case when quality < 0.2 then 'quality' when face_size < 40 then 'size' when abs(coalesce(yaw, 0)) > 75 then 'yaw' else 'ok' end"
PIPE = _evidence(HITS + """, h as (select qid, person_id, min(rank) as rank from hits join faces on face_id = id where rank <= 30 and person_id is not null group by all),
cand as (select qid, person_id, row_number() over (partition by qid order by rank) as face_rank, 0 as body_rank from h qualify face_rank <= 10)""")


@R.query(PIPE + f""", top as (select *, round(case when face_score >= 0.55 and face_score < 0.7 and body_prototypes > 0 then 0.85 * face_score + 0.15 * body_score else face_score end, 6) as confidence,
round(coalesce(0.5 * face_margin + 0.5 * body_margin, face_margin, body_margin), 6) as fusion_margin from e where face_rank = 1)
select q.qid, {GATE} as gate, candidates, person_id, face_score, face_margin, body_score, body_margin, confidence, fusion_margin, face_gap, body_gap, ambiguous, signal, suggestion
from (select q.*, f.quality, f.face_size, f.yaw from q join faces f on f.face_id = q.qid) q left join (top join amb using (qid)) using (qid)""")
def d09_evaluated_queries(s, d):
    """Gate, 30 nearest faces, their first 10 persons, evidence, gaps, and the figures of the first candidate."""
    f = X.faces(s, d)
    q = f.where("face_id % 100 = 0").selectExpr("face_id as qid", "image_id as qimage", "vector as qv", "quality", "face_size", "yaw")
    hits = knn(q, f, 30).join(f.select(c("face_id").alias("id"), "person_id"), "id")
    return V.evaluate(q, F.expr(GATE), hits, prototypes(f), channels())
