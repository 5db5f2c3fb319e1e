"""Evidence about the persons that a query may show: prototype scores by channel, margins, ambiguity, confidence.

Candidates are few for each query (the persons among its nearest rows), and prototypes few for each person, so what is
joined here is bounded by queries x candidates x prototypes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators.tables import gap_to_next_lower

c = F.col
CHANNELS = ("face", "body")


def prototype_scores(candidates: DataFrame, queries: DataFrame, prototypes: DataFrame, name: str, vector: Column) -> DataFrame:
    """``qid, person_id, {name}_prototypes, {name}_score, {name}_second``: number of the candidate's prototypes, and the
    two highest scores of the query with them. Prototypes taken from the query's own image are left out."""
    p = prototypes.select("person_id", c("image_id").alias("_image"), vector.alias("_v"))
    j = candidates.select("qid", "person_id").join(queries.select("qid", "qimage", "qv"), "qid").join(p, "person_id").where("_image != qimage")
    j = j.select("qid", "person_id", F.round(V.dot("qv", "_v"), 6).alias("s"))
    w = Window.partitionBy("qid", "person_id").orderBy(F.desc("s"))
    j = j.withColumn("k", F.row_number().over(w))
    second = F.coalesce(F.max(F.when(c("k") == 2, c("s"))), F.lit(0.0))
    return j.groupBy("qid", "person_id").agg(F.count(F.lit(1)).alias(f"{name}_prototypes"), F.max("s").alias(f"{name}_score"), second.alias(f"{name}_second"))


def identity_evidence(candidates: DataFrame, queries: DataFrame, prototypes: DataFrame, vectors: dict[str, Column]) -> DataFrame:
    """One row for each candidate (qid, person_id, face_rank, body_rank): prototypes, best and second score, margin to the
    next lower score among the query's candidates (null for the lowest) in each channel. A channel without prototypes
    counts as score 0."""
    e = candidates.select("qid", "person_id", "face_rank", "body_rank")
    for n in CHANNELS:
        s = prototype_scores(candidates, queries, prototypes, n, vectors[n])
        e = e.join(s, ["qid", "person_id"], "left").na.fill(0, [f"{n}_prototypes", f"{n}_score", f"{n}_second"])
        e = gap_to_next_lower(e, "qid", f"{n}_score", f"{n}_margin").withColumn(f"{n}_margin", F.round(f"{n}_margin", 6))
    return e


def confidence(face: Column, body: Column, has_face: Column, has_body: Column) -> Column:
    """The face's score, helped by the body's between .55 and .70; 0 without a face."""
    return F.when(~has_face, 0.0).when((face >= 0.55) & (face < 0.7) & has_body, 0.85 * face + 0.15 * body).otherwise(face)


def fusion_margin(face: Column, body: Column, weight: float = 0.5) -> Column:
    """Weighted mean of the margins that are there; null without any."""
    return F.coalesce(weight * face + (1 - weight) * body, face, body)


def ambiguity(evidence: DataFrame, enough: float = 0.05, some: float = 0.02) -> DataFrame:
    """``qid, candidates, face_gap, body_gap, ambiguous, signal, suggestion``: gap of the two best scores in each channel;
    ambiguous if there are two candidates and both gaps are under ``enough``. The suggestion is to use the first one, to
    look at it (a gap of ``some`` or more), or that there is a conflict."""
    g = evidence
    for n in CHANNELS:
        g = g.withColumn(f"_{n}", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(f"{n}_score"), "person_id")))
    gap = lambda n: F.round(F.coalesce(F.max(f"{n}_score") - F.max(F.when(c(f"_{n}") == 2, c(f"{n}_score"))), F.lit(0.0)), 6).alias(f"{n}_gap")
    g = g.groupBy("qid").agg(F.count(F.lit(1)).alias("candidates"), gap("face"), gap("body"))
    one, f, b = c("candidates") < 2, c("face_gap"), c("body_gap")
    clear = one | (f >= enough) | (b >= enough)
    signal = F.when(f > b, "face").when(b > f, "body").otherwise("both")
    suggestion = F.when(clear, "use_top1").when((f >= some) | (b >= some), "review").otherwise("conflict")
    return g.select("qid", "candidates", "face_gap", "body_gap", (~clear).alias("ambiguous"), signal.alias("signal"), suggestion.alias("suggestion"))


def identity_search(evidence: DataFrame, enough: float = 0.05) -> DataFrame:
    """Evidence in the order of confidence, with whether the query is ambiguous: ``qid, rank, person_id, confidence,
    face_score, body_score, face_margin, body_margin, ambiguous``."""
    a = ambiguity(evidence, enough).select("qid", "ambiguous")
    conf = confidence(c("face_score"), c("body_score"), c("face_prototypes") > 0, c("body_prototypes") > 0)
    e = evidence.join(a, "qid").withColumn("confidence", F.round(conf, 6))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("confidence"), "person_id")).cast("bigint")
    return e.select("qid", rank.alias("rank"), "person_id", "confidence", "face_score", "body_score", "face_margin", "body_margin", "ambiguous")


def first_persons(hits: DataFrame, persons: int) -> DataFrame:
    """``qid, person_id, face_score, face_rank`` of hits (qid, person_id, score, rank): the first hit of each person, the
    first ``persons`` persons; ranks are counted anew."""
    b = hits.where("person_id is not null").groupBy("qid", "person_id").agg(F.min(F.struct("rank", "score")).alias("z"))
    w = Window.partitionBy("qid").orderBy("z.rank")
    out = b.select("qid", "person_id", c("z.score").alias("face_score"), F.row_number().over(w).alias("face_rank"))
    return out.where(c("face_rank") <= persons)


def evaluate(queries: DataFrame, gate: Column, hits: DataFrame, prototypes: DataFrame, vectors: dict[str, Column], persons: int = 10) -> DataFrame:
    """The whole flow for each query: gate, candidates, evidence, gaps, and the first candidate's figures: ``qid, gate,
    candidates, person_id, face_score, face_margin, body_score, body_margin, confidence, fusion_margin, face_gap, body_gap,
    ambiguous, signal, suggestion``. A query that fails the gate keeps its evidence beside the reason; one without
    candidates has nulls."""
    cand = first_persons(hits, persons).withColumn("body_rank", F.lit(0))
    e = identity_evidence(cand, queries, prototypes, vectors)
    conf = confidence(c("face_score"), c("body_score"), F.lit(True), c("body_prototypes") > 0)
    top = e.where("face_rank = 1").select(
        "qid", "person_id", "face_score", "face_margin", "body_score", "body_margin", F.round(conf, 6).alias("confidence"),
        F.round(fusion_margin(c("face_margin"), c("body_margin")), 6).alias("fusion_margin"),
    )
    return queries.select("qid", gate.alias("gate")).join(top.join(ambiguity(e), "qid"), "qid", "left")
