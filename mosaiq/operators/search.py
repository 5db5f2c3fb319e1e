"""Searches: nearest rows, joined with what they belong to, best per image, thresholds, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.quality import fetch_k
from mosaiq.operators.similarity import knn
from mosaiq.operators.tables import best_per_group, delete, ranked


def _order() -> list:
    return [F.desc("score"), F.col("image_id")]


def image_search(queries: DataFrame, gallery: DataFrame, k: int = 10, least: float = 0.5, weight=None) -> DataFrame:
    """``qid, rank, image_id, target_id, score``: nearest rows, the threshold, the first ``k``, then the best of each
    image. There may be fewer than ``k`` images, as the first ``k`` are taken before. ``weight`` (a column of the
    gallery) changes the order of an image's rows, not the score shown."""
    hits = knn(queries, gallery, fetch_k(k, 4, 20)).where(F.col("score") >= least).where(F.col("rank") <= k).drop("rank")
    j = hits.join(gallery.select(F.col("face_id").alias("id"), "image_id", (weight if weight is not None else F.lit(1.0)).alias("_w")), "id")
    best = best_per_group(j, ["qid", "image_id"], [(F.col("score") * F.col("_w")).desc(), F.col("id")])
    return ranked(best, ["qid"], _order()).select("qid", F.col("rank").cast("bigint").alias("rank"), "image_id", F.col("id").alias("target_id"), "score")


def person_search(prototypes: DataFrame, gallery: DataFrame, k: int = 10, least: float = 0.5) -> DataFrame:
    """``person, rank, image_id, score``: the images most similar to any prototype (person, proto_id, vector) of a
    person, among the person's own rows."""
    q = prototypes.select(F.col("proto_id").alias("qid"), F.col("vector").alias("qv"), F.col("person_id").alias("person"))
    hits = knn(q, gallery, 4 * k).drop("rank").join(q.select("qid", "person"), "qid")
    j = hits.join(gallery.select(F.col("face_id").alias("id"), "image_id", "person_id"), "id").where("person = person_id")
    best = best_per_group(j.where(F.col("score") >= least), ["person", "image_id"], [F.desc("score"), F.col("id")])
    top = ranked(best, ["person"], _order()).where(F.col("rank") <= k)
    return top.select("person", F.col("rank").cast("bigint").alias("rank"), "image_id", "score")


def with_person_expansion(found: DataFrame, gallery: DataFrame) -> DataFrame:
    """``qid, image_id, score, kind``: found images, and the other images of the persons on them, with the person's best
    score."""
    g = gallery.where("person_id is not null").select("image_id", "person_id", F.col("face_id").alias("target_id"))
    persons = found.join(g.select("target_id", "person_id"), "target_id").groupBy("qid", "person_id").agg(F.max("score").alias("score"))
    more = persons.join(g.select("image_id", "person_id").distinct(), "person_id").groupBy("qid", "image_id").agg(F.max("score").alias("score"))
    more = more.join(found.select("qid", "image_id").distinct(), ["qid", "image_id"], "left_anti")
    own = found.select("qid", "image_id", "score", F.lit("hit").alias("kind"))
    return own.unionByName(more.select("qid", "image_id", "score", F.lit("person").alias("kind")))


def dual_channel(face_hits: DataFrame, body_hits: DataFrame) -> DataFrame:
    """``qid, person_id, face_score, face_rank, body_score, body_rank`` of hits (qid, person_id, score, rank): the first
    hit of each person in each channel; rank 0 where a channel has none."""

    def first(h: DataFrame, n: str) -> DataFrame:
        b = best_per_group(h.where("person_id is not null"), ["qid", "person_id"], [F.col("rank")])
        return b.select("qid", "person_id", F.col("score").alias(f"{n}_score"), F.col("rank").alias(f"{n}_rank"))

    j = first(face_hits, "face").join(first(body_hits, "body"), ["qid", "person_id"], "full_outer")
    zero = {f"{n}_{x}": 0 for n in ("face", "body") for x in ("score", "rank")}
    return j.na.fill(zero)


def two_stage(queries: DataFrame, gallery: DataFrame, weight, k: int = 10, raw: float = 0.3, cap: int = 50, least: float = 0.5) -> DataFrame:
    """Coarse search, best row of each image by weighted score, filter on the raw score, at most ``cap`` candidates,
    fused score (here the embedding alone), the threshold on both scores, rank."""
    hits = knn(queries, gallery, max(20 * k, 200)).drop("rank")
    j = hits.join(gallery.select(F.col("face_id").alias("id"), "image_id", weight.alias("_w")), "id").withColumn("weighted", F.round(F.col("score") * F.col("_w"), 6))
    best = best_per_group(j, ["qid", "image_id"], [F.desc("weighted"), F.col("id")])
    fine = best_per_group(best.where(F.col("score") >= raw), ["qid"], [F.desc("weighted"), F.col("image_id")], cap)
    out = ranked(fine.where((F.col("score") >= least) & (F.col("weighted") >= least)), ["qid"], [F.desc("weighted"), F.col("image_id")])
    return out.where(F.col("rank") <= k).select("qid", F.col("rank").cast("bigint").alias("rank"), "image_id", F.col("id").alias("target_id"), "score", "weighted")


def without(found: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    return delete(found, seen, on)
