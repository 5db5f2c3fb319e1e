"""Queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import clusters, describe, history, mixing, permknn, quality, tokens, topn
from mosaiq.session import cut, read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.find_repeats(read(spark, d, "images"), read(spark, d, "new_images"))


def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """Records of each batch, and how many of them repeat an earlier one."""
    n = read(spark, d, "new_images").where("new_image_id is not null").groupBy("new_image_id").agg(F.min("batch_id").alias("batch_id"))
    hit = p1_found(spark, d).select(F.col("dup_id").alias("new_image_id"), F.lit(1).alias("hit"))
    g = n.join(hit, "new_image_id", "left").groupBy("batch_id")
    return g.agg(F.count(F.lit(1)).alias("records"), F.count("hit").alias("repeats"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(read(spark, d, "face_features"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "face_features")
    return describe.describe(f, cut(clusters.clusters(f)), read(spark, d, "face_person_assignments"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "face_person_assignments")
    return topn.top_n(a, "person_id", "confidence", "face_id", "assignment_id", 10, 0.0, 1.0).select("person_id", "assignment_id")


def p4_ranked(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "face_person_assignments")
    top = topn.top_n(a, "person_id", "confidence", "face_id", "assignment_id", 10, 0.0, 1.0)
    return top.select("person_id", "rank", "assignment_id", "face_id", F.round("confidence", 6).alias("confidence"))


P4_SQL = """
with a as (
  select distinct person_id, assignment_id, face_id, cast(confidence as double) confidence
  from face_person_assignments
  where person_id is not null and assignment_id is not null and confidence is not null and not isnan(confidence)
    and confidence between 0 and 1
), r as (
  select *, row_number() over (partition by person_id order by confidence desc, face_id nulls last, assignment_id) as rank from a
)
"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return permknn.pairs(permknn.neighbours(read(spark, d, "face_features")))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """As a search: every hundredth face (by id) against all faces."""
    near = permknn.neighbours(read(spark, d, "face_features"))
    return near.where("face_id % 100 = 0")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(read(spark, d, "documents"), "doc_id")


def _mixed(spark: SparkSession, d: str, fit: str) -> tuple[DataFrame, DataFrame]:
    """The plan and the mix by it."""
    sized = cut(mixing.sized_documents(read(spark, d, "documents")))
    plan = cut(mixing.mix_plan(sized, read(spark, d, "mix_targets"), fit))
    return plan, mixing.mix_sources(sized, plan)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that are used up in a mix that asks each for its full share."""
    return mixing.mix_report(*_mixed(spark, d, "demand")).where("short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d, "shares")[1]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(*_mixed(spark, d, "shares"))


def _types(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(read(spark, d, "documents"), read(spark, d, "common_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _types(spark, d).where("p_prose < 0.5").select("doc_id")


def p8_figures(spark: SparkSession, d: str) -> DataFrame:
    t = _types(spark, d)
    return t.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in t.dtypes])


def p8_accuracies(spark: SparkSession, d: str) -> DataFrame:
    """What was learnt about each threshold: how often a level's vote is right, and how often the level occurs."""
    figs = quality.text_figures(read(spark, d, "documents"), read(spark, d, "common_words"))
    got = [(f, n, v, round(a, 6), round(c, 6)) for f, n, v, a, c in quality.accuracies(*quality.patterns(figs))]
    return spark.createDataFrame(got, "figure string, level int, votes_for string, accuracy double, coverage double")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_batches, p3_found, p3_clusters, p4_found, p4_ranked, p5_found, p5_neighbours, p6_ids, p7_found, p7_mix, p7_shares, p8_found, p8_figures, p8_accuracies)}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": P4_SQL + "select person_id, assignment_id from r where rank <= 10",
        "p4_ranked": P4_SQL + "select person_id, cast(rank as int) as rank, assignment_id, face_id, round(confidence, 6) as confidence from r where rank <= 10",
    }
