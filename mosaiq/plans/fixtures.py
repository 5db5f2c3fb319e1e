"""Views on the given tables, each in Spark and as a common table expression of the same rows.

``faces`` gives the ``embeddings`` a class structure: an element is raised by the label, then the vector is normalised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.session import read

#: Columns of ``faces`` that both engines read the same way.
FACE_COLUMNS = {
    "face_id": "vec_id",
    "vector_id": "vec_id",
    "image_id": "case when vec_id % 7 = 6 then 5000 + cast(floor(vec_id / 3.0) as bigint) else label * 100 + vec_id % 9 end",
    "identity": "label",
    "person_id": "case when vec_id % 5 = 4 then null else label end",
    "quality": "((vec_id * 53) % 1000) / cast(1000.0 as double)",
    "det": "((vec_id * 37) % 101) / cast(100.0 as double)",
    "blur": "((vec_id * 43) % 101) / cast(100.0 as double)",
    "yaw": "case when vec_id % 11 = 0 then null else cast((vec_id * 71) % 181 - 90 as double) end",
    "pitch": "cast((vec_id * 29) % 121 - 60 as double)",
    "roll": "cast((vec_id * 17) % 91 - 45 as double)",
    "face_size": "cast(20 + (vec_id * 61) % 200 as double)",
    "x": "cast((vec_id * 13) % 400 as double)",
    "y": "cast((vec_id * 7) % 300 as double)",
    "w": "cast(40 + (vec_id * 11) % 160 as double)",
    "h": "cast(40 + (vec_id * 19) % 160 as double)",
    "status": "case vec_id % 7 when 0 then 'pending' when 1 then 'failed' else 'indexed' end",
    "boost": "cast(1.0 as double) + cast(0.5 as double) * (vec_id % 4)",
}
COLUMNS = ", ".join(f"{e} as {n}" for n, e in FACE_COLUMNS.items())
#: DuckDB: raise element ``identity``, then unit length.
FACES = f"""
faces0 as (select {COLUMNS}, list_transform(embedding, lambda x, i: x::double + case when i = label + 1
           then 1.0::double + 0.5::double * (vec_id % 4) else 0.0::double end) as raw from embeddings),
faces as (select *, list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) as vector from faces0)
"""
#: One query for each hundredth face, against all faces of other ids.
QUERIES = "q as (select face_id as qid, image_id as qimage, person_id as qperson, identity as qidentity, vector as qv from faces where face_id % 100 = 0)"


def faces(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    raised = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("identity"), F.col("boost")).otherwise(F.lit(0.0)))
    f = e.selectExpr(*[f"{x} as {n}" for n, x in FACE_COLUMNS.items()], "embedding").withColumn("raw", raised)
    return f.withColumn("vector", V.scale("raw", 1.0 / V.norm("raw"))).drop("embedding")


def face_queries(f: DataFrame) -> DataFrame:
    return f.where("face_id % 100 = 0").selectExpr(
        "face_id as qid", "image_id as qimage", "person_id as qperson", "identity as qidentity", "vector as qv"
    )
