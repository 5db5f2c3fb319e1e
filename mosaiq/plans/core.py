"""Queries on keys of very uneven size, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaiq.operators import hotkeys
from mosaiq.session import read

QUARTILES = (0.25, 0.5, 0.75)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    c = hotkeys.stale_counts(read(spark, d, "persons"), read(spark, d, "face_person_assignments"))
    return c.where("stored is null or stored != counted").select("person_id")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.stale_counts(read(spark, d, "persons"), read(spark, d, "face_person_assignments"))


def p2_confidence_quartiles(spark: SparkSession, d: str) -> DataFrame:
    q = hotkeys.key_quantiles(read(spark, d, "face_person_assignments"), "person_id", "confidence", QUARTILES)
    return q.selectExpr("key as person_id", "n", "prob", "round(value, 6) as value")


def p2_face_quartiles(spark: SparkSession, d: str) -> DataFrame:
    q = hotkeys.distinct_ranks(read(spark, d, "face_person_assignments"), "person_id", "face_id", QUARTILES)
    return q.selectExpr("key as person_id", "n", "prob", "value as face_id")


COUNTS = """
with n as (select person_id, max(struct_pack(u := updated_at, f := face_count)).f as stored from persons
           where person_id is not null group by person_id),
c as (select person_id, count(distinct face_id) as c from face_person_assignments
      where coalesce(lower(trim(status)), '') <> 'rejected' group by person_id),
r as (select n.person_id, n.stored, coalesce(c.c, 0) as counted from n left join c using (person_id))
"""


def _ranked(value: str, out: str, cast: str, distinct: str) -> str:
    probs = " union all ".join(f"select cast({p} as double) as prob" for p in QUARTILES)
    return f"""
with v as (select {distinct} person_id, {value} as v from face_person_assignments
           where person_id is not null and {value} is not null and not isnan({value}::double)),
r as (select person_id, v, row_number() over (partition by person_id order by v) as k,
      count(*) over (partition by person_id) as n from v), p as ({probs})
select person_id, n, prob, {cast} as {out} from r, p where k = greatest(1, ceil(prob * n))
"""


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_counts, p2_confidence_quartiles, p2_face_quartiles)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": COUNTS + "select person_id from r where stored is null or stored <> counted",
        "p2_counts": COUNTS + "select person_id, stored, counted from r",
        "p2_confidence_quartiles": _ranked("confidence", "value", "round(v::double, 6)", ""),
        "p2_face_quartiles": _ranked("face_id", "face_id", "v", "distinct"),
    }
