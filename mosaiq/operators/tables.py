"""Operators on tables: lookups, rankings, set operations and changes as new tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.hotkeys import key_ranks
from mosaiq.session import save


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows in a unique order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page beside the number of all rows. The total is a one-row aggregate, not a window over everything."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page(df, order, offset, limit).join(F.broadcast(total))


def lookup(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys``; no literal list, so any number of keys will do."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def best_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of each group in a unique order. Spark limits groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def gap_to_next_lower(df: DataFrame, group: str, score: str, name: str = "margin") -> DataFrame:
    """Score less the next strictly lower score of the group; null for the lowest. Equal scores share their gap."""
    d = df.withColumn("_d", F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc(score))))
    steps = d.select(F.col(group).alias("_g"), (F.col("_d") - 1).alias("_n"), F.col(score).alias("_lower")).distinct()
    out = d.join(steps, (F.col(group) == F.col("_g")) & (F.col("_d") == F.col("_n")), "left")
    return out.withColumn(name, F.col(score) - F.col("_lower")).drop("_d", "_g", "_n", "_lower")


def top_two_gap(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """``group, candidates, top1, top2, gap``: gap of the two highest scores, ties included; null with fewer than two."""
    w = Window.partitionBy(*group).orderBy(F.desc(score))
    d = df.withColumn("_r", F.row_number().over(w))
    pick = lambda k: F.max(F.when(F.col("_r") == k, F.col(score)))
    return d.groupBy(*group).agg(F.count(F.lit(1)).alias("candidates"), pick(1).alias("top1"), pick(2).alias("top2")).withColumn(
        "gap", F.col("top1") - F.col("top2")
    )


def nearest_rank(df: DataFrame, group: list[str], value: str, probs: dict[str, float], floor: bool = False) -> DataFrame:
    """``group..., n, mean`` and a column for each name in ``probs``: the values at the 0-based rank round(p (n - 1)), or
    floor(p n), of each group in ascending order; no interpolation. Found by refining histograms, so a group may hold most
    rows. Null values and NaN are left out; a null group is a group."""
    n = F.col("n")
    at = {name: (F.least(F.floor(F.lit(p) * n), n - 1) if floor else F.floor(F.lit(p) * (n - 1) + 0.5)) + 1 for name, p in probs.items()}
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_key", F.to_json(F.struct(*group)) if group else F.lit("{}"))
    found = key_ranks(d, "_key", value, at)
    pick = [F.max(F.when(F.col("prob") == name, F.col("value"))).alias(name) for name in probs]
    picked = found.groupBy(F.col("key").alias("_key")).agg(*pick)
    about = d.groupBy("_key", *group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return about.join(picked, "_key").drop("_key")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based places of the rows in a unique order. Rows are sorted by ranges, and each range is numbered on its own after
    the number of rows in those before it, so no task sees all."""
    r = save(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as a shuffle has partitions
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    k = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return r.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + k).drop("_p", "_before")


def insert(df: DataFrame, rows: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """``rows`` with new ids after the greatest, in a unique order."""
    last = df.agg(F.coalesce(F.max(ident), F.lit(0)).alias("_last"))
    new = numbered(rows, order, "_k").join(F.broadcast(last))
    new = new.withColumn(ident, F.col("_last") + F.col("_k")).drop("_last", "_k")
    return df.unionByName(new.select(*df.columns))


def upsert(df: DataFrame, rows: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Insert or replace: the last version of each key wins."""
    return best_per_group(df.unionByName(rows), keys, version)


def update(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values of ``columns`` where ``changes`` (one row a key) has the key; null in ``changes`` leaves the value."""
    c = changes.select(F.col(key).alias("_key"), *[F.col(x).alias(f"_{x}") for x in columns])
    out = df.join(c, F.col(key) == F.col("_key"), "left")
    for x in columns:
        out = out.withColumn(x, F.coalesce(F.col(f"_{x}"), F.col(x)))
    return out.select(*df.columns)


def delete(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti")


def set_null_where_missing(df: DataFrame, parents: DataFrame, column: str, parent: str) -> DataFrame:
    """References to rows that don't exist become null."""
    p = parents.select(F.col(parent).alias("_p")).distinct()
    return df.join(p, F.col(column) == F.col("_p"), "left").withColumn(column, F.col("_p")).drop("_p").select(*df.columns)
