"""Per-key results over keys of very uneven size.

Distributed exact selection: the values of a key are counted in histograms that merge, and a histogram is refined
only where a wanted rank lies, until every rank is a single value. No task ever gathers the values of a key.

Two forms:

* ``distinct_ranks``: integer values, repeated values count once. The finest histogram has cells of 64 neighbouring
  values, each held as a bitmap, so a cell is merged with OR and its count is the number of set bits.
* ``key_quantiles``: any numeric values, repeated values count as often as they occur. The value's 64 bits, put into
  an order-preserving form, are refined by ``BITS`` bits a pass.

Refinement goes ``BITS`` bits a pass, from the coarsest cells in which the values differ. After each pass only the cells
in which a wanted rank lies are kept (``_refined``), so a pass reads about 1/2^BITS of the one before for each rank; it
ends when each of these holds a single finest cell.

Both shuffle on (key, cell), so a key with a third of all rows is spread over as many tasks as it has cells, and both
are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.session import save

BITS = 8


def distinct_cells(df: DataFrame, key: str, value: str) -> DataFrame:
    """Finest histogram of distinct integer values: ``key, cell, bits, n``. Null keys and null values are left out."""
    return (
        df.select(F.col(key).alias("key"), F.col(value).cast("bigint").alias("v"))
        .where("key is not null and v is not null")
        .groupBy("key", F.expr("shiftright(v, 6)").alias("cell"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(v & 63 as int)))").alias("bits"))
        .withColumn("n", F.expr("bit_count(bits)").cast("bigint"))
    )


def distinct_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n``: exact number of distinct values of each key, by selecting the last of them: its rank is their number."""
    return distinct_ranks(df, key, value, (1.0,)).select("key", "n")


def distinct_ranks(df: DataFrame, key: str, value: str, probs: tuple[float, ...]) -> DataFrame:
    """``key, n, prob, value``: exact quantiles of the distinct values of each key.

    The quantile of p is the value of rank max(1, ceil(p * n)) in ascending order. The histogram is refined from
    cells of 2^(6+8j) values down to the bitmap that holds the rank.
    """
    cells = save(distinct_cells(df, key, value))
    want, cells = _refined(cells, "n", {float(p): _rank(p) for p in probs})
    leaf = cells.select("key", F.col("cell").alias("c"), "bits")
    found = want.join(leaf, ["key", "c"])
    # the r-th set bit: the only position whose bit is set with r bits up to and including it
    pos = F.expr(
        "filter(sequence(0, 63), i -> (shiftright(bits, i) & 1) = 1 and "
        "bit_count(bits & shiftrightunsigned(-1L, 63 - i)) = r)[0]"
    )
    return found.select("key", "n", "prob", (F.col("c") * 64 + pos).alias("value"))


def key_quantiles(df: DataFrame, key: str, value: str, probs: tuple[float, ...]) -> DataFrame:
    """``key, n, prob, value``: exact quantiles of the numeric ``value`` of each key, repeated values included.

    Rank max(1, ceil(p * n)); null keys, null values and NaN are left out; -0.0 counts as 0.0.
    """
    return key_ranks(df, key, value, {float(p): _rank(p) for p in probs})


def _rank(p: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n"))).cast("bigint")


def key_ranks(df: DataFrame, key: str, value: str, ranks: dict) -> DataFrame:
    """``key, n, prob, value`` as ``key_quantiles``: for each name in ``ranks`` (in the column ``prob``), the value of the
    1-based rank that its expression gives from ``n``; names are of one type. Ranks outside 1 to n give no row."""
    v = F.col(value).cast("double") + F.lit(0.0)
    base = (
        df.select(F.col(key).alias("key"), v.alias("v"))
        .where("key is not null and v is not null and not isnan(v)")
        .groupBy("key", "v")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    base = save(base.withColumn("cell", _ordered_bits(F.col("v"))))
    want, base = _refined(base, "m", ranks)
    leaf = base.select("key", F.col("cell").alias("c"), "v")
    return want.join(leaf, ["key", "c"]).select("key", "n", "prob", F.col("v").alias("value"))


def _refined(cells: DataFrame, count: str, ranks: dict) -> tuple[DataFrame, DataFrame]:
    """``key, n, prob, r, c``: the finest cell of each wanted rank and the rank within it; and the cells left (of those
    given, in the neighbourhood of the wanted ones)."""
    ends = cells.agg(F.min("cell"), F.max("cell")).first()
    low, high = ends[0] or 0, ends[1] or 0
    top = 0
    while (high >> top) - (low >> top) >= 1 << BITS:
        top += BITS
    want = None
    for shift in range(top, -1, -BITS):
        step = cells.groupBy("key", F.expr(f"shiftright(cell, {shift})").alias("c")).agg(F.sum(count).alias("m"))
        if want is None:
            want = _narrow(_wanted(step.groupBy("key").agg(F.sum("m").alias("n")), ranks), step, ["key"])
        else:
            step = step.withColumn("up", F.expr(f"shiftright(c, {BITS})"))
            want = _narrow(want.withColumnRenamed("c", "up"), step, ["key", "up"])
        want = save(want)
        if shift:
            near = want.select("key", F.col("c").alias("_c")).distinct()
            kept = save(cells.withColumn("_c", F.expr(f"shiftright(cell, {shift})")).join(near, ["key", "_c"], "left_semi"))
            cells = kept.drop("_c")
            if kept.groupBy("key", "_c").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():  # every rank is resolved
                one = kept.select("key", F.col("_c").alias("c"), "cell")
                return want.join(one, ["key", "c"]).select("key", "n", "prob", "r", F.col("cell").alias("c")), cells
    return want, cells


def _wanted(n: DataFrame, ranks: dict) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("prob"), r.cast("bigint").alias("r")) for name, r in ranks.items()]))
    return n.select("key", "n", each.alias("x")).select("key", "n", "x.prob", "x.r")


def _narrow(want: DataFrame, step: DataFrame, on: list[str]) -> DataFrame:
    """One refinement: the cell that holds each wanted rank, and the rank within it. A parent has 2^BITS cells at most."""
    w = Window.partitionBy(*on).orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumn("upto", F.sum("m").over(w))
    hit = (F.col("r") <= F.col("upto")) & (F.col("r") > F.col("upto") - F.col("m"))
    joined = want.join(step, on).where(hit)
    return joined.select("key", "n", "prob", (F.col("r") - F.col("upto") + F.col("m")).alias("r"), "c")


def _ordered_bits(v: Column) -> Column:
    """Signed 64-bit integers in the order of the doubles, from the IEEE form: sign, exponent, fraction."""
    a = F.abs(v)
    e = F.when(a == 0, F.lit(-1075)).otherwise(F.floor(F.log2(a))).cast("int")
    # log2 may be off by one at powers of two; put right by comparison
    e = F.when((a > 0) & (F.pow(F.lit(2.0), e) > a), e - 1).when((a > 0) & (F.pow(F.lit(2.0), e + 1) <= a), e + 1).otherwise(e)
    e = F.greatest(e, F.lit(-1022))
    frac = (a / F.pow(F.lit(2.0), e) * F.pow(F.lit(2.0), F.lit(52))).cast("bigint")
    bits = (e + 1022).cast("bigint") * F.lit(1 << 52) + frac
    bits = F.when(a == F.lit(float("inf")), F.lit(2047 << 52)).when(a == 0, F.lit(0)).otherwise(bits)
    return F.when(v < 0, -bits).otherwise(bits).cast("bigint")


def stale_counts(persons: DataFrame, assignments: DataFrame) -> DataFrame:
    """``person_id, stored, counted``: the newest stored ``face_count`` of each person beside the number of distinct
    faces assigned to the person (assignments of status rejected left out; a null status is not rejected).

    Persons without assignments count 0; rows without person_id are left out.
    """
    newest = persons.where("person_id is not null").groupBy("person_id").agg(
        F.max(F.struct(F.col("updated_at"), F.col("face_count"))).getField("face_count").alias("stored")
    )
    kept = assignments.where(F.coalesce(F.lower(F.regexp_replace("status", r"^\s+|\s+$", "")), F.lit("")) != "rejected")
    n = distinct_counts(kept, "person_id", "face_id")
    return newest.join(n, newest.person_id == n.key, "left").select(
        "person_id", "stored", F.coalesce("n", F.lit(0)).cast("bigint").alias("counted")
    )

