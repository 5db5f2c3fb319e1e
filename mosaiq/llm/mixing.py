"""Mixing sources to target weights by systematic sampling.

A source's documents get the same expected number of copies, ``target_share * budget / size``, but at most
``max_repeats``. Where some source can't reach its share of the size wanted, the budget of the mix is made smaller until
each can (``fit="shares"``), or the size is kept and what is missing is left to the others in proportion to their shares
(``fit="size"``). The expected copies are prefix-summed within the source, in a pseudo-random order, one random offset
is added, and a document is emitted once for each integer boundary that its part of the sum crosses. The number of
copies of a document is so never more than one away from the expected one, and never above ``max_repeats``.

The prefix sum needs no task that sees a whole source: documents are put into hash buckets, the buckets' counts are
summed first (a table of sources x BUCKETS rows), and positions are numbered within (source, bucket).

Defined cases: sources are read without case and white space around them; documents whose source is null or not in the
targets take no part; null and empty texts have 0 tokens and take part in the numbering only; a target without
documents keeps size 0; null shares and repeats count as 0; repeated target rows count once (the largest share).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.tokens import count_tokens
from mosaiq.session import norm_text

BUCKETS = 4096


def sized_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document, source read without case and blanks."""
    d = documents.select("doc_id", norm_text(F.col("source")).alias("source"), "text")
    return count_tokens(d, ["doc_id", "source"])


def _targets(targets: DataFrame) -> DataFrame:
    t = targets.select(norm_text(F.col("source")).alias("source"), "target_share", "max_repeats")
    return t.where("source is not null").groupBy("source").agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).cast("double").alias("target_share"),
        F.coalesce(F.max("max_repeats"), F.lit(0)).cast("int").alias("max_repeats"),
    )


def mix_plan(sized: DataFrame, targets: DataFrame, fit: str = "shares") -> DataFrame:
    """One row for each target source: ``source, target_share, max_repeats, n_docs, size, total, budget, copies``.

    ``total`` is the size of all target sources, the size wanted; ``budget`` the size planned, ``copies`` the expected
    copies of each document. With ``fit="demand"`` every source is asked for its share of ``total`` as it is, whether it
    can give it or not. Sources without tokens take no part in the fitting.
    """
    t = _targets(targets)
    by_source = sized.where("source is not null").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("size")
    )
    p = t.join(by_source, "source", "left").na.fill(0, ["n_docs", "size"])
    most = F.col("size") * F.col("max_repeats")
    able = (F.col("size") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    share = F.sum(F.when(able, F.col("target_share")))
    # one row: the size wanted, the shares that can be served, and the largest mix that keeps them
    whole = p.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), share.alias("served"), F.min(F.when(able, most / F.col("target_share"))).alias("kept"))
    p = p.join(F.broadcast(whole)).withColumn("able", able).withColumn("most", most.cast("double"))
    if fit == "shares":
        p = p.withColumn("budget", F.least(F.col("total").cast("double"), F.coalesce(F.col("kept"), F.lit(0.0)) * F.col("served")))
        give = F.col("target_share") / F.col("served") * F.col("budget")
    elif fit == "size":
        p = _poured(p)
        give = F.col("give")
    else:
        p = p.withColumn("budget", F.col("total").cast("double"))
        give = F.col("target_share") * F.col("total")
    copies = F.when(F.col("able"), F.least(F.col("max_repeats").cast("double"), F.round(give / F.col("size"), 12))).otherwise(0.0)
    return p.select("source", "target_share", "max_repeats", "n_docs", "size", "total", "budget", copies.alias("copies"))


def _poured(p: DataFrame) -> DataFrame:
    """``give`` of each source: the size wanted is poured in proportion to the shares, and what a full source can't take
    goes to the others. In the order in which sources become full (size at most / share), the level at which the k-th is
    full is known from those before. As many rows as mix_targets, a fixed table."""
    level = F.when(F.col("able"), F.col("most") / F.col("target_share"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last(level), "source")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_level", level)
    full = F.coalesce(F.sum(F.when(F.col("able"), F.col("most"))).over(before), F.lit(0.0))
    rest = F.col("served") - F.coalesce(F.sum(F.when(F.col("able"), F.col("target_share"))).over(before), F.lit(0.0))
    # the level of those that aren't full, if the ones before are: the highest that fits is the true one
    p = p.withColumn("_try", F.when(F.col("able"), (F.col("total") - full) / rest))
    p = p.withColumn("_ok", F.col("_try") <= F.col("_level"))
    true = F.max(F.when(F.col("_ok"), F.col("_try"))).over(Window.partitionBy(F.lit(0)))
    p = p.withColumn("give", F.when(F.col("able"), F.least(F.col("most"), F.coalesce(true, F.col("_level")) * F.col("target_share"))).otherwise(0.0))
    return p.withColumn("budget", F.sum("give").over(Window.partitionBy(F.lit(0))))


def _offset(source: Column, seed: int) -> Column:
    """One pseudo-random offset in [0, 1) for each source."""
    h = F.conv(F.substring(F.md5(F.concat(source, F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double")
    return h / F.lit(float(1 << 32))


def offset(source: str, seed: int) -> float:
    """The same offset on the driver, for tests."""
    return int(hashlib.md5(f"{source}|{seed}".encode()).hexdigest()[:8], 16) / (1 << 32)


def mix_sources(sized: DataFrame, plan: DataFrame, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, source, n_tokens, copies``: the documents of the mix, each with its number of copies (1 or more)."""
    rate = plan.select("source", F.col("copies").alias("rate"))
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))
    d = sized.join(F.broadcast(rate), "source").where("rate > 0")  # as many rows as mix_targets, a fixed table
    d = d.withColumn("h", h).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    counts = d.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens")
    d = d.withColumn("k", F.row_number().over(within)).join(counts, ["source", "bucket"])
    u, whole = _offset(F.col("source"), seed), F.floor("rate")
    part = F.col("rate") - whole
    upto = F.floor((F.col("base") + F.col("k")) * part + u)
    below = F.floor((F.col("base") + F.col("k") - 1) * part + u)
    return d.select("doc_id", "source", "n_tokens", (whole + upto - below).cast("int").alias("copies")).where("copies > 0")


def mix_report(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """Target and actual share of each source: ``source, target_share, max_repeats, size, copies, used_docs,
    emitted_tokens, actual_share, short``. A source is short if each of its tokens is in the mix ``max_repeats`` times and
    they are still less than its share of the size wanted."""
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("used_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("emitted_tokens")
    )
    r = plan.join(got, "source", "left").na.fill(0, ["used_docs", "emitted_tokens"])
    whole = r.agg(F.sum("emitted_tokens").alias("whole"))  # one row
    share = F.when(F.col("whole") > 0, F.col("emitted_tokens") / F.col("whole")).otherwise(0.0)
    used_up = F.col("emitted_tokens") == F.col("size") * F.col("max_repeats")
    return r.join(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "size", "copies", "used_docs", "emitted_tokens", share.alias("actual_share"),
        (used_up & (F.col("emitted_tokens") < F.col("target_share") * F.col("total"))).alias("short"),
    )
