import math

from mosaiq.llm import mixing


def sized(spark):
    rows = [(k, "a", 10) for k in range(500)] + [(1000 + k, "b", 5) for k in range(40)] + [(2000, "z", 7), (2001, None, 9), (None, "a", 10)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


TARGETS = [(" A ", 0.4, 2), ("b", 0.5, 3), ("c", 0.1, 5), (None, 0.2, 1)]


def test_plan_and_mix(spark):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    s = sized(spark)
    plan = mixing.mix_plan(s, t, "demand")
    p = {r.source: r for r in plan.collect()}
    total = 501 * 10 + 40 * 5
    assert p["a"].total == total and p["a"].size == 5010 and set(p) == {"a", "b", "c"}
    assert abs(p["a"].copies - 0.4 * total / 5010) < 1e-12 and p["b"].copies == 3.0
    m = mixing.mix_sources(s, plan, buckets=16).collect()
    per = {k: [r.copies for r in m if r.source == k] for k in ("a", "b")}
    assert set(per["a"]) == {1} and set(per["b"]) == {3} and len(per["b"]) == 40
    rate = p["a"].copies
    assert len(per["a"]) in (math.floor(501 * rate), math.ceil(501 * rate))
    rep = {r.source: r for r in mixing.mix_report(plan, mixing.mix_sources(s, plan, buckets=16)).collect()}
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9 and rep["c"].actual_share == 0.0
    assert {k for k, r in rep.items() if r.short} == {"b", "c"}


def test_actual_shares_meet_their_targets(spark):
    """A short source makes the mix smaller, or is used up while the others keep their proportions."""
    rows = [(k, "a", 10) for k in range(3000)] + [(5000 + k, "b", 10) for k in range(500)] + [(9000 + k, "c", 10) for k in range(2000)]
    s = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("a", 0.4, 3), ("b", 0.4, 2), ("c", 0.2, 1), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    total = 55_000

    def report(fit):
        plan = mixing.mix_plan(s, t, fit)
        return {r.source: r for r in mixing.mix_report(plan, mixing.mix_sources(s, plan)).collect()}

    r = report("shares")
    assert all(abs(x.actual_share - x.target_share) < 0.001 for x in r.values())
    assert abs(sum(x.emitted_tokens for x in r.values()) - 10_000 / 0.4) < 50 and {k for k, x in r.items() if x.short} == {"b"}
    r = report("size")
    assert abs(sum(x.emitted_tokens for x in r.values()) - total) < 50 and r["b"].emitted_tokens == 10_000
    assert abs(r["a"].emitted_tokens - 30_000) < 30 and abs(r["c"].emitted_tokens - 15_000) < 30


def test_systematic_positions(spark):
    """Copies follow from the boundaries that position * rate + offset crosses."""
    t = spark.createDataFrame([("a", 0.7, 4), ("b", 0.3, 4)], "source string, target_share double, max_repeats int")
    s = sized(spark)
    plan = mixing.mix_plan(s, t)
    rate = {r.source: r.copies for r in plan.collect()}
    m = mixing.mix_sources(s, plan, seed=11, buckets=8).collect()
    for k, n in (("a", 501), ("b", 40)):
        u = mixing.offset(k, 11)
        assert sum(r.copies for r in m if r.source == k) == math.floor(n * rate[k] + u)


def test_empty(spark):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    e = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    plan = mixing.mix_plan(e, t)
    assert {(r.source, r.short) for r in mixing.mix_report(plan, mixing.mix_sources(e, plan)).collect()} == {("a", False), ("b", False), ("c", False)}
    assert mixing.mix_sources(e, plan).collect() == []
    assert mixing.mix_plan(e, t.limit(0)).collect() == []
