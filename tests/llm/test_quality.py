import numpy as np

from mosaiq.llm import quality
from mosaiq.llm.textstats import blank, figures

COMMON = [("en", w) for w in "the a and of to in it was we that is for on with as at by from not be".split()] + [("de", "und"), ("de", "die"), (None, "x"), ("en", None), ("zh", "我们"), ("zh", "了")]
PROSE = [
    "We went to the harbour in the evening, and the light on the water was so bright that it hurt. It is not a place for a long walk.",
    "Nothing of the old house was left\nby the time we came back to it, and the\ngarden was as wild as the wood. We sat on the wall for a while.",
    "it was late so we took the bus to the station and it was not on time",
]
OTHER = [
    "- lamp\n- grey card\n- tripod\n- rain cover\n- boat\n- window", "name;size;date\n\"a\";\"12\";\"2020-01-01\"\n\"b\";\"13\";\"2020-01-02\"\n\"c\";\"14\";\"2020-01-03\"",
    "ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok", "7cEW0jojN52cGTsFgd93USmH2qnePu4I2XhR3Z2sfu8WfvZt1CNhHns0BDId+JrU", "{} $1 NULL [object Object] 0 NULL undefined -- :: NaN %s",
    "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |",
]


def rows():
    return [(k, t, 1) for k, t in enumerate(PROSE * 20 + OTHER * 3)] + [(1000, None, 1), (1001, "", 1), (1002, " \n\t", 1), (1003, "\u200b\ufeff ", 1), (None, PROSE[0], 1)]


def test_types(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, code int")
    words = spark.createDataFrame(COMMON, "lang string, word string")
    got = {r.doc_id: r for r in quality.text_types(docs, words).collect()}
    for k, t, _ in rows():
        r = got[k]
        if blank(t):
            assert r.text_type is None and r.p_prose is None and r.n_words is None
        else:
            assert (r.p_prose >= 0.5) == (t in PROSE), (t, r)
            assert abs(r.p_prose + r.p_list + r.p_table + r.p_junk - 1) < 1e-9


def test_figures():
    f = figures("We sat.\n- lamp\n", {"en": frozenset(["we"])})
    assert (f.n_words, f.n_lines, f.ended_lines) == (3, 2, 0.5) and f.list_share > 0.3


def test_patterns_round_trip(spark):
    base = len(quality.FUNCTIONS)
    codes = np.arange(0, 5000, 7)
    lv = quality.levels(codes)
    back = np.zeros(len(codes), int)
    for k, (_, cuts, _) in enumerate(quality.FUNCTIONS):
        back = back * (len(cuts) + 1) + lv[:, k]
    assert lv.shape == (len(codes), base) and (back == codes).all()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    words = spark.createDataFrame(COMMON, "lang string, word string")
    assert quality.text_types(docs, words).collect() == []


def test_very_long_text():
    f = figures("the boat and the lamp " * 50_000, {"en": frozenset(["the", "and"])})
    assert f.n_words == 250_000 and abs(f.common_share - 0.6) < 1e-9


def test_the_model_learns(spark, monkeypatch):
    """Cases barely depend on the start nor on any one threshold."""
    d = "/root/testdata/sf0.01"
    docs, words = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/common_words.parquet")
    figs = quality.text_figures(docs, words).where("n_chars is not null").cache()

    def cases(start=quality.START):
        coded = figs.select("doc_id", quality.pattern().alias("code")).toPandas()
        codes, at, n = np.unique(coded["code"].to_numpy(np.int64), return_inverse=True, return_counts=True)
        return set(coded["doc_id"][quality.learn(codes, n.astype(float), start)[at, 0] < 0.5])

    base = cases()
    assert len(base) > 200 and len(base ^ cases(2.0)) <= 0.02 * len(base) and len(base ^ cases(8.0)) <= 0.02 * len(base)
    whole = quality.FUNCTIONS
    for k, (name, cuts, levels) in enumerate(whole):
        for f in (0.8, 1.2):
            moved = [*whole]
            moved[k] = (name, tuple(c * f for c in cuts), levels)
            monkeypatch.setattr(quality, "FUNCTIONS", tuple(moved))
            assert len(base - cases()) <= 0.02 * len(base), (name, f)
    figs.unpersist()
