"""Figures of every text, and its type by a label model over noisy thresholds.

The thresholds on the figures of ``textstats`` are labelling functions: each puts a text into one of a few levels, and a
level votes for some of the types or for none. How often a type of text shows each level is learnt by
expectation-maximisation from the functions' agreements alone (a latent class model). All functions start alike: a level
is ``START`` times as frequent in the types that it votes for as in others, whatever the function. Nothing is held
afterwards but for ``HOLD`` of the start, against empty cells; the accuracies learnt are reported by ``accuracies``. The
posterior of the types follows from the levels.

What reaches the driver are counts of level patterns, at most the product of the levels, whatever the number of texts.
All texts take part in the counts.

Defined cases: null, empty and blank texts (white space and invisible characters only) have null figures
and no type; equal texts have equal figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.textstats import Figures, blank, figures
from mosaiq.session import save, spread

TYPES = ("prose", "list", "table", "junk")
PROSE = 0
_P, _L, _T, _J = range(4)
#: Labelling functions: figure, cuts, and the types that each level votes for.
FUNCTIONS = (
    ("common_share", (0.03, 0.1, 0.18), ((_T, _J), (_L, _T), (_L, _T), (_P,))),
    ("segment_words", (3.3, 4.2), ((_L, _T), (_L, _T), (_P, _J))),
    ("list_share", (0.25, 0.55), ((_P, _T, _J), (_L,), (_L,))),
    ("table_share", (0.25, 0.55), ((_P, _L, _J), (_T,), (_T,))),
    ("short_lines", (0.62,), ((_P,), (_L, _T, _J))),
    ("symbol_ratio", (0.11, 0.2), ((_P,), (_L, _T, _J), (_T, _J))),
    ("odd_share", (0.12, 0.3), ((_P, _L), (_T, _J), (_T, _J))),
    ("distinct_share", (0.16,), ((_J,), ())),
    ("markup_share", (0.3,), ((), (_T, _J))),
    ("sentence_words", (4.0, 40.0), ((_L, _T, _J), (_P,), (_L, _T, _J))),
    ("mean_word_length", (2.0, 8.5), ((_T, _J), (_P, _L), (_T, _J))),
    ("longest_rare", (8.0, 16.0), ((_P,), (), (_L, _T, _J))),
    ("common_kinds", (1.0, 3.0), ((_T, _J), (), ())),
)
PRIOR = (0.4, 0.2, 0.2, 0.2)
START = 4.0
#: Texts' worth of the start's frequencies that stay in every estimate, as a share of all texts.
HOLD = 0.02
ROUNDS = 200
#: Texts of fewer words abstain on common words.
FEW_WORDS = 6
FIGURES = [f.name for f in fields(Figures)]


def _kinds() -> str:
    return ", ".join(f"{f.name} {'bigint' if f.type in (int, 'int') else 'double'}" for f in fields(Figures))


def _run(batches: Iterator[pa.RecordBatch], common: dict[str, frozenset[str]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [None if blank(t) else figures(t, common) for t in b.column(1).to_pylist()]
        cols = [
            pa.array([None if g is None else getattr(g, f.name) for g in got], pa.int64() if f.type in (int, "int") else pa.float64())
            for f in fields(Figures)
        ]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["k", *FIGURES])


def text_figures(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the figures of every row's text. ``common_words`` is a fixed, small table (``lang, word``)."""
    by: dict[str, set[str]] = {}
    for r in common_words.where("word is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), "word").distinct().collect():
        by.setdefault(r.lang.lower(), set()).add(r.word.lower())
    common = {k: frozenset(v) for k, v in by.items()}
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _run(it, common), f"k {kind}, {_kinds()}").withColumnRenamed("k", key)


def pattern() -> Column:
    """All levels of a text in one number, mixed radix."""
    code = F.lit(0)
    for name, cuts, _ in FUNCTIONS:
        figure = F.when(F.col("n_words") < FEW_WORDS, F.lit(0.15)).otherwise(F.col(name)) if name == "common_share" else F.col(name)
        level = sum(((figure >= c).cast("int") for c in cuts), F.lit(0))
        code = code * (len(cuts) + 1) + level
    return code.cast("bigint")


def levels(codes: np.ndarray) -> np.ndarray:
    out = []
    for _, cuts, _ in reversed(FUNCTIONS):
        out.append(codes % (len(cuts) + 1))
        codes = codes // (len(cuts) + 1)
    return np.stack(out[::-1], axis=1) if len(codes) else np.zeros((0, len(FUNCTIONS)), int)


def votes() -> list[np.ndarray]:
    """Of each function, whether a type (row) is voted for by a level (column)."""
    return [np.array([[t in v for v in levels_] for t in range(len(TYPES))]) for _, _, levels_ in FUNCTIONS]


def fit(codes: np.ndarray, counts: np.ndarray, start: float = START) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Posterior of the types for each pattern, prior, and the frequency of each level in each type of each function, by
    expectation-maximisation on the patterns' counts."""
    lv = levels(codes)
    total, prior = counts.sum(), np.array(PRIOR)
    first = []
    for k, v in enumerate(votes()):
        seen = np.bincount(lv[:, k], weights=counts, minlength=v.shape[1]) + 1
        w = seen[None, :] * np.where(v, start, 1.0)
        first.append(w / w.sum(axis=1, keepdims=True))
    table = first
    post = np.zeros((len(codes), len(TYPES)))
    for _ in range(ROUNDS):
        log = np.log(prior)[None, :] + sum(np.log(t[:, lv[:, k]]).T for k, t in enumerate(table))
        new = np.exp(log - log.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - post).max(initial=0) < 1e-7
        post = new
        if done:
            break
        mass = post * counts[:, None]
        prior = (mass.sum(axis=0) + 1) / (total + len(TYPES))
        table = []
        for k, s in enumerate(first):
            n = np.stack([np.bincount(lv[:, k], weights=mass[:, c], minlength=s.shape[1]) for c in range(len(TYPES))])
            n += HOLD * total * s * np.array(PRIOR)[:, None] + 1e-6
            table.append(n / n.sum(axis=1, keepdims=True))
    return post, prior, table


def learn(codes: np.ndarray, counts: np.ndarray, start: float = START) -> np.ndarray:
    return fit(codes, counts, start)[0]


def patterns(figs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Level patterns of the texts of ``text_figures`` and their counts: at most the product of the levels."""
    seen = figs.where("n_chars is not null").groupBy(pattern().alias("code")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    return seen["code"].to_numpy(np.int64), seen["n"].to_numpy(float)


def accuracies(codes: np.ndarray, counts: np.ndarray) -> list[tuple[str, int, str, float, float]]:
    """Of each function's levels that vote: the function, the level, the types voted for, the share of texts at that level
    that are of these types by the posterior, and the share of texts at that level."""
    post, lv, out = learn(codes, counts), levels(codes), []
    for k, ((name, _, _), v) in enumerate(zip(FUNCTIONS, votes())):
        for level in range(v.shape[1]):
            on = lv[:, k] == level
            n = counts[on].sum()
            if v[:, level].any() and n:
                right = (post[on] * counts[on, None])[:, v[:, level]].sum() / n
                out.append((name, level, "|".join(t for t, x in zip(TYPES, v[:, level]) if x), float(right), float(n / counts.sum())))
    return out


def text_types(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the figures, ``text_type`` and the posteriors ``p_prose, p_list, p_table, p_junk``."""
    figs = save(text_figures(df, common_words, key, text).withColumn("code", F.when(F.col("n_chars").isNotNull(), pattern())))
    codes, counts = patterns(figs)
    names = [f"p_{t}" for t in TYPES]
    post = learn(codes, counts)
    best = [TYPES[k] for k in post.argmax(axis=1)] if len(post) else []
    rows = [(int(c), t, *map(float, p)) for c, t, p in zip(codes, best, post)]
    # one row a pattern: at most the product of the levels
    model = df.sparkSession.createDataFrame(rows, "code bigint, text_type string, " + ", ".join(f"{n} double" for n in names))
    return figs.join(F.broadcast(model), "code", "left").drop("code")
