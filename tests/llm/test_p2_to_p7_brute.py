"""Found cases against plain Python on the smallest tables."""

import os

import duckdb
import pytest

import mosaiq.llm.queries as q
from mosaiq.llm import tokens

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{D}/documents.parquet"), reason="no test data here")


def rows(sql):
    return duckdb.sql(sql).fetchall()


def test_p7_found(spark):
    enc = tokens.encoder(os.path.join(tokens.VOCABULARY_DIR, tokens.VOCABULARY))
    size = {}
    for s, t in rows(f"select lower(trim(source)), text from '{D}/documents.parquet' where source is not null"):
        size[s] = size.get(s, 0) + len(enc.encode(t))
    target = rows(f"select source, target_share, max_repeats from '{D}/mix_targets.parquet'")
    total = sum(size.get(s, 0) for s, _, _ in target)
    want = {s for s, share, most in target if size.get(s, 0) * most < share * total}
    assert {r.source for r in q.p7_found(spark, D).collect()} == want


def test_p7_shares_reach_their_targets(spark):
    got = q.p7_shares(spark, D).collect()
    assert abs(sum(r.actual_share for r in got) - 1) < 1e-9
    assert all(r.copies <= r.max_repeats for r in got)
    assert all(r.copies == r.max_repeats for r in got if r.short and r["size"])


def test_p6_ids_are_whole(spark):
    enc = tokens.encoder(os.path.join(tokens.VOCABULARY_DIR, tokens.VOCABULARY))
    want = {k: enc.encode(t) for k, t in rows(f"select doc_id, text from '{D}/documents.parquet'")}
    assert {r.doc_id: list(r.ids) for r in q.p6_ids(spark, D).collect()} == want
