import os
import random

import pytest

from mosaiq.llm import tokens

PATH = os.path.join(tokens.VOCABULARY_DIR, tokens.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_same_ids(reference):
    r = random.Random(1)
    texts = ["", " ", "\r\n\t", "<|endoftext|> a", "a" * 1000, "don't we'll I'D", "日本語のテキスト", "🙂👍🏽 x\u200b", "\u2028\x85\xa0", "=" * 333]
    texts += ["".join(r.choice("abcdeaaaaeeeioust the in er") for _ in range(r.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([32, 10, 160, 97, r.randint(33, 0x2FFF), 0x4E00 + r.randint(0, 9000), 0x1F600 + r.randint(0, 70)])) for _ in range(30)) for _ in range(500)]
    e = tokens.encoder(PATH)
    for t in texts:
        assert e.encode(t) == reference(t)


def test_long_piece(reference):
    t = "ab" * 40_000
    assert tokens.encoder(PATH).encode(t) == reference(t)


def test_rows(spark, reference):
    rows = [(1, "Hello there", "x"), (2, "", "x"), (3, None, None), (None, "again", "y"), (3, "twice", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode_texts(df, "doc_id").collect()), key=repr)
    assert got == sorted(((k, reference(t or "")) for k, t, _ in rows), key=repr)
    n = {(r.doc_id, r.n_tokens) for r in tokens.count_tokens(df, ["doc_id"]).collect()}
    assert n == {(k, len(reference(t or ""))) for k, t, _ in rows}


def test_empty_table(spark):
    assert tokens.encode_texts(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id").collect() == []
