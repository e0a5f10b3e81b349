"""Encoding: round trips, special strings, long texts cut at safe boundaries."""

import os
import random

import pytest

from thicket.llm import tokens as t

pytestmark = pytest.mark.skipif(not os.path.exists(t.RANKS), reason="no rank file")
TEXTS = ["", "plain text", "a <|endoftext|> b", "naïve Ωmega 日本語 🙂\r\n\t x", "it's we'll  two  spaces   \n\n\nlines", "1234567 abc123def", "\x00 odd \ufffd", "   "]


def test_same_as_library():
    e = t.encoding()
    for x in TEXTS:
        assert t.encode(x) == e.encode_ordinary(x)
        assert t.decode(t.encode(x)).decode() == x
    assert t.encode(None) == [] and t.decode([10**6]) is None


def test_same_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    f = t.RANKS.replace(".tiktoken", ".json")
    other = tokenizers.Tokenizer.from_file(f)
    other.encode_special_tokens = True
    for x in TEXTS:
        assert other.encode(x, add_special_tokens=False).ids == t.encode(x)


@pytest.mark.parametrize("seed", range(6))
def test_cut_texts(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "Bc", "'s", "'ll", " ", "  ", "\n", "7", "99", "é", ".", "--", "'", "日", "x1"]) for _ in range(3000))
    for long in (1, 7, 100):
        assert t.encode(text, long=long) == t.encoding().encode_ordinary(text)
        assert "".join(t.pieces(text, long)) == text


def test_tables(spark):
    df = spark.createDataFrame([(1, None, "e"), (2, "", "e"), (3, "hello world", "e")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in t.encode_texts(df).collect()}
    assert got == {1: [], 2: [], 3: t.encode("hello world")}
    assert {r["doc_id"]: r["tokens"] for r in t.count_tokens(df).collect()} == {1: 0, 2: 0, 3: 2}
    assert t.encode_texts(df.where("false")).count() == 0
    assert [r["same"] for r in t.round_trip(df).collect()] == [True] * 3
