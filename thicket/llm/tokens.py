"""Encoding of the whole corpus with a public byte-level BPE (problem 6).

Method: the tiktoken library with a local rank file, without special tokens. Long texts are cut
at boundaries that the split pattern can never cross, so the pieces' ids concatenate to the ids
of the whole text; decoding concatenates the raw bytes of the ids.

Defined results. A null or empty text has the empty list; strings of special tokens are
ordinary text; every row comes out once, with its other columns untouched. Ids outside the
vocabulary decode to null.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from thicket.plans.scale import fan_out

#: The rank file on every machine of the cluster; a parameter of each operator here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a text is encoded in pieces.
LONG = 200_000
#: A piece never spans from a character to white space after it, nor between a letter and an ASCII digit.
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@functools.cache
def encoding(ranks: str = RANKS):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def pieces(text: str, long: int = LONG):
    """``text`` cut at the first safe boundary after every ``long`` characters."""
    start = 0
    while len(text) - start > long:
        m = _SAFE.search(text, start + long)
        if not m or m.start() >= len(text):
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str | None, ranks: str = RANKS, long: int = LONG) -> list[int]:
    if not text:
        return []
    e = encoding(ranks)
    if len(text) <= long:
        return e.encode_ordinary(text)
    return [i for p in pieces(text, long) for i in e.encode_ordinary(p)]


def decode(ids: list[int], ranks: str = RANKS) -> bytes | None:
    """The raw bytes of ``ids``; null if one isn't in the vocabulary."""
    try:
        return encoding(ranks).decode_bytes(ids)
    except (KeyError, OverflowError):
        return None


def _rows(df: DataFrame, text: str, out: str, kind: T.DataType, make) -> DataFrame:
    """``df`` with ``text`` replaced by ``out``, made from each text by ``make``."""
    keep = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, kind)])
    arrow = {"array": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string()}[kind.typeName() if kind.typeName() != "long" else "bigint"]

    def run(batches):
        for b in batches:
            t = b.column(b.num_columns - 1)
            values = pa.array([make(x.as_py()) for x in t], arrow)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), values], names=[*keep, out])

    return fan_out(df.select(*keep, text)).mapInArrow(run, schema)


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``df`` with the ids of ``text`` in ``out`` instead of the text."""
    return _rows(df, text, out, T.ArrayType(T.IntegerType()), lambda x: encode(x, ranks))


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", ranks: str = RANKS) -> DataFrame:
    """``df`` with the number of ids of ``text`` in ``out`` instead of the text."""
    return _rows(df, text, out, T.LongType(), lambda x: len(encode(x, ranks)))


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "text", ranks: str = RANKS) -> DataFrame:
    """``df`` with the text of the id lists; bytes that are no UTF-8 become replacement marks."""

    def text(x):
        raw = decode(x or [], ranks)
        return None if raw is None else raw.decode("utf-8", "replace")

    return _rows(df, ids, out, T.StringType(), text)


def document_ids(documents: DataFrame) -> DataFrame:
    return encode_texts(documents.select("doc_id", "text"))


def round_trip(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, same of each document: whether its ids decode to its text again; both ways in one pass."""

    def run(batches):
        for b in batches:
            texts = [x.as_py() or "" for x in b.column("text")]
            ids = [encode(x, ranks) for x in texts]
            same = [decode(i, ranks) == x.encode("utf-8") for i, x in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(i) for i in ids], pa.int32()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "same"])

    return fan_out(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens int, same boolean")
