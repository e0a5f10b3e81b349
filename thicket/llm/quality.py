"""Per-document text quality statistics and whether a text is natural prose (problem 8).

Method: two ordered rule lists, induced by incremental reduced-error pruning on labelled examples
(``samples``, ``rules``) and exported to SQL CASE expressions, are applied natively over whole texts.
The first judges every line by its features and takes away structure: headings, list items, table
rows, keys and values, code, log lines, links. The second judges what is left of every paragraph. A
document is prose if at least half of its characters other than white space stand in paragraphs of
running text. Only front matter and fenced code, which Markdown itself delimits, are taken out before.

What lines are made of is counted on the bytes of Arrow batches (``lines``); shares of these counts
are the features. Lines, paragraphs and documents follow each other in one stage, without a shuffle.

Defined results. A null, empty or blank text has zero words, null shares and is neither prose nor
a case. Line ends of any system count alike. Every row comes out once, repeated ones too.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from thicket.llm import lines as ln, rules as ir
from thicket.llm.samples import labelled, labelled_lines
from thicket.plans.scale import fan_out

#: Labelled documents and lines that the rules are induced from: the bounds of the training samples.
LABELLED, LABELLED_LINES = 12_000, 24_000
#: Most rules of a list.
MOST_RULES = 45
#: A rule of paragraphs is kept if it is right for more than this share of what it covers.
LEAST_RIGHT = 0.84
#: Rules in a row that fail it before a list ends.
TRIES = 15
#: Most words of the table of common words; it is a small fixed table.
MOST_COMMON = 20_000


def common_words(common_word: DataFrame) -> list[str]:
    """The words of the small fixed table, in lower case."""
    rows = common_word.select(F.lower(F.trim("word")).alias("w")).where("w <> ''").distinct().limit(MOST_COMMON + 1).collect()
    if len(rows) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    return sorted(r["w"] for r in rows)


def _sub(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def _has(c: Column, *parts: str) -> Column:
    """Whether a text has one of ``parts``, by its bytes."""
    b = c.cast("binary")
    return reduce(lambda x, y: x | y, (F.contains(b, F.lit(x.encode())) for x in parts))


def _if(c: Column, has: str, then: Column) -> Column:
    """``then`` where ``c`` holds a string that it is about; most texts don't."""
    return F.when(F.contains(c, F.lit(has)), then).otherwise(c)


def _solid(c: Column) -> Column:
    """Characters other than white space of a cleaned text."""
    c = F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.length(_if(c, "\t", F.replace(c, F.lit("\t"), F.lit(""))))


def clean(text: Column) -> Column:
    """Line ends as line feeds, blanks of any kind as blanks, without marks of no width."""
    # by bytes, as nearly all texts have none of them
    general = _has(text, "–"[:0] or " ", " ", " ", *map(chr, range(0x2000, 0x200E)))
    rare = (F.octet_length(text) != F.length(text)) & (_has(text, "\u0085", " ", "­", "　", "﻿") | (F.contains(text.cast("binary"), F.lit(b"\xe2\x80")) & general))
    c = _sub(_sub(_sub(text, "\r\n?|[\u0085  ]", "\n"), "[\u000b\u000c  -  　]", " "), "[﻿​-‍­]", "")
    return F.when(_has(text, "\r", "\x0b", "\x0c") | rare, c).otherwise(text)


def opened(df: DataFrame, text: str) -> DataFrame:
    """``df`` with its cleaned ``text`` without front matter, fenced code, quote marks and marks such as ``<|end|>``."""
    c = F.col(text)
    fence = lambda f: _if(c, f, _sub(c, rf"(?m)^[ \t]*{f}(?!~)[^\n]*\n(?:[^\n]*\n)*?(?:[ \t]*{f}[ \t]*$|\z)", "\n"))
    front = F.when(c.startswith("---"), _sub(c, r"\A\s*---[ \t]*\n(?:[ \t]*(?:[\w-]+:|- )[^\n]*\n)*---[ \t]*(?:\n|\z)", "")).otherwise(c)
    for step in (front, fence("```"), fence("~~~"), _if(c, "<|", _sub(c, r"<\|\w++(?:\|>?|>)", "")), _if(c, ">", _sub(c, r"(?m)^[ \t]*(?:>[ \t]?)+", ""))):
        df = df.withColumn(text, step)
    return df


#: Features of a line and of a paragraph, as SQL over the counts of ``lines``; ``n`` and ``words`` are at least 1 where they divide.
_WORDS = "(common + short + long + names)"
_OF = lambda x, n: f"CAST({x} AS DOUBLE) / greatest({n}, 1)"
_LINE = {
    "lead": "lead", "item": "item", "deep": "deep", "odd_share": _OF("odd", "tokens"), "sign_share": _OF("signs + dots", "tokens"), "number_share": _OF("number", "tokens"), "part_share": _OF("parts", "tokens"),
    "gap_share": _OF("gaps", "tokens"), "key": "key", "code_share": _OF("code", "width"), "stamp": "stamp", "dots": "dots", "token_size": _OF("width", "tokens"), "words": _WORDS, "common_share": _OF("common", _WORDS),
    "stop_share": _OF("stops", "tokens"), "comma_share": _OF("commas", "tokens"), "closed": "closed", "name_share": _OF("names", _WORDS), "small": "small", "tokens": "tokens",
}
_ALL = f"({_WORDS} + signs + number + odd)"
_PARAGRAPH = {
    "common_share": _OF("common", _WORDS), "three_share": _OF("three", _WORDS), "sentence": _OF(_WORDS, "stops"), "sign_share": _OF("signs + number", _ALL), "stop_share": _OF("stops + commas", _WORDS),
    "comma_share": _OF("commas", _WORDS), "begun_share": _OF("begun", "stops"), "line_words": _OF(_WORDS, "lines"), "upper_share": "1 - " + _OF("small", "lines"), "closed_share": _OF("closed", "lines"),
    "even": _OF("width", "lines * longest"), "words": _WORDS, "short_share": _OF("common + short", _WORDS), "odd_share": _OF("odd", _ALL), "name_share": _OF("names", _WORDS),
}
LINE_FEATURES, FEATURES = tuple(_LINE), tuple(_PARAGRAPH)


def _case(case: str, features: dict[str, str], name: str, *keep: str):
    """A step that adds the verdict of a CASE expression over ``features`` as ``name``."""

    def step(df: DataFrame) -> DataFrame:
        own = [f"{e} AS _f_{f}" for f, e in features.items()]
        named = re.sub(r"\b(" + "|".join(features) + r")\b(?= (?:<=|>))", r"_f_\1", case)
        return df.selectExpr(*keep, *own).withColumn(name, F.expr(named)).select(*keep, name)

    return step


def _schema(df: DataFrame, names: list[str], numbers: dict[str, str]) -> T.StructType:
    kinds = {"int": T.IntegerType(), "long": T.LongType()}
    return T.StructType([*(T.StructField(n, kinds[k]) for n, k in numbers.items()), *(T.StructField(n, df.schema[n].dataType) for n in names)])


def _lines(df: DataFrame, words: list[str], text: str) -> tuple[DataFrame, list[str], list[str]]:
    """The counted lines of the texts of ``df``, the names its other columns have for now, and their own."""
    own = [c for c in df.columns if c != text]
    names = [f"_k{i}" for i in range(len(own))]
    d = df.select(F.coalesce(clean(F.col(text)), F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(own, names)))
    d = d.withColumn("_total", _solid(F.col("text")).cast("long"))
    d = opened(d, "text").withColumn("text", F.concat("text", F.lit("\n")))
    keep = ["_total", *names]
    schema = _schema(d, keep, {"doc": "long", "block": "int"} | {c: "int" for c in ln.COUNTS})
    return d.mapInArrow(ln.count_batches(ln.word_hashes(words), keep), schema), keep, own


def _paragraphs(df: DataFrame, words: list[str], text: str, line_case: str) -> tuple[DataFrame, list[str], list[str]]:
    lines, keep, own = _lines(df, words, text)
    needed = ["doc", "block", *(c for c in ln.SUMS), *keep]
    judged = _case(line_case, _LINE, "structure", *needed)(lines)
    schema = _schema(judged, keep, {"doc": "long", "lines": "long", "longest": "long"} | {c: "long" for c in ln.SUMS})
    return judged.mapInArrow(ln.sum_paragraphs(keep), schema), keep, own


# ---------------------------------------------------------------- rules


def line_table(spark, words: list[str], n: int = LABELLED_LINES, seed: int = 3):
    """The features of labelled lines as a pandas table with ``label`` (structure)."""
    lines = spark.createDataFrame(labelled_lines(n, seed), "id int, text string, label boolean").repartition(8)
    rows, keep, _ = _lines(lines, words, "text")
    return rows.where("tokens > 0").selectExpr("_k0 AS id", "_k1 AS label", *(f"{e} AS {f}" for f, e in _LINE.items())).orderBy("id").toPandas()


def training_table(spark, words: list[str], n: int = LABELLED, seed: int = 3, line_case: str | None = None):
    """The features of the paragraphs of labelled documents, as a pandas table with ``label`` and ``chars``."""
    docs = spark.createDataFrame(labelled(n, seed), "id int, text string, label boolean").repartition(8)
    rows, keep, _ = _paragraphs(docs, words, "text", line_case or LINE_CASE)
    # a text is named with its first paragraph only
    t = rows.selectExpr("spark_partition_id() AS part", "doc", "_k0 AS id", "_k1 AS label", "chars", *(f"{e} AS {f}" for f, e in _PARAGRAPH.items())).toPandas()
    t[["id", "label"]] = t.groupby(["part", "doc"])[["id", "label"]].transform("first")
    return t[t["chars"] > 0].sort_values("id", kind="stable").drop(columns=["part", "doc"]).reset_index(drop=True)


def induce_line_rules(spark, words: list[str], n: int = LABELLED_LINES, seed: int = 3) -> list[ir.Rule]:
    """The rule list for lines that are structure, from ``n`` labelled lines."""
    t = line_table(spark, words, n, seed)
    return ir.induce({f: t[f].to_numpy("float64") for f in LINE_FEATURES}, t["label"].to_numpy(bool), most_rules=MOST_RULES, tries=TRIES)


def induce_rules(spark, words: list[str], n: int = LABELLED, seed: int = 3, line_case: str | None = None) -> list[ir.Rule]:
    """The rule list for paragraphs that are no running text, from ``n`` labelled documents."""
    t = training_table(spark, words, n, seed, line_case)
    return ir.induce({f: t[f].to_numpy("float64") for f in FEATURES}, ~t["label"].to_numpy(bool), most_rules=MOST_RULES, least=LEAST_RIGHT, tries=TRIES)


#: The induced rules of lines as a CASE expression over their features (``induce_line_rules`` and ``to_case`` make it again).
LINE_CASE = """CASE
   
    WHEN words <= 6.5 AND small <= 0.5 AND words <= 3.5 AND stop_share <= 0.2361 THEN true
    WHEN code_share > 0.0175 AND code_share > 0.055 AND stop_share <= 0.0465 AND token_size > 7.6125 THEN true
    WHEN code_share > 0.0164 AND comma_share <= 0.0253 AND words <= 6.5 AND stop_share <= 0.0556 THEN true
    WHEN code_share > 0.0184 AND lead > 0.5 THEN true
    WHEN token_size > 7.9016 AND name_share > 0.2026 THEN true
    WHEN words <= 7.5 AND number_share > 0.1339 AND token_size > 6.8167 AND token_size > 7.8452 THEN true
    WHEN words <= 7.5 AND words <= 5.5 AND closed <= 0.5 AND sign_share > 0.05 THEN true
    WHEN code_share > 0.0077 AND comma_share <= 0.0038 AND name_share > 0.0396 AND stop_share <= 0.0465 AND part_share > 0.1319 THEN true
    WHEN words <= 8.5 AND comma_share <= 0.1056 AND small <= 0.5 AND token_size > 6.7639 AND words > 4.5 THEN true
    WHEN words <= 7.5 AND key <= 51.5 THEN true
    WHEN lead > 0.5 THEN true
    WHEN code_share > 0.0077 AND item > 0.5 THEN true
    WHEN odd_share > 0.038 AND stamp > 0.5 THEN true
    WHEN words <= 8.5 AND words <= 4.5 AND code_share > 0.0122 AND words <= 3.5 AND common_share <= 0.1667 THEN true
    WHEN words <= 8.5 AND comma_share <= 0.1056 AND token_size > 6.2929 AND stop_share <= 0.1181 AND gap_share > 0.0556 THEN true
    WHEN words <= 8.5 AND comma_share <= 0.1056 AND number_share > 0.0455 AND stop_share > 0.2929 AND closed <= 0.5 THEN true
    WHEN words <= 8.5 AND sign_share > 0.0455 AND code_share <= 0.0354 THEN true
    WHEN item > 0.5 AND stop_share > 0.1026 THEN true
    WHEN stop_share <= 0.0531 AND name_share > 0.058 AND comma_share <= 0.052 AND token_size > 5.3205 AND token_size > 5.8089 AND tokens > 4.5 THEN true
    WHEN code_share > 0.0157 AND part_share > 0.0881 AND comma_share <= 0.0572 AND token_size > 4.6273 AND code_share > 0.0276 AND token_size > 4.9107 AND common_share > 0.3485 THEN true
    WHEN token_size > 7.8048 AND stop_share <= 0.0955 AND token_size > 8.2929 AND token_size > 9.0714 THEN true
    WHEN code_share > 0.0158 AND comma_share <= 0.0449 AND stop_share <= 0.0465 AND name_share > 0.0152 THEN true
    WHEN code_share > 0.0158 AND part_share > 0.0978 AND part_share > 0.1914 AND tokens > 14.5 AND stop_share <= 0.0455 THEN true
    WHEN token_size > 7.8048 AND comma_share > 0.5536 THEN true
    WHEN code_share > 0.0157 AND odd_share > 0.0955 AND code_share <= 0.0269 THEN true
    WHEN stamp > 0.5 AND stop_share <= 0.0806 THEN true
    WHEN words <= 4.5 AND stop_share <= 0.225 AND token_size > 6.0833 AND words <= 3.5 AND tokens > 2.5 THEN true
    WHEN part_share > 0.043 AND words <= 6.5 AND name_share > 0.2083 THEN true
    WHEN part_share > 0.0339 AND token_size > 4.6011 AND comma_share <= 0.052 AND part_share > 0.1266 AND code_share > 0.0615 THEN true
    WHEN part_share > 0.0339 AND part_share > 0.0873 AND common_share > 0.2679 AND token_size > 4.6307 AND stop_share <= 0.0541 AND common_share > 0.5732 THEN true
    WHEN words <= 9.5 AND key <= 2.5 AND number_share <= 0.05 THEN true
    WHEN part_share > 0.0445 AND tokens <= 8.5 AND closed > 0.5 AND code_share <= 0.0381 AND part_share > 0.1548 THEN true
    WHEN part_share > 0.0339 AND stop_share <= 0.0537 AND name_share > 0.0572 AND words > 26.0 THEN true
    WHEN words <= 11.5 AND common_share > 0.5635 AND token_size > 5.9129 AND tokens > 8.5 THEN true
    ELSE false END"""

#: The induced rules of paragraphs (``induce_rules`` makes them again).
JUNK_CASE = """CASE
   
    WHEN comma_share <= 0.0098 AND sign_share <= 0.0021 AND line_words <= 12.6333 AND name_share > 0.0031 AND closed_share <= 0.1056 THEN true
    WHEN begun_share <= 0.4833 AND sign_share <= 0.0021 AND words > 52.5 AND common_share <= 0.0539 THEN true
    WHEN comma_share <= 0.0109 AND line_words <= 11.9375 AND sentence <= 8.9643 AND even <= 0.9943 THEN true
    WHEN begun_share <= 0.4365 AND sign_share <= 0.0021 AND words > 20.5 AND short_share > 0.6738 AND common_share > 0.7192 AND line_words > 70.5 THEN true
    WHEN begun_share <= 0.4643 AND sign_share <= 0.0021 AND words > 20.5 AND sentence > 93.5 AND even > 0.9128 AND common_share > 0.4054 AND common_share <= 0.5893 THEN true
    WHEN begun_share <= 0.4643 AND sign_share <= 0.0021 AND comma_share <= 0.0106 AND common_share <= 0.0351 AND words > 9.5 AND common_share <= 0.0209 AND words > 18.5 THEN true
    WHEN begun_share <= 0.2917 AND sign_share <= 0.002 AND common_share > 0.6008 AND line_words <= 15.45 AND line_words <= 8.5167 AND common_share <= 0.6859 THEN true
    WHEN begun_share <= 0.2917 AND sign_share <= 0.0021 AND upper_share <= 0.45 AND closed_share > 0.0263 AND stop_share <= 0.0793 THEN true
    WHEN closed_share <= 0.0263 AND sign_share <= 0.002 AND line_words <= 9.1833 AND upper_share > 0.55 AND common_share > 0.3889 THEN true
    WHEN upper_share <= 0.0172 AND sign_share <= 0.002 AND common_share <= 0.0254 AND comma_share <= 0.0755 AND sentence <= 8.9167 AND words > 6.5 THEN true
    WHEN closed_share <= 0.0179 AND sign_share <= 0.0021 AND common_share <= 0.0254 AND words > 18.5 THEN true
    WHEN begun_share <= 0.125 AND sign_share <= 0.0021 AND stop_share <= 0.0109 AND three_share > 0.1587 AND line_words <= 14.875 AND even > 0.89 THEN true
    WHEN begun_share <= 0.2917 AND sign_share <= 0.002 AND stop_share <= 0.0111 AND three_share > 0.2243 AND short_share <= 0.7797 AND common_share > 0.683 THEN true
    WHEN begun_share <= 0.125 AND sign_share <= 0.002 AND stop_share <= 0.0282 AND common_share > 0.5902 AND common_share > 0.7378 AND sentence > 20.5 AND common_share > 0.8047 THEN true
    WHEN begun_share <= 0.2917 AND sign_share <= 0.0021 AND upper_share <= 0.45 AND line_words <= 9.1964 AND comma_share <= 0.0286 AND line_words <= 6.3333 AND closed_share <= 0.75 THEN true
    WHEN begun_share <= 0.125 AND sign_share <= 0.002 AND upper_share <= 0.45 AND common_share > 0.5749 AND name_share > 0.0111 THEN true
    WHEN begun_share <= 0.2917 AND sign_share <= 0.002 AND comma_share <= 0.0109 AND line_words <= 12.9167 AND stop_share > 0.0774 AND line_words > 7.5 THEN true
    WHEN closed_share <= 0.0179 AND sign_share <= 0.0021 AND stop_share <= 0.01 AND common_share > 0.5772 AND short_share <= 0.7321 AND three_share > 0.2226 AND common_share > 0.6598 THEN true
    WHEN begun_share <= 0.125 AND sign_share <= 0.002 AND upper_share <= 0.4167 AND line_words <= 9.2273 AND stop_share > 0.1124 AND name_share > 0.0106 THEN true
    WHEN begun_share <= 0.125 AND sign_share <= 0.002 AND stop_share <= 0.0267 AND line_words <= 11.8636 AND common_share > 0.4302 AND even > 0.8935 AND line_words <= 9.65 THEN true
    WHEN closed_share <= 0.0179 AND sign_share <= 0.0021 AND line_words > 57.5 AND sentence > 98.0 AND sentence <= 123.5 THEN true
    WHEN closed_share <= 0.0179 AND sign_share <= 0.0021 AND common_share <= 0.0351 AND line_words > 9.8333 AND begun_share <= 0.75 AND sentence <= 17.5 THEN true
    WHEN begun_share <= 0.2917 AND sign_share <= 0.002 AND stop_share <= 0.0153 AND line_words > 51.5 AND short_share > 0.9135 THEN true
    WHEN begun_share <= 0.125 AND sign_share <= 0.002 AND line_words > 21.5 AND three_share > 0.121 AND short_share <= 0.7145 AND short_share <= 0.6334 AND three_share > 0.1716 THEN true
    WHEN begun_share <= 0.125 AND sign_share <= 0.002 AND common_share > 0.5745 AND line_words <= 14.8056 AND line_words <= 7.4167 THEN true
    WHEN begun_share <= 0.2917 AND sign_share <= 0.0075 AND stop_share <= 0.0109 AND common_share <= 0.069 AND short_share > 0.1144 THEN true
    WHEN begun_share <= 0.2917 AND sign_share <= 0.002 AND common_share > 0.6047 AND common_share <= 0.6607 AND sentence > 137.5 THEN true
    WHEN comma_share <= 0.0181 AND line_words <= 11.9375 AND closed_share > 0.75 AND line_words > 4.5 AND sign_share <= 0.0479 AND begun_share > 0.1667 THEN true
    WHEN begun_share <= 0.2917 AND sign_share <= 0.0075 AND sentence <= 8.5 AND short_share <= 0.225 AND sentence > 2.25 AND stop_share > 0.1484 THEN true
    WHEN closed_share <= 0.0179 AND sign_share <= 0.002 AND three_share > 0.1124 AND name_share > 0.122 THEN true
    WHEN stop_share <= 0.0427 AND line_words <= 8.8524 AND line_words <= 6.875 THEN true
    WHEN closed_share <= 0.0179 AND sign_share <= 0.002 AND three_share > 0.1124 AND line_words > 55.0 AND common_share <= 0.5399 THEN true
    ELSE false END"""


def judge(df: DataFrame, words: list[str], text: str = "text", case: str = JUNK_CASE, line_case: str = LINE_CASE) -> DataFrame:
    """``df`` without its text, with total, prose_chars and prose_share of each document."""
    parts, keep, own = _paragraphs(df, words, text, line_case)
    judged = _case(case, _PARAGRAPH, "junk", "doc", "chars", *keep)(parts).select("doc", F.when(F.col("junk"), 0).otherwise(F.col("chars")).alias("prose"), *keep)
    d = judged.mapInArrow(ln.sum_documents(keep), _schema(judged, keep, {"prose": "long"}))
    clash = ("total", "prose_chars", "prose_share")
    rest = [F.col(n).alias(c) for n, c in zip(keep[1:], own) if c not in clash]
    total = F.col("_total")
    return d.select(*rest, total.alias("total"), F.col("prose").alias("prose_chars"), F.when(total > 0, F.col("prose") / total).alias("prose_share"))


def not_prose(documents: DataFrame, common_word: DataFrame) -> DataFrame:
    """doc_id of each document whose text isn't mainly natural prose."""
    return judge(fan_out(documents.select("doc_id", "text")), common_words(common_word)).where("total > 0 AND 2 * prose_chars < total").select("doc_id")


# ---------------------------------------------------------------- statistics

def trie(words) -> str:
    """A regular expression for the words, shared beginnings written once."""
    tree: dict = {}
    for w in words:
        at = tree
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = {}

    def build(at: dict) -> str:
        end = "" in at
        parts = [re.escape(ch) + build(sub) for ch, sub in sorted(at.items()) if ch]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and not end else "(?:" + "|".join(parts) + ")"
        return body + "?" if end else body

    first = sorted(k for k in tree if k)
    groups = [first[i : i + 5] for i in range(0, len(first), 5)]
    return "|".join(f"(?=[{''.join(map(re.escape, g))}])(?:{build({k: tree[k] for k in g})})" for g in groups)


_WORD = r"[\p{L}\p{M}\p{N}]+"


def _statistics(text: Column, words: list[str]) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    n = F.regexp_count(t, F.lit(_WORD))
    solid = F.length(F.regexp_replace(t, r"\s+", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}]+", ""))
    lines = F.regexp_count(t, F.lit(r"[^\r\n]*\S[^\r\n]*"))
    ended = F.regexp_count(t, F.lit(r"[.!?:;][ \t]*(?=[\r\n]|\z)"))
    known = F.regexp_count(F.lower(t), F.lit(rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{trie(words)})(?![\p{{L}}\p{{M}}\p{{N}}])"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return {
        "words": n.cast("long"), "mean_word_length": share(letters, n), "symbol_share": share(solid - letters, solid),
        "punctuated_lines": share(ended, lines), "common_share": share(known, n),
    }


def statistics(documents: DataFrame, common_word: DataFrame) -> DataFrame:
    """doc_id, words, mean_word_length, symbol_share, punctuated_lines, common_share of each text.

    Words are runs of letters and digits, symbols all other characters but white space; a line
    is punctuated if its last character other than white space is one of ``.!?:;``.
    """
    of = _statistics(F.col("text"), common_words(common_word))
    return fan_out(documents.select("doc_id", "text")).select("doc_id", *(c.alias(n) for n, c in of.items()))


def quality(documents: DataFrame, common_word: DataFrame) -> DataFrame:
    """The statistics of each text with prose_share and whether it is prose (null for a blank text), in one reading."""
    words = common_words(common_word)
    d = fan_out(documents.select("doc_id", "text"))
    d = judge(d.select("doc_id", *(c.alias(n) for n, c in _statistics(F.col("text"), words).items()), "text"), words)
    flag = F.when(F.col("total") > 0, 2 * F.col("prose_chars") >= F.col("total"))
    rest = [c for c in d.columns if c not in ("total", "prose_chars", "prose_share")]
    return d.select(*rest, F.round("prose_share", 6).alias("prose_share"), flag.alias("prose"))


STATISTICS_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{M}\p{N}]+')) AS w FROM t),
k AS (SELECT doc_id, count(*) AS known FROM w WHERE w IN (SELECT lower(trim(word)) FROM common_word) GROUP BY doc_id),
n AS (SELECT doc_id, len(regexp_extract_all(t, '[\p{L}\p{M}\p{N}]+')) AS words, length(regexp_replace(t, '[\s\x0b]+', '', 'g')) AS solid,
  length(regexp_replace(t, '[^\p{L}\p{M}\p{N}]+', '', 'g')) AS letters,
  len(regexp_extract_all(t, '[^\r\n]*[^\s\x0b][^\r\n]*')) AS lines, len(regexp_extract_all(t || chr(10), '[.!?:;][ \t]*[\r\n]')) AS ended FROM t)
SELECT doc_id, words::BIGINT AS words, CASE WHEN words > 0 THEN round(letters / words, 6) END AS mean_word_length,
  CASE WHEN solid > 0 THEN round((solid - letters) / solid, 6) END AS symbol_share,
  CASE WHEN lines > 0 THEN round(ended / lines, 6) END AS punctuated_lines,
  CASE WHEN words > 0 THEN round(coalesce(known, 0) / words, 6) END AS common_share FROM n LEFT JOIN k USING (doc_id)"""
