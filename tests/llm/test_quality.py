"""Quality: rule induction, held-out accuracy, forms of documents, statistics."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import lines as ln, quality as q, rules as ir
from thicket.llm.samples import labelled

WORDS = sorted("the of to and a in is it that for was on are with as by at but not this have had they or one we all can there been if more when will who so no what up out about into them only some could these may other most our because any after over did where how first der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an aus er hat dass sie nach bei einer um am sind noch wie einem über so zum war haben nur oder aber vor wir wenn man de la le et les un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son mais comme ou si elle nous cette être fait même on quand el en y los del las por con su para lo o pero sus ha me sin sobre este ya entre cuando todo esta ser son dos también fue".split())
PROSE = "We waited at the station for almost two hours, and nobody came to tell us what had happened. There was a small house behind it when I was a child, but it is gone now."
TABLE = "| a | b |\n|---|---|\n| 1 | 2 |\n| three | four |"
CODE = "```\nfor x in y:\n    print(x)\n```"
LIST = "- red bucket\n- blue bucket\n- how to paint a door\n- who owns the door"


def shares(spark, *texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, total string, block int")
    return [r["prose_share"] for r in q.judge(df, WORDS).orderBy("doc_id").collect()]


def test_forms(spark):
    got = shares(spark, PROSE, TABLE, CODE, LIST, PROSE + "\n\n" + TABLE, "> " + PROSE, PROSE.replace(". ", ".\r\n"), None, "", " \n ")
    assert got[0] == 1.0 and got[1] == got[2] == got[3] == 0.0 and 0.5 < got[4] < 1.0 and got[5] > 0.95 and got[6] == 1.0 and got[7:] == [None] * 3


def test_found_leaves_blank_texts_out(spark):
    docs = spark.createDataFrame([(1, PROSE), (2, TABLE), (3, None), (4, " "), (5, "x" * 300_000)], "doc_id long, text string")
    words = spark.createDataFrame([("en", w) for w in WORDS] + [(None, None)], "lang string, word string")
    assert {r["doc_id"] for r in q.not_prose(docs, words).collect()} == {2, 5}
    assert q.quality(docs, words).count() == 5
    assert q.not_prose(docs.where("false"), words).count() == 0


def test_stored_rules_hold_on_unseen_labels(spark):
    t = q.training_table(spark, WORDS, 600, seed=77)
    columns = {f: t[f].to_numpy("float64") for f in q.FEATURES}
    right = (ir.predict(ir.from_case(q.JUNK_CASE), columns) != t["label"].to_numpy(bool)).mean()
    assert right > 0.93
    t = q.line_table(spark, WORDS, 1500, seed=77)
    columns = {f: t[f].to_numpy("float64") for f in q.LINE_FEATURES}
    assert (ir.predict(ir.from_case(q.LINE_CASE), columns) == t["label"].to_numpy(bool)).mean() > 0.97


def test_rules_decide(spark):
    """Without rules only what Markdown delimits is found."""
    df = spark.createDataFrame([(1, TABLE), (2, LIST), (3, CODE)], "doc_id long, text string")
    got = {r["doc_id"]: r["prose_chars"] for r in q.judge(df, WORDS, case="CASE WHEN words <= -1.0 THEN true ELSE false END", line_case="CASE WHEN key <= -1.0 THEN true ELSE false END").collect()}
    assert got[1] > 0 and got[2] > 0 and got[3] == 0


def _plain_counts(text):
    """Tokens, words, numbers, stops and characters of each line, one by one."""
    out = []
    for i, line in enumerate(text.split("\n")):
        tokens = line.split()
        if not tokens:
            continue
        core = [t.rstrip(".,;:!?\"')]…”’») ").lstrip("(\"[“*`~+") for t in tokens]
        word = [c for c, t in zip(core, tokens) if c and all(ch.isalpha() or ch in "'-" for ch in c)]
        out.append((i, len(word), sum(c.isdigit() for c in core), sum(any(ch in ".!?…" for ch in t[len(t.rstrip(".,;:!?\"')]…”’»)")):]) for t in tokens), sum(map(len, tokens))))
    return out


def test_counts_of_lines_against_a_plain_reading():
    texts = [PROSE, "Ein Öl-Fass, Straße 12; “so” sagte er!", "a\n\n  b 7 8.\n\tc.", "x" * 50 + " y", "n'est pas là…", "", "\n\n"]
    data = np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8)
    c = ln.line_counts(data, ln.word_hashes(["ein", "er"]))
    words = c["common"] + c["short"] + c["long"] + c["names"]
    got = list(zip(c["line"].tolist(), words.tolist(), c["number"].tolist(), c["stops"].tolist(), c["chars"].tolist()))
    assert got == _plain_counts("\n".join(texts)) and c["common"].tolist()[1] == 2


def test_long_texts_in_pieces(monkeypatch):
    text = "\n".join([PROSE, "", "- item one", "k: v", "| a | b |", ""] * 40) + "\n"
    data, known = np.frombuffer(text.encode(), np.uint8), ln.word_hashes(WORDS)
    want = ln.line_counts(data, known)
    monkeypatch.setattr(ln, "SLICE", 700)
    got = ln._pieces(data, known)
    assert all((got[k] == want[k]).all() for k in want)


def test_scripts_without_blanks_and_repeated_rows(spark):
    text = "我们昨天在河边等了很久，可是没有人来告诉我们发生了什么事。后来天黑了，大家就回家了。"
    df = spark.createDataFrame([(1, text), (1, text), (1, None), (1, PROSE)], "doc_id long, text string")
    got = q.judge(df, WORDS).collect()
    assert len(got) == 4 and sorted(r["prose_chars"] for r in got)[0] == 0


def test_induction_and_export(spark):
    r = np.random.default_rng(0)
    x, y = r.random(900), r.random(900)
    label = (x > 0.7) & (y <= 0.4)
    rules = ir.induce({"x": x, "y": y}, label)
    assert (ir.predict(rules, {"x": x, "y": y}) == label).mean() > 0.97
    case = ir.to_case(rules)
    assert ir.from_case(case) == rules
    df = spark.createDataFrame([(0.9, 0.1), (0.9, 0.9), (0.1, 0.1)], "x double, y double")
    want = [(True, True), (False, False), (False, False)]
    assert [tuple(v) for v in df.select(F.expr(case), ir.to_column(rules, F.col)).collect()] == want
    assert ir.to_case([]) == "false"


def test_trie():
    import re

    words = ["the", "them", "a", "an", "über", "x.y"]
    p = re.compile(f"(?:{q.trie(words)})$")
    assert all(p.match(w) for w in words) and not p.match("th") and not p.match("b")


def test_labels_are_reproducible():
    assert labelled(20, 4) == labelled(20, 4) and sum(y for _, _, y in labelled(20, 4)) == 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_statistics_same_as_sql(spark):
    from oracle import compare, connect

    from thicket.llm import catalog

    con = connect("/root/testdata/sf0.001")
    for name in catalog.SQL:
        compare(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"), con, catalog.SQL[name])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_every_query_runs(spark):
    from thicket.llm import catalog

    for name in set(catalog.QUERIES) - set(catalog.SQL):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0, name


def test_few_signs_do_not_make_a_line_of_running_text_structure(spark):
    marked = PROSE.replace("nobody", "<|endoftext|> nobody")
    signs = [PROSE.replace("hours", x).replace("happened", x) for x in ("| hours", "hours\tor more", "hours   or more", "hours > less")]
    strewn = [" | ".join(["red", "blue", "green", "door"] * 9), " / ".join(["red", "blue", "green", "door"] * 9), "red\tblue\tgreen", "a | b | the third of them"]
    got = shares(spark, marked, *signs, *strewn)
    assert all(x > 0.85 for x in got[:5]) and got[5:] == [0.0] * 4
