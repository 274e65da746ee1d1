"""The masked view: worked cases, places that never move, and a plain scanner on generated texts."""

from __future__ import annotations

import random
import re

from assetgraph import queries as core
from assetgraph.functions.markdown_view import line_of, masked_view
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CASES = {
    "a `b` c": ("a     c", ["code"]),
    "a ``b ` c`` d": ("a           d", ["code"]),
    "a `b c": ("a `b c", []),
    "x\n```py\nrm -rf\n```\ny": ("x\n     \n      \n   \ny", ["fence"]),
    "~~~\na\n```\n~~~~\nb": ("   \n \n   \n    \nb", ["fence"]),
    "```\nopen": ("   \n    ", ["fence"]),
    "a <!-- b\nc --> d": ("a       \n      d", ["comment"]),
    "a <!-- b": ("a       ", ["comment"]),
    "see [x](http://y/(z)) and ![i](p.png) end": ("see [x]               and ![i]        end", ["link", "link"]),
    "mail <mailto:a@b.c> or <https://x.y> <b>": ("mail " + " " * 14 + " or " + " " * 13 + " <b>", ["address", "address"]),
    "😀 `😀` é": ("😀      é", ["code"]),
    "a <!-- ` b --> `c` d": ("a                  d", ["comment", "code"]),
    "`a\n\nb`": ("`a\n\nb`", []),
    "": ("", []),
}


def test_cases(spark):
    got = {r.t: r.m for r in spark.createDataFrame([(t,) for t in CASES], "t string").select("t", masked_view(F.col("t")).alias("m")).collect()}
    for text, (view, kinds) in CASES.items():
        assert (got[text].view, [s.kind for s in got[text].spans]) == (view, kinds), text
    assert spark.createDataFrame([(None,)], "t string").select(masked_view(F.col("t")).alias("m")).first().m is None


def plain_view(text):
    """From left to right: the first thing that begins is blanked."""
    i, out, line_start = 0, [], True
    blank = lambda s: "".join(c if c in "\r\n" else " " * (len(c.encode("utf-16-le")) // 2) for c in s)
    while i < len(text):
        end = None
        if i == 0 or text[i - 1] == "\n":
            m = re.match(r" {0,3}(?:(`{3,})[^`\n]*|(~{3,})[^\n]*)(\n|$)", text[i:])
            if m and (m[3] or i + m.end() == len(text)):
                mark, at, end = m[1] or m[2], i + m.end(), len(text)
                while at < len(text):
                    line = text[at:].split("\n", 1)[0]
                    if re.fullmatch(rf" {{0,3}}{mark[0]}{{{len(mark)},}}[ \t]*", line):
                        end = at + len(line)
                        break
                    at += len(line) + 1
        if end is None and text.startswith("<!--", i):
            close = text.find("-->", i + 4)
            end = close + 3 if close >= 0 else len(text)
        if end is None and text[i] == "`" and (i == 0 or text[i - 1] != "`"):
            run = re.match("`+", text[i:])[0]
            for m in re.finditer("`+", text[i + len(run) :]):
                inner = text[i + len(run) : i + len(run) + m.start()]
                if m[0] == run and not re.search(r"\n[ \t]*\n", inner):
                    end = i + len(run) + m.end()
                    break
        if end is None and text[i] == "(" and i and text[i - 1] == "]":
            m = re.match(r"\((?:[^()\n\\]|\\.|\([^()\n]*\))*\)", text[i:])
            end = i + m.end() if m else None
        if end is None and (m := re.match(r"<(?:https?|mailto):[^<>\s]*>", text[i:])):
            end = i + m.end()
        if end is None:
            out.append(text[i])
            i += 1
        else:
            out.append(blank(text[i:end]))
            i = end
    return "".join(out)


def test_generated(spark):
    rng = random.Random(6)
    some = ["`", "``", "```", "~~~", "\n", "\n", "\n\n", " ", "a", "😀", "<!--", "-->", "[x]", "(", ")", "(u)", "<https://a>", "<", "b c"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(14))) for _ in range(1500)] + ["`x` " * 3000, "a\n" * 5000 + "```\n" + "b\n" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", masked_view(F.col("t")).alias("m"))
    for r in df.collect():
        t = texts[r.i]
        assert r.m.view == plain_view(t), repr(t)
        assert len(r.m.view.encode("utf-16-le")) == len(t.encode("utf-16-le")) and r.m.view.count("\n") == t.count("\n")


def test_lines(spark):
    t = "a\n😀 `b`\r\nc `d`"
    r = spark.createDataFrame([(t,)], "t string").withColumn("m", masked_view(F.col("t"))).select(F.transform("m.spans", lambda s: line_of(F.col("t"), s["start"])).alias("n")).first()
    assert r.n == [2, 3]


def test_query(spark):
    rows = core.QUERIES["markdown_masks"](spark, SF).collect()
    assert {r.kind for r in rows} == {"fence", "comment", "code", "link", "address"}
