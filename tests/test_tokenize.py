import random

import pytest
from pyspark.sql import functions as F

from markloom import operators as op
from markloom.functions import tokenize as tk

O, C, S = ("OPENTAG", None), ("CLOSETAG", None), ("SELFCLOSETAG", None)
tag, attr, val, text = (lambda v: ("TAGNAME", v)), (lambda v: ("ATTRNAME", v)), (lambda v: ("ATTRVALUE", v)), (lambda v: ("TEXTCONTENT", v))
# Markup, tokens up to the end or the error, error.
ROWS = [
    ("<p> hi </p>", [O, tag("p"), text("hi "), C, tag("p")], None),
    ("< p >x", [O, tag("p")], None),
    ("<!DOCTYPE html>", [O, tag("!DOCTYPE"), attr("html")], None),
    ("<a b=c/>", [O, tag("a"), attr("b"), val("c"), S], None),
    ("<a b/>", [O, tag("a"), S], None),
    ("<a b =c>", [O, tag("a"), val("c")], None),
    ("<a b=>", [O, tag("a"), attr("b"), val("")], None),
    ("<a b=c d>", [O, tag("a"), attr("b"), val("c"), attr("d")], None),
    ("<p", [O], None),
    ("<p a=b", [O, tag("p"), attr("a")], None),
    ("x<?xml", [text("x")], "BAD_TAG_START"),
    ("</>", [C], "EMPTY_TAG_NAME"),
    ("<a =c>", [O, tag("a")], "EMPTY_ATTR_NAME"),
    ("<my-el>", [O, tag("my")], "BAD_ATTR_NAME_CHAR"),
    ("<!-- x -->", [O, tag("!")], "BAD_ATTR_NAME_CHAR"),
    ("<a b >", [O, tag("a")], "EXPECTED_EQUALS"),
    ("<a b=c/d>", [O, tag("a"), attr("b"), val("c")], "BAD_SELF_CLOSE"),
    ('<a b="c">', [O, tag("a"), attr("b"), val("")], "BAD_AFTER_VALUE"),
    ("</ p ></p a=1/>", [C, tag("p"), C, tag("p"), attr("a"), val("1"), S], None),
    ("", [], None),
]
WS, ALNUM = set("\t\n\f\r "), set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class Wrong(Exception):
    pass


def by_character(s):
    """The tokenizer as a machine of states, a character at a time: tokens, error, its offset."""
    out, state, held, skip = [], "text", "", True
    i = 0

    def fail(code):
        raise Wrong(code)

    try:
        while i < len(s):
            c = s[i]
            if skip and c in WS:
                i += 1
                continue
            skip = False
            if state == "text":
                if c == "<":
                    if held:
                        out.append(text(held))
                    state, held, skip = "switch", "", True
                else:
                    held += c
            elif state == "switch":
                if c == "/":
                    out.append(C)
                    state, skip = "name", True
                elif c in ALNUM or c == "!":
                    out.append(O)
                    state = "name"
                    continue
                else:
                    fail("BAD_TAG_START")
            elif state == "name":
                if c in ALNUM or c == "!":
                    held += c
                elif not held:
                    fail("EMPTY_TAG_NAME")
                else:
                    out.append(tag(held))
                    state, held, skip = "attr", "", True
                    continue
            elif state == "attr":
                if c in ALNUM:
                    held += c
                elif c == "=":
                    if not held:
                        fail("EMPTY_ATTR_NAME")
                    out.append(attr(held))
                    state, held, skip = "value", "", True
                elif c == ">":
                    if held:
                        out.append(attr(held))
                    state, held, skip = "text", "", True
                elif c == "/":
                    state, held = "self", ""
                elif c in WS:
                    state, held, skip = "equals", "", True
                else:
                    fail("BAD_ATTR_NAME_CHAR")
            elif state == "equals":
                if c != "=":
                    fail("EXPECTED_EQUALS")
                state, skip = "value", True
            elif state == "value":
                if c in ALNUM:
                    held += c
                else:
                    out.append(val(held))
                    state, held, skip = "after", "", True
                    continue
            elif state == "self":
                if c != ">":
                    fail("BAD_SELF_CLOSE")
                out.append(S)
                state, skip = "text", True
            elif state == "after":
                if c in ALNUM:
                    state, skip = "attr", True
                    continue
                if c == ">":
                    state, skip = "text", True
                elif c == "/":
                    state = "self"
                else:
                    fail("BAD_AFTER_VALUE")
            i += 1
    except Wrong as e:
        return out, str(e), i
    return out, None, None


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = tk.tokenized(df, ["i"], F.col("t"), with_partial=True).collect()
    errors = {r["i"]: (r["error"], r["offset"]) for r in op.token_errors(df, "i", F.col("t")).collect()}
    fine = {r["i"]: r["ok"] for r in df.select("i", tk.accepted(F.col("t")).alias("ok")).collect()}
    out = []
    for r in sorted(got, key=lambda r: r["i"]):
        error, offset = errors.get(r["i"], (None, None))
        assert fine[r["i"]] == (error is None)
        out.append(([tuple(x) for x in r["all"]], error, offset))
    return out


def test_rows(spark):
    for (m, tokens, error), (got, code, _) in zip(ROWS, run(spark, [r[0] for r in ROWS]), strict=True):
        assert (got, code) == (tokens, error), m
        assert by_character(m)[:2] == (tokens, error), m


@pytest.mark.parametrize("alphabet", ["<>/=!\"a \r\n", "<<>>/== ab", '<a b=c d="/>'])
def test_random_markup(spark, alphabet):
    r = random.Random(alphabet)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 16))) for _ in range(1500)]
    texts += ["<p>" * r.randint(0, 2) + "<a" + t for t in texts[:500]]
    for t, got in zip(texts, run(spark, texts), strict=True):
        assert got == by_character(t), t


def test_tokens_before_an_error_stand(spark):
    df = spark.createDataFrame([(1, "<p>x<my-el>y</p>")], "i int, t string")
    rows = [(r["pos"], r["kind"], r["value"]) for r in op.token_rows(df, "i", F.col("t")).orderBy("pos").collect()]
    assert rows == [(0, "OPENTAG", None), (1, "TAGNAME", "p"), (2, "TEXTCONTENT", "x")]
    assert op.page_histogram(df, "i", F.col("t")).count() == 3
    assert tk.tokens  # the single-column form gives the same
    got = df.select(tk.tokens(F.col("t")).alias("a")).first()["a"]
    assert [(x["kind"], x["value"]) for x in got] == [r[1:] for r in rows]


def test_null_empty_long(spark):
    long = "<p>" + "x" * 2_000_000 + "</p>" + "<b c=d>y</b>" * 5000
    df = spark.createDataFrame([(0, None), (1, ""), (2, long)], "i int, t string")
    rows = {r["i"]: r["n"] for r in op.token_rows(df, "i", F.col("t")).groupBy("i").agg(F.count("*").alias("n")).collect()}
    assert rows == {2: 5 + 5000 * 7}


def test_any_number_of_attributes(spark):
    """Whole, cut short by the end, and with each kind of error behind them."""
    many = "<a " + "b=c " * 100_000
    ends = {">": 2 + 2 * 100_000, "d/>": 3 + 2 * 100_000, "d=e>x": 4 + 2 * 100_000, "": 2 + 2 * 100_000}
    wrong = {'"': "BAD_AFTER_VALUE", "/x": "BAD_SELF_CLOSE", "d e": "EXPECTED_EQUALS", "d-": "BAD_ATTR_NAME_CHAR", "d=e/f": "BAD_SELF_CLOSE"}
    df = spark.createDataFrame([(k, many + end) for k, end in enumerate([*ends, *wrong])], "i int, t string")
    rows = {r["i"]: r["n"] for r in op.token_rows(df, "i", F.col("t")).groupBy("i").agg(F.count("*").alias("n")).collect()}
    errors = {r["i"]: (r["error"], r["offset"]) for r in op.token_errors(df, "i", F.col("t")).collect()}
    for k, (end, n) in enumerate(ends.items()):
        assert rows[k] == n and k not in errors, end
    for k, (end, code) in enumerate(wrong.items(), len(ends)):
        assert errors[k] == (code, len(many) + len(end) - 1), end
