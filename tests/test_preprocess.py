from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markloom.functions import classes as c
from markloom.functions import preprocess as p

# Input and output of the newline rules.
NEWLINES = [("a\r\nb", "a\nb"), ("a\r\rb", "a\nb"), ("a\rb", "ab"), ("a\r", "a"), ("a\r\r\nb", "a\n\nb"), ("a\r\x85\nb", "a\nb")]


def run(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(df.select("i", f(F.col("t"))).collect())]


def test_newlines(spark):
    assert run(spark, [a for a, _ in NEWLINES], p.preprocess) == [b for _, b in NEWLINES]


def test_sanitize(spark):
    text = "﷐x\U0001fffey\x01z﻿\x7f\x9f\x1f\xa0"
    assert run(spark, [text, None, ""], p.sanitize) == ["xy\x01z﻿\x1f\xa0", None, ""]
    assert run(spark, [text, None, ""], p.error_count) == [4, None, 0]


def by_character(text):
    out, pending = [], False
    for x in text:
        if 0x7F <= ord(x) <= 0x9F or 0xFDD0 <= ord(x) <= 0xFDEF or ord(x) & 0xFFFE == 0xFFFE:
            continue
        if pending:
            out.append("\n" if x in "\r\n" else x)
            pending = False
        elif x == "\r":
            pending = True
        else:
            out.append(x)
    return "".join(out)


def test_against_characters(spark):
    found = []

    @settings(max_examples=300, database=None)
    @given(st.text(alphabet="\r\na\x85﷐\U0010ffff\x00é", max_size=12))
    def collect(t):
        found.append(t)

    collect()
    assert run(spark, found, p.preprocess) == [by_character(t) for t in found]


def test_sizes_of_sets():
    sizes = [c.size(s) for s in (c.SURROGATES, c.NON_CHARACTERS, c.CONTROLS, c.WHITESPACE, c.LETTERS, c.ALPHANUMERIC, c.NAME)]
    assert sizes == [2048, 66, 33, 5, 52, 62, 63]


def test_algebra():
    a, b = c.ranges((1, 5), (9, 12)), c.ranges((4, 10))
    flat = lambda s: {x for lo, hi in s for x in range(lo, hi + 1)}
    assert flat(c.union(a, b)) == flat(a) | flat(b)
    assert flat(c.difference(a, b)) == flat(a) - flat(b)
    assert flat(c.complement(a, 15)) == set(range(16)) - flat(a)
    assert c.ranges("ab", 0x63) == ((0x61, 0x63),)
