import random

from pyspark.sql import functions as F

from markloom.functions import patterns as p
from markloom.operators import catalogue, pattern_counts, pattern_results
from markloom.plans.queries import SEQUENCES

RESULTS = ["TRUE", "TRUE", "FALSE", "PENDING", "TRUE", "TRUE", "FALSE", "TRUE", "TRUE", "TRUE"]


def by_value(pattern, values):
    """Feeds one value at a time: completions, and the last result."""
    i, n, last = 0, 0, None
    for v in values:
        e = pattern.elements[i]
        hit = any(a <= v <= b for a, b in e.values)
        if not hit and not e.optional:
            i, last = 0, "FALSE"
        elif i + 1 == len(pattern.elements):
            i, n, last = 0, n + 1, "TRUE"
        else:
            i, last = i + 1, "PENDING"
    return n, last


def test_known_results(spark):
    from markloom.plans.queries import seq_result

    got = {r["id"]: r["result"] for r in seq_result(spark, "").collect()}
    assert [got[i] for i in range(len(SEQUENCES))] == RESULTS
    assert [by_value(p.BY_NAME[n], bytes.fromhex(h))[1] for n, h in SEQUENCES] == RESULTS


def test_every_pattern_on_random_input(spark):
    r = random.Random(3)
    pools = {
        "byte": [0x00, 0x20, 0x2D, 0x2F, 0x3B, 0x3C, 0x3D, 0x3E, 0x3F, 0x21, 0x27, 0x4D, 0x61, 0x65, 0x67, 0x69, 0x6E, 0x63, 0x6F, 0x64, 0x74, 0x78, 0x6D, 0x6C, 0xBB, 0xBF, 0xEF, 0xFE, 0xFF],
        "codepoint": [0x0A, 0x0D, 0x20, 0x61, 0x7F, 0x9F, 0xFDD0, 0x1FFFE],
    }
    rows = []
    for i in range(150):
        data = bytes(r.choice(pools["byte"]) for _ in range(r.randint(0, 14)))
        # what patterns are made of, so that long ones complete
        if i % 3 == 0:
            q = r.choice([x for x in p.CATALOGUE if x.domain == "byte"])
            data += bytes(r.choice(list(range(e.values[0][0], e.values[0][1] + 1))) for e in q.elements)
        text = "".join(chr(r.choice(pools["codepoint"])) for _ in range(r.randint(0, 10)))
        rows.append((i, bytearray(data), text))
    df = spark.createDataFrame(rows, "i int, b binary, t string").cache()
    counts = {(x["i"], x["name"]): x["n"] for x in pattern_counts(df, "i", F.col("b"), F.col("t")).collect()}
    results = {(x["i"], x["name"]): x["result"] for x in pattern_results(df, "i", F.col("b"), F.col("t")).collect()}
    for i, data, text in rows:
        for q in p.CATALOGUE:
            n, last = by_value(q, data if q.domain == "byte" else map(ord, text))
            assert counts.get((i, q.name), 0) == n, (q.name, data, text)
            assert results[(i, q.name)] == last, (q.name, data, text)


def test_catalogue(spark):
    df = catalogue(spark)
    assert df.count() == len(p.CATALOGUE) == 29
    assert df.filter("exists(elements, e -> e.policy = 'OPTIONAL')").first()["name"] == "THREEC"
