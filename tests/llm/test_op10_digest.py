import hashlib
import random
import unicodedata

from pyspark.sql import functions as F

from markloom.llm import op10_digest as op
from tests.llm.rows import awkward, empty, stored


def canonical(t):
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", t or "").casefold())
    return " ".join(t.split())


def test_canonical_form(spark):
    texts = ["é", "é", "STRASSE  x", "straße\n\tx", " a b　c ", "ΟΔΟΣ", "οδοσ", "ﬁ", "Å", "ậ", "ậ", None, "", "日本 🙂", "A\x85B"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", op.canonical(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [canonical(t) for t in texts]


def edited(rows):
    """By ascending (doc_id, nulls first): the last quarter becomes the next text's start."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in order]
    out = []
    for i, (k, _) in enumerate(order):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        q = len(t) // 4
        out.append((k, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_texts(spark, tmp_path):
    r = random.Random(1)
    rows = [(i * 7 % 501, "".join(r.choice("aé🙂b ") for _ in range(r.randint(0, 30)))) for i in range(501)]
    df = stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tmp_path)
    got = op.edited_fingerprints(df).collect()
    assert sorted(((x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in got), key=repr) == edited(rows)
    for buckets in (1, 2, 300):
        led = {x["doc_id"]: x["next_text"] for x in op.with_next(df, buckets).collect()}
        by = dict(rows)
        assert led == {i: by[(i + 1) % 501] for i in range(501)}
    by = {}
    for x in got:
        by.setdefault(canonical(dict(rows)[x["doc_id"]]), []).append(x)
    for same in by.values():
        assert len({x["fingerprint"] for x in same}) == 1
        assert {x["group_id"] for x in same} == {min(x["doc_id"] for x in same)} and {x["n_copies"] for x in same} == {len(same)}
    assert len({x["fingerprint"] for x in got}) == len(by)
    nxt = {x["doc_id"]: x for x in got}
    for i in range(501):
        same = canonical(dict(rows)[i]) == canonical(dict(rows)[(i + 1) % 501])
        assert nxt[i]["near_next"] == float(same) and (nxt[i]["near_edited"] == 1.0) == (nxt[i]["fingerprint"] == nxt[i]["edited_fingerprint"])


def test_hot_ids_are_cut_and_ordered(spark, tmp_path):
    """Most rows have one id or none: their ranges are cut by the texts' hashes, and each row has its successor."""
    r = random.Random(2)
    texts = [f"text {i}" for i in range(400)]
    rows = [(None, t) for t in texts[:100]] + [(7, t) for t in texts[100:300]] + [(i, t) for i, t in enumerate(texts[300:])] + [(7, texts[120])] * 3 + [(-(2**63), "least"), (2**63 - 1, "most")]
    r.shuffle(rows)
    df = stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path)
    place = {x["text"]: x["o"] for x in df.select("text", op._order(F.col("text")).alias("o")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, place[x[1]], x[1]))
    want = sorted(((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)), key=repr)
    for buckets in (1, 5, 24):
        got = op.with_next(df, buckets)
        assert sorted((tuple(x) for x in got.collect()), key=repr) == want
    plan = op.with_next(df, 24)
    assert plan.count() == len(rows)


def test_awkward(spark, tmp_path):
    df = stored(spark, awkward(spark), tmp_path)
    got = op.edited_fingerprints(df).collect()
    assert len(got) == 13
    n = {r["doc_id"]: r["n_copies"] for r in got}
    assert n[1] == n[5] == 3 and n[2] == n[3] == n[4] == 3
    assert op.edited_fingerprints(stored(spark, empty(spark), tmp_path, "none")).count() == 0
    one = stored(spark, spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string"), tmp_path, "one")
    assert op.edited_fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_no_python(spark, tmp_path):
    plan = op.edited_fingerprints(stored(spark, awkward(spark), tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
