import collections
import hashlib

import numpy as np
import pyarrow as pa

from markloom.llm import op4_suffix as op
from tests.llm.rows import awkward, empty, prose, stored


def brute(rows, n):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        edge = np.zeros(len(b) + 1, int)
        for s in range(len(b) - n + 1):
            if seen[b[s : s + n]] > 1:
                edge[s] += 1
                edge[s + n] -= 1
        m = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        spans = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum())
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_array():
    r = np.random.default_rng(0)
    for _ in range(400):
        t = r.integers(1, r.integers(2, 7), int(r.integers(0, 90))).astype(np.int64)
        assert op.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    t = np.tile([1, 2, 1], 200)
    assert op.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_random_passages(spark, tmp_path):
    r = np.random.default_rng(4)
    text = lambda n: "".join(r.choice(list("abé \n"), n))
    passages = [text(k) for k in (30, 60, 45, 20, 25)]
    rows = []
    for i in range(80):
        parts = [text(int(r.integers(0, 50)))]
        for _ in range(int(r.integers(0, 3))):
            p = passages[int(r.integers(len(passages)))]
            a = int(r.integers(0, len(p) // 2))
            parts += [p[a:], text(int(r.integers(0, 30)))]
        rows.append((i, "".join(parts)))
    rows += [(80, "ab" * 60), (81, "a" * 25), (82, rows[0][1])]
    df = stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path)
    for n, k in ((20, 6), (24, 24), (16, 1)):
        want = brute(rows, n)
        for hot in (op.HOT, 1):  # suffix arrays; digests of windows
            got = sorted((tuple(x) for x in op.repeats_report(df, n, k, hot).collect()), key=repr)
            assert got == want, (n, k, hot)


def test_chunks_of_long_texts(monkeypatch):
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    at = np.array([0, 100, 100, 3000, 5000])
    monkeypatch.setattr(op, "_CHUNK", 512)
    owner, s0, s1, _ = op.blocks_of(data, at, 50, 10)
    seen = sorted(w for o, a, b in zip(owner, s0, s1, strict=True) for w in [(o, x) for x in range(a, b + 1)])
    assert seen == [(o, x) for o in range(4) for x in range(max(0, at[o + 1] - at[o] - 50 + 1))]


def thue_morse(one, two, rounds=10):
    a, b = one, two
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def test_texts_whose_polynomial_hashes_collide(spark, tmp_path):
    """Any polynomial hash modulo 2**64 takes these for equal; bytes don't."""
    rows = [(i, t) for i, t in enumerate([*thue_morse("a", "b"), *thue_morse("e", "q"), *thue_morse("xy", "zw")])]
    df = stored(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    for n in (1000, 1024):
        for hot in (op.HOT, 0):
            assert sorted(tuple(x) for x in op.repeats_report(df, n, 10, hot).collect()) == brute(rows, n), (n, hot)
    data = np.frombuffer("".join(thue_morse("a", "b")).encode(), np.uint8)
    prefix = op.rolling(1).prefix(data)
    same = op.rolling(1).of(prefix, np.array([0, 1024]), np.array([1024, 2048]))
    one, two = op.digests(data, np.array([0, 1024]), np.array([1024, 2048]), b"k" * 16)
    assert same[0] == same[1] and one[0] != one[1] and two[0] != two[1]


def test_periodic_stretches(spark, tmp_path):
    """A block for each period, all equal, is one row; what is cut stays the same, alone, once more and beside others."""
    pairs = ["ab", "a", "xyz", "one two ", "é", "aab"]
    rows = [(i, f"{i}left {p * 60} right{i}") for i, p in enumerate(pairs)]
    rows += [(10 + i, f"other {p * (20 + i)} end{i}") for i, p in enumerate(pairs * 2)]
    rows += [(30, "q" * 23), (31, "uv" * 300), (32, prose(5, 30)), (33, "ab" * 9 + "z" + "ab" * 11), (34, prose(5, 30)[7:90])]
    for some in (rows, rows[3:4]):
        df = stored(spark, spark.createDataFrame(some, "doc_id long, text string"), tmp_path)
        for n, k in ((20, 6), (16, 1)):
            want = brute(some, n)
            for hot in (op.HOT, 0):
                got = sorted((tuple(x) for x in op.repeats_report(df, n, k, hot).collect()), key=repr)
                assert got == want, (len(some), n, k, hot)


def test_equal_blocks_in_a_row_are_one_row():
    text = "thing that " * 400
    batch = pa.RecordBatch.from_arrays([pa.array([text, "x" * 3000, text, prose(1, 200)]), pa.array([0, 1, 2, 3])], names=["text", "rid"])
    (got,) = op._anchors(op.N, op.K, b"k" * 16)([batch])
    rows = got.to_pandas()
    assert (rows.groupby("rid").size()[[0, 1, 2]] <= 4).all()
    for i, t in enumerate(batch.column("text").to_pylist()):  # every window still stands in one block
        own = rows[rows.rid == i]
        stop = own.s0 + own.times * (own.s1 - own.s0 + 1)
        assert own.s0.tolist() == [0, *stop.tolist()[:-1]] and stop.iloc[-1] == len(t) - op.N + 1


def test_rows_keep_their_numbers(spark, tmp_path):
    """The scan is split otherwise between the call and the action."""
    shared = prose(9, 60)
    df = spark.createDataFrame([(i, prose(i, 40) + (shared if i % 3 == 0 else "")) for i in range(300)], "doc_id long, text string")
    df.repartition(8).write.parquet(str(tmp_path / "many"))
    docs = spark.read.parquet(str(tmp_path / "many"))
    want = {r["doc_id"]: r["text"] for r in op.remove_repeats(docs).collect()}
    key = "spark.sql.files.minPartitionNum"
    spark.conf.set(key, "8")
    try:
        cut = op.remove_repeats(spark.read.parquet(str(tmp_path / "many")))
        spark.conf.set(key, "1")
        assert {r["doc_id"]: r["text"] for r in cut.collect()} == want
    finally:
        spark.conf.unset(key)
    assert len(want) == 300 and all((shared[:200] in t) is False for t in want.values())


def test_awkward(spark, tmp_path):
    df = stored(spark, awkward(spark), tmp_path)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted((tuple(x) for x in op.repeats_report(df).collect()), key=repr)
    assert got == brute(rows, op.N)
    cut = op.remove_repeats(df)
    assert cut.schema == df.schema and cut.count() == len(rows)
    by = {r["doc_id"]: r for r in cut.collect()}
    assert by[2]["text"] is None and by[5]["text"] == "" and by[6]["text"] == prose(2, 30_000) and by[1]["rid"] == "own rid"
    assert op.repeats_report(stored(spark, empty(spark), tmp_path, "none")).count() == 0


def test_cut_characters_go_whole(spark, tmp_path):
    shared = "é" * 30
    df = stored(spark, spark.createDataFrame([(1, "x" + shared), (2, "yy" + shared)], "doc_id long, text string"), tmp_path)
    texts = {r["doc_id"]: r["text"] for r in op.remove_repeats(df, 21, 5).collect()}
    assert texts == {1: "x", 2: "yy"}
