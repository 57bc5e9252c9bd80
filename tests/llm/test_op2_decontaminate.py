import hashlib
import random
import re

from markloom.llm import op2_decontaminate as op
from tests.llm.rows import awkward, empty, prose, stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(FOLD))
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= own - {None}
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "1 AS gram")


def test_random_words(spark):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(["a", "B", "é", "c9", "d.d"]) for _ in range(n))
    docs = [(i, text(r.randint(0, 60))) for i in range(120)]
    bench = [(i, text(r.randint(0, 14))) for i in range(40)] + [(100, "a b c"), (101, "a b c"), (102, None), (None, "c9 é")]
    for n in (3, 10):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = sorted((tuple(x) for x in op.report(op.find_leaks(df, items(spark, bench), n)).collect()), key=repr)
        assert got == brute(docs, bench, n)


def test_awkward_rows_chunks_and_shuffled_join(spark, tmp_path, monkeypatch):
    df = stored(spark, awkward(spark), tmp_path)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    bench = [(1, prose(1, 80)[100:300]), (2, prose(2, 30_000)[90_000:90_400]), (3, "日本語 éé")]
    want = brute(rows, bench)
    assert sum(x[5] for x in want) >= 5
    monkeypatch.setattr(op, "CHUNK", 64)
    for most in (64 << 20, 0):
        monkeypatch.setattr(op, "BROADCAST_BYTES", most)
        got = sorted((tuple(x) for x in op.report(op.find_leaks(df, items(spark, bench))).collect()), key=repr)
        assert got == want
    kept = op.drop_contaminated(df, items(spark, bench))
    assert kept.columns == df.columns and kept.count() == len(rows) - sum(x[5] for x in want)
    assert {r["rid"] for r in kept.collect()} == {"own rid"}
    blank = {r["doc_id"]: r for r in op.blank_spans(df, items(spark, bench)).collect()}
    assert not any(x[5] for x in brute([(i, r["text"]) for i, r in blank.items()], bench)) and blank[2]["text"] is None


def test_hashes_only_say_where_to_look(spark, monkeypatch):
    """All windows of a length have one hash: every place is a candidate, and words decide."""
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abcdefg") for _ in range(n))
    docs, bench = [(i, text(r.randint(0, 30))) for i in range(40)], [(i, text(r.randint(1, 8))) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(op, "_word_hashes", lambda w: op.F.transform(w, lambda x: op.F.lit(7).cast("long")))
    assert sorted((tuple(x) for x in op.report(op.find_leaks(df, items(spark, bench), 4)).collect()), key=repr) == brute(docs, bench, 4)


def test_documents_keep_their_hits(spark, tmp_path):
    """The scan is split otherwise between the call and the action."""
    bench = [(1, prose(5000, 12))]
    df = spark.createDataFrame([(i % 150, prose(i, 30) + (" " + prose(5000, 12) if i % 4 == 0 else "")) for i in range(300)], "doc_id long, text string")
    df.repartition(8).write.parquet(str(tmp_path / "many"))
    key = "spark.sql.files.minPartitionNum"
    spark.conf.set(key, "8")
    try:
        kept = op.drop_contaminated(spark.read.parquet(str(tmp_path / "many")), items(spark, bench))
        blank = op.blank_spans(spark.read.parquet(str(tmp_path / "many")), items(spark, bench))
        spark.conf.set(key, "1")
        assert kept.count() == 225 and blank.count() == 300
        assert not any(x[5] for f in (kept, blank) for x in brute([tuple(r) for r in f.select("doc_id", "text").collect()], bench))
    finally:
        spark.conf.unset(key)


def test_empty(spark):
    none = items(spark, [])
    assert op.find_leaks(empty(spark), items(spark, [(1, "a b")])).count() == 0
    got = op.report(op.find_leaks(awkward(spark), none)).collect()
    assert len(got) == 13 and not any(r["contaminated"] for r in got)


def test_no_python(spark):
    plan = op.report(op.find_leaks(awkward(spark), items(spark, [(1, "a b")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
