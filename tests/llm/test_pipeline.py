"""The pipeline stage by stage against what each must do to its own input, and the guard without it."""

import importlib
import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from markloom.llm import op2_decontaminate, op5_simhash, op7_pack
from markloom.llm.common import Workspace
from tests.llm.rows import prose
from tests.llm.test_op2_decontaminate import brute as brute_leaks
from tests.llm.test_op5_simhash import grouped

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with planted copies, passages, benchmark windows and junk."""
    at = str(tmp_path_factory.mktemp("tables"))
    bench = [(i, prose(9000 + i, 30)) for i in range(20)]  # each in one document, else it is a repeat
    passage = prose(777, 60)
    rows, labels = [], []
    for i in range(240):
        text = prose(i, 90)
        if i % 12 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 12 == 2:
            w = prose(i - 2, 90).split()
            w[40] = "changed"
            text = " ".join(w)
        if i % 12 == 3:
            text = prose(i - 3, 90)
        if i % 12 in (4, 5):
            text = f"{text} {passage}"
        if i % 12 == 6:
            text = f"{text} {bench[i // 12][1]}"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(i % 12 != 1), 0))
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", bench, "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).repartition(2).write.parquet(f"{at}/{name}.parquet")
    return at


def by_loops(name, rows, bench):
    """What a stage must make of (doc_id, text): near copies over all pairs, repeats over all windows, benchmarks over
    all windows, packing as pieces by the tokenizer itself."""
    if name == "near_copies":
        sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
        ids = [i for i, _ in rows]
        near = lambda k: [j for j, x in enumerate(ids) if len(sets[ids[k]] & sets[x]) >= 0.8 * len(sets[ids[k]] | sets[x])]
        return {i: t for (i, t), first in zip(rows, grouped(ids, near), strict=True) if i == first}
    if name == "repeats":
        data = {i: t.encode() for i, t in rows}
        seen = Counter(b[k : k + 200] for b in data.values() for k in range(len(b) - 199))
        out = {}
        for i, b in data.items():
            gone = {j for k in range(len(b) - 199) if seen[b[k : k + 200]] > 1 for j in range(k, k + 200)}
            out[i] = bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore")
        return out
    if name == "benchmarks":
        return {i: t for (i, t), x in zip(sorted(rows), leaks(sorted(rows), bench), strict=True) if x[0] == i and not x[5]}
    words = op7_pack.WordIds(op7_pack.default_tokenizer())
    return {i: len(words.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}


def leaks(rows, bench):
    return sorted(brute_leaks(rows, bench), key=lambda x: x[0])


def test_stages(spark, tables):
    ws = Workspace(spark, "test")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = ws.save(stage(spark, docs, tables), name)
        if name != "quality":
            want = by_loops(name, [tuple(r) for r in before.select("doc_id", "text").collect()], bench)
            got = docs.groupBy("doc_id").agg(F.sum("length").alias("text")) if name == "packing" else docs
            assert {r["doc_id"]: r["text"] for r in got.collect()} == want, name
        if name != "packing":
            assert docs.columns == before.columns
            kept[name] = {r["doc_id"]: r for r in docs.collect()}
    kinds = lambda ids: {k: sum(i % 12 == k for i in ids) for k in range(12)}
    assert kinds(kept["quality"]) == {k: 0 if k == 1 else 20 for k in range(12)}
    assert kinds(kept["near_copies"]) == {k: 0 if k in (1, 2, 3) else 20 for k in range(12)}
    assert set(kept["repeats"]) == set(kept["near_copies"])
    passage = prose(777, 60)
    assert all(passage not in r["text"] and r["n_chars"] == len(r["text"]) for r in kept["repeats"].values())
    clean = {i: r["text"] for i, r in kept["near_copies"].items() if i % 12 not in (4, 5, 6)}
    assert {i: kept["repeats"][i]["text"] for i in clean} == clean
    assert kinds(kept["benchmarks"]) == {k: 0 if k in (1, 2, 3, 6) else 20 for k in range(12)}
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == set(kept["benchmarks"])
    per = {}
    for r in packed:
        per[r["sequence_id"]] = per.get(r["sequence_id"], 0) + r["length"]
    assert max(per.values()) <= 2048
    again = pipeline.run(spark, tables)
    assert sorted(map(tuple, again.select(docs.columns[:5]).collect())) == sorted(tuple(r)[:5] for r in packed)


def test_awkward_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing columns, and empty tables, through every stage and run()."""
    from tests.llm.rows import TEXTS, awkward

    docs = awkward(spark).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0), (99, 1, 0), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, None), (1, ""), (2, prose(3, 60)[50:200]), (2, None)], "item_id long, text string")
    for name, some in (("all", True), ("none", False)):
        at = f"{tmp_path}/{name}"
        for table, rows in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            (rows if some else rows.limit(0)).write.parquet(f"{at}/{table}.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        ws, n = Workspace(spark, "test"), []
        for stage, f in pipeline.STAGES:
            before, now = now, ws.save(f(spark, now, at), stage)
            assert stage == "packing" or now.schema == before.schema, stage
            n.append(now.count())
        # no label is a bad one's; three copies of prose(1, 80) and a near one, and four texts without words, are one each
        assert n[:4] == ([13, 8, 8, 7] if some else [0] * 4), n
        packed = pipeline.run(spark, at)
        assert packed.count() == n[4] and (not some or n[4] > 7)
    assert len(TEXTS) == 13


def test_stages_leave_nothing_behind(spark, tables):
    from markloom.llm.common import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    assert pipeline.run(spark, tables).count() > 0
    left = set(os.listdir(root)) - before
    assert len(left) == 1 and [os.listdir(f"{root}/{x}") for x in left] == [["packing"]]


def test_near_copies_of_a_stage_are_kept_once(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id % 12 IN (0, 3)")
    assert op5_simhash.keep_one(docs, shingle=5, words=2, segments=8, most=30, radius=1).count() == 20


def test_benchmark_windows_are_found_after_cutting(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = spark.read.parquet(f"{tables}/benchmark.parquet")
    assert op2_decontaminate.find_leaks(docs, items).filter(F.size("spans") > 0).count() == 20


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_chat_format", "op2_decontaminate"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from markloom.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    r = con.execute(ORACLE[name])
    columns = [d[0] for d in r.description]
    assert sorted(map(repr, df.select(columns).collect())) == sorted(repr(type(df.first())(**dict(zip(columns, x, strict=True)))) for x in r.fetchall())


def test_the_rest_works_without_llm(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run(["cp", "-r", f"{root}/markloom", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "markloom/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
