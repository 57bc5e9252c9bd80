import math
import random

import pytest
from pyspark.sql import functions as F

from markloom.llm import op9_quality as op
from markloom.llm.common import Workspace
from tests.llm.rows import awkward, empty, prose, stored


def corpus(spark, n=600):
    r = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        kind = i % 10
        text = prose(i, r.randint(20, 120))
        if kind < 2:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 2:
            w = text.split()
            w.insert(len(w) // 2, "scoundrel")
            text = " ".join(w)
        rows.append((i, text, f"host{i % 3 if i % 4 else 0}", "ab"[i % 2]))
        labels.append((i, int(kind >= 2), int(kind == 2)))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = corpus(spark)
    docs = stored(spark, docs, tmp_path)
    known = labels.filter("doc_id < 400").unionByName(labels.limit(3).selectExpr("CAST(NULL AS LONG) doc_id", "quality", "CAST(NULL AS INT) toxic"))
    got = {r["doc_id"]: r for r in op.classify(docs, known, *op.sites_of_documents()).collect()}
    assert len(got) == 600
    new = [(got[i]["keep"], i % 10 > 2) for i in range(400, 600)]
    assert sum(a == b for a, b in new) >= 196
    kept = op.keep_good(docs, known, *op.sites_of_documents())
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["keep"]}


def test_shrinkage(spark):
    """A bad host pulls its documents down, a small site stays near its parent, and rates are between them."""
    rows = [("bad", "bad/x", 0.1)] * 300 + [("good", "good/x", 0.9)] * 300 + [("good", "good/y", 0.0)] * 2 + [(None, None, 0.5)] * 3
    scored = spark.createDataFrame(rows, "host string, path string, evidence double")
    rate = {r["path"]: r for r in op.site_rates(scored).collect()}
    assert len(rate) == 4
    assert rate["bad/x"]["host_rate"] < 0.2 and rate["good/x"]["host_rate"] > 0.8
    assert rate["good/y"]["path_rate"] > 0.02 and rate["good/y"]["path_rate"] < rate["good/x"]["path_rate"]
    same = spark.createDataFrame([(f"h{i % 5}", f"h{i % 5}/p", 0.2 + 0.6 * ((i // 5) % 2)) for i in range(500)], "host string, path string, evidence double")
    assert all(abs(r["path_rate"] - 0.5) < 0.01 for r in op.site_rates(same).collect())


def plainly(rows, base):
    """Rates and posteriors by loops: (id, host, path, evidence) to (path rate, score)."""

    def of(group):
        n, s = len(group), sum(group)
        return n, s, s / n, max(sum(x * x for x in group) - s * s / n, 0.0)

    def strength(sites):  # (n, rate, within, prior mean) of each
        n, k = sum(x[0] for x in sites), len(sites)
        if k < 2 or n <= k:
            return 1000.0
        between, within = sum(a * (r - p) ** 2 for a, r, _, p in sites), sum(x[2] for x in sites)
        spread = max((between - k * within / (n - k)) / n, 1e-9)
        most = sum(a * p * (1 - p) for a, _, _, p in sites) / n
        return min(max(most / spread - 1, 2.0), 10_000.0)

    mean = sum(r[3] for r in rows) / len(rows)
    hosts, paths = {}, {}
    for _, h, p, e in rows:
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, p), []).append(e)
    a = strength([(n, r, w, mean) for n, _, r, w in map(of, hosts.values())])
    host_rate = {h: (a * mean + sum(x)) / (a + len(x)) for h, x in hosts.items()}
    b = strength([(n, r, w, host_rate[h]) for (h, _), (n, _, r, w) in zip(paths, map(of, paths.values()), strict=True)])
    path_rate = {k: (b * host_rate[k[0]] + sum(x)) / (b + len(x)) for k, x in paths.items()}
    odds = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    return {i: (path_rate[h, p], 1 / (1 + math.exp(-(odds(e) + odds(path_rate[h, p]) - odds(base))))) for i, h, p, e in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_posterior_against_loops(spark, seed):
    r = random.Random(seed)
    hosts = [None, "a", "b", "c"]
    rows = [(i, h := r.choice(hosts), r.choice([None, f"{h}/1", f"{h}/2", "shared"]), min(1.0, max(0.0, r.gauss(0.2 + 0.2 * hosts.index(h), 0.2)))) for i in range(300)]
    rows += [(1000, "alone", "alone/x", 0.01), (1001, "a", "once", 1.0)]
    ws = Workspace(spark, "test")
    scored = ws.save(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double"), "scored")
    want = plainly(rows, 0.6)
    got = op.posterior(scored, 0.6, ws).collect()
    assert len(got) == len(rows)
    for x in got:
        rate, score = want[x["doc_id"]]
        assert x["path_rate"] == pytest.approx(rate) and x["score"] == pytest.approx(score) and x["keep"] == (x["score"] >= 0.5)


def test_posterior_moves_by_the_site(spark):
    rows = [(i, "bad", "bad/x", 0.05) for i in range(500)] + [(i, "good", "good/x", 0.95) for i in range(500, 1000)]
    rows += [(2000, "bad", "bad/x", 0.5), (2001, "good", "good/x", 0.5)]
    ws = Workspace(spark, "test")
    scored = ws.save(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double"), "scored")
    got = {r["doc_id"]: r["score"] for r in op.posterior(scored, 0.5, ws).collect()}
    assert got[2000] < 0.2 and got[2001] > 0.8


def test_one_kind_of_label_and_none(spark, tmp_path):
    docs, labels = corpus(spark, 40)
    docs = stored(spark, docs, tmp_path)
    for some in (labels.limit(0), labels.filter("quality = 1 AND toxic = 0")):
        got = op.classify(docs, some, *op.sites_of_documents()).collect()
        assert len(got) == 40 and all(r["keep"] for r in got)


def test_awkward(spark, tmp_path):
    _, labels = corpus(spark, 40)
    df = stored(spark, awkward(spark), tmp_path)
    got = op.classify(df, labels, *op.sites_of_documents()).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    kept = op.keep_good(df, labels, *op.sites_of_documents())
    assert kept.columns == df.columns and kept.count() == sum(r["keep"] for r in got)
    assert kept.filter("host != 'own host'").count() == 0
    assert op.classify(stored(spark, empty(spark), tmp_path, "none"), labels, F.lit("h"), F.lit("p")).count() == 0
