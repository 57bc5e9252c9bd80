import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from markloom.llm import op6_lm as op
from tests.llm.rows import awkward, empty, prose, stored


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


@pytest.fixture(scope="module")
def lattice():
    path = op.default_vocabulary()
    _, w, _ = op.vocabulary(path)
    return op.Lattice(path, np.log(w / w.sum()))


def by_segmentation(lattice, word):
    """Sum over all segmentations, by recursion on the first piece."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, min(len(word), lattice.longest) + 1):
        i = lattice.index.get(word[:k])
        p = math.exp(lattice.log_p[i]) if i is not None else 0.0
        if k == 1 and i is None:
            p = math.exp(lattice.log_p[lattice._spelled(word[0])].sum())
        if p:
            total += p * by_segmentation(lattice, word[k:])
    return total


def test_all_segmentations(lattice):
    few = ["", "a", "the", "hello", "日本x", "🙂", "éè", "zzzz", "a" * 11]
    got = lattice.words(few)
    for w, x in zip(few, got, strict=True):
        assert math.isclose(x, math.log(by_segmentation(lattice, op.MARK + w)), rel_tol=1e-9), w


def test_matrix_equals_single_and_counts_add_up(lattice):
    r = np.random.default_rng(0)
    some = ["".join(r.choice(list("etaoins日🙂é"), int(r.integers(0, 20)))) for _ in range(200)] + ["q" * 60]
    weight = r.integers(1, 9, len(some)).astype(float)
    one, two = np.zeros(len(lattice.log_p) - 1), np.zeros(len(lattice.log_p) - 1)
    got = lattice.words(some, weight, one)
    want = [lattice._single(op.MARK + w, x, two) for w, x in zip(some, weight, strict=True)]
    assert np.allclose(got, want, rtol=1e-10) and np.allclose(one, two, atol=1e-9)


def test_substrings_are_compared_by_characters(lattice, monkeypatch):
    """Every substring takes the hash of some piece: only equal characters count."""
    some = ["the", "hello", "zzz"]
    want = lattice.words(some)
    r = np.random.default_rng(1)
    found = op.Lattice._find
    wrong = lambda self, h: np.where((got := found(self, h)) < 0, r.integers(0, len(self.pieces), len(h)), got)
    monkeypatch.setattr(op.Lattice, "_find", wrong)
    assert np.allclose(lattice.words(some), want)


def em(path, counts, rounds):
    """Weights by forward-backward over each word alone."""
    _, w, _ = op.vocabulary(path)
    log_p = np.log(w / w.sum())
    for _ in range(rounds):
        own, into = op.Lattice(path, log_p), np.full(len(log_p), op.PRIOR)
        for word, c in counts.items():
            own._single(op.MARK + word, c, into)
        log_p = np.log(into / into.sum())
    return op.Lattice(path, log_p)


def test_scores(spark, tmp_path):
    rows = [(i, prose(i % 7, 5 + i)) for i in range(60)] + [(60, None), (61, ""), (62, "new WORDS only")]
    df = stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c, ends = collections.Counter(), 0
    for i, t in rows:
        if not held[i]:
            c.update(words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    base = lambda k: math.log10((k + 1) / (n + v + 1))
    marked = df.select("doc_id", "text", (op.id_hash_remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    got = {common: {r["doc_id"]: r for r in op.score(marked, common=common).collect()} for common in (0, 20, 10_000)}
    for i, t in rows:
        w = words(t)
        for g in got.values():
            r = g[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
            assert math.isclose(r["base_score"], sum(base(c[x]) for x in w) + base(ends), rel_tol=1e-9)
            assert math.isclose(r["score"], got[10_000][i]["score"], rel_tol=1e-6) and r["score"] < 0
    # the marginal of whole documents, by all segmentations of each word
    path = op.default_vocabulary()
    end_p = (ends + op.PRIOR) / (n + 3 * op.PRIOR)
    bare = {r["doc_id"]: r["score"] for r in op.score(marked, rounds=0, common=20).collect()}
    for rounds, scores in ((op.ROUNDS, {i: r["score"] for i, r in got[20].items()}), (0, bare)):
        model, value = em(path, c, rounds), {}
        for i, t in rows[:12] + rows[-3:]:
            for x in set(words(t)) - set(value):
                value[x] = math.log10(by_segmentation(model, op.MARK + x))
            want = sum(value[x] + math.log10(1 - end_p) for x in words(t)) + math.log10(end_p)
            assert math.isclose(scores[i], want, rel_tol=1e-6), (i, rounds)
    assert sum(r["score"] for r in got[20].values()) > sum(bare.values())  # fitted weights suit the corpus better


def test_a_new_word_s_model_is_proper(lattice):
    # probabilities of the shortest words and of all that is longer can't exceed one
    start = math.exp(lattice.log_p[lattice.index[op.MARK]])
    assert sum(math.exp(x) for x in lattice.words([chr(k) for k in range(33, 127)])) < 1 and start < 1


def test_awkward(spark, tmp_path):
    got = op.lm_score(stored(spark, awkward(spark), tmp_path)).collect()
    assert len(got) == 13 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert op.lm_score(stored(spark, empty(spark), tmp_path, "none")).count() == 0


def test_nothing_to_learn(spark, tmp_path):
    df = stored(spark, spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), tmp_path)
    got = {r["doc_id"]: r for r in op.score(df.withColumn("held_out", F.lit(True))).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and got[1]["base_score"] == 0 and math.isfinite(got[1]["score"])
