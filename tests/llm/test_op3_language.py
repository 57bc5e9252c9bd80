import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from markloom.llm import op3_language as op
from tests.llm.rows import TEXTS, awkward, empty


def greedy(sample, text):
    """Phrases by plain search."""
    i = n = 0
    while i < len(text):
        k = 0
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        i, n = i + max(1, k), n + 1
    return n


def parsed(automaton, texts):
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return automaton.phrases(np.frombuffer(b"".join(texts), np.uint8), at).tolist()


@pytest.mark.parametrize("lane, chunk", [(256, 1 << 21), (7, 1 << 21), (3, 50), (1, 5)])
def test_phrases_against_search(monkeypatch, lane, chunk):
    monkeypatch.setattr(op, "LANE", lane), monkeypatch.setattr(op, "CHUNK", chunk)
    r = random.Random(lane)
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(n)).encode()
    for _ in range(150):
        sample = word("abc ", r.randint(0, 60))
        # texts of the sample's own pieces too: phrases that run over many lanes
        texts = [r.choice([word("abcd ", r.randint(0, 40)), sample * r.randint(0, 2), sample[r.randint(0, 30) :] + b"d" + sample]) for _ in range(r.randint(0, 6))]
        assert parsed(op.SuffixAutomaton(sample), texts) == [greedy(sample, t) for t in texts]


def test_phrases_cross_blanks_but_not_texts():
    one = op.SuffixAutomaton(b"the cat sat" + op.BETWEEN + b"on a mat")
    assert parsed(one, [b"the cat sat", b"cat saton a", b"sat on a mat", b""]) == [1, 2, 3, 0]
    assert parsed(one, ["é".encode()]) == [2]


def test_prediction_against_search(spark):
    samples = (("aa", b" the cat sat on the mat "), ("bb", b" der hund lag auf der matte, und die katze auch "), ("cc", b"the cat"))
    r = random.Random(5)
    words = "the cat sat on mat der hund lag auf matte und die katze auch zebra é".split()
    texts = ["the Cat lag", "Hund der", "", None, "123 !", "x", "sat\nauf der", "é", "catsat", *(" ".join(r.choices(words, k=r.randint(1, 12))) for _ in range(60))]
    df = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    got = {x["doc_id"]: x for x in op.identify(df, samples).collect()}
    for i, t in enumerate(texts):
        if not t or not any(map(str.isalpha, t)):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cost = [greedy(s, op.folded(t)) * math.log(len(s) + 1) for _, s in samples]
        assert got[i]["lang_pred"] == samples[cost.index(min(cost))][0], t
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(min(cost) - c) for c in cost))
        assert got[i]["score"] >= 1 / len(samples)  # the label is the one that the score says


def test_held_out_rows_teach_nothing(spark):
    text = {"p": "lorem ipsum dolor sit amet ", "q": "quick brown fox jumps over "}
    rows = [(i, text["p" if i % 2 else "q"] * 3, "p" if i % 2 else "q") for i in range(200)] + [(i, "zzz", None) for i in range(200, 220)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in op.language_id(df).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows if lang)
    assert 20 < sum(r["held_out"] for r in got.values()) < 90
    # a language that only held-out rows have isn't learned
    odd = df.withColumn("lang", F.when(op.id_hash_remainder(F.col("doc_id"), 4) == 2, "only").otherwise(F.col("lang")))
    assert {r["lang_pred"] for r in op.language_id(odd).collect()} == {"p", "q"}


def test_samples_are_whole_texts_that_differ(spark):
    """Most rows are copies, and texts open alike: whole texts are learned, each once, until there are bytes enough."""
    own = [f"opening {'x' * 50} body{i:05d} " + "tail" * (i % 7) for i in range(300)]
    rows = [(i, own[i % 300] if i % 3 else own[0], "p") for i in range(1500)] + [(2000 + i, "z" * (900 + i), "q") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = dict(op.learn(df, F.lit(True), bytes_each=3000, longest=500))
    texts = got["p"].split(op.BETWEEN)
    assert len(set(texts)) == len(texts) and set(texts) <= {t.encode() for t in own}
    assert 3000 <= sum(map(len, texts)) < 3500
    assert got["q"] == b"z" * 900  # only long texts: the shortest one
    assert sum(map(len, dict(op.learn(df, F.lit(True), bytes_each=10**7))["p"].split(op.BETWEEN))) == sum(len(t) for t in {t for _, t, k in rows if k == "p"})


def test_many_languages_share_the_bound(spark, monkeypatch):
    monkeypatch.setattr(op, "BYTES_ALL", 2000)
    df = spark.createDataFrame([(i, f"text {i} of its own", f"l{i % 10}") for i in range(1000)], "doc_id long, text string, lang string")
    got = op.learn(df, F.lit(True))
    assert len(got) == 10 and all(200 <= len(s) < 260 for _, s in got)


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op.language_id(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL AND lang_pred != 'und'").collect()
    assert len(got) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_awkward(spark):
    df = awkward(spark)
    got = op.language_id(df).collect()
    assert len(got) == len(TEXTS)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} >= {2, 3, 4, 11}
    assert op.language_id(empty(spark)).count() == 0
    none = op.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_nulls_in_a_batch():
    auto = [op.SuffixAutomaton(b"abc")]
    assert op.costs((("p", b"abc"),), auto, pa.array([None, "", "ABC"]))[:, 0].tolist() == [0.0, 0.0, math.log(4)]
