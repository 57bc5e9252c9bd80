import random
import re

from markloom.llm import op8_license as op
from markloom.llm.common import WORD_BYTES
from tests.llm.rows import awkward, empty

FOLD = {i: i + 32 for i in range(65, 91)}


def padded(text):
    return b" " + b" ".join(text.encode().translate(WORD_BYTES).split()) + b" "


def labels(text):
    return {label for _, _, label, _ in op.scan(padded(text))[0]}


def test_rules():
    rules = [r for own in op.rules().values() for r in own]
    written = sum(len(names) for _, _, names in op.NAMES) + len(op.TEXTS) + len(op.FORMS)
    assert written > 300 and len(rules) > 800
    for key, own in op.rules().items():
        for _, pattern, _, _ in own:  # whatever the pattern matches holds the keyword
            inner = pattern.pattern.decode().removeprefix(" (?:").removesuffix(")(?= )")
            # a name stands in a group of its own, which is always there
            names = [inner, *re.findall(r"\(\?:((?:[^()]|\(\?:[^()]*\)|\(\?:(?:[^()]|\([^()]*\))*\))*)\)(?!\?)", inner)]
            assert any(key.decode() in x for n in names for x in op.literals(n)), (key, inner)


def examples(pattern, r):
    """A text that the pattern matches."""
    import re._parser as parser

    def out(tree):
        got = ""
        for kind, value in tree:
            kind = str(kind)
            if kind == "LITERAL":
                got += chr(value)
            elif kind == "IN":
                got += chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0]) if str(value[0][0]) != "CATEGORY" else "2"
            elif kind == "SUBPATTERN":
                got += out(value[3])
            elif kind == "BRANCH":
                got += out(r.choice(value[1]))
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                got += "".join(out(value[2]) for _ in range(r.randint(value[0], min(value[1], 1))))
            elif kind == "ANY":
                got += "x"
        return got

    return out(parser.parse(pattern))


def plainly(norm):
    """All rules on all texts, without a gate; suppression by comparing all pairs."""
    found = []
    for own in op.rules().values():
        for rank, pattern, label, sure in own:
            found += [(-rank, m.start() + 1 - m.end(), m.start() + 1, f"{label}\0{sure}", m.end(), label, sure) for m in pattern.finditer(norm)]
    kept = []
    for _, _, a, _, b, label, sure in sorted(found):
        if any(x <= a and b <= y for x, y, *_ in kept):
            continue
        inside = [k for k in kept if a <= k[0] and k[1] <= b]
        if all(k[2] == label for k in inside):
            kept = [k for k in kept if k not in inside] + [(a, b, label, max([sure, *(k[3] for k in inside)]))]
    return sorted(kept)


def test_every_rule_and_suppression_against_all_pairs():
    r = random.Random(3)
    patterns = [(p.pattern.decode().removeprefix(" (?:").removesuffix(")(?= )"), label) for own in op.rules().values() for _, p, label, _ in own]
    shown = [(examples(p, r), p) for p, _ in patterns]
    for text, p in shown:
        assert re.fullmatch(p, text), (text, p)
        assert op.scan(b" " + text.encode() + b" ")[0] == plainly(b" " + text.encode() + b" "), text
    pieces = [t for t, _ in shown]
    for _ in range(150):
        words = " ".join(r.choice(pieces + ["or", "license", "the", "the mit", "2 0"]) for _ in range(r.randint(1, 25))).split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(["x", "license", "the", "3"])
        norm = (" " + " ".join(words) + " ").encode()
        assert op.scan(norm)[0] == plainly(norm), norm


def test_time_is_in_proportion_to_the_text():
    import time

    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        kept, places, _ = op.scan(padded("mit license " * n))
        took.append(time.process_time() - began)
        assert len(places) == n and len(kept) == 2 * n - 1
    assert took[1] < 25 * took[0]


def test_base_columns_in_sql(spark):
    import duckdb

    docs = "/root/testdata/sf0.001/documents.parquet"
    got = {tuple(r) for r in op.license_scan(spark.read.parquet(docs), spans=False).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()}
    want = duckdb.sql(rf"""
      WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM '{docs}'),
      p AS (SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w)),
      h AS (SELECT doc_id, i, CASE WHEN a = 'mit' AND b = 'license' THEN 'mit' WHEN a = 'apache' AND b = 'license' THEN 'apache'
                                   WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' END AS label FROM p),
      s AS (SELECT doc_id, count(*) AS n, min(i) AS f, max(i) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h WHERE label IS NOT NULL GROUP BY doc_id)
      SELECT doc_id, len(w), coalesce(n, 0), f, l, coalesce(labels, '') FROM w LEFT JOIN s USING (doc_id)""").fetchall()
    assert got == set(want)


def test_literals():
    assert op.literals("gnu gpl (?:version |v )?3(?: 0)?")[0] == "gnu gpl "
    assert op.literals("licen[cs]e")[0] == "licen"
    assert op.gate("mit", "expat") == "expat" and op.gate("mit", "the mit") == "mit"


def test_known_lines():
    want = {
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc"},
        "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
        "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
        "Released under the MIT License.": {"mit"},
        "SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"},
        "You may not use this file except in compliance with the License.": {"apache-2.0"},
        "released into the public domain": {"public-domain"},
        "Mozilla Public License, v. 2.0": {"mpl-2.0"},
        "the committee permits commit logs": set(),
        "we licensed the limits": set(),
    }
    assert {t: labels(t) for t in want} == want


def test_suppression():
    kept, places, base = op.scan(padded("licensed under the apache license version 2 0 or the mit license"))
    assert base == ["mit", "apache"] and len(places) == 2
    for i, (a, b, *_) in enumerate(kept):
        assert not any(c <= a and b <= d for j, (c, d, *_) in enumerate(kept) if j != i)


def test_base_against_words(spark):
    r = random.Random(1)
    pool = ["MIT", "license", "Apache", "general", "public", "x", "É", "mit,license", "licenseé", "\n"]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in op.license_scan(df).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(FOLD))
        places, base = [], set()
        for phrase, label in op.BASE:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        x = got[i]
        assert (x["n_words"], x["n_base"], x["base_labels"]) == (len(w), len(places), ",".join(sorted(base)))
        assert (x["first_word"], x["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert base <= set(x["labels"].split(",")) and x["labels"] == ",".join(sorted(set(x["labels"].split(","))))
        assert 0 <= x["score"] <= 1
        assert all(0 <= s["start"] < s["stop"] <= len(w) for s in x["spans"])


def test_awkward(spark):
    got = op.license_scan(awkward(spark)).collect()
    assert len(got) == 13 and {r["n_words"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert op.license_scan(empty(spark)).count() == 0
    assert "spans" not in op.license_scan(empty(spark), spans=False).columns
