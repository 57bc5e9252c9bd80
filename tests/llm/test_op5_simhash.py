import re

import numpy as np
import pytest
import xxhash

from markloom.llm import op5_simhash as op
from markloom.llm.common import Workspace
from markloom.llm.components import components
from tests.llm.rows import awkward, empty, prose, stored


def fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(ids, linked):
    """Smallest id of each component; linked(i) gives positions."""
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in linked(i):
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    best = {}
    for i, x in enumerate(ids):
        if x is not None:
            best[find(i)] = min(x, best.get(find(i), x))
    return [best.get(find(i)) for i in range(len(ids))]


def brute(rows, n, most):
    fp = np.array([fingerprint(t, n) for _, t in rows], np.uint64)
    ids = [i for i, _ in rows]
    roots = grouped(ids, lambda i: np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= most).tolist())
    return sorted(((i, f"{int(f):016x}", c) for i, f, c in zip(ids, fp, roots, strict=True)), key=repr)


@pytest.mark.parametrize("hot", [op.HOT, 2])
def test_edited_copies(spark, tmp_path, hot):
    rows = []
    for s in range(12):
        words = prose(s, 60 + 20 * s).split()
        for k in range(6):
            rows.append((100 - len(rows), " ".join([*words[: 50 - k], "edit", *words[50 - k :]]) if k else " ".join(words)))
    df = stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path)
    got = sorted((tuple(r) for r in op.simhash_components(df, hot=hot).collect()), key=repr)
    want = brute(rows, 4, 4)
    assert len({c for *_, c in want}) < len(rows)
    assert got == want


@pytest.mark.parametrize("segments,most,hot,taken", [(3, 4, 10_000, 1), (4, 7, 10_000, 1), (2, 5, 10_000, 1), (3, 4, 1, 1), (3, 3, 0, 1), (2, 1, 0, 1), (5, 4, 10_000, 2), (8, 4, 10_000, 4), (10, 4, 0, 6)])
def test_links_of_random_fingerprints(spark, tmp_path, segments, most, hot, taken):
    r = np.random.default_rng(7)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(6):
            fps.add(b ^ sum(1 << int(i) for i in r.choice(64, int(r.integers(1, 9)), replace=False)))
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    ws = Workspace(spark, "test")
    roots = {x["node"]: x["root"] for x in components(op.link_edges(df, ws, most, segments, hot, taken=taken), ws).collect()}
    signed = fps.view(np.int64).tolist()
    want = grouped(signed, lambda i: np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= most).tolist())
    assert [roots.get(x, x) for x in signed] == want


def test_near_copies_give_a_task_no_more_edges_than_they_are(spark):
    """All within two bits of one value, in keys of few rows each: the pairs grow with the square, edges must not."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for size in (16, 32, 64):
        fps = [0] + [1 << i for i in range(size - 1)]
        df = spark.createDataFrame([(x,) for x in fps], "fp long")
        edges = [tuple(r) for r in op.link_edges(df, Workspace(spark, "test"), 4, 3).distinct().collect()]
        assert len(edges) <= tasks * (size - 1), size
        at = {x: i for i, x in enumerate(fps)}
        assert set(grouped(fps, lambda i: [at[v] for u, v in edges if u == fps[i]])) == {0}


def test_folded_links_have_the_components_of_all(monkeypatch):
    r = np.random.default_rng(11)
    for gather, hold in ((op._GATHER, op._HOLD), (5, 1000), (0, 7), (0, 0)):
        monkeypatch.setattr(op, "_GATHER", gather)
        monkeypatch.setattr(op, "_HOLD", hold)
        for n in (0, 1, 60, 300):
            ids = np.sort(r.integers(0, 1 << 64, 200, dtype=np.uint64))
            links = [(ids[r.integers(0, 200, k)], ids[r.integers(0, 200, k)]) for k in r.integers(0, 9, n // 4 + n % 4)]
            got = [x.column(c).to_numpy().view(np.uint64) for x in op._folded(iter(links)) for c in ("u", "v")]
            if hold >= 1000 and got:
                assert len(got) == 2 and len(set(got[0].tolist())) == len(got[0])  # once each
            names = ids.tolist()
            tied = lambda pairs: lambda i: [names.index(b) for u, v in pairs for a, b in zip(u.tolist(), v.tolist(), strict=True) if a == names[i]]
            assert grouped(names, tied(links)) == grouped(names, tied(list(zip(got[::2], got[1::2], strict=True))))


def test_segments_follow_the_count_and_miss_nothing():
    assert [op.segmentation(n) for n in (0, 1 << 24, 1 << 25, 1 << 30, 1 << 36)] == [(3, 1), (3, 1), (5, 2), (8, 4), (10, 6)]
    r = np.random.default_rng(2)
    for blocks, taken in op.CUTS:
        radius = op.least_radius(4, blocks, taken)
        bounds = op.block_bounds(blocks)
        assert sum(sorted((w for _, _, w in bounds), reverse=True)[:taken]) <= 50
        for _ in range(2000):
            flips = sum(1 << int(i) for i in r.choice(64, 4, replace=False))
            assert sum(sorted((flips >> a & (1 << w) - 1).bit_count() for _, a, w in bounds)[:taken]) <= radius


@pytest.mark.parametrize("hot", [10_000, 1])
def test_wide_fingerprints(spark, tmp_path, hot):
    """Two words a fingerprint, against all pairs; radius 1 meets all pairs within 15 bits, and most within 23."""
    rows = []
    for s in range(15):
        words = prose(s, 120).split()
        for k in range(4):
            rows.append((len(rows), " ".join([*words[: 20 * k], *["edit"] * (k > 0), *words[20 * k + (k > 1) :]])))
    df = stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path)
    wide = {r["doc_id"]: r for r in op.fingerprints(df, 5, 2).collect()}
    fp = np.array([[wide[i]["f0"], wide[i]["f1"]] for i, _ in rows]).view(np.uint64)
    for most in (15, 9):
        got = {r["doc_id"]: r["component_id"] for r in op.simhash_components(df, shingle=5, most=most, segments=8, words=2, radius=1, hot=hot).collect()}
        want = grouped([i for i, _ in rows], lambda i: np.flatnonzero(np.bitwise_count(fp[i] ^ fp).sum(axis=1) <= most).tolist())
        assert [got[i] for i, _ in rows] == want
    assert 15 <= len(set(want)) < 60


def test_similar_sets_against_all_pairs():
    r = np.random.default_rng(5)
    for tables in (30, 12):
        sets = [np.unique(r.integers(0, 7, int(r.integers(0, 14)), dtype=np.uint64)) for _ in range(30)]
        pairs = [(a, b) for a in range(tables) for b in range(tables if tables < 30 else a + 1, 30)]
        jaccard = lambda a, b: len(set(sets[a]) & set(sets[b])) / max(1, len(set(sets[a]) | set(sets[b])))
        linked = [(a, b) for a, b in pairs if jaccard(a, b) >= 0.8]
        got = list(zip(*op.similar(sets, tables, 0.8), strict=True))
        assert set(got) <= set(linked) and len(linked) > 3
        ids, tied = list(range(30)), lambda edges: lambda i: [b for a, b in edges if a == i]
        assert grouped(ids, tied(got)) == grouped(ids, tied(linked))


@pytest.mark.parametrize("hot_sets", [op.HOT_SETS, 1])
def test_only_similar_texts_go(spark, tmp_path, hot_sets):
    """Copies with edits here and there: fingerprints chain far more of them than have five-word similarity of 0.8."""
    rows = []
    for s in range(12):
        words = prose(s, 150).split()
        for k in range(6):
            own = list(words)
            for j in range(2 * k):
                own[(7 * s + 31 * k + 12 * j) % 150] = f"edit{k}x{j}"
            rows.append((len(rows), " ".join(own)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in rows]
    near = lambda i: [j for j in range(len(rows)) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    want = grouped(list(range(len(rows))), near)
    df = stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path)
    how = dict(shingle=5, words=2, segments=8, most=23, radius=1)
    unchecked = {r["doc_id"]: r["component_id"] for r in op.simhash_components(df, **how).collect()}
    assert any(unchecked[i] != i and want[i] == i for i in range(len(rows)))
    kept = sorted(r["doc_id"] for r in op.keep_one(df, least=0.8, hot_sets=hot_sets, **how).collect())
    assert kept == sorted(set(want)) and 12 < len(kept) < len(rows)


def test_one_row_of_each_group_stays(spark, tmp_path):
    """Repeated rows, null ids, and one id on different texts."""
    a, b, c, d = (prose(i, 80) for i in (1, 2, 3, 4))
    rows = [(7, a), (7, a), (None, b), (None, b), (3, c), (3, d), (2, d), (None, a)]
    df = stored(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path)
    for least in (None, 0.8):
        got = sorted((tuple(r) for r in op.keep_one(df, least=least).collect()), key=repr)
        assert got == sorted([(7, a), (None, b), (3, c), (2, d)], key=repr)


@pytest.mark.parametrize("few", [500_000, 0])
def test_components_of_paths_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr("markloom.llm.components.FEW", few)
    r = np.random.default_rng(3)
    order = r.permutation(300).tolist()
    edges = list(zip(order, order[1:], strict=False)) + [(1000, x) for x in range(1001, 1200)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "u long, v long")
    got = {x["node"]: x["root"] for x in components(df, Workspace(spark, "test")).collect()}
    want = {x: 0 for x in order} | {x: 1000 for x in range(1000, 1200)} | {6000: 6000, 6001: 6000}
    assert got == want
    assert components(df.limit(0), Workspace(spark, "test")).count() == 0


def test_majority_is_the_same_for_few_and_many():
    r = np.random.default_rng(0)
    h = r.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert op.fingerprint_of(h) == want
    assert op.fingerprint_of(h[:2]) == int(h[0] & h[1])


def test_awkward(spark, tmp_path):
    df = stored(spark, awkward(spark), tmp_path)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted((tuple(r) for r in op.simhash_components(df).collect()), key=repr)
    assert got == brute(rows, 4, 4)
    assert {r[2] for r in got if r[0] in (2, 3, 4)} == {2}
    kept = op.keep_one(df)
    assert kept.columns == df.columns
    assert kept.filter("doc_id IS NULL").count() == 1 and kept.filter("doc_id = 3").count() == 0
    assert op.simhash_components(stored(spark, empty(spark), tmp_path, "none")).count() == 0
