import zlib

import numpy as np
import pyarrow as pa
import pytest

from markloom.llm import op7_pack as op
from tests.llm.rows import awkward, empty, prose, stored

ODD = ["don't it's <|endoftext|>x  a", "́abc é  x y\x85z", "", "Σας ΟΔΟΣ ΟΔΟΣ\x0bq\x0cr\x1cs", "日本語テキスト 123 4.5", "a​b 🙂👍🏽", " lead  trail ", "İSTANBUL ǅ ﬁ", "a b", "x" * 5000]


@pytest.fixture(scope="module")
def words():
    return op.WordIds(op.default_tokenizer())


def test_ids_are_the_tokenizer_s(words, monkeypatch):
    monkeypatch.setattr(words, "limit", 120)
    for k in range(5):
        texts = [*ODD, *(prose(s, 40) for s in range(k, k + 6)), *ODD]
        ids, at = words.ids(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t[:40]


def test_words_whose_hashes_collide(words):
    from tests.llm.test_op4_suffix import thue_morse

    texts = [*thue_morse("a", "b"), *thue_morse("e", "q"), *thue_morse("b", "a")]
    for _ in range(2):
        ids, at = words.ids(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


def check_runs(runs, counts, capacity):
    """Every rank once, no overlap, no gap; the number of sequences."""
    held = {}
    for length in counts:
        ranks = sorted(x for n, a, b, _, _ in runs if n == length for x in range(a, b))
        assert ranks == list(range(counts[length]))
    for length, a, b, first, offset in runs:
        for k in range(b - a):
            held.setdefault(first + k, []).append((offset, length))
    for own in held.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


def test_plan_is_item_by_item_best_fit():
    r = np.random.default_rng(0)
    for _ in range(300):
        cap = int(r.integers(1, 64))
        sizes = r.integers(1, cap + 1, int(r.integers(1, 250)))
        counts = {int(k): int((sizes == k).sum()) for k in set(sizes.tolist())}
        bins = []
        for s in sorted(sizes.tolist(), reverse=True):
            fit = [i for i, g in enumerate(bins) if g >= s]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= s
            else:
                bins.append(cap - s)
        assert check_runs(op.best_fit(counts, cap), counts, cap) == len(bins)
    assert op.best_fit({}, 10) == []
    big = {1000: 10**9, 900: 10**9, 148: 10**9, 3: 5}
    assert len(op.best_fit(big, 2048)) < 200  # runs, not documents


def test_pieces(spark, tmp_path, words):
    df = stored(spark, awkward(spark), tmp_path)
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    for capacity in (2048, 64):
        got = op.pack(df, capacity=capacity).collect()
        want = []
        for i, t in rows:
            ids = np.array([*words.tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
            for p, a in enumerate(range(0, len(ids), capacity)):
                part = ids[a : a + capacity]
                want.append((i, p, a, len(part), zlib.crc32(part.tobytes())))
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
        held = {}
        for r in got:
            held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in held.values():
            assert [a for a, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist()
            assert sum(n for _, n in own) <= capacity
        least = -(-sum(w[3] for w in want) // capacity)
        assert len(held) <= 1.3 * least + 1
    assert op.pack(stored(spark, empty(spark), tmp_path, "none")).count() == 0
