"""Exact repeated passages by suffix arrays: every byte under an `n`-byte string that also starts anywhere else.

1. Candidates. Every window of n bytes has an anchor: the leftmost smallest hash of its k-byte substrings. Equal
   windows have equal anchors at equal places, so a window whose anchor's hash occurs nowhere else is unique. The
   windows that share an anchor are a block (about 75 of them). An aggregation finds the hashes that repeat; only
   their blocks go on, which leaves the repeats and their surroundings. Hashes that collide only bring more candidates.
   In a periodic stretch (a word pair over and over) the anchor moves on by a period, so there is a block for each
   period, all of them equal. Equal blocks that follow one another are one row that says how many they are.
2. Blocks of equal bytes are one suffix-array entry with a multiplicity. Equal means: of equal keyed BLAKE2b digests
   of 128 bits, with a key drawn for each call, so texts can't be made to collide; that any two of 10^12 different
   blocks do has a probability under 2 ** -48. Where all blocks of a hash are equal there is nothing to sort.
3. Suffix arrays. The distinct blocks are dealt by anchor hash: all suffixes that can share n bytes meet in one
   task. There a difference-cover (modulo 3) algorithm sorts them: it names the triples of two thirds of the
   suffixes, recurses on the names while they aren't distinct, sorts the other third by what it has, merges the
   two, and adjacent suffixes are compared over n bytes. No order between the tasks is needed, since their suffixes
   share no n bytes.
4. A hash with over `hot` distinct blocks (a passage in very many contexts) isn't one task's: its windows are
   counted by digests of the same kind in an aggregation that combines equal ones before the shuffle. The result is
   the same either way.
5. The bytes covered are cut out of the texts, or counted.

Rows are numbered and written once, so that the steps agree on them. Null text: empty. A long text is read in pieces of
a mebibyte that overlap by n - 1; only cutting holds it whole. Repeated rows are repeats of each other, null ids are
rows like others. Extra columns are ignored (remove_repeats keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import Workspace, flow, let_go, masked, sent_if_small, slices, trim, unmasked

N, K, HOT = 200, 50, 4096
#: Windows of one pass of numpy, and symbols of one suffix array.
_CHUNK, _SYMBOLS = 1 << 20, 1 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Rolling:
    """Hashes of substrings by prefix sums of byte values times powers of an odd number, modulo 2**64."""

    def __init__(self, seed: int, size: int):
        base = _U(0x9E3779B97F4A7C15 + 2 * seed)
        inverse = _U(pow(int(base), -1, 1 << 64))
        self.values = _mix(np.arange(1, 257, dtype=_U) + _U(1000 * seed))
        self.power = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size, base)]))
        self.back = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size, inverse)]))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, _U), np.cumsum(self.values[data] * self.power[: len(data)], dtype=_U)])

    def of(self, prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return _mix((prefix[stops] - prefix[starts]) * self.back[starts])


@lru_cache(maxsize=4)
def rolling(seed: int, size: int = _CHUNK + 4096) -> Rolling:
    return Rolling(seed, size)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size :][: len(x) - width + 1])


def blocks_of(flat: np.ndarray, at: np.ndarray, n: int = N, k: int = K):
    """Blocks of concatenated texts: owner, first and last window (within the text), anchor hash."""
    out = []
    for c in range(0, max(len(flat) - n + 1, 0), _CHUNK):
        data = flat[c : c + _CHUNK + n - 1]
        windows = len(data) - n + 1
        r = rolling(1)
        prefix = r.prefix(data)
        grams = _mix((prefix[k:] - prefix[:-k]) * r.back[: len(data) - k + 1])
        key = ((grams >> _U(24)) << _U(24)) | np.arange(len(grams), dtype=_U)
        anchor = (_sliding_min(key, n - k + 1) & _U((1 << 24) - 1)).astype(np.int64)
        # windows that lie within one text
        edge = np.zeros(windows + 1, np.int32)
        first, last = np.clip(at[:-1] - c, 0, windows), np.clip(at[1:] - n + 1 - c, 0, windows)
        np.add.at(edge, first[first < last], 1)
        np.add.at(edge, last[first < last], -1)
        inside = np.cumsum(edge[:-1]) > 0
        new = inside.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        starts = np.flatnonzero(new | _text_starts(at - c, windows, inside))
        stop = np.concatenate([starts[1:], [windows]])
        outside = np.concatenate([np.flatnonzero(~inside), [windows]])
        stop = np.minimum(stop, outside[np.searchsorted(outside, starts)]) - 1
        owner = np.searchsorted(at, starts + c, "right") - 1
        out.append((owner, starts + c - at[owner], stop + c - at[owner], grams[anchor[starts]]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _text_starts(at: np.ndarray, windows: int, inside: np.ndarray) -> np.ndarray:
    """Where a text begins within the windows: a block never crosses from one text into the next."""
    mark = np.zeros(windows, bool)
    own = at[:-1][(at[:-1] >= 0) & (at[:-1] < windows)]
    mark[own] = True
    return mark & inside


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == _U else x.astype(np.int64))


def digests(flat: np.ndarray, first: np.ndarray, stop: np.ndarray, key: bytes) -> tuple[pa.Array, pa.Array]:
    """Keyed 128-bit digests of stretches of bytes, as two longs."""
    view, one = memoryview(np.ascontiguousarray(flat)), hashlib.blake2b
    got = b"".join([one(view[a:b], digest_size=16, key=key).digest() for a, b in zip(first.tolist(), stop.tolist(), strict=True)])
    two = np.frombuffer(got, np.int64).reshape(-1, 2)
    return tuple(pa.array(np.ascontiguousarray(two[:, i])) for i in (0, 1))


def _in_a_row(owner, s0, s1, *same) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks in order: the first of each run of equal ones that follow one another in a text, and how many it has."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (s0[1:] != s1[:-1] + 1)
    for x in (s1 - s0, *same):
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _anchors(n: int, k: int, key: bytes):
    def run(batches):
        let_go()
        for b in slices(batches, "text", _CHUNK):
            flat, at = _flat(b.column("text"))
            owner, s0, s1, h = blocks_of(flat, at, n, k)
            d1, d2 = digests(flat, at[owner] + s0, at[owner] + s1 + n, key)
            first, times = _in_a_row(owner, s0, s1, h, d1.to_numpy(), d2.to_numpy())
            owner, s0, s1, h, d1, d2 = (x[first] for x in (owner, s0, s1, h, d1.to_numpy(), d2.to_numpy()))
            cols = [_long(h), _long(d1), _long(d2), b.column("rid").take(pa.array(owner)), *(pa.array(x.astype(np.int32)) for x in (s0, s1, times))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "d1", "d2", "rid", "s0", "s1", "times"])

    return run


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of t (values from 1 to under 2**21, at most as many) in order: difference cover modulo 3."""
    n = len(t)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    odd = n % 3 == 1  # then position n is sampled too, so that the last triple of the first half ends the half
    t = np.concatenate([t, np.zeros(3, np.int64)])
    top = int(t.max()) + 1
    ones, twos = np.arange(1, n + odd, 3), np.arange(2, n, 3)
    cover = np.concatenate([ones, twos])
    triples = (t[cover] * top + t[np.minimum(cover + 1, n + 2)]) * top + t[np.minimum(cover + 2, n + 2)]
    names, code = np.unique(triples, return_inverse=True)
    if len(names) < len(cover):
        order = suffix_array(code + 1)
    else:
        order = np.argsort(code, kind="stable")
    cover = cover[order]
    rank = np.zeros(n + 4, np.int64)
    rank[cover] = np.arange(1, len(cover) + 1)
    rest = np.arange(0, n, 3)
    wide = n + 4
    key = t[rest] * wide + rank[rest + 1]
    by = np.argsort(key, kind="stable")
    rest, key = rest[by], key[by]
    # merge: a suffix of the rest goes behind as many sampled ones of either residue as are smaller
    one, two = cover[cover % 3 == 1], cover[cover % 3 == 2]
    below = np.searchsorted(t[one] * wide + rank[one + 1], key)
    pair = lambda i: (t[i] * top + t[i + 1]) * wide + rank[i + 2]
    below += np.searchsorted(pair(two), pair(rest))
    out = np.full(len(rest) + len(cover), -1, np.int64)
    out[np.arange(len(rest)) + below] = rest
    out[out < 0] = cover
    return out[out < n]


def repeated_windows(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of blocks in one buffer: the starts (in the buffer) of windows that occur at least twice."""
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    text = np.ones(len(data) + len(sizes), np.int64)  # 1 stands between blocks
    place = np.arange(len(data)) + owner
    text[place] = data.astype(np.int64) + 2
    back = np.full(len(text), -1, np.int64)
    back[place] = np.arange(len(data))
    order = back[suffix_array(text)]
    order = order[order >= 0]
    order = order[at[owner[order] + 1] - order >= n]  # equal windows stay neighbours
    a, b = order[:-1], order[1:]
    prefix = rolling(1, 2 * _SYMBOLS + 4096).prefix(data)
    r = rolling(1, 2 * _SYMBOLS + 4096)
    near = r.of(prefix, a, a + n) == r.of(prefix, b, b + n)
    a, b = a[near], b[near]
    same = np.ones(len(a), bool)
    for i in range(0, len(a), 20_000):  # adjacent prefixes, byte by byte
        x, y = (data[v[i : i + 20_000, None] + np.arange(n)] for v in (a, b))
        same[i : i + 20_000] = (x == y).all(axis=1)
    return np.unique(np.concatenate([a[same], b[same]]))


def _runs(starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first and the last of each run of successive starts of one owner."""
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return first, np.concatenate([first[1:], [len(starts)]])[: len(first)] - 1


def _sort_blocks(n: int):
    """Blocks in the order of their hashes to spans (rid, start, stop) of windows that repeat, of blocks that are single."""

    def solve(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        data, at = _flat(table.column("block").chunk(0) if table.num_rows else pa.array([], pa.binary()))
        found = repeated_windows(data, at, n)
        owner = np.searchsorted(at, found, "right") - 1
        single = table.column("c").to_numpy()[owner] == 1  # the others are covered already
        found, owner = found[single], owner[single]
        first, last = _runs(found, owner)
        s0 = table.column("s0").to_numpy().astype(np.int64)[owner[first]]
        start = s0 + found[first] - at[owner[first]]
        rid = table.column("rid").to_numpy()[owner[first]]
        cols = [pa.array(rid), pa.array(start.astype(np.int32)), pa.array((start + found[last] - found[first] + n).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["rid", "start", "stop"])

    def run(batches):
        let_go()
        kept: list[pa.RecordBatch] = []
        held, last = 0, None
        for b in batches:
            h = b.column("h").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = pc.binary_length(b.column("block")).to_numpy(zero_copy_only=False)
            total = np.add.reduceat(size, cut) + np.diff(np.append(cut, len(h))) if len(h) else size
            for i, j, s in zip(cut.tolist(), np.append(cut, len(h))[1:].tolist(), total.tolist(), strict=True):
                if held + s > _SYMBOLS and h[i] != last and kept:
                    yield solve(kept)
                    kept, held = [], 0
                kept.append(b.slice(i, j - i))
                held, last = held + s, h[i]
        if kept:
            yield solve(kept)
        trim()

    return run


def _window_digests(n: int, key: bytes):
    """Blocks of hot hashes to their windows; a batch a block."""

    def run(batches):
        for b in batches:
            data, at = _flat(b.column("block"))
            for i in range(b.num_rows):
                starts = np.arange(at[i], at[i + 1] - n + 1)
                m, rid, s0, c = len(starts), *(b.column(x)[i].as_py() for x in ("rid", "s0", "c"))
                cols = [*digests(data, starts, starts + n, key), pa.array(np.full(m, rid)), pa.array((np.arange(m) + s0).astype(np.int32)), pa.array(np.full(m, c))]
                yield pa.RecordBatch.from_arrays(cols, names=["w1", "w2", "rid", "start", "c"])

    return run


def _cut_blocks(n: int):
    def run(batches):
        for b in slices(batches, "text", 4 << 20):
            data, at = _flat(b.column("text"))
            want = b.column("want")
            owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(want).to_numpy(zero_copy_only=False))
            fields = want.flatten()
            s0, s1 = (fields.field(k).to_numpy() for k in ("s0", "s1"))
            view = data.tobytes()
            begin = at[owner] + s0
            block = pa.array([view[x:y] for x, y in zip(begin.tolist(), (begin + s1 - s0 + n).tolist(), strict=True)], pa.binary())
            cols = [fields.field("h"), fields.field("c"), b.column("rid").take(pa.array(owner)), fields.field("s0"), block]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "c", "rid", "s0", "block"])

    return run


def release(spark) -> None:
    """Lets the driver drop the shuffle files of jobs whose tables have been written."""
    gc.collect()
    spark._jvm.System.gc()


def repeated_spans(rows: DataFrame, ws: Workspace, n: int = N, k: int = K, hot: int = HOT) -> DataFrame:
    """rows: rid, text, a saved table. Spans (rid, start, stop) in bytes, not merged, that cover every repeated window."""
    spark, key, digest = rows.sparkSession, os.urandom(16), ["d1", "d2"]
    anchors = ws.save(rows.select("rid", "text").mapInArrow(_anchors(n, k, key), "h long, d1 long, d2 long, rid long, s0 int, s1 int, times int"), "anchors")
    ends = [f(c).alias(f"{c}_{name}") for c in digest for name, f in (("low", F.min), ("high", F.max))]
    twice = anchors.groupBy("h").agg(F.sum("times").alias("n"), *ends).filter("n > 1")
    # saved, so that the join has a plain shuffle under it, which Spark can split where a hash is hot
    twice = ws.save(twice.select("h", F.expr("d1_low != d1_high OR d2_low != d2_high").alias("multi")), "twice")
    repeated = ws.save(anchors.join(twice, "h"), "repeated")
    release(spark)
    ws.drop("anchors", "twice")
    pick = [F.first(c).alias(c) for c in ("rid", "s0", "s1")]  # of one row: all three are taken together
    kinds = ws.save(repeated.filter("multi").groupBy("h", *digest).agg(F.sum("times").alias("c"), *pick), "kinds")
    ends = ["rid", F.col("s0").alias("start"), F.expr(f"s0 + times * (s1 - s0 + 1) - 1 + {n}").alias("stop")]
    copies = sent_if_small(kinds.filter("c > 1").select("h", *digest))
    spans = [
        repeated.filter("not multi").select(*ends),
        repeated.filter("multi").join(copies, ["h", *digest], "left_semi").select(*ends),
    ]
    # hashes with over `hot` kinds
    common = ws.save(kinds.groupBy("h").agg(F.count("*").alias("nk")).filter(F.col("nk") > hot).select("h"), "common")
    want = kinds.groupBy("rid").agg(F.collect_list(F.struct("h", "c", "s0", "s1")).alias("want"))
    cut = rows.select("rid", "text").join(want, "rid").mapInArrow(_cut_blocks(n), "h long, c long, rid long, s0 int, block binary")
    blocks = ws.save(cut, "blocks")
    release(spark)
    sorted_ones = blocks
    if not common.isEmpty():
        common = sent_if_small(common)
        sorted_ones = blocks.join(common, "h", "left_anti")
        windows = blocks.join(common, "h", "left_semi").mapInArrow(_window_digests(n, key), "w1 long, w2 long, rid long, start int, c long")
        w = ws.save(windows, "windows")
        more = ws.save(w.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2"), "more")
        hits = w.filter("c = 1").join(more, ["w1", "w2"], "left_semi")
        spans.append(hits.select("rid", "start", (F.col("start") + n).alias("stop")))
    dealt = sorted_ones.repartition(flow(spark), "h").sortWithinPartitions("h")
    spans.append(dealt.mapInArrow(_sort_blocks(n), "rid long, start int, stop int"))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    found = ws.save(out, "spans")
    release(spark)
    ws.drop("repeated", "kinds", "common", "blocks", "windows", "more")
    return found


def _kept(size: int, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, int]:
    """Which bytes are not covered, and the number of maximal covered runs."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    covered = np.cumsum(edge[:-1]) > 0
    n = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
    return ~covered, n


def _each(batches):
    """(batch, text bytes, kept mask or None, spans) of each row."""
    for b in slices(batches, "text", 4 << 20):
        texts = b.column("text").cast(pa.binary()).to_pylist()
        for i, (t, s) in enumerate(zip(texts, b.column("spans").to_pylist(), strict=True)):
            t = t or b""
            if s:
                keep, n = _kept(len(t), np.array([x["start"] for x in s]), np.array([x["stop"] for x in s]))
                yield b, i, t, keep, n
            else:
                yield b, i, t, None, 0


def _with_spans(docs: DataFrame, n: int, k: int, hot: int) -> DataFrame:
    """docs, masked, with rid and spans."""
    ws = Workspace(docs.sparkSession, "suffix")
    rows = ws.numbered(docs)
    spans = repeated_spans(rows, ws, n, k, hot)
    per = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows.join(per, "rid", "left")


def _report(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    rows = []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b, i, t, keep, n in _each(batches):
        left = t if keep is None else np.frombuffer(t, np.uint8)[keep].tobytes()
        rows.append((b.column("doc_id")[i].as_py(), len(t), len(t) - len(left), n, hashlib.sha256(left).hexdigest()))
        if len(rows) >= 2000:
            yield flush()
            rows = []
    if rows:
        yield flush()


def repeats_report(docs: DataFrame, n: int = N, k: int = K, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    joined = _with_spans(docs.select("doc_id", "text"), n, k, hot)
    return joined.select("doc_id", "text", "spans").mapInArrow(_report, schema)


def remove_repeats(docs: DataFrame, n: int = N, k: int = K, hot: int = HOT) -> DataFrame:
    """docs with all repeated bytes cut out of their texts; a character that is cut in part goes whole."""
    rows = _with_spans(docs, n, k, hot)
    shape = masked(docs).schema
    columns = shape.names

    def cut(batches):
        held, texts = None, []
        for b, i, t, keep, _ in _each(batches):
            if held is not None and b is not held:
                yield _replaced(held, texts, columns)
                texts = []
            held = b
            left = t if keep is None else np.frombuffer(t, np.uint8)[keep].tobytes()
            texts.append(None if b.column("text")[i].as_py() is None else left.decode("utf-8", "ignore"))
        if held is not None:
            yield _replaced(held, texts, columns)

    return unmasked(rows.select(*columns, "spans").mapInArrow(cut, shape), docs.columns)


def _replaced(b: pa.RecordBatch, texts: list, columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns], names=columns)
