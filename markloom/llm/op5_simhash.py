"""SimHash near-duplicates by multi-index hashing.

Fingerprints. A text is lower-cased (A-Z), cut at ASCII white space into words and hashed by `shingle`-word
shingles (XXH64 of UTF-8, seed 42, repeats included; fewer words: the whole sequence). A fingerprint bit is set
where over half of the hashes have it. A text without words has fingerprint zero and links like any other.

Links. Two fingerprints link where they differ in at most `most` bits. Equal fingerprints collapse first, so a
group of copies is one row. The 64 bits are cut into blocks; some of the blocks together are a segment. By the
pigeonhole principle two linked fingerprints differ in few bits (the radius) of one of the segments. Each fingerprint is
a row of that segment's table and probes it with the Hamming ball of the radius around its own segment; what shares a
key is verified by its complete distance. With 3 blocks, each a segment, for 4 bits that is 67 probes with 21-bit keys.
Keys must not hold more rows as the table grows, so the blocks follow from the measured number of fingerprints
(`segmentation`): beyond 2**24 two of 5 blocks are a segment (25 bits), beyond 2**28 four of 8 (32 bits, radius 0), and so
on. Every choice finds every link.

A table key's rows are compared in one task, in numpy blocks. In a large key only links that join what was apart are
taken (a spanning forest), and what a task emits are not the links of its keys but stars: each linked fingerprint with
the smallest one that the task's links reach. So near copies, which share many keys, give no task more rows than they
are, however many pairs they make. A key with over `hot` table
rows isn't compared: its fingerprints instead emit every value within half the distance (where that is odd, the one
half as a side of its own and the other as the other), on which linked fingerprints meet (a ball of 2,081 values for 4
bits), and are tied by an aggregation. That is exact too, linear in the group, and no task holds it.

Wider fingerprints. `words` times 64 bits estimate similarity better: two texts of Jaccard similarity J differ in
about acos(2J / (1 + J)) / pi of the bits. There the ball that meets every pair within `most` bits may be too
large; `radius` sets a smaller one. Pairs within (radius + 1) * segments - 1 bits are always met, those beyond
unless each segment differs in more than radius bits. A key with over `hot` table rows is compared in a grid of
tasks then (blocks of table rows against blocks of all rows), as balls about middles would be too large.

Verified links. Fingerprints only estimate: with `least`, keep_one takes their components as candidates alone. Texts
of one component link where the Jaccard similarity of their sets of shingles (by 64-bit hashes) is `least` or more,
whatever their fingerprints' distance; components of those links count then. Texts of equal sets collapse first, equal
fingerprints don't. Every pair of a component is compared unless its two texts are joined already; a component with over
`HOT_SETS` sets or `HOT_HASHES` hashes is compared in a grid of tasks.

keep_one numbers the rows and writes them once, so that its steps agree on them.

Null text: empty. A very long text is hashed alone, with a number for each of its shingles. Null doc_ids take part; a
component's id is its smallest doc_id. Repeated rows each give a row. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import Workspace, flow, let_go, masked, sent_if_small, slices, trim, unmasked
from markloom.llm.components import components

SHINGLE, MOST = 4, 4
#: Table rows of one key that are compared in one task.
HOT = 16_384
#: Sets of shingles, and hashes in them, that are compared in one task (twice as many in a cell of a grid).
HOT_SETS, HOT_HASHES = 1024, 2_000_000
#: Links that a task gathers before it folds them into stars, and stars that it holds.
_GATHER, _HOLD = 1 << 16, 1 << 20
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _node(fp: np.ndarray) -> np.ndarray:
    """One number for a fingerprint of one or several columns: itself, or a 64-bit hash."""
    out = fp[0]
    for x in fp[1:]:
        out = _mix(_mix(out) ^ x)
    return out


def bit_columns(words: int) -> list[str]:
    return ["fp"] if words == 1 else [f"f{j}" for j in range(words)]


def fingerprint_of(hashes: np.ndarray) -> int:
    """Majority bits of uint64 hashes, by counts of byte values: 8 histograms, not 64 passes."""
    if not len(hashes):
        return 0
    byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 512:
        ones = np.unpackbits(byte, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.bincount((byte + np.arange(8, dtype=np.int64) * 256).ravel(), minlength=2048).reshape(8, 256)
        ones = (counts @ _BYTE_BITS).ravel()
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -shingle]])
    got = [xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return np.array(got, np.uint64)


def _set_digest(distinct: np.ndarray) -> int:
    """64 bits for a sorted set of hashes."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(distinct.astype("<u8").tobytes(), 42)


def _fingerprints(shingle: int, words: int, sets: bool = False):
    def run(batches):
        let_go()
        for b in slices(batches, "text"):
            got: list[list[int]] = [[] for _ in range(words)]
            digest, size = [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                h = shingle_hashes(t or b"", shingle)
                for j in range(words):  # other words by other functions of the hashes
                    got[j].append(fingerprint_of(_mix(h + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)) if j else h))
                if sets:
                    own = np.unique(h)
                    digest.append(_set_digest(own)), size.append(len(own))
            fp = [np.array(x, np.uint64) for x in got]
            cols = [_node(fp)] + (fp if words > 1 else [])
            names = ["fp", *(bit_columns(words) if words > 1 else [])]
            out = [b.column("doc_id"), *(pa.array(c.view(np.int64)) for c in cols)]
            if sets:
                out += [b.column("rid"), pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array(np.array(size, np.int64))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", *names, *(["rid", "s", "n"] if sets else [])])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long; of wider ones a hash, and the bits in f0, f1, ...)."""
    more = "".join(f", {c} long" for c in bit_columns(words) if words > 1)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle, words), f"doc_id long, fp long{more}")


def set_fingerprints(rows: DataFrame, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id, text, rid to what fingerprints gives, rid, s (a hash of the set of shingles) and n (its size)."""
    more = "".join(f", {c} long" for c in bit_columns(words) if words > 1)
    schema = f"doc_id long, fp long{more}, rid long, s long, n long"
    return rows.select("doc_id", "text", "rid").mapInArrow(_fingerprints(shingle, words, True), schema)


def block_bounds(blocks: int, words: int = 1) -> list[tuple[int, int, int]]:
    """(word, shift, width) of each block; as many in each word, widths as even as can be."""
    each = blocks // words
    cuts = [64 * i // each for i in range(each + 1)]
    return [(j, a, b - a) for j in range(words) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_radius(most: int, blocks: int, taken: int) -> int:
    """Bits in which fingerprints that differ in `most` bits differ at most in some `taken` of the blocks."""
    each, more = divmod(most, blocks)  # at worst the bits are spread evenly
    return taken * each + max(0, taken - (blocks - more))


#: Ways to cut 64 bits: blocks, and how many of them are a segment.
CUTS = ((3, 1), (5, 2), (8, 4), (10, 6), (12, 8))


def segmentation(rows: int) -> tuple[int, int]:
    """The first way by which a key has eight table rows or fewer on average."""
    return next((c for c in CUTS if rows <= 8 << (64 * c[1] // c[0])), CUTS[-1])


def ball(width: int, radius: int) -> np.ndarray:
    """All values of so many bits with at most radius bits set; 0 first."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """A row of uint64 for each column of bits."""
    return np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names])


def _near(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ two).sum(axis=0, dtype=np.int32)


def _probes(blocks: int, taken: int, radius: int, words: int):
    bounds = block_bounds(blocks, words)
    segments = [(s, own, ball(sum(w for _, _, w in own), radius)) for s, own in enumerate(combinations(bounds, taken))]
    names = bit_columns(words)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 20_000):
                fp = _columns(whole.slice(i, 20_000), names)
                for s, parts, flips in segments:
                    own, at = np.zeros(fp.shape[1], np.uint64), 0
                    for j, shift, width in parts:
                        own |= ((fp[j] >> np.uint64(shift)) & np.uint64((1 << width) - 1)) << np.uint64(at)
                        at += width
                    keys = (own[:, None] ^ flips[None, :]).ravel() | (np.uint64(s) << np.uint64(50))
                    side = np.tile(np.arange(len(flips)) > 0, fp.shape[1]).astype(np.int8)
                    cols = [keys.view(np.int64), side, *(np.repeat(x, len(flips)).view(np.int64) for x in fp)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "side", *names])

    return run


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these links but the smallest of each component, and that smallest one."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _folded(links):
    """Batches of edges with the components of all links (pairs of arrays of nodes) that a task finds: stars, told once a
    task, or whenever there are more than it may hold."""

    def batch(u, v):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

    us, vs, held, fold_at = [], [], 0, _GATHER
    for u, v in links:
        us.append(u), vs.append(v)
        held += len(u)
        if held > fold_at:
            u, v = stars(np.concatenate(us), np.concatenate(vs))
            if len(u) > _HOLD:
                yield batch(u, v)
                u, v = u[:0], v[:0]
            us, vs, held, fold_at = [u], [v], len(u), len(u) + max(_GATHER, len(u))
    if held:
        yield batch(*stars(np.concatenate(us), np.concatenate(vs)))


def _verify(most: int, words: int, small: int = 64):
    """Rows sorted by key and side: table rows of a key come before its probes. Emits edges with the components of all links."""
    names = bit_columns(words)

    def links(sizes, tables, fp):
        first = np.cumsum(sizes) - sizes
        light = sizes <= small
        for k in range(int(tables[light].max(initial=0))):  # all light keys at once: their k-th table row with the rows after it
            own = light & (tables > k) & (sizes > k + 1)
            n = sizes[own] - k - 1
            a = np.repeat(first[own] + k, n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            near = _near(fp[:, a], fp[:, b]) <= most
            yield fp[:, a[near]], fp[:, b[near]]
        for at, n, t in zip(first[~light], sizes[~light], tables[~light], strict=True):
            own = fp[:, at : at + n]
            label = np.arange(n)
            us, vs = [], []
            for k in range(t):
                near = np.flatnonzero(_near(own[:, k : k + 1], own) <= most)
                found, where = np.unique(label[near], return_index=True)
                if len(found) > 1:
                    mine = label[k]
                    other = near[where[found != mine]]
                    us += [k] * len(other)
                    vs += other.tolist()
                    label[np.isin(label, found)] = mine
            yield own[:, us], own[:, vs]

    def found(batches):
        key, side, fp = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros((len(names), 0), np.uint64)
        for b in batches:
            key = np.concatenate([key, b.column("key").to_numpy()])
            side = np.concatenate([side, b.column("side").to_numpy()])
            fp = np.concatenate([fp, _columns(b, names)], axis=1)
            # the last key may go on; keys stand together, though not in the order of their numbers
            ends = np.flatnonzero(key[1:] != key[:-1])
            if len(ends):
                cut = ends[-1] + 1
                yield from links(*_runs(key[:cut], side[:cut]), fp[:, :cut])
                key, side, fp = key[cut:], side[cut:], fp[:, cut:]
        if len(key):
            yield from links(*_runs(key, side), fp)

    def run(batches):
        yield from _folded((_node(u), _node(v)) for u, v in found(batches))
        trim()

    return run


def _runs(key: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each key, and how many of them are table rows."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return np.diff(np.append(first, len(key))), np.add.reduceat((side == 0).astype(np.int64), first)


def _midpoints(most: int):
    """Values within half the distance: side 0, and for an odd distance those a bit farther as side 1."""
    flips = ball(64, -(-most // 2))
    far = np.bitwise_count(flips) > most // 2

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                fp = whole.column("fp").slice(i, 200).to_numpy().view(np.uint64)
                cols = [(fp[:, None] ^ flips[None, :]).ravel().view(np.int64), np.tile(far, len(fp)).astype(np.int8), np.repeat(fp, len(flips)).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["mid", "side", "fp"])

    return run


def _tie():
    """Rows sorted by mid and side: ties each fingerprint to the key's first one, if that is of side 0: the two then
    differ in no more bits than both halves have."""

    def run(batches):
        last_mid, head = None, None
        for b in batches:
            mid, side, fp = b.column("mid").to_numpy(), b.column("side").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            us, vs = [], []
            for m, far, x in zip(mid.tolist(), side.tolist(), fp.tolist(), strict=True):
                if m != last_mid:
                    last_mid, head = m, None if far else x
                elif head is not None and x != head:
                    us.append(x), vs.append(head)
            cols = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (us, vs)]
            yield pa.RecordBatch.from_arrays(cols, names=["u", "v"])

    return run


def _grid(rows: DataFrame, heavy: DataFrame, hot: int, bits: list[str]) -> DataFrame:
    """Rows of heavy keys, dealt to the cells of a grid: a block of table rows and a block of all rows meet in each."""
    spread = F.pmod(F.xxhash64(*bits), F.lit(1 << 30)).cast("long")
    rows = rows.join(heavy, "key").withColumn("own", F.col("side") == 0)
    rows = rows.withColumn("row_block", spread % F.col("blocks")).withColumn("all_block", F.floor(spread / F.col("blocks")) % F.col("blocks"))
    all_cells = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    as_any = rows.select("key", F.explode(all_cells).alias("r"), F.col("all_block").alias("a"), F.lit(1).cast("byte").alias("side"), *bits)
    as_table = rows.filter("own").select("key", F.col("row_block").alias("r"), F.explode(all_cells).alias("a"), F.lit(0).cast("byte").alias("side"), *bits)
    return as_any.unionByName(as_table).select(F.xxhash64("key", "r", "a").alias("key"), "side", *bits)


def link_edges(distinct: DataFrame, ws: Workspace, most: int = MOST, segments: int | None = None, hot: int = HOT, words: int = 1, radius: int | None = None, taken: int = 1) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fp` that have the components of all links, not all links.
    segments: blocks, `taken` of which are a segment; by default as many as suit the number of fingerprints."""
    spark, n, bits = distinct.sparkSession, flow(distinct.sparkSession), bit_columns(words)
    if segments is None:
        segments, taken = segmentation(distinct.count()) if words == 1 else (4 * words, 1)
    if segments % words:
        raise ValueError("segments must be a multiple of words")
    radius = least_radius(most, segments, taken) if radius is None else radius
    schema = "key long, side byte" + "".join(f", {c} long" for c in bits)
    rows = distinct.select(*bits).mapInArrow(_probes(segments, taken, radius, words), schema)
    sizes = rows.filter("side = 0").groupBy("key").count()
    heavy = ws.save(sizes.filter(F.col("count") > hot).select("key", F.ceil(F.col("count") / max(hot, 1)).alias("blocks")), "heavy")
    edges = []
    if heavy.isEmpty():
        pass
    elif words > 1 or most > 4:
        cells = _grid(rows, heavy, hot, bits).repartition(4 * n, "key").sortWithinPartitions("key", "side")
        edges.append(cells.mapInArrow(_verify(most, words), "u long, v long"))
        rows = rows.join(heavy, "key", "left_anti")
    else:
        # what has a table row or a probe at a heavy key meets in the middle instead
        heavy = heavy.select("key")
        sent = rows.join(heavy, "key", "left_semi").select("fp").distinct()
        mids = sent.mapInArrow(_midpoints(most), "mid long, side byte, fp long").repartition(4 * n, "mid").sortWithinPartitions("mid", "side", "fp")
        edges.append(mids.mapInArrow(_tie(), "u long, v long"))
        rows = rows.join(heavy, "key", "left_anti")
    dealt = rows.repartition(n, "key").sortWithinPartitions("key", "side")
    edges.append(dealt.mapInArrow(_verify(most, words), "u long, v long"))
    return edges[0].unionByName(edges[1]) if len(edges) > 1 else edges[0]


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST, segments: int | None = None, hot: int = HOT, words: int = 1, radius: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits a word), component_id (smallest doc_id reachable over links)."""
    ws, bits = Workspace(docs.sparkSession, "simhash"), bit_columns(words)
    fps = ws.save(fingerprints(docs, shingle, words), "fps")
    smallest = ws.save(fps.groupBy("fp", *(bits if words > 1 else [])).agg(F.min("doc_id").alias("low")), "distinct")
    roots = ws.save(components(link_edges(smallest, ws, most, segments, hot, words, radius), ws).withColumnRenamed("node", "fp"), "roots")
    # most fingerprints stand alone; the smallest doc_id of the others' component is a minimum over its fingerprints
    low = ws.save(smallest.join(sent_if_small(roots), "fp").groupBy("root").agg(F.min("low").alias("least")), "low")
    linked = ws.save(roots.join(sent_if_small(low), "root").select("fp", F.struct("least").alias("linked")), "linked")
    ids = smallest.join(sent_if_small(linked), "fp", "left")
    ids = ws.save(ids.select("fp", F.when(F.col("linked").isNull(), F.col("low")).otherwise(F.col("linked.least")).alias("component_id")), "ids")
    ws.drop("distinct", "heavy", "roots", "low", "linked")
    digits = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in bits])
    return fps.join(ids, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def _sets(shingle: int):
    names = ["root", "s", "blocks"]

    def run(batches):
        let_go()
        for b in slices(batches, "text"):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            hashes = [np.unique(shingle_hashes(t or b"", shingle)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(hashes, pa.binary())], names=[*names, "hashes"])

    return run


def similar(sets: list[np.ndarray], tables: int, least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sets with Jaccard similarity of least or more: of the first `tables` sets with
    the ones after those, or of all pairs where there are none after."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    at = np.cumsum(size) - size
    words, codes = np.unique(np.concatenate(sets), return_inverse=True)
    label, mark = np.arange(m), np.zeros(len(words), bool)
    us, vs = [], []
    for k in range(tables):
        after = np.arange(tables if tables < m else k + 1, m)
        low, high = np.minimum(size[k], size[after]), np.maximum(size[k], size[after])
        after = after[(label[after] != label[k]) & (low > 0) & (low + 1e-9 >= least * high)]
        if not len(after):
            continue
        own, many = codes[at[k] : at[k] + size[k]], size[after]
        first = np.cumsum(many) - many
        mark[own] = True
        hit = mark[codes[np.repeat(at[after] - first, many) + np.arange(many.sum())]]
        mark[own] = False
        common = np.add.reduceat(hit, first, dtype=np.int64)
        near = after[common + 1e-9 >= least * (size[k] + many - common)]
        found, where = np.unique(label[near], return_index=True)
        us += [k] * len(found)
        vs += near[where].tolist()
        label[np.isin(label, found)] = label[k]
    return us, vs


def _similar(least: float):
    """Rows sorted by key and side, as _verify has them."""

    def out(s, side, sets):
        us, vs = similar(sets, side.count(0), least) if len(s) > 1 else ([], [])
        return [s[i] for i in us], [s[i] for i in vs]

    def run(batches):
        last, s, side, sets = None, [], [], []
        for b in batches:
            u, v = [], []
            for key, own, where, hashes in zip(*(b.column(c).to_pylist() for c in ("key", "s", "side", "hashes")), strict=True):
                if key != last:
                    x, y = out(s, side, sets)
                    u += x
                    v += y
                    last, s, side, sets = key, [], [], []
                s.append(own), side.append(where), sets.append(np.frombuffer(hashes, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        u, v = out(s, side, sets)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        trim()

    return run


def similar_edges(rows: DataFrame, fps: DataFrame, roots: DataFrame, ws: Workspace, shingle: int, least: float, hot_sets: int = HOT_SETS) -> DataFrame:
    """Edges (u, v) between sets `s` that have the components of all links within components of fingerprints.
    rows: rid, text; fps: their set_fingerprints; roots: node (fp), root."""
    # a fingerprint that stands alone may still have several sets
    each = ws.save(fps.groupBy("fp", "s").agg(F.min("rid").alias("rid"), F.max("n").alias("n")), "each")
    each = each.join(sent_if_small(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    members = ws.save(each.groupBy("root", "s").agg(F.min("rid").alias("rid"), F.max("n").alias("n")), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("n")).filter("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / hot_sets), F.ceil(F.col("n") / HOT_HASHES))
    sizes = ws.save(sizes.select("root", blocks.alias("blocks")), "sizes")
    compared = ws.save(members.join(sent_if_small(sizes), "root").select("rid", "root", "s", "blocks"), "compared")
    texts = rows.select("rid", "text").join(sent_if_small(compared), "rid")
    sets = texts.select("root", "s", "blocks", "text").mapInArrow(_sets(shingle), "root long, s long, blocks long, hashes binary")
    own, other = F.pmod(F.xxhash64("s"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = sets.withColumn("own", own).withColumn("other", other)
    key = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    cells = cells.select(key.alias("key"), (F.col("own") > F.col("other")).cast("byte").alias("side"), "s", "hashes")
    dealt = cells.repartition(flow(rows.sparkSession), "key").sortWithinPartitions("key", "side")
    return dealt.mapInArrow(_similar(least), "u long, v long")


def keep_one(docs: DataFrame, least: float | None = None, shingle: int = SHINGLE, words: int = 1, hot_sets: int = HOT_SETS, **how) -> DataFrame:
    """One row of each component, with all columns: that of the smallest doc_id (nulls last), of several the first in
    place. least: links are verified by the Jaccard similarity of sets of shingles. `how` goes to link_edges."""
    ws, bits = Workspace(docs.sparkSession, "near"), bit_columns(words)
    rows = ws.numbered(docs)
    fps = ws.save(set_fingerprints(rows, shingle, words), "fps")
    distinct = ws.save(fps.select("fp", *(bits if words > 1 else [])).distinct(), "distinct")
    roots, node = ws.save(components(link_edges(distinct, ws, words=words, **how), ws), "roots"), "fp"
    if least is not None:
        # a workspace of their own: the first components are still read
        edges = similar_edges(rows, fps, roots, ws, shingle, least, hot_sets)
        own = Workspace(docs.sparkSession, "similar")
        roots, node = ws.save(components(edges, own), "similar"), "s"
    first = ws.save(fps.groupBy(node).agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rid")).alias("first")), "first")
    roots = sent_if_small(roots.withColumnRenamed("node", node))
    # alone, or the first of a component
    alone = first.join(roots, node, "left_anti").select("first.rid")
    best = first.join(roots, node).groupBy("root").agg(F.min("first").alias("first")).select("first.rid")
    gone = ws.save(fps.select("rid").join(alone.unionByName(best), "rid", "left_anti"), "gone")
    ws.drop("fps", "distinct", "heavy", "each", "members", "sizes", "compared", "first")
    return unmasked(rows.join(sent_if_small(gone), "rid", "left_anti"), docs.columns)
