"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is cut greedily into
the longest phrases that occur in the sample (a byte that doesn't occur is a phrase of its own). A phrase points into
the sample, so it costs the logarithm of the sample's length; the language of the least cost, that is of the fewest
phrases normalised by that logarithm, wins, and ties go to the first in alphabetical order. The score is the winner's
share of exp(-cost) over all languages. Texts are lower-cased, white space is blanks, and phrases are of bytes of UTF-8:
they run over word ends as far as they match. All of every text counts.

The sample: of each language distinct labelled texts in the order of their hashes, each whole, until they have
`bytes_each` bytes (with many languages `BYTES_ALL` by their number). Texts of over `LONGEST` bytes aren't taken, but for
a language that has no others: there its shortest one is. So the sample, and a worker's tables, don't grow with the input.
Languages are read from the labels (a row for each label is collected); null labels teach nothing.

Parsing goes by numpy over many stretches (lanes) of text at once, a byte of each in a step. A lane begins as if a
phrase did; afterwards it is parsed again from the state that the lane before it left, up to the first place where both
ways begin a phrase, and so on until no lane's entry changes. The counts are those of parsing byte by byte.

Null text or a text without a letter: `und`, score 0; so is every text where no language was learned. A very long text
is parsed in chunks that hand their state on. Repeated rows each give a row, null ids too. Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import bytes_of, held, id_hash_remainder, slices

#: The bound of what is learned: bytes of a language, of all languages, of one text.
BYTES_EACH, BYTES_ALL, LONGEST = 1 << 16, 1 << 19, 20_000
UNKNOWN = "und"
#: Bytes of a lane, and of what is parsed at once.
LANE, CHUNK = 256, 1 << 21
#: Between sampled texts: in no UTF-8 text, so no phrase crosses.
BETWEEN = b"\xff"
_BLANK = np.where(np.isin(np.arange(256), (9, 10, 11, 12, 13)), 32, np.arange(256)).astype(np.uint8)


def folded(text: str) -> bytes:
    return text.lower().encode().translate(_BLANK.tobytes())


class SuffixAutomaton:
    """All substrings of some bytes. A state is the start of its row in `table`, which has by class of byte twice the
    next state, plus 1 where a phrase begins with the byte: at the root, and where nothing goes on (there the next
    state is the root's)."""

    def __init__(self, sample: bytes):
        edges: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sample:
            new = len(edges)
            edges.append({}), link.append(0), length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(edges)
                    edges.append(edges[q].copy()), link.append(link[q]), length.append(length[p] + 1)
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        own = sorted(set(sample) - set(BETWEEN))
        self.wide = len(own) + 1
        self.classes = np.zeros(256, np.int64)
        self.classes[own] = np.arange(1, self.wide)
        at = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
        byte = np.array([c for e in edges for c in e], np.int64)
        to = np.array([t for e in edges for t in e.values()], np.int32)
        fits = self.classes[byte] > 0
        table = np.zeros((len(edges), self.wide), np.int32)
        table[at[fits], self.classes[byte[fits]]] = to[fits]
        begins = table == 0
        begins[0] = True
        self.table = (2 * self.wide * np.where(table == 0, table[0], table) + begins).astype(np.int32).ravel()
        self.classes = self.classes.astype(np.int32)

    def _chunk(self, flat: np.ndarray, at: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Phrases that begin in each text, the first one of which goes on in state `entry`; the state at the end."""
        size = np.diff(at)
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(len(size)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        if not len(owner):
            return np.zeros(len(size), np.int64), entry
        start = at[owner] + nth * LANE
        stop = np.minimum(start + LANE, at[owner + 1])
        width = stop - start
        order = np.argsort(-width, kind="stable")  # at each step the lanes that go on come first
        deep = np.searchsorted(-width[order], -np.arange(1, LANE + 1), "right")
        grid = self.classes[flat[np.minimum(start[order][None, :] + np.arange(LANE)[:, None], len(flat) - 1)]]
        begins = np.zeros(grid.shape, bool)
        left = np.zeros(len(order), np.int32)
        for j in range(LANE):
            m = deep[j]
            if not m:
                break
            got = self.table[left[:m] + grid[j, :m]]
            left[:m], begins[j, :m] = got >> 1, got & 1
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.full(len(order), -1)  # each lane's predecessor, by place; -1: none, -2: in the chunk before
        before[place[1:]] = np.where(nth[1:] > 0, place[:-1], -1)
        before[place[0]] = -2
        taken = np.zeros(len(order), np.int32)
        width = width[order]
        while True:
            want = np.where(before == -2, entry, np.where(before < 0, 0, left[np.maximum(before, 0)])).astype(np.int32)
            live = np.flatnonzero(want != taken)
            if not len(live):
                break
            taken[live] = want[live]
            state = want[live]
            for j in range(LANE):
                got = self.table[state + grid[j, live]]
                state, new = got >> 1, (got & 1).astype(bool)
                met = new & begins[j, live]  # both ways begin a phrase here: what follows stays
                begins[j, live] = new
                over = width[live] == j + 1
                left[live[over & ~met]] = state[over & ~met]
                on = ~met & ~over
                live, state = live[on], state[on]
                if not len(live):
                    break
        n = np.bincount(owner[order], begins.sum(axis=0), minlength=len(size)).astype(np.int64)
        return n, int(left[place[-1]])

    def phrases(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Greedy longest matches that cover each text."""
        if len(flat) <= CHUNK:
            return self._chunk(flat, at, 0)[0]
        out = np.zeros(len(at) - 1, np.int64)
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            entry = 0
            for c in range(a, b, CHUNK):
                n, entry = self._chunk(flat[c : min(c + CHUNK, b)], np.array([0, min(CHUNK, b - c)]), entry)
                out[i] += n[0]
        return out


def learn(docs: DataFrame, usable: Column, bytes_each: int = BYTES_EACH, longest: int = LONGEST) -> tuple[tuple[str, bytes], ...]:
    """(language, sample) in alphabetical order, from the usable rows."""
    size = F.octet_length("text")
    own = docs.filter(usable & F.col("lang").isNotNull() & (size > 0)).select("lang", "text", size.alias("size"), F.xxhash64("text").alias("h"))
    short = F.col("size") <= longest
    sums = own.groupBy("lang").agg(F.count(F.when(short, 1)).alias("n"), F.sum(F.when(short, F.col("size"))).alias("bytes")).collect()  # a row per language
    if not sums:
        return ()
    bytes_each = min(bytes_each, max(BYTES_ALL // len(sums), 1))
    found: dict[str, list[str]] = {}
    # a fraction of the hashes that has three times the bytes needed; more where too few texts differ
    factor, left = 3.0, {r["lang"]: r["bytes"] for r in sums if r["n"]}
    while left:
        share = F.coalesce(*[F.when(F.col("lang") == k, int(min(1.0, factor * bytes_each / v) * (1 << 40))) for k, v in left.items()])
        rows = own.filter(short & (F.pmod("h", F.lit(1 << 40)) < share)).groupBy("lang", "h").agg(F.first("text").alias("text"), F.first("size").alias("size"))
        w = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).filter(F.col("before") < bytes_each)
        got = rows.select("lang", "text", "size", "before").collect()  # under bytes_each + longest of each language
        for lang, all_bytes in list(left.items()):
            mine = sorted((r for r in got if r["lang"] == lang), key=lambda r: r["before"])
            if sum(r["size"] for r in mine) >= bytes_each or factor * bytes_each >= all_bytes:
                found[lang] = [r["text"] for r in mine]
                del left[lang]
        factor *= 8
    if rest := [r["lang"] for r in sums if not r["n"]]:
        alone = own.filter(F.col("lang").isin(rest)).groupBy("lang").agg(F.min_by("text", F.struct("size", "h")).alias("text"))
        found |= {r["lang"]: [r["text"]] for r in alone.collect()}
    return tuple((k, BETWEEN.join(map(folded, v))) for k, v in sorted(found.items()))


def costs(samples: tuple[tuple[str, bytes], ...], automata: list[SuffixAutomaton], texts: pa.Array) -> np.ndarray:
    """Nats that each text costs in each language."""
    flat, at = bytes_of(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = _BLANK[flat]
    return np.stack([a.phrases(flat, at) * math.log(len(s) + 1) for a, (_, s) in zip(automata, samples, strict=True)], 1)


def _predict(samples: tuple[tuple[str, bytes], ...]):
    names = [k for k, _ in samples] or [UNKNOWN]

    def run(batches):
        key = ("language", *((k, len(s), zlib.crc32(s)) for k, s in samples))
        automata = held(key, lambda: [SuffixAutomaton(s) for _, s in samples])
        for b in slices(batches, "text"):
            text = b.column("text")
            known = np.array([bool(t) and any(map(str.isalpha, t)) for t in text.to_pylist()], bool) & bool(samples)
            best, score = np.zeros(len(known), np.int64), np.zeros(len(known))
            if samples:
                cost = costs(samples, automata, text)
                best = cost.argmin(axis=1)
                score = 1 / np.exp(-np.clip(cost - cost.min(axis=1, keepdims=True), 0, 700)).sum(axis=1)
            said = [names[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(said, pa.string()), pa.array(np.where(known, np.minimum(score, 1.0), 0.0))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, samples: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """doc_id, held_out, text to doc_id, held_out, lang_pred, score."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(samples), schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose id hash is not 2 modulo 4, predicts all."""
    held_out = id_hash_remainder(F.col("doc_id"), 4) == 2
    return identify(docs.withColumn("held_out", held_out), learn(docs, ~held_out))
