"""Language-model scoring by a subword lattice.

The model is a unigram model over the pieces of an existing vocabulary file. A text is its words, A-Z lower-cased, each
with the vocabulary's word mark before it, then an end event. The probability of a word is the sum over all its
segmentations into pieces, by a forward recursion in log space; a character that is no piece is spelled by its byte
pieces. The probability of a text is the product over its words and the end: the marginal over all segmentations of the
whole text, as no piece crosses a word's mark.

Weights. The file's scores are the start: they are negated ranks, read by Zipf's law. `rounds` rounds of EM over the
words of the training documents, each weighted by its count, then fit the weights to the corpus; with none the file's
weights stay. The words are counted by an aggregation over the whole corpus; the counts are a distributed table that
grows with the input. A round runs the forward-backward recursion over all distinct words and sums expected piece counts
(as many numbers as pieces, whatever the input).

Scoring. A word's lattice value needs only the pieces. Its count is needed by the base score: counts of the
`common` most frequent words are sent to every task (a fixed number); the other words of a text, none of which is
frequent, are joined with the counts table. No word is hot in that join.

Lattices of many words are computed at once: words of equal length are a matrix of code points, and substrings are
looked up at once by 64-bit rolling hashes in an open-addressing table, then compared by their characters.

Null text: empty; it has the end token alone. A very long word goes by itself, with a number for each of its characters.
A null doc_id's hash is that of an empty text. Repeated rows each give a row. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import WordCache, WordNumbers, Workspace, held, id_hash_remainder, let_go, slices, sums, trim, words_of

ROUNDS, COMMON = 2, 300_000
#: Added to each expected piece count.
PRIOR = 0.1
#: Longer words go one by one, not by matrix.
MATRIX_CHARS = 48
MARK = "▁"
_U, _BASE, _LOW = np.uint64, np.uint64(0x9E3779B97F4A7C15), -1e300


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Normal pieces in the order of their ids, start weights (their file scores are negated ranks), ids of the 256 byte pieces.

    Pieces with an A-Z letter, or the word mark after their start, never fit a lower-cased word; they stay and get no count.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, byte = [], [], np.zeros(256, np.int64)
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[3:5], 16)] = -1 - int(sp.id_to_piece(i)[3:5], 16)
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append(sp.id_to_piece(i))
            scores.append(sp.get_score(i))
    weight = 1.0 / (10.0 - np.array(scores) + np.array(scores).max())  # Zipf's law over the ranks
    byte = len(pieces) + np.arange(256)
    return pieces, np.concatenate([weight, np.full(256, weight.min())]), byte


class Lattice:
    """Forward (and backward) recursion over the segmentations of words."""

    def __init__(self, path: str, log_p: np.ndarray):
        self.pieces, _, self.byte = vocabulary(path)
        self.log_p = np.append(log_p, _LOW)  # the last one stands for no piece
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.size = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.longest = int(self.size.max())
        flat = "".join(p.ljust(self.longest, "\0") for p in self.pieces)
        self.points = np.frombuffer(flat.encode("utf-32-le"), np.uint32).reshape(len(self.pieces), -1)
        self.power = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(MATRIX_CHARS, _BASE)]))
        self.back = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(MATRIX_CHARS, _U(pow(int(_BASE), -1, 1 << 64)))]))
        h = (self.points * self.power[: self.longest]).sum(axis=1, dtype=np.uint64)
        self.bits = _U((4 * len(h) - 1).bit_length())
        self.last = (1 << int(self.bits)) - 1
        self.keys, self.ids = np.zeros(self.last + 1, np.uint64), np.full(self.last + 1, -1, np.int64)
        slot, left = self._slot(h), np.arange(len(h))
        while len(left):
            free = left[self.ids[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.ids[slot[put]], self.keys[slot[put]] = put, h[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.last

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> _U(29))) * _U(0x94D049BB133111EB) >> (_U(64) - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where there is none."""
        slot = self._slot(h)
        got = self.keys[slot]
        out = np.where(got == h, self.ids[slot], -1)
        live = np.flatnonzero((got != h) & (got != 0))
        slot, h = slot[live], h[live]
        while len(live):
            slot = (slot + 1) & self.last
            got = self.keys[slot]
            same = got == h
            out[live[same]] = self.ids[slot[same]]
            on = ~same & (got != 0)
            live, slot, h = live[on], slot[on], h[on]
        return out

    def _spelled(self, char: str) -> list[int]:
        return [int(self.byte[b]) for b in char.encode("utf-8", "surrogatepass")]

    def _matrix(self, points: np.ndarray, weight: np.ndarray | None, into: np.ndarray | None) -> np.ndarray:
        """Log values of words of one length, a row of code points for each character's place."""
        width, n = points.shape
        arcs = [(e - k, e) for e in range(1, width + 1) for k in range(1, min(e, self.longest) + 1)]
        start, end = np.array(arcs).T
        prefix = np.zeros((width + 1, n), np.uint64)
        np.cumsum(points * self.power[:width, None], axis=0, out=prefix[1:])
        h = (prefix[end] - prefix[start]) * self.back[start, None]
        ids = self._find(h.ravel()).reshape(h.shape)
        for i, (a, b) in enumerate(arcs):  # a hash only says where to look
            hit = np.flatnonzero(ids[i] >= 0)
            piece = ids[i, hit]
            same = (self.size[piece] == b - a) & (self.points[piece, : b - a] == points[a:b, hit].T).all(axis=1)
            ids[i, hit[~same]] = -1
        value = self.log_p[ids]
        # characters that are no piece are spelled by their bytes
        spelled: list[tuple[int, np.ndarray, list[int]]] = []
        for i in np.flatnonzero(end - start == 1):
            odd = np.flatnonzero(ids[i] < 0)
            for c in np.unique(points[end[i] - 1, odd]):
                own = self._spelled(chr(int(c)))
                rows = odd[points[end[i] - 1, odd] == c]
                value[i, rows] = self.log_p[own].sum()
                spelled.append((int(i), rows, own))
        alpha = np.zeros((width + 1, n))
        for e in range(1, width + 1):
            own = np.flatnonzero(end == e)
            alpha[e] = _log_sum(alpha[start[own]] + value[own])
        if into is not None:
            beta = np.zeros((width + 1, n))
            for s in range(width - 1, -1, -1):
                own = np.flatnonzero(start == s)
                beta[s] = _log_sum(beta[end[own]] + value[own])
            share = np.exp(np.minimum(0, alpha[start] + value + beta[end] - alpha[width])) * weight
            into += np.bincount(ids.ravel() + 1, share.ravel(), minlength=len(into) + 1)[1:]
            for i, rows, own in spelled:
                for k in own:
                    into[k] += share[i, rows].sum()
        return alpha[width]

    def _arcs(self, word: str, end: int) -> list[tuple[int, float, list[int]]]:
        """Start, log weight and pieces of what can end there."""
        own = []
        for start in range(max(0, end - self.longest), end):
            i = self.index.get(word[start:end])
            if i is not None:
                own.append((start, float(self.log_p[i]), [i]))
        if not own or own[-1][0] != end - 1:
            ids = self._spelled(word[end - 1])
            own.append((end - 1, float(self.log_p[ids].sum()), ids))
        return own

    def _single(self, word: str, weight: float = 1.0, into: np.ndarray | None = None) -> float:
        """A long word, place by place."""
        n = len(word)
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0
        for end in range(1, n + 1):
            x = [alpha[a] + p for a, p, _ in self._arcs(word, end)]
            top = max(x)
            alpha[end] = top + math.log(sum(math.exp(y - top) for y in x))
        if into is not None:
            beta = np.full(n + 1, -np.inf)
            beta[n] = 0
            for end in range(n, 0, -1):  # what begins at `end` has been seen
                for start, p, ids in self._arcs(word, end):
                    beta[start] = np.logaddexp(beta[start], beta[end] + p)
                    share = weight * math.exp(min(0.0, alpha[start] + p + beta[end] - alpha[n]))
                    for j in ids:
                        into[j] += share
        return float(alpha[n])

    def words(self, words: list[str], weights: np.ndarray | None = None, into: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each word with its mark; adds expected piece counts, by weight, to `into`."""
        out = np.zeros(len(words))
        marked = [MARK + w for w in words]
        weights = np.ones(len(words)) if weights is None else weights
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        for width in np.unique(size).tolist():
            own = np.flatnonzero(size == width)
            if width > MATRIX_CHARS:
                for i in own.tolist():
                    out[i] = self._single(marked[i], float(weights[i]), into)
                continue
            step = max(64, 1_000_000 // (width * min(width, self.longest)))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                flat = "".join([marked[i] for i in part.tolist()]).encode("utf-32-le", "surrogatepass")
                points = np.ascontiguousarray(np.frombuffer(flat, np.uint32).reshape(len(part), width).T.astype(np.uint64))
                out[part] = self._matrix(points, weights[part], into)
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def _count_batches(batches):
    let_go()
    for b in slices(batches, "text", 2_000_000):
        codes, names, _ = words_of(pc.ascii_lower(pc.fill_null(b.column("text"), "")))
        yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(codes, minlength=len(names)))], names=["word", "c"])


def word_counts(docs: DataFrame) -> DataFrame:
    """text to word, c."""
    return docs.select("text").mapInArrow(_count_batches, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _expect(path: str, log_p: np.ndarray):
    def run(batches):
        let_go()
        lattice, into, words, weights = Lattice(path, log_p), np.zeros(len(log_p)), [], []

        def use() -> None:
            lattice.words(words, np.array(weights, np.float64), into)
            words.clear(), weights.clear()

        for b in batches:
            words += b.column("word").to_pylist()
            weights += b.column("c").to_pylist()
            if len(words) >= 100_000:  # fuller matrices
                use()
        use()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(into))), pa.array(into)], names=["piece", "e"])
        trim()

    return run


def train(counts: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces (and of the byte pieces after them), by EM from the file's weights."""
    _, start, _ = vocabulary(path)
    log_p = np.log(start / start.sum())
    for _ in range(rounds):
        rows = counts.mapInArrow(_expect(path, log_p), "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e"))
        e = np.full(len(log_p), PRIOR)
        for r in rows.collect():  # a number per piece
            e[r["piece"]] += r["e"]
        log_p = np.log(e / e.sum())
    return log_p


def _most_common(counts: DataFrame, common: int) -> tuple[pa.Array, np.ndarray]:
    """At most `common` words and their counts: those above the count at which there are as many, by a histogram on a log scale."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 32).cast("int")
    sizes = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    total, least = 0, None
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > common:
            break
        least = k
    if least is None:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    rows = counts.filter(level >= least).select("word", "c").toArrow().combine_chunks()
    return rows["word"].combine_chunks(), rows["c"].to_numpy()


def _numbered(words: pa.Array) -> WordNumbers:
    numbers = WordNumbers()
    if len(words):
        numbers.add(words)
    return numbers


def _score_batches(model: str, path: str, log_p, known, below: float):
    def run(batches):
        from pyspark import TaskContext

        words, counts = known.value
        common = _numbered(words)
        counts = np.append(counts, -1)  # of words that aren't common
        lattice, pid, nth = Lattice(path, log_p.value), TaskContext.get().partitionId(), 0

        def compute(words: list[str]) -> np.ndarray:
            return np.stack([counts[common.find(pa.array(words, pa.string()))], lattice.words(words) / math.log(10)], 1)

        cache = held(("lm", model), lambda: WordCache(compute, limit=250_000))
        cache.compute = compute
        names = ["rid", "doc_id", "held_out", "word", "base_score", "n_words", "n_known", "score"]
        for b in slices(batches, "text"):
            values, at, distinct, codes = cache.of(b.column("text"))
            docs, c = len(at) - 1, values[:, 0]
            seen = c >= 0
            base = np.where(seen, np.log10(np.maximum(c, 0) + 1) - below, 0.0)
            rid = (np.int64(pid) << np.int64(40)) + nth + np.arange(docs)
            nth += docs
            own = [pa.array(rid), b.column("doc_id"), b.column("held_out"), pa.nulls(docs, pa.string()), pa.array(sums(base, at))]
            own += [pa.array(np.diff(at)), pa.array(sums(seen & (c > 0), at).astype(np.int64)), pa.array(sums(values[:, 1], at))]
            yield pa.RecordBatch.from_arrays(own, names=names)
            rare = np.flatnonzero(~seen)
            if len(rare):
                owner = np.searchsorted(at, rare, "right") - 1
                pair, times = np.unique(owner * np.int64(len(distinct)) + codes[rare], return_counts=True)
                m = len(pair)
                own = [pa.array(rid[pair // len(distinct)]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), distinct.take(pa.array(pair % len(distinct)))]
                zeros = pa.array(np.zeros(m))
                yield pa.RecordBatch.from_arrays([*own, zeros, pa.array(times), pa.array(np.zeros(m, np.int64)), zeros], names=names)

    return run


def score(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS, common: int = COMMON) -> DataFrame:
    """doc_id, held_out (never learned from), text to n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark, path = docs.sparkSession, path or default_vocabulary()
    ws = Workspace(spark, "lm")
    learned = docs.filter(~F.col("held_out"))
    counts = ws.save(word_counts(learned), "counts")
    documents = learned.count()
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = total["n"] + documents, total["v"] + bool(documents)
    below = math.log10(n + v + 1)
    log_p = train(counts, path, rounds)
    end_p = (documents + PRIOR) / (n + 3 * PRIOR)  # after a word comes another one, or the end
    sent, known = spark.sparkContext.broadcast(log_p), spark.sparkContext.broadcast(_most_common(counts, common))
    schema = "rid long, doc_id long, held_out boolean, word string, base_score double, n_words long, n_known long, score double"
    # written once: row ids must not change where a task runs again
    run = _score_batches(ws.root, path, sent, known, below)
    rows = ws.save(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema), "rows")
    rare = rows.filter(F.col("word").isNotNull()).join(counts, "word", "left")
    c, zero = F.coalesce("c", F.lit(0)), F.lit(0).cast("long")
    found = F.when(c > 0, F.col("n_words")).otherwise(zero)
    rare = rare.select("rid", "doc_id", "held_out", (F.col("n_words") * (F.log10(c + 1) - below)).alias("base_score"), zero.alias("n_words"), found.alias("n_known"), "score")
    own = rows.filter(F.col("word").isNull()).drop("word")
    # words counted above have their numbers; a text's own row has the number of all its words
    added = ["base_score", "n_words", "n_known", "score"]
    per = own.unionByName(rare).groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(k).alias(k) for k in added])
    return per.select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + int(documents > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + (math.log10(documents + 1) - below)).alias("base_score"),
        (F.col("score") + F.col("n_words") * math.log10(1 - end_p) + math.log10(end_p)).alias("score"),
    )


def lm_score(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose id hash is not 2 modulo 7, scores all."""
    return score(docs.select("doc_id", "text", (id_hash_remainder(F.col("doc_id"), 7) == 2).alias("held_out")))
