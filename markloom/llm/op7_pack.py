"""Best-fit packing of tokenised documents into sequences of at most `capacity` tokens.

Tokens. A text is cut at ASCII white space, across which this kind of tokenizer never merges, and only the words
that a worker hasn't met are tokenised; the ids of a batch are then gathered by numpy. An end id closes each
document. Longer documents are cut at multiples of the capacity.

Packing is bulk-synchronous best fit. Pieces and gaps are sorted by size, longest pieces first. In a superstep all
pieces of one length look up the smallest gap that holds them (the successor in the sorted gaps), a conflict over
a gap is resolved by rank (the piece's place among those of its length), the gaps shrink, and the step repeats
until the length is used up; only where no gap is left, sequences open. Pieces of equal length are
interchangeable, so a sweep works on classes: its state is the number of pieces and the ranges of sequences by
size, at most `capacity` sizes, however many documents there are. What grows with the input stays distributed:
ranks (a count per task and length, summed over tasks) and the assignment of pieces to sequences.

A very long text is tokenised alone, in the task that reads it. Null or empty texts are a document of the end id alone;
a null id is an id like others. Repeated rows are packed each. Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import WordCache, Workspace, held, ragged, slices

CAPACITY, END_ID = 2048, 0
#: Words whose ids a worker keeps; beyond that it forgets the half that was needed least. Bounds memory, not results.
CACHED_WORDS = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class WordIds(WordCache):
    """Ids of texts by their words: a word's row is where its ids begin in one store, and how many there are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.store, self.end = np.zeros(1 << 16, np.uint32), 0
        super().__init__(self._encode, CACHED_WORDS)

    def forget(self) -> None:
        best = self.most_used()
        first, size = self.rows[best].T
        ends = np.cumsum(size)
        kept = self.store[ragged(first, size)]
        super().forget()
        self.store[: len(kept)], self.end = kept, len(kept)
        self.rows[: len(best), 0] = ends - size

    def _encode(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), 2), np.int32)
        for k in range(0, len(words), 2000):  # bounds what the encoder holds at once
            part = words[k : k + 2000]
            # one text of many words costs less than as many texts; a token's word is where its first character lies
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, np.uint32)
            begins = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            first = np.fromiter((a for a, _ in got.offsets), np.int64, len(ids))
            size = np.bincount(np.searchsorted(begins, first, "right"), minlength=len(part))
            while self.end + len(ids) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            self.store[self.end : self.end + len(ids)] = ids
            out[k : k + len(part), 0] = self.end + np.cumsum(size) - size
            out[k : k + len(part), 1] = size
            self.end += len(ids)
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin (one more for the end)."""
        rows, at, _, _ = self.of(texts, lower=False)
        ends = np.concatenate([[0], np.cumsum(rows[:, 1], dtype=np.int64)])
        return self.store[ragged(rows[:, 0], rows[:, 1])], ends[at]


def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return held(("ids", path), lambda: WordIds(path))


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        words, pid = word_ids(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in slices(batches, "text"):
            ids, at = words.ids(b.column("text"))
            doc_ids = b.column("doc_id")
            last = np.array([end_id], np.uint32)
            rows: list[tuple[int, int, int, int, int, int]] = []
            for d in range(len(doc_ids)):
                own = np.concatenate([ids[at[d] : at[d + 1]], last])
                for p, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    n = len(part)
                    rows.append((d, p, start, n, zlib.crc32(part.astype("<u4").tobytes()), int(seen[n])))
                    seen[n] += 1
            cols = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.take(pa.array(cols[0])),
                    pa.array(cols[1].astype(np.int32)),
                    *(pa.array(c) for c in cols[2:5]),
                    pa.array(np.full(len(rows), pid, np.int32)),
                    pa.array(cols[5]),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "pid", "nth"],
            )

    return run


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank from, rank to, first sequence, offset): ranks of a length that go to successive sequences."""
    runs: list[tuple[int, int, int, int, int]] = []
    ranges: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, how many)
    sizes: list[int] = []  # the gaps there are, sorted
    fresh = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in ranges:
                insort(sizes, gap)
                ranges[gap] = []
            ranges[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(sizes, length)
            if k < len(sizes):
                gap = sizes[k]
                first, n = ranges[gap].pop()
                if not ranges[gap]:
                    del ranges[gap], sizes[k]
            else:
                gap, first, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            each = gap // length  # a gap takes so many before the next one is touched
            full = min(n, left // each)
            for j in range(each if full else 0):
                runs.append((length, rank, rank + full, first, capacity - gap + j * length))
                rank += full
            left -= full * each
            put(gap - each * length, first, full)
            first, n = first + full, n - full
            if n and left and left < each:  # the last gap gets what is left
                for j in range(left):
                    runs.append((length, rank, rank + 1, first, capacity - gap + j * length))
                    rank += 1
                put(gap - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(gap, first, n)
    return runs


def _assign(runs: list[tuple[int, int, int, int, int]], capacity: int):
    table = np.array(sorted(runs) or [(0, 0, 0, 0, 0)], np.int64)
    big = np.int64(1) << 48  # ranks are far below
    keys = table[:, 0] * big + table[:, 1]

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("before").to_numpy()
            r = table[np.searchsorted(keys, length * big + rank, "right") - 1]
            cols = {k: b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            cols |= {"sequence_id": pa.array(r[:, 3] + rank - r[:, 1]), "offset": pa.array(r[:, 4])}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id and text to pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ws = Workspace(docs.sparkSession, "pack")
    run = _pieces(tokenizer or default_tokenizer(), capacity, end_id)
    # written once: ranks must not change where a task runs again
    pieces = ws.save(docs.select("doc_id", "text").mapInArrow(run, PIECES), "pieces")
    counts = ws.save(pieces.groupBy("length", "pid").agg(F.count("*").alias("n")), "counts")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # capacity rows at most
    runs = best_fit({r["length"]: r["n"] for r in totals}, capacity)
    w = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "pid", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    # counts grow with the number of tasks: never broadcast
    ranked = pieces.join(before.hint("merge"), ["pid", "length"])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_assign(runs, capacity), schema)
