"""Shared helpers: shared-folder tables, ASCII folding, column hygiene."""

from __future__ import annotations

import contextlib
import ctypes
import os
import string
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.sources import shared_dir

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: Bytes to bytes: A-Z become a-z; digits, a-z and every byte of a non-ASCII character stay; the rest become a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


#: Bytes of an Arrow batch; ten thousand rows, the other limit, can be far more where texts are long.
ARROW_BYTES = 4 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, where their path doesn't have it anyway."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if root in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    name = os.path.join(tempfile.mkdtemp(prefix="markloom-"), "markloom.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "markloom")):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
    context.addPyFile(name)


def tune(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session says something itself; ships the package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (spark.conf.get(key) or "").startswith(str(64 << 20)):  # Spark's default
        spark.conf.set(key, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def masked(docs: DataFrame, **more: Column) -> DataFrame:
    """docs with doc_id and text under their names and all other columns as x_0, x_1, ... (and more columns),
    so that what an operator adds can't clash with what the rows bring along."""
    names = {"doc_id", "text"}
    own = [F.col(f"`{c}`").alias(c if c in names else f"x_{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*own, *[c.alias(k) for k, c in more.items()])


def unmasked(df: DataFrame, columns: list[str]) -> DataFrame:
    names = {"doc_id", "text"}
    return df.select(*[F.col(c if c in names else f"x_{i}").alias(c) for i, c in enumerate(columns)])


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Workspace:
    """Tables written to the shared folder to cut lineage: they survive a lost executor, unlike cached blocks.

    Tables that are superseded go at once. Those that a returned DataFrame still reads stay until it has been
    written: clean() then deletes them.
    """

    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        tune(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Workspace.made.append(self.root)

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path, mode="overwrite", partitionBy=partition_by)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    def numbered(self, docs: DataFrame, name: str = "rows") -> DataFrame:
        """docs, masked, with rid, written once. Numbers that are taken anew with each scan don't agree where the
        scan is split otherwise, as it is when executors come or go."""
        return self.save(masked(docs, rid=F.monotonically_increasing_id()), name)


def clean(spark: SparkSession, since: int = 0) -> None:
    """Deletes the workspaces made after the first `since`; what was returned from them must have been written."""
    while len(Workspace.made) > since:
        _delete(spark, Workspace.made.pop())


def sent_if_small(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of ids, marked for broadcast where its row count allows it; else Spark shuffles it."""
    return F.broadcast(ids) if ids.count() <= most else ids


def trim() -> None:
    """Gives freed memory back at the end of a task: workers idle between tasks, and more of them than run at once."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: str, most_bytes: int = 1_000_000):
    """Cuts record batches so that the named text column has about most_bytes a piece (a longer text comes alone)."""
    for batch in batches:
        col = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)
    trim()


def flow(spark: SparkSession, factor: int = 1) -> int:
    """Number of partitions to deal rows into, from the session's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * factor)


_HELD: dict = {}


def held(key, make):
    """make()'s result, kept by a Python worker for its next task under this key. A worker keeps one at a time:
    workers outlive their tasks, so what an earlier operator kept would stay beside what the next one needs."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Frees what an earlier operator's tasks kept in this worker."""
    _HELD.clear()


_U = np.uint64


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where those of each word begin (one more for the end)."""
    words = words.cast(pa.large_binary())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    ends = np.cumsum(size, dtype=np.int64)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1])


def _hashes(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word's bytes, of all words at once. Only says where to look: bytes decide."""
    size = np.diff(at)
    power = np.multiply.accumulate(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, _U))
    total = np.concatenate([[_U(0)], np.cumsum((flat.astype(_U) + _U(1)) * power[np.arange(len(flat)) - np.repeat(at[:-1], size)], dtype=_U)])
    h = (total[at[1:]] - total[at[:-1]]) ^ (size.astype(_U) << _U(40))
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    return h ^ (h >> _U(29))


class WordNumbers:
    """Numbers words in the order in which they come: an open-addressing table of numpy arrays, with the words' bytes
    beside it. Whole batches are looked up at once; a word is found where hash and bytes are equal."""

    def __init__(self):
        self.n, self.bits = 0, 16
        self.h, self.at = np.zeros(1 << 15, _U), np.zeros((1 << 15) + 1, np.int64)
        self.flat = np.zeros(1 << 18, np.uint8)
        self._fill()

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def _fill(self) -> None:
        """The table anew, from the hashes of all numbers."""
        self.table = np.full(1 << self.bits, -1, np.int32)
        self._put(np.arange(self.n))

    def _put(self, left: np.ndarray) -> None:
        place, last = self._place(self.h[left]), (1 << self.bits) - 1
        while len(left):
            free = self.table[place] < 0
            self.table[place[free]] = left[free]  # of several for one place the last one stays
            on = self.table[place] != left
            left, place = left[on], (place[on] + 1) & last

    def _same(self, number: np.ndarray, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words of these numbers have the bytes that begin at first in flat."""
        own = self.at[number]
        out = self.at[number + 1] - own == size
        k = np.flatnonzero(out & (size > 0))
        if len(k):
            differ = self.flat[ragged(own[k], size[k])] != flat[ragged(first[k], size[k])]
            out[k] = np.add.reduceat(differ, np.cumsum(size[k]) - size[k], dtype=np.int64) == 0
        return out

    def find(self, words: pa.Array) -> np.ndarray:
        """Numbers, -1 for new words."""
        flat, at = bytes_of(words)
        h, size = _hashes(flat, at), np.diff(at)
        place, last = self._place(h), (1 << self.bits) - 1
        out, live = np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(live):
            got = self.table[place[live]].astype(np.int64)
            live, got = live[got >= 0], got[got >= 0]
            hit = self.h[got] == h[live]
            hit[hit] = self._same(got[hit], flat, at[live[hit]], size[live[hit]])
            out[live[hit]] = got[hit]
            live = live[~hit]
            place[live] = (place[live] + 1) & last
        return out

    def add(self, words: pa.Array) -> None:
        """Words that aren't there yet, all different."""
        flat, at = bytes_of(words)
        m, used = self.n + len(words), int(self.at[self.n])
        while m > len(self.h):
            self.h = np.concatenate([self.h, np.zeros_like(self.h)])
            self.at = np.concatenate([self.at, np.zeros(len(self.h) + 1 - len(self.at), np.int64)])
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.h[self.n : m], self.at[self.n + 1 : m + 1] = _hashes(flat, at), used + at[1:]
        self.flat[used : used + len(flat)] = flat
        new, self.n = np.arange(self.n, m), m
        if 2 * m > 1 << self.bits:
            self.bits = (4 * m - 1).bit_length()
            self._fill()
        else:
            self._put(new)

    def keep(self, numbers: np.ndarray) -> None:
        """Only these (sorted) stay, numbered anew."""
        first, size = self.at[numbers], np.diff(self.at)[numbers]
        self.n, flat = len(numbers), self.flat[ragged(first, size)]
        self.h[: self.n] = self.h[numbers]
        self.at[1 : self.n + 1] = np.cumsum(size)
        self.flat[: len(flat)] = flat
        self._fill()


class WordCache:
    """Rows of numbers by word, for the words of whole batches: computed once a worker, looked up by numbers.

    Holds at most about `limit` words; beyond that the half needed least goes. `compute` takes a list of words
    and returns an array with a row for each.
    """

    def __init__(self, compute, limit: int = 400_000):
        self.compute, self.limit, self.numbers = compute, limit, WordNumbers()
        self.rows: np.ndarray | None = None
        self.used = np.zeros(0, np.int64)

    def most_used(self) -> np.ndarray:
        n = self.numbers.n
        best = np.argsort(-self.used[:n], kind="stable")[: self.limit // 2]
        return np.sort(best[self.used[best] > 1])

    def forget(self) -> None:
        best = self.most_used()
        self.numbers.keep(best)
        self.rows[: len(best)] = self.rows[best]
        self.used[: len(best)], self.used[len(best) :] = self.used[best] // 2, 0

    def learn(self, words: list[str]) -> None:
        """Rows of words that have just been numbered."""
        end = self.numbers.n
        new = self.compute(words)
        if self.rows is None:
            self.rows = np.zeros((max(1 << 15, len(words)), *new.shape[1:]), new.dtype)
            self.used = np.zeros(len(self.rows), np.int64)
        while end > len(self.rows):
            self.rows, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.used))
        self.rows[end - len(words) : end] = new

    def number(self, words: pa.Array, codes: np.ndarray) -> np.ndarray:
        """Of distinct words, which the codes refer to: their numbers; new ones are learned."""
        if self.numbers.n and self.numbers.n + len(words) > self.limit:
            self.forget()
        found = self.numbers.find(words)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self.numbers.n + np.arange(len(new))
            unseen = words.take(pa.array(new))
            self.numbers.add(unseen)
            self.learn(unseen.to_pylist())
        self.used[found] += np.bincount(codes, minlength=len(words))
        return found

    def of(self, texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of A-Z-lowered texts, cut at ASCII white space: the row of each word, where texts begin (one more for
        the end), the distinct words and each word's code among them."""
        texts = pc.fill_null(texts, "")
        codes, words, at = words_of(pc.ascii_lower(texts) if lower else texts)
        if not len(words):
            return self.compute([""])[:0], at, words, codes
        numbers = self.number(words, codes)
        return self.rows[numbers[codes]], at, words, codes


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space: codes, distinct words, and where each text's words begin (one more for the end)."""
    lists = pc.ascii_split_whitespace(texts)
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(at[0], at[-1] - at[0])
    at = at - at[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end leaves empty strings
        flat = flat.filter(pa.array(full))
        at = np.concatenate([[0], np.cumsum(full)])[at]
    words = flat.dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False), words.dictionary, at


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of consecutive values between the offsets."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def id_hash_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(n))
