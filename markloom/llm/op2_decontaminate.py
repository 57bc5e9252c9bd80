"""Benchmark decontamination with DataFrame functions only: no Python on the executors.

Texts are lower-cased (A-Z) and cut into words. A benchmark item gives its windows of `n` consecutive words (an
item of fewer words is one window).

1. Probing. The windows' 64-bit hashes are a broadcast hash set where their number allows it, and a shuffled join (which
   Spark can split where a window is frequent) where it does not. Words are hashed once; a window's hash is made from
   its words' hashes, so no strings are built for the windows that hit nothing. A document's words are dealt in chunks
   of `CHUNK` words (overlapping by n - 1), which bounds what one row holds while windows are made.
2. Verification. The documents with hits are read once more; the words at the hits are compared with the windows
   themselves, which are broadcast only where their measured bytes, lists of items included, allow it.
3. The verified places of a document are merged into spans.

The steps know a document by its id and the SHA-256 of its text, which no lost executor and no other split of the scan
can change; rows with equal ids and texts have equal results.

Null or empty texts have no words and no hits. Repeated rows each give a row, null ids too. An item with a null id marks
words but isn't listed. Extra columns are ignored; an empty benchmark leaves every document clean; empty documents give
an empty result. A very long text is cut into chunks once; its words are one array in the task that reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import Workspace, ascii_lower, masked, sent_if_small, unmasked

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK = 4096
#: Windows of the benchmark, with their items, are broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def text_key(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def _gram(w: Column, i: Column, k: Column | int) -> Column:
    """Words i to i+k-1: single element accesses, as slice() copies the whole array each time."""
    return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(k) - 1), lambda j: F.get(w, i + j)))


def _hashes(w: Column, k: int) -> Column:
    """The hash of each window of k words, from hashes of the words."""
    one = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), one)).otherwise(F.array().cast("array<bigint>"))


def _word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def windows(items: DataFrame, n: int) -> DataFrame:
    """gram, len, h (its hash), items (distinct ids): one row for each distinct window."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.select("item_id", "w", _word_hashes(F.col("w")).alias("wh"), F.least(F.size("w"), F.lit(n)).alias("len"))

    def one(i: Column) -> Column:
        h = F.coalesce(*[F.when(F.col("len") == k, F.xxhash64(*[F.get("wh", i + j) for j in range(k)])) for k in range(1, n + 1)])
        return F.struct(_gram(F.col("w"), i, F.col("len")).alias("gram"), F.col("len").alias("len"), h.alias("h"))

    every = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")), one)
    w = w.select("item_id", F.explode(every).alias("g")).select("item_id", "g.*")
    return w.groupBy("gram", "len", "h").agg(F.collect_set("item_id").alias("items"))


def _light(rows: DataFrame, lists: Column, most: int = 1_000_000) -> DataFrame:
    """A written table, marked for broadcast where its rows and what is in their lists are few."""
    return F.broadcast(rows) if (rows.agg(F.sum(lists + 4)).first()[0] or 0) <= most else rows


def _probe(at: Column, k: int):
    return lambda h, i: F.struct((at + i).alias("pos"), F.lit(k).alias("len"), h.alias("h"))


def probed(docs: DataFrame, hashes: DataFrame, lengths: list[int]) -> DataFrame:
    """Per row of docs: doc_id, key, n_words, places (struct<pos,len,h>: the windows whose hashes are those of items)."""
    overlap = max(lengths, default=1) - 1
    w = docs.select("doc_id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("w"))
    w = w.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "key", F.size("w").alias("n_words"), _word_hashes(F.col("w")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(CHUNK))
    parts = F.when(F.col("n_words") <= CHUNK, F.array("w")).otherwise(F.transform(starts, lambda s: F.slice("w", s + 1, F.lit(CHUNK + overlap))))
    w = w.select("rid", "doc_id", "key", "n_words", F.posexplode(parts).alias("at", "part"))
    at = F.col("at") * CHUNK
    found = [F.transform(_hashes(F.col("part"), k), _probe(at, k)) for k in lengths]
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("h")))  # so that each row is there
    probes = w.select("rid", "doc_id", "key", "n_words", F.explode(F.concat(own, *found)).alias("g")).select("rid", "doc_id", "key", "n_words", "g.*")
    hits = probes.join(hashes.withColumn("hit", F.lit(True)), "h", "left").filter(F.col("hit") | (F.col("pos") < 0))
    place = F.when(F.col("pos") >= 0, F.struct("pos", "len"))
    # one scan and one job: row ids mean the same all through
    per = hits.groupBy("rid").agg(*[F.max(c).alias(c) for c in ("doc_id", "key", "n_words")], F.collect_set(place).alias("places"))
    return per.drop("rid")


def find_leaks(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Per row of docs: doc_id, key, n_words, spans array<struct<start,stop>> (merged, in words), items (distinct ids)."""
    ws = Workspace(docs.sparkSession, "leaks")
    grams = ws.save(windows(items, n), "grams")
    size = grams.agg(F.sum(F.octet_length("gram") + 24 * F.size("items")).alias("b"), F.collect_set("len").alias("l")).first()
    lengths = sorted(size["l"])  # n values at most
    if (size["b"] or 0) <= BROADCAST_BYTES:
        grams = F.broadcast(grams)
    hashes = ws.save(grams.select("h").distinct(), "hashes")
    places = ws.save(probed(docs, sent_if_small(hashes), lengths), "places")
    hit = places.filter(F.size("places") > 0).select(F.col("doc_id").alias("id"), "key", "places").dropDuplicates(["id", "key"])
    hit = _light(ws.save(hit, "hit"), F.size("places"))
    again = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").withColumnRenamed("key", "k")
    again = again.join(hit, (F.col("k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    again = again.select("doc_id", "key", "places", words(F.col("text")).alias("w"))
    shown = F.transform("places", lambda p: F.struct(p["pos"].alias("pos"), p["len"].alias("len"), _gram(F.col("w"), p["pos"], p["len"]).alias("gram")))
    # asking for the size too keeps the words a column of their own: merged into the lambda they would be cut again for each place
    again = again.select("doc_id", "key", F.explode(F.when(F.size("w") > 0, shown)).alias("g")).select("doc_id", "key", "g.*").join(grams, ["gram", "len"])
    place = F.struct("pos", (F.col("pos") + F.col("len")).alias("end"))
    found = again.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(
        F.array_sort(F.collect_set(place)).alias("places"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    found = _light(ws.save(found.select("id", "k", _merged(F.col("places")).alias("spans"), "items"), "found"), F.size("spans") + F.size("items"))
    ws.drop("hit", "hashes")
    rows = places.drop("places").join(found, (F.col("k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>"))
    return rows.select("doc_id", "key", "n_words", spans.alias("spans"), F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"))


def _merged(places: Column) -> Column:
    """Sorted places to maximal spans."""
    kind = "array<struct<start:int,stop:int>>"

    def add(spans: Column, p: Column) -> Column:
        last = F.element_at(spans, -1)
        grown = F.concat(
            F.slice(spans, F.lit(1), F.size(spans) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], p["end"]).alias("stop"))),
        )
        new = F.concat(spans, F.array(F.struct(p["pos"].alias("start"), p["end"].alias("stop"))))
        return F.when((F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["stop"] >= p["pos"]), grown).otherwise(new)

    return F.aggregate(places, F.array().cast(kind), add)


def report(leaks: DataFrame) -> DataFrame:
    """The contract's columns."""
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return leaks.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(ids, "UTF-8"), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


def _with_leaks(docs: DataFrame, leaks: DataFrame, how: str) -> DataFrame:
    """docs, masked, joined with leaks by id and text."""
    rows = masked(docs, k=text_key(F.col("text")))
    own = leaks.withColumnRenamed("doc_id", "id").dropDuplicates(["id", "key"])
    return rows.join(own, (F.col("k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), how)


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Document mode: rows of docs without any hit, with all their columns."""
    ws = Workspace(docs.sparkSession, "leaked")
    leaked = ws.save(find_leaks(docs, items, n).filter(F.size("spans") > 0).select("doc_id", "key"), "leaked")
    return unmasked(_with_leaks(docs, sent_if_small(leaked), "left_anti"), docs.columns)


def blank_spans(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Span mode: texts where something was hit become the words left, joined by blanks; the others are unchanged."""
    ws = Workspace(docs.sparkSession, "leaked")
    leaked = ws.save(find_leaks(docs, items, n).filter(F.size("spans") > 0).select("doc_id", "key", "spans"), "leaked")
    rows = _with_leaks(docs, leaked, "left")
    # the words that no span covers: those between the end of one span and the start of the next
    rows = rows.withColumn("w", words(F.col("text"))).withColumn("n", F.size("w"))
    w, n_words = F.col("w"), F.col("n")
    stops = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["stop"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(n_words))
    left = F.concat_ws(" ", F.flatten(F.zip_with(stops, starts, lambda a, b: F.slice(w, a + 1, F.greatest(b - a, F.lit(0))))))
    rows = rows.withColumn("text", F.when(F.size("spans") > 0, left).otherwise(F.col("text")))
    return unmasked(rows, docs.columns)
