"""Document fingerprints: canonical exact digests, native Spark expressions only.

Canonical form: NFC (ICU, through a static JVM method), full case folding, NFC again, runs of white space to one
blank, trimmed. Digest: two 64-bit xxhashes of it with different seeds, as 32 hex digits. `exact_groups` groups
by the digest and compares the bytes inside equal buckets by keeping the canonical text in the grouping key, so
two texts of equal digests but different bytes never share a group.

Null text: empty. `with_next` orders by doc_id (null comes first), then by the text's hash, then by the text, so rows of
one id have a defined order too; equal rows follow each other in any order, which shows nowhere. Repeated rows stay. A
very long text is a value of its own row throughout, held by one task at a time. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import Workspace, flow, sent_if_small

_ICU, _CHARS = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"
#: White space and separators of Unicode that Java's \s leaves out.
_BLANKS = r"[\s\x{85}\p{Z}]+"
#: Texts of printable ASCII only, already NFC: folding is lower-casing.
_PLAIN = r"^[\x00-\x7F]*$"


def canonical(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    yes, no = F.lit(True), F.lit(False)
    nfc = lambda c: F.reflect(F.lit(_ICU), F.lit("compose"), c, no)
    folded = nfc(F.reflect(F.lit(_CHARS), F.lit("foldCase"), nfc(text), yes))
    folded = F.when(text.rlike(_PLAIN), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(folded, _BLANKS, " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hex digits: XXH64 of the text with two seeds (the second one is the hash of a salt)."""
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit("second half"), canon)))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per group of two or more canonically equal texts: fingerprint, told_apart, group_id (smallest
    doc_id), n_copies.

    Digests that occur once are alone and send no text. Texts of the others are compared as bytes, in the
    grouping key. Copies collapse in the map-side part of the aggregation, so a group that holds a third of all
    rows sends a row per task.
    """
    ws = Workspace(docs.sparkSession, "digests")
    canon = docs.select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    counts = canon.select("fingerprint").groupBy("fingerprint").count()
    again = ws.save(counts.filter("count > 1").select("fingerprint"), "again")
    canon = canon.join(sent_if_small(again), "fingerprint", "left_semi")
    groups = canon.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies"))
    return groups.select("fingerprint", _told_apart(F.col("canon")).alias("told_apart"), "group_id", "n_copies")


def _told_apart(canon: Column) -> Column:
    """Another digest, to join rows with the group of their bytes without sending the bytes again."""
    return F.sha2(F.encode(canon, "UTF-8"), 256)


def _order(text: Column) -> Column:
    """A number from 0 to 2**63 - 1 by hash, after which texts of one id are ordered."""
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text and next_text: the text of the next document by doc_id; after the last comes the first.

    Ids are cut into ranges at their quantiles; a window runs in each range. An id (or null) that holds several ranges'
    worth of rows is cut further, by the hash of the text. The first document of a range is also sent, as a ghost, to
    the end of the range before: so texts are shuffled once, and no task sees all.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = buckets or flow(spark, 8)
    quantiles = F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets) if buckets > 1 else F.array().cast("array<bigint>")
    seen = docs.agg(quantiles.alias("cuts"), F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    cuts = sorted(c for c in seen["cuts"] or [] if c is not None)
    null_ranges = max(1, -(-(seen["n"] - seen["ids"]) * buckets // max(seen["n"], 1)))
    cut_array = F.array(*[F.lit(c).cast("long") for c in cuts])
    order = _order(F.col("text"))
    part = lambda n: F.least(F.floor(order / F.lit(2.0**63) * n).cast("int"), n - 1)
    # the number of cuts at or below doc_id, and below it, by halving a sorted literal
    up_to, below = (_count_cuts(cut_array, len(cuts), F.col("doc_id"), itself) for itself in (True, False))
    placed = docs.withColumn("up_to", up_to).withColumn("own", F.col("up_to") - below)
    bucket = F.when(F.col("own") > 1, F.col("up_to") - F.col("own") + 1 + part(F.col("own"))).otherwise(F.col("up_to"))
    placed = placed.withColumn("bucket", F.when(F.col("doc_id").isNull(), part(F.lit(null_ranges)) - null_ranges).otherwise(bucket))
    placed = placed.select("doc_id", "text", "bucket")
    # a row per range, as many as there are cuts: a fixed number, whatever the size of the input
    first = placed.groupBy("bucket").agg(F.min(F.struct("doc_id", order.alias("o"), "text")).alias("f"))
    first = first.select("bucket", "f.doc_id", F.sha2(F.encode("f.text", "UTF-8"), 256).alias("h"))
    starts = {r["bucket"]: (r["doc_id"], r["h"]) for r in first.collect()}
    order_of = sorted(starts)
    ghosts = [(b, order_of[i - 1], *starts[b]) for i, b in enumerate(order_of)]
    firsts = F.broadcast(spark.createDataFrame(ghosts, "bucket int, before int, f_id long, f_h string"))
    is_first = F.when(F.col("f_id").eqNullSafe(F.col("doc_id")), F.col("f_h") == F.sha2(F.encode("text", "UTF-8"), 256)).otherwise(F.lit(False))
    sent = placed.join(firsts, "bucket", "left").withColumn("is_first", is_first)
    own = F.struct(F.col("bucket").alias("at"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.col("before").alias("at"), F.lit(1).alias("ghost"))
    sent = sent.withColumn("to", F.explode(F.when(F.col("is_first"), F.array(own, ghost)).otherwise(F.array(own))))
    sent = sent.select("doc_id", "text", F.col("to.at").alias("at"), F.col("to.ghost").alias("ghost"))
    w = Window.partitionBy("at").orderBy("ghost", F.asc_nulls_first("doc_id"), order, "text")
    led = sent.withColumn("next_text", F.lead("text").over(w)).filter("ghost = 0")
    return led.select("doc_id", "text", "next_text")


def _count_cuts(cuts: Column, n: int, x: Column, itself: bool) -> Column:
    """How many of the n sorted cuts are below x, or x itself: a search by halving, as a fold over the step widths."""
    if n == 0:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])

    def widen(found: Column, step: Column) -> Column:
        cut = F.get(cuts, found + step - 1)
        return F.when((found + step <= n) & (cut <= x if itself else cut < x), found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), widen)


def likeness(one: Column, two: Column, canon_one: Column, canon_two: Column) -> Column:
    """1 for equal digests whose canonical bytes are equal too, else 0: an exact digest knows nothing between."""
    return F.when((one == two) & (canon_one == canon_two), 1.0).otherwise(0.0)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts and of their edited forms (the last quarter replaced by the next document's start),
    with the id and size of the group of canonically equal texts."""
    n = F.length("text")
    keep, k = n - F.floor(n / 4).cast("int"), F.floor(n / 4).cast("int")
    rows = with_next(docs).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), keep), F.substring("next_text", F.lit(1), k)))
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("canon"),
        canonical(F.col("edited")).alias("canon_edited"),
        canonical(F.col("next_text")).alias("canon_next"),
    )
    a, b, c = digest(F.col("canon")), digest(F.col("canon_edited")), digest(F.col("canon_next"))
    rows = rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _told_apart(F.col("canon")).alias("told_apart"),
        a.alias("fingerprint"),
        b.alias("edited_fingerprint"),
        likeness(a, b, F.col("canon"), F.col("canon_edited")).alias("near_edited"),
        likeness(a, c, F.col("canon"), F.col("canon_next")).alias("near_next"),
    )
    rows = rows.join(exact_groups(docs), ["fingerprint", "told_apart"], "left").drop("told_apart")
    return rows.withColumn("group_id", F.coalesce("group_id", "doc_id")).withColumn("n_copies", F.coalesce("n_copies", F.lit(1).cast("long")))
