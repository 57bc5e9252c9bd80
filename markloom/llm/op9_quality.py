"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Evidence. A logistic regression over hashed words and hashed word beginnings (present or not, letters and digits,
lower-cased) and shape features (capitals, symbols, digits, word length, repetition, length) is fitted on the
driver on at most about `SAMPLE` labelled documents, chosen by id hash. Words take part whose good share differs
from the base rate by a chi-square of `LEAST_CHI2`. It gives each document a probability of being good, at the
base rate of the sample.

Sites. A host's rate is the mean of its documents' probabilities, shrunk toward the global rate; a path's is
shrunk toward its host's. Shrinkage strengths (pseudo counts) come from the data by the method of moments: the
variance between sites against what documents within a site vary. Sites of few documents so stay near their
parents. All of it is grouped aggregation over all documents, combined map-side: a hot host sends a row per task.

Posterior. log-odds of the evidence + log-odds of the path's rate - log-odds of the base rate; a document is kept
where that is at least even. A site's rate leaves out nothing, the document itself included.

Good means quality 1 and not toxic (`GOOD`); unlabelled or null-quality rows teach nothing, of several labels of a
document the worst counts. Where only one kind of label is there, the evidence is its rate. Null text: empty. A
null host or path is a site of its own. A score of exactly one half is kept; a null id has no label and a score like any
other. A very long text is read alone, its words as numbers. Repeated rows each give a row. Extra columns are ignored (keep_good keeps
them); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import WORD_BYTES, WordCache, Workspace, held, masked, slices, sums, unmasked

SAMPLE = 12_000
#: Labels of a good document.
GOOD = "quality = 1 AND coalesce(toxic, 0) = 0"
BUCKETS = 1 << 18
BEGINNING, LEAST_CHI2 = 4, 15.0
SHAPES = 9
#: Site tables of at most so many rows are sent to every task.
SENT_SITES = 200_000


def _word_rows(words: list[str]) -> np.ndarray:
    """Per word: its bucket and that of its beginning; characters, capitals, symbols, digits, all capitals, ends in two symbols."""
    out = np.zeros((len(words), 8), np.float32)
    for i, w in enumerate(words):
        core = w.lower().encode().translate(WORD_BYTES).replace(b" ", b"")
        letters = sum(map(str.isalpha, w))
        capitals = sum(map(str.isupper, w))
        digits = sum(map(str.isdigit, w))
        symbols = len(w) - letters - digits
        begin = core.decode()[:BEGINNING].lower().encode()
        out[i] = (zlib.crc32(core) % BUCKETS, zlib.crc32(begin, 1) % BUCKETS, len(w), capitals, symbols, digits, letters > 1 and capitals == letters, symbols > 1 and not w[-1].isalnum())
    return out


def _cache() -> WordCache:
    return held("quality", lambda: WordCache(_word_rows, limit=400_000))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape features of each text; buckets of its distinct words and where each text's begin."""
    rows, at, names, codes = _cache().of(texts, lower=False)
    n = np.diff(at)
    s = sums(rows[:, 2:], at)
    owner = np.repeat(np.arange(len(n)), n)
    pairs = np.unique((owner * np.int64(BUCKETS))[:, None] + rows[:, :2].astype(np.int64))
    distinct = np.bincount(pairs // BUCKETS, minlength=len(n))
    again = np.zeros(len(codes))
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    words, chars = np.maximum(n, 1), np.maximum(s[:, 0], 1)
    shape = np.stack([np.log1p(n), s[:, 1] / chars, s[:, 2] / chars, s[:, 3] / chars, s[:, 4] / words, s[:, 5] / words, s[:, 0] / words / 10, distinct / words / 2, sums(again, at) / words], 1)
    return shape, pairs % BUCKETS, np.concatenate([[0], np.cumsum(distinct)])


def fit(shape: np.ndarray, bucket: np.ndarray, at: np.ndarray, good: np.ndarray, rounds: int = 300) -> dict:
    """Logistic regression by Adam over all rows at once."""
    rate = float(np.clip(good.mean(), 1e-3, 1 - 1e-3)) if len(good) else 0.5
    bias = float(np.log(rate / (1 - rate)))
    model = {"rate": rate, "mean": np.zeros(SHAPES), "scale": np.ones(SHAPES), "shape": np.zeros(SHAPES), "words": np.zeros(BUCKETS, np.float32), "bias": bias}
    if not len(good) or good.min() == good.max():
        return model
    model["mean"], model["scale"] = shape.mean(0), shape.std(0) + 1e-3
    x = np.clip((shape - model["mean"]) / model["scale"], -6, 6)
    owner = np.repeat(np.arange(len(good)), np.diff(at))
    n, hits = np.bincount(bucket, minlength=BUCKETS), np.bincount(bucket, good[owner], minlength=BUCKETS)
    telling = (n >= 3) & ((hits - n * rate) ** 2 >= LEAST_CHI2 * np.maximum(n, 1) * rate * (1 - rate))
    owner, bucket = owner[telling[bucket]], bucket[telling[bucket]]
    used, code = np.unique(bucket, return_inverse=True)
    w = np.zeros(SHAPES + 1 + len(used))
    w[SHAPES] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    decay = np.concatenate([np.full(SHAPES, 1e-4), [0], np.full(len(used), 1e-4)])
    for t in range(1, rounds + 1):
        z = x @ w[:SHAPES] + w[SHAPES] + np.bincount(owner, w[SHAPES + 1 :][code], minlength=len(good))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good) / len(good)
        g = np.concatenate([x.T @ err, [err.sum()], np.bincount(code, err[owner], minlength=len(used))]) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    model["shape"], model["bias"] = w[:SHAPES], float(w[SHAPES])
    model["words"][used] = w[SHAPES + 1 :]
    return model


def evidence(model: dict, shape: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = np.clip((shape - model["mean"]) / model["scale"], -6, 6)
    z = x @ model["shape"] + model["bias"] + sums(model["words"][bucket].astype(np.float64), at)
    return 1 / (1 + np.exp(-np.clip(z, -15, 15)))


def _collect_features(batches):
    for b in slices(batches, "text", 1_000_000):
        shape, bucket, at = features(b.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)))
        shapes = pa.ListArray.from_arrays(pa.array(np.arange(0, shape.size + 1, SHAPES, dtype=np.int32)), pa.array(shape.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("good"), shapes, lists], names=["good", "shape", "bucket"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    own = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
    own = own.groupBy("doc_id").agg(F.min(F.expr(GOOD).cast("int")).alias("good"))
    n = own.count()
    share = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    chosen = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)  # about `sample` rows: small enough to send
    rows = docs.join(F.broadcast(chosen), "doc_id").select("good", "text")
    got = rows.mapInArrow(_collect_features, "good int, shape array<double>, bucket array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return fit(np.zeros((0, SHAPES)), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0))
    shape = np.array(got["shape"].to_pylist())
    lists = got["bucket"].combine_chunks()
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return fit(shape, lists.flatten().to_numpy().astype(np.int64), at, got["good"].to_numpy().astype(np.float64))


def _score_batches(model):
    def run(batches):
        m = model.value
        for b in slices(batches, "text", 1_000_000):
            p = evidence(m, *features(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "evidence"])

    return run


def with_evidence(docs: DataFrame, model: dict) -> DataFrame:
    """docs with the column `evidence`; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score_batches(sent), f"{kinds}, evidence double")


def _strength(sites: DataFrame, prior: Column) -> float:
    """Pseudo counts of a Beta prior by moments: sites hold n documents of mean `rate` about a prior mean."""
    r = sites.agg(
        F.sum(F.col("n") * (F.col("rate") - prior) ** 2).alias("between"),
        F.sum(F.col("within")).alias("within"),
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("n") * prior * (1 - prior)).alias("most"),
    ).first()
    if not r["n"] or r["k"] < 2 or r["n"] <= r["k"]:
        return 1000.0
    noise = r["within"] / (r["n"] - r["k"])  # variance of one document within a site
    spread = max((r["between"] - r["k"] * noise) / r["n"], 1e-9)  # variance of the sites' own rates
    return float(np.clip(r["most"] / r["n"] / spread - 1, 2.0, 10_000.0))


def site_rates(scored: DataFrame) -> DataFrame:
    """evidence, host, path to host, path, host_rate, path_rate: shrunk rates of every site."""
    total = scored.agg(F.avg("evidence")).first()[0]
    mean = F.lit(0.5 if total is None else total)
    stats = [F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("q")]
    rate, within = F.col("s") / F.col("n"), F.greatest(F.col("q") - F.col("s") ** 2 / F.col("n"), F.lit(0.0))
    paths = scored.groupBy("host", "path").agg(*stats).withColumn("rate", rate).withColumn("within", within)
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).withColumn("rate", rate).withColumn("within", within)
    a = _strength(hosts, mean)
    hosts = hosts.select("host", ((a * mean + F.col("s")) / (a + F.col("n"))).alias("host_rate"))
    paths = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    b = _strength(paths, F.col("host_rate"))
    return paths.select("host", "path", "host_rate", ((b * F.col("host_rate") + F.col("s")) / (b + F.col("n"))).alias("path_rate"))


def posterior(scored: DataFrame, base: float, ws: Workspace) -> DataFrame:
    """scored (a saved table with evidence, host, path) with host_rate, path_rate, score and keep."""
    sites = ws.save(site_rates(scored), "sites")
    if sites.count() <= SENT_SITES:
        sites = F.broadcast(sites)
    sites = sites.withColumnsRenamed({"host": "h", "path": "p"})
    odds = lambda c: F.log(c / (1 - c))
    clip = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    z = odds(clip(F.col("evidence"))) + odds(clip(F.col("path_rate"))) - odds(clip(F.lit(base)))
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))).drop("h", "p")
    return out.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("keep", F.col("score") >= 0.5)


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score, keep."""
    ws = Workspace(docs.sparkSession, "quality")
    model = train(docs.select("doc_id", "text"), labels)
    rows = docs.select("doc_id", "text", host.alias("host"), path.alias("path"))
    scored = ws.save(with_evidence(rows, model).drop("text"), "scored")
    return posterior(scored, model["rate"], ws).select("doc_id", "evidence", "host_rate", "path_rate", "score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """The rows of docs that are kept, with all columns."""
    ws = Workspace(docs.sparkSession, "quality")
    model = train(docs.select("doc_id", "text"), labels)
    scored = ws.save(with_evidence(masked(docs, host=host, path=path), model), "scored")
    return unmasked(posterior(scored, model["rate"], ws).filter("keep"), docs.columns)


def sites_of_documents() -> tuple[Column, Column]:
    """Of the documents table: the source is the host, its section in one language the path."""
    return F.col("source"), F.concat_ws("/", "source", "lang")
