"""A corpus pipeline of five of the llm operators, each stage written as Parquet before the next reads it.

quality      documents that the quality classifier rejects go
near_copies  of each group of near-duplicates the document of the smallest doc_id stays; texts are linked by a Jaccard
             similarity of 0.8 or more of their sets of five-word shingles; candidates are the components of
             fingerprints of 128 bits within 30 bits (a similarity of 0.8 is some 19 bits)
repeats      bytes of passages that occur more than once are cut out of the texts (documents stay)
benchmarks   documents that hold a benchmark window go
packing      the rest is tokenised and packed into sequences

All but the last return the columns of documents, whatever else those hold; n_chars follows the text. Null texts count as
empty and stay null; rows with null ids are rows like others, and of repeated rows near_copies keeps one. Rows that no
label is known of are judged by what others teach, and with no labels at all every row is kept. Empty tables give empty
results, an empty benchmark leaves all. No stage is SQL's to express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm import op2_decontaminate, op4_suffix, op5_simhash, op7_pack, op9_quality
from markloom.llm.common import Workspace, clean, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_quality.keep_good(docs, table(spark, sf_dir, "labels"), *op9_quality.sites_of_documents())


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_simhash.keep_one(docs, least=0.8, shingle=5, words=2, segments=8, most=30, radius=1)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = op4_suffix.remove_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_pack.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("benchmarks", benchmarks),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        since = len(Workspace.made)
        docs = ws.save(stage(spark, docs, sf_dir), name)
        clean(spark, since)  # what the stage wrote on its way
        if i:
            ws.drop(STAGES[i - 1][0])
    return docs
