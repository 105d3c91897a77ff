"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and all rows that the one before it kept.  The first four return the columns of
documents, whatever other columns there are and whatever their names; the last returns pieces of sequences.  Cases: a null
or empty text passes the filters by its score and is packed as the end token alone; a null id is kept by the near-duplicate
stage, which of rows with one id keeps one (that whose text's hash is the smallest); ties, very long texts and empty tables
are treated as each operator's docstring says, and an empty table gives no pieces.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import near_dedup, packing, quality_classifier, substring_dedup, toxicity
from skirmish.llm.common import stored, table

#: Similarity from which, and word shingles over which, documents count as near-duplicates.
PERCENT, SHINGLE = 80, 5


def _aside(docs: DataFrame) -> DataFrame:
    """docs with its other columns under names that no operator makes."""
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")))


def _back(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names and in their order."""
    return made.select(*(c if c in ("doc_id", "text") else F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier takes for good."""
    return _back(quality_classifier.score(_aside(docs), quality_classifier.learn(docs)).where("good"), docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that aren't predicted toxic; labels come from the training fold of the labels table."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _back(toxicity.score(_aside(docs), model).where("predicted = 0"), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that with the smallest id."""
    found = near_dedup.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT)
    gone = found.where("NOT kept").select("doc_id").distinct()
    left = _aside(docs).join(gone, "doc_id", "left_anti")
    many = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    twins = left.join(many, "doc_id", "left_semi")
    one = twins.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), *(c for c in left.columns if c != "doc_id"))).alias("r"))
    alone = left.join(many, "doc_id", "left_anti")
    return _back(alone.unionByName(one.select("doc_id", "r.*").drop("h")), docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the passages that a document with a smaller id has too; other texts stay as they are."""
    cut = substring_dedup.deduplicate(_aside(docs))
    out = _back(cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages hold a learnt classifier and a tokenizer, which SQL can't express; tests hold run() against plain Python.
ORACLE_SQL = None
