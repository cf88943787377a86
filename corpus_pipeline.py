"""The corpus pipeline: documents of low quality, of no clear language, near duplicates and contaminated ones go; the rest is tokenized.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. run()
writes each stage's result to the shared folder as Parquet and reads it again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnworks.llm import bpe, decontam, langid, ngram_join, quality
from tarnworks.session import stash, unstash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is at least 0.5."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, name="__score").where("__score >= 0.5").drop("__score")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a letter and whose likeliest language has a score of at least 0.5."""
    model = langid.fit(docs)
    return langid.identify(docs, model, names=("__lang", "__score")).where("__lang <> 'und' AND __score >= 0.5").drop("__lang", "__score")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the smallest doc_id (null ids last), then of the least key.

    Rows are told apart by a key of doc_id and text, so rows of equal or null ids but unlike texts don't take each other's
    place; of rows equal in both, one stays. Documents without a word are linked with nothing and stay.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    groups = ngram_join.ngram_jaccard_components(keyed, doc_id="__key").where("n_shingles > 0").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    members = keyed.select("__key", "doc_id").join(groups, "__key")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("x")).select("x.__key")
    kept = keyed.join(first, "__key", "left_semi").dropDuplicates(["__key"])
    return kept.select(*docs.columns).unionByName(docs.where("NOT coalesce(text, '') RLIKE '[^\\x20\\x09-\\x0D]'"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't contaminated by the benchmark."""
    checked = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return checked.where("NOT contaminated").select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids, and decodes: whether the ids decode to the text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=None, decodes="decodes")


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: SQL can't express the trained stages; a test compares each stage with a brute-force version of its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            unstash(before)
        before = docs
    return docs
