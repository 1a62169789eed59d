"""A corpus pipeline of the text operators: each stage is written as Parquet and read again as the next one's input.

1. language ID: documents without an identified language, or in one that the labelled documents do not hold, go;
2. near-dedup: of each group of documents linked by a similarity of five-word shingles of 0.8 or more the one with the
   least id stays; op6's operator does that by fingerprints and pivot tables, then by an exact search for the links that these
   cannot show (see llm/simhash.py);
3. benchmark decontamination: documents that hold a passage of the benchmark go;
4. PII: personal data is replaced by its kind in brackets;
5. BPE: the texts are encoded and decoded.

All stages but the last return the columns of documents. Rows without an id belong to no group and stay at stage 2; rows
that repeat an id stay or go together.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, common, decontaminate, language, pii, simhash

#: Least score of a language that stage 1 accepts.
LEAST_SCORE = 0.2
#: Words of a shingle, bits between fingerprints that the pivot tables try, and similarity of near copies in stage 2.
WORDS, DISTANCE, SIMILARITY = 5, 4, Fraction(4, 5)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs.filter(language.training_rows(docs)))
    return language.keep_identified(docs, model, LEAST_SCORE)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash.group(docs, words_of=WORDS, distance=DISTANCE, similarity=SIMILARITY)
    kept = groups.groupBy("component_id").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    stays = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").select(docs.columns)
    return stays.union(docs.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_only(docs, common.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, bpe.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]
#: SQL cannot express the trained and alignment stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
