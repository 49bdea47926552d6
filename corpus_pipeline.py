"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of their input, whatever these are; the last returns the pieces
of packed sequences. Each stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm import exact_dedup, minhash, mixing, packing, quality
from landloom.llm.common import materialise, table

#: The mixture leaves clean documents as they are and holds down the others.
WEIGHTS = {"clean": 0.93, "low": 0.05, "toxic": 0.02}


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose id is in dropped (column doc_id); rows with a null id stay."""
    gone = materialise(dropped.select(F.col("doc_id").alias("_gone")).distinct(), "dropped")
    return docs.join(gone, docs.doc_id == gone["_gone"], "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for low quality go."""
    scores = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    return without(docs, scores.filter("predicted = 0"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that of the smallest id."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, that of the smallest id."""
    return without(docs, minhash.near_duplicates(docs, k=5, num=80, den=100).filter("NOT kept"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at their rates; rates don't exceed 1, so none is repeated."""
    rates = mixing.draw(mixing.mixing_rates(docs, mixing.label_domains(table(spark, sf_dir, "labels")), WEIGHTS, "clean"))
    return without(docs, rates.filter("copies = 0"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences: doc_id, start, ids, doc_tokens, sequence_id, offset."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Classifier, similarity and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
