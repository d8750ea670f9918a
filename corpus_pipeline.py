"""The corpus pipeline: five stages, each one operator over all that the stage before it kept.

``STAGES`` lists (name, function of (spark, docs, sf_dir)); each result is written as Parquet and read as the next stage's
documents. All but the last return the columns of ``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, line_dedup, minhash_dedup, packing, quality
from tessella.llm.common import Scratch, read
from tessella.llm.queries import tokenizer_path


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws for the labelled good ones, as many as hold 99.5 % of these; what it rejects goes."""
    labels = read(spark, sf_dir, "labels")
    drawn = quality.resample(docs, quality.good_ids(labels), bad_ids=quality.bad_ids(labels))
    return drawn.where("kept").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least three documents share; the largest id keeps them. No document goes."""
    out = line_dedup.dedup_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group at Jaccard 0.8 or more on five-word shingles."""
    return minhash_dedup.near_duplicates(docs).where("kept").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten benchmark words; the others go."""
    found = decontam.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_spans") == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", select_quality),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor MinHash and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
        scratch.drop_all_but(docs)
    out = STAGES[-1][1](spark, docs, sf_dir)
    scratch.drop_all_but()  # packing reads the pieces that it has written, not the documents
    return out
