"""Corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a frame; all but the last
return the columns of ``documents``, whatever else these hold.

Defined cases: rows with a null, empty or very short text are rejected by the quality rules; rows with a null id stay
until they are packed, but name no group and are no source of passages; equal rows of id and text are one, rows of one
id with different texts are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nullweave.llm.decontaminate import drop_contaminated
from nullweave.llm.engine import table
from nullweave.llm.jaccard_join import component_heads
from nullweave.llm.packing import pack_documents
from nullweave.llm.quality_rules import keep_quality
from nullweave.llm.queries import read, tokenizer_path
from nullweave.llm.substring_dedup import remove_repeats

#: Near duplicates share this part of their shingles of so many words; the op5 query keeps values of its own.
NEAR_WORDS, NEAR_SHARE = 5, Fraction(4, 5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition and symbol rules reject go."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays (of one id's texts, that of the smallest
    hash), of equal rows of id and text one.  Rows of one id with different texts are judged each by its own component.
    Rows without id stay."""
    heads = component_heads(docs, NEAR_WORDS, NEAR_SHARE).toDF("doc_id", "text_hash")
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    named = keyed.join(heads, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(*docs.columns)
    return named.union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller document has go; a document that loses all its words goes.  ``n_chars``, where the
    table has it, is that of the text that stays."""
    out = remove_repeats(docs).where("dedup_removed = 0 or dedup_removed < dedup_words")
    cut = F.col("dedup_removed") > 0
    out = out.withColumn("text", F.when(cut, F.col("dedup_text")).otherwise(F.col("text")))
    if "n_chars" not in docs.columns:
        return out.select(*docs.columns)
    return out.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or within the error budget, go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all kept documents, placed in sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("benchmark decontamination", benchmark_leaks), ("best-fit packing", packing)]

#: The stages hash, tokenise and solve; SQL cannot express them.  They are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs, f"stage{k}")
    return docs
