"""A cleaning pipeline over ``documents``: toxicity, n-gram Jaccard join, suffix-array dedup, packing.

Each stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import ngram_join, packing, suffix, toxicity
from keyloom.llm.common import owned, release, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """``f`` as a stage: what the stage before left is deleted, since its result has been written; nobody else's tables are."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release("pipeline")
        with owned("pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The lexicon is learned from the labels that aren't held out."""
    lexicon = toxicity.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, lexicon)


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.8 join, that with the smallest doc_id stays."""
    found = ngram_join.ngram_join(docs, counted=False).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["kept_id"]), "left_semi")


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under 100-byte strings that start earlier too are cut; what a cut leaves of a character goes with it."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = suffix.dedup_suffixes(docs, carried=rest)
    out = out.withColumn("text", F.when(F.is_valid_utf8(F.col("kept").cast("string")), F.col("kept").cast("string")).otherwise(F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("�"), F.lit(""))))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of at most 2048 tokens."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    p = packing.pack(docs, lambda: packing.tokenizer(path, pattern).encode, end_id=1, window=2048)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("ngram_join", one_of_each_group), ("suffix_dedup", cut_repeats), ("packing", pack)]
#: No stage can be put into SQL: learned lexicon, transitive links, suffix order, byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}", scratch=False)
    return docs
