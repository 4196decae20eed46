"""A training corpus from `documents`, in five stages; each works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. What a stage returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.llm import bpe, linededup, mixing, neardup, quality
from symlattice.llm.queries import digests, table
from symlattice.staging import cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    return quality.accept(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat an earlier one; n_chars follows the text."""
    done = linededup.dedup_lines(docs).select(docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: links are similarities of 0.8 or more on shingles of five words."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, a document of several epochs as several rows."""
    return mixing.take(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's number of token ids and the digests of the ids and of the bytes they stand for."""
    return digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", keep_one_of_each_group),
    ("source mixing", mix_sources),
    ("byte-level bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES, one after the other, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: SQL has no merges by rank, no fitted classifier and no components; tests/llm hold the stages against brute force.
ORACLE_SQL = None
