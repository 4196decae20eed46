"""Toxicity of documents by a factorization machine over hashed terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.llm.factorization import FactorizationMachine

#: Terms are hashed to so many numbers.
SIZE = 1 << 18
#: Labelled documents that the model is fitted on at most: those whose ids have the least hashes.
SAMPLE = 20_000


def term_set(text: Column, size: int = SIZE, stems: tuple[int, ...] = (4, 5, 7)) -> Column:
    """The distinct hashed terms of a whole text: runs of letters in lower case, and the first letters
    of the longer ones, so that inflected and compound forms share a term. None for a null text."""
    runs = F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+"), ""))

    def terms(w: Column) -> Column:
        whole = F.xxhash64(w)
        # a run no longer than the stem names the run itself again
        heads = [F.when(F.length(w) > n, F.xxhash64(F.lit(n), F.substring(w, 1, n))).otherwise(whole) for n in stems]
        return F.transform(F.array(whole, *heads), lambda h: F.pmod(h, F.lit(size)).cast("int"))

    return F.array_distinct(F.flatten(F.transform(runs, terms)))


def remainder(id_: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, factors: int = 4) -> FactorizationMachine:
    """A model of label_col from the rows of labels outside fold 0, `sample` documents at most.

    Several labels of one id count as their maximum; rows with a null id or label teach nothing. With
    no labels at all every score is 1/2 or less.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("double").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # sample rows of two numbers at most, whatever the tables' size; ids may repeat in docs, so the bound holds again
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = plain.select("_id", "_y", F.xxhash64("_text").alias("_h"), term_set(F.col("_text")).alias("_terms"))
    got = rows.orderBy(F.xxhash64("_id"), "_id", "_h").limit(sample).select("_id", "_y", "_terms").toArrow()
    lists = got["_terms"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return FactorizationMachine(SIZE, factors).fit(terms, lengths, got["_y"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs. Texts without terms, null ones included, get the bias alone."""
    spark = docs.sparkSession
    live = np.flatnonzero((model.linear != 0) | (np.abs(model.pairs) > 0).any(1))
    packed = spark.sparkContext.broadcast((live.astype(np.int32), model.linear[live], model.pairs[live], model.bias))

    @F.arrow_udf("double")
    def judge(lists: pa.Array) -> pa.Array:
        live, linear, pairs, bias = packed.value
        fm = FactorizationMachine(0)
        fm.bias, fm.linear, fm.pairs = bias, np.append(linear, 0), np.vstack([pairs, np.zeros((1, pairs.shape[1]))])
        terms = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(live, terms)
        known = (at < len(live)) & (live[np.minimum(at, len(live) - 1)] == terms) if len(live) else np.zeros(len(terms), bool)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)[known]
        m = fm.margins(at[known], np.bincount(owner, minlength=len(lengths)))
        return pa.array(1 / (1 + np.exp(-np.clip(m, -500, 500))))

    plain = docs.select(F.col(id_col).alias("id"), term_set(F.col(text_col)).alias("_terms"))
    return plain.select("id", judge("_terms").alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted): fit() and score() over all rows of docs. Only texts are
    inputs of a score; repeated rows get the same; extra columns are not read; an empty table gives
    an empty one."""
    scored = score(docs, fit(docs, labels, id_col, text_col, label_col, sample), id_col, text_col)
    return scored.select("id", (remainder(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
