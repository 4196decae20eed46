"""What the two vector operators share: valid vectors, classes of equal ones, shards as rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two that a band of magnitudes spans.
BAND = 32
#: Tasks that heavy groups are dealt to at most.
MOST_TASKS = 20_000


def valid(vector: Column) -> Column:
    """True for a vector that is no null, holds no null or non-finite component, and is not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def canonical(vector: Column) -> Column:
    """The vector as doubles, with 0 for -0, so that equal vectors are equal keys."""
    return F.transform(vector.cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))


def matrix(lists: pa.ListArray | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """The rows at length 1, in double precision. Rows are brought to a largest component near 1 first, so
    that no finite row's squares overflow or vanish."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return x / np.sqrt((x**2).sum(1))[:, None]


def euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows in double precision, whatever finite numbers they hold. inf where the distance
    itself is beyond the largest double."""
    half = a / 2 - b / 2
    power = np.frexp(np.abs(half).max(1, initial=0))[1]
    near = np.abs(power) < 400
    out = np.empty(len(a))
    out[near] = np.sqrt(((a[near] - b[near]) ** 2).sum(1))
    far = ~near
    if far.any():
        # halves that lose bits at the very bottom are taken whole
        diff = np.where(power[far][:, None] < 0, a[far] - b[far], half[far])
        shift = np.where(power[far] < 0, 0, 1)
        scale = np.frexp(np.abs(diff).max(1, initial=0))[1]
        with np.errstate(over="ignore"):
            out[far] = np.ldexp(np.sqrt((np.ldexp(diff, -scale[:, None]) ** 2).sum(1)), scale + shift)
    return out


def magnitude_band(vector: Column) -> Column:
    """A number for vectors whose largest component lies within the same 32 powers of two; 0 holds 1."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    return F.floor((F.log2(most) + BAND / 2) / BAND).cast("int")


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by the keys to several times as many tasks as `rows`, the number of its groups: few heavy groups
    seldom meet in a task, and Spark does not merge the tasks by their bytes."""
    return df.repartition(max(1, min(4 * rows, MOST_TASKS)), *keys)


def shard_counts(df: DataFrame, groups: list[str], rows: int) -> DataFrame:
    """(groups..., shards): how many shards of about `rows` rows each group needs."""
    return df.groupBy(*groups).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("shards"))


def salted(df: DataFrame, groups: list[str], key: str, rows: int, seed: int) -> DataFrame:
    """df with shard: a number below its group's shards, by the hash of the key. Groups are few or small:
    their counts are joined by Spark's own choice of strategy."""
    counts = shard_counts(df, groups, rows)
    return df.join(counts, groups).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.col("shards")).cast("int"))
