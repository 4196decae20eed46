"""Exact ranks and running sums within groups of any size, without one task per group.

Rows are dealt to buckets by a monotone function of their sort key; a window within a bucket and the
sum of the buckets before it give the rank in the group. A group of a third of all rows is then as
many tasks' work as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_bits(rows: int, per_bucket: int = 2000, most: int = 16) -> int:
    """So many bits that 2**bits even buckets hold about per_bucket rows each."""
    return max(0, min(most, (max(rows, 1) // per_bucket).bit_length()))


def before(df: DataFrame, groups: list[str], bucket: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in sums, the sum of that column over the rows that come earlier in the
    same group, by bucket and then by `order`. groups may hold nulls. The table of bucket totals, whose
    running sums are taken a group at a time, has a row per group and non-empty bucket: 2**most of
    bucket_bits() at most, however many rows there are."""
    part = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumns({f"_in_{k}": F.coalesce(F.sum(v).over(part), F.lit(0).cast("long")) for k, v in sums.items()})
    totals = df.groupBy(*groups, bucket).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    run = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, bucket, *[F.coalesce(F.sum(f"_t_{k}").over(run), F.lit(0).cast("long")).alias(f"_o_{k}") for k in sums])
    renamed = offsets.toDF(*[c if c.startswith("_o_") else f"_b_{c}" for c in offsets.columns])
    on = [inner[c].eqNullSafe(renamed[f"_b_{c}"]) for c in [*groups, bucket]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return inner.join(renamed, cond, "left").select(*df.columns, *[(F.col(f"_in_{k}") + F.coalesce(F.col(f"_o_{k}"), F.lit(0))).alias(k) for k in sums])
