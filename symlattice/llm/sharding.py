"""Shards that all match the mixture of sources, by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.llm.ranking import before, bucket_bits
from symlattice.llm.text import uniform, utf8_bytes
from symlattice.staging import cut


def interleave(docs: DataFrame, n_shards: int, source: Column, order: list[Column], seed: int = 17, per_bucket: int = 2000) -> DataFrame:
    """docs with rank, shard and slot (longs, shard an int), by DataFrame functions alone.

    Within each source the rows are shuffled: sorted by a seeded uniform number of the `order`
    columns. A row's fractional rank (r - 1/2) / n spreads every source evenly over (0, 1); all rows
    are sorted by it, ties by source (null last) and then by the shuffle. Rank k of N rows goes to
    shard k * n_shards div N, so that sizes differ by one row at most, and every shard holds each
    source's share to within about as many rows as there are sources. Slots count from 0 in each shard. Rows that
    agree in source and all of `order` are interchangeable. An empty table gives an empty one.
    The result has the columns rank, shard and slot besides those of docs, which must not have them.
    """
    names = docs.columns
    base = docs.select(*names, source.alias("_src"), uniform(seed, *order).alias("_u"), *[c.alias(f"_k{i}") for i, c in enumerate(order)])
    keys = [F.col("_u"), *[F.col(f"_k{i}") for i in range(len(order))]]
    counts = cut(base.groupBy("_src").agg(F.count("*").alias("_n")), "sources")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    buckets = 1 << bucket_bits(total, per_bucket)
    base = base.withColumn("_b", F.floor(F.col("_u") * buckets))
    inside = before(base, ["_src"], "_b", keys, {"_r": F.lit(1).cast("long")})
    sizes = counts.select(F.col("_src").alias("_s2"), "_n")
    spread = inside.join(sizes, F.col("_src").eqNullSafe(F.col("_s2"))).drop("_s2")
    # In halves of 1 / n: exact for up to 2**52 rows.
    spread = spread.withColumn("_f", (2 * F.col("_r") + 1) / (2 * F.col("_n"))).withColumn("_b", F.floor(F.col("_f") * buckets))
    ranked = before(spread.select(*names, "_src", "_f", "_b", "_u", *[f"_k{i}" for i in range(len(order))]), [], "_b", [F.col("_f"), F.col("_src").asc_nulls_last(), *keys], {"rank": F.lit(1).cast("long")})
    shard = F.expr(f"(rank * {n_shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.select(*names, "rank", shard.alias("shard")).select(*names, "rank", F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """(doc_id, source, size, text_crc32, rank, shard, slot): the place of every row of docs.

    size is the text's UTF-8 bytes (0 for a null text) plus 16; text_crc32 of a null text is 0, that
    of no bytes. Texts are read once, measured at the scan and not shuffled. Null ids and sources are
    values like others; repeated rows get a place each.
    """
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (utf8_bytes(F.col(text_col)) + 16).alias("size"), crc.alias("text_crc32"))
    slim = cut(slim, "slim")
    return interleave(slim, n_shards, F.col("source"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], seed)
