"""Near-duplicate documents by SimHash: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.llm.pretokens import give_back
from symlattice.llm.text import ascii_lower, words
from symlattice.operators.components import connected_components
from symlattice.staging import Scratch, cut, sent

BITS = 64
#: Values that are counted together; bounds a worker's memory at 64 bytes for each.
CHUNK = 1 << 15


def shingle_hashes(text: Column, size: int = 3) -> tuple[Column, Column]:
    """(words, hashes): the second is an expression over a column named by the first, array of XXH64 with seed 42."""
    w, n = F.col("_words"), F.size("_words")
    each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(F.concat_ws(" ", *[w[i + k] for k in range(size)])))
    whole = F.array(F.xxhash64(F.concat_ws(" ", w)))
    return words(ascii_lower(text)), F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, whole).otherwise(each)


def majority_bits(hashes: pa.Array) -> pa.Array:
    """One 64-bit number for each list: a bit is 1 if it is set in over half of the list's values; 0 for an empty list."""
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    lengths = hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = hashes.flatten(), np.cumsum(lengths)
    counts = np.zeros((len(lengths), BITS), np.int64)
    for lo in range(0, len(flat), CHUNK):
        part = flat.slice(lo, CHUNK).to_numpy(zero_copy_only=False).astype("<i8", copy=False)
        mine = np.searchsorted(ends, np.arange(lo, lo + len(part)), "right")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        counts[mine[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    over = counts * 2 > lengths[:, None]
    return pa.array(np.packbits(over, axis=1, bitorder="little").reshape(-1).view("<i8") if len(lengths) else np.zeros(0, np.int64), pa.int64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): a row for each row of docs. A null text counts as empty, and its fingerprint is 0."""

    @F.arrow_udf("long")
    def fold(h: pa.Array) -> pa.Array:
        out = majority_bits(h)
        give_back()
        return out

    w, h = shingle_hashes(F.col("_text"), size)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return plain.select("id", w.alias("_words")).select("id", fold(h).alias("fp"))


def _shift(x: Column, n: int) -> Column:
    return F.shiftleft(x, n) if n else x


def block_keys(fp: Column, distance: int, extra: int) -> list[tuple[int, Column]]:
    """(mask, value) for each choice of blocks: the fingerprint is cut into distance + extra blocks, of
    which `extra` at least are equal in two fingerprints that differ in `distance` bits or fewer."""
    cuts = [round(BITS * i / (distance + extra)) for i in range(distance + extra + 1)]
    out = []
    for chosen in combinations(range(distance + extra), extra):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        mask -= (mask >> 63) << 64  # as a signed long
        out.append((mask, fp.bitwiseAND(F.lit(mask))))
    return out


def near_fingerprints(fps: DataFrame, distance: int = 2, extra: int = 2, hot: int = 64) -> DataFrame:
    """Edges (a, b) over the distinct values of fps.fp that have the same components as all pairs
    within `distance` bits.

    Blocks with up to `hot` fingerprints are joined with themselves and each pair's Hamming distance
    is checked. In a larger block (a crowd of near copies) all pairs would grow with its square; there
    each fingerprint names all numbers one bit away from it instead, within the bits that the block
    leaves free. Two that share such a number are two bits apart at most, and two that are two bits
    apart share one, so the numbers with two or more fingerprints are nodes that connect exactly
    those (distance 2; 0 and 1 need fewer). Other distances join every block.
    """
    choices = block_keys(F.col("fp"), distance, extra)
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), v.alias("v")) for i, (_, v) in enumerate(choices)])).alias("k")).select("fp", "k.t", "k.v")
    rows = cut(rows, "blocks")
    size = rows.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1")
    kept = rows.join(size, ["t", "v"])
    crowd = hot if distance == 2 else None
    few = kept if crowd is None else kept.where(F.col("n") <= crowd)
    left, right = few.select("t", "v", F.col("fp").alias("a")), few.select("t", "v", F.col("fp").alias("b"))
    pairs = left.join(right, ["t", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    edges = pairs.select("a", "b").distinct()
    if crowd is None:
        return edges
    many = kept.where(F.col("n") > crowd)
    flip = [F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(BITS)]
    free = F.element_at(F.array(*[F.lit(m) for m, _ in choices]), F.col("t") + 1)
    bits = F.filter(F.array(F.lit(0).cast("long"), *flip), lambda b: b.bitwiseAND(free) == 0)
    near = many.select("fp", F.explode(F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b))).alias("pivot")).distinct()
    shared = near.groupBy("pivot").agg(F.count("*").alias("n")).where("n > 1").select("pivot")
    star = near.join(shared, "pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    return edges.unionByName(star)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 2) -> DataFrame:
    """(id, fp, component): a row for each row of docs.

    component is the least id of those whose fingerprints can be reached over links of `distance`
    bits or fewer. Null and empty texts have fingerprint 0 and link like others; repeated rows share
    a fingerprint and so a component; a null id never names a component unless all its ids are null;
    an empty table gives an empty one. Other columns of docs are not read.
    """
    own = cut(fingerprints(docs, id_col, text_col, size), "fingerprints", batch_rows=2000)
    distinct = cut(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    root = connected_components(near_fingerprints(distinct.select("fp"), distance))
    named = distinct.join(root, distinct.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "roots")
    of_root = named.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = cut(named.join(of_root, "root").select("fp", "component"), "named")
    # rows of a common fingerprint are many: few numbers are sent to them, and a shuffle join of more is split by skew
    return own.join(sent(of_fp), "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 2) -> DataFrame:
    """docs with one row of each of simhash_groups(), as keep_first() chooses it."""
    return keep_first(docs, lambda d, i, t: simhash_groups(d, i, t, size, distance), id_col, text_col)


def keep_first(docs: DataFrame, grouped: Callable[[DataFrame, str, str], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """docs without the near copies: of each component of grouped(docs, id_col, text_col) the row with the least id stays, null ids
    last, ties to the text with the least hash; of rows that repeat both, one. All columns stay."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    plain = docs.toDF(*names).withColumn("_h", F.xxhash64(text))
    row = F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"), F.col("_h").alias("h"))
    with Scratch(docs.sparkSession) as scratch:
        groups = grouped(plain.select(row.alias("_id"), F.col(text).alias("_t")), "_id", "_t")
        won = scratch.keep(cut(groups.groupBy("component").agg((F.sum((F.col("id") == F.col("component")).cast("long")) > 1).alias("again")).select(F.col("component.k").alias("_k"), F.col("component.h").alias("_w"), "again"), "won"))
    on = plain[key].eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_w"))
    single = plain.join(won.where("not again"), on, "left_semi")
    several = plain.join(won.where("again"), on, "left_semi").dropDuplicates([key, "_h"])
    return single.select(names).unionByName(several.select(names)).toDF(*docs.columns)
