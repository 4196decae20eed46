"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.llm.ranking import before, bucket_bits
from symlattice.llm.text import uniform, words
from symlattice.staging import Scratch, cut, sent

#: The weights that the sources get in turn.
WEIGHTS = (5.0, 2.0, 1.0)


def quality_weight(text: Column) -> Column:
    """Between 0.25 and 1: grows with the share of a text's characters that are letters or blanks."""
    t = F.coalesce(text, F.lit(""))
    plain = F.length(F.regexp_replace(t, "[\\p{L}\\s.,]+", ""))
    return F.lit(1.0) - 0.75 * plain / F.greatest(F.length(t), F.lit(1))


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = 3.0) -> dict:
    """Words to take from each source: the sources by code point, null last, weigh weights[0],
    weights[1], ... again and again and share `share` of all sizes. A target stops at cap times its
    source's size, and what is over is dealt to the others by weight until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    out, open_, left = dict.fromkeys(size, 0.0), {s for s in size if size[s] > 0}, share * sum(size.values())
    while open_ and left > 0:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * per >= cap * size[s]}
        if not full:
            return out | {s: weight[s] * per for s in open_}
        for s in full:
            out[s] = cap * size[s]
            left -= out[s]
        open_ -= full
    return out


def mix(rows: DataFrame, source: str, size: str, weight: str, order: list[str], weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = 3.0, seed: int = 23, passes: int = 3, per_bucket: int = 2000) -> DataFrame:
    """rows with source_size (long), target (double), taken (long) and epochs (int).

    A source with target T and size S gives T div S complete epochs of all its rows; the rest of its
    budget is filled by weighted sampling without replacement: each row gets the exponential key
    -ln(u) / weight, u a seeded number of the `order` columns, and rows are taken in order of the key
    until one does not fit. The words then left over are offered, in order of the key again, to rows
    not yet taken that are no longer than that (`passes` times in all; the last time a row is also
    taken if half of it fits), so that one very long row cannot leave a source far below its target.
    Keys are dealt to buckets by their logarithm, of which none holds more than a known small share
    of any source, whatever the weights; so a source of any size is sorted in many tasks. weight must
    be above 0. The sources' names and sizes (one row each) are read to the driver, where targets()
    runs. Null sources are a source; a null size counts as 0; rows that agree in `order` are
    interchangeable; an empty table gives an empty one.
    """
    names, spark = rows.columns, rows.sparkSession
    base = rows.withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long")).withColumn("_key", -F.log(uniform(seed, *[F.col(c) for c in order])) / F.col(weight))
    totals = base.groupBy(source).agg(F.sum(size).alias("s"), F.count("*").alias("n")).collect()
    want = targets([(r[0], r["s"]) for r in totals], weights, share, cap)
    bits = bucket_bits(sum(r["n"] for r in totals), 8 * per_bucket, 10)
    kind = rows.schema[source].dataType.simpleString()
    plan = spark.createDataFrame([(r[0], r["s"], float(want[r[0]]), int(want[r[0]] // r["s"]) if r["s"] else 0) for r in totals], f"_s {kind}, source_size long, target double, epochs int")
    small = len(totals) <= 100_000  # else a shuffle join; the driver holds a few numbers for each source either way
    left = {r[0]: max(0.0, want[r[0]] % r["s"]) if r["s"] else 0.0 for r in totals}
    state = base.withColumn("_b", F.floor(F.log2("_key") * (1 << bits))).withColumn("_took", F.lit(False))
    for k in range(passes):
        gap = spark.createDataFrame([(s, g) for s, g in left.items()], f"_s {kind}, _gap double")
        placed = state.join(F.broadcast(gap) if small else gap, F.col(source).eqNullSafe(F.col("_s"))).drop("_s")
        fits = ~F.col("_took") & (F.col("_gap") > 0) & (F.col(size) <= F.col("_gap")) if k else F.col("_gap") > 0
        ranked = before(placed.where(fits), [source], "_b", [F.col("_key"), *[F.col(c) for c in order]], {"_past": F.col(size)})
        need = F.col(size) if k < passes - 1 else F.col(size) / 2
        now = ranked.withColumn("_took", F.col("_past") + need <= F.col("_gap")).select(*names, "_key", "_b", "_took")
        state = cut(now.unionByName(placed.where(~fits).select(*names, "_key", "_b", "_took")), "mix")
        got = {r[0]: r[1] for r in state.where("_took").groupBy(source).agg(F.sum(size)).collect()}
        left = {r[0]: (max(0.0, want[r[0]] % r["s"]) if r["s"] else 0.0) - (got.get(r[0]) or 0) for r in totals}
        if max(left.values(), default=0) < 1:
            break
    done = state.join(F.broadcast(plan) if small else plan, F.col(source).eqNullSafe(F.col("_s")))
    copies = F.col("epochs") + F.col("_took").cast("int")
    return done.select(*names, "source_size", "target", (copies * F.col(size)).cast("long").alias("taken"), copies.alias("epochs"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 23, **how) -> DataFrame:
    """(doc_id, source, crc, size, weight, source_size, target, taken, epochs) for every row of docs.

    size is the text's number of words (null: 0); weight is quality_weight(). The texts are read once
    and are not shuffled.
    """
    t = F.col(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(t).alias("crc"), F.size(words(t)).cast("long").alias("size"), quality_weight(t).alias("weight"))
    return mix(cut(slim, "slim"), "source", "size", "weight", ["doc_id", "crc"], seed=seed, **how)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 23, **how) -> DataFrame:
    """docs as the mix has them: each row as often as the mix takes it, all columns kept.

    Rows without words are in as many copies as their source has epochs."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (id_col, text_col, source_col)}
    plain = docs.toDF(*names)
    with Scratch(docs.sparkSession) as scratch:
        plan = mix_documents(plain, at[id_col], at[text_col], at[source_col], seed, **how)
        # rows that agree in id, source and text are one row here, with all their copies
        plan = plan.groupBy(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("crc").alias("_x")).agg(F.sum("epochs").alias("_e"), F.count("*").alias("_n"))
        plan = scratch.keep(cut(plan.where("_e > 0"), "plan"))
    hit = plain.withColumn("_h", F.xxhash64(at[text_col])).join(sent(plan), F.col(at[id_col]).eqNullSafe(F.col("_i")) & F.col(at[source_col]).eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_x")))
    alike = hit.where("_n = 1")
    again = hit.where("_n > 1").dropDuplicates([at[id_col], at[source_col], "_h"])
    return alike.unionByName(again).select(*names, F.explode(F.sequence(F.lit(1), F.col("_e").cast("int")))).select(*names).toDF(*docs.columns)
