"""Approximate nearest neighbours: a robust-pruned graph per shard, searched by beams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlattice.llm.proximity import NONE, RobustGraph
from symlattice.llm.vectors import BAND, canonical, euclid, magnitude_band, matrix, salted, spread, valid
from symlattice.staging import cut

#: Rows of a shard; a task holds one shard's vectors and links.
SHARD_ROWS = 8192
#: Queries of a block, and blocks that a task searches in one shard.
BLOCK_ROWS, BLOCKS = 2048, 4
#: Queries so many powers of two beyond a shard's magnitudes are compared with all its points.
FAR = 20


def build_index(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, degree: int = 32, width: int = 64, alpha: float = 1.2) -> DataFrame:
    """A table with a row for each shard: dim, band, shard, n, points, ids and links as bytes.

    Equal vectors are one point, which keeps its k + 1 least ids: no query can want more of them.
    Points go to shards by their hash, so that a crowd of near copies is spread over all shards.
    Vectors of unlike dimensions, or of magnitudes many powers of two apart, are in different shards;
    a graph is built on a shard's vectors divided by its power of two, so squares neither overflow nor
    vanish. Rows with a null id or an invalid vector take no part; others may be any finite numbers.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & valid(F.col("v")))
    rows = rows.select("id", canonical(F.col("v")).alias("v"))
    # the limit on the rank also holds in each map task, so a vector of any number of rows stays small
    least = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    points = least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v")).withColumn("band", magnitude_band(F.col("v"))).withColumn("head", F.col("ids")[0])
    points = cut(points, "points")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("head")  # the same graph, in whatever order the rows came
        n = table.num_rows
        x = matrix(table["v"], n)
        band = table["band"][0].as_py()
        graph = RobustGraph.build(_graph_points(x, band), degree, width, alpha)
        ids = np.full((n, k + 1), -1, np.int64)
        some = np.zeros(n, np.int64)
        for i, own in enumerate(table["ids"].to_pylist()):
            ids[i, : len(own)] = own
            some[i] = len(own)
        cells = [table["dim"][0].as_py(), band, table["shard"][0].as_py(), n, x.tobytes(), some.tobytes(), ids.tobytes(), graph.links.astype("<i4").tobytes(), graph.entry]
        return pa.table({c: [v] for c, v in zip(("dim", "band", "shard", "n", "points", "counts", "ids", "links", "entry"), cells, strict=True)})

    dealt = salted(points, ["dim", "band"], "head", shard_rows, 41)
    dealt = spread(dealt, points.count() // shard_rows + 1, "dim", "band", "shard")
    return dealt.groupBy("dim", "band", "shard").applyInArrow(build, "dim long, band long, shard long, n long, points binary, counts binary, ids binary, links binary, entry long")


def _graph_points(x: np.ndarray, band: int) -> np.ndarray:
    """What graphs and beams see of vectors: single precision, divided by the band's power of two."""
    return np.ascontiguousarray(np.ldexp(x, -BAND * band), np.float32)


@lru_cache(maxsize=2)
def _opened(dim: int, band: int, points: bytes, counts: bytes, ids: bytes, links: bytes, entry: int):
    x = np.frombuffer(points, np.float64).reshape(-1, dim)
    n = len(x)
    graph = RobustGraph(_graph_points(x, band), np.frombuffer(links, "<i4").reshape(n, -1).astype(np.int64), entry)
    return x, graph, np.frombuffer(counts, np.int64), np.frombuffer(ids, np.int64).reshape(n, -1)


def _candidates(x: np.ndarray, graph: RobustGraph, band: int, qs: np.ndarray, width: int, k: int):
    """(query, point, distance) triples: those a beam finds; for queries far beyond the shard's
    magnitudes, to which single precision shows all points alike, the k + 1 nearest of all points, and
    those as near as the last of them."""
    power = np.frexp(np.abs(qs).max(1, initial=0))[1] - BAND * band
    near = np.flatnonzero(power <= BAND // 2 + FAR)
    at, _ = graph.search(_graph_points(qs[near], band), max(width, k + 1))
    r, c = np.nonzero(at != NONE)
    p, r = at[r, c], near[r]
    found = [(r, p, euclid(x[p], qs[r]))]
    for i in np.flatnonzero(power > BAND // 2 + FAR):
        d = euclid(x, np.broadcast_to(qs[i], x.shape))
        last = np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)]
        p = np.flatnonzero(d <= last)
        found.append((np.full(len(p), i), p, d[p]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 128, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, the query's own id left out.

    Every block of queries is searched in every shard of its dimension by a beam of `width`; distances
    are taken again in double precision on the vectors as given. Ties go to the smaller id. A query
    that is there twice counts once (the vector least in order stays); null ids and invalid vectors
    are no queries.
    """
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & valid(F.col("v")))
    q = q.groupBy("id").agg(F.min(canonical(F.col("v"))).alias("v")).withColumn("dim", F.size("v"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        return pa.table({"dim": [table["dim"][0].as_py()], "block": [table["shard"][0].as_py()], "qids": [table["id"].to_numpy().astype(np.int64).tobytes()], "qs": [matrix(table["v"], table.num_rows).tobytes()]})

    blocks = salted(q, ["dim"], "id", block_rows, 43).groupBy("dim", "shard").applyInArrow(pack, "dim long, block long, qids binary, qs binary")
    blocks = cut(blocks, "queries")

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, graph, counts, ids = _opened(row["dim"], row["band"], row["points"], row["counts"], row["ids"], row["links"], row["entry"])
                own = np.frombuffer(row["qids"], np.int64)
                r, p, d = _candidates(x, graph, row["band"], np.frombuffer(row["qs"], np.float64).reshape(len(own), -1), width, k)
                # every point for as many ids as it keeps
                rep = np.repeat(np.arange(len(p)), counts[p])
                slot = np.arange(len(rep)) - np.repeat(np.cumsum(counts[p]) - counts[p], counts[p])
                r, d, vec = r[rep], d[rep], ids[p[rep], slot]
                ok = vec != own[r]
                r, d, vec = r[ok], d[ok], vec[ok]
                order = np.lexsort((vec, d, r))
                r, d, vec = r[order], d[order], vec[order]
                near = np.arange(len(r)) - np.searchsorted(r, r) < k
                yield pa.RecordBatch.from_arrays([pa.array(own[r[near]]), pa.array(vec[near]), pa.array(d[near])], ["query_id", "vec_id", "score"])

    # a block goes to each shard of its dimension; a shard goes to a task for every BLOCKS blocks
    index, n = cut(index, "index"), blocks.count()
    parts = -(-n // BLOCKS) or 1
    where, key = index.select("dim", "band", "shard"), ["dim", "band", "shard", "part"]
    asked = blocks.withColumn("part", F.pmod("block", F.lit(parts)).cast("int")).join(where, "dim")
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tasks = parts * max(1, where.count())
    pairs = spread(held, tasks, *key).join(spread(asked, tasks, *key), key)
    found = pairs.select("dim", "band", "points", "counts", "ids", "links", "entry", "qids", "qs").mapInArrow(work, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
