"""Near-duplicate vectors: a layered graph per shard, searched by all, verified, and united."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.llm.proximity import LayeredGraph, groups
from symlattice.llm.vectors import canonical, matrix, salted, spread, unit, valid
from symlattice.operators.components import connected_components
from symlattice.staging import cut

#: Rows of a shard; a task holds two.
SHARD_ROWS = 16384
#: Queries without and with a link that an audit compares with all vectors of a shard.
AUDIT = (192, 64)
#: Times that a search is widened after a failed audit.
WIDENED = 1
#: Queries that are verified at a time.
PART = 512


def _pairs(graph: LayeredGraph, x: np.ndarray, queries: np.ndarray, least: float, width: int, slack: float) -> Iterator[np.ndarray]:
    """For each PART of the unit vectors `queries` a matrix that says which vectors of x have a cosine of `least` or more,
    of those that the graph proposes: a beam of `width` finds the ball around a query that is `slack` wider
    than the threshold, and the ball expands."""
    for lo in range(0, len(queries), PART):
        part = queries[lo : lo + PART]
        q, p = graph.within(part, 2 * (1 - least) + slack, width)
        out = np.zeros((len(part), len(x)), bool)
        for at in range(0, len(q), 1 << 16):
            i, j = q[at : at + (1 << 16)], p[at : at + (1 << 16)]
            out[i, j] = np.einsum("ij,ij->i", part[i], x[j]) >= least
        yield out


def _exact(x: np.ndarray, queries: np.ndarray, least: float) -> Iterator[np.ndarray]:
    for lo in range(0, len(queries), PART):
        yield queries[lo : lo + PART] @ x.T >= least


def links_between(graph: LayeredGraph, x: np.ndarray, queries: np.ndarray, least: float, width: int, slack: float, same: bool = False, seed: int = 3) -> np.ndarray:
    """Which of the vectors x each query has a cosine of `least` or more with, as rows of packed bits. All are
    unit vectors in double precision; same: the queries are x, and each has itself.

    An audit compares some queries, most of them without a link, with all points: while it misses a
    link, width and slack are doubled and all queries are searched again. WIDENED times at most: a beam
    that is wider still costs more than what comes then, every query compared with every point.
    """
    r, widest = np.random.default_rng(seed), width << WIDENED
    while True:
        last = width >= min(len(x), widest + 1)
        found = _exact(x, queries, least) if last else _pairs(graph, x, queries, least, width, slack)
        bits = np.concatenate([np.packbits(m, axis=1, bitorder="little") for m in found]) if len(queries) else np.zeros((0, (len(x) + 7) // 8), np.uint8)
        if last:
            return bits
        if same:
            own = np.arange(len(x))
            bits[own, own >> 3] |= (1 << (own & 7)).astype(np.uint8)
        got = np.bitwise_count(bits).sum(1, dtype=np.int64)
        lone = got == int(same)
        tried = np.concatenate([r.permutation(group)[:most] for group, most in zip((np.flatnonzero(lone), np.flatnonzero(~lone)), AUDIT, strict=True)])
        # a cosine within rounding of the threshold may fall on either side of another order of sums
        true = np.concatenate([m.sum(1) for m in _exact(x, queries[tried], least + 1e-12)]) if len(tried) else tried
        if (got[tried] >= true).all():
            return bits
        width, slack = 2 * width, 2 * slack


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (the least member of each node's group) after the links a-b."""
    apart = label[a] != label[b]
    return groups(len(label), np.concatenate([np.arange(len(label)), a[apart]]), np.concatenate([label, b[apart]])) if apart.any() else label


def both_ways(gx: LayeredGraph, x: np.ndarray, gy: LayeredGraph | None, y: np.ndarray, least: float, width: int, slack: float, weight_x: np.ndarray, weight_y: np.ndarray):
    """(links of each x, links of each y, groups over x and then y): a link counts for both its ends,
    whichever of the two searches found it. gy None: y is x itself, and no vector links with itself."""
    of_y = links_between(gx, x, y, least, width, slack, gy is None)  # rows are y
    n_x, n_y, label = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), np.arange(len(x) + len(y))
    of_x = of_y if gy is None else links_between(gy, y, x, least, width, slack)
    for lo in range(0, len(x), PART):
        hi = min(lo + PART, len(x))
        here = np.unpackbits(of_x[lo:hi], axis=1, count=len(y), bitorder="little")
        here |= np.unpackbits(of_y[:, lo >> 3 : (hi + 7) >> 3], axis=1, bitorder="little")[:, : hi - lo].T
        if gy is None:
            here[np.arange(hi - lo), np.arange(lo, hi)] = 0
        n_x[lo:hi] = here @ weight_y
        n_y += weight_x[lo:hi] @ here
        r, c = np.nonzero(here)
        label = _united(label, r + lo, c if gy is None else c + len(x))
    return n_x, n_y, label


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", least: float = 0.98, shard_rows: int = SHARD_ROWS, degree: int = 16, width: int = 48, slack: float = 0.02) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Two vectors link if their labels are equal and not null (label_col None: all of them) and their
    cosine is `least` or more. Equal vectors of a label are one point with a number of rows. Points are
    dealt to shards within their label; a graph is built in each, and every two shards of a label are
    searched with each other's points, in a task of their own. It sends back a count and one link to a group's head for each
    point, not the pairs; the groups are united by connected components. Finite components may be of
    any size: vectors are brought to length 1 before anything is squared. n_links counts rows, not
    points; component_id is the least vec_id that can be reached. Rows with a null label, a null id or
    an invalid vector (null, zero, null or non-finite components) link with nothing and are their own
    component. Rows that repeat an id are rows of their own that share a component if they link.
    """
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("ok", valid(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = cut(rows.select("vec_id", "label", "ok", F.when(F.col("ok"), canonical(F.col("v"))).alias("v")), "vectors")
    good = rows.where("ok")
    points = good.groupBy("label", "v").agg(F.min("vec_id").alias("head"), F.count("*").alias("n"))
    points = cut(points.select(F.monotonically_increasing_id().alias("node"), "label", "v", "head", "n", F.size("v").alias("dim")), "points")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x = matrix(table["v"], table.num_rows)
        graph = LayeredGraph.build(unit(x), degree, max(width, 48))
        cells = {"grp": table["grp"][0].as_py(), "shard": table["shard"][0].as_py(), "dim": x.shape[1], "nodes": table["node"].to_numpy().astype(np.int64).tobytes(), "counts": table["n"].to_numpy().astype(np.int64).tobytes(), "points": x.tobytes(), "graph": graph.to_bytes()}
        return pa.table({k: [v] for k, v in cells.items()})

    grouped = points.withColumn("grp", F.concat_ws("/", F.col("label").cast("string"), F.col("dim").cast("string")))
    dealt = spread(salted(grouped, ["grp"], "node", shard_rows, 47), points.count() // shard_rows + 1, "grp", "shard")
    shards = cut(dealt.groupBy("grp", "shard").applyInArrow(pack, "grp string, shard long, dim long, nodes binary, counts binary, points binary, graph binary"), "shards")

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (unit(np.frombuffer(row[c], np.float64).reshape(-1, row["dim"])) for c in ("points", "points2"))
                hx, hy, wx, wy = (np.frombuffer(row[c], np.int64) for c in ("nodes", "nodes2", "counts", "counts2"))
                same = row["at"] == row["by"]
                gx, gy = (LayeredGraph.from_bytes(z, row[c]) for z, c in ((x, "graph"), (y, "graph2")))
                n_x, n_y, label = both_ways(gx, x, None if same else gy, y, least, width, slack, wx, wy)
                names, count = (hx, n_x) if same else (np.concatenate([hx, hy]), np.concatenate([n_x, n_y]))
                label = label[: len(names)]
                some = np.flatnonzero(count)
                # named by the least node of the group, as components are
                low = names.copy()
                np.minimum.at(low, label, names)
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(low[label[some]]), pa.array(count[some])], ["node", "root", "n_links"])

    place, cells = shards.select("grp", "shard"), ["nodes", "counts", "points", "graph"]
    two = place.withColumnRenamed("shard", "at").join(place.withColumnRenamed("shard", "by"), "grp").where(F.col("at") <= F.col("by"))
    n = two.count()
    a = shards.select("grp", F.col("shard").alias("at"), "dim", *cells)
    b = shards.select("grp", F.col("shard").alias("by"), *[F.col(c).alias(f"{c}2") for c in cells])
    # numbers only are joined by label; the shards' bytes then meet pair by pair
    left = two.join(a, ["grp", "at"])
    pairs = spread(left.join(b, ["grp", "by"]), n, "grp", "at", "by")
    found = cut(pairs.select("at", "by", "dim", *cells, *[f"{c}2" for c in cells]).mapInArrow(work, "node long, root long, n_links long"), "found")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("other"))
    united = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = points.select("node", "label", "v", "head", "n").join(counts, "node", "left").join(united, "node", "left")
    told = cut(told.select("label", "v", "head", (F.col("n") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "told")
    told = told.join(told.groupBy("root").agg(F.min("head").alias("component_id")), "root").select("label", "v", "n_links", "component_id")
    named = good.select("vec_id", "label", "v").join(told, ["label", "v"]).select("vec_id", "n_links", "component_id")
    lone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(lone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
