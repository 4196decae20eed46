"""Recursive queries over an edge table (a, b): closures, cones, search trees, roots.

One interface, three ways. A graph whose number of edges is checked to be at most `small` is sent to
every executor as sorted arrays, and sources are searched where they lie, with no shuffle a round. In a
larger one the edges of a unit are dealt to one task and walked there: units are what the caller says
(syntax trees: the function), or else the components of the graph without the ends that lead nowhere,
so that one shuffle of the edges serves all rounds. From given seeds, and within units too large for a
task, rounds of joins over rows not seen before (semi-naive) are written to the shared folder, so that
neither plans nor recomputation grow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.operators.components import connected_components
from symlattice.staging import cut, drop_staged, sent

#: Edges that are sent to the executors: 16 bytes each.
SMALL = 2_000_000
#: Edges of a task that walks whole units, and of the largest unit that one task walks.
TASK_EDGES, UNIT_EDGES = 1_000_000, 1_000_000
#: Pairs of a source and an end that a task holds in one step; beyond that it takes fewer sources at once.
STEP_PAIRS = 8_000_000


def ready(edges: DataFrame) -> DataFrame:
    """A cut() table whose rows (a, b) are known to be distinct: reach() does not write it again."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    edges._ready = True
    return edges


def _cut(edges: DataFrame) -> DataFrame:
    return edges if getattr(edges, "_ready", False) else cut(plain_edges(edges), "edges")


def plain_edges(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null").distinct()


class Adjacency:
    """Neighbours by node, over the sorted distinct nodes of an edge table."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        order = np.argsort(x, kind="stable")
        self.ends = y[order]
        self.starts = np.searchsorted(x[order], np.arange(len(self.nodes) + 1))

    def depths(self, source: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes reached by one step or more, and by how many; the source too if it is on a cycle."""
        at = np.searchsorted(self.nodes, source)
        if at >= len(self.nodes) or self.nodes[at] != source:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth = np.full(len(self.nodes), -1)
        front, d = np.array([at]), 0
        while len(front) and (most is None or d < most):
            d += 1
            count = self.starts[front + 1] - self.starts[front]
            reach = np.unique(self.ends[np.arange(count.sum()) + np.repeat(self.starts[front] - (np.cumsum(count) - count), count)])
            front = reach[depth[reach] < 0]
            depth[front] = d
        hit = np.flatnonzero(depth > 0)
        return self.nodes[hit], depth[hit]


    def pairs(self, sources: np.ndarray, most: int | None = None):
        """Yields (a, b, depth) arrays: what each source reaches; many sources go at once."""
        at = np.searchsorted(self.nodes, sources)
        at[at >= len(self.nodes)] = 0
        at = np.unique(at[self.nodes[at] == sources]) if len(self.nodes) else at[:0]
        todo = [at[i : i + (1 << 16)] for i in range(0, len(at), 1 << 16)][::-1]
        while todo:
            part = todo.pop()
            found = self._pairs(part, most)
            if found is None:
                half = len(part) // 2
                todo += [part[half:], part[:half]]
                continue
            yield from ((self.nodes[key // len(self.nodes)], self.nodes[key % len(self.nodes)], np.full(len(key), d)) for d, key in found)

    def _pairs(self, part: np.ndarray, most: int | None):
        n = len(self.nodes)
        a = b = part
        seen, out, d, held = np.zeros(0, np.int64), [], 0, 0
        while len(a) and (most is None or d < most):
            d += 1
            count = self.starts[b + 1] - self.starts[b]
            total = int(count.sum())
            if len(part) > 1 and total + held > STEP_PAIRS:
                return None
            ends = self.ends[np.arange(total) + np.repeat(self.starts[b] - (np.cumsum(count) - count), count)]
            key = np.unique(np.repeat(a, count) * n + ends)
            if len(seen):
                place = np.searchsorted(seen, key)
                place[place == len(seen)] = 0
                key = key[seen[place] != key]
            out.append((d, key))
            held += len(key)
            # ends that lead nowhere need not be looked up again as fronts, but as pairs they must
            seen = np.sort(np.concatenate([seen, key]), kind="stable")
            a, b = key // n, key % n
            go = self.starts[b + 1] > self.starts[b]
            a, b = a[go], b[go]
        return out


def _sent(edges: DataFrame, small: int) -> Adjacency | None:
    if edges.limit(small + 1).count() > small:
        return None
    t = edges.toArrow()
    return Adjacency(t["a"].to_numpy(), t["b"].to_numpy())


_PAIRS = "a long, b long, depth long"


def _batches(parts):
    """Record batches of bounded length of arrays that belong together."""
    for a, b, depth in parts:
        for lo in range(0, len(a), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 18)].astype(np.int64)) for x in (a, b, depth)], ["a", "b", "depth"])


def reach(edges: DataFrame, seeds: DataFrame | None = None, most: int | None = None, small: int = SMALL, unit: Callable[[Column], Column] | None = None) -> DataFrame:
    """(a, b, depth): b can be reached from a by depth >= 1 steps, the fewest there are.

    seeds: one column, the a's wanted (None: every node with an edge). most bounds the steps. A node
    reaches itself only over a cycle. Null ends are ignored. unit: a function of a node that is the same
    for both ends of every edge, and says what lies together; if some edge says otherwise, it is not used.
    """
    if unit is not None:
        e = edges.select(F.col(edges.columns[0]).cast("long").alias("a"), F.col(edges.columns[1]).cast("long").alias("b")).where("a is not null and b is not null")
        rows, apart = e.agg(F.count("*"), F.count_if(unit(F.col("a")) != unit(F.col("b")))).first()
        if not apart:
            return _reach_in_units(e.select(unit(F.col("a")).alias("u"), "a", "b"), rows, None if seeds is None else _nodes(seeds).select(unit(F.col("a")).alias("u"), "a"), most)
    e = _cut(edges)
    graph = _sent(e, small)
    if graph is not None:
        return _reach_here(e, e.select("a").distinct() if seeds is None else _nodes(seeds).distinct(), graph, most)
    if seeds is not None:
        return _reach_by_rounds(e, _nodes(seeds).distinct(), most)
    units = _units(e)
    large = cut(units.groupBy("u").count().where(F.col("count") > UNIT_EDGES).select("u"), "units")
    if large.isEmpty():
        return _reach_in_units(units, units.count(), None, most)
    rest, big = units.join(large, "u", "left_anti"), units.join(large, "u", "left_semi").select("a", "b")
    return _reach_in_units(rest, units.count(), None, most).unionByName(_reach_by_rounds(cut(big, "edges"), big.select("a").distinct(), most))


def _nodes(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.col(seeds.columns[0]).cast("long").alias("a")).where("a is not null")


def _inner(e: DataFrame) -> DataFrame:
    """The edges whose far ends have edges themselves."""
    return e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")


def _units(e: DataFrame) -> DataFrame:
    """(u, a, b): the edges with the component of their sources, where ends that lead nowhere join nothing:
    all that a node reaches lies in the edges of its own component, and no node is a source in two."""
    roots = connected_components(_inner(e)).select(F.col("node").alias("a"), F.col("root").alias("u"))
    return cut(e.join(roots, "a", "left").select(F.coalesce("u", "a").alias("u"), "a", "b"), "units")


def _adjacency_of(batches) -> tuple[Adjacency, np.ndarray | None]:
    """The graph of a partition of (a, b) rows, and the sources among them: rows without b (None: no such row is meant)."""
    a, b, seed = [], [], []
    for batch in batches:
        x, y = batch.column(0).to_numpy(), batch.column(1)
        own = np.asarray(y.is_null())
        seed.append(x[own])
        a.append(x[~own])
        b.append(y.drop_null().to_numpy())
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Adjacency(join(a), join(b)), np.unique(join(seed))


def _dealt(units: DataFrame, rows: int, seed: DataFrame | None) -> DataFrame:
    """(a, b) rows, those of a unit in one task; seeds are rows without b."""
    all_ = units if seed is None else units.unionByName(seed.withColumn("b", F.lit(None).cast("long")))
    parts = max(rows // TASK_EDGES + 1, min(units.sparkSession.sparkContext.defaultParallelism, rows // 10_000 + 1))
    return all_.repartition(parts, "u").select("a", "b")


def _reach_in_units(units: DataFrame, rows: int, seed: DataFrame | None, most: int | None) -> DataFrame:
    given = seed is not None

    def work(batches):
        graph, seeds = _adjacency_of(batches)
        yield from _batches(graph.pairs(seeds if given else graph.nodes, most))

    return _dealt(units, rows, seed).mapInArrow(work, _PAIRS)


def reached_by(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(b, n): by how many nodes each node can be reached. Counted where the sources lie: no pairs are moved."""
    e = _cut(edges)
    graph = _sent(e, small)
    units = None if graph is not None else _units(e)
    if graph is not None or not units.groupBy("u").count().where(F.col("count") > UNIT_EDGES).isEmpty():
        return reach(ready(e), small=small).groupBy("b").agg(F.count("*").alias("n"))

    def work(batches):
        graph, _ = _adjacency_of(batches)
        n = np.zeros(len(graph.nodes), np.int64)
        for _, b, _ in graph.pairs(graph.nodes):
            n += np.bincount(np.searchsorted(graph.nodes, b), minlength=len(n))
        hit = np.flatnonzero(n)
        yield from (pa.RecordBatch.from_arrays([pa.array(graph.nodes[x]), pa.array(n[x])], ["b", "n"]) for x in (hit[lo : lo + (1 << 18)] for lo in range(0, len(hit), 1 << 18)))

    return _dealt(units, units.count(), None).mapInArrow(work, "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))


def on_cycles(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(a): the nodes that reach themselves. Ends that lead nowhere are on no cycle and are left out first."""
    return reach(ready(cut(_inner(_cut(edges)), "edges")), small=small).where("a = b").select("a")


def _reach_by_rounds(e: DataFrame, seed: DataFrame, most: int | None) -> DataFrame:
    # the front is sent where it is few rows: then a round reads the edges and shuffles nothing of them
    front = sent(cut(seed, "seeds"))
    seen = delta = cut(e.join(front, "a").select("a", "b", F.lit(1).cast("long").alias("depth")), "reach")
    d = 1
    parts = [seen]
    while not delta.isEmpty() and (most is None or d < most):
        d += 1
        step = e.select(F.col("a").alias("k"), "b").join(sent(delta).select("a", F.col("b").alias("k")), "k").select("a", "b").distinct()
        delta = cut(step.join(seen.select("a", "b"), ["a", "b"], "left_anti").withColumn("depth", F.lit(d).cast("long")), "reach")
        parts.append(delta)
        seen = seen.unionByName(delta)
        if len(parts) % 16 == 0:  # keeps the number of files that a round reads small
            seen = cut(seen, "reach")
    return seen


def _reach_here(e: DataFrame, seed: DataFrame, graph: Adjacency, most: int | None) -> DataFrame:
    lies = e.sparkSession.sparkContext.broadcast(graph)

    def work(batches):
        for batch in batches:
            yield from _batches(lies.value.pairs(batch.column(0).to_numpy(), most))

    parallel = e.sparkSession.sparkContext.defaultParallelism
    return seed.repartition(max(parallel, 1), "a").mapInArrow(work, _PAIRS)


def backward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def cone(edges: DataFrame, seeds: DataFrame, forward: bool = True, small: int = SMALL) -> DataFrame:
    """(a, b): the edges on walks that leave the seeds (or, backward, that arrive at them)."""
    e = _cut(edges)
    along = e if forward else ready(backward(e))
    seed = seeds.select(F.col(seeds.columns[0]).cast("long").alias("a")).distinct()
    nodes = reach(along, seed, small=small).select(F.col("b").alias("a")).unionByName(seed).distinct()
    hit = along.join(nodes, "a", "left_semi")
    return hit if forward else backward(hit)


def tree(edges: DataFrame, start: int, most: int | None = None, most_nodes: int | None = None, target: int | None = None) -> DataFrame:
    """(node, depth, parent): a breadth-first search from start, which has depth 0 and no parent.

    Of several parents the least id is taken. most_nodes bounds the nodes, start included: the nodes
    of the last round are cut in order of (parent, node). The search ends when target is reached.
    """
    e = _cut(edges)
    spark = e.sparkSession
    delta = spark.createDataFrame([(start, 0, None)], "node long, depth int, parent long")
    parts, total, d = [delta], 1, 0
    while most is None or d < most:
        d += 1
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        found = delta.select(F.col("node").alias("a")).join(e, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")).join(seen.select("node"), "node", "left_anti")
        if most_nodes is not None:
            found = found.orderBy("parent", "node").limit(most_nodes - total)
        delta = cut(found.select("node", F.lit(d).alias("depth"), "parent"), "tree")
        n = delta.count()
        if not n:
            break
        parts.append(delta)
        total += n
        if (most_nodes is not None and total >= most_nodes) or (target is not None and not delta.where(F.col("node") == target).isEmpty()):
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def path(edges: DataFrame, start: int, target: int, most: int | None = 8) -> list[int] | None:
    """A shortest walk from start to target, as nodes; None if there is none of `most` steps or fewer (None: of any number)."""
    if start == target:
        return [start]
    t = cut(tree(edges, start, most, target=target), "tree")
    out = [target]
    while out[-1] != start:
        row = t.where(F.col("node") == out[-1]).first()
        if row is None:
            return None
        out.append(row["parent"])
    return out[::-1]


def roots(pointers: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root): where following pointers (node, next; one each) ends, by pointer jumping.

    Nodes of a cycle, and those that lead into one, stop at themselves: they have no end.
    """
    cur = cut(pointers.select(F.col("node").cast("long").alias("node"), F.col("next").cast("long").alias("root")).where("node <> root"), "pointers")
    origin = cur
    for _ in range(64):
        jump = cur.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(cur.join(jump, "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "pointers")
        if new.where("moved").isEmpty():
            return new.select("node", "root")
        if cur is not origin:
            drop_staged(cur)
        # after 64 doublings only cycles still move
        cur = new.select("node", "root")
    return cur.join(origin.select(F.col("node").alias("root")), "root", "left_anti").select("node", "root")
