"""The registered closures over the whole call graph, against a search by hand on a small cyclic graph and on the star schema."""

import pytest

from symlattice import queries as Q

CALLS = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 8)]


def closure(edges):
    out, todo = set(), list(edges)
    while todo:
        a, b = todo.pop()
        if (a, b) not in out:
            out.add((a, b))
            todo += [(a, y) for x, y in edges if x == b]
    return out


@pytest.mark.parametrize("real", [False, True])
def test_closures_of_a_cyclic_call_graph(spark, monkeypatch, real):
    path = "/root/testdata/sf0.001"
    if not real:
        monkeypatch.setattr(Q, "calls", lambda spark, sf_dir: spark.createDataFrame(CALLS, "a long, b long"))
    edges = {(r["a"], r["b"]) for r in Q.calls(spark, path).collect()}
    if real:  # the far ends of every caller, by a search from each
        step = {}
        for a, b in edges:
            step.setdefault(a, []).append(b)
        want = set()
        for a in step:
            todo = list(step[a])
            while todo:
                b = todo.pop()
                if (a, b) not in want:
                    want.add((a, b))
                    todo += step.get(b, [])
    else:
        want = closure(edges)
    assert any(a == b for a, b in want)
    assert {(r["a"], r["b"]) for r in Q.QUERIES["closure_full"](spark, path).collect()} == want
    if not real:
        assert {(r["a"], r["b"]) for r in Q.QUERIES["closure_by_rounds"](spark, path).collect()} == want
    callers = {}
    for a, b in want:
        callers.setdefault(b, set()).add(a)
    got = {(r["changed"], r["callers"]) for r in Q.QUERIES["blast_radius"](spark, path).collect()}
    assert got == {(b, len(x)) for b, x in callers.items()}


def test_every_row_of_the_star_schema_is_a_fact(spark):
    path = "/root/testdata/sf0.001"
    rows = Q.QUERIES["edge_counts"](spark, path).collect()
    assert len(rows) == Q.entry(spark, path, "edge").count() and {r["kind"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 17}
    items = spark.read.parquet(f"{path}/lineitem.parquet").count()
    chain = Q.entry(spark, path, "chain").count()
    assert sum(r["n"] for r in rows if r["kind"] == 1) == 2 * items + chain


def test_large_graphs_are_walked_in_units_and_not_by_rounds(spark, monkeypatch):
    """Two groups of callers that share what they call, and a unit too large for a task; no pairs but those of the result are made."""
    from symlattice.operators import closure as C

    edges = [(i, i + 1) for i in range(10, 16)] + [(16, 10)] + [(i, i + 1) for i in range(20, 24)] + [(i, 90 + i % 3) for i in (10, 12, 20, 23)] + [(90, 99)]
    want = closure(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    for unit_edges, step in ((1000, 8_000_000), (5, 8_000_000), (1000, 4)):
        monkeypatch.setattr(C, "UNIT_EDGES", unit_edges)
        monkeypatch.setattr(C, "STEP_PAIRS", step)
        assert sorted((r["a"], r["b"]) for r in C.reach(df, small=0).collect()) == sorted(want)
        assert {r["b"]: r["n"] for r in C.reached_by(df, small=0).collect()} == {b: len({x for x, y in want if y == b}) for _, b in want}
        assert {r["a"] for r in C.on_cycles(df, small=0).collect()} == set(range(10, 17))
        if unit_edges == 1000:
            with monkeypatch.context() as m:
                m.setattr(C, "_reach_by_rounds", None)
                assert C.reach(df, small=0).count() == len(want)
    tree = spark.createDataFrame([(10, 11), (11, 12), (20, 21)], "a long, b long")
    tops = spark.createDataFrame([(10,), (21,)], "x long")
    unit = lambda c: (c / 10).cast("long")
    assert {tuple(r) for r in C.reach(tree, tops, unit=unit).collect()} == {(10, 11, 1), (10, 12, 2)}
