"""Vector operators against brute force."""

import numpy as np
import pytest

from symlattice.llm import nearest, proximity, vectordedup, vectors

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 16))
    out = []
    for i in range(900):
        v = centres[i % 6] + r.normal(size=16) * (0.02 if i % 3 == 0 else 1.0)
        out.append((i, [float(np.float32(x)) for x in v], i % 2 if i % 50 else None))
    for i in range(900, 960):  # one vector many times
        out.append((i, out[1][1], 1))
    return out + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, [1.0, 2.0], 1), (1004, [1.0, 2.0], 1), (None, out[1][1], 1)]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("shard_rows", [200, 5000])
def test_near_vectors(spark, rows, shard_rows):
    df = spark.createDataFrame(rows, VECTORS)
    got = vectordedup.near_vectors(df, shard_rows=shard_rows).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v), y) for i, v, y in rows if i is not None and y is not None and usable(v)]
    near = [(a, b) for a in range(len(good)) for b in range(a) if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.98 * np.linalg.norm(good[a][1]) * np.linalg.norm(good[b][1])]
    links, label = [0] * len(good), proximity.groups(len(good), np.array([a for a, _ in near]), np.array([b for _, b in near]))
    for a, b in near:
        links[a] += 1
        links[b] += 1
    least = {}
    for k, (i, _, _) in enumerate(good):
        least[label[k]] = min(least.get(label[k], 1 << 60), i)
    want = sorted((i, links[k], least[label[k]]) for k, (i, _, _) in enumerate(good))
    seen = {i for i, _, _ in want}
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] in seen) == want
    rest = [r for r in got if r["vec_id"] not in seen]
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"] for r in rest)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_near_vectors_of_nothing(spark):
    assert vectordedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_nearest(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", __import__("pyspark").sql.functions.lit("mine"))
    got = nearest.search(nearest.build_index(df, shard_rows=300), df.where("vec_id % 100 = 0 or vec_id in (1, 950, 1004)")).collect()
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and usable(v)]
    hit = total = 0
    for q in sorted({r["query_id"] for r in got}):
        v = next(v for i, v in good if i == q)
        near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v))[:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(near)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        hit += len({r["vec_id"] for r in mine} & {i for _, i in near})
        total += len(near)
    assert hit / total >= 0.9 and not any(r["query_id"] >= 1000 and r["query_id"] != 1004 for r in got)
    none = spark.createDataFrame([], VECTORS)
    assert nearest.search(nearest.build_index(none), none).count() == 0
    assert nearest.search(nearest.build_index(df, shard_rows=300), none).count() == 0


def test_graphs_reach_every_point():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(300, 8)), r.normal(size=(1, 8)) + r.normal(size=(200, 8)) * 1e-3]).astype(np.float32)
    g = proximity.RobustGraph.build(x, 8, 16)
    assert sorted(g.search(x[:1], len(x))[0][0].tolist()) == list(range(len(x)))
    h = proximity.LayeredGraph.from_bytes(x, proximity.LayeredGraph.build(x, 6, 16).to_bytes())
    q, p = h.within(x[300:], 1e-3, 8)
    want = (((x[300:, None] - x[None]) ** 2).sum(2) <= 1e-3).sum()
    assert len(q) >= 0.999 * want
    for cls in (proximity.RobustGraph, proximity.LayeredGraph):
        assert cls.build(np.zeros((1, 4), np.float32)) is not None


EXTREME = [1e-200, 1e-40, 1e20, 3e38, 1e39, 1e200]


@pytest.mark.parametrize("size", EXTREME)
def test_graphs_of_extreme_vectors_end(size):
    x = np.array([[1.0, 2.0], [2.0, 1.0], [-1.0, 0.5]]) * size
    u = vectors.unit(x)
    assert np.allclose(np.sqrt((u**2).sum(1)), 1) and proximity.LayeredGraph.build(u) is not None
    d = vectors.euclid(x[:1].repeat(2, 0), x[1:])
    assert np.allclose(d / size, [np.sqrt(2), 2.5])
    with np.errstate(all="ignore"), pytest.raises(ValueError):
        proximity.connect(np.array([[1.0], [np.inf]]), np.full((2, 2), -1), np.array([0, 1]), 0)


def test_extreme_vectors(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(40, 4)) * s for s in (1.0, *EXTREME)])
    x[1::2] = x[::2] * (1 + 1e-3 * r.normal(size=x[::2].shape))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {a["vec_id"]: a["n_links"] for a in vectordedup.near_vectors(df, shard_rows=100).collect()}
    u = vectors.unit(x)
    assert [got[i] for i in range(len(x))] == [int((u @ u[i] >= 0.98).sum()) - 1 for i in range(len(x))]
    asked = df.where("vec_id % 10 = 0")
    hit = total = 0
    found = nearest.search(nearest.build_index(df, shard_rows=100), asked).collect()
    for q in range(0, len(x), 10):
        d = vectors.euclid(x, np.broadcast_to(x[q], x.shape))
        want = sorted((v, i) for i, v in enumerate(d) if i != q)[:10]
        mine = [(a["score"], a["vec_id"]) for a in sorted((a for a in found if a["query_id"] == q), key=lambda a: a["rank"])]
        assert len(mine) == 10 and all(s == d[i] for s, i in mine)
        hit += len(set(mine) & set(want))
        total += 10
    assert hit / total >= 0.9


def test_links_count_both_ways():
    r = np.random.default_rng(2)
    x = vectors.unit(r.normal(size=(3, 8))[r.integers(0, 3, 700)] + 0.05 * r.normal(size=(700, 8)))
    y = vectors.unit(r.normal(size=(3, 8))[r.integers(0, 3, 300)] + x[:300])
    graphs = [proximity.LayeredGraph.build(z) for z in (x, y)]
    one, two = np.ones(len(x), np.int64), np.ones(len(y), np.int64)
    n_x, n_y, label = vectordedup.both_ways(graphs[0], x, graphs[1], y, 0.98, 32, 0.02, one, two)
    near = x @ y.T >= 0.98
    assert (n_x == near.sum(1)).all() and (n_y == near.sum(0)).all()
    a, b = np.nonzero(near)
    assert (label == proximity.groups(len(x) + len(y), a, b + len(x))).all()
    own, _, _ = vectordedup.both_ways(graphs[0], x, None, x, 0.98, 32, 0.02, one, one)
    assert (own == (x @ x.T >= 0.98).sum(1) - 1).all()
