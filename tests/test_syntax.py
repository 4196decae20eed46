"""Relations over a tiny syntax tree: int helper(int p) { return p; }  int main() { int v = helper(w); }  int w;"""

import pytest

from symlattice.operators.syntax import CALL, FUNCTION, PARAM, RETURN, VAR, Trees


@pytest.fixture(scope="module")
def trees(spark):
    node = [
        # id, kind, spelling, line, end, definition
        (1, FUNCTION, "helper", 1, 3, 1), (2, PARAM, "p", 1, 1, 0), (3, RETURN, "", 2, 2, 0), (4, 101, "p", 2, 2, 0),
        (5, FUNCTION, "main", 4, 9, 1), (6, VAR, "v", 5, 5, 0), (7, CALL, "helper", 5, 5, 0), (8, 101, "helper", 5, 5, 0), (9, 101, "w", 5, 5, 0),
        (10, VAR, "w", 11, 11, 0), (11, FUNCTION, "lost", 12, 12, 1),
    ]
    edge = [(1, 2, 1, 0), (1, 3, 1, 1), (3, 4, 1, 0), (4, 2, 2, 0), (5, 6, 1, 0), (6, 7, 1, 0), (7, 8, 1, 0), (7, 9, 1, 1), (7, 1, 2, 0), (8, 1, 2, 0), (9, 10, 2, 0)]
    n = spark.createDataFrame([("t", i, k, s, a, b, d, 1) for i, k, s, a, b, d in node], "tu string, id long, kind_id int, spelling string, line int, end_line int, is_definition int, file_id long").selectExpr("*", "id as symbol_id")
    e = spark.createDataFrame([("t", *x) for x in edge], "tu string, src_id long, dst_id long, rel_id int, ord int")
    f = spark.createDataFrame([("t", 1, "a.cpp", 1)], "tu string, id long, path string, is_main int")
    return Trees(n, e, spark.createDataFrame([("t", 1, "u1", "helper")], "tu string, id long, usr string, name string"), f)


def test_calls_metrics_and_dead_code(trees):
    names = {r["key"]: r["spelling"] for r in trees.node.collect()}
    assert {(names[r["caller"]], names[r["callee"]]) for r in trees.calls().collect()} == {("main", "helper")}
    assert {r["spelling"] for r in trees.dead_functions().collect()} == {"lost"}
    m = {r["spelling"]: r for r in trees.metrics().collect()}
    assert m["helper"]["params"] == 1 and m["helper"]["returns"] == 1 and m["main"]["calls_out"] == 1 and m["main"]["lines"] == 6 and m["lost"]["nodes"] == 0
    assert {r["spelling"] for r in trees.unused(VAR, PARAM).collect()} == {"v"}


def test_values_flow_through_calls(trees):
    names = {r["key"]: r["spelling"] for r in trees.node.collect()}
    flow = {(names[r["a"]], names[r["b"]]) for r in trees.value_flow().collect()}
    assert flow == {("w", "v"), ("w", "p"), ("p", "v")}
    assert {(names[r["a"]], names[r["b"]]) for r in trees.influences().collect()} == flow


def test_whole_programs(trees):
    calls = {r["spelling"]: r["callees"] for r in trees.callee_names().collect()}
    assert calls == {"helper": [], "main": ["helper"], "lost": []}
    assert {(r["spelling"], r["problem"]) for r in trees.naming_problems("^[a-l].*$").collect()} == {("main", "name"), ("p", "one letter")}
    assert [r["spelling"] for r in trees.top_level().collect()] == ["helper", "main", "w", "lost"]
    assert {r["spelling"]: r["depth"] for r in trees.nesting().collect()} == {"helper": 0, "main": 0, "lost": 0}
    assert trees.shared_headers().count() == 0 and trees.references_to("u").count() == 0
    assert [(r["usr"], r["definitions"], r["references"]) for r in trees.symbol_table().collect()] == [("u1", 1, 2)] and {(r["path"], r["line"]) for r in trees.references_to("u1").collect()} == {("a.cpp", 5)}


def test_tree_program_on_the_tiny_tree(spark, trees):
    from symlattice.plans import tree_programs as P

    blank = {c: 0 for c in P.NODE}
    nodes = [tuple((blank | {"id": r["id"], "kind": r["kind_id"], "spelling": r["spelling"], "file": 1, "line": r["line"], "end_line": r["end_line"], "definition": r["is_definition"]})[c] for c in P.NODE) for r in trees.node.collect()]
    edge = [(1, 2, 1, 0), (1, 3, 1, 1), (3, 4, 1, 0), (4, 2, 2, 0), (5, 6, 1, 0), (6, 7, 1, 0), (7, 8, 1, 0), (7, 9, 1, 1), (7, 1, 2, 0), (8, 1, 2, 0), (9, 10, 2, 0)]
    tables = {
        "node": spark.createDataFrame(nodes, ", ".join(f"{c} {'string' if c == 'spelling' else 'long'}" for c in P.NODE)),
        "edge": spark.createDataFrame(edge, "a long, b long, r long, p long"),
        "file": spark.createDataFrame([(1, "a.cpp", 1)], "id long, path string, is_main long"),
        "symbol": spark.createDataFrame([], "id long, usr string, name string, kind long, linkage long"),
    }
    flow = {(r["from"], r["to"]) for r in P.run(spark, "dataflow", tables, ["value_flow_named"])["value_flow_named"].collect()}
    assert flow == {("w", "v"), ("w", "p"), ("p", "v")}
    dead = P.run(spark, "deadcode", tables, ["dead_function", "unused_var"])
    assert {r["f"] for r in dead["dead_function"].collect()} == {"lost"} and {r["var"] for r in dead["unused_var"].collect()} == {"v"}


def test_paths(spark):
    from pyspark.sql import functions as F

    from symlattice.functions import paths as P
    from symlattice.sources import facts

    df = spark.createDataFrame([("/opt/lib/v1.20", "/opt/lib", "v1.20"), ("/opt/lib/", "/opt/lib", None), ("/1.2", "/1.2", None), ("/a/b/../c/./2_0", "/a/c", "2_0")], "p string, base string, version string")
    assert all((r["s"]["base"], r["s"]["version"]) == (r["base"], r["version"]) for r in df.withColumn("s", P.split_base_version(F.col("p"))).collect())
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(P.version_key(F.lit("v18-0-0-275"))) == [18, 0, 0, 275] and one(P.normal_path(F.lit(""))) == "." and one(P.normal_path(F.lit("/../a"))) == "/a"
    labels = F.create_map(F.lit("inc"), F.lit("/usr/include"))
    assert one(P.label_expand(F.lit("-I<inc>/x:<a-b>"), labels)) == "-I/usr/include/x:/a/b" and one(P.label_expand(F.lit("<a>"), labels, derive=False)) == "<a>"
    opts = spark.createDataFrame([(["-I/r/lib/1.2/inc", "-isystem", "/usr/include/q", "-O2", "-Irel"],)], "options array<string>")
    values = P.include_values(opts)
    assert sorted((r["flag"], r["value"], r["glued"]) for r in values.collect()) == [("-I", "/r/lib/1.2/inc", True), ("-I", "rel", True), ("-isystem", "/usr/include/q", False)]
    alias = spark.createDataFrame([("lib", "/r/lib", True), ("inc", "/usr/include", False), ("usr", "/usr", False)], "name string, match_path string, versioned boolean")
    assert {r["value"]: r["encoded"] for r in P.aliased(values, alias).collect()} == {"/r/lib/1.2/inc": "<lib>/inc", "rel": "rel", "/usr/include/q": "<inc>/q"}
    comps = spark.createDataFrame([("r::lib", "/work/lib/"), ("lib", "/other")], "name string, path string")
    assert {r["value"]: r["relinked"] for r in P.relinked(values, comps).collect()} == {"/r/lib/1.2/inc": "/work/lib/inc", "rel": "rel", "/usr/include/q": "/usr/include/q"}
    assert [(r["flag"], r["share"]) for r in facts.option_uniformity(opts).where("flag = '-O2'").collect()] == [("-O2", 1.0)]


def test_tree_programs_walk_units_and_not_rounds(spark, monkeypatch):
    """Descendants are found in one go, from functions only; what the units say is checked; hot types are sent."""
    from symlattice import tree_queries as Q
    from symlattice.operators import closure as C
    from symlattice.plans import rules as R
    from symlattice.sources import adapter

    path, names = "/root/testdata/sf0.001", []
    cut = R.cut
    monkeypatch.setattr(R, "cut", lambda df, name="stage", **k: names.append(name) or cut(df, name, **k))
    with adapter.shared():
        assert Q.QUERIES["tree_metrics_body_size"](spark, path).count() == 697
    assert not {"delta", "full"} & set(names)
    # a unit that cuts the trees apart is not believed
    child = [(1, 2), (2, 3), (10, 11)]
    df = spark.createDataFrame(child, "a long, b long")
    got = C.reach(df, unit=lambda c: c % 2)
    assert {(r["a"], r["b"]) for r in got.collect()} == {(1, 2), (2, 3), (1, 3), (10, 11)}
