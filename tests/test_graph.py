"""The graph engine on a small seeded graph: every direction of every relation, and the recursive operators."""

import pytest
from pyspark.sql import functions as F

from symlattice.functions import names as N
from symlattice.functions import types as T
from symlattice.operators import closure as C
from symlattice.operators import resolve as R
from symlattice.operators.components import connected_components
from symlattice.operators.entity import EntityGraph
from symlattice.operators.graph import Graph, NoEdgesError
from symlattice.plans.pattern import Engine, ParseError, parse
from symlattice.plans.rules import Program, RuleError
from symlattice.schemas import EDGE_KIND, SYMBOL_KIND
from symlattice.sources.facts import Catalog, component_of_path, merge_symbols, replace_file, upsert
from symlattice.staging import cut

K, E = SYMBOL_KIND, EDGE_KIND
SYMBOLS = [
    # id, spelling, qualified name, kind, type, pure, access, owner, file
    (1, "main", "main", K["function"], "int ()", 0, None, None, 1),
    (2, "helper", "helper", K["function"], "void ()", 0, None, None, 1),
    (3, "compute", "compute", K["function"], "int (int)", 0, None, None, 2),
    (4, "render", "render", K["function"], "void (Base &)", 0, None, None, 2),
    (5, "g_config", "g_config", K["variable"], "int", 0, None, None, 1),
    (6, "ext_fn", "ext_fn", K["function"], None, 0, None, None, None),
    (7, "Base", "Base", K["class"], None, 0, None, None, 2),
    (8, "Derived", "Derived", K["class"], None, 0, None, None, 2),
    (9, "Derived2", "Derived2", K["class"], None, 0, None, None, 3),
    (10, "draw", "Base::draw", K["method"], "void ()", 1, "public", "u7", 2),
    (11, "draw", "Derived::draw", K["method"], "void ()", 0, "public", "u8", 2),
    (12, "draw", "Derived2::draw", K["method"], "void ()", 0, "public", "u9", 3),
    (13, "x", "Base::x", K["member"], "std::vector<std::shared_ptr<Derived>>", 0, "private", "u7", 2),
    (14, "Nested", "Base::Nested", K["struct"], None, 0, "public", "u7", 2),
]
EDGES = [
    (1, 2, "calls"), (2, 3, "calls"), (2, 6, "calls"), (4, 10, "calls"), (2, 5, "uses"), (8, 7, "inherits"), (9, 8, "inherits"),
    (11, 10, "overrides"), (12, 11, "overrides"), (13, 7, "field_of"), (10, 7, "method_of"), (11, 8, "method_of"), (12, 9, "method_of"), (7, 14, "contains"),
]


def catalog(spark):
    rows = [(i, f"u{i}", s, q, s + ("()" if k in (K["function"], K["method"]) else ""), k, t, f, i, 1 if f else 0, p, a, o, 1 if f else 0) for i, s, q, k, t, p, a, o, f in SYMBOLS]
    symbol = spark.createDataFrame(rows, "id long, usr string, spelling string, qual_name string, display_name string, kind int, type_info string, file_id long, line int, is_definition int, is_pure int, access string, parent_usr string, resolved int")
    edge = spark.createDataFrame([(n, a, b, E[k], 1) for n, (a, b, k) in enumerate(EDGES)], "id long, src_id long, dst_id long, kind int, count long")
    site = spark.createDataFrame([(0, 1, 5, 1, 0), (1, 1, 7, 1, 0), (1, 1, 8, 1, 1)], "edge_id long, file_id long, line int, col int, conditional int")
    comp = spark.createDataFrame([(1, "app", "/src/app"), (2, "lib", "/src/lib")], "id long, name string, path string")
    folder = spark.createDataFrame([(1, 1, "core"), (2, 2, "")], "id long, component_id long, path string")
    file = spark.createDataFrame([(1, 1, "a.cpp"), (2, 1, "b.hpp"), (3, 2, "c.cpp")], "id long, directory_id long, name string")
    return Catalog(spark, {"symbol": symbol, "edge": edge, "edge_site": site, "component": comp, "directory": folder, "file": file})


@pytest.fixture(scope="module")
def g(spark):
    return Graph(catalog(spark))


@pytest.fixture(scope="module")
def resolved(spark):
    return R.resolve(catalog(spark))


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_hops_and_members(g):
    assert pairs(g.callers(2).select("id", "peer")) == {(2, 1)}
    assert pairs(g.references([5, 3]).select("id", "peer")) == {(5, 2), (3, 2)}
    assert pairs(g.members(7)) == {(7, 13), (7, 10), (7, 14)}
    assert pairs(g.members(7, "public")) == {(7, 10), (7, 14)}
    counts = {r["peer"]: r["count"] for r in g.edges_out(2, ["calls"]).collect()}
    assert counts == {3: 2, 6: 1}  # by sites, and never below one
    with pytest.raises(ValueError):
        g.edges_out(2, ["nonsense"])
    with pytest.raises(ValueError):
        g.pairs(["calls"], "sideways")


def test_hierarchy_and_dispatch(g):
    assert pairs(g.subclasses(7)) == {(7, 8)}
    assert pairs(g.subclasses(7, direct=False)) == {(7, 8), (7, 9)}
    assert pairs(g.bases(9, direct=False)) == {(9, 8), (9, 7)}
    assert pairs(g.dispatch_targets(10)) == {(10, 11), (10, 12)}
    assert pairs(g.virtual_callees(4)) == {(4, 10)}
    assert pairs(g.dispatch_selection(10)) == {(10, 8, 11), (10, 9, 12)}


def test_find_tiers_and_paths(g):
    assert [r["id"] for r in g.find("draw").collect()] == [10, 11, 12]
    assert [r["name"] for r in g.find("DERIVED").collect()][:2] == ["Derived", "Derived2"]
    assert [r["id"] for r in g.find("ase::dra").collect()] == [10]
    assert g.reaches(1, 3) == [1, 2, 3]
    assert g.reaches(3, 1) is None and g.reaches(1, 1) == [1]
    assert {r["path"] for r in g.files().collect()} == {"/src/app/core/a.cpp", "/src/app/core/b.hpp", "/src/lib/c.cpp"}
    walk = {r["node"]: r["depth"] for r in g.walk(1, ["calls"], depth=2).collect()}
    assert walk == {1: 0, 2: 1, 3: 2, 6: 2}
    assert g.walk(1, ["calls"], max_nodes=3).count() == 3


def test_no_edges(spark):
    with pytest.raises(NoEdgesError):
        Graph(Catalog(spark)).require_edges()


CYCLE = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7)]


@pytest.mark.parametrize("small", [0, 1000])
def test_reach(spark, small):
    e = spark.createDataFrame([*CYCLE, (7, None)], "a long, b long")
    got = {(r["a"], r["b"]): r["depth"] for r in C.reach(e, small=small).collect()}
    want = {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)} | {(5, 5), (6, 7)}
    assert set(got) == want and got[1, 1] == 3 and got[2, 4] == 2
    seeds = spark.createDataFrame([(6,), (99,)], "x long")
    assert pairs(C.reach(e, seeds, small=small).select("a", "b")) == {(6, 7)}
    assert C.reach(e.limit(0), small=small).count() == 0


def test_cones_are_mirror_images(spark):
    e = spark.createDataFrame(CYCLE, "a long, b long")
    seed = spark.createDataFrame([(4,)], "x long")
    back = pairs(C.cone(e, seed, forward=False))
    assert back == {(1, 2), (2, 3), (3, 1), (3, 4)}
    assert {(b, a) for a, b in back} == pairs(C.cone(C.backward(e), seed))


def test_roots_stop_at_cycles(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (4, 3)], "node long, next long")
    assert pairs(C.roots(p)) == {(1, 3), (2, 3), (4, 3)}


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (6, 6), (None, 2)], "a long, b long")
    assert pairs(connected_components(e)) == {(n, 3) for n in (3, 4, 5, 9)} | {(7, 7), (8, 7)}
    assert connected_components(e.limit(0)).count() == 0


def test_resolve(spark, resolved):
    dispatch = resolved["edge"].where(F.col("kind") == E["dispatch_calls"])
    assert pairs(dispatch.select("src_id", "dst_id")) == {(4, 11), (4, 12)}
    assert pairs(resolved["edge"].where("src_id = 2 and dst_id = 3").select("count")) == {(2,)}
    nodes = dict(pairs(resolved["entity_node"]))
    assert nodes[7] == 2 and nodes[8] == 1 and nodes[14] == 1  # Base has a field, so it is abstract and no interface
    ent = pairs(resolved["entity_edge"].select("src_id", "dst_id", "kind", "multiplicity"))
    assert {(8, 7, 1, 1), (9, 8, 1, 1), (7, 8, 5, 3)} <= ent
    again = R.resolve(resolved)
    key = ["src_id", "dst_id", "kind", "count"]
    assert pairs(again["edge"].select(key)) == pairs(resolved["edge"].select(key))
    assert pairs(again["entity_edge"].select(key)) == pairs(resolved["entity_edge"].select(key))


def test_entity_query(resolved):
    eg = EntityGraph(Graph(resolved))
    q = eg.query("Base").derived(transitive=True)
    assert [r["name"] for r in q.names().collect()] == ["Derived", "Derived2"]
    assert eg.query("Derived").aggregated_in().count() == 1
    assert eg.query("Base").aggregates().edges().count() == 1
    assert q.exclude("Derived2").count() == 1 and q.named("2").first()["id"] == 9
    assert eg.query().abstract().count() == 1 and bool(eg.query("Base").interfaces()) is False
    with pytest.raises(AttributeError):
        eg.query("Base").nonsense()


def test_patterns(resolved):
    run = Engine(Graph(resolved)).run
    names = lambda text: sorted(r[0] for r in run(text).collect())
    assert names('match function f where "main" calls+ f select f.name') == ["compute", "ext_fn", "helper"]
    assert names('match function f where f calls+ "compute" select f.name') == ["helper", "main"]
    assert names('match class c where c inherits+ "Base" select c.name') == ["Derived", "Derived2"]
    assert names('match class c where c implements+ "Base" select c.name') == ["Base", "Derived", "Derived2"]
    assert names('match method m where m.is_pure = "True" or not m.name ~ "Base" select m.name') == ["Base::draw", "Derived2::draw", "Derived::draw"]
    assert names('match function f where f.access != "public" select f.name') == ["compute", "ext_fn", "helper", "main", "render"]
    both = {tuple(r) for r in run("match class a, class b where a inherits+ b select a.name, b.name").collect()}
    assert both == {("Derived", "Base"), ("Derived2", "Base"), ("Derived2", "Derived")}
    assert [r["name"] for r in run('show path from "main" to "compute" via calls').collect()] == ["main", "helper", "compute"]
    top = run("rank f in match method f select f by count(callers+ f) desc limit 2").collect()
    assert [r["score"] for r in top] == [1, 1]
    assert run("match class c select count(c)").collect()[0][0] == 3
    for bad in ("match", "match class c select d", "match class c where c.name % \"x\" select c", 'match class c where "a" inherits+ "b" select c'):
        with pytest.raises(ParseError):
            parse(bad)


def test_rules(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "d")], "x string, y string")
    text = """
    .decl r(x: symbol, y: symbol)
    r(x, y) :- e(x, y).
    r(x, z) :- r(x, y), r(y, z).   // not linear
    .decl cyc(x: symbol)
    cyc(x) :- r(x, x).
    .decl free(x: symbol)
    free(x) :- e(x, _), !cyc(x).
    .decl deg(x: symbol, n: number)
    deg(x, n) :- e(x, _), n = count : { r(x, _) }.
    .decl big(x: symbol)
    big(x) :- deg(x, n), n >= 2, x != "b".
    """
    out = Program(text).run(spark, {"e": e})
    assert pairs(out["r"]) == {("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "b"), ("c", "c"), ("d", "d")}
    assert pairs(out["cyc"]) == {("b",), ("c",), ("d",)} and pairs(out["free"]) == {("a",)}
    assert dict(pairs(out["deg"])) == {"a": 2, "b": 2, "c": 2, "d": 1} and pairs(out["big"]) == {("a",), ("c",)}
    with pytest.raises(RuleError):
        Program("p(x) :- e(x, _), !p(x).").run(spark, {"e": e})


def test_type_spellings():
    composes, aggregates, associates = 4, 5, 6
    cases = {
        "Foo": (composes, 1), "const Foo": (composes, 1), "Foo *": (associates, 2), "Foo &": (associates, 2), "Foo[4]": (composes, 4),
        "std::unique_ptr<Foo>": (composes, 2), "std::optional<Foo>": (composes, 2), "std::shared_ptr<Foo>": (aggregates, 2), "std::weak_ptr<Foo>": (associates, 2),
        "std::vector<Foo>": (composes, 3), "std::vector<Foo *>": (associates, 3), "std::map<Key, Foo>": (composes, 3), "std::vector<std::shared_ptr<Foo>>": (aggregates, 3),
        "map<Key, Foo>": (composes, 1),
    }
    assert {k: T.ownership(k) for k in cases} == cases
    assert T.core("const std::map<K, std::vector<Foo *>> &") == "Foo"
    assert T.split_top("a, b<c, d>, (e, f)") == ["a", "b<c, d>", "(e, f)"]
    assert T.parse_signature("int (std::map<a, b>, char) const") == ("int", ["std::map<a, b>", "char"])
    assert T.same_type("std::string", "string") and not T.same_type("int", "long")


def test_display_names_never_collide(spark):
    rows = [(1, "a", "f", "n::f", "f(int)", 8, 1, 3), (2, "b", "f", "n::f", "f(char)", 8, 1, 4), (3, "c", "g", "g", "g()", 8, 1, 5), (4, "d", "g", "g", "g()", 8, 2, 5), (5, "e", "h", None, None, 8, 1, 1), (6, "x", "h", None, None, 8, 1, 1)]
    s = spark.createDataFrame(rows, "id long, usr string, spelling string, qual_name string, display_name string, kind int, file_id long, line int")
    f = spark.createDataFrame([(1, "a.cpp"), (2, "b.cpp")], "id long, name string")
    got = dict(pairs(N.display_names(Catalog(spark, {"symbol": s, "file": f}))))
    assert got == {1: "n::f(int)", 2: "n::f(char)", 3: "g() @a.cpp:5", 4: "g() @b.cpp:5", 5: "h @a.cpp:1 [1]", 6: "h @a.cpp:1 [2]"}


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, seq long")
    assert pairs(upsert(old, new, ["id"], "seq")) == {(1, "a"), (2, "d"), (3, "e")}
    files = spark.createDataFrame([(7,)], "id long")
    t = spark.createDataFrame([(7, "x"), (8, "y")], "file_id long, v string")
    assert pairs(replace_file(t, t.where("file_id = 7").withColumn("v", F.lit("z")), files)) == {(7, "z"), (8, "y")}
    c = spark.createDataFrame([(1, "/a"), (2, "/a/b")], "id long, path string")
    p = spark.createDataFrame([("/a/b/c.h",), ("/a/bc.h",), ("/z",)], "path string")
    assert pairs(component_of_path(p, c)) == {("/a/b/c.h", 2), ("/a/bc.h", 1), ("/z", None)}


def test_merge_symbols(spark):
    empty = Catalog(spark)["symbol"]
    rows = [("u", "f", None, 8, 1, 10, 1, 0, 1), ("u", "f", "n::f", 8, 2, 20, 0, 1, 2), ("w", "g", "g", 8, 1, 1, 0, 0, 3)]
    new = spark.createDataFrame(rows, "usr string, spelling string, qual_name string, kind int, file_id long, line int, is_definition int, is_pure int, seq long")
    got = {r["usr"]: r for r in cut(merge_symbols(empty, new)).collect()}
    assert got["u"]["file_id"] == 1 and got["u"]["qual_name"] == "n::f" and got["u"]["is_pure"] == 1 and got["u"]["is_definition"] == 1
    assert len({got["u"]["id"], got["w"]["id"]}) == 2


def test_a_recursion_that_is_not_done_is_an_error(spark):
    edge = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")
    p = Program(".decl far(a, b)\nfar(a, b) :- step(a, b).\nfar(a, c) :- far(a, b), step(b, c).\n")
    assert p.run(spark, {"step": edge})["far"].count() == 36
    with pytest.raises(RuleError):
        p.run(spark, {"step": edge}, most_rounds=2)


def test_only_what_is_wanted_runs(spark):
    p = Program("a(x) :- in(x).\nb(x) :- missing(x).\nc(n) :- n = count : { in(_) }.\n")
    got = p.run(spark, {"in": spark.createDataFrame([(1,), (2,)], "x long")}, ["a", "c"])
    assert sorted(r[0] for r in got["a"].collect()) == [1, 2] and got["c"].first()[0] == 2 and p.reads(["a"]) == ["in"]


def test_programs_on_the_seeded_graph(spark):
    from symlattice.plans import programs

    c = R.resolve(catalog(spark))
    one = lambda x: spark.createDataFrame([(x,)], "name string")
    got = programs.run("callgraph", c, seeds=one("main()"))
    assert {tuple(r) for r in got["call_edge"].collect()} == {("main()", "helper()"), ("helper()", "compute()"), ("helper()", "ext_fn()")}
    assert got["recursive"].count() == 0 and {r["line"] for r in got["call_location"].where("caller = 'helper()'").collect()} == {7, 8, 0}
    up = programs.run("hierarchy", c, seeds=one("Derived2"))
    assert {r["base"] for r in up["ancestor"].collect()} == {"Derived", "Base"}
    hit = programs.run("impact", c, seeds=one("compute()"))
    assert {r["caller"] for r in hit["impacts"].collect()} == {"helper()", "main()"} and hit["blast_radius"].first()["callers"] == 2
    way = programs.run("all_paths", c, ["path_node", "path_exists"], seeds=one("main()"), targets=one("compute()"))
    assert {r["node"] for r in way["path_node"].collect()} == {"main()", "helper()", "compute()"} and way["path_exists"].count() == 1
    assert programs.run("callgraph", c, ["reachable"])["reachable"].count() == 0


def test_programs_run_on_numbers_and_names_come_last(spark, monkeypatch):
    """Closures of calls see ids; a name that no symbol has stays; a name of two symbols is one node."""
    from symlattice.plans import programs, rules

    seen = []
    reach = rules.reach
    monkeypatch.setattr(rules, "reach", lambda e, *a, **k: seen.extend(f.dataType.typeName() for f in e.schema) or reach(e, *a, **k))
    c = R.resolve(catalog(spark))
    seeds = spark.createDataFrame([("helper()",), ("nobody",)], "name string")
    assert {r["callee"] for r in programs.run("callgraph", c, ["call_edge"], seeds=seeds)["call_edge"].collect()} == {"compute()", "ext_fn()"}
    assert seen == ["long", "long"]
    assert pairs(programs.run("metrics", c, ["fan_out"], seeds=seeds)["fan_out"]) == {("helper()", 2), ("nobody", 0)}
    twice = spark.createDataFrame([(1, "f"), (2, "f"), (3, "g")], "id long, name string")
    assert pairs(programs.coded(twice)) == {(1, "f", 1), (2, "f", 1), (3, "g", 3)}
