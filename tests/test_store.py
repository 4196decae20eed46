"""Keyed writes, cascades and commands over a small catalog."""

import json

import pytest
from pyspark.sql import functions as F
from test_graph import catalog

from symlattice import commands
from symlattice.sources import facts
from symlattice.sources.facts import Catalog
from symlattice.sources.store import Store


def test_dimensions(spark):
    s = Store(Catalog(spark))
    a = s.add_component("app", "/src/app")
    assert s.add_component("other", "/src/app") == a and s.get_component("/src/app/")["name"] == "app"
    assert s.add_component("app", "/src/app2", version="10.1") != a and s.add_component("app", "/src/app3", version="9.2")
    assert {(r["name"], r["version"], r["bumpable"]) for r in s.component_alias_index().collect()} == {("app", "10.1", True)}
    assert s.set_component_version("app", None) and not s.set_component_version("none", "1")
    f = s.add_file_path("/src/app/core/deep/x.cpp", mtime=1.5)
    assert s.file_abs_path(f) == "/src/app/core/deep/x.cpp" and s.get_file("/src/app/core/deep/x.cpp")["id"] == f
    assert not s.is_file_indexed("/src/app/core/deep/x.cpp") and s.mark_file_indexed(f) and s.is_file_indexed("/src/app/core/deep/x.cpp", 1.5) and not s.is_file_indexed("/src/app/core/deep/x.cpp", 2.0)
    assert [r["abs_path"] for r in s.list_files(a, "core").collect()] == ["/src/app/core/deep/x.cpp"] and s.list_files(a, "cor").count() == 0
    with pytest.raises(ValueError):
        s.split_path("/elsewhere/y.cpp")
    r = s.add_repository("r", remote_url="git@x")
    c = s.add_clone(r, "/work/r/")
    assert s.get_repository_by_remote("git@x")["id"] == r and s.set_active_clone(r, c) and s.active_clone_root(r) == "/work/r"
    b = s.add_component("lib", "/work/r/lib", repository_id=r)
    assert s.relativize_component(b, "/work/r") and s.component_abs_base(s.get_component_by_id(b)) == "/work/r/lib"
    s.delete_clone(c)
    assert s.active_clone_root(r) is None and s.list_clones().count() == 0
    s.delete_repository(r)
    assert s.get_component_by_id(b)["repository_id"] is None and s.list_repositories().count() == 0
    s.add_label("inc", "/usr/include")
    assert s.get_alias("inc") == "/usr/include" and s.get_alias("lib") == "lib" and s.get_alias("app") is None and s.remove_label("inc") and not s.remove_label("inc")
    with pytest.raises(RuntimeError), s.transaction():
        s.add_label("x", "y")
        raise RuntimeError
    assert s.get_label("x") is None


def test_facts(spark):
    s = Store(catalog(spark))
    s.add_edges(spark.createDataFrame([(1, 2, 1, 4), (2, 9, 7, 1)], "src_id long, dst_id long, kind int, count long"))
    e = {(r["src_id"], r["dst_id"], r["kind"]): (r["id"], r["count"]) for r in s.c["edge"].collect()}
    assert e[1, 2, 1] == (0, 5) and e[2, 9, 7][1] == 1
    s.add_edge_sites(spark.createDataFrame([(0, 1, 5, 1, 1), (0, 1, 6, 1, 1)], "edge_id long, file_id long, line int, col int, conditional int"))
    assert sorted((r["line"], r["conditional"]) for r in s.c["edge_site"].where("edge_id = 0").collect()) == [(5, 0), (6, 1)]
    minted = {r["usr"]: r["id"] for r in s.mint_symbols(spark.createDataFrame([("u1", "main"), ("new", "stub")], "usr string, spelling string")).collect()}
    assert minted["u1"] == 1 and minted["new"] > 14 and s.lookup_symbol("new")["resolved"] == 0
    assert [r["id"] for r in s.search_symbols("drwd2").collect()] == [] and [r["id"] for r in s.search_symbols("D2draw").collect()] == [12]
    assert [r["id"] for r in s.lookup_symbols_by_name("draw", "method").collect()] == [10, 11, 12]
    s.replace_diagnostics(1, spark.createDataFrame([(1, 2, "x"), (2, 3, "y")], "id long, severity int, message string"))
    assert s.get_diagnostics(1).count() == 2 and {(r["severity"], r["n"]) for r in s.diagnostic_counts().collect()} == {(2, 1), (3, 1)}
    assert s.resolve_pass()[1] >= 1 and s.c["entity_edge"].count() > 0


def test_cascades(spark):
    c = catalog(spark)
    defs = spark.createDataFrame([(1, 3, 1, 2), (2, 1, 1, 1), (3, 12, 2, 3)], "id long, symbol_id long, component_id long, file_id long")
    c = c.replaced(
        definition=defs,
        def_edge=spark.createDataFrame([(1, 2, 3, 1, 1), (2, 2, 2, 1, 1), (3, 1, 2, 1, 1)], "id long, src_def_id long, dst_id long, kind int, count long"),
        possible_call=spark.createDataFrame([(2, 1, 1), (2, 3, 1)], "src_def_id long, dst_def_id long, count long"),
        decl_site=spark.createDataFrame([(3, 1), (1, 2), (1, 1)], "symbol_id long, file_id long"),
        template_arg=spark.createDataFrame([(9, 0, 1, 8), (8, 0, 1, 9)], "owner_id long, position int, arg_kind int, ref_id long"),
        template_param=spark.createDataFrame([(8, 0), (9, 0)], "owner_id long, position int"),
        entity_node=spark.createDataFrame([(7, 2), (9, 1)], "id long, kind int"),
        entity_edge=spark.createDataFrame([(9, 8, 1, None), (9, 9, 8, 11), (9, 9, 1, None)], "src_id long, dst_id long, kind int, via_member_id long"),
        diagnostic=spark.createDataFrame([(1, 2), (2, 3)], "id long, file_id long"),
    )
    s = Store(c)
    s.delete_file(2)  # symbols 3, 4, 7, 8, 10, 11, 13, 14
    t = s.c
    assert sorted(r["id"] for r in t["symbol"].collect()) == [1, 2, 5, 6, 9, 12]
    assert {(r["src_id"], r["dst_id"]) for r in t["edge"].collect()} == {(1, 2), (2, 6), (2, 5), (12, 9)}
    assert {r["edge_id"] for r in t["edge_site"].collect()} == {0} and sorted(r["id"] for r in t["definition"].collect()) == [2, 3]
    assert [r["id"] for r in t["def_edge"].collect()] == [2] and [(r["src_def_id"], r["dst_def_id"]) for r in t["possible_call"].collect()] == [(2, 3)]
    assert [(r["symbol_id"], r["file_id"]) for r in t["decl_site"].collect()] == [(1, 1)] and [r["owner_id"] for r in t["template_param"].collect()] == [9]
    assert [(r["owner_id"], r["ref_id"]) for r in t["template_arg"].collect()] == [(9, None)] and [r["id"] for r in t["entity_node"].collect()] == [9]
    assert sorted(((r["dst_id"], r["kind"], r["via_member_id"]) for r in t["entity_edge"].collect()), key=str) == [(9, 1, None), (9, 8, None)]
    assert [r["file_id"] for r in t["diagnostic"].collect()] == [3]
    s.delete_component(2)
    assert [r["id"] for r in s.c["file"].collect()] == [1] and sorted(r["id"] for r in s.c["symbol"].collect()) == [1, 2, 5, 6]


def test_compile_commands(spark, tmp_path):
    held = [
        {"directory": "/b", "file": "x.cpp", "command": "ccache /usr/bin/c++ -DNAME=\"a b\" '-I/inc dir' -c x.cpp"},
        {"directory": "/b", "file": "y.cpp", "command": "env LANG=C g++ -O2 y.cpp"},
        {"directory": "/b", "file": "z.cpp", "arguments": ["clang++", "-DX=1", "z.cpp"]},
        {"directory": "/b", "file": "w.cpp", "command": "c++ -D'broken w.cpp"},
    ]
    (tmp_path / "db.json").write_text(json.dumps(held))
    got = {r["file"]: r["options"] for r in facts.compile_commands(spark, f"file://{tmp_path}/db.json").collect()}
    assert got == {"x.cpp": ["-DNAME=a b", "-I/inc dir", "-c", "x.cpp"], "y.cpp": ["-O2", "y.cpp"], "z.cpp": ["-DX=1", "z.cpp"], "w.cpp": ["-D'broken", "w.cpp"]}


def test_commands(spark, tmp_path):
    path = f"file://{tmp_path}/snapshot"
    c = catalog(spark)
    c.write(f"{path}/1")
    run = lambda *a: commands.run(spark, path, *a)
    assert [r["peer"] for r in run("callers", "helper").collect()] == [1] and [r["peer"] for r in run("callees", "helper").collect()] == [3, 6]
    assert {r["peer"] for r in run("refs", "g_config").collect()} == {2} and run("path", "main", "compute") == [1, 2, 3]
    assert [r["peer"] for r in run("hierarchy", "Base", "down").collect()] == [8, 9] and sorted(r["peer"] for r in run("dispatch", "Base::draw").collect()) == [11, 12]
    assert [r["node"] for r in run("walk", "main").where("depth = 2").collect()] == [3, 6] and run("search", "cmpt").count() == 1
    assert run("verify").count() == 0 and run("show-file", "/src/app/core/a.cpp").count() == 3
    run("label-add", "inc", "/usr/include")
    run("resolve")
    assert run("label-resolve", "inc") == "/usr/include" and run("classes", "Derived").count() > 0
    run("delete-symbol", "helper")
    assert run("search", "helper").count() == 0 and [r["peer"] for r in run("callers", "compute").collect()] == [] and run("stats").where("what = 'edge'").count() > 0
    with pytest.raises(SystemExit):
        run("nonsense")
