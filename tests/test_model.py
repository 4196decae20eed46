"""Selectors, call order, pruned dispatch and streaming ingest on the seeded graph."""

from pyspark.sql import functions as F
from test_graph import catalog

from symlattice.operators import resolve as R
from symlattice.operators.graph import Graph
from symlattice.operators.model import CodeBase
from symlattice.streaming.ingest import FileIngest


def test_selectors_and_order(spark):
    cb = CodeBase(Graph(R.resolve(catalog(spark))))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(cb.function("compute", "int(int)")) == [3] and ids(cb.function("int compute(char)")) == []
    assert ids(cb.method("draw", owner="Derived")) == [11] and ids(cb.method("draw")) == [10, 11, 12]
    assert ids(cb.klass("Derived")) == [8] and ids(cb.abstract_class("Base")) == [7] and ids(cb.interface("Base")) == []
    assert ids(cb.abstract_records()) == [7]
    assert cb.callgraph_order(1) == [(2, 1), (3, 2), (6, 2)]
    assert {r["peer"] for r in cb.ordered_callees(4).collect()} == {10, 11, 12}


def test_pruned_dispatch(spark):
    c = catalog(spark)
    site = spark.createDataFrame([(3, 2, 30, 1, 0), (3, 2, 31, 1, 0)], "edge_id long, file_id long, line int, col int, conditional int")
    args = spark.createDataFrame([(3, 2, 30, 1, -1, "construct", "u9", None)], "edge_id long, file_id long, line int, col int, position int, src_kind string, type_usr string, decl_usr string")
    c = c.replaced(edge_site=c["edge_site"].unionByName(site), call_arg=args)
    rows = CodeBase(Graph(c)).virtual_sites().collect()
    kept = {(r["line"], r["target"]) for r in rows if r["kept"]}
    assert kept == {(30, 12), (31, 11), (31, 12)}


def test_types_flow_over_any_number_of_arguments(spark):
    n = 40
    symbol = spark.createDataFrame([(100 + i, f"f{i}") for i in range(n)], "id long, usr string")
    edge = spark.createDataFrame([(i, 1, 100 + i, 1) for i in range(n)], "id long, src_id long, dst_id long, kind int")
    args = [(0, 0, "construct", "A", None), *[(i, 0, "param", None, f"f{i - 1}#0") for i in range(1, n)], (n - 1, 0, "construct", "B", None)]
    c = catalog(spark).replaced(symbol=symbol, edge=edge, call_arg=spark.createDataFrame(args, "edge_id long, position int, src_kind string, type_usr string, decl_usr string").withColumn("type_is_value", F.lit(0)))
    types = {r["usr"]: (r["types"], r["top"]) for r in CodeBase(Graph(c)).receiver_types().collect()}
    assert types[f"f{n - 1}#0"] == (["A", "B"], False) and all(types[f"f{i}#0"] == (["A"], False) for i in range(n - 1))


def test_streamed_files_replace_themselves_and_survive_a_restart(spark, tmp_path):
    folder, checkpoint, source = (f"file://{tmp_path}/{x}" for x in ("table", "cp", "in"))
    rows = spark.createDataFrame([(1, 7, 1, 1), (2, 8, 1, 1)], "symbol_id long, file_id long, line int, col int")

    def run():
        ingest = FileIngest(spark, "decl_site", folder)
        ingest.run(spark.readStream.schema(rows.schema).parquet(source), checkpoint).awaitTermination()
        return {(r["file_id"], r["line"]) for r in ingest.current.collect()}

    rows.coalesce(1).write.parquet(source)
    assert run() == {(7, 1), (8, 1)}
    rows.where("file_id = 7").withColumn("line", F.lit(9)).coalesce(1).write.mode("append").parquet(source)
    assert run() == {(7, 9), (8, 1)} and run() == {(7, 9), (8, 1)}
    again = FileIngest(spark, "decl_site", folder)
    again.apply(rows, 0)  # delivered twice
    assert {(r["file_id"], r["line"]) for r in again.current.collect()} == {(7, 9), (8, 1)}


def test_records_and_namespaces(spark):
    c = catalog(spark)
    more = spark.createDataFrame([(20, "app", "app", 22, None), (21, "Box", "app::Box", 31, None), (22, "kMax", "app::kMax", 9, "const int"), (23, "Box", "app::Box<int>", 4, None)], "id long, spelling string, qual_name string, kind int, type_info string").withColumn("usr", F.concat(F.lit("u"), "id"))
    e = spark.createDataFrame([(90, 20, 21, 3), (91, 20, 22, 3), (92, 23, 21, 4), (93, 20, 7, 3)], "id long, src_id long, dst_id long, kind int")
    arg = spark.createDataFrame([(23, 0, 1, 8, None), (23, 1, 2, None, "4")], "owner_id long, position int, arg_kind int, ref_id long, literal string")
    c = c.replaced(symbol=c["symbol"].unionByName(more, allowMissingColumns=True), edge=c["edge"].unionByName(e, allowMissingColumns=True), template_arg=arg)
    cb = CodeBase(Graph(c))
    peers = lambda df: sorted((r["id"], r["peer"]) for r in df.collect())
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(cb.namespace_class_templates("app")) == [21] and ids(cb.namespace_variables("app")) == [22] == ids(cb.constants("app")) and ids(cb.namespace_classes("app")) == [7]
    assert ids(cb.namespace_functions("app")) == [] and ids(cb.namespaces_in("app")) == [] == ids(cb.namespace_enums("app"))
    assert peers(cb.fields(7)) == [(7, 13)] and peers(cb.methods([7, 8])) == [(7, 10), (8, 11)] and peers(cb.owner(11)) == [(11, 8)]
    assert peers(cb.parents(9)) == [(9, 8)] and peers(cb.ancestors(9)) == [(9, 7), (9, 8)] and peers(cb.children(7)) == [(7, 8), (7, 9)]
    assert {r["id"]: r["class_kind"] for r in cb.class_kinds([7, 8]).collect()} == {7: "abstract", 8: "concrete"}
    assert {r["id"]: r["abstract"] for r in cb.is_abstract([7, 8]).collect()} == {7: True, 8: False}
    assert {r["id"]: r["virtual"] for r in cb.is_virtual([3, 10, 12]).collect()} == {3: False, 10: True, 12: True}
    assert {r["id"]: (r["returns"], r["arguments"]) for r in cb.signatures([3, 6]).collect()} == {3: ("int", ["int"]), 6: (None, None)}
    assert peers(cb.primary_template(23)) == [(23, 21)] and peers(cb.specializations(21)) == [(21, 23)]
    assert cb.specialized_types(23).first()["types"] == ["Derived", "4"] and peers(cb.specialized_type_entities(23)) == [(23, 8)]
    assert cb.definition(1).first()["path"] == "/src/app/core/a.cpp" and cb.declaration(1).count() == 0
    g = cb.g
    assert sorted((r["caller"], r["method"]) for r in g.virtual_call_sites().collect()) == []
    assert g.path_to(1, 6, ["calls"]) == [1, 2, 6] and g.path_to(6, 1, ["calls"]) == [] and ids(g.records_by_name("Base")) == [7]


def test_entity_nodes(spark):
    from symlattice.operators.entity import EntityGraph

    eg = EntityGraph(Graph(R.resolve(catalog(spark))))
    base = eg.entity("u7")
    assert base.name == "Base" and base.is_abstract and base.class_kind == "abstract" and base.location == "/src/app/core/b.hpp:7"
    assert sorted(r["id"] for r in base.walk("generalizes", "in")) == [8, 9] and len(base.implemented_by()) == 1
    assert sorted(r["method"] for r in base.operations().collect()) == [10] and base.primary_template() is None
    assert eg.entity(1) is None and [r["src_id"] for r in eg][0] == 7 and len(eg.query().of_class_kind("concrete")) >= 2
