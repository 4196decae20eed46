"""Lookups, hops and walks over the code graph. Every operator returns a DataFrame, batch-wise where it can:
the symbols asked about are a DataFrame of ids, a list, or one id."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlattice.functions.names import kind_names
from symlattice.operators.closure import backward, path, reach, tree
from symlattice.schemas import EDGE_KIND, ENTITY_KIND, SYMBOL_KIND, kind_ids
from symlattice.sources.facts import Catalog

#: Steps that hierarchies are followed, at most; None: all the way.
DEEP = None


class NoEdgesError(RuntimeError):
    """The graph layer is empty."""


def escape_like(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def fuzzy(text: str) -> str:
    """A LIKE pattern for the characters of a text in order, blanks left out."""
    return "%" + "%".join(escape_like(c) for c in text if not c.isspace()) + "%"


def ascii_fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Graph:
    """The imperative query surface over a catalog."""

    def __init__(self, catalog: Catalog):
        self.c, self.spark = catalog, catalog.spark

    # --- plumbing

    def ids(self, what, name: str = "id") -> DataFrame:
        if isinstance(what, DataFrame):
            return what.select(F.col(what.columns[0]).cast("long").alias(name)).distinct()
        rows = [(int(x),) for x in ([what] if isinstance(what, int) else what)]
        return self.spark.createDataFrame(rows, f"{name} long").distinct()

    def only(self, df: DataFrame, what, column: str = "id") -> DataFrame:
        """The rows of df for the symbols asked about; None: all."""
        return df if what is None else df.join(self.ids(what, column), column, "left_semi")

    def files(self) -> DataFrame:
        """(file_id, path, component): absolute paths by component, folder and name."""
        f, d, c = self.c["file"], self.c["directory"], self.c["component"]
        root = F.when(F.col("version").isNotNull(), F.concat_ws("/", "c_path", "version")).otherwise(F.col("c_path"))
        x = f.select(F.col("id").alias("file_id"), "name", "directory_id").join(d.select(F.col("id").alias("directory_id"), "component_id", F.col("path").alias("d_path")), "directory_id")
        x = x.join(c.select(F.col("id").alias("component_id"), F.col("path").alias("c_path"), F.col("name").alias("component"), "version"), "component_id")
        return x.select("file_id", F.concat_ws("/", root, F.when(F.col("d_path") != "", F.col("d_path")), "name").alias("path"), "component")

    def symbols(self) -> DataFrame:
        """Symbols with kind by name, path, component and whether they are stubs."""
        s = self.c["symbol"]
        stub = (F.coalesce("resolved", F.lit(0)) == 0) & F.col("file_id").isNull() & F.col("decl_file_id").isNull()
        return s.join(self.files(), "file_id", "left").withColumns({"kind_name": F.coalesce(F.try_element_at(kind_names(), F.col("kind")), F.lit("unknown")), "name": F.coalesce("qual_name", "spelling"), "is_stub": stub})

    def edge_count(self) -> int:
        return self.c["edge"].count()

    def require_edges(self) -> None:
        if self.c["edge"].isEmpty():
            raise NoEdgesError("the index has no edges")

    def is_resolved(self) -> bool:
        return not self.c["meta"].where("key = 'graph_resolved_at'").isEmpty()

    def edges(self, kinds=None) -> DataFrame:
        e = self.c["edge"]
        return e if kinds is None else e.where(F.col("kind").isin(kind_ids(kinds)))

    def pairs(self, kinds, direction: str = "out") -> DataFrame:
        if direction not in ("out", "in"):
            raise ValueError(f"direction: {direction}")
        e = self.edges(kinds).select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
        return e if direction == "out" else backward(e)

    # --- lookup

    def get(self, ident) -> DataFrame:
        """The symbol of an id or a usr."""
        return self.symbols().where(F.col("usr") == ident if isinstance(ident, str) else F.col("id") == int(ident))

    def find(self, pattern: str, kind: str | None = None, limit: int | None = 50) -> DataFrame:
        """Symbols by name, best tier only: equal (spelling or qualified name), beginning with the pattern,
        or holding its ::-separated parts in order; the latter two whatever the case of A to Z.
        Shortest names first."""
        s = self.symbols()
        if kind is not None:
            s = s.where(F.col("kind").isin(kind_ids([kind], SYMBOL_KIND)))
        order = [F.length("name"), "name", "id"]
        if not pattern:
            return self._first(s.orderBy(*order), limit)
        low = ascii_fold(F.col("name"))
        text = pattern.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        parts = "%" + "%".join(escape_like(p) for p in text.split("::") if p) + "%"
        equal = (F.col("name") == pattern) | (F.col("spelling") == pattern)
        head = low.startswith(text) | ascii_fold(F.col("spelling")).startswith(text)
        tier = F.when(F.coalesce(equal, F.lit(False)), 1).when(F.coalesce(head, F.lit(False)), 2).when(F.coalesce(low.like(parts), F.lit(False)), 3)
        told = s.withColumn("tier", tier).where("tier is not null")
        best = told.agg(F.min("tier").alias("best"))
        return self._first(told.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best").orderBy(*order), limit)

    @staticmethod
    def _first(df: DataFrame, limit: int | None) -> DataFrame:
        return df if limit is None else df.limit(limit)

    def by_name(self, spelling: str, kind: str | None = None) -> DataFrame:
        s = self.symbols().where(F.col("spelling") == spelling)
        return (s if kind is None else s.where(F.col("kind").isin(kind_ids([kind], SYMBOL_KIND)))).orderBy("usr")

    def by_qual_or_spelling(self, *names: str, limit: int = 200) -> DataFrame:
        return self.symbols().where(F.col("qual_name").isin(*names) | F.col("spelling").isin(*names)).orderBy(F.length("name"), "name", "id").limit(limit)

    def symbols_in_file(self, part: str, limit: int = 500) -> DataFrame:
        return self.symbols().where(F.contains("path", F.lit(part))).orderBy("path", "line", "col", "id").limit(limit)

    # --- one hop

    def hops(self, what=None, direction: str = "out", kinds=None, limit: int | None = 500) -> DataFrame:
        """(id, peer, kind, count, edge_id): edges at the symbols asked about (None: all). The count is the
        edge's if the graph is resolved, else that of its sites, and never below 1; most counted first."""
        own, peer = ("src_id", "dst_id") if direction == "out" else ("dst_id", "src_id")
        e = self.edges(kinds)
        if what is not None:
            e = e.join(self.ids(what, own), own, "left_semi")
        if not self.is_resolved():
            n = self.c["edge_site"].groupBy(F.col("edge_id").alias("id")).agg(F.count("*").alias("n"))
            e = e.join(n, "id", "left").withColumn("count", F.coalesce("n", F.lit(1)))
        out = e.select(F.col(own).alias("id"), F.col(peer).alias("peer"), "kind", F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)).alias("count"), F.col("id").alias("edge_id"))
        if limit is None:
            return out
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("count"), "kind", "peer"))
        return out.withColumn("r", rank).where(F.col("r") <= limit).drop("r")

    def edges_out(self, what, kinds=None, limit: int = 500) -> DataFrame:
        return self.hops(what, "out", kinds, limit)

    def edges_in(self, what, kinds=None, limit: int = 500) -> DataFrame:
        return self.hops(what, "in", kinds, limit)

    def references(self, what, limit: int | None = 500) -> DataFrame:
        return self.hops(what, "in", ["calls", "uses"], limit)

    def neighbors(self, what, kinds=None, direction: str = "out", limit: int | None = 500) -> DataFrame:
        return self.hops(what, direction, kinds, limit).select("id", "peer").distinct()

    def aliased_by(self, what) -> DataFrame:
        alias = self.c["symbol"].where(F.col("kind").isin(SYMBOL_KIND["typedef"], SYMBOL_KIND["type-alias"])).select(F.col("id").alias("peer"))
        return self.hops(what, "in", ["uses"], None).join(alias, "peer", "left_semi").select("id", "peer")

    def sites(self, edge_ids, limit: int = 200) -> DataFrame:
        """Places of edges, with paths; the first `limit` of each edge."""
        s = self.c["edge_site"].join(self.ids(edge_ids, "edge_id"), "edge_id", "left_semi").join(self.files(), "file_id", "left")
        rank = F.row_number().over(Window.partitionBy("edge_id").orderBy("path", "line", "col"))
        return s.withColumn("r", rank).where(F.col("r") <= limit).drop("r")

    def declaration_sites(self, what) -> DataFrame:
        return self.c["decl_site"].join(self.ids(what, "symbol_id"), "symbol_id", "left_semi").join(self.files(), "file_id", "left")

    def call_args(self, edge_ids, at: tuple[int, int, int] | None = None) -> DataFrame:
        """Where the arguments of calls come from, in order; at: one site (file, line, column)."""
        a = self.c["call_arg"].join(self.ids(edge_ids, "edge_id"), "edge_id", "left_semi")
        if at is not None:
            a = a.where((F.col("file_id") == at[0]) & (F.col("line") == at[1]) & (F.col("col") == at[2]))
        return a.orderBy("edge_id", "file_id", "line", "col", "position")

    def call_sites_into(self, what) -> DataFrame:
        """(callee, caller, edge_id, args): incoming calls with their arguments in order."""
        calls = self.hops(what, "in", ["calls"], None)
        args = self.c["call_arg"].groupBy("edge_id", "file_id", "line", "col").agg(F.sort_array(F.collect_list(F.struct("position", "src_kind", "type_usr", "decl_usr", "callee_usr"))).alias("args"))
        return calls.join(args, "edge_id", "left").select(F.col("id").alias("callee"), F.col("peer").alias("caller"), "edge_id", "file_id", "line", "col", "args")

    # --- calls with dispatch and template roll-up

    def callers(self, what=None, include_overrides: bool = True, include_instantiations: bool = False) -> DataFrame:
        """(id, peer, via): who calls a symbol; via the instance of it that is called, if any."""
        return self._calls(what, "in", include_overrides, include_instantiations)

    def callees(self, what=None, include_overrides: bool = True, include_instantiations: bool = False) -> DataFrame:
        return self._calls(what, "out", include_overrides, include_instantiations)

    def _calls(self, what, direction: str, overrides: bool, instances: bool) -> DataFrame:
        kinds = ["calls", "dispatch_calls"] if overrides else ["calls"]
        none = F.lit(None).cast("long").alias("via")
        out = self.hops(what, direction, kinds, None).select("id", "peer", none).distinct()
        if not instances:
            return out
        inst = self.instantiations(what).select(F.col("id").alias("primary"), F.col("peer").alias("via"))
        more = self.hops(inst.select("via"), direction, kinds, None).select(F.col("id").alias("via"), "peer").join(inst, "via").select(F.col("primary").alias("id"), "peer", "via")
        return out.unionByName(more.distinct())

    def instantiations(self, what) -> DataFrame:
        """(id, peer): implicit instances of templates."""
        inst = self.c["symbol"].where("is_instantiation = 1").select(F.col("id").alias("peer"))
        p = self.pairs(["instantiates"], "in").select(F.col("a").alias("id"), F.col("b").alias("peer"))
        p = p if what is None else p.join(self.ids(what), "id", "left_semi")
        return p.join(inst, "peer", "left_semi").select("id", "peer").distinct()

    def template_of(self, what) -> DataFrame:
        """(id, template): what an instance instantiates; the least id of several."""
        return self.hops(what, "out", ["instantiates"], None).groupBy("id").agg(F.min("peer").alias("template"))

    def template_params(self, what) -> DataFrame:
        return self.c["template_param"].join(self.ids(what, "owner_id"), "owner_id", "left_semi").orderBy("owner_id", "position")

    def template_args(self, what) -> DataFrame:
        return self.c["template_arg"].join(self.ids(what, "owner_id"), "owner_id", "left_semi").orderBy("owner_id", "position")

    def template_of_member(self, what) -> DataFrame:
        """(id, owner): the instance that owns a member, as a method before as a field."""
        inst = self.c["symbol"].where("is_instantiation = 1 or is_named_instance = 1").select(F.col("id").alias("peer"))
        own = self.hops(what, "out", ["method_of", "field_of"], None).join(inst, "peer", "left_semi")
        return own.withColumn("o", F.struct(F.col("kind") != EDGE_KIND["method_of"], "peer")).groupBy("id").agg(F.min("o").alias("o")).select("id", F.col("o.peer").alias("owner"))

    # --- walks

    def walk(self, start: int, kinds, direction: str = "out", depth: int = 3, max_nodes: int = 500) -> DataFrame:
        """(node, depth, parent) of a bounded breadth-first walk."""
        return tree(self.pairs(kinds, direction), start, depth, max_nodes)

    def path_to(self, start: int, end: int, kinds, direction: str = "out", depth: int = 3, max_nodes: int = 500) -> list[int]:
        """The nodes from start to end by the parents of a bounded walk; empty if it does not get there. At most
        max_nodes rows are read."""
        parent = {r["node"]: r["parent"] for r in self.walk(start, kinds, direction, depth, max_nodes).collect()}
        out = [end] if end in parent else []
        while out and out[-1] != start:
            out.append(parent[out[-1]])
        return out[::-1]

    def reaches(self, src: int, dst: int, kinds=("calls",), direction: str = "out", max_depth: int = 8) -> list[int] | None:
        """A shortest way of at most max_depth edges, or None."""
        return path(self.pairs(kinds, direction), src, dst, max_depth)

    def _up_or_down(self, what, kind: str, direction: str, direct: bool) -> DataFrame:
        p = self.pairs([kind], direction)
        out = p.join(self.ids(what, "a"), "a", "left_semi") if direct else reach(p, self.ids(what, "a"), DEEP).where("a <> b").select("a", "b")
        return out.select(F.col("a").alias("id"), F.col("b").alias("peer")).distinct()

    def bases(self, what, direct: bool = True) -> DataFrame:
        return self._up_or_down(what, "inherits", "out", direct)

    def subclasses(self, what, direct: bool = True) -> DataFrame:
        return self._up_or_down(what, "inherits", "in", direct)

    def members(self, what, access: str | None = None) -> DataFrame:
        """(id, peer): what a record or namespace contains, and the methods and fields that are its."""
        m = self.pairs(["contains"]).unionByName(self.pairs(["field_of", "method_of"], "in")).distinct().join(self.ids(what, "a"), "a", "left_semi")
        if access is not None:
            m = m.join(self.c["symbol"].where(F.col("access") == access).select(F.col("id").alias("b")), "b", "left_semi")
        return m.select(F.col("a").alias("id"), F.col("b").alias("peer"))

    # --- virtual dispatch

    def overrides(self, what) -> DataFrame:
        return self._up_or_down(what, "overrides", "out", True)

    def overridden_by(self, what) -> DataFrame:
        return self._up_or_down(what, "overrides", "in", True)

    def virtual_methods(self) -> DataFrame:
        """(id): methods that are pure, override or are overridden."""
        e = self.edges(["overrides"])
        pure = self.c["symbol"].where("is_pure = 1").select("id")
        return pure.unionByName(e.select(F.col("src_id").alias("id"))).unionByName(e.select(F.col("dst_id").alias("id"))).distinct()

    def dispatch_targets(self, what=None) -> DataFrame:
        """(id, target): the methods that a call to id can land on: itself and what overrides it over any
        steps, without the pure ones."""
        p = self.pairs(["overrides"], "in")
        seeds = p.select("a").distinct() if what is None else self.ids(what, "a")
        far = reach(p, seeds).select("a", "b").unionByName(seeds.select("a", F.col("a").alias("b"))).distinct()
        solid = self.c["symbol"].where("coalesce(is_pure, 0) = 0").select(F.col("id").alias("b"))
        return far.join(solid, "b", "left_semi").select(F.col("a").alias("id"), F.col("b").alias("target"))

    def virtual_callees(self, what) -> DataFrame:
        return self.hops(what, "out", ["calls"], None).join(self.virtual_methods().withColumnRenamed("id", "peer"), "peer", "left_semi").select("id", "peer")

    def dispatch_selection(self, what, close_subtypes: bool = False) -> DataFrame:
        """(id, receiver, target): for each concrete receiver type the method that a call lands on.

        close_subtypes adds the types below the owners that own no target themselves: they take that of
        their nearest base."""
        owner = self.pairs(["method_of"]).groupBy(F.col("a").alias("target")).agg(F.min("b").alias("receiver"))
        own = self.dispatch_targets(what).join(owner, "target").select("id", "receiver", "target")
        if not close_subtypes:
            return own
        below = reach(self.pairs(["inherits"], "in"), own.select("receiver"), DEEP).select(F.col("a").alias("receiver"), F.col("b").alias("sub"), "depth").where("receiver <> sub")
        heir = own.join(below, "receiver").join(own.select("id", F.col("receiver").alias("sub")), ["id", "sub"], "left_anti")
        near = heir.groupBy("id", "sub").agg(F.min(F.struct("depth", "receiver", "target")).alias("m"))
        return own.unionByName(near.select("id", F.col("sub").alias("receiver"), F.col("m.target").alias("target")))

    # --- several definitions

    def redefined(self, limit: int = 500) -> DataFrame:
        return self.symbols().where("multi_def > 1").orderBy(F.desc("multi_def"), "name", "id").limit(limit)

    def definitions(self, what) -> DataFrame:
        return self.c["definition"].join(self.ids(what, "symbol_id"), "symbol_id", "left_semi").join(self.files(), "file_id", "left").orderBy("symbol_id", "component_id", "file_id")

    def possible_callees(self, what) -> DataFrame:
        """(id, definition): bodies that a call through a symbol's bodies may reach."""
        d = self.only(self.c["definition"].select(F.col("id").alias("src_def_id"), F.col("symbol_id").alias("id")), what)
        return d.join(self.c["possible_call"], "src_def_id").select("id", F.col("dst_def_id").alias("definition")).distinct()

    def of_definition(self, definitions, kind: str = "calls") -> DataFrame:
        """(definition, peer): what one body calls or uses."""
        e = self.c["def_edge"].where(F.col("kind") == EDGE_KIND[kind]).join(self.ids(definitions, "src_def_id"), "src_def_id", "left_semi")
        return e.select(F.col("src_def_id").alias("definition"), F.col("dst_id").alias("peer")).distinct()

    def referencing_definitions(self, what) -> DataFrame:
        e = self.only(self.c["def_edge"].where(F.col("kind").isin(EDGE_KIND["calls"], EDGE_KIND["uses"])), what, "dst_id")
        return e.select(F.col("dst_id").alias("id"), F.col("src_def_id").alias("definition")).distinct()

    def callees_of_definition(self, definitions) -> DataFrame:
        """(definition, peer): what one body calls."""
        return self.of_definition(definitions, "calls")

    def uses_of_definition(self, definitions) -> DataFrame:
        return self.of_definition(definitions, "uses")

    # --- places and facts of single symbols

    def def_decl_locations(self, what=None) -> DataFrame:
        """(id, role, path, line, col): where a symbol is defined (or last seen) and where it is declared."""
        paths = self.files().select("file_id", "path")
        s = self.only(self.c["symbol"], what)
        own = s.where("file_id is not null").select("id", F.lit("definition").alias("role"), "file_id", "line", "col").join(paths, "file_id", "left")
        decl = s.where("decl_line is not null").select("id", F.lit("declaration").alias("role"), F.col("decl_file_id").alias("file_id"), F.col("decl_line").alias("line"), F.lit(None).cast("int").alias("col"), "decl_path")
        decl = decl.join(paths, "file_id", "left").withColumn("path", F.coalesce("path", "decl_path"))
        columns = ["id", "role", "path", "line", "col"]
        return own.select(columns).unionByName(decl.select(columns))

    def entity_nodes_ready(self) -> bool:
        """Whether the design types have been derived."""
        return not self.c["entity_node"].isEmpty()

    def records_by_name(self, *names: str, design: tuple[str, ...] = ()) -> DataFrame:
        """Records and templates by qualified name or spelling; design: of these design types only."""
        kinds = [SYMBOL_KIND[k] for k in ("class", "struct", "union", "enum", "class-template")]
        s = self.symbols().where(F.col("kind").isin(kinds) & (F.col("qual_name").isin(*names) | F.col("spelling").isin(*names)))
        if design:
            node = self.c["entity_node"].where(F.col("kind").isin(kind_ids(design, ENTITY_KIND))).select("id")
            s = s.join(node, "id", "left_semi")
        return s.orderBy(F.length("name"), "name", "id")

    def is_virtual_method(self, what) -> DataFrame:
        """(id, virtual) of the symbols asked about."""
        v = self.virtual_methods().withColumn("virtual", F.lit(True))
        return self.ids(what).join(v, "id", "left").select("id", F.coalesce("virtual", F.lit(False)).alias("virtual"))

    def call_args_at(self, file_id: int, line: int, col: int) -> DataFrame:
        """Where the arguments of the calls at one place come from, in order."""
        a = self.c["call_arg"].where((F.col("file_id") == file_id) & (F.col("line") == line) & (F.col("col") == col))
        return a.orderBy("edge_id", "position")

    def receiver_provenance(self, edge_ids=None) -> DataFrame:
        """(edge_id, file_id, line, col, src_kind, type_usr, decl_usr, callee_usr, type_is_value): where the object
        comes from that a call is made on; calls without one have no row."""
        a = self.c["call_arg"].where("position = -1")
        return self.only(a, edge_ids, "edge_id").drop("position")

    def virtual_call_sites(self, what=None) -> DataFrame:
        """(caller, method, edge_id, file_id, line, col, src_kind, type_usr, decl_usr): every place at which the
        symbols asked about (None: all) call a virtual method, with where the receiver comes from."""
        e = self.only(self.edges(["calls"]).select(F.col("id").alias("edge_id"), F.col("src_id").alias("caller"), F.col("dst_id").alias("method")), what, "caller")
        e = e.join(self.virtual_methods().withColumnRenamed("id", "method"), "method", "left_semi")
        place = ["edge_id", "file_id", "line", "col"]
        recv = self.receiver_provenance().select(*place, "src_kind", "type_usr", "decl_usr").dropDuplicates(place)
        return self.c["edge_site"].select(place).join(e, "edge_id").join(recv, place, "left").select("caller", "method", *place, "src_kind", "type_usr", "decl_usr")

    # --- counts

    def stats(self) -> DataFrame:
        """(what, name, n): symbols and edges by kind, stubs."""
        s, names = self.symbols(), F.create_map(*[F.lit(x) for k, v in EDGE_KIND.items() for x in (v, k)])
        by_symbol = s.groupBy(F.lit("symbol").alias("what"), F.col("kind_name").alias("name")).agg(F.count("*").alias("n"))
        by_edge = self.c["edge"].groupBy(F.lit("edge").alias("what"), F.try_element_at(names, F.col("kind")).alias("name")).agg(F.count("*").alias("n"))
        stubs = s.agg(F.lit("symbol").alias("what"), F.lit("stub").alias("name"), F.coalesce(F.sum(F.col("is_stub").cast("long")), F.lit(0)).alias("n"))
        return by_symbol.unionByName(by_edge).unionByName(stubs)
