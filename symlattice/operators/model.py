"""The typed view: selectors by name, kind and signature, call graphs, and devirtualised calls."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlattice.functions.types import Signature, matching, normal, parse_signature
from symlattice.operators.closure import reach, tree
from symlattice.operators.graph import Graph
from symlattice.operators.resolve import entity_nodes
from symlattice.schemas import CALLABLES, EDGE_KIND, ENTITY_KIND, RECORDS, SYMBOL_KIND


class CodeBase:
    """Selectors that give symbols (columns of Graph.symbols()), and what can be asked of them."""

    def __init__(self, graph: Graph):
        self.g, self.c = graph, graph.c

    # --- selectors

    def _named(self, name: str, kinds: tuple[int, ...]) -> DataFrame:
        """Equal to the qualified name or spelling, or its end after a ::."""
        s = self.g.symbols().where(F.col("kind").isin(*kinds))
        return s.where((F.col("name") == name) | (F.col("spelling") == name) | F.col("name").endswith("::" + name))

    def _signed(self, s: DataFrame, ret: str | None, params: list[str] | None) -> DataFrame:
        return matching(s, Signature(ret, params))

    @staticmethod
    def _split(name: str, sig: str | None) -> tuple[str, str | None, list[str] | None]:
        """`ret name(params)` in the name, or `ret(params)` apart."""
        if sig is not None:
            ret, params = parse_signature(sig)
            return name, ret, params
        if "(" in name:
            head, params = parse_signature(name)
            ret, _, bare = (head or "").rpartition(" ")
            return bare, ret or None, params
        return name, None, None

    def function(self, name: str, sig: str | None = None, ret: str | None = None, params: list[str] | None = None) -> DataFrame:
        name, r, p = self._split(name, sig)
        return self._signed(self._named(name, (SYMBOL_KIND["function"], SYMBOL_KIND["function-template"])), ret or r, params if params is not None else p)

    def method(self, name: str, sig: str | None = None, ret: str | None = None, params: list[str] | None = None, owner: str | None = None) -> DataFrame:
        name, r, p = self._split(name, sig)
        kinds = tuple(SYMBOL_KIND[k] for k in ("method", "constructor", "destructor"))
        s = self._signed(self._named(name, kinds), ret or r, params if params is not None else p)
        if owner is None:
            return s
        o = self._named(owner, (*RECORDS, SYMBOL_KIND["class-template"])).select(F.col("usr").alias("parent_usr"))
        return s.join(o, "parent_usr", "left_semi")

    def records(self, name: str, kinds: tuple[str, ...] = ("class", "struct", "union"), design: tuple[str, ...] = ("class", "union")) -> DataFrame:
        node = self.c["entity_node"].where(F.col("kind").isin([ENTITY_KIND[d] for d in design])).select("id")
        plain = self._named(name, tuple(SYMBOL_KIND[k] for k in kinds)).where("coalesce(is_instantiation, 0) = 0")
        return plain.join(node, "id", "left_semi")

    def klass(self, name: str) -> DataFrame:
        return self.records(name, ("class",), ("class",))

    def struct(self, name: str) -> DataFrame:
        return self.records(name, ("struct",), ("class",))

    def interface(self, name: str) -> DataFrame:
        return self.records(name, ("class", "struct"), ("interface",))

    def abstract_class(self, name: str) -> DataFrame:
        return self.records(name, ("class", "struct"), ("abstract_class",))

    def record(self, name: str) -> DataFrame:
        """Any class, struct or union that is neither abstract nor an interface."""
        return self.records(name)

    def function_template(self, name: str, sig: str | None = None) -> DataFrame:
        name, r, p = self._split(name, sig)
        return self._signed(self._named(name, (SYMBOL_KIND["function-template"],)), r, p)

    def class_template(self, name: str) -> DataFrame:
        return self._named(name, (SYMBOL_KIND["class-template"],))

    def namespace(self, name: str) -> DataFrame:
        return self.g.symbols().where((F.col("kind") == SYMBOL_KIND["namespace"]) & (F.col("name") == name)).orderBy("id").limit(1)

    def instance(self, name: str | None = None, args: list[str] | None = None) -> DataFrame:
        """Instances and specialisations, by name (`Box<int>` names arguments as well) and by their arguments."""
        if name and "<" in name and args is None:
            from symlattice.functions.types import split_top

            name, inner = name.split("<", 1)
            args = split_top(inner.rsplit(">", 1)[0])
        s = self.g.symbols().where(F.col("kind").isin(*RECORDS))
        told = self.c["template_arg"].join(self.c["symbol"].select(F.col("id").alias("ref_id"), F.coalesce("qual_name", "spelling").alias("ref")), "ref_id", "left")
        told = told.groupBy(F.col("owner_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", F.coalesce("ref", "literal").alias("t")))), lambda x: x["t"]).alias("args"))
        s = s.join(told, "id")
        if name:
            s = s.where((F.col("name") == name) | (F.col("spelling") == name) | F.col("name").endswith("::" + name) | F.col("name").startswith(name + "<"))
        if args is not None:
            s = s.where(F.transform("args", lambda t: F.regexp_replace(t, "\\s+", "")) == F.array(*[F.lit(normal(a).replace(" ", "")) for a in args]))
        return s

    def namespace_members(self, name: str, kinds: tuple[str, ...] | None = None, part: str | None = None) -> DataFrame:
        """What a namespace declares directly, by kind and by a part of the name."""
        own = self.g.pairs(["contains"]).join(self.namespace(name).select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        s = self.g.symbols().join(own, "id", "left_semi")
        if kinds is not None:
            s = s.where(F.col("kind").isin([SYMBOL_KIND[k] for k in kinds]))
        return s if part is None else s.where(F.contains(F.lower("spelling"), F.lit(part.lower())))

    def constants(self, name: str) -> DataFrame:
        """Variables of a namespace whose own type is const, not only what it points to."""
        v = self.namespace_members(name, ("variable",))
        after = F.regexp_replace("type_info", "^.*[*&]", "")
        pointer = F.col("type_info").rlike("[*&]")
        return v.where(F.when(pointer, after.rlike("\\b(const|constexpr)\\b")).otherwise(F.col("type_info").rlike("\\b(const|constexpr)\\b")))

    def enumerators(self, what) -> DataFrame:
        return self.g.members(what).join(self.c["symbol"].where(F.col("kind") == SYMBOL_KIND["enum-constant"]).select(F.col("id").alias("peer")), "peer", "left_semi").select("id", "peer")

    def aliased(self, what) -> DataFrame:
        """(id, peer): the record or enum that an alias names directly."""
        named = self.c["symbol"].where(F.col("kind").isin(*RECORDS, SYMBOL_KIND["enum"], SYMBOL_KIND["class-template"])).select(F.col("id").alias("peer"))
        return self.g.hops(what, "out", ["uses"], None).join(named, "peer", "left_semi").groupBy("id").agg(F.min("peer").alias("peer"))

    def abstract_records(self) -> DataFrame:
        """(id): records with a pure method, their own or inherited and not overridden by name among their own."""
        s = self.c["symbol"]
        method = s.where(F.col("kind") == SYMBOL_KIND["method"])
        record = s.where(F.col("kind").isin(*RECORDS)).select("id", "usr")
        pure = method.where("is_pure = 1").select(F.col("parent_usr").alias("usr"), "spelling").join(record, "usr").select(F.col("id").alias("base"), "spelling")
        own = method.where("coalesce(is_pure, 0) = 0").select(F.col("parent_usr").alias("usr"), "spelling").join(record, "usr").select("id", "spelling")
        up = reach(self.g.pairs(["inherits"])).select(F.col("a").alias("id"), F.col("b").alias("base"))
        left = up.join(pure, "base").select("id", "spelling").join(own, ["id", "spelling"], "left_anti").select("id")
        return pure.select(F.col("base").alias("id")).unionByName(left).distinct()

    # --- namespaces

    def namespace_functions(self, name: str, part: str | None = None) -> DataFrame:
        """Free functions and function templates that a namespace declares directly."""
        return self.namespace_members(name, ("function", "function-template"), part)

    def namespace_function_templates(self, name: str, part: str | None = None) -> DataFrame:
        return self.namespace_members(name, ("function-template",), part)

    def namespace_classes(self, name: str, part: str | None = None) -> DataFrame:
        """Plain records: no instances and no specializations."""
        special = self.c["edge"].where(F.col("kind").isin(EDGE_KIND["specializes"], EDGE_KIND["instantiates"])).select(F.col("src_id").alias("id"))
        plain = self.namespace_members(name, ("class", "struct", "union"), part).where("coalesce(is_instantiation, 0) = 0 and coalesce(is_named_instance, 0) = 0")
        return plain.join(special, "id", "left_anti")

    def namespace_class_templates(self, name: str, part: str | None = None) -> DataFrame:
        return self.namespace_members(name, ("class-template",), part)

    def namespace_aliases(self, name: str, part: str | None = None) -> DataFrame:
        return self.namespace_members(name, ("typedef", "type-alias"), part)

    def namespace_enums(self, name: str, part: str | None = None) -> DataFrame:
        return self.namespace_members(name, ("enum",), part)

    def namespace_variables(self, name: str, part: str | None = None) -> DataFrame:
        return self.namespace_members(name, ("variable",), part)

    def namespaces_in(self, name: str, part: str | None = None) -> DataFrame:
        return self.namespace_members(name, ("namespace",), part)

    # --- records; each gives (id, peer) unless it says otherwise

    def _of_kinds(self, pairs: DataFrame, *kinds: str) -> DataFrame:
        ok = self.c["symbol"].where(F.col("kind").isin([SYMBOL_KIND[k] for k in kinds])).select(F.col("id").alias("peer"))
        return pairs.join(ok, "peer", "left_semi").select("id", "peer")

    def fields(self, what) -> DataFrame:
        """Data members."""
        return self._of_kinds(self.g.members(what), "member")

    def methods(self, what) -> DataFrame:
        """Member functions, constructors, destructors and member function templates."""
        return self._of_kinds(self.g.members(what), "method", "constructor", "destructor", "function-template")

    def members(self, what, access: str | None = None) -> DataFrame:
        return self.g.members(what, access)

    def parents(self, what) -> DataFrame:
        return self.g.bases(what)

    def ancestors(self, what) -> DataFrame:
        return self.g.bases(what, direct=False)

    def derived(self, what, recursive: bool = False) -> DataFrame:
        return self.g.subclasses(what, direct=not recursive)

    def children(self, what) -> DataFrame:
        """All that inherit from a record, over any steps."""
        return self.g.subclasses(what, direct=False)

    def class_kinds(self, what=None) -> DataFrame:
        """(id, class_kind): concrete, abstract or interface, by a record's own members alone."""
        names = {ENTITY_KIND[k]: v for k, v in (("abstract_class", "abstract"), ("abstract_class_template", "abstract"), ("interface", "interface"), ("interface_template", "interface"))}
        told = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)]), F.col("kind")), F.lit("concrete"))
        return self.g.only(entity_nodes(self.c).select("id", told.alias("class_kind")), what)

    def is_interface(self, what=None) -> DataFrame:
        return self.class_kinds(what).select("id", (F.col("class_kind") == "interface").alias("interface"))

    def is_abstract(self, what=None) -> DataFrame:
        """(id, abstract) of records: cannot be instantiated, for a pure method of its own or an inherited one that it leaves open."""
        records = self.g.only(self.c["symbol"].where(F.col("kind").isin(*RECORDS)).select("id"), what)
        yes = self.abstract_records().withColumn("abstract", F.lit(True))
        return records.join(yes, "id", "left").select("id", F.coalesce("abstract", F.lit(False)).alias("abstract"))

    # --- methods

    def owner(self, what=None) -> DataFrame:
        """The record that a method belongs to, by the usr of its parent."""
        record = self.c["symbol"].where(F.col("kind").isin(*RECORDS, SYMBOL_KIND["class-template"])).groupBy(F.col("usr").alias("parent_usr")).agg(F.min("id").alias("peer"))
        return self.g.only(self.c["symbol"].select("id", "parent_usr"), what).join(record, "parent_usr").select("id", "peer")

    def access(self, what=None) -> DataFrame:
        return self.g.only(self.c["symbol"].select("id", "access"), what)

    def is_virtual(self, what) -> DataFrame:
        return self.g.is_virtual_method(what)

    # --- signatures

    def signatures(self, what=None) -> DataFrame:
        """(id, returns, arguments) of callables, from the spelling of their type."""
        s = self.g.only(self.c["symbol"].where(F.col("kind").isin(*CALLABLES)).select("id", "type_info"), what)

        @F.arrow_udf("struct<returns:string,arguments:array<string>>")
        def told(texts: pa.Array) -> pa.Array:
            rows = [dict(zip(("returns", "arguments"), parse_signature(t), strict=True)) for t in texts.to_pylist()]
            return pa.array(rows, pa.struct([("returns", pa.string()), ("arguments", pa.list_(pa.string()))]))

        kinds = s.select("type_info").distinct().select("type_info", told("type_info").alias("t")).select("type_info", "t.*")
        return s.join(kinds, s["type_info"].eqNullSafe(kinds["type_info"])).select("id", "returns", "arguments")

    # --- any symbol

    def definition(self, what=None) -> DataFrame:
        """(id, role, path, line, col) where it is defined."""
        return self.g.def_decl_locations(what).where("role = 'definition'")

    def declaration(self, what=None) -> DataFrame:
        return self.g.def_decl_locations(what).where("role = 'declaration'")

    def is_redefined(self, what=None) -> DataFrame:
        return self.g.only(self.c["symbol"].select("id", (F.coalesce("multi_def", F.lit(0)) > 1).alias("redefined")), what)

    def initializer(self, what=None) -> DataFrame:
        """(id, init_text): the initializers of a symbol's definitions."""
        d = self.c["definition"].where("init_text is not null").select(F.col("symbol_id").alias("id"), "init_text")
        return self.g.only(d, what).distinct()

    def uses(self, what) -> DataFrame:
        return self.g.neighbors(what, ["uses"], limit=None)

    def underlying_type(self, what=None) -> DataFrame:
        """(id, underlying): what an alias stands for, as spelled."""
        alias = self.c["symbol"].where(F.col("kind").isin(SYMBOL_KIND["typedef"], SYMBOL_KIND["type-alias"]))
        return self.g.only(alias.select("id", F.col("type_info").alias("underlying")), what)

    # --- templates

    def parameters(self, what) -> DataFrame:
        return self.g.template_params(what)

    def specializations(self, what) -> DataFrame:
        """(id, peer): explicit and partial specializations of a template."""
        return self.g.neighbors(what, ["specializes"], "in", limit=None)

    def instantiation_sites(self, what) -> DataFrame:
        """(id, peer): functions that use a template by instantiating it."""
        pairs = self.g.neighbors(what, ["instantiates"], "in", limit=None)
        return self._of_kinds(pairs, "function", "method", "constructor", "destructor", "function-template")

    def primary_template(self, what=None) -> DataFrame:
        """(id, peer): the template that a specialization or instance comes from; the least id of several, specializations first."""
        e = self.c["edge"].where(F.col("kind").isin(EDGE_KIND["specializes"], EDGE_KIND["instantiates"])).select(F.col("src_id").alias("id"), "kind", F.col("dst_id").alias("peer"))
        return self.g.only(e, what).groupBy("id").agg(F.min(F.struct("kind", "peer"))["peer"].alias("peer"))

    def template_arguments(self, what=None) -> DataFrame:
        """(id, position, arg_kind, text, entity): the arguments in order: as text, and the symbol that each names, if any."""
        a = self.g.only(self.c["template_arg"].withColumnRenamed("owner_id", "id"), what)
        named = self.c["symbol"].select(F.col("id").alias("ref_id"), F.coalesce("qual_name", "spelling").alias("ref"))
        return a.join(named, "ref_id", "left").select("id", "position", "arg_kind", F.coalesce("ref", "literal").alias("text"), F.col("ref_id").alias("entity"))

    specialization_arguments = template_arguments

    def specialized_types(self, what=None) -> DataFrame:
        """(id, types): the arguments' texts in order."""
        a = self.template_arguments(what).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("x"))
        return a.select("id", F.transform("x", lambda t: t["text"]).alias("types"))

    def specialized_type_entities(self, what=None) -> DataFrame:
        return self.template_arguments(what).where("entity is not null").select("id", "position", F.col("entity").alias("peer"))

    # --- calls in the order of the source

    def ordered_callees(self, what=None) -> DataFrame:
        """(id, peer, n): callees by their first call site, dispatch targets after the direct ones."""
        calls = self.g.hops(what, "out", ["calls", "dispatch_calls"], None)
        first = self.c["edge_site"].groupBy("edge_id").agg(F.min(F.struct("line", "col")).alias("at"))
        calls = calls.join(first, "edge_id", "left").groupBy("id", "peer").agg(F.min(F.struct(F.col("kind") != EDGE_KIND["calls"], F.col("at").isNull(), "at")).alias("o"))
        return calls.select("id", "peer", F.row_number().over(Window.partitionBy("id").orderBy("o", "peer")).alias("n"))

    def callgraph(self, root: int, depth: int | None = None) -> DataFrame:
        """(node, depth, parent) of all that root calls, over dispatch as well."""
        return tree(self.g.pairs(["calls", "dispatch_calls"]), root, depth)

    def callgraph_order(self, root: int, depth: int | None = None) -> list[tuple[int, int]]:
        """(node, depth) in the order of a walk through the source, each node at its first visit.

        The order of a depth-first walk is sequential by nature: the reachable part is read to the driver."""
        nodes = self.callgraph(root, depth).select("node")
        nxt: dict[int, list[int]] = {}
        for r in self.ordered_callees(nodes).orderBy("id", "n").toLocalIterator():
            nxt.setdefault(r["id"], []).append(r["peer"])
        out, seen, stack = [], {root}, [(iter(nxt.get(root, [])), 1)]
        while stack:
            it, d = stack[-1]
            step = next((x for x in it if x not in seen), None)
            if step is None or (depth is not None and d > depth):
                stack.pop()
                continue
            seen.add(step)
            out.append((step, d))
            stack.append((iter(nxt.get(step, [])), d + 1))
        return out

    # --- devirtualisation

    def receiver_types(self) -> DataFrame:
        """(usr, types, top): the record types that may be bound to each variable or parameter.

        Types flow from constructions and value types over call arguments to parameters, without regard
        to the order of statements, and from variable to variable, until nothing is new; top: some
        source is not known, so that the types may be incomplete. Parameters are `callee#position`."""
        edge = self.c["edge"].where(F.col("kind") == EDGE_KIND["calls"]).select(F.col("id").alias("edge_id"), "dst_id")
        callee = self.c["symbol"].select(F.col("id").alias("dst_id"), F.col("usr").alias("callee"))
        arg = self.c["call_arg"].join(edge, "edge_id").join(callee, "dst_id").select(F.concat_ws("#", "callee", F.col("position").cast("string")).alias("to"), "src_kind", "type_usr", "decl_usr", "type_is_value")
        known = F.col("type_usr").isNotNull() & (F.col("src_kind").isin("construct", "this") | (F.coalesce("type_is_value", F.lit(0)) == 1))
        base = arg.where(known).select("to", F.col("type_usr").alias("type")).distinct()
        flow = arg.where(~known & F.col("decl_usr").isNotNull()).select(F.col("decl_usr").alias("frm"), "to").distinct()
        lost = arg.where(~known & F.col("decl_usr").isNull()).select("to").distinct()
        # numbers for the closure: the flow is a graph over names
        ids = flow.select(F.col("frm").alias("u")).unionByName(flow.select(F.col("to").alias("u"))).distinct().select("u", F.xxhash64("u").alias("n"))
        e = flow.join(ids.select(F.col("u").alias("frm"), F.col("n").alias("a")), "frm").join(ids.select(F.col("u").alias("to"), F.col("n").alias("b")), "to").select("a", "b")
        far = reach(e).join(ids.select(F.col("n").alias("a"), F.col("u").alias("frm")), "a").join(ids.select(F.col("n").alias("b"), F.col("u").alias("to")), "b").select("frm", "to")
        types = base.unionByName(far.join(base.withColumnRenamed("to", "frm"), "frm").select("to", "type")).distinct()
        # a variable that nothing is known of makes what it flows to incomplete
        sources = flow.select("frm").distinct().join(types.select(F.col("to").alias("frm")), "frm", "left_anti")
        open_ = lost.unionByName(far.join(sources, "frm").select("to")).unionByName(far.join(lost.withColumnRenamed("to", "frm"), "frm").select("to")).distinct()
        t = types.groupBy(F.col("to").alias("usr")).agg(F.sort_array(F.collect_set("type")).alias("types"))
        return t.join(open_.select(F.col("to").alias("usr"), F.lit(True).alias("top")), "usr", "full").select("usr", F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.coalesce("top", F.lit(False)).alias("top"))

    def virtual_sites(self, prune: bool = True) -> DataFrame:
        """(edge_id, file_id, line, col, caller, method, receiver, target, kept): every virtual call site with
        the methods it can land on. With prune, receivers that the site's or its variable's types rule out
        are not kept; a site where nothing is known, or where nothing would be left, keeps all."""
        e = self.c["edge"].where(F.col("kind") == EDGE_KIND["calls"]).select(F.col("id").alias("edge_id"), F.col("src_id").alias("caller"), F.col("dst_id").alias("method"))
        e = e.join(self.g.virtual_methods().withColumnRenamed("id", "method"), "method", "left_semi")
        sel = self.g.dispatch_selection(e.select("method"), close_subtypes=True).select(F.col("id").alias("method"), "receiver", "target")
        sites = self.c["edge_site"].join(e, "edge_id").join(sel, "method")
        if not prune:
            return sites.select("edge_id", "file_id", "line", "col", "caller", "method", "receiver", "target", F.lit(True).alias("kept"))
        usr = self.c["symbol"].select(F.col("id").alias("receiver"), F.col("usr").alias("r_usr"))
        recv = self.c["call_arg"].where("position = -1").select("edge_id", "file_id", "line", "col", "src_kind", "type_usr", "decl_usr", "type_is_value")
        sites = sites.join(usr, "receiver").join(recv, ["edge_id", "file_id", "line", "col"], "left")
        flows = self.receiver_types().select(F.col("usr").alias("decl_usr"), "types", "top")
        sites = sites.join(flows, "decl_usr", "left")
        exact = (F.col("src_kind") == "construct") | (F.coalesce("type_is_value", F.lit(0)) == 1)
        fits = F.when(exact & F.col("type_usr").isNotNull(), F.col("r_usr") == F.col("type_usr")).when(F.col("types").isNotNull() & ~F.coalesce("top", F.lit(True)), F.array_contains("types", F.col("r_usr"))).otherwise(True)
        place = Window.partitionBy("edge_id", "file_id", "line", "col")
        some = F.max(F.coalesce(fits, F.lit(True)).cast("int")).over(place)
        return sites.select("edge_id", "file_id", "line", "col", "caller", "method", "receiver", "target", ((some == 0) | F.coalesce(fits, F.lit(True))).alias("kept"))

    def devirtualized_edges(self) -> DataFrame:
        """(a, b): calls as they can happen: of plain functions as they stand, and of virtual methods those
        targets that the receivers' types leave at one of the call's places. Calls without a place keep all targets."""
        e = self.c["edge"].where(F.col("kind") == EDGE_KIND["calls"]).select(F.col("id").alias("edge_id"), F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
        virtual = self.g.virtual_methods().withColumnRenamed("id", "b")
        plain = e.join(virtual, "b", "left_anti").select("a", "b")
        placed = self.virtual_sites().where("kept").select(F.col("caller").alias("a"), F.col("target").alias("b"))
        lost = e.join(virtual, "b", "left_semi").join(self.c["edge_site"].select("edge_id"), "edge_id", "left_anti")
        all_ = lost.join(self.g.dispatch_targets(lost.select("b")).withColumnRenamed("id", "b"), "b").select("a", F.col("target").alias("b"))
        return plain.unionByName(placed).unionByName(all_).distinct()

    def devirtualized_callgraph(self, root: int, depth: int | None = None) -> DataFrame:
        """(node, depth, parent): callgraph() without the targets that the receivers' types rule out."""
        return tree(self.devirtualized_edges(), root, depth)

    def callables(self) -> DataFrame:
        return self.g.symbols().where(F.col("kind").isin(*CALLABLES))
