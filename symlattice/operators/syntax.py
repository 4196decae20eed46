"""Relations over syntax trees: nodes and typed edges of many translation units (column tu) at once.

node: tu, id, kind_id, symbol_id, type_id, spelling, file_id, line, end_line, is_definition, is_const;
edge: tu, src_id, dst_id, rel_id, ord; symbol: tu, id, usr, name; file: tu, id, path, is_main.
Ids count within a unit; 0 and '' stand for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.operators.closure import reach

# Relations and kinds of nodes in the trees.
REL = {"child": 1, "references": 2, "definition": 3, "canonical": 4, "semantic_parent": 5, "specializes": 7, "overrides": 8, "type_decl": 10, "canonical_type": 11, "pointee": 12, "element_type": 13, "result_type": 14, "arg_type": 15, "named_type": 16, "underlying_type": 17, "template_arg": 18, "class_type": 19}
FUNCTION, VAR, PARAM, METHOD, CONSTRUCTOR, DESTRUCTOR, FUNCTION_TEMPLATE = 8, 9, 10, 21, 24, 25, 30
CALL, IF, SWITCH, WHILE, DO, FOR, RETURN, BASE, TYPEDEF, ALIAS = 103, 205, 206, 207, 208, 209, 214, 44, 20, 36
FUNCTIONS = (FUNCTION, METHOD, CONSTRUCTOR, DESTRUCTOR)
TYPES_FROM = 1000


class Trees:
    def __init__(self, node: DataFrame, edge: DataFrame, symbol: DataFrame, file: DataFrame):
        # one id for a node of a unit, so that recursive operators see one graph
        key = lambda c: F.xxhash64("tu", c)
        self.node = node.withColumn("key", key("id"))
        self.edge = edge.select(key("src_id").alias("a"), key("dst_id").alias("b"), "rel_id", "ord")
        self.symbol, self.file = symbol, file

    def rel(self, *names: str) -> DataFrame:
        return self.edge.where(F.col("rel_id").isin([REL[n] for n in names])).select("a", "b")

    def main_nodes(self) -> DataFrame:
        main = self.file.where("is_main = 1").select("tu", F.col("id").alias("file_id"))
        return self.node.join(main, ["tu", "file_id"], "left_semi")

    def functions(self) -> DataFrame:
        """Definitions of functions, methods, constructors and destructors in main files."""
        return self.main_nodes().where(F.col("kind_id").isin(*FUNCTIONS, FUNCTION_TEMPLATE) & (F.col("is_definition") == 1))

    def inside(self, tops: DataFrame | None = None) -> DataFrame:
        """(a, b): b lies in the subtree of a, for the tops (main functions)."""
        tops = self.functions().select("key") if tops is None else tops
        return reach(self.rel("child"), tops).select("a", "b")

    def calls(self) -> DataFrame:
        """(caller, callee, line): call expressions in a function with what they refer to."""
        site = self.node.where(F.col("kind_id") == CALL).select(F.col("key").alias("b"), "line")
        hit = self.inside().join(site, "b").select(F.col("a").alias("caller"), F.col("b").alias("site"), "line")
        return hit.join(self.rel("references").select(F.col("a").alias("site"), F.col("b").alias("callee")), "site").select("caller", "callee", "line").distinct()

    def bodies(self) -> DataFrame:
        """(callee, body): a declaration and the definition that stands for it."""
        own = self.node.where("is_definition = 1").select(F.col("key").alias("callee"), F.col("key").alias("body"))
        return own.unionByName(self.rel("definition").toDF("callee", "body")).distinct()

    def call_reach(self) -> DataFrame:
        c = self.calls().join(self.bodies(), "callee", "left").select(F.col("caller").alias("a"), F.coalesce("body", "callee").alias("b"))
        return reach(c).select(F.col("a").alias("caller"), F.col("b").alias("callee"))

    def dead_functions(self) -> DataFrame:
        """Main functions that no call reaches, by themselves or by a declaration; main is never dead."""
        called = self.calls().join(self.bodies(), "callee", "left").select(F.explode(F.array("callee", "body")).alias("key"))
        return self.functions().where("spelling <> 'main'").join(called.where("key is not null"), "key", "left_anti")

    def unused(self, *kinds: int) -> DataFrame:
        """Declarations of some kinds in main files that nothing refers to."""
        return self.main_nodes().where(F.col("kind_id").isin(*kinds)).join(self.rel("references").select(F.col("b").alias("key")), "key", "left_anti")

    def _count(self, kinds: tuple[int, ...], name: str) -> DataFrame:
        site = self.node.where(F.col("kind_id").isin(*kinds)).select(F.col("key").alias("b"))
        n = self.inside().join(site, "b").groupBy(F.col("a").alias("key")).agg(F.countDistinct("b").alias(name))
        return n

    def metrics(self) -> DataFrame:
        """(key, spelling, nodes, params, calls_out, branches, ifs, switches, loops, returns, lines) of main functions."""
        f = self.functions().select("tu", "key", "spelling", (F.col("end_line") - F.col("line") + 1).alias("lines"))
        params = self.rel("child").join(self.node.where(F.col("kind_id") == PARAM).select(F.col("key").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("key")).agg(F.count("*").alias("params"))
        parts = {"calls_out": (CALL,), "branches": (IF, SWITCH, WHILE, DO, FOR), "ifs": (IF,), "switches": (SWITCH,), "loops": (WHILE, DO, FOR), "returns": (RETURN,)}
        # one closure for all counts
        below = self.inside().join(self.node.select(F.col("key").alias("b"), F.col("kind_id").alias("k")), "b")
        n = below.groupBy(F.col("a").alias("key")).agg(F.countDistinct("b").alias("nodes"), *[F.countDistinct(F.when(F.col("k").isin(*v), F.col("b"))).alias(k) for k, v in parts.items()])
        out = f.join(n, "key", "left").join(params, "key", "left")
        return out.select("tu", "key", "spelling", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "params", *parts)], "lines")

    def type_mentions(self) -> DataFrame:
        """(a, b): type a names type b through pointers, arguments, aliases and the like, itself included."""
        t = self.node.where(F.col("kind_id") >= TYPES_FROM).select(F.col("key").alias("a"))
        step = self.rel("canonical_type", "pointee", "element_type", "result_type", "arg_type", "named_type", "underlying_type", "template_arg", "class_type")
        return reach(step, t).select("a", "b").unionByName(t.select("a", F.col("a").alias("b"))).distinct()

    def pointer_depths(self) -> DataFrame:
        """(key, depth): how many pointers lead to the last type."""
        return reach(self.rel("pointee")).groupBy(F.col("a").alias("key")).agg(F.max("depth").alias("depth"))

    def derives(self) -> DataFrame:
        """(derived, base): by the base specifiers among a record's children."""
        spec = self.node.where(F.col("kind_id") == BASE).select(F.col("key").alias("b"))
        of = self.rel("child").join(spec, "b").select(F.col("a").alias("derived"), F.col("b").alias("a"))
        return of.join(self.rel("references"), "a").select("derived", F.col("b").alias("base")).distinct()

    def leaf_overrides(self) -> DataFrame:
        """Overriding methods that nothing overrides further."""
        o = self.rel("overrides")
        return o.select(F.col("a").alias("key")).join(o.select(F.col("b").alias("key")), "key", "left_anti").distinct()

    def file_dependencies(self) -> DataFrame:
        """(tu, source, target, n): references from one file's nodes to another's."""
        at = self.node.where("file_id <> 0").select("key", "tu", "file_id")
        r = self.rel("references").join(at.select(F.col("key").alias("a"), "tu", F.col("file_id").alias("source")), "a").join(at.select(F.col("key").alias("b"), F.col("file_id").alias("target")), "b")
        return r.where("source <> target").groupBy("tu", "source", "target").agg(F.count("*").alias("n"))

    def inventory(self) -> DataFrame:
        return self.node.groupBy("kind_id").agg(F.count("*").alias("n"))

    def value_flow(self) -> DataFrame:
        """(a, b): a variable read where another gets its value: in its initializer, as an argument for a
        parameter, or in what a function returns that initializes it."""
        var = self.main_nodes().where(F.col("kind_id").isin(VAR, PARAM)).select("key")
        within = reach(self.rel("child"), var).select(F.col("a").alias("to"), F.col("b").alias("site"))
        reads = self.rel("references").join(var.select(F.col("key").alias("b")), "b", "left_semi").select(F.col("a").alias("site"), F.col("b").alias("v"))
        direct = within.join(reads, "site").select(F.col("v").alias("a"), F.col("to").alias("b"))
        param = self.node.where(F.col("kind_id") == PARAM).select(F.col("key").alias("b"))
        ranked = self.edge.where(F.col("rel_id") == REL["child"]).join(param, "b", "left_semi").select(F.col("a").alias("body"), F.col("b").alias("p"), "ord")
        order = ranked.groupBy("body").agg(F.sort_array(F.collect_list(F.struct("ord", "p"))).alias("ps")).select("body", F.posexplode("ps").alias("n", "x")).select("body", "n", F.col("x.p").alias("p"))
        call = self.node.where(F.col("kind_id") == CALL).select(F.col("key").alias("call"))
        target = self.rel("references").toDF("call", "callee").join(call, "call", "left_semi").join(self.bodies(), "callee").select("call", "body")
        # a call's first child names the function; the others are the arguments in order
        args = self.edge.where(F.col("rel_id") == REL["child"]).select(F.col("a").alias("call"), F.col("b").alias("arg"), "ord").join(call, "call", "left_semi")
        args = args.groupBy("call").agg(F.sort_array(F.collect_list(F.struct("ord", "arg"))).alias("xs")).select("call", F.posexplode("xs").alias("i", "x")).where("i > 0").select("call", (F.col("i") - 1).alias("n"), F.col("x.arg").alias("arg"))
        under = reach(self.rel("child"), args.select("arg")).select(F.col("a").alias("arg"), F.col("b").alias("site")).unionByName(args.select("arg", F.col("arg").alias("site")))
        passed = args.join(target, "call").join(order, ["body", "n"]).join(under, "arg").join(reads, "site").select(F.col("v").alias("a"), F.col("p").alias("b"))
        ret = self.node.where(F.col("kind_id") == RETURN).select(F.col("key").alias("b"))
        returned = self.inside().join(ret, "b").select(F.col("a").alias("body"), F.col("b").alias("r"))
        returned = returned.join(reach(self.rel("child"), returned.select("r")).select(F.col("a").alias("r"), F.col("b").alias("site")), "r").join(reads, "site").select("body", "v")
        back = within.withColumnRenamed("site", "call").join(target, "call").join(returned, "body").select(F.col("v").alias("a"), F.col("to").alias("b"))
        return direct.unionByName(passed).unionByName(back).where("a <> b").distinct()

    def influences(self) -> DataFrame:
        return reach(self.value_flow()).select("a", "b")

    # --- whole programs

    def callee_names(self) -> DataFrame:
        """(tu, key, spelling, callees): each function with the sorted names of what it calls."""
        names = self.node.select(F.col("key").alias("callee"), F.col("spelling").alias("name"))
        called = self.calls().join(names, "callee").groupBy(F.col("caller").alias("key")).agg(F.sort_array(F.collect_set("name")).alias("callees"))
        return self.functions().join(called, "key", "left").select("tu", "key", "spelling", F.coalesce("callees", F.array().cast("array<string>")).alias("callees"))

    def symbol_table(self) -> DataFrame:
        """(usr, name, units, definitions, references): symbols of all units by usr, with how often each is defined and referred to."""
        s = self.node.join(self.symbol.select("tu", F.col("id").alias("symbol_id"), "usr", "name"), ["tu", "symbol_id"])
        n = self.rel("references").groupBy(F.col("b").alias("key")).agg(F.count("*").alias("n"))
        return s.join(n, "key", "left").groupBy("usr").agg(F.min("name").alias("name"), F.countDistinct("tu").alias("units"), F.sum("is_definition").alias("definitions"), F.coalesce(F.sum("n"), F.lit(0)).alias("references"))

    def references_to(self, usr: str) -> DataFrame:
        """(tu, path, line): where a symbol is referred to, in whatever unit."""
        target = self.node.join(self.symbol.where(F.col("usr") == usr).select("tu", F.col("id").alias("symbol_id")), ["tu", "symbol_id"], "left_semi").select(F.col("key").alias("b"))
        site = self.rel("references").join(target, "b", "left_semi").select(F.col("a").alias("key"))
        paths = self.file.select("tu", F.col("id").alias("file_id"), "path")
        return self.node.join(site, "key", "left_semi").join(paths, ["tu", "file_id"], "left").select("tu", "path", "line")

    def naming_problems(self, pattern: str = "^[a-z_][a-z0-9_]*$") -> DataFrame:
        """(tu, key, spelling, problem): functions whose name does not fit a pattern, parameters of one letter."""
        bad = self.functions().where(~F.col("spelling").rlike(pattern) & F.col("kind_id").isin(FUNCTION, METHOD)).withColumn("problem", F.lit("name"))
        short = self.main_nodes().where((F.col("kind_id") == PARAM) & (F.length("spelling") == 1)).withColumn("problem", F.lit("one letter"))
        return bad.unionByName(short).select("tu", "key", "spelling", "problem")

    def top_level(self) -> DataFrame:
        """Declarations of main files that lie in no other node, in the order of the source."""
        inner = self.rel("child").select(F.col("b").alias("key"))
        return self.main_nodes().where(f"kind_id < {TYPES_FROM}").join(inner, "key", "left_anti").orderBy("tu", "line", "key")

    def nesting(self) -> DataFrame:
        """(key, spelling, depth): how deep branches and loops of main functions lie in each other."""
        kinds = (IF, SWITCH, WHILE, DO, FOR)
        site = self.node.where(F.col("kind_id").isin(*kinds)).select(F.col("key").alias("b"))
        inside = reach(self.rel("child"), site).select("a", "b").join(site, "b", "left_semi")
        outer = inside.groupBy("b").agg(F.count("*").alias("n"))
        deep = self.inside().join(site, "b", "left_semi").join(outer, "b", "left").groupBy(F.col("a").alias("key")).agg(F.max(1 + F.coalesce("n", F.lit(0))).alias("depth"))
        return self.functions().join(deep, "key", "left").select("key", "spelling", F.coalesce("depth", F.lit(0)).alias("depth"))

    def shared_headers(self, share: float = 0.5) -> DataFrame:
        """(path, units, share): files that at least this share of all units read, most shared first."""
        total = self.file.select("tu").distinct().count()
        n = self.file.where("is_main = 0").groupBy("path").agg(F.countDistinct("tu").alias("units"))
        return n.withColumn("share", F.col("units") / F.lit(max(total, 1))).where(F.col("share") >= share).orderBy(F.desc("units"), "path")
