"""The resolve pass: relations derived from the facts, each a DataFrame program written once."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.functions.types import classified
from symlattice.operators.closure import reach, roots
from symlattice.schemas import ACCESS, CREATE_FORM, EDGE_KIND, ENTITIES, ENTITY_EDGE_KIND, ENTITY_KIND, SYMBOL_KIND
from symlattice.sources.facts import Catalog
from symlattice.staging import cut

TEMPLATE = SYMBOL_KIND["class-template"]


def edge_counts(c: Catalog) -> DataFrame:
    """edge with the counts of calls and uses taken from their sites, where they have any."""
    n = c["edge_site"].groupBy(F.col("edge_id").alias("id")).agg(F.count("*").alias("n"))
    counted = F.col("kind").isin(EDGE_KIND["calls"], EDGE_KIND["uses"]) & F.col("n").isNotNull()
    return c["edge"].join(n, "id", "left").withColumn("count", F.when(counted, F.col("n")).otherwise(F.col("count"))).select(c["edge"].columns)


def multi_def(c: Catalog) -> DataFrame:
    """symbol with the number of its definitions."""
    n = c["definition"].groupBy(F.col("symbol_id").alias("id")).agg(F.count("*").alias("n"))
    return c["symbol"].join(n, "id", "left").withColumn("multi_def", F.coalesce("n", F.lit(0)).cast("int")).select(c["symbol"].columns)


def possible_calls(c: Catalog) -> DataFrame:
    """(src_def_id, dst_def_id, count): a body's calls of symbols with several bodies, to each of them."""
    several = c["symbol"].where("multi_def > 1").select(F.col("id").alias("dst_id"))
    bodies = c["definition"].select(F.col("id").alias("dst_def_id"), F.col("symbol_id").alias("dst_id"))
    calls = c["def_edge"].where(F.col("kind") == EDGE_KIND["calls"]).select("src_def_id", "dst_id", "count")
    return calls.join(several, "dst_id").join(bodies, "dst_id").groupBy("src_def_id", "dst_def_id").agg(F.sum("count").alias("count"))


def dispatch_calls(c: Catalog) -> DataFrame:
    """Edges of kind dispatch_calls: caller of a method to every method that overrides it, over any
    number of steps; none to the caller itself. The count is the call's; of several, the largest."""
    down = c["edge"].where(F.col("kind") == EDGE_KIND["overrides"]).select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"))
    calls = c["edge"].where(F.col("kind") == EDGE_KIND["calls"]).select("src_id", F.col("dst_id").alias("a"), "count")
    called = down.select("a").distinct().join(calls.select("a").distinct(), "a", "left_semi")
    far = reach(down, called).select("a", F.col("b").alias("dst_id"))
    out = calls.join(far, "a").where("src_id <> dst_id").groupBy("src_id", "dst_id").agg(F.max("count").alias("count"))
    kind = F.lit(EDGE_KIND["dispatch_calls"])
    return out.select(F.xxhash64("src_id", "dst_id", kind).alias("id"), "src_id", "dst_id", kind.alias("kind"), "count")


def primaries(c: Catalog) -> DataFrame:
    """(node, root): instances and specialisations with the primary template they lead to; each takes its
    first specializes or instantiates edge in order of (kind, target)."""
    e = c["edge"].where(F.col("kind").isin(EDGE_KIND["specializes"], EDGE_KIND["instantiates"]))
    return roots(e.groupBy(F.col("src_id").alias("node")).agg(F.min(F.struct("kind", "dst_id")).alias("m")).select("node", F.col("m.dst_id").alias("next")))


def owner_flags(c: Catalog) -> DataFrame:
    """(usr, pure, impure, fields): whether a record has own pure methods, other methods, data members."""
    s = c["symbol"].where(F.col("parent_usr").isNotNull())
    method, member = F.col("kind") == SYMBOL_KIND["method"], F.col("kind") == SYMBOL_KIND["member"]
    pure = F.coalesce("is_pure", F.lit(0)) == 1
    return s.groupBy(F.col("parent_usr").alias("usr")).agg(F.bool_or(method & pure).alias("pure"), F.bool_or(method & ~pure).alias("impure"), F.bool_or(member).alias("fields"))


def entity_nodes(c: Catalog) -> DataFrame:
    """(id, kind): the design type of every record, enum, class template and namespace."""
    s = c["symbol"].where(F.col("kind").isin(*ENTITIES, TEMPLATE, SYMBOL_KIND["namespace"])).select("id", "usr", F.col("kind").alias("k"))
    flags = owner_flags(c)
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    interface = yes("pure") & ~yes("impure") & ~yes("fields")
    template = F.col("k") == TEMPLATE
    pick = lambda plain, of_template: F.when(template, ENTITY_KIND[of_template]).otherwise(ENTITY_KIND[plain])
    kind = (
        F.when(F.col("k") == SYMBOL_KIND["namespace"], ENTITY_KIND["namespace"])
        .when(F.col("k") == SYMBOL_KIND["enum"], ENTITY_KIND["enum"])
        .when(F.col("k") == SYMBOL_KIND["union"], ENTITY_KIND["union"])
        .when(interface, pick("interface", "interface_template"))
        .when(yes("pure"), pick("abstract_class", "abstract_class_template"))
        .otherwise(pick("class", "class_template"))
    )
    return s.join(flags, "usr", "left").select("id", kind.cast("int").alias("kind"))


class _Pass:
    """What the phases share: kinds, primaries, owners and interface flags, each computed once."""

    def __init__(self, c: Catalog):
        self.c = c
        self.edge, self.symbol = c["edge"], c["symbol"]
        self.kinds = self.symbol.select("id", F.col("kind").alias("k"))
        self.root = primaries(c)
        self.nodes = cut(entity_nodes(c), "nodes")
        record = self.kinds.where(F.col("k").isin(*ENTITIES)).select(F.col("id").alias("owner"))
        of = self.edge.where(F.col("kind") == EDGE_KIND["method_of"]).select(F.col("src_id").alias("method"), F.col("dst_id").alias("owner")).join(record, "owner")
        self.owner = cut(of.groupBy("method").agg(F.min("owner").alias("owner")), "owners")

    def edges(self, *names: str) -> DataFrame:
        return self.edge.where(F.col("kind").isin(*[EDGE_KIND[n] for n in names]))

    def between(self, name: str, kinds: tuple[int, ...]) -> DataFrame:
        ok = self.kinds.where(F.col("k").isin(*kinds)).select("id")
        return self.edges(name).join(ok.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ok.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")

    def collapsed(self, df: DataFrame, *columns: str) -> DataFrame:
        for col in columns:
            r = self.root.select(F.col("node").alias(col), F.col("root").alias("_r"))
            df = df.join(r, col, "left").withColumn(col, F.coalesce("_r", col)).drop("_r")
        return df

    def by_spelling(self) -> DataFrame:
        """(text, ref): the entity of a type's name, by qualified name before spelling, least id first."""
        s = self.symbol.where(F.col("kind").isin(*ENTITIES))
        both = s.select(F.col("qual_name").alias("text"), F.lit(0).alias("tier"), "id").unionByName(s.select(F.col("spelling").alias("text"), F.lit(1).alias("tier"), "id"))
        return both.where(F.col("text").isNotNull()).groupBy("text").agg(F.min(F.struct("tier", "id")).alias("m")).select("text", F.col("m.id").alias("ref"))


COLUMNS = ["src_id", "dst_id", "kind", "count", "via_member_id", "multiplicity", "access", "is_virtual", "create_form", "partial"]


def _entity_rows(df: DataFrame, kind, **values) -> DataFrame:
    """Rows of entity_edge, one for each key: counts add up, partial is the largest."""
    defaults = {"via_member_id": F.lit(None).cast("long"), "multiplicity": F.lit(1), "access": F.lit(0), "is_virtual": F.lit(0), "create_form": F.lit(None).cast("int"), "partial": F.lit(0), "count": F.lit(1)}
    df = df.where("src_id <> dst_id").withColumns({"kind": kind, **{k: v for k, v in (defaults | values).items()}})
    key = ["src_id", "dst_id", "kind", "via_member_id", "create_form"]
    out = df.groupBy(*key).agg(F.sum("count").cast("long").alias("count"), *[F.max(x).alias(x) for x in ("multiplicity", "access", "is_virtual", "partial")])
    return out.select(*[F.col(x).cast("long" if x in ("src_id", "dst_id", "count", "via_member_id") else "int").alias(x) for x in COLUMNS])


def inheritance(p: _Pass) -> DataFrame:
    """generalizes, or implements where the base is an interface; a derived instance counts as its template."""
    e = p.between("inherits", ENTITIES).select("src_id", "dst_id", "base_access", "is_virtual")
    base = p.nodes.select(F.col("id").alias("dst_id"), (F.col("kind") == ENTITY_KIND["interface"]).alias("iface"))
    e = p.collapsed(e.join(base, "dst_id", "left"), "src_id")
    kind = F.when(F.coalesce("iface", F.lit(False)), ENTITY_EDGE_KIND["implements"]).otherwise(ENTITY_EDGE_KIND["generalizes"])
    rows = e.withColumns({"_a": F.coalesce("base_access", F.lit(0)), "_v": F.coalesce("is_virtual", F.lit(0))})
    return _entity_rows(rows.select("src_id", "dst_id", "iface", "_a", "_v"), kind, access=F.col("_a"), is_virtual=F.col("_v")).withColumn("count", F.lit(1).cast("long"))


def _template_edges(p: _Pass, name: str, kind: str) -> DataFrame:
    e = p.collapsed(p.between(name, (*ENTITIES, TEMPLATE)).select("src_id", "dst_id"), "dst_id")
    return _entity_rows(e, F.lit(ENTITY_EDGE_KIND[kind]))


def _access(column: str):
    m = F.create_map(*[F.lit(x) for k, v in ACCESS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(m, F.coalesce(column, F.lit("public"))), F.lit(0))


def field_relations(p: _Pass) -> DataFrame:
    """composes, aggregates and associates of data members. The type named is the least named instance
    that the member uses, else its last type argument, else the entity its spelling comes down to."""
    member = p.symbol.where(F.col("kind") == SYMBOL_KIND["member"]).where("coalesce(type_info, '') <> ''").select(F.col("id").alias("field"), "type_info", "access")
    owner = p.kinds.where(F.col("k").isin(*ENTITIES)).select(F.col("id").alias("owner"))
    f = p.edges("field_of").select(F.col("src_id").alias("field"), F.col("dst_id").alias("owner")).join(owner, "owner", "left_semi").join(member, "field")
    instance = p.symbol.where("is_named_instance = 1").select(F.col("id").alias("dst_id"))
    named = p.edges("uses").join(instance, "dst_id", "left_semi").groupBy(F.col("src_id").alias("field")).agg(F.min("dst_id").alias("inst"))
    arg = p.c["template_arg"].where("arg_kind = 1 and ref_id is not null").groupBy(F.col("owner_id").alias("field")).agg(F.max_by("ref_id", "position").alias("arg"))
    f = f.join(named, "field", "left").join(arg, "field", "left")
    f = f.join(classified(f, "type_info"), "type_info", "left").join(p.by_spelling().withColumnRenamed("text", "core"), "core", "left")
    f = f.withColumn("to", F.coalesce("arg", "ref"))
    f = p.collapsed(f.withColumnRenamed("to", "plain"), "owner", "plain").withColumn("dst", F.coalesce("inst", "plain"))
    entity = p.kinds.where(F.col("k").isin(*ENTITIES)).select(F.col("id").alias("origin"))
    f = f.withColumn("origin", F.coalesce("inst", "arg", "ref")).join(entity, "origin", "left_semi")
    rows = f.select(F.col("owner").alias("src_id"), F.col("dst").alias("dst_id"), "field", "field_kind", F.col("multiplicity").alias("_m"), _access("access").alias("_a"))
    return _entity_rows(rows, F.col("field_kind"), via_member_id=F.col("field"), multiplicity=F.col("_m"), access=F.col("_a"))


def instance_composition(p: _Pass) -> DataFrame:
    """The members of a named instance: those of its primary template, with the bound type in place of a parameter."""
    inst = p.symbol.where("is_named_instance = 1").select(F.col("id").alias("inst"))
    prim = p.kinds.where(F.col("k") == TEMPLATE).select(F.col("id").alias("prim"))
    pairs = p.edges("instantiates").select(F.col("src_id").alias("inst"), F.col("dst_id").alias("prim")).join(inst, "inst", "left_semi").join(prim, "prim", "left_semi")
    member = p.symbol.where(F.col("kind") == SYMBOL_KIND["member"]).where("coalesce(type_info, '') <> ''").select(F.col("id").alias("field"), "type_info", "access")
    fields = p.edges("field_of").select(F.col("src_id").alias("field"), F.col("dst_id").alias("prim")).join(member, "field")
    f = pairs.join(fields, "prim")
    f = f.join(classified(f, "type_info"), "type_info", "left")
    param = p.c["template_param"].where("param_kind = 1 and coalesce(name, '') <> ''").groupBy(F.col("owner_id").alias("prim"), F.col("name").alias("core")).agg(F.min("position").alias("position"))
    bound = p.c["template_arg"].where("arg_kind = 1").select(F.col("owner_id").alias("inst"), "position", "ref_id")
    f = f.join(param, ["prim", "core"], "left").join(bound, ["inst", "position"], "left").join(p.by_spelling().withColumnRenamed("text", "core"), "core", "left")
    f = f.withColumn("dst_id", F.when(F.col("position").isNotNull(), F.col("ref_id")).otherwise(F.col("ref")))
    f = f.join(p.kinds.where(F.col("k").isin(*ENTITIES)).select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    rows = f.select(F.col("inst").alias("src_id"), "dst_id", "field", "field_kind", F.col("multiplicity").alias("_m"), _access("access").alias("_a"))
    return _entity_rows(rows, F.col("field_kind"), via_member_id=F.col("field"), multiplicity=F.col("_m"), access=F.col("_a"))


def creates_destroys(p: _Pass) -> DataFrame:
    """creates by form and destroys, from the owner of the method that does it to the record concerned;
    and creates of form 2 for methods that return another entity by value."""
    e = p.edge.where(F.col("kind").isin(*CREATE_FORM, EDGE_KIND["destroy"])).select("src_id", "dst_id", F.col("kind").alias("l0"))
    e = e.join(p.owner.select(F.col("method").alias("src_id"), "owner"), "src_id")
    entity = p.symbol.where(F.col("kind").isin(*ENTITIES))
    parent = p.symbol.select(F.col("id").alias("dst_id"), "parent_usr").join(entity.groupBy(F.col("usr").alias("parent_usr")).agg(F.min("id").alias("rec")), "parent_usr").select("dst_id", "rec")
    itself = entity.select(F.col("id").alias("dst_id"), F.col("id").alias("own"))
    e = e.join(parent, "dst_id", "left").join(itself, "dst_id", "left").withColumn("to", F.coalesce("rec", "own")).where("to is not null")
    e = p.collapsed(e.select(F.col("owner").alias("src_id"), F.col("to").alias("dst_id"), "l0"), "src_id", "dst_id")
    form = F.try_element_at(F.create_map(*[F.lit(x) for k, v in CREATE_FORM.items() for x in (k, v)]), F.col("l0"))
    destroyed = F.col("l0") == EDGE_KIND["destroy"]
    made = _entity_rows(e, F.when(destroyed, ENTITY_EDGE_KIND["destroys"]).otherwise(ENTITY_EDGE_KIND["creates"]), create_form=form, partial=(F.col("l0") == EDGE_KIND["factory-construct"]).cast("int"))
    m = p.symbol.where(F.col("kind").isin(SYMBOL_KIND["method"], SYMBOL_KIND["constructor"])).where("type_info is not null").select(F.col("id").alias("method"), "type_info")
    own = p.edges("method_of").select(F.col("src_id").alias("method"), F.col("dst_id").alias("owner")).join(p.kinds.where(F.col("k").isin(*ENTITIES)).select(F.col("id").alias("owner")), "owner", "left_semi")
    r = m.join(own, "method").join(classified(m, "type_info").select("type_info", "returns"), "type_info").join(p.by_spelling().withColumnRenamed("text", "returns"), "returns")
    r = p.collapsed(r.select(F.col("owner").alias("src_id"), F.col("ref").alias("dst_id")), "src_id", "dst_id")
    return made.unionByName(_entity_rows(r, F.lit(ENTITY_EDGE_KIND["creates"]), create_form=F.lit(2), partial=F.lit(1)))


def entity_uses(p: _Pass) -> DataFrame:
    """uses: a method calls or uses a method of another entity; by the method used; partial if that is pure."""
    callable_ = p.symbol.where(F.col("kind").isin(*[SYMBOL_KIND[k] for k in ("method", "function", "constructor", "destructor", "function-template")]))
    e = p.edges("calls", "uses").select("src_id", "dst_id").join(callable_.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    e = e.join(callable_.select(F.col("id").alias("dst_id"), F.coalesce("is_pure", F.lit(0)).alias("pure")), "dst_id")
    e = e.join(p.owner.select(F.col("method").alias("src_id"), F.col("owner").alias("a")), "src_id").join(p.owner.select(F.col("method").alias("dst_id"), F.col("owner").alias("b")), "dst_id")
    rows = p.collapsed(e.select("a", "b", F.col("dst_id").alias("via"), "pure"), "a", "b").select(F.col("a").alias("src_id"), F.col("b").alias("dst_id"), "via", "pure")
    return _entity_rows(rows, F.lit(ENTITY_EDGE_KIND["uses"]), via_member_id=F.col("via"), partial=F.col("pure"))


def befriends(p: _Pass) -> DataFrame:
    return _entity_rows(p.collapsed(p.between("friend", ENTITIES).select("src_id", "dst_id"), "src_id", "dst_id"), F.lit(ENTITY_EDGE_KIND["befriends"]))


def declares(p: _Pass) -> DataFrame:
    """declares: a namespace and the entities it contains."""
    space = p.kinds.where(F.col("k") == SYMBOL_KIND["namespace"]).select(F.col("id").alias("src_id"))
    e = p.edges("contains").select("src_id", "dst_id").join(space, "src_id", "left_semi").join(p.nodes.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    return _entity_rows(e.distinct(), F.lit(ENTITY_EDGE_KIND["declares"]))


def entity_edges(c: Catalog, p: _Pass | None = None) -> DataFrame:
    """All design-level edges. Keys that several phases make are added up."""
    p = p or _Pass(c)
    parts = [inheritance(p), _template_edges(p, "specializes", "specializes"), _template_edges(p, "instantiates", "instantiates"), field_relations(p), instance_composition(p), creates_destroys(p), entity_uses(p), befriends(p), declares(p)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    key = ["src_id", "dst_id", "kind", "via_member_id", "create_form"]
    merged = out.groupBy(*key).agg(F.sum("count").alias("count"), *[F.max(x).alias(x) for x in ("multiplicity", "access", "is_virtual", "partial")])
    return merged.select(COLUMNS)


def file_components(c: Catalog) -> DataFrame:
    """(file_id, component_id)."""
    return c["file"].select(F.col("id").alias("file_id"), "directory_id").join(c["directory"].select(F.col("id").alias("directory_id"), "component_id"), "directory_id").select("file_id", "component_id")


def cross_component_edges(c: Catalog) -> DataFrame:
    """(src_id, dst_id, kind): edges whose ends' files belong to different components."""
    of = c["symbol"].select("id", "file_id").join(file_components(c), "file_id").select("id", "component_id")
    e = c["edge"].select("src_id", "dst_id", "kind")
    e = e.join(of.select(F.col("id").alias("src_id"), F.col("component_id").alias("x")), "src_id").join(of.select(F.col("id").alias("dst_id"), F.col("component_id").alias("y")), "dst_id")
    return e.where("x <> y").select("src_id", "dst_id", "kind")


def resolve(c: Catalog) -> Catalog:
    """The catalog with counts, numbers of definitions, possible and dispatch calls, and the entity graph.

    Running it again changes nothing: derived edges are made anew. Each derived table is made when it is
    first asked for and written once to the shared folder, so that the queries that follow neither
    derive it again nor wait for tables that they do not read. meta says when it ran.
    """
    plain = c.replaced(edge=c["edge"].where(F.col("kind") != EDGE_KIND["dispatch_calls"]))
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    meta = c["meta"].where("key <> 'graph_resolved_at'").unionByName(c.spark.createDataFrame([("graph_resolved_at", now)], "key string, value string"))
    out = plain.replaced(meta=meta)

    @cache
    def symbol() -> DataFrame:
        return cut(multi_def(plain), "symbol")

    @cache
    def edge() -> DataFrame:
        counted = cut(edge_counts(plain), "edge")
        return cut(counted.unionByName(dispatch_calls(plain.replaced(edge=counted)), allowMissingColumns=True), "edge")

    @cache
    def design() -> _Pass:
        return _Pass(plain.replaced(edge=edge(), symbol=symbol()))

    @cache
    def entity_edge() -> DataFrame:
        return cut(entity_edges(design().c, design()), "entity_edge")

    @cache
    def possible_call() -> DataFrame:
        return cut(possible_calls(plain.replaced(symbol=symbol())), "possible_call")

    for name, table in {"symbol": symbol, "edge": edge, "possible_call": possible_call, "entity_node": lambda: design().nodes, "entity_edge": entity_edge}.items():
        out = out.later(name, table)
    return out


def summary(c: Catalog) -> dict[str, int]:
    """Symbols that are stubs still, and edges between components."""
    stubs = c["symbol"].where("coalesce(resolved, 0) = 0 and file_id is null and decl_file_id is null").count()
    return {"stubs": stubs, "cross_component": cross_component_edges(c).count()}


