"""The design-level graph: a reader and a fluent query whose steps are lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.operators.closure import backward, reach
from symlattice.operators.graph import Graph
from symlattice.schemas import ENTITY_EDGE_KIND, ENTITY_KIND, SYMBOL_KIND, kind_ids

#: Step name: (relation, direction).
STEPS = {
    "implements": ("implements", "out"), "implementors": ("implements", "in"), "uses": ("uses", "out"), "used_by": ("uses", "in"),
    "composes": ("composes", "out"), "composed_in": ("composes", "in"), "creates": ("creates", "out"), "created_by": ("creates", "in"),
    "friends": ("befriends", "out"), "befriended_by": ("befriends", "in"), "instantiates": ("instantiates", "out"), "instances": ("instantiates", "in"),
    "specializes": ("specializes", "out"), "specialized_by": ("specializes", "in"), "aggregates": ("aggregates", "out"), "aggregated_in": ("aggregates", "in"),
    "associates": ("associates", "out"), "associated_with": ("associates", "in"), "destroys": ("destroys", "out"), "destroyed_by": ("destroys", "in"),
    "declares": ("declares", "out"), "declared_in": ("declares", "in"),
}
ABSTRACT = [ENTITY_KIND[k] for k in ("abstract_class", "interface", "abstract_class_template", "interface_template")]
INTERFACES = [ENTITY_KIND[k] for k in ("interface", "interface_template")]


class EntityGraph:
    """Entities and their relations, over a resolved catalog."""

    def __init__(self, graph: Graph):
        self.g, self.c = graph, graph.c

    def edges(self, kind: str | None = None, src=None, dst=None) -> DataFrame:
        e = self.c["entity_edge"]
        e = e if kind is None else e.where(F.col("kind").isin(kind_ids([kind], ENTITY_EDGE_KIND)))
        e = e if src is None else e.join(self.g.ids(src, "src_id"), "src_id", "left_semi")
        return e if dst is None else e.join(self.g.ids(dst, "dst_id"), "dst_id", "left_semi")

    def entities(self) -> DataFrame:
        """(id, entity_kind, name, display, spelling, symbol_kind, component, path): classified symbols and ends of edges."""
        e = self.c["entity_edge"]
        ids = self.c["entity_node"].select("id").unionByName(e.select(F.col("src_id").alias("id"))).unionByName(e.select(F.col("dst_id").alias("id"))).distinct()
        n = self.c["entity_node"].select("id", F.col("kind").alias("entity_kind"))
        s = self.g.symbols()
        more = F.when(F.coalesce(F.col("display_name").startswith(F.col("spelling")), F.lit(False)), F.concat("name", F.substring("display_name", F.length("spelling") + 1, F.length("display_name")))).otherwise(F.col("name"))
        return s.join(ids, "id", "left_semi").join(n, "id", "left").select("id", F.coalesce("entity_kind", F.lit(0)).alias("entity_kind"), "name", more.alias("display"), "spelling", "usr", F.col("kind").alias("symbol_kind"), "component", "path")

    def kinds(self) -> DataFrame:
        return self.c["entity_edge"].select("kind").distinct()

    def stats(self) -> DataFrame:
        """(kind, n) for the kinds of edges."""
        names = F.create_map(*[F.lit(x) for k, v in ENTITY_EDGE_KIND.items() for x in (v, k)])
        return self.c["entity_edge"].groupBy(F.try_element_at(names, F.col("kind")).alias("kind")).agg(F.count("*").alias("n"))

    def find(self, pattern: str, limit: int = 50) -> DataFrame:
        return self.entities().join(self.g.find(pattern, limit=limit).select("id"), "id", "left_semi")

    def query(self, start=None) -> EntityQuery:
        """All entities, those of some ids, or those of a name (else, of the best matches)."""
        all_ = self.entities()
        if start is None:
            return EntityQuery(self, all_.select("id"))
        if not isinstance(start, str):
            return EntityQuery(self, all_.join(self.g.ids(start), "id", "left_semi").select("id"))
        exact = self._exact(start)
        return EntityQuery(self, exact if not exact.isEmpty() else self.find(start).select("id"))

    def _exact(self, name: str) -> DataFrame:
        """By qualified name, spelling, display name, or spelling with its arguments."""
        args = F.concat("spelling", F.regexp_extract("display", "(<.*)$", 1))
        return self.entities().where((F.col("name") == name) | (F.col("spelling") == name) | (F.col("display") == name) | (args == name)).select("id")

    def seeded(self, name: str, symbol_kinds: tuple[str, ...], entity_kinds: tuple[str, ...]) -> EntityQuery:
        """Entities of a name that are of some symbol kinds and some design kinds."""
        hit = self.entities().where(F.col("symbol_kind").isin([SYMBOL_KIND[k] for k in symbol_kinds]) & F.col("entity_kind").isin([ENTITY_KIND[k] for k in entity_kinds]))
        return EntityQuery(self, hit.join(self._exact(name), "id", "left_semi").select("id"))

    def klass(self, name: str) -> EntityQuery:
        return self.seeded(name, ("class",), ("class",))

    def struct(self, name: str) -> EntityQuery:
        return self.seeded(name, ("struct",), ("class",))

    def record(self, name: str) -> EntityQuery:
        return self.seeded(name, ("class", "struct", "union"), ("class", "union"))

    def template(self, name: str) -> EntityQuery:
        return self.seeded(name, ("class-template",), ("class_template", "abstract_class_template", "interface_template"))

    def abstract_class(self, name: str) -> EntityQuery:
        return self.seeded(name, ("class", "struct"), ("abstract_class",))

    def interface(self, name: str) -> EntityQuery:
        return self.seeded(name, ("class", "struct"), ("interface",))

    def instance(self, name: str) -> EntityQuery:
        inst = self.c["symbol"].where("is_instantiation = 1 or is_named_instance = 1").select("id")
        return EntityQuery(self, self._exact(name).join(inst, "id", "left_semi"))


    def by_kind(self, kind: str) -> DataFrame:
        return self.edges(kind)

    def in_graph(self, what) -> DataFrame:
        """(id): those of the symbols that are classified or an end of an edge."""
        return self.g.ids(what).join(self.entities().select("id"), "id", "left_semi")

    def own_methods(self, what, pure_only: bool = False) -> DataFrame:
        """(id, method): a record's methods by the usr of their parent."""
        s = self.c["symbol"]
        m = s.where(F.col("kind") == SYMBOL_KIND["method"]).select(F.col("parent_usr").alias("usr"), F.col("id").alias("method"), "is_pure")
        m = m.where("is_pure = 1") if pure_only else m
        return self.g.only(s.select("id", "usr"), what).join(m, "usr").select("id", "method")

    def entity(self, ident: int | str) -> EntityNode | None:
        """The entity of an id or usr, if it is in the graph."""
        key = F.col("usr") == ident if isinstance(ident, str) else F.col("id") == int(ident)
        row = self.entities().where(key).first()
        return None if row is None else EntityNode(self, row)

    def __iter__(self):
        return self.c["entity_edge"].orderBy("src_id", "kind", "dst_id").toLocalIterator()


class EntityNode:
    """One entity: the columns of its row as attributes, and steps from it as queries."""

    def __init__(self, graph: EntityGraph, row):
        self.graph, self.row = graph, row

    def __getattr__(self, name: str):
        if name in self.row:
            return self.row[name]
        raise AttributeError(name)

    @property
    def is_interface(self) -> bool:
        return self.row["entity_kind"] in INTERFACES

    @property
    def is_abstract(self) -> bool:
        return self.row["entity_kind"] in ABSTRACT

    @property
    def class_kind(self) -> str:
        return "interface" if self.is_interface else "abstract" if self.is_abstract else "concrete"

    @property
    def location(self) -> str | None:
        """path:line of its definition."""
        at = self.graph.g.def_decl_locations(self.row["id"]).orderBy(F.desc("role")).first()
        return None if at is None else f"{at['path']}:{at['line']}"

    def sym(self) -> DataFrame:
        return self.graph.g.get(self.row["id"])

    def out_edges(self, kind: str | None = None) -> DataFrame:
        return self.graph.edges(kind, src=self.row["id"])

    def in_edges(self, kind: str | None = None) -> DataFrame:
        return self.graph.edges(kind, dst=self.row["id"])

    def query(self) -> EntityQuery:
        return self.graph.query(self.row["id"])

    def neighbors(self, kind: str | None = None, direction: str = "out") -> EntityQuery:
        """Entities one edge away, of a kind or of any."""
        out, in_ = self.out_edges(kind).select(F.col("dst_id").alias("id")), self.in_edges(kind).select(F.col("src_id").alias("id"))
        return EntityQuery(self.graph, {"out": out, "in": in_, "both": out.unionByName(in_)}[direction])

    def parts(self) -> DataFrame:
        return self.out_edges("composes")

    def uses(self) -> DataFrame:
        return self.out_edges("uses")

    def creates(self) -> DataFrame:
        return self.out_edges("creates")

    def friends(self) -> EntityQuery:
        return self.neighbors("befriends")

    def instances(self) -> EntityQuery:
        """Specializations and instances of a template."""
        return self.neighbors("instantiates", "in")

    def primary_template(self) -> EntityNode | None:
        return next((EntityNode(self.graph, r) for r in self.neighbors("instantiates").nodes().orderBy("id").take(1)), None)

    def implemented_by(self, concrete: bool = False) -> EntityQuery:
        """What generalizes to it or implements it directly."""
        both = self.in_edges("generalizes").unionByName(self.in_edges("implements")).select(F.col("src_id").alias("id"))
        q = EntityQuery(self.graph, both)
        return q.concrete() if concrete else q

    def operations(self) -> DataFrame:
        return self.graph.own_methods(self.row["id"])

    def walk(self, kind: str, direction: str = "out", max_depth: int | None = None) -> EntityQuery:
        return self.query().relation(kind, direction, transitive=True, max_depth=max_depth)

    def to_dict(self) -> dict:
        return self.row.asDict()


class EntityQuery:
    """A set of entity ids and the steps that follow; nothing runs before a terminal."""

    def __init__(self, graph: EntityGraph, ids: DataFrame, last: DataFrame | None = None):
        self.graph, self.ids, self.last = graph, ids.distinct(), last

    def relation(self, kind: str, direction: str = "out", transitive: bool = False, max_depth: int | None = None) -> EntityQuery:
        """Along edges of a kind, out, in or both ways. transitive: over any number of steps (max_depth at
        most), the starting entities themselves left out unless another leads to them."""
        if direction not in ("out", "in", "both"):
            raise ValueError(f"direction: {direction}")
        e = self.graph.edges(kind)
        p = e.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
        p = p if direction == "out" else backward(p) if direction == "in" else p.unionByName(backward(p))
        if transitive:
            far = reach(p, self.ids, max_depth).where("a <> b")
            return EntityQuery(self.graph, far.select(F.col("b").alias("id")))
        hit = p.join(self.ids.withColumnRenamed("id", "a"), "a", "left_semi")
        own = e.join(self.ids.withColumnRenamed("id", "src_id" if direction != "in" else "dst_id"), "src_id" if direction != "in" else "dst_id", "left_semi")
        return EntityQuery(self.graph, hit.select(F.col("b").alias("id")), own)

    then = relation

    def bases(self, transitive: bool = False) -> EntityQuery:
        return self.relation("generalizes", "out", transitive)

    def derived(self, transitive: bool = False) -> EntityQuery:
        return self.relation("generalizes", "in", transitive)

    def __getattr__(self, name: str) -> Callable[..., EntityQuery]:
        if name not in STEPS:
            raise AttributeError(name)
        kind, direction = STEPS[name]
        return lambda **how: self.relation(kind, direction, **how)

    def where(self, condition: Column | Callable[[DataFrame], Column]) -> EntityQuery:
        """Keeps entities for which a condition on the columns of nodes() holds."""
        nodes = self.nodes()
        hit = nodes.where(F.coalesce(condition(nodes) if callable(condition) and not isinstance(condition, Column) else condition, F.lit(False)))
        return EntityQuery(self.graph, hit.select("id"), self.last)

    def of_kind(self, *kinds: str) -> EntityQuery:
        """By design kind (class, interface, enum, ...) or kind of symbol (struct, union, ...)."""
        design = [ENTITY_KIND[k] for k in kinds if k in ENTITY_KIND]
        raw = [SYMBOL_KIND[k] for k in kinds if k not in ENTITY_KIND and k in SYMBOL_KIND]
        if len(design) + len(raw) < len(kinds):
            raise ValueError(f"unknown kind among {kinds}")
        return self.where(F.col("entity_kind").isin(design) | F.col("symbol_kind").isin(raw))

    def of_class_kind(self, kind: str) -> EntityQuery:
        """Records that are concrete, abstract or an interface."""
        hit = {"interface": F.col("entity_kind").isin(INTERFACES), "abstract": F.col("entity_kind").isin(ABSTRACT) & ~F.col("entity_kind").isin(INTERFACES)}
        hit["concrete"] = ~F.col("entity_kind").isin([*ABSTRACT, ENTITY_KIND["namespace"]])
        return self.where(hit[kind])

    def interfaces(self) -> EntityQuery:
        return self.where(F.col("entity_kind").isin(INTERFACES))

    def abstract(self) -> EntityQuery:
        return self.where(F.col("entity_kind").isin(ABSTRACT))

    def concrete(self) -> EntityQuery:
        return self.where(~F.col("entity_kind").isin([*ABSTRACT, ENTITY_KIND["namespace"]]))

    def named(self, part: str) -> EntityQuery:
        return self.where(F.contains(F.lower("name"), F.lit(part.lower())))

    def exclude(self, *others) -> EntityQuery:
        out = self.ids
        for o in others:
            ids = o.ids if isinstance(o, EntityQuery) else self.graph.query(o).ids
            out = out.join(ids, "id", "left_anti")
        return EntityQuery(self.graph, out, self.last)

    # --- terminals

    def nodes(self) -> DataFrame:
        return self.graph.entities().join(self.ids, "id", "left_semi")

    def names(self) -> DataFrame:
        return self.nodes().select("name").orderBy("name")

    def displays(self) -> DataFrame:
        return self.nodes().select("display").orderBy("display")

    def edges(self) -> DataFrame:
        """The edges of the last step, if that was one along edges."""
        return self.last if self.last is not None else self.graph.c["entity_edge"].limit(0)

    def first(self):
        return self.nodes().orderBy("id").first()

    def count(self) -> int:
        return self.ids.count()

    def __bool__(self) -> bool:
        return not self.ids.isEmpty()

    def __len__(self) -> int:
        return self.count()

    def __iter__(self):
        return self.nodes().orderBy("id").toLocalIterator()

    def to_dict(self) -> list[dict]:
        return [r.asDict() for r in self.nodes().orderBy("id").toLocalIterator()]
