"""The registered graph queries over the adapter's code graph, and their SQL for other engines.

The SQL says the same in another way: recursive common table expressions with set semantics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symlattice.functions import names as N
from symlattice.operators import closure as C
from symlattice.operators import resolve as R
from symlattice.operators.entity import EntityGraph
from symlattice.operators.graph import Graph
from symlattice.operators.model import CodeBase
from symlattice.plans import programs
from symlattice.plans.pattern import Engine
from symlattice.plans.rules import Program
from symlattice.schemas import ENTITY_EDGE_KIND, SYMBOL_KIND
from symlattice import tree_queries
from symlattice.sources.adapter import catalog, entry, expanded, sharing
from symlattice.sources.store import Store
from symlattice.staging import cut, sent

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _with(*used: str, recursive: bool = False, more: str = "") -> str:
    parts = [f"{u} AS ({expanded(u)})" for u in used]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([*parts, *([more] if more else [])]) + " "


def query(sql: str = "", used: tuple[str, ...] = (), recursive: bool = False, more: str = ""):
    """Registers a query, with its SQL over the named tables of the adapter."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _with(*used, recursive=recursive, more=more) + sql
        return f

    return add


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(catalog(spark, sf_dir))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = entry(spark, sf_dir, "calls")
    return C.ready(c) if sharing() else c.select("a", "b")


_CALLS = "calls AS (SELECT DISTINCT a, b FROM site)"
_SEED = "seed AS (SELECT min(a) AS a FROM calls)"


def seed(c: DataFrame) -> DataFrame:
    return c.agg(F.min("a").alias("a"))


# --- scans and lookups


@query("SELECT id, name, kind FROM (SELECT id, spelling AS name, kind, access FROM symbol) x WHERE kind = 21 AND access = 'public'", ("symbol",))
def scan_filter(spark, sf_dir):
    return entry(spark, sf_dir, "symbol").where("kind = 21 and access = 'public'").select("id", F.col("spelling").alias("name"), "kind")


_FIND = "SELECT id, qual_name AS name FROM symbol WHERE {} ORDER BY length(qual_name), qual_name, id LIMIT 50"


@query(_FIND.format("qual_name = 'red_widget'"), ("symbol",))
def find_exact(spark, sf_dir):
    return graph(spark, sf_dir).find("red_widget").select("id", "name")


@query(_FIND.format("lower(qual_name) LIKE 'asia::%'"), ("symbol",))
def find_prefix(spark, sf_dir):
    return graph(spark, sf_dir).find("asia::").select("id", "name")


@query(_FIND.format("lower(qual_name) LIKE '%frica%tion\\_1%' ESCAPE '\\'"), ("symbol",))
def find_fuzzy(spark, sf_dir):
    return graph(spark, sf_dir).find("frica::TION_1").select("id", "name")


@query("SELECT kind, count(*) AS total FROM symbol GROUP BY kind", ("symbol",))
def symbols_by_kind(spark, sf_dir):
    return entry(spark, sf_dir, "symbol").groupBy("kind").agg(F.count("*").alias("total"))


# --- hops


@query("SELECT src_id AS id, dst_id AS peer, kind, count FROM edge", ("edge",))
def edges_out(spark, sf_dir):
    return graph(spark, sf_dir).hops(None, "out", None, None).select("id", "peer", "kind", "count")


@query("SELECT dst_id AS id, src_id AS peer, kind FROM edge WHERE kind IN (1, 7)", ("edge",))
def references(spark, sf_dir):
    return graph(spark, sf_dir).references(None, limit=None).select("id", "peer", "kind")


@query("SELECT DISTINCT src_id AS id, dst_id AS peer FROM edge WHERE kind IN (2, 6)", ("edge",))
def neighbors_kind(spark, sf_dir):
    return graph(spark, sf_dir).neighbors(None, ["inherits", "overrides"], limit=None)


@query("SELECT DISTINCT src_id AS id, dst_id AS peer FROM edge WHERE kind = 3 UNION SELECT DISTINCT dst_id, src_id FROM edge WHERE kind IN (8, 9)", ("edge",))
def members_union(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.members(g.c["symbol"].select("id"))


# --- recursion


_ALL = f"{_CALLS}, r(a, b) AS (SELECT a, b FROM calls UNION SELECT r.a, c.b FROM r JOIN calls c ON c.a = r.b)"


@query("SELECT a, b FROM r", ("site",), True, _ALL)
def closure_full(spark, sf_dir):
    """All that every function reaches over the whole call graph, cycles included."""
    return C.reach(calls(spark, sf_dir)).select("a", "b")


@query("SELECT a, b FROM r", ("site",), True, _ALL)
def closure_by_rounds(spark, sf_dir):
    """The same by the way that large graphs take."""
    return C.reach(calls(spark, sf_dir), small=0).select("a", "b")


_REACH = f"{_CALLS}, {_SEED}, r(a, b) AS (SELECT c.a, c.b FROM calls c JOIN seed s ON s.a = c.a UNION SELECT r.a, c.b FROM r JOIN calls c ON c.a = r.b)"


@query("SELECT r.a AS caller, r.b AS callee, s.qual_name AS name FROM r JOIN symbol s ON s.id = r.b", ("symbol", "site"), True, _REACH)
def reach_seeded(spark, sf_dir):
    """Which functions can be reached from the first caller, with their names."""
    c = calls(spark, sf_dir)
    found = C.reach(c, seed(c)).select(F.col("a").alias("caller"), F.col("b").alias("callee"))
    return found.join(entry(spark, sf_dir, "symbol").select(F.col("id").alias("callee"), F.col("qual_name").alias("name")), "callee").select("caller", "callee", "name")


@query("SELECT DISTINCT c.a, c.b FROM calls c WHERE c.a IN (SELECT b FROM r) OR c.a IN (SELECT a FROM seed)", ("site",), True, _REACH)
def cone_out(spark, sf_dir):
    c = calls(spark, sf_dir)
    return C.cone(c, seed(c))


_LAST = f"{_CALLS}, seed AS (SELECT max(b) AS b FROM calls), r(b) AS (SELECT b FROM seed UNION SELECT c.a FROM r JOIN calls c ON c.b = r.b)"


@query("SELECT DISTINCT c.a, c.b FROM calls c WHERE c.b IN (SELECT b FROM r)", ("site",), True, _LAST)
def cone_in(spark, sf_dir):
    c = calls(spark, sf_dir)
    return C.cone(c, c.agg(F.max("b").alias("b")), forward=False)


@query(
    "SELECT DISTINCT a AS node FROM (SELECT a, b FROM r) x WHERE a = b",
    ("site",), True, f"{_CALLS}, r(a, b) AS (SELECT a, b FROM calls UNION SELECT r.a, c.b FROM r JOIN calls c ON c.a = r.b)",
)
def recursive_nodes(spark, sf_dir):
    return C.on_cycles(calls(spark, sf_dir)).select(F.col("a").alias("node"))


@query(
    "SELECT b AS node, min(d) AS depth FROM r GROUP BY b",
    ("site",), True, f"{_CALLS}, {_SEED}, r(b, d) AS (SELECT a, 0 FROM seed UNION SELECT c.b, r.d + 1 FROM r JOIN calls c ON c.a = r.b WHERE r.d < 6)",
)
def bfs_depth(spark, sf_dir):
    c = calls(spark, sf_dir)
    return C.tree(c, seed(c).first()[0], most=6).select("node", "depth")


@query(
    "SELECT max(x.d) AS hops FROM (SELECT b, min(d) AS d FROM r GROUP BY b) x",
    ("site",), True, f"{_CALLS}, {_SEED}, r(b, d) AS (SELECT a, 0 FROM seed UNION SELECT c.b, r.d + 1 FROM r JOIN calls c ON c.a = r.b WHERE r.d < 8)",
)
def shortest_path_len(spark, sf_dir):
    """Steps of a shortest way from the seed to the last of the nodes that are farthest within 8 steps."""
    c = calls(spark, sf_dir)
    start = seed(c).first()[0]
    far = C.tree(c, start, most=8).orderBy(F.desc("depth"), F.desc("node")).first()
    way = C.path(c, start, far["node"], 8)
    return spark.createDataFrame([(len(way) - 1,)], "hops int")


_SUB = "r(a, b) AS (SELECT src_id, dst_id FROM edge WHERE kind = 2 UNION SELECT r.a, e.dst_id FROM r JOIN edge e ON e.src_id = r.b AND e.kind = 2)"


@query("SELECT a AS sub, b AS super FROM r", ("edge",), True, _SUB)
def subtype_closure(spark, sf_dir):
    return C.reach(graph(spark, sf_dir).pairs(["inherits"])).select(F.col("a").alias("sub"), F.col("b").alias("super"))


_OVER = "r(base, target) AS (SELECT dst_id, src_id FROM edge WHERE kind = 6 UNION SELECT r.base, e.src_id FROM r JOIN edge e ON e.dst_id = r.target AND e.kind = 6)"


@query("SELECT target AS method, base AS base_method FROM r", ("edge",), True, _OVER)
def override_chain(spark, sf_dir):
    return C.reach(graph(spark, sf_dir).pairs(["overrides"])).select(F.col("a").alias("method"), F.col("b").alias("base_method"))


@query(
    "SELECT DISTINCT x.id, x.target FROM (SELECT base AS id, target FROM r UNION SELECT base, base FROM r) x JOIN symbol s ON s.id = x.target WHERE s.is_pure = 0",
    ("symbol", "edge"), True, _OVER,
)
def dispatch_targets(spark, sf_dir):
    return graph(spark, sf_dir).dispatch_targets()


@query("SELECT c.src_id, r.target AS dst_id, max(c.count) AS count FROM edge c JOIN r ON r.base = c.dst_id WHERE c.kind = 1 AND c.src_id <> r.target GROUP BY 1, 2", ("edge",), True, _OVER)
def dispatch_calls(spark, sf_dir):
    return R.dispatch_calls(catalog(spark, sf_dir)).select("src_id", "dst_id", "count")


@query(
    "SELECT n.id AS node, min(CASE WHEN u.id IS NULL THEN n.id ELSE u.id END) AS root FROM (SELECT 100 + n_nationkey AS id FROM nation) n LEFT JOIN (SELECT r.a AS x, r.b AS id FROM r WHERE r.b NOT IN (SELECT src_id FROM edge WHERE kind = 2)) u ON u.x = n.id WHERE n.id > 100 GROUP BY n.id",
    ("edge",), True, _SUB,
)
def collapse_root(spark, sf_dir):
    p = graph(spark, sf_dir).pairs(["inherits"])
    return C.roots(p.select(F.col("a").alias("node"), F.col("b").alias("next")))


# --- negation and counts


@query("SELECT id FROM symbol WHERE kind = 8 AND is_definition = 1 AND id NOT IN (SELECT dst_id FROM edge WHERE kind IN (1, 7))", ("symbol", "edge"))
def unreferenced(spark, sf_dir):
    c = catalog(spark, sf_dir)
    used = c["edge"].where("kind in (1, 7)").select(F.col("dst_id").alias("id"))
    return c["symbol"].where("kind = 8 and is_definition = 1").select("id").join(used, "id", "left_anti")


@query("SELECT DISTINCT a AS id FROM calls WHERE a NOT IN (SELECT b FROM calls)", ("site",), False, _CALLS)
def entry_points(spark, sf_dir):
    c = calls(spark, sf_dir)
    return c.select(F.col("a").alias("id")).distinct().join(c.select(F.col("b").alias("id")), "id", "left_anti")


@query("SELECT s.id, count(c.a) AS total FROM symbol s LEFT JOIN calls c ON c.b = s.id WHERE s.kind = 8 GROUP BY s.id", ("symbol", "site"), False, _CALLS)
def fan_in(spark, sf_dir):
    n = calls(spark, sf_dir).groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n"))
    return entry(spark, sf_dir, "symbol").where("kind = 8").select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("total"))


@query("SELECT s.id, count(c.b) AS total FROM symbol s LEFT JOIN calls c ON c.a = s.id WHERE s.kind = 8 GROUP BY s.id", ("symbol", "site"), False, _CALLS)
def fan_out(spark, sf_dir):
    n = calls(spark, sf_dir).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    return entry(spark, sf_dir, "symbol").where("kind = 8").select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("total"))


@query("SELECT b AS changed, count(DISTINCT a) AS callers FROM r GROUP BY b", ("site",), True, _ALL)
def blast_radius(spark, sf_dir):
    return C.reached_by(calls(spark, sf_dir)).select(F.col("b").alias("changed"), F.col("n").alias("callers"))


@query(
    "SELECT x.file_id AS source, y.file_id AS target, count(*) AS calls FROM calls c JOIN symbol x ON x.id = c.a JOIN symbol y ON y.id = c.b WHERE x.file_id <> y.file_id GROUP BY 1, 2",
    ("symbol", "site"), False, _CALLS,
)
def file_dependency(spark, sf_dir):
    s = entry(spark, sf_dir, "symbol").select("id", "file_id")
    c = calls(spark, sf_dir).join(s.select(F.col("id").alias("a"), F.col("file_id").alias("source")), "a").join(s.select(F.col("id").alias("b"), F.col("file_id").alias("target")), "b")
    return c.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("calls"))


@query(
    "SELECT e.src_id, e.dst_id, e.kind FROM edge e JOIN symbol x ON x.id = e.src_id JOIN symbol y ON y.id = e.dst_id WHERE x.file_id % 5 <> y.file_id % 5",
    ("symbol", "edge"),
)
def cross_component_edges(spark, sf_dir):
    return R.cross_component_edges(catalog(spark, sf_dir))


@query(
    "SELECT e.src_id, e.dst_id, e.kind, coalesce(s.n, e.count) AS n FROM edge e LEFT JOIN (SELECT a, b, count(*) AS n FROM site GROUP BY a, b) s ON s.a = e.src_id AND s.b = e.dst_id AND e.kind = 1",
    ("edge", "site"),
)
def edge_counts(spark, sf_dir):
    """Every edge with its count: of its sites, or as stored where it has none."""
    return R.edge_counts(catalog(spark, sf_dir)).select("src_id", "dst_id", "kind", F.col("count").alias("n"))


# --- names

_DISP = """
ann AS (SELECT s.id, s.qual_name, s.parent_usr, s.usr, s.file_id, s.line,
               CASE WHEN position(spelling IN display_name) = 1 THEN substr(display_name, length(spelling) + 1) ELSE '' END AS sig,
               qual_name || CASE WHEN position(spelling IN display_name) = 1 THEN substr(display_name, length(spelling) + 1) ELSE '' END AS base FROM symbol s),
placed AS (SELECT a.id, CASE WHEN p.usr IS NOT NULL AND p.base <> p.qual_name AND position(p.qual_name IN a.qual_name) = 1
                             THEN p.base || substr(a.qual_name, length(p.qual_name) + 1) || a.sig ELSE a.base END AS nm,
                  coalesce(f.name, '?') || ':' || coalesce(a.line, 0) AS loc
           FROM ann a LEFT JOIN ann p ON p.usr = a.parent_usr LEFT JOIN file f ON f.id = a.file_id),
disp AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY nm) = 1 THEN nm WHEN count(*) OVER (PARTITION BY nm, loc) = 1 THEN nm || ' @' || loc
                    ELSE nm || ' @' || loc || ' [' || row_number() OVER (PARTITION BY nm, loc ORDER BY id) || ']' END AS name FROM placed)"""


@query("SELECT id, name FROM disp", ("symbol", "file"), False, _DISP)
def display_names(spark, sf_dir):
    return N.display_names(catalog(spark, sf_dir))


@query("SELECT s.id, d.name, coalesce(s.type_info, '') AS type_info, coalesce(f.name, '') AS file, s.line, s.is_definition, s.is_pure, s.access FROM symbol s JOIN disp d ON d.id = s.id LEFT JOIN file f ON f.id = s.file_id", ("symbol", "file"), False, _DISP)
def symbol_facts(spark, sf_dir):
    return N.symbol_facts(catalog(spark, sf_dir)).select("id", "name", "type_info", "file", "line", "is_definition", "is_pure", "access")


@query("SELECT d.name, split_part(s.type_info, ' (', 1) || ' ' || s.qual_name || substr(s.type_info, position(' (' IN s.type_info) + 1) AS signature FROM symbol s JOIN disp d ON d.id = s.id WHERE s.kind IN (8, 21)", ("symbol", "file"), False, _DISP)
def callable_facts(spark, sf_dir):
    return N.callable_facts(catalog(spark, sf_dir))


@query("SELECT x.name AS a, y.name AS b FROM edge e JOIN disp x ON x.id = e.src_id JOIN disp y ON y.id = e.dst_id WHERE e.kind = 6", ("symbol", "file", "edge"), False, _DISP)
def named_overrides(spark, sf_dir):
    return N.named_edges(catalog(spark, sf_dir), 6)


# --- the entity graph

_FLAGS = "flags AS (SELECT parent_usr AS usr, bool_or(kind = 21 AND is_pure = 1) AS pure, bool_or(kind = 21 AND is_pure = 0) AS impure, bool_or(kind = 6) AS fields FROM symbol WHERE parent_usr IS NOT NULL GROUP BY parent_usr)"
_NODES = f"""{_FLAGS}, nodes AS (SELECT s.id, CASE WHEN s.kind = 22 THEN 9 WHEN f.pure AND NOT f.impure AND NOT f.fields THEN CASE s.kind WHEN 31 THEN 8 ELSE 3 END
    WHEN f.pure THEN CASE s.kind WHEN 31 THEN 7 ELSE 2 END ELSE CASE s.kind WHEN 31 THEN 6 ELSE 1 END END AS kind FROM symbol s LEFT JOIN flags f ON f.usr = s.usr WHERE s.kind IN (4, 22, 31))"""


@query("SELECT id, kind FROM nodes", ("symbol",), False, _NODES)
def entity_kinds(spark, sf_dir):
    return R.entity_nodes(catalog(spark, sf_dir))


_ENT = f"""{_NODES},
own AS (SELECT src_id AS m, dst_id AS c FROM edge WHERE kind = 9),
held AS (SELECT e.src_id AS f, e.dst_id AS c, CASE WHEN s.type_info LIKE '%*' THEN 6 WHEN s.type_info LIKE 'std::shared_ptr<%' THEN 5 ELSE 4 END AS kind,
                CASE WHEN s.type_info LIKE 'std::vector<%' THEN 3 WHEN s.type_info LIKE '%*' OR s.type_info LIKE 'std::%_ptr<%' THEN 2 ELSE 1 END AS many,
                CASE s.access WHEN 'private' THEN 2 WHEN 'protected' THEN 1 ELSE 0 END AS access,
                replace(replace(replace(replace(replace(s.type_info, 'std::vector<', ''), 'std::shared_ptr<', ''), 'std::unique_ptr<', ''), '>', ''), ' *', '') AS core FROM edge e JOIN symbol s ON s.id = e.src_id WHERE e.kind = 8),
ee AS (SELECT e.src_id, e.dst_id, CASE WHEN n.kind = 3 THEN 2 ELSE 1 END AS kind, 1 AS count, CAST(NULL AS BIGINT) AS via, 1 AS many, coalesce(e.base_access, 0) AS access, CAST(NULL AS INT) AS form, 0 AS partial
       FROM edge e JOIN nodes n ON n.id = e.dst_id WHERE e.kind = 2
       UNION ALL SELECT src_id, dst_id, CASE kind WHEN 4 THEN 3 ELSE 11 END, 1, NULL, 1, 0, NULL, 0 FROM edge WHERE kind IN (4, 5)
       UNION ALL SELECT h.c, s.id, h.kind, 1, h.f, h.many, h.access, NULL, 0 FROM held h JOIN symbol s ON s.qual_name = h.core AND s.kind = 4 WHERE h.c <> s.id
       UNION ALL SELECT e.src_id, a.ref_id, h.kind, 1, h.f, h.many, h.access, NULL, 0 FROM edge e JOIN held h ON h.c = e.dst_id JOIN template_param p ON p.owner_id = e.dst_id AND p.name = h.core
                 JOIN template_arg a ON a.owner_id = e.src_id AND a.position = p.position AND a.arg_kind = 1 WHERE e.kind = 5
       UNION ALL SELECT o.c, e.dst_id, CASE e.kind WHEN 16 THEN 9 ELSE 7 END, count(*), NULL, 1, 0, CASE e.kind WHEN 10 THEN 3 WHEN 12 THEN 5 END, 0 FROM edge e JOIN own o ON o.m = e.src_id WHERE e.kind IN (10, 12, 16) AND o.c <> e.dst_id GROUP BY o.c, e.dst_id, e.kind
       UNION ALL SELECT o.c, p.c, 8, count(*), e.dst_id, 1, 0, NULL, max(s.is_pure) FROM edge e JOIN own o ON o.m = e.src_id
                 JOIN own p ON p.m = e.dst_id JOIN symbol s ON s.id = e.dst_id WHERE e.kind IN (1, 7) AND o.c <> p.c GROUP BY o.c, p.c, e.dst_id
       UNION ALL SELECT src_id, dst_id, 10, 1, NULL, 1, 0, NULL, 0 FROM edge WHERE kind = 17
       UNION ALL SELECT e.src_id, e.dst_id, 12, 1, NULL, 1, 0, NULL, 0 FROM edge e JOIN nodes n ON n.id = e.dst_id WHERE e.kind = 3)"""
_FACTS = ("symbol", "edge", "template_param", "template_arg")


@query("SELECT src_id, dst_id, kind, count, via AS via_member_id, many AS multiplicity, access, form AS create_form, partial FROM ee", _FACTS, False, _ENT)
def entity_edges(spark, sf_dir):
    """All twelve kinds of design-level edges."""
    return R.entity_edges(catalog(spark, sf_dir)).select("src_id", "dst_id", "kind", "count", "via_member_id", "multiplicity", "access", "create_form", "partial")


def entity_graph(spark: SparkSession, sf_dir: str) -> EntityGraph:
    return EntityGraph(Graph(R.resolve(catalog(spark, sf_dir))))


@query(
    "SELECT DISTINCT s.id, s.qual_name AS name FROM r JOIN ee u ON u.kind = 8 AND u.src_id = r.b JOIN symbol s ON s.id = u.dst_id",
    _FACTS, True, _ENT + ", r(b) AS (SELECT src_id FROM ee WHERE kind = 1 AND dst_id = 100 UNION SELECT e.src_id FROM r JOIN ee e ON e.kind = 1 AND e.dst_id = r.b)",
)
def entity_query_chain(spark, sf_dir):
    """What the subclasses of the first class use."""
    return entity_graph(spark, sf_dir).query(100).derived(transitive=True).uses().nodes().select("id", "name")


_KINDS = "CASE kind " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in ENTITY_EDGE_KIND.items()) + " END"


@query(f"SELECT {_KINDS} AS kind, count(*) AS n FROM ee GROUP BY 1", _FACTS, False, _ENT)
def entity_stats(spark, sf_dir):
    return entity_graph(spark, sf_dir).stats()


@query("SELECT a, b FROM r", _FACTS, True, _ENT + ", d AS (SELECT DISTINCT src_id AS a, dst_id AS b FROM ee WHERE kind IN (4, 5, 6, 7, 8)), r(a, b) AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b)")
def entity_dependency_closure(spark, sf_dir):
    e = cut(R.entity_edges(catalog(spark, sf_dir)).where("kind in (4, 5, 6, 7, 8)"), "design")
    return C.reach(e.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))).select("a", "b")


# --- the pattern language


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(Graph(R.resolve(catalog(spark, sf_dir))))


@query("SELECT qual_name AS \"f.name\", access AS \"f.access\" FROM symbol WHERE kind = 21 AND access <> 'private' AND regexp_matches(qual_name, 'm[0-3]$')", ("symbol",))
def pattern_match(spark, sf_dir):
    return engine(spark, sf_dir).run('match method f where f.name ~ "m[0-3]$" and not f.access = "private" select f.name, f.access')


@query("SELECT s.qual_name AS \"c.name\" FROM symbol s WHERE s.kind = 4 AND s.id IN (SELECT a FROM r WHERE b = 101)", ("symbol", "edge"), True, _SUB)
def pattern_closure(spark, sf_dir):
    return engine(spark, sf_dir).run('match class c where c inherits+ "AMERICA::NATION_1" select c.name')


@query("SELECT x.qual_name AS \"a.name\", y.qual_name AS \"b.name\" FROM r JOIN symbol x ON x.id = r.a JOIN symbol y ON y.id = r.b WHERE regexp_matches(x.qual_name, 'ASIA')", ("symbol", "edge"), True, _SUB)
def pattern_join(spark, sf_dir):
    return engine(spark, sf_dir).run('match class a, class b where a inherits+ b and a.namespace = "ASIA" select a.name, b.name')


_ALLCALLS = f"{_OVER}, allc AS (SELECT DISTINCT src_id AS a, dst_id AS b FROM edge WHERE kind = 1 UNION SELECT c.src_id, r.target FROM edge c JOIN r ON r.base = c.dst_id WHERE c.kind = 1 AND c.src_id <> r.target)"


@query("SELECT count(DISTINCT c.a) AS score, s.id, s.qual_name AS name FROM symbol s LEFT JOIN allc c ON c.b = s.id WHERE s.kind = 21 GROUP BY s.id, s.qual_name ORDER BY score DESC, length(s.qual_name), s.qual_name, s.id LIMIT 10", ("symbol", "edge"), True, _ALLCALLS)
def pattern_rank(spark, sf_dir):
    return engine(spark, sf_dir).run("rank f in match method f select f by count(callers f) desc limit 10").select("score", "id", "name")


@query(
    """SELECT w.step, w.id, s.qual_name AS name FROM (SELECT unnest(way) AS id, generate_subscripts(way, 1) - 1 AS step FROM
       (SELECT way FROM r WHERE b = 105 ORDER BY len(way), way LIMIT 1) o) w JOIN symbol s ON s.id = w.id""",
    ("symbol", "edge"), True, "r(b, way) AS (SELECT CAST(100 AS BIGINT), [CAST(100 AS BIGINT)] UNION ALL SELECT e.src_id, list_append(r.way, e.src_id) FROM r JOIN edge e ON e.dst_id = r.b AND e.kind = 2 WHERE NOT list_contains(r.way, e.src_id) AND len(r.way) < 12)",
)
def pattern_path(spark, sf_dir):
    return engine(spark, sf_dir).run('show path from "AFRICA::NATION_0" to "AFRICA::NATION_5" via inherits')


# --- rules

_RULES = """
.decl chain(m: symbol, b: symbol)
chain(m, b) :- overrides(m, b).
chain(m, b) :- chain(m, k), overrides(k, b).
.decl lone(m: number, c: number, n: number)
lone(m, c, n) :- method_of(m, c), !chain(m, _), n = count : { chain(x, _), method_of(x, c) }.
"""


@query(
    "SELECT m.src_id AS m, m.dst_id AS c, (SELECT count(*) FROM r JOIN edge k ON k.kind = 9 AND k.src_id = r.target WHERE k.dst_id = m.dst_id) AS n FROM edge m WHERE m.kind = 9 AND m.src_id NOT IN (SELECT target FROM r)",
    ("edge",), True, _OVER,
)
def rules_negation_count(spark, sf_dir):
    g = graph(spark, sf_dir)
    return Program(_RULES).run(spark, {"overrides": g.pairs(["overrides"]), "method_of": g.pairs(["method_of"])}, ["lone"])["lone"]


@query("SELECT id, mult, rn FROM (SELECT src_id AS id, count AS mult, row_number() OVER (PARTITION BY src_id ORDER BY count DESC, dst_id) AS rn FROM edge WHERE kind = 1) x WHERE rn <= 2", ("edge",))
def top_calls(spark, sf_dir):
    """Each caller's two most counted calls."""
    e = catalog(spark, sf_dir)["edge"].where("kind = 1")
    rank = F.row_number().over(Window.partitionBy("src_id").orderBy(F.desc("count"), "dst_id"))
    return e.select(F.col("src_id").alias("id"), F.col("count").alias("mult"), rank.alias("rn")).where("rn <= 2")


# --- callers and callees, templates, definitions


_TARGETS = f"{_OVER}, land AS (SELECT DISTINCT x.id, x.target FROM (SELECT base AS id, target FROM r UNION SELECT base, base FROM r) x JOIN symbol s ON s.id = x.target WHERE s.is_pure = 0)"


@query("SELECT DISTINCT l.id, o.dst_id AS receiver, l.target FROM land l JOIN edge o ON o.kind = 9 AND o.src_id = l.target", ("symbol", "edge"), True, _TARGETS)
def dispatch_selection(spark, sf_dir):
    """For each virtual method and receiver type the method that a call lands on."""
    return graph(spark, sf_dir).dispatch_selection(None)


@query("SELECT id FROM symbol WHERE is_pure = 1 UNION SELECT src_id FROM edge WHERE kind = 6 UNION SELECT dst_id FROM edge WHERE kind = 6", ("symbol", "edge"))
def virtual_methods(spark, sf_dir):
    return graph(spark, sf_dir).virtual_methods()


@query("SELECT DISTINCT src_id AS id, dst_id AS peer FROM edge WHERE kind = 1 AND dst_id IN (SELECT id FROM symbol WHERE is_pure = 1 UNION SELECT src_id FROM edge WHERE kind = 6 UNION SELECT dst_id FROM edge WHERE kind = 6)", ("symbol", "edge"))
def virtual_callees(spark, sf_dir):
    return graph(spark, sf_dir).virtual_callees(None)


@query("SELECT b AS id, a AS peer FROM allc", ("edge",), True, _ALLCALLS)
def callers_with_dispatch(spark, sf_dir):
    """Who calls a symbol, by itself or by a method that it overrides."""
    g = Graph(catalog(spark, sf_dir))
    g.c["edge"] = g.c["edge"].unionByName(R.dispatch_calls(g.c), allowMissingColumns=True)
    return g.callers().select("id", "peer").distinct()


@query("SELECT e.src_id AS id, min(e.dst_id) AS template FROM edge e WHERE e.kind = 5 GROUP BY e.src_id", ("edge",))
def template_of(spark, sf_dir):
    return graph(spark, sf_dir).template_of(None)


@query("SELECT owner_id, position, arg_kind, ref_id, literal FROM template_arg", ("template_arg",))
def template_args(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.template_args(g.c["symbol"].select("id")).select("owner_id", "position", "arg_kind", "ref_id", "literal")


@query(
    "SELECT i.id, o.id AS shown_owner, i.name FROM (SELECT id, name FROM disp) i JOIN template_arg a ON a.owner_id = i.id AND a.arg_kind = 1 JOIN disp o ON o.id = a.ref_id",
    ("symbol", "file", "template_arg"), False, _DISP,
)
def named_instances(spark, sf_dir):
    """Instances under their unique names, with the class that is bound."""
    c = catalog(spark, sf_dir)
    names = N.display_names(c)
    bound = c["template_arg"].where("arg_kind = 1").select(F.col("owner_id").alias("id"), F.col("ref_id").alias("shown_owner"))
    return names.join(bound, "id").select("id", "shown_owner", "name")


@query(
    "SELECT x.name AS owner, a.position, a.arg_kind, coalesce(y.name, '') AS referenced, coalesce(a.literal, '') AS literal FROM template_arg a JOIN disp x ON x.id = a.owner_id LEFT JOIN disp y ON y.id = a.ref_id",
    ("symbol", "file", "template_arg"), False, _DISP,
)
def template_arg_facts(spark, sf_dir):
    return N.template_arg_facts(catalog(spark, sf_dir))


@query(
    "SELECT x.name AS caller, y.name AS callee, coalesce(f.name, '') AS file, s.line, s.col, s.conditional, c.n AS occurrences FROM calls c JOIN site s ON s.a = c.a AND s.b = c.b JOIN disp x ON x.id = c.a JOIN disp y ON y.id = c.b LEFT JOIN file f ON f.id = s.file_id",
    ("symbol", "file", "site", "calls"), False, _DISP,
)
def call_site_facts(spark, sf_dir):
    return N.call_site_facts(catalog(spark, sf_dir))


_BODIES = "bodies AS (SELECT symbol_id, count(*) AS n FROM definition GROUP BY symbol_id)"


@query("SELECT s.id, coalesce(b.n, 0) AS multi_def FROM symbol s LEFT JOIN bodies b ON b.symbol_id = s.id", ("symbol", "definition"), False, _BODIES)
def multi_def(spark, sf_dir):
    return R.multi_def(catalog(spark, sf_dir)).select("id", F.col("multi_def").cast("long").alias("multi_def"))


_POSSIBLE = f"{_BODIES}, possible AS (SELECT e.src_def_id, d.id AS dst_def_id, sum(e.count) AS count FROM def_edge e JOIN bodies b ON b.symbol_id = e.dst_id AND b.n > 1 JOIN definition d ON d.symbol_id = e.dst_id GROUP BY 1, 2)"


@query("SELECT src_def_id, dst_def_id, CAST(count AS BIGINT) AS count FROM possible", ("definition", "def_edge"), False, _POSSIBLE)
def possible_calls(spark, sf_dir):
    """A body's calls of what has several bodies, to each of them."""
    c = catalog(spark, sf_dir)
    return R.possible_calls(c.replaced(symbol=R.multi_def(c)))


@query("SELECT DISTINCT d.symbol_id AS id, p.dst_def_id AS definition FROM possible p JOIN definition d ON d.id = p.src_def_id", ("definition", "def_edge"), False, _POSSIBLE)
def possible_callees(spark, sf_dir):
    c = catalog(spark, sf_dir)
    c = c.replaced(symbol=R.multi_def(c))
    return Graph(c.replaced(possible_call=R.possible_calls(c))).possible_callees(None)


@query("SELECT DISTINCT dst_id AS id, src_def_id AS definition FROM def_edge", ("def_edge",))
def referencing_definitions(spark, sf_dir):
    return graph(spark, sf_dir).referencing_definitions(None)


@query("SELECT f.id AS file_id, '/src/lib' || (f.id % 5) || '/' || d.path || '/' || f.name AS path FROM file f JOIN directory d ON d.id = f.directory_id", ("file", "directory"))
def file_paths(spark, sf_dir):
    return graph(spark, sf_dir).files().select("file_id", "path")


def virtual_sites(spark, sf_dir):
    """Every virtual call site with the methods it can land on, and which the receivers' types leave."""
    return CodeBase(graph(spark, sf_dir)).virtual_sites().select("caller", "method", "line", "col", "receiver", "target", "kept")


QUERIES["virtual_sites"] = virtual_sites


# --- rule programs


def _first_step(spark, sf_dir) -> DataFrame:
    """(a): the first caller of a caller."""
    c = calls(spark, sf_dir)
    return cut(c.join(c.select(F.col("a").alias("b")).distinct(), "b", "left_semi").agg(F.min("a").alias("id")), "first", rows=1)


def _second_step(spark, sf_dir) -> DataFrame:
    c = calls(spark, sf_dir)
    first = c.join(F.broadcast(_first_step(spark, sf_dir).withColumnRenamed("id", "a")), "a", "left_semi").select(F.col("b").alias("a"))
    return cut(c.join(sent(cut(first, "second")), "a", "left_semi").agg(F.max("b").alias("id")), "second", rows=1)


def _ids(*ids: int):
    return lambda spark, sf_dir: spark.createDataFrame([(i,) for i in ids], "id long")


def _overriding(spark, sf_dir) -> DataFrame:
    return catalog(spark, sf_dir)["edge"].where("kind = 6").agg(F.max("src_id").alias("id"))


def _called(spark, sf_dir) -> DataFrame:
    return calls(spark, sf_dir).agg(F.min("b").alias("id"))


def _instance(spark, sf_dir) -> DataFrame:
    return catalog(spark, sf_dir)["edge"].where("kind = 5").agg(F.min("src_id").alias("id"))


_SEED_SQL = {
    _first_step: "SELECT min(x.a) FROM calls x JOIN calls y ON y.a = x.b", _overriding: "SELECT max(src_id) FROM edge WHERE kind = 6", _called: "SELECT min(b) FROM calls", _instance: "SELECT min(src_id) FROM edge WHERE kind = 5",
    _second_step: "SELECT max(y.b) FROM calls x JOIN calls y ON y.a = x.b WHERE x.a = (SELECT min(x.a) FROM calls x JOIN calls y ON y.a = x.b)",
}
_NAMED = f"{_DISP}, ne AS (SELECT e.kind, x.name AS a, y.name AS b FROM edge e JOIN disp x ON x.id = e.src_id JOIN disp y ON y.id = e.dst_id)"
_DESIGN = f"{_ENT}, {_NAMED}, nee AS (SELECT e.kind, x.name AS a, y.name AS b FROM ee e JOIN disp x ON x.id = e.src_id JOIN disp y ON y.id = e.dst_id)"
_SIGNED = "signed AS (SELECT d.name, split_part(s.type_info, ' (', 1) || ' ' || s.qual_name || substr(s.type_info, position(' (' IN s.type_info) + 1) AS signature FROM symbol s JOIN disp d ON d.id = s.id WHERE s.kind IN (8, 21))"
_PLACES = "places AS (SELECT x.name AS caller, y.name AS callee, coalesce(f.name, '') AS file, s.line, s.conditional FROM site s JOIN disp x ON x.id = s.a JOIN disp y ON y.id = s.b LEFT JOIN file f ON f.id = s.file_id)"
_NC = "nc AS (SELECT a, b FROM ne WHERE kind = 1)"


def rule(program: str, relation: str, sql: str, more: str = "", seeds=None, targets=None, design: bool = False) -> None:
    """Registers an output of a rule program as dl_<program>_<relation>."""

    def run_(spark, sf_dir):
        c = catalog(spark, sf_dir)
        c = c.later("entity_edge", lambda: cut(R.entity_edges(c), "design"))
        names = programs.coded(N.display_names(c))
        named = (programs.name_of(c, f(spark, sf_dir), names) if f else None for f in (seeds, targets))
        return programs.run(program, c, [relation], *named, names=names)[relation]

    name = f"dl_{program}_{relation}"
    QUERIES[name] = run_
    parts = [_DESIGN if design else _NAMED, _NC]
    for what, f in (("seed", seeds), ("target", targets)):
        if f is not None:
            parts.append(f"{what} AS (SELECT name FROM disp WHERE id IN ({_SEED_SQL.get(f) or f.sql}))")
    used = ("symbol", "file", "edge", "site", "calls") + (("template_param", "template_arg") if design or "template_arg" in sql else ())
    ORACLE_SQL[name] = _with(*used, recursive=True).rstrip() + "".join(", " + p for p in [*parts, *([more] if more else [])]) + " " + sql


def _at(*ids: int):
    f = _ids(*ids)
    f.sql = ", ".join(map(str, ids))
    return f


_DOWN = "cone(f) AS (SELECT name FROM seed UNION SELECT c.b FROM cone k JOIN nc c ON c.a = k.f)"
_FAR = "far(a, b) AS (SELECT c.a, c.b FROM nc c JOIN seed s ON s.name = c.a UNION SELECT r.a, c.b FROM far r JOIN nc c ON c.a = r.b)"
_UP = "up(f) AS (SELECT name FROM seed UNION SELECT c.a FROM up k JOIN nc c ON c.b = k.f)"
_SUPER = "p AS (SELECT a, b FROM ne WHERE kind = 2 UNION SELECT a, b FROM nee WHERE kind IN (1, 2)), above(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM above r JOIN p ON p.a = r.b)"
_DEPS = "deps AS (SELECT DISTINCT a, kind, b FROM nee WHERE kind IN (4, 5, 6, 7, 8)), dep(a, b) AS (SELECT a, b FROM deps UNION SELECT r.a, d.b FROM dep r JOIN deps d ON d.a = r.b)"
_ARCH = "deps AS (SELECT DISTINCT a, kind, b FROM nee WHERE kind IN (4, 5, 6, 7, 8, 9)), dep(a, b) AS (SELECT d.a, d.b FROM deps d JOIN seed s ON s.name = d.a UNION SELECT r.a, d.b FROM dep r JOIN deps d ON d.a = r.b)"
_IMPACT = "hit(changed, caller) AS (SELECT c.b, c.a FROM nc c JOIN seed s ON s.name = c.b UNION SELECT h.changed, c.a FROM hit h JOIN nc c ON c.b = h.caller)"
_ROUTE = "src(f) AS (SELECT name FROM seed UNION SELECT c.b FROM src k JOIN nc c ON c.a = k.f), dst(f) AS (SELECT name FROM target UNION SELECT c.a FROM dst k JOIN nc c ON c.b = k.f), route AS (SELECT DISTINCT c.a, c.b FROM nc c JOIN src ON src.f = c.a JOIN dst ON dst.f = c.b)"

rule("base", "subtype", "SELECT a AS sub, b AS super FROM above", _SUPER, design=True)
rule("base", "edep", "SELECT a, b FROM dep", _DEPS, design=True)
rule("base", "reach", "SELECT a, b FROM far", _FAR, _first_step)
rule("base", "cg_out", "SELECT DISTINCT c.a AS caller, c.b AS callee FROM nc c JOIN cone k ON k.f = c.a", _DOWN, _first_step)
rule("base", "cg_in", "SELECT DISTINCT c.a AS caller, c.b AS callee FROM nc c JOIN up k ON k.f = c.b", _UP, _called)
_KIND_NAMES = "CASE s.kind " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in SYMBOL_KIND.items()) + " ELSE 'unknown' END"
rule("inventory", "symbols_by_kind", f"SELECT {_KIND_NAMES} AS kind, count(*) AS total FROM symbol s GROUP BY 1")
rule("callgraph", "call_edge", "SELECT DISTINCT c.a AS caller, c.b AS callee FROM nc c JOIN cone k ON k.f = c.a", _DOWN, _first_step)
rule("callgraph", "reachable", "SELECT a AS caller, b AS callee FROM far", _FAR, _first_step)
rule("callgraph", "recursive", "SELECT a AS symbol FROM far WHERE a = b", _FAR, _first_step)
rule("callgraph", "call_location", "SELECT DISTINCT p.caller, p.callee, p.file, p.line, p.conditional FROM places p JOIN cone k ON k.f = p.caller", f"{_DOWN}, {_PLACES}", _first_step)
rule("references", "incoming_reference", "SELECT DISTINCT CASE e.kind WHEN 1 THEN 'calls' ELSE 'uses' END AS kind, e.a AS source, e.b AS target FROM ne e JOIN seed s ON s.name = e.b WHERE e.kind IN (1, 7)", "", _overriding)
rule("references", "unreferenced_definition", "SELECT s.name FROM seed s WHERE s.name NOT IN (SELECT b FROM ne WHERE kind IN (1, 7))", "", _at(100, 105))
rule("hierarchy", "ancestor", "SELECT r.a AS derived, r.b AS base FROM above r JOIN seed s ON s.name = r.a", _SUPER, _at(124), design=True)
rule("hierarchy", "override_chain", "SELECT r.a AS method, r.b AS base_method FROM r JOIN seed s ON s.name = r.a", "r(a, b) AS (SELECT a, b FROM ne WHERE kind = 6 UNION SELECT r.a, e.b FROM r JOIN ne e ON e.kind = 6 AND e.a = r.b)", _overriding)
rule("architecture", "depends_transitively", "SELECT a AS src, b AS dst FROM dep", _ARCH, _at(105), design=True)
rule("architecture", "dependency_edge", f"SELECT DISTINCT d.a AS src, {_KINDS.replace('CASE kind', 'CASE d.kind')} AS relation, d.b AS dst FROM deps d WHERE d.a IN (SELECT name FROM seed UNION SELECT b FROM dep)", _ARCH, _at(105), design=True)
rule("impact", "impacts", "SELECT changed, caller FROM hit", _IMPACT, _called)
rule("impact", "blast_radius", "SELECT changed, count(*) AS callers FROM hit GROUP BY changed", _IMPACT, _called)
rule("metrics", "fan_in", "SELECT s.name AS symbol, count(DISTINCT c.a) AS total FROM seed s LEFT JOIN nc c ON c.b = s.name GROUP BY s.name", "", _called)
rule("metrics", "fan_out", "SELECT s.name AS symbol, count(DISTINCT c.b) AS total FROM seed s LEFT JOIN nc c ON c.a = s.name GROUP BY s.name", "", _first_step)
rule("metrics", "dependency_count", "SELECT s.name AS entity, count(DISTINCT d.b) AS total FROM seed s LEFT JOIN nee d ON d.a = s.name AND d.kind IN (4, 5, 6, 7, 8) GROUP BY s.name", "", _at(105), design=True)
rule("templates", "selected_instantiation", "SELECT e.a AS instance, e.b AS primary FROM ne e JOIN seed s ON s.name = e.a WHERE e.kind = 5".replace("AS primary", 'AS "primary"'), "", _instance)
rule("templates", "template_argument", "SELECT s.name AS owner, t.position, CASE t.arg_kind WHEN 1 THEN 'type' ELSE 'value' END AS kind, CASE t.arg_kind WHEN 1 THEN coalesce(y.name, '') ELSE coalesce(t.literal, '') END AS value FROM seed s JOIN disp x ON x.name = s.name JOIN template_arg t ON t.owner_id = x.id LEFT JOIN disp y ON y.id = t.ref_id", "", _instance)
rule("cross_file", "file_dependency", "SELECT x.file AS source, y.file AS target, count(*) AS calls FROM (SELECT DISTINCT a, b FROM nc) c JOIN at_ x ON x.name = c.a JOIN at_ y ON y.name = c.b WHERE x.file <> y.file GROUP BY 1, 2", "at_ AS (SELECT d.name, f.name AS file FROM symbol s JOIN disp d ON d.id = s.id JOIN file f ON f.id = s.file_id)")
rule("all_paths", "path_exists", "SELECT s.name AS source, x.signature AS source_signature, t.name AS target, y.signature AS target_signature FROM seed s JOIN target t ON t.name IN (SELECT f FROM src) JOIN signed x ON x.name = s.name JOIN signed y ON y.name = t.name", f"{_ROUTE}, {_SIGNED}", _first_step, _second_step)
rule("all_paths", "path_node", "SELECT src.f AS node, x.signature AS full_signature FROM src JOIN dst ON dst.f = src.f JOIN signed x ON x.name = src.f", f"{_ROUTE}, {_SIGNED}", _first_step, _second_step)
rule("all_paths", "path_edge", "SELECT r.a AS caller, x.signature AS caller_signature, r.b AS callee, y.signature AS callee_signature FROM route r JOIN signed x ON x.name = r.a JOIN signed y ON y.name = r.b", f"{_ROUTE}, {_SIGNED}", _first_step, _second_step)
rule("all_paths", "path_location", "SELECT DISTINCT p.caller, p.callee, p.file, p.line, p.conditional FROM places p JOIN route r ON r.a = p.caller AND r.b = p.callee", f"{_ROUTE}, {_PLACES}", _first_step, _second_step)
rule("writeback", "impact_of_change", "SELECT changed, caller FROM hit", _IMPACT, _called)


# --- the typed view


def code(spark: SparkSession, sf_dir: str) -> CodeBase:
    return CodeBase(graph(spark, sf_dir))


def _records(m: CodeBase) -> DataFrame:
    return m.c["symbol"].where("kind in (4, 31)").select("id")


@query("SELECT DISTINCT dst_id AS id, src_id AS peer FROM edge WHERE kind = 8", ("edge",))
def record_fields(spark, sf_dir):
    m = code(spark, sf_dir)
    return m.fields(_records(m))


@query("SELECT DISTINCT dst_id AS id, src_id AS peer FROM edge WHERE kind = 9", ("edge",))
def record_methods(spark, sf_dir):
    m = code(spark, sf_dir)
    return m.methods(_records(m))


@query("SELECT s.id, min(o.id) AS peer FROM symbol s JOIN symbol o ON o.usr = s.parent_usr AND o.kind IN (4, 31) GROUP BY s.id", ("symbol",))
def method_owner(spark, sf_dir):
    return code(spark, sf_dir).owner()


@query("SELECT b AS id, a AS peer FROM r", ("edge",), True, _SUB)
def record_children(spark, sf_dir):
    m = code(spark, sf_dir)
    return m.children(_records(m))


@query("SELECT id, CASE kind WHEN 3 THEN 'interface' WHEN 8 THEN 'interface' WHEN 2 THEN 'abstract' WHEN 7 THEN 'abstract' ELSE 'concrete' END AS class_kind FROM nodes", ("symbol",), False, _NODES)
def class_kinds(spark, sf_dir):
    return code(spark, sf_dir).class_kinds()


@query("SELECT src_id AS id, dst_id AS peer FROM edge WHERE kind IN (4, 5)", ("edge",))
def primary_template(spark, sf_dir):
    return code(spark, sf_dir).primary_template()


@query("SELECT a.owner_id AS id, a.position, a.arg_kind, coalesce(s.qual_name, a.literal) AS text, a.ref_id AS entity FROM template_arg a LEFT JOIN symbol s ON s.id = a.ref_id", ("symbol", "template_arg"))
def template_arguments(spark, sf_dir):
    return code(spark, sf_dir).template_arguments()


@query("SELECT id, split_part(type_info, ' (', 1) AS returns FROM symbol WHERE kind IN (8, 21)", ("symbol",))
def signatures(spark, sf_dir):
    return code(spark, sf_dir).signatures().select("id", "returns")


@query("SELECT s.id FROM symbol s WHERE s.kind = 4 AND s.qual_name LIKE 'ASIA::%'", ("symbol",))
def namespace_classes(spark, sf_dir):
    return code(spark, sf_dir).namespace_classes("ASIA").select("id")


@query("SELECT s.id, coalesce(b.n, 0) > 1 AS redefined FROM symbol s LEFT JOIN bodies b ON b.symbol_id = s.id", ("symbol", "definition"), False, _BODIES)
def redefined_symbols(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return CodeBase(Graph(c.replaced(symbol=R.multi_def(c)))).is_redefined()


_PATHS = "paths AS (SELECT f.id, '/src/lib' || (f.id % 5) || '/' || d.path || '/' || f.name AS path FROM file f JOIN directory d ON d.id = f.directory_id)"


@query("SELECT s.id, 'definition' AS role, p.path, s.line FROM symbol s LEFT JOIN paths p ON p.id = s.file_id WHERE s.file_id IS NOT NULL", ("symbol", "file", "directory"), False, _PATHS)
def symbol_locations(spark, sf_dir):
    return graph(spark, sf_dir).def_decl_locations().select("id", "role", "path", "line")


@query("SELECT s.a AS caller, s.b AS method, s.line, s.col, x.src_kind, x.type_usr, x.decl_usr FROM site s JOIN (SELECT DISTINCT a, b, line, col, src_kind, type_usr, decl_usr FROM receiver) x ON x.a = s.a AND x.b = s.b AND x.line = s.line AND x.col = s.col WHERE s.b IN (SELECT id FROM symbol WHERE is_pure = 1 UNION SELECT src_id FROM edge WHERE kind = 6 UNION SELECT dst_id FROM edge WHERE kind = 6)", ("symbol", "edge", "site", "receiver"))
def virtual_call_sites(spark, sf_dir):
    """Every place at which a virtual method is called, with where its receiver comes from."""
    return graph(spark, sf_dir).virtual_call_sites().select("caller", "method", "line", "col", "src_kind", "type_usr", "decl_usr")


@query("SELECT file_id, line, col, src_kind, type_usr, decl_usr FROM receiver", ("receiver",))
def receiver_provenance(spark, sf_dir):
    return graph(spark, sf_dir).receiver_provenance().select("file_id", "line", "col", "src_kind", "type_usr", "decl_usr")


# --- the store


def store(spark: SparkSession, sf_dir: str) -> Store:
    return Store(catalog(spark, sf_dir))


@query("SELECT id, path AS abs_path FROM paths", ("file", "directory"), False, _PATHS)
def store_files(spark, sf_dir):
    return store(spark, sf_dir).files().select("id", "abs_path")


@query("SELECT p.id, p.path AS abs_path FROM paths p JOIN file f ON f.id = p.id JOIN directory d ON d.id = f.directory_id WHERE d.component_id = 2 AND d.path LIKE 'brand#%'", ("file", "directory"), False, _PATHS)
def store_component_files(spark, sf_dir):
    return store(spark, sf_dir).list_files(component_id=2, name="brand").select("id", "abs_path")


@query("SELECT id, qual_name FROM symbol WHERE lower(qual_name) LIKE '%r%e%d%w%g%'", ("symbol",))
def store_search(spark, sf_dir):
    return store(spark, sf_dir).search_symbols("redwg").select("id", "qual_name")


@query("SELECT id, usr FROM symbol WHERE resolved = 0", ("symbol",))
def store_unresolved(spark, sf_dir):
    return store(spark, sf_dir).unresolved_symbols().select("id", "usr")


@query("SELECT e.src_id, e.dst_id, e.kind FROM edge e WHERE e.src_id NOT IN (SELECT id FROM symbol WHERE file_id = 3) AND e.dst_id NOT IN (SELECT id FROM symbol WHERE file_id = 3)", ("symbol", "edge"))
def store_delete_file(spark, sf_dir):
    """The edges that are left when a file goes with its symbols."""
    s = store(spark, sf_dir)
    s.delete_file(3)
    return s.c["edge"].select("src_id", "dst_id", "kind")


@query("SELECT src_id, dst_id, kind, count + (CASE WHEN kind = 2 THEN 2 ELSE 0 END) AS count FROM edge", ("edge",))
def store_merge_edges(spark, sf_dir):
    """Edges after those of inheritance arrived twice more: counts add up by key."""
    s = store(spark, sf_dir)
    s.add_edges(s.c["edge"].where("kind = 2").withColumn("count", F.lit(2)).drop("id"))
    return s.c["edge"].select("src_id", "dst_id", "kind", "count")


QUERIES |= tree_queries.QUERIES
ORACLE_SQL |= tree_queries.ORACLE_SQL
