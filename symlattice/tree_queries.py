"""The registered queries over syntax trees: every output of the tree programs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symlattice.plans import tree_programs
from symlattice.plans.tree_programs import PROGRAMS
from symlattice.sources import tree_adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Who is asked about: the function that runs first, and what a change of it or a type by name would touch.
SEED, TARGET, TYPE = "main", "NATION_3", "Shape1"

_COMMON = "".join(f"{short} AS MATERIALIZED ({tree_adapter.expanded(table)}), " for short, table in (("n", "tree_node"), ("e", "tree_edge"), ("sy", "tree_symbol"), ("fi", "tree_file")))
_COMMON += """ch AS (SELECT src AS a, dst AS b, pos FROM e WHERE rel = 1), rf AS (SELECT src AS a, dst AS b, pos FROM e WHERE rel = 2),
fd AS (SELECT id, spelling AS name FROM n WHERE kind IN (8, 21, 24, 25) AND definition = 1), mn AS (SELECT n.* FROM n JOIN fi ON fi.id = n.file AND fi.is_main = 1),
mf AS (SELECT id, name FROM fd WHERE id IN (SELECT id FROM mn)), ns AS (SELECT n.id, sy.usr, sy.name FROM n JOIN sy ON sy.id = n.symbol),
de(a, b) AS (SELECT a, b FROM ch UNION SELECT d.a, c.b FROM de d JOIN ch c ON c.a = d.b),
dc AS (SELECT DISTINCT d.a AS f, r.b AS g, s.line FROM de d JOIN fd ON fd.id = d.a JOIN n s ON s.id = d.b AND s.kind = 103 JOIN rf r ON r.a = s.id),
re(a, b) AS (SELECT DISTINCT f, g FROM dc UNION SELECT r.a, c.g FROM re r JOIN dc c ON c.f = r.b),
ts AS (SELECT src AS a, dst AS b FROM e WHERE rel IN (11, 12, 13, 14, 15, 16, 18)),
tr(a, b) AS (SELECT id, id FROM n WHERE kind >= 1000 UNION SELECT r.a, s.b FROM tr r JOIN ts s ON s.a = r.b)"""


def tree_rule(program: str, relation: str, sql: str | None, more: str = "") -> None:
    """Registers an output of a program as tree_<program>_<relation>."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        once = tree_programs.walks(program, [relation])
        tables = {name: tree_adapter.entry(spark, sf_dir, table, once) for name, table in tree_adapter.TABLES.items()}
        one = lambda x: spark.createDataFrame([(x,)], "name string")
        tables |= {"query_seed": one(SEED), "query_target": one(TYPE if program == "types" else TARGET)}
        return tree_programs.run(spark, program, tables, [relation], tree_adapter.unit)[relation]

    name = f"tree_{program}_{relation}"
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = f"WITH RECURSIVE {_COMMON}{', ' + more if more else ''} {sql}"


_WORD = "CASE {}.kind WHEN 205 THEN 'if' WHEN 206 THEN 'switch' WHEN 207 THEN 'while' WHEN 208 THEN 'do' WHEN 209 THEN 'for' ELSE 'return' END"
_SITES = f"cs AS (SELECT DISTINCT mf.id AS f, {_WORD.format('s')} AS k, s.line FROM mf JOIN de ON de.a = mf.id JOIN n s ON s.id = de.b AND s.kind IN (205, 206, 207, 208, 209, 214))"
_USED = "used AS (SELECT b FROM rf UNION SELECT m.dst FROM rf JOIN e m ON m.src = rf.b AND m.rel IN (3, 4))"
_CLASSES = "cl AS (SELECT id, spelling AS name FROM n WHERE kind IN (4, 2, 31, 32)), dr AS (SELECT DISTINCT c.a AS d, r.b FROM ch c JOIN n s ON s.id = c.b AND s.kind = 44 JOIN rf r ON r.a = s.id JOIN cl x ON x.id = c.a JOIN cl y ON y.id = r.b), an(d, b) AS (SELECT d, b FROM dr UNION SELECT x.d, y.b FROM an x JOIN dr y ON y.d = x.b)"
_OWNER = "ow AS (SELECT m.id AS m, m.spelling AS name, c.id AS c, c.spelling AS cls, m.access, m.kind FROM e JOIN n m ON m.id = e.src JOIN n c ON c.id = e.dst WHERE e.rel = 5)"


def _count(name: str, value: str, source: str) -> str:
    """A number for each main function; names that stand for several functions have one for each."""
    return f"SELECT DISTINCT mf.name AS f, coalesce(c.n, 0) AS {value} FROM mf LEFT JOIN (SELECT f, count(*) AS n FROM (SELECT DISTINCT {source}) x GROUP BY f) c ON c.f = mf.id"


tree_rule("basics", "main_functions", "SELECT DISTINCT mf.name, n.line FROM mf JOIN n ON n.id = mf.id")
tree_rule("basics", "main_records", "SELECT DISTINCT CASE kind WHEN 2 THEN 'struct' WHEN 4 THEN 'class' ELSE 'union' END AS kind, spelling AS name, line FROM mn WHERE kind IN (2, 3, 4) AND definition = 1")
tree_rule("basics", "globals", "SELECT DISTINCT v.spelling AS name, t.spelling AS type FROM ch JOIN n v ON v.id = ch.b AND v.kind = 9 JOIN n t ON t.id = v.type WHERE ch.a = 1")
tree_rule("basics", "contributing_files", "SELECT path FROM fi WHERE is_main = 0")
tree_rule("callgraph", "call_display", "SELECT DISTINCT x.usr AS caller_usr, x.name AS caller, y.usr AS callee_usr, y.name AS callee, dc.line FROM dc JOIN ns x ON x.id = dc.f JOIN ns y ON y.id = dc.g")
tree_rule("callgraph", "reach_display", "SELECT DISTINCT x.usr AS caller_usr, x.name AS caller, y.usr AS callee_usr, y.name AS callee FROM re JOIN ns x ON x.id = re.a JOIN ns y ON y.id = re.b")
tree_rule("callgraph", "impacted", f"SELECT DISTINCT x.usr AS caller_usr, x.name AS caller FROM re JOIN ns x ON x.id = re.a JOIN ns y ON y.id = re.b WHERE y.name = '{TARGET}'")
tree_rule("callgraph", "main_cone", f"SELECT DISTINCT y.usr AS callee_usr, y.name AS callee FROM re JOIN fd ON fd.id = re.a AND fd.name = '{SEED}' JOIN ns y ON y.id = re.b")
tree_rule("callgraph", "recursive", "SELECT DISTINCT x.usr AS function_usr, x.name AS function FROM re JOIN ns x ON x.id = re.a WHERE re.a = re.b")
tree_rule("callgraph", "entry_point_display", "SELECT DISTINCT x.usr AS function_usr, x.name AS function FROM dc JOIN ns x ON x.id = dc.f WHERE dc.f NOT IN (SELECT b FROM used)", _USED)
tree_rule("callgraph", "fan_out", "SELECT x.usr AS function_usr, x.name AS function, c.n AS calls FROM (SELECT f, count(*) AS n FROM dc GROUP BY f) c JOIN ns x ON x.id = c.f")
tree_rule("types", "decl_type", "SELECT DISTINCT x.spelling AS name, t.spelling AS type FROM n x JOIN n t ON t.id = x.type WHERE x.kind IN (6, 9, 10) AND x.spelling <> ''")
tree_rule("types", "touches", f"SELECT DISTINCT fd.name AS f, r.spelling AS type FROM fd JOIN de ON de.a = fd.id JOIN n x ON x.id = de.b JOIN tr ON tr.a = x.type JOIN n r ON r.id = tr.b AND r.kind = 1105 AND r.spelling = '{TYPE}'")
tree_rule("types", "returns_pointer", "SELECT DISTINCT fd.name AS f, r.spelling AS ret FROM fd JOIN n x ON x.id = fd.id JOIN e ON e.src = x.type AND e.rel = 14 JOIN n r ON r.id = e.dst AND r.kind = 1101")
tree_rule("types", "deep_pointers", "SELECT DISTINCT n.spelling AS type, d.d AS depth FROM d JOIN n ON n.id = d.t AND n.kind = 1101 WHERE d.d >= 2", "d(t, d) AS (SELECT id, 0 FROM n WHERE kind >= 1000 AND id NOT IN (SELECT src FROM e WHERE rel = 12) UNION SELECT e.src, d.d + 1 FROM d JOIN e ON e.dst = d.t AND e.rel = 12)")
tree_rule("types", "typedef_resolves", "SELECT DISTINCT x.spelling AS alias, t.spelling AS canonical FROM mn x JOIN e ON e.src = x.id AND e.rel = 17 JOIN tr ON tr.a = e.dst JOIN n t ON t.id = tr.b WHERE x.kind = 20 AND t.kind NOT IN (1107, 1119)")
tree_rule("types", "readonly_pointer_param", "SELECT DISTINCT fd.name AS f, p.spelling AS param FROM fd JOIN de ON de.a = fd.id JOIN n p ON p.id = de.b AND p.kind = 10 JOIN e ON e.src = p.type AND e.rel = 12 JOIN tr ON tr.a = e.dst JOIN n q ON q.id = tr.b AND q.is_const = 1")
tree_rule("deadcode", "dead_function", "SELECT DISTINCT mf.name AS f, n.line FROM mf JOIN n ON n.id = mf.id WHERE mf.name <> 'main' AND mf.id NOT IN (SELECT g FROM dc UNION SELECT e.dst FROM dc JOIN e ON e.src = dc.g AND e.rel = 3)")
tree_rule("deadcode", "unused_parameter", "SELECT DISTINCT fd.name AS f, p.spelling AS param FROM fd JOIN de ON de.a = fd.id JOIN n p ON p.id = de.b AND p.kind = 10 WHERE p.spelling <> '' AND p.id NOT IN (SELECT b FROM used)", _USED)
tree_rule("deadcode", "unused_var", "SELECT DISTINCT fd.name AS f, p.spelling AS var, p.line FROM fd JOIN de ON de.a = fd.id JOIN n p ON p.id = de.b AND p.kind = 9 WHERE p.spelling <> '' AND p.id NOT IN (SELECT b FROM used)", _USED)
tree_rule("deadcode", "unused_typedef", "SELECT DISTINCT spelling AS name, line FROM mn WHERE kind = 20 AND id NOT IN (SELECT b FROM used) AND id NOT IN (SELECT e.dst FROM e JOIN tr ON tr.b = e.src JOIN n c ON c.type = tr.a AND c.kind < 1000 AND c.id <> e.dst WHERE e.rel = 10)", _USED)
tree_rule("deadcode", "undefined_prototype", "SELECT DISTINCT spelling AS f, line FROM mn WHERE kind = 8 AND definition = 0 AND id NOT IN (SELECT src FROM e WHERE rel = 3)")
tree_rule("oop", "derives", "SELECT DISTINCT x.name AS derived, y.name AS base FROM dr JOIN cl x ON x.id = dr.d JOIN cl y ON y.id = dr.b", _CLASSES)
tree_rule("oop", "derives_id", "SELECT d AS derived, b AS base FROM dr", _CLASSES)
tree_rule("oop", "ancestor", "SELECT DISTINCT x.name AS derived, y.name AS base FROM an JOIN cl x ON x.id = an.d JOIN cl y ON y.id = an.b", _CLASSES)
tree_rule("oop", "ancestor_id", "SELECT d AS derived, b AS base FROM an", _CLASSES)
tree_rule("oop", "method_of", "SELECT DISTINCT ow.cls AS class, ow.name AS method, ow.access FROM ow JOIN n c ON c.id = ow.c AND c.kind IN (4, 2, 31, 32) AND c.definition = 1 WHERE ow.kind = 21", _OWNER)
tree_rule("oop", "overrides", "SELECT DISTINCT x.name AS derived_m, x.cls AS in_class, y.name AS base_m, y.cls AS of_class FROM e JOIN ow x ON x.m = e.src JOIN ow y ON y.m = e.dst WHERE e.rel = 8", _OWNER)
tree_rule("oop", "leaf_override", "SELECT DISTINCT x.cls AS class, x.name AS method FROM e JOIN ow x ON x.m = e.src WHERE e.rel = 8 AND e.src NOT IN (SELECT dst FROM e WHERE rel = 8)", _OWNER)
tree_rule("oop", "constructs", "SELECT DISTINCT fd.name AS f, c.spelling AS class, dc.line FROM dc JOIN fd ON fd.id = dc.f JOIN n c ON c.id = dc.g AND c.kind = 24")
tree_rule("oop", "specializes", "SELECT DISTINCT s.spelling AS what, t.spelling AS template FROM e JOIN n s ON s.id = e.src JOIN n t ON t.id = e.dst WHERE e.rel = 7 AND s.spelling <> ''")
tree_rule("metrics", "body_size", _count("body_size", "nodes", "de.a AS f, de.b AS x FROM de"))
tree_rule("metrics", "parameter_count", _count("parameter_count", "params", "ch.a AS f, ch.b AS x FROM ch JOIN n ON n.id = ch.b AND n.kind = 10"))
tree_rule("metrics", "fan_out", _count("fan_out", "calls_out", "dc.f, dc.g, dc.line FROM dc"))
tree_rule("metrics", "fan_in", _count("fan_in", "called", "rf.b AS f, rf.a AS x, rf.pos FROM rf"))
tree_rule("metrics", "branchiness", _count("branchiness", "branches", "de.a AS f, de.b AS x FROM de JOIN n ON n.id = de.b AND n.kind IN (205, 206, 207, 208, 209)"))
tree_rule("metrics", "line_span", "SELECT DISTINCT mf.name AS f, n.end_line - n.line + 1 AS lines FROM mf JOIN n ON n.id = mf.id WHERE n.end_line >= n.line")
tree_rule("writeback", "calls", "SELECT f AS caller, g AS callee, line FROM dc")
tree_rule("writeback", "reach", "SELECT a, b FROM re")
tree_rule("writeback", "call_symbol", "SELECT DISTINCT x.usr AS caller_usr, y.usr AS callee_usr, dc.line FROM dc JOIN ns x ON x.id = dc.f JOIN ns y ON y.id = dc.g")
_VARS = "va AS (SELECT id, spelling AS name, kind, line FROM mn WHERE kind IN (9, 10)), rv AS (SELECT DISTINCT n.id AS r, rf.b AS v FROM n JOIN rf ON rf.a = n.id JOIN va ON va.id = rf.b WHERE n.kind = 101 AND (n.id IN (SELECT id FROM mn) OR n.id IN (SELECT de.b FROM de JOIN mf ON mf.id = de.a)))"
_VARS += ", sc AS (SELECT id FROM mf UNION SELECT de.b FROM de JOIN mf ON mf.id = de.a), cd AS (SELECT DISTINCT n.id AS c, r.b AS f FROM n JOIN sc ON sc.id = n.id JOIN rf r ON r.a = n.id JOIN fd ON fd.id = r.b WHERE n.kind = 103 UNION SELECT n.id, m.dst FROM n JOIN sc ON sc.id = n.id JOIN rf r ON r.a = n.id JOIN e m ON m.src = r.b AND m.rel = 3 WHERE n.kind = 103)"
_VARS += ", dx AS (SELECT a, b FROM de UNION SELECT id, id FROM n), pi AS (SELECT ch.a AS f, ch.b AS p, row_number() OVER (PARTITION BY ch.a ORDER BY ch.pos) - 1 AS i FROM ch JOIN n ON n.id = ch.b AND n.kind = 10 JOIN mf ON mf.id = ch.a)"
_VARS += ", rt AS (SELECT DISTINCT mf.id AS f, rv.v FROM mf JOIN de ON de.a = mf.id JOIN n x ON x.id = de.b AND x.kind = 214 JOIN dx ON dx.a = x.id JOIN rv ON rv.r = dx.b)"
_VARS += ", fl AS (SELECT rv.v AS a, va.id AS b FROM va JOIN de ON de.a = va.id JOIN rv ON rv.r = de.b WHERE va.kind = 9 UNION SELECT rv.v, pi.p FROM cd JOIN ch ON ch.a = cd.c AND ch.pos >= 1 JOIN pi ON pi.f = cd.f AND pi.i = ch.pos - 1 JOIN dx ON dx.a = ch.b JOIN rv ON rv.r = dx.b UNION SELECT rt.v, va.id FROM va JOIN de ON de.a = va.id JOIN cd ON cd.c = de.b JOIN rt ON rt.f = cd.f WHERE va.kind = 9), fc(a, b) AS (SELECT a, b FROM fl UNION SELECT x.a, y.b FROM fc x JOIN fl y ON y.a = x.b)"
tree_rule("dataflow", "value_flow_named", 'SELECT DISTINCT x.name AS "from", x.line AS from_line, y.name AS "to", y.line AS to_line FROM fl JOIN va x ON x.id = fl.a JOIN va y ON y.id = fl.b', _VARS)
tree_rule("dataflow", "parameter_influence", "SELECT DISTINCT mf.name AS function, x.name AS parameter, y.name AS variable, y.line FROM pi JOIN mf ON mf.id = pi.f JOIN va x ON x.id = pi.p JOIN fc ON fc.a = pi.p AND fc.b <> pi.p JOIN va y ON y.id = fc.b", _VARS)
tree_rule("control_flow", "control_site_display", "SELECT DISTINCT x.usr AS function_usr, x.name AS function, cs.k AS kind, cs.line FROM cs JOIN ns x ON x.id = cs.f", _SITES)
tree_rule("control_flow", "control_summary", """SELECT DISTINCT x.usr AS function_usr, x.name AS function, coalesce(sum(CASE WHEN k = 'if' THEN 1 END), 0) AS ifs, coalesce(sum(CASE WHEN k = 'switch' THEN 1 END), 0) AS switches,
    count(DISTINCT CASE WHEN k IN ('while', 'do', 'for') THEN cs.line END) AS loops, coalesce(sum(CASE WHEN k = 'return' THEN 1 END), 0) AS returns FROM mf JOIN ns x ON x.id = mf.id LEFT JOIN cs ON cs.f = mf.id GROUP BY mf.id, x.usr, x.name""", _SITES)
tree_rule("templates", "template_argument", "SELECT o.id AS owner, o.spelling AS owner_spelling, e.pos AS position, a.id AS argument, a.spelling AS argument_spelling FROM e JOIN n o ON o.id = e.src AND o.kind >= 1000 JOIN n a ON a.id = e.dst WHERE e.rel = 18")
tree_rule("templates", "specialization", 'SELECT x.id AS what, x.usr AS what_usr, x.name AS what_name, y.id AS "primary", y.usr AS primary_usr, y.name AS primary_name FROM e JOIN ns x ON x.id = e.src JOIN ns y ON y.id = e.dst WHERE e.rel = 7')
tree_rule("templates", "main_template_use", "SELECT DISTINCT d.id AS declaration, d.spelling AS name, o.id AS type, o.spelling AS type_spelling FROM e JOIN n o ON o.id = e.src AND o.kind >= 1000 JOIN mn d ON d.type = o.id WHERE e.rel = 18")
_FILES = "fr AS (SELECT DISTINCT x.file AS p, y.file AS q, rf.a, rf.b FROM rf JOIN n x ON x.id = rf.a JOIN n y ON y.id = rf.b WHERE x.file <> 0 AND y.file <> 0 AND x.file <> y.file)"
tree_rule("dependencies", "file_dependency_display", 'SELECT x.path AS source, y.path AS target, count(*) AS "references" FROM fr JOIN fi x ON x.id = fr.p JOIN fi y ON y.id = fr.q GROUP BY 1, 2', _FILES)
_ANONYMOUS = "SELECT DISTINCT rf.a AS site, rf.b AS target, t.spelling FROM rf JOIN n t ON t.id = rf.b WHERE t.symbol = 0 AND t.spelling <> ''"
tree_rule("dependencies", "anonymous_reference", _ANONYMOUS)
tree_rule("inventory", "node_kind_inventory", "SELECT kind, concat('kind', kind) AS name, CASE WHEN kind >= 1000 THEN 'type' ELSE 'cursor' END AS category, count(*) AS node_count FROM n GROUP BY kind")
tree_rule("inventory", "relation_inventory", "SELECT rel AS relation, concat('relation', rel) AS name, count(*) AS edge_count FROM (SELECT DISTINCT * FROM e) x GROUP BY rel")
tree_rule("inventory", "main_file_nodes", "SELECT count(*) AS node_count FROM mn")
tree_rule("inventory", "header_nodes", "SELECT count(*) AS node_count FROM n JOIN fi ON fi.id = n.file AND fi.is_main = 0")
tree_rule("inventory", "locationless_cursors", "SELECT id, kind FROM n WHERE kind < 1000 AND file = 0")
tree_rule("inventory", "usrless_named_cursors", "SELECT id, kind, spelling FROM n WHERE kind < 1000 AND symbol = 0 AND spelling <> ''")
tree_rule("inventory", "reference_without_usr", _ANONYMOUS)
