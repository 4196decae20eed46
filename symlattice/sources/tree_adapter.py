"""The driver's star schema read as syntax trees, by SQL that Spark and other engines both run.

Regions are files, of which the first three in order are main files; orders are functions with a
parameter, a call of a constructor and a statement for each of their line items, which calls the item's
part with the parameter and the item's supplier, a method of its nation's class; parts are functions
that return their parameter. Every row is in the trees. Ids of the kinds lie 10**9 or more apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.operators.syntax import REL
from symlattice.plans.tree_programs import KIND, NODE
from symlattice.sources.adapter import expand, filled

SOURCES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")
ORDER, PART, ORDER_PARAM, PART_PARAM, PART_RETURN, PART_READ, TYPE, METHOD, MAKE = (n * 10**9 for n in range(1, 10))
STMT, CALL, ARG, METHOD_CALL = (n * 10**17 for n in range(1, 5))
#: What a line item's statement is, by its flags.
_STMT_KIND = f"CASE concat(flag, st) WHEN 'AO' THEN {KIND['if']} WHEN 'AF' THEN {KIND['while']} WHEN 'NO' THEN {KIND['variable']} WHEN 'NF' THEN {KIND['for']} WHEN 'RO' THEN {KIND['switch']} ELSE {KIND['return']} END"


def _node(ident: str, kind: str, source: str, **of: str) -> str:
    of = {"id": ident, "kind": KIND.get(kind, kind)} | of
    text = {"spelling"}
    return "SELECT " + ", ".join(f"CAST({of.get(c, repr('') if c in text else 0)} AS {'STRING' if c in text else 'BIGINT'}) AS {c}" for c in NODE) + f" FROM {source}"


def _edge(src: str, dst: str, relation: str, source: str, position: str = "0") -> str:
    return f"SELECT CAST({src} AS BIGINT) AS src, CAST({dst} AS BIGINT) AS dst, {REL[relation]} AS rel, CAST({position} AS BIGINT) AS pos FROM {source}"


_O, _P, _I, _N, _S, _T, _R = "({order}) o", "({func}) p", "({stmt}) i", "{nation}", "{supplier}", "({kind}) t", "{region}"
SQL = {
    "order": "SELECT o_orderkey AS o, c_nationkey AS n, n_regionkey AS r, o_orderstatus AS status FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
    "func": "SELECT p_partkey AS p, replace(p_name, ' ', '_') AS name, p_size AS size, n_regionkey AS r FROM {part} JOIN {nation} ON n_nationkey = CAST(substr(p_brand, 7) AS BIGINT) - 1",
    # one statement for each item of an order, whatever suppliers it comes from
    "stmt": f"""SELECT x.*, n_regionkey AS r, {_STMT_KIND} AS kind FROM (
        SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS ln, min(l_suppkey) AS s, min(l_returnflag) AS flag, min(l_linestatus) AS st,
               (CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 10000000 + l_partkey AS k FROM {{lineitem}} GROUP BY l_orderkey, l_partkey, l_linenumber) x
        JOIN {{orders}} ON o_orderkey = x.o JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "kind": "SELECT p_type AS name, dense_rank() OVER (ORDER BY p_type) AS t FROM (SELECT DISTINCT p_type FROM {part}) x",
    "peer": "SELECT s_suppkey AS s, s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM {supplier}",
    "tree_file": "SELECT CAST(1 + r_regionkey AS BIGINT) AS id, concat(lower(r_name), '.cc') AS path, CASE WHEN r_regionkey < 3 THEN 1 ELSE 0 END AS is_main FROM {region}",
    "tree_node": "\nUNION ALL ".join([
        "SELECT " + ", ".join({"id": "CAST(1 AS BIGINT) AS id", "kind": "CAST(350 AS BIGINT) AS kind", "spelling": "'all' AS spelling"}.get(c, f"CAST(0 AS BIGINT) AS {c}") for c in NODE),
        _node("100 + n_nationkey", "variable", _N, type=f"{TYPE} + n_regionkey", spelling="concat('g', n_nationkey)", file="1 + n_regionkey", line="n_nationkey"),
        _node("200 + n_nationkey", "class", _N, symbol="200 + n_nationkey", spelling="n_name", file="1 + n_regionkey", line="10 + n_nationkey", end_line="20 + n_nationkey", definition="1"),
        _node("300 + n_nationkey", "base", f"{_N} WHERE n_nationkey > 0", spelling="n_name", file="1 + n_regionkey", line="10 + n_nationkey"),
        _node("400 + n_nationkey", "constructor", _N, symbol="400 + n_nationkey", spelling="n_name", file="1 + n_regionkey", line="11 + n_nationkey", definition="1", access="1"),
        _node("500 + t", "class_template", _T, symbol="500 + t", spelling="name", definition="1"),
        _node("600 + t", "struct", _T, symbol="600 + t", spelling="concat(name, '<int>')", definition="1"),
        _node("800 + n_nationkey", "typedef", _N, type=f"{TYPE} + 100 + n_regionkey", spelling="concat('alias', n_nationkey)", file="1 + n_regionkey", line="40 + n_nationkey"),
        _node(f"{TYPE} + r_regionkey", "record_type", _R, spelling="concat('Shape', r_regionkey)"),
        _node(f"{TYPE} + 100 + r_regionkey", "pointer", _R, spelling="concat('Shape', r_regionkey, ' *')"),
        _node(f"{TYPE} + 200 + r_regionkey", "pointer", _R, spelling="concat('Shape', r_regionkey, ' **')"),
        _node(f"{TYPE} + 300 + r_regionkey", "function_type", _R, spelling="concat('Shape', r_regionkey, ' *(const Shape', r_regionkey, ' *)')"),
        _node(f"{TYPE} + 400 + r_regionkey", "record_type", _R, spelling="concat('const Shape', r_regionkey)", is_const="1"),
        _node(f"{TYPE} + 500 + t", "elaborated", _T, spelling="concat(name, '<Shape>')"),
        _node(f"{TYPE} + 600 + n_nationkey", "typedef_type", _N, spelling="concat('alias', n_nationkey)"),
        _node(f"{TYPE} + 700 + r_regionkey", "pointer", _R, spelling="concat('const Shape', r_regionkey, ' *')"),
        _node(f"{ORDER} + o", "function", _O, symbol=f"{ORDER} + o", type=f"{TYPE} + 300 + r", spelling="CASE WHEN o = 0 THEN 'main' ELSE concat('order', o) END", file="1 + r", line="o", end_line="o + 9", definition="CASE WHEN status = 'P' THEN 0 ELSE 1 END"),
        _node(f"{ORDER_PARAM} + o", "parameter", _O, type=f"{TYPE} + 700 + r", spelling="concat('a', o)", file="1 + r", line="o"),
        _node(f"{MAKE} + o", "call", _O, spelling="'make'", file="1 + r", line="o + 8"),
        _node(f"{PART} + p", "function", _P, symbol=f"{PART} + p", type=f"{TYPE} + 300 + r", spelling="name", file="1 + r", line="p", end_line="p + 2", definition="CASE WHEN size > 2 THEN 1 ELSE 0 END"),
        _node(f"{PART_PARAM} + p", "parameter", _P, type=f"{TYPE} + 700 + r", spelling="concat('b', p)", file="1 + r", line="p"),
        _node(f"{PART_RETURN} + p", "return", _P, file="1 + r", line="p + 1"),
        _node(f"{PART_READ} + p", "name_use", _P, spelling="concat('b', p)", file="1 + r", line="p + 1"),
        _node(f"{METHOD} + s_suppkey", "method", f"{_S} JOIN {{nation}} ON s_nationkey = n_nationkey", symbol=f"{METHOD} + s_suppkey", spelling="concat('m', s_suppkey)", file="1 + n_regionkey", line="s_suppkey", definition="1", access="1 + s_suppkey % 3"),
        _node(f"{STMT} + k", "kind", _I, type=f"CASE WHEN kind = {KIND['variable']} THEN {TYPE} + 200 + r ELSE 0 END", spelling=f"CASE WHEN kind = {KIND['variable']} THEN concat('v', ln) ELSE '' END", file="1 + r", line="o + ln"),
        _node(f"{CALL} + k", "call", _I, spelling="'call'", file="1 + r", line="o + ln"),
        _node(f"{ARG} + k", "name_use", _I, spelling="concat('a', o)", file="1 + r", line="o + ln"),
        _node(f"{METHOD_CALL} + k", "call", _I, spelling="'call'", file="1 + r", line="o + ln"),
    ]),
    "tree_edge": "\nUNION ALL ".join([
        _edge("1", "100 + n_nationkey", "child", _N, "n_nationkey"),
        _edge("200 + n_nationkey", "300 + n_nationkey", "child", f"{_N} WHERE n_nationkey > 0"),
        _edge("300 + n_nationkey", "200 + floor(n_nationkey / 2)", "references", f"{_N} WHERE n_nationkey > 0"),
        _edge(f"{ORDER} + o", f"{ORDER_PARAM} + o", "child", _O),
        _edge(f"{ORDER} + o", f"{MAKE} + o", "child", _O, "99"),
        _edge(f"{MAKE} + o", "400 + n", "references", _O),
        _edge(f"{PART} + p", f"{PART_PARAM} + p", "child", _P),
        _edge(f"{PART} + p", f"{PART_RETURN} + p", "child", _P, "1"),
        _edge(f"{PART_RETURN} + p", f"{PART_READ} + p", "child", _P),
        _edge(f"{PART_READ} + p", f"{PART_PARAM} + p", "references", _P),
        _edge(f"{ORDER} + o", f"{STMT} + k", "child", _I, "ln"),
        _edge(f"{STMT} + k", f"{CALL} + k", "child", _I),
        _edge(f"{STMT} + k", f"{METHOD_CALL} + k", "child", _I, "1"),
        _edge(f"{CALL} + k", f"{ARG} + k", "child", _I, "1"),
        _edge(f"{CALL} + k", f"{PART} + p", "references", _I),
        _edge(f"{ARG} + k", f"{ORDER_PARAM} + o", "references", _I),
        _edge(f"{METHOD_CALL} + k", f"{METHOD} + s", "references", _I),
        _edge(f"{METHOD} + s_suppkey", "200 + s_nationkey", "semantic_parent", _S),
        _edge("400 + n_nationkey", "200 + n_nationkey", "semantic_parent", _N),
        _edge(f"{METHOD} + m.s", f"{METHOD} + b.s", "overrides", "({peer}) m JOIN ({peer}) b ON b.n = floor(m.n / 2) AND b.k = m.k WHERE m.n > 0"),
        _edge("600 + t", "500 + t", "specializes", _T),
        _edge(f"{TYPE} + 600 + n_nationkey", "800 + n_nationkey", "type_decl", _N),
        _edge(f"{TYPE} + 100 + r_regionkey", f"{TYPE} + r_regionkey", "pointee", _R),
        _edge(f"{TYPE} + 200 + r_regionkey", f"{TYPE} + 100 + r_regionkey", "pointee", _R),
        _edge(f"{TYPE} + 700 + r_regionkey", f"{TYPE} + 400 + r_regionkey", "pointee", _R),
        _edge(f"{TYPE} + 300 + r_regionkey", f"{TYPE} + 100 + r_regionkey", "result_type", _R),
        _edge(f"{TYPE} + 300 + r_regionkey", f"{TYPE} + 700 + r_regionkey", "arg_type", _R),
        _edge("800 + n_nationkey", f"{TYPE} + 100 + n_regionkey", "underlying_type", _N),
        _edge(f"{TYPE} + 500 + t", f"{TYPE} + t % 5", "template_arg", _T),
    ]),
    # declarations that are known across files: their symbols have their own ids
    "tree_symbol": "SELECT symbol AS id, concat('u:', symbol) AS usr, spelling AS name, kind, 1 AS linkage FROM ({tree_node}) x WHERE symbol <> 0",
    "tree_node_kind": "SELECT DISTINCT kind AS id, concat('kind', kind) AS name, CASE WHEN kind >= 1000 THEN 'type' ELSE 'cursor' END AS category FROM ({tree_node}) x",
    "tree_relation_kind": "SELECT DISTINCT rel AS id, concat('relation', rel) AS name FROM ({tree_edge}) x",
}
#: The tables of the trees by the names that programs use.
TABLES = {"node": "tree_node", "edge": "tree_edge", "symbol": "tree_symbol", "file": "tree_file", "node_kind": "tree_node_kind", "relation_kind": "tree_relation_kind"}


def expanded(name: str, sources: dict[str, str] | None = None) -> str:
    return expand(SQL, SOURCES, name, sources)


#: What the tables of the trees rest on more than once.
BASES = ("order", "func", "stmt")


def entry(spark: SparkSession, sf_dir: str, name: str, once: bool = False) -> DataFrame:
    """A table of the trees; once: what its parts have in common is written once, where adapter.shared() is open."""
    return filled(spark, sf_dir, SQL, SOURCES, name, BASES if once else ())


def unit(node: Column) -> Column:
    """The order or part that a node belongs to; no child lies in another one's. Line numbers from 8 on would
    break that; closure.reach() looks."""
    return F.when(node >= STMT, ((node % STMT) - (node % STMT) % 80_000_000) / 80_000_000).when(node >= ORDER, node % ORDER).otherwise(F.lit(-1)).cast("long")
