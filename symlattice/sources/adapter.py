"""The driver's star schema read as a code graph, by SQL that Spark and other engines both run.

Every row of every table is a fact. Regions are namespaces, nations classes (a binary hierarchy whose
two topmost are interfaces), suppliers their methods and customers their data members; parts and orders
are functions. An order calls its line items' parts and, by dispatch, their suppliers, and the
customer's next order; the last order of a customer in debt calls the first again. Suppliers use the
next line's supplier, construct or destroy the class of the order's customer. Kinds of parts are
class templates, brands of a kind their instances. Ids of the kinds do not overlap.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession

from symlattice.sources.facts import Catalog
from symlattice.staging import cut

SOURCES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")

#: {name} is a table of the star schema or an earlier entry.
SQL = {
    "component": "SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) % 5 AS id, concat('lib', CAST(substr(p_brand, 7) AS BIGINT) % 5) AS name, concat('/src/lib', CAST(substr(p_brand, 7) AS BIGINT) % 5) AS path, 'repo' AS kind FROM {part}",
    "file": "SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS id, CAST(substr(p_brand, 7) AS BIGINT) AS directory_id, concat(lower(p_brand), '.cpp') AS name FROM {part}",
    "directory": "SELECT CAST(substr(p_brand, 7) AS BIGINT) AS id, CAST(substr(p_brand, 7) AS BIGINT) % 5 AS component_id, lower(p_brand) AS path FROM {part} GROUP BY p_brand",
    # the kinds of parts, numbered, and the brands that make each
    "template": "SELECT p_type AS name, dense_rank() OVER (ORDER BY p_type) AS t FROM (SELECT DISTINCT p_type FROM {part}) x",
    "instance": """
        SELECT x.name, x.t, x.brand, CAST(1000 + 100 * x.t + x.brand AS BIGINT) AS id, CAST(100 + n_nationkey AS BIGINT) AS bound, concat(r_name, '::', n_name) AS arg
        FROM (SELECT DISTINCT t.name, t.t, CAST(substr(p_brand, 7) AS BIGINT) AS brand FROM {part} JOIN ({template}) t ON t.name = p_type) x
        JOIN {nation} ON n_nationkey = x.brand - 1 JOIN {region} ON n_regionkey = r_regionkey""",
    "symbol": """
        SELECT CAST(1 + r_regionkey AS BIGINT) AS id, concat('r:', r_regionkey) AS usr, r_name AS spelling, r_name AS qual_name, r_name AS display_name, 22 AS kind,
               CAST(NULL AS STRING) AS type_info, CAST(NULL AS BIGINT) AS file_id, CAST(r_regionkey AS INT) AS line, 1 AS is_definition, 0 AS is_pure, 'public' AS access,
               CAST(NULL AS STRING) AS parent_usr, 1 AS resolved, 0 AS is_named_instance
        FROM {region}
        UNION ALL
        SELECT CAST(100 + n_nationkey AS BIGINT), concat('n:', n_nationkey), n_name, concat(r_name, '::', n_name), n_name, 4, CAST(NULL AS STRING),
               CAST(1 + n_nationkey AS BIGINT), CAST(n_nationkey AS INT), 1, 0, 'public', concat('r:', r_regionkey), 1, 0
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT CAST(300 + t AS BIGINT), concat('t:', name), name, name, concat(name, '<T>'), 31, CAST(NULL AS STRING), CAST(t AS BIGINT), CAST(t AS INT), 1, 0, 'public', CAST(NULL AS STRING), 1, 0 FROM ({template}) x
        UNION ALL
        SELECT CAST(350 + t AS BIGINT), concat('t:', name, '#held'), 'held', concat(name, '::held'), 'held', 6, 'T', CAST(t AS BIGINT), CAST(t AS INT), 1, 0, 'private', concat('t:', name), 1, 0 FROM ({template}) x
        UNION ALL
        SELECT CAST(370 + t AS BIGINT), concat('t:', name, '<int>'), name, name, concat(name, '<int>'), 4, CAST(NULL AS STRING), CAST(t AS BIGINT), CAST(t AS INT), 1, 0, 'public', CAST(NULL AS STRING), 1, 0 FROM ({template}) x
        UNION ALL
        SELECT id, concat('t:', name, '<', arg, '>'), name, name, concat(name, '<', arg, '>'), 4, CAST(NULL AS STRING), brand, CAST(t AS INT), 1, 0, 'public', CAST(NULL AS STRING), 1, 1 FROM ({instance}) x
        UNION ALL
        SELECT CAST(500000000 + s_suppkey AS BIGINT), concat('s:', s_suppkey), concat('m', s_suppkey % 7), concat(r_name, '::', n_name, '::m', s_suppkey % 7),
               concat('m', s_suppkey % 7, '()'), 21, 'void ()', CAST(1 + n_nationkey AS BIGINT), CAST(s_suppkey AS INT), 1,
               CASE WHEN s_acctbal < 0 OR n_nationkey < 2 THEN 1 ELSE 0 END, CASE WHEN s_suppkey % 3 = 0 THEN 'public' WHEN s_suppkey % 3 = 1 THEN 'protected' ELSE 'private' END, concat('n:', n_nationkey), 1, 0
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT CAST(600000000 + c_custkey AS BIGINT), concat('c:', c_custkey), concat('f', c_custkey), concat('f', c_custkey), concat('f', c_custkey), 6,
               CASE c_mktsegment WHEN 'BUILDING' THEN concat(r_name, '::', n_name) WHEN 'AUTOMOBILE' THEN concat(r_name, '::', n_name, ' *') WHEN 'MACHINERY' THEN concat('std::shared_ptr<', r_name, '::', n_name, '>')
                    WHEN 'HOUSEHOLD' THEN concat('std::vector<', r_name, '::', n_name, '>') ELSE concat('std::unique_ptr<', r_name, '::', n_name, '>') END,
               CAST(1 + c_nationkey AS BIGINT), CAST(c_custkey AS INT), 1, 0, CASE WHEN c_acctbal < 0 THEN 'private' ELSE 'public' END, CAST(NULL AS STRING), 1, 0
        FROM {customer} JOIN {nation} ON n_nationkey = floor(c_nationkey / 2) JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT CAST(1000000 + p_partkey AS BIGINT), concat('p:', p_partkey), replace(p_name, ' ', '_'), replace(p_name, ' ', '_'), concat(replace(p_name, ' ', '_'), '(', p_type, ')'), 8,
               concat('int (', p_type, ')'), CAST(substr(p_brand, 7) AS BIGINT), CAST(p_size AS INT), CASE WHEN p_size > 2 THEN 1 ELSE 0 END, 0, 'public', CAST(NULL AS STRING), CASE WHEN p_size > 2 THEN 1 ELSE 0 END, 0
        FROM {part}
        UNION ALL
        SELECT CAST(2000000000 + o_orderkey AS BIGINT), concat('o:', o_orderkey), concat('order', o_orderkey), concat('order', o_orderkey), concat('order', o_orderkey, '(int)'), 8,
               'void (int)', CAST(1 + c_nationkey AS BIGINT), CAST(o_orderkey AS INT), 1, 0, 'public', CAST(NULL AS STRING), 1, 0
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "chain": """
        SELECT a, CASE WHEN b IS NULL AND debt THEN head ELSE b END AS b FROM (
            SELECT CAST(2000000000 + o_orderkey AS BIGINT) AS a, c_acctbal < 0 AS debt,
                   CAST(2000000000 + lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS b,
                   CAST(2000000000 + first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS head
            FROM {orders} JOIN {customer} ON o_custkey = c_custkey) x
        WHERE b IS NOT NULL OR (debt AND a <> head)""",
    "item": """
        SELECT CAST(2000000000 + l_orderkey AS BIGINT) AS a, CAST(1000000 + l_partkey AS BIGINT) AS p, CAST(500000000 + l_suppkey AS BIGINT) AS s, CAST(l_linenumber AS INT) AS line,
               CAST(l_partkey AS INT) AS pk, CAST(l_suppkey AS INT) AS sk, l_returnflag AS flag, CAST(100 + c_nationkey AS BIGINT) AS cls, CAST(1 + c_nationkey AS BIGINT) AS file_id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey""",
    "site": """
        SELECT a, p AS b, line, sk AS col, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS conditional, file_id FROM ({item}) i
        UNION ALL
        SELECT a, s, line, -1 - pk, CASE WHEN flag = 'R' THEN 1 ELSE 0 END, file_id FROM ({item}) i
        UNION ALL
        SELECT a, b, 0, 0, 0, CAST(1 + c_nationkey AS BIGINT) FROM ({chain}) c JOIN {orders} ON a = 2000000000 + o_orderkey JOIN {customer} ON o_custkey = c_custkey""",
    "calls": "SELECT a, b, count(*) AS n FROM ({site}) s GROUP BY a, b",
    "ranked": "SELECT CAST(500000000 + s_suppkey AS BIGINT) AS id, s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM {supplier}",
    "edge": """
        SELECT a AS src_id, b AS dst_id, 1 AS kind, n AS count, CAST(NULL AS INT) AS base_access FROM ({calls}) c
        UNION ALL
        SELECT CAST(100 + n_nationkey AS BIGINT), CAST(100 + floor(n_nationkey / 2) AS BIGINT), 2, CAST(1 AS BIGINT), CAST(n_nationkey % 3 AS INT) FROM {nation} WHERE n_nationkey > 0
        UNION ALL
        SELECT CAST(1 + n_regionkey AS BIGINT), CAST(100 + n_nationkey AS BIGINT), 3, CAST(1 AS BIGINT), CAST(NULL AS INT) FROM {nation}
        UNION ALL
        SELECT CAST(370 + t AS BIGINT), CAST(300 + t AS BIGINT), 4, CAST(1 AS BIGINT), CAST(NULL AS INT) FROM ({template}) t
        UNION ALL
        SELECT id, CAST(300 + t AS BIGINT), 5, CAST(1 AS BIGINT), CAST(NULL AS INT) FROM ({instance}) i
        UNION ALL
        SELECT m.id, o.id, 6, CAST(1 AS BIGINT), CAST(NULL AS INT) FROM ({ranked}) m JOIN ({ranked}) o ON o.nation = floor(m.nation / 2) AND o.r = m.r WHERE m.nation > 0
        UNION ALL
        SELECT DISTINCT p, s, 7, CAST(1 AS BIGINT), CAST(NULL AS INT) FROM ({item}) i
        UNION ALL
        SELECT DISTINCT s, t, 7, CAST(1 AS BIGINT), CAST(NULL AS INT) FROM (SELECT s, lead(s) OVER (PARTITION BY a ORDER BY line, p, s) AS t FROM ({item}) i) x WHERE t IS NOT NULL AND s <> t
        UNION ALL
        SELECT CAST(600000000 + c_custkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), 8, CAST(1 AS BIGINT), CAST(NULL AS INT) FROM {customer}
        UNION ALL
        SELECT CAST(350 + t AS BIGINT), CAST(300 + t AS BIGINT), 8, CAST(1 AS BIGINT), CAST(NULL AS INT) FROM ({template}) t
        UNION ALL
        SELECT CAST(500000000 + s_suppkey AS BIGINT), CAST(100 + s_nationkey AS BIGINT), 9, CAST(1 AS BIGINT), CAST(NULL AS INT) FROM {supplier}
        UNION ALL
        SELECT DISTINCT s, cls, CASE flag WHEN 'A' THEN 10 WHEN 'N' THEN 12 ELSE 16 END, CAST(1 AS BIGINT), CAST(NULL AS INT) FROM ({item}) i
        UNION ALL
        SELECT CAST(100 + x.n_nationkey AS BIGINT), CAST(100 + y.n_nationkey AS BIGINT), 17, CAST(1 AS BIGINT), CAST(NULL AS INT) FROM {nation} x JOIN {nation} y ON y.n_regionkey = x.n_regionkey AND y.n_nationkey > x.n_nationkey""",
    # a part that is a prototype here is defined in the next file as well; orders have one body
    "definition": """
        SELECT CAST(2000000000 + o_orderkey AS BIGINT) AS id, CAST(2000000000 + o_orderkey AS BIGINT) AS symbol_id, CAST((1 + c_nationkey) % 5 AS BIGINT) AS component_id, CAST(1 + c_nationkey AS BIGINT) AS file_id, CAST(o_orderkey AS INT) AS line
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
        UNION ALL SELECT CAST(1000000 + p_partkey AS BIGINT), CAST(1000000 + p_partkey AS BIGINT), CAST(substr(p_brand, 7) AS BIGINT) % 5, CAST(substr(p_brand, 7) AS BIGINT), CAST(p_size AS INT) FROM {part}
        UNION ALL SELECT CAST(3000000000 + p_partkey AS BIGINT), CAST(1000000 + p_partkey AS BIGINT), (CAST(substr(p_brand, 7) AS BIGINT) + 1) % 5, CAST(substr(p_brand, 7) AS BIGINT) % 25 + 1, CAST(p_size AS INT) FROM {part} WHERE p_size <= 2""",
    "def_edge": "SELECT a AS src_def_id, b AS dst_id, 1 AS kind, n AS count FROM ({calls}) c",
    "template_param": "SELECT CAST(300 + t AS BIGINT) AS owner_id, 0 AS position, 1 AS param_kind, 'T' AS name FROM ({template}) t",
    "template_arg": """
        SELECT id AS owner_id, 0 AS position, 1 AS arg_kind, bound AS ref_id, CAST(NULL AS STRING) AS literal FROM ({instance}) i
        UNION ALL SELECT id, 1, 2, CAST(NULL AS BIGINT), CAST(brand AS STRING) FROM ({instance}) i
        UNION ALL SELECT CAST(370 + t AS BIGINT), 0, 2, CAST(NULL AS BIGINT), 'int' FROM ({template}) t""",
    # the receivers of dispatched calls: constructed on the spot, a variable, or not known
    "receiver": """
        SELECT i.a, i.s AS b, i.file_id, i.line, -1 - i.pk AS col, CASE i.flag WHEN 'A' THEN 'construct' WHEN 'N' THEN 'var' ELSE 'unknown' END AS src_kind,
               CASE WHEN i.flag = 'A' THEN concat('n:', s_nationkey) END AS type_usr, CASE WHEN i.flag = 'N' THEN concat('v:', i.a) END AS decl_usr
        FROM ({item}) i JOIN {supplier} ON i.s = 500000000 + s_suppkey""",
}


def expand(entries: dict[str, str], tables: tuple[str, ...], name: str, sources: dict[str, str] | None = None, stop: tuple[str, ...] = ()) -> str:
    """SQL of an entry over the star schema alone; sources: what stands for each of its tables. Entries in `stop` stay names."""
    text = entries[name]
    for other in entries:
        if "{" + other + "}" in text and other not in stop:
            text = text.replace("{" + other + "}", expand(entries, tables, other, sources, stop))
    for t in tables:
        text = text.replace("{" + t + "}", (sources or {}).get(t, t))
    return text


def expanded(name: str, sources: dict[str, str] | None = None) -> str:
    return expand(SQL, SOURCES, name, sources)


_shared: ContextVar[dict | None] = ContextVar("shared", default=None)


@contextmanager
def shared():
    """Within, what several entries or several reads of an entry rest on is written once and read again."""
    token = _shared.set({})
    try:
        yield
    finally:
        _shared.reset(token)


def sharing() -> bool:
    return _shared.get() is not None


def filled(spark: SparkSession, sf_dir: str, entries: dict[str, str], tables: tuple[str, ...], name: str, bases: tuple[str, ...]) -> DataFrame:
    """An entry as a DataFrame; within shared(), the entries `bases` are tables that were written once."""
    held = _shared.get()
    stop = tuple(b for b in bases if b != name) if held is not None else ()
    text = expand(entries, tables, name, {t: "{" + t + "}" for t in tables}, stop)
    given = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in tables if "{" + t + "}" in text}
    for b in stop:
        if "({" + b + "})" in text:
            text = text.replace("({" + b + "})", "{" + b + "}")
            given[b] = base(spark, sf_dir, entries, tables, b, bases)
    return spark.sql(text, **given)


def base(spark: SparkSession, sf_dir: str, entries: dict[str, str], tables: tuple[str, ...], name: str, bases: tuple[str, ...]) -> DataFrame:
    held, key = _shared.get(), (spark.sparkContext.applicationId, sf_dir, id(entries), name)
    if key not in held:
        held[key] = cut(filled(spark, sf_dir, entries, tables, name, bases), name)
    return held[key]


#: Entries that others rest on more than once.
BASES = ("item", "calls")


def entry(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if _shared.get() is not None and name in BASES:
        return base(spark, sf_dir, SQL, SOURCES, name, BASES)
    return filled(spark, sf_dir, SQL, SOURCES, name, BASES)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The whole graph; edge ids are hashes of their ends and kind, and the sites' edge ids are the same.
    The edges' counts are those of their sites, so the graph counts as resolved."""
    from pyspark.sql import functions as F

    def of(a: str, b: str) -> Column:
        return F.xxhash64(a, b, F.lit(1)).alias("edge_id")

    def read(name: str, *more: Column, drop: tuple[str, ...] = ()) -> DataFrame:
        return entry(spark, sf_dir, name).select("*", *more).drop(*drop)

    plain = ("component", "directory", "file", "symbol", "definition", "template_param", "template_arg")
    tables = {k: lambda k=k: read(k) for k in plain}
    tables["edge"] = lambda: read("edge", F.xxhash64("src_id", "dst_id", "kind").alias("id"))
    tables["edge_site"] = lambda: read("site", of("a", "b"), drop=("a", "b"))
    tables["call_arg"] = lambda: read("receiver", of("a", "b"), F.lit(-1).alias("position"), drop=("a", "b"))
    tables["def_edge"] = lambda: read("def_edge", F.xxhash64("src_def_id", "dst_id").alias("id"))
    tables["meta"] = lambda: spark.createDataFrame([("graph_resolved_at", "")], "key string, value string")
    return Catalog(spark, tables)
