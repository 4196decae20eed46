"""Rule programs over the code graph by names, and the relations they read.

A program is a text in the rule language of plans/rules.py. Its inputs are relations(): the facts keyed
by the unique names of functions/names.py, and query_seed and query_target, the names asked about.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlattice.functions import names as N
from symlattice.operators.closure import ready
from symlattice.plans.rules import Program
from symlattice.schemas import EDGE_KIND, ENTITY_EDGE_KIND
from symlattice.sources.facts import Catalog
from symlattice.staging import cut, sent

#: Relations of one kind of edge each, between names.
PLAIN = ("calls", "inherits", "overrides", "instantiates", "uses", "field_of", "method_of", "contains", "specializes", "friend")
DESIGN = ("generalizes", "implements", "specializes", "composes", "aggregates", "associates", "creates", "uses", "destroys", "befriends", "instantiates")
SYMBOL_COLUMNS = ("id", "name", "kind", "type_info", "file", "line", "is_definition", "is_pure", "is_static", "is_instantiation", "is_named_instance", "linkage", "access")


#: Which columns of the relations are names of symbols.
NAMES = {k: (0, 1) for k in (*PLAIN, *[f"e_{k}" for k in DESIGN], "call_site_fact")} | {"symbol_fact": (1,), "callable_fact": (0,), "template_arg_fact": (0,), "seed": (0,), "query_seed": (0,), "query_target": (0,)}
#: Relations that are as a rule few rows, and those that a program's calls with places are of.
HELD, CALLERS = {"downward", "upward", "cone", "from_source", "to_target", "on_path", "route_edge"}, {"callgraph": "cone", "all_paths": "on_path"}


def coded(names: DataFrame) -> DataFrame:
    """(id, name, code), written once: a number for each name, the id of the symbol that has it. Were a name
    that of several symbols, it would be the least of their ids."""
    names = cut(names, "names")
    if names.groupBy("name").count().where("count > 1").isEmpty():
        return names.withColumn("code", F.col("id"))
    return cut(names.withColumn("code", F.min("id").over(Window.partitionBy("name"))), "names")


def relations(c: Catalog, names: DataFrame, seeds: DataFrame | None = None, targets: DataFrame | None = None) -> dict[str, Callable[[], DataFrame]]:
    """What programs can read, each made when it is asked for, with codes in place of names, see coded().
    seeds and targets: a column of codes, none by default."""
    code = names.select("id", F.col("code").alias("name"))
    nobody = c.spark.createDataFrame([], "name long")
    edges = lambda kind, table="edge": N.named_edges(c, kind, code, table)
    out: dict[str, Callable[[], DataFrame]] = {
        "symbol_fact": lambda: N.symbol_facts(c, code).select(*SYMBOL_COLUMNS),
        "callable_fact": lambda: N.callable_facts(c, names, "code"),
        "template_arg_fact": lambda: N.template_arg_facts(c, names, "code"),
        "call_site_fact": lambda: N.call_site_facts(c, code),
        "query_seed": lambda: nobody if seeds is None else seeds,
        "seed": lambda: nobody if seeds is None else seeds,
        "query_target": lambda: nobody if targets is None else targets,
    }
    out |= {k: (lambda k=k: edges(EDGE_KIND[k])) for k in PLAIN}
    # calls are many and read again and again
    out["calls"] = lambda: ready(cut(edges(EDGE_KIND["calls"]).distinct(), "calls"))
    out |= {f"e_{k}": (lambda k=k: edges(ENTITY_EDGE_KIND[k], "entity_edge")) for k in DESIGN}
    return out


def _any(head: str, args: str, bodies: Iterable[str]) -> str:
    """One relation that is the union of others with the same attributes."""
    return f".decl {head}({args})\n" + "".join(f"{head}({args}) :- {b}({args}).\n" for b in bodies)


def _steps(head: str, args: tuple[str, str], step: str) -> str:
    """The closure of a relation of pairs."""
    a, b = args
    return f".decl {head}({a}, {b})\n{head}({a}, {b}) :- {step}({a}, {b}).\n{head}({a}, {b}) :- {head}({a}, mid), {step}(mid, {b}).\n"


def _from_seed(head: str, args: tuple[str, str], step: str, seed: str = "query_seed") -> str:
    """What the seeds lead to over one step or more of a relation."""
    a, b = args
    return f".decl {head}({a}, {b})\n{head}({a}, {b}) :- {seed}({a}), {step}({a}, {b}).\n{head}({a}, {b}) :- {head}({a}, mid), {step}(mid, {b}).\n"


_ANY_SYMBOL = "symbol_fact(_, {name}, {kind}, _, {file}, _, {defined}, _, _, _, _, _, _)"


def _symbol(name: str = "_", kind: str = "_", file: str = "_", defined: str = "_") -> str:
    return _ANY_SYMBOL.format(name=name, kind=kind, file=file, defined=defined)


_DEPENDENCIES = ("composes", "aggregates", "associates", "creates", "uses")
#: The records above a record, the entities that one depends on, and the cones of calls around seeds.
BASE = (
    _any("parent", "sub, super", ("inherits", "e_generalizes", "e_implements"))
    + _steps("subtype", ("sub", "super"), "parent")
    + _any("needs", "a, b", [f"e_{k}" for k in _DEPENDENCIES])
    + _steps("edep", ("a", "b"), "needs")
    + _from_seed("reach", ("a", "b"), "calls", "seed")
    + """
.decl downward(name)
downward(x) :- seed(x).
downward(y) :- downward(x), calls(x, y).
.decl cg_out(caller, callee)
cg_out(x, y) :- downward(x), calls(x, y).
.decl upward(name)
upward(y) :- seed(y).
upward(x) :- upward(y), calls(x, y).
.decl cg_in(caller, callee)
cg_in(x, y) :- upward(y), calls(x, y).
.output subtype
.output edep
.output reach
.output cg_out
.output cg_in
"""
)

_CONE = """
.decl cone(name)
cone(f) :- query_seed(f).
cone(g) :- cone(f), calls(f, g).
"""

PROGRAMS: dict[str, str] = {
    "base": BASE,
    "inventory": f"""
.decl known_kind(kind)
known_kind(kind) :- {_symbol(kind="kind")}.
.decl symbols_by_kind(kind, total)
symbols_by_kind(kind, total) :- known_kind(kind), total = count : {{ {_symbol(kind="kind")} }}.
.output symbols_by_kind
""",
    "callgraph": f"""{_CONE}
.decl call_edge(caller, callee)
call_edge(f, g) :- cone(f), calls(f, g).
{_from_seed("reachable", ("caller", "callee"), "calls")}
.decl recursive(symbol)
recursive(f) :- reachable(f, f).
.decl call_location(caller, callee, file, line, conditional)
call_location(f, g, file, line, cond) :- cone(f), call_site_fact(f, g, file, line, _, cond, _).
.output call_edge
.output reachable
.output recursive
.output call_location
""",
    "references": f"""
.decl incoming_reference(kind, source, target)
incoming_reference("calls", s, t) :- calls(s, t), query_seed(t).
incoming_reference("uses", s, t) :- uses(s, t), query_seed(t).
.decl unreferenced_definition(name)
unreferenced_definition(t) :- query_seed(t), {_symbol(name="t", defined="1")}, !incoming_reference(_, _, t).
.output incoming_reference
.output unreferenced_definition
""",
    "hierarchy": _any("parent", "derived, base", ("inherits", "e_generalizes", "e_implements"))
    + _from_seed("ancestor", ("derived", "base"), "parent")
    + _from_seed("override_chain", ("method", "base_method"), "overrides")
    + ".output ancestor\n.output override_chain\n",
    "architecture": ".decl dependency(src, relation, dst)\n"
    + "".join(f'dependency(x, "{k}", y) :- e_{k}(x, y).\n' for k in (*_DEPENDENCIES, "destroys"))
    + """
.decl depends_on(src, dst)
depends_on(x, y) :- dependency(x, _, y).
"""
    + _from_seed("depends_transitively", ("src", "dst"), "depends_on")
    + """
.decl involved(name)
involved(x) :- query_seed(x).
involved(y) :- query_seed(x), depends_transitively(x, y).
.decl dependency_edge(src, relation, dst)
dependency_edge(x, r, y) :- involved(x), dependency(x, r, y).
.output dependency_edge
.output depends_transitively
""",
    "impact": """
.decl called_by(callee, caller)
called_by(g, f) :- calls(f, g).
"""
    + _from_seed("impacts", ("changed", "caller"), "called_by")
    + """
.decl affected(changed)
affected(x) :- impacts(x, _).
.decl blast_radius(changed, callers)
blast_radius(x, n) :- affected(x), n = count : { impacts(x, _) }.
.output impacts
.output blast_radius
""",
    "metrics": _any("direct_entity_dependency", "src, dst", [f"e_{k}" for k in _DEPENDENCIES])
    + """
.decl fan_in(symbol, total)
fan_in(x, n) :- query_seed(x), n = count : { calls(_, x) }.
.decl fan_out(symbol, total)
fan_out(x, n) :- query_seed(x), n = count : { calls(x, _) }.
.decl dependency_count(entity, total)
dependency_count(x, n) :- query_seed(x), n = count : { direct_entity_dependency(x, _) }.
.output fan_in
.output fan_out
.output dependency_count
""",
    "templates": """
.decl selected_instantiation(instance, primary)
selected_instantiation(x, t) :- instantiates(x, t), query_seed(x).
.decl template_argument(owner, position, kind, value)
"""
    + "".join(f'template_argument(x, i, "{kind}", v) :- query_seed(x), template_arg_fact(x, i, {n}, {"v, _" if kind in ("type", "template") else "_, v"}).\n' for n, kind in enumerate(("type", "value", "template", "pack"), 1))
    + ".output selected_instantiation\n.output template_argument\n",
    "cross_file": f"""
.decl symbol_file(symbol, file)
symbol_file(x, file) :- {_symbol(name="x", file="file")}, file != "".
.decl file_call(source, target, caller, callee)
file_call(p, q, f, g) :- symbol_file(f, p), calls(f, g), symbol_file(g, q), p != q.
.decl file_pair(source, target)
file_pair(p, q) :- file_call(p, q, _, _).
.decl file_dependency(source, target, calls)
file_dependency(p, q, n) :- file_pair(p, q), n = count : {{ file_call(p, q, _, _) }}.
.output file_dependency
""",
    "all_paths": """
.decl from_source(node)
from_source(x) :- query_seed(x).
from_source(y) :- from_source(x), calls(x, y).
.decl to_target(node)
to_target(y) :- query_target(y).
to_target(x) :- to_target(y), calls(x, y).
.decl on_path(node)
on_path(x) :- from_source(x), to_target(x).
.decl route_edge(caller, callee)
route_edge(x, y) :- on_path(x), calls(x, y), on_path(y).
.decl path_node(node, full_signature)
path_node(x, s) :- on_path(x), callable_fact(x, s).
.decl path_edge(caller, caller_signature, callee, callee_signature)
path_edge(x, s, y, t) :- route_edge(x, y), callable_fact(x, s), callable_fact(y, t).
.decl path_location(caller, callee, file, line, conditional)
path_location(x, y, file, line, cond) :- route_edge(x, y), call_site_fact(x, y, file, line, _, cond, _).
.decl path_exists(source, source_signature, target, target_signature)
path_exists(x, s, y, t) :- query_seed(x), query_target(y), from_source(y), callable_fact(x, s), callable_fact(y, t).
.output path_exists
.output path_node
.output path_edge
.output path_location
""",
}
#: The cone of impact as a table of the snapshot: write_back() stores it.
PROGRAMS["writeback"] = PROGRAMS["impact"].split(".decl affected")[0].replace("impacts", "impact_of_change") + ".output impact_of_change\n"


def run(name: str, c: Catalog, wanted: list[str] | None = None, seeds: DataFrame | None = None, targets: DataFrame | None = None, names: DataFrame | None = None) -> dict[str, DataFrame]:
    """The outputs of a program (those `wanted`, all by default) over a catalog. Programs run on the symbols'
    numbers; only what comes out gets names. names: coded() ones, if there are any."""
    program = Program(PROGRAMS[name])
    wanted = wanted or program.outputs
    names = coded(N.display_names(c)) if names is None else names
    known = names.select("code", "name").where("id = code")
    asked = [None if x is None else x.toDF("name").join(known, "name", "left").select("name", F.coalesce("code", -1 - F.abs(F.xxhash64("name"))).alias("code")).distinct() for x in (seeds, targets)]
    # names that no symbol has stay what they are
    for x in asked:
        if x is not None:
            known = known.unionByName(x.where("code < 0").select("code", "name"))
    given = relations(c, names, *[None if x is None else cut(x.select("code"), "asked") for x in asked])
    reads = program.reads(wanted)
    made = {k: given[k]() for k in reads if k in given and k != "call_site_fact"}
    of_name = program.typed(NAMES)
    if "call_site_fact" in reads:
        guard = CALLERS[name]
        first = program.run(c.spark, made, [guard], held=HELD)[guard]
        made[guard] = sent(cut(first, "guard"))
        program = program.given({guard})
        made["call_site_fact"] = N.call_site_facts(c, names.select("id", F.col("code").alias("name")), names.join(made[guard].toDF("code"), "code", "left_semi").select("id"))
        missing = [k for k in program.reads(wanted) if k in given and k not in made]
        made |= {k: given[k]() for k in missing}
    out = program.run(c.spark, {k: v for k, v in made.items()}, wanted, held=HELD)
    return {k: _named(df, known, of_name.get(k, ())) for k, df in out.items()}


def _named(df: DataFrame, known: DataFrame, positions: Iterable[int]) -> DataFrame:
    columns = df.columns
    if not positions:
        return df
    df = sent(cut(df, "coded"))
    for i in positions:
        df = df.join(known.select(F.col("code").alias(columns[i]), F.col("name").alias(f"_n{i}")), columns[i])
    return df.select(*[F.col(f"_n{i}" if i in positions else x).alias(x) for i, x in enumerate(columns)])


def write_back(c: Catalog, path: str, seeds: DataFrame) -> DataFrame:
    """Stores the impact of changing the seeds beside a snapshot's tables, and reads it again."""
    run("writeback", c, seeds=seeds)["impact_of_change"].write.mode("overwrite").parquet(f"{path}/impact_of_change")
    return c.spark.read.parquet(f"{path}/impact_of_change")


def name_of(c: Catalog, ids: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(name): the unique names of some symbols (column id)."""
    return (N.display_names(c) if names is None else names).join(ids.select("id"), "id", "left_semi").select(F.col("name"))
