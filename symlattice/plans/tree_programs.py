"""Rule programs over syntax trees: the relations that every program can use, and the programs.

Inputs are the tables of a tree: node (15 columns, see NODE), edge(src, dst, relation, position),
symbol(id, usr, name, kind, linkage), file(id, path, is_main), node_kind(id, name, category) and
relation_kind(id, name). 0 and "" stand for nothing; nodes from kind 1000 on are types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from symlattice.operators.syntax import REL
from symlattice.plans.programs import _any, _steps
from symlattice.plans.rules import Program

#: Columns of node, in order.
NODE = ("id", "kind", "symbol", "type", "spelling", "file", "line", "col", "end_line", "end_col", "definition", "access", "is_const", "is_volatile", "is_restrict")
# Kinds of nodes in the trees.
KIND = {
    "struct": 2, "union": 3, "class": 4, "enum": 5, "field": 6, "enum_constant": 7, "function": 8, "variable": 9, "parameter": 10, "typedef": 20, "method": 21, "namespace": 22, "constructor": 24, "destructor": 25,
    "function_template": 30, "class_template": 31, "partial_specialization": 32, "base": 44, "name_use": 101, "member_use": 102, "call": 103, "if": 205, "switch": 206, "while": 207, "do": 208, "for": 209, "return": 214,
    "alias": 600, "alias_template": 601, "pointer": 1101, "reference": 1103, "record_type": 1105, "enum_type": 1106, "typedef_type": 1107, "function_type": 1111, "elaborated": 1119,
}
FUNCTIONS, RECORDS = ("function", "method", "constructor", "destructor"), ("class", "struct", "class_template", "partial_specialization")
TYPE_STEPS = ("canonical_type", "pointee", "element_type", "result_type", "arg_type", "named_type", "template_arg")


def node(ident: str = "_", **of) -> str:
    """An atom of node with some columns named; a kind may be given by its word."""
    of = {"id": ident} | {k: str(KIND.get(v, v)) if k == "kind" else str(v) for k, v in of.items()}
    return f"node({', '.join(of.get(c, '_') for c in NODE)})"


def link(a: str, b: str, relation: str, position: str = "_") -> str:
    return f"edge({a}, {b}, {REL[relation]}, {position})"


def _one_of(head: str, words: tuple[str, ...], numbers: dict[str, int]) -> str:
    return f".decl {head}(k)\n" + "".join(f"{head}({numbers[w]}).\n" for w in words)


PRELUDE = (
    _one_of("function_kind", FUNCTIONS, KIND)
    + _one_of("type_relation", TYPE_STEPS, REL)
    + f"""
.decl child(parent, node)
child(p, c) :- {link("p", "c", "child")}.
.decl refers(site, target)
refers(s, t) :- {link("s", "t", "references")}.
.decl node_core(id, kind, symbol, type, spelling, definition)
node_core(x, k, s, t, w, d) :- {node("x", kind="k", symbol="s", type="t", spelling="w", definition="d")}.
.decl node_location(id, file, line, col, end_line, end_col)
node_location(x, f, l, c, m, d) :- {node("x", file="f", line="l", col="c", end_line="m", end_col="d")}.
.decl node_access(id, access)
node_access(x, a) :- {node("x", access="a")}.
.decl type_qualifiers(id, is_const, is_volatile, is_restrict)
type_qualifiers(x, c, v, r) :- {node("x", kind="k", is_const="c", is_volatile="v", is_restrict="r")}, k >= 1000.
.decl node_symbol(id, usr, name, linkage)
node_symbol(x, u, w, l) :- {node("x", symbol="s")}, s != 0, symbol(s, u, w, _, l).
.decl main_file(id)
main_file(f) :- file(f, _, 1).
.decl node_in_main_file(id)
node_in_main_file(x) :- main_file(f), {node("x", file="f")}.
.decl function_definition(id, name)
function_definition(x, w) :- function_kind(k), {node("x", kind="k", spelling="w", definition=1)}.
.decl main_function(id, name)
main_function(x, w) :- function_definition(x, w), {node("x", file="f")}, main_file(f).
{_steps("descendant", ("anc", "n"), "child")}
.decl main_scope(id)
main_scope(x) :- main_function(x, _).
main_scope(y) :- main_function(x, _), descendant(x, y).
.decl typenode(t)
typenode(t) :- {node("t", kind="k")}, k >= 1000.
.decl type_step(a, b)
type_step(a, b) :- type_relation(r), edge(a, b, r, _).
.decl type_reach(a, b)
type_reach(t, t) :- typenode(t).
type_reach(a, b) :- type_reach(a, t), type_step(t, b).
.decl stands_for(named, meant)
stands_for(p, d) :- {link("p", "d", "definition")}.
stands_for(p, d) :- {link("p", "d", "canonical")}.
.decl referenced(d)
referenced(d) :- refers(_, d).
referenced(d) :- refers(_, p), stands_for(p, d).
.decl direct_call_site(function, site, callee, line)
direct_call_site(f, s, g, l) :- {node("s", kind="call", line="l")}, refers(s, g), descendant(f, s), function_definition(f, _).
.decl direct_call(function, callee, line)
direct_call(f, g, l) :- direct_call_site(f, _, g, l).
.decl called_function(id)
called_function(g) :- direct_call(_, g, _), function_definition(g, _).
called_function(g) :- direct_call(_, p, _), {link("p", "g", "definition")}, function_definition(g, _).
.decl file_reference(source, target, source_node, target_node)
file_reference(p, q, s, t) :- refers(s, t), {node("s", file="p")}, {node("t", file="q")}, p != 0, q != 0, p != q.
"""
)

_CALLS = """
.decl calls(caller, callee, line)
calls(f, g, l) :- direct_call(f, g, l).
.decl called(a, b)
called(f, g) :- calls(f, g, _).
""" + _steps("reach", ("a", "b"), "called")


def _site(words: tuple[str, ...]) -> str:
    return "".join(f'control_site(f, "{w}", l) :- main_function(f, _), descendant(f, s), {node("s", kind=w, line="l")}.\n' for w in words)


PROGRAMS: dict[str, str] = {
    "basics": f"""
.decl main_functions(name, line)
main_functions(w, l) :- main_function(x, w), {node("x", line="l")}.
.decl main_records(kind, name, line)
"""
    + "".join(f'main_records("{k}", w, l) :- node_in_main_file(x), {node("x", kind=k, spelling="w", line="l", definition=1)}.\n' for k in ("struct", "class", "union"))
    + f"""
.decl globals(name, type)
globals(w, t) :- child(1, v), {node("v", kind="variable", spelling="w", type="ty")}, {node("ty", spelling="t")}.
.decl contributing_files(path)
contributing_files(p) :- file(_, p, 0).
.output main_functions
.output main_records
.output globals
.output contributing_files
""",
    "callgraph": _CALLS
    + """
.decl call_display(caller_usr, caller, callee_usr, callee, line)
call_display(u, f, v, g, l) :- calls(x, y, l), node_symbol(x, u, f, _), node_symbol(y, v, g, _).
.decl reach_display(caller_usr, caller, callee_usr, callee)
reach_display(u, f, v, g) :- reach(x, y), node_symbol(x, u, f, _), node_symbol(y, v, g, _).
.decl impacted(caller_usr, caller)
impacted(u, f) :- query_target(w), node_symbol(y, _, w, _), reach(x, y), node_symbol(x, u, f, _).
.decl main_cone(callee_usr, callee)
main_cone(v, g) :- query_seed(w), function_definition(x, w), reach(x, y), node_symbol(y, v, g, _).
.decl recursive(function_usr, function)
recursive(u, f) :- reach(x, x), node_symbol(x, u, f, _).
.decl entry_point(id)
entry_point(x) :- function_definition(x, _), calls(x, _, _), !referenced(x).
.decl entry_point_display(function_usr, function)
entry_point_display(u, f) :- entry_point(x), node_symbol(x, u, f, _).
.decl fan_out(function_usr, function, calls)
fan_out(u, f, n) :- function_definition(x, _), node_symbol(x, u, f, _), n = count : { calls(x, _, _) }, n > 0.
.output call_display
.output reach_display
.output impacted
.output main_cone
.output recursive
.output entry_point_display
.output fan_out
""",
    "types": _one_of("holder", ("variable", "parameter", "field"), KIND)
    + f"""
.decl decl_type(name, type)
decl_type(w, t) :- holder(k), {node(kind="k", type="ty", spelling="w")}, w != "", ty != 0, {node("ty", spelling="t")}.
.decl asked_type(type, name)
asked_type(ty, t) :- query_target(t), {node("r", kind="record_type", spelling="t")}, type_reach(ty, r).
.decl touches(f, type)
touches(w, t) :- asked_type(ty, t), {node("x", type="ty")}, descendant(f, x), function_definition(f, w).
.decl returns_pointer(f, ret)
returns_pointer(w, t) :- function_definition(f, w), {node("f", type="ty")}, {link("ty", "r", "result_type")}, {node("r", kind="pointer", spelling="t")}.
.decl has_pointee(t)
has_pointee(t) :- {link("t", "_", "pointee")}.
.decl pointer_depth(t, d)
pointer_depth(t, 0) :- typenode(t), !has_pointee(t).
pointer_depth(t, d + 1) :- pointer_depth(p, d), {link("t", "p", "pointee")}.
.decl deep_pointers(type, depth)
deep_pointers(w, d) :- pointer_depth(t, d), d >= 2, {node("t", kind="pointer", spelling="w")}.
.decl typedef_resolves(alias, canonical)
typedef_resolves(a, c) :- node_in_main_file(x), {node("x", kind="typedef", spelling="a")}, {link("x", "u", "underlying_type")}, type_reach(u, t), {node("t", kind="k", spelling="c")}, k >= 1000, k != {KIND["typedef_type"]}, k != {KIND["elaborated"]}.
.decl readonly_pointer(type)
readonly_pointer(ty) :- {link("ty", "to", "pointee")}, type_reach(to, q), type_qualifiers(q, 1, _, _).
.decl readonly_pointer_param(f, param)
readonly_pointer_param(w, p) :- readonly_pointer(ty), {node("x", kind="parameter", type="ty", spelling="p")}, descendant(f, x), function_definition(f, w).
.output decl_type
.output touches
.output returns_pointer
.output deep_pointers
.output typedef_resolves
.output readonly_pointer_param
""",
    "deadcode": f"""
.decl dead_function(f, line)
dead_function(w, l) :- main_function(x, w), {node("x", line="l")}, !called_function(x), w != "main".
.decl unused_parameter(f, param)
unused_parameter(w, p) :- function_definition(f, w), descendant(f, x), {node("x", kind="parameter", spelling="p")}, p != "", !referenced(x).
.decl unused_var(f, var, line)
unused_var(w, v, l) :- function_definition(f, w), descendant(f, x), {node("x", kind="variable", spelling="v", line="l")}, v != "", !referenced(x).
.decl typedef_used(td)
typedef_used(x) :- referenced(x).
typedef_used(x) :- {link("u", "x", "type_decl")}, type_reach(t, u), {node("c", kind="k", type="t")}, k < 1000, c != x.
.decl unused_typedef(name, line)
unused_typedef(w, l) :- node_in_main_file(x), {node("x", kind="typedef", spelling="w", line="l")}, !typedef_used(x).
.decl has_definition(p)
has_definition(p) :- {link("p", "_", "definition")}.
.decl undefined_prototype(f, line)
undefined_prototype(w, l) :- node_in_main_file(x), {node("x", kind="function", spelling="w", line="l", definition=0)}, !has_definition(x).
.output dead_function
.output unused_parameter
.output unused_var
.output unused_typedef
.output undefined_prototype
""",
    "oop": _one_of("record_kind", RECORDS, KIND)
    + f"""
.decl class_like(id, name)
class_like(x, w) :- record_kind(k), {node("x", kind="k", spelling="w")}.
.decl class_definition(id, name)
class_definition(x, w) :- record_kind(k), {node("x", kind="k", spelling="w", definition=1)}.
.decl derives_id(derived, base)
derives_id(d, b) :- {node("s", kind="base")}, child(d, s), refers(s, b), class_like(d, _), class_like(b, _).
{_steps("ancestor_id", ("derived", "base"), "derives_id")}
.decl derives(derived, base)
derives(v, w) :- derives_id(d, b), class_like(d, v), class_like(b, w).
.decl ancestor(derived, base)
ancestor(v, w) :- ancestor_id(d, b), class_like(d, v), class_like(b, w).
.decl owner(method, name, class, class_name)
owner(m, w, c, v) :- {link("m", "c", "semantic_parent")}, {node("m", spelling="w")}, {node("c", spelling="v")}.
.decl method_of(class, method, access)
method_of(v, w, a) :- owner(m, w, c, _), {node("m", kind="method", access="a")}, class_definition(c, v).
.decl overrides(derived_m, in_class, base_m, of_class)
overrides(w, v, x, y) :- {link("m", "b", "overrides")}, owner(m, w, _, v), owner(b, x, _, y).
.decl overridden_by_someone(b)
overridden_by_someone(b) :- {link("_", "b", "overrides")}.
.decl leaf_override(class, method)
leaf_override(v, w) :- {link("m", "_", "overrides")}, !overridden_by_someone(m), owner(m, w, _, v).
.decl constructs(f, class, line)
constructs(w, v, l) :- direct_call(f, c, l), {node("c", kind="constructor", spelling="v")}, function_definition(f, w).
.decl specializes(what, template)
specializes(v, w) :- {link("s", "t", "specializes")}, {node("s", spelling="v")}, v != "", {node("t", spelling="w")}.
.output derives
.output derives_id
.output ancestor
.output ancestor_id
.output method_of
.output overrides
.output leaf_override
.output constructs
.output specializes
""",
    "metrics": _one_of("branch_kind", ("if", "switch", "while", "do", "for"), KIND)
    + f"""
.decl body_size(f, nodes)
body_size(w, n) :- main_function(x, w), n = count : {{ descendant(x, _) }}.
.decl parameter(function, node)
parameter(f, p) :- child(f, p), {node("p", kind="parameter")}.
.decl parameter_count(f, params)
parameter_count(w, n) :- main_function(x, w), n = count : {{ parameter(x, _) }}.
.decl fan_out(f, calls_out)
fan_out(w, n) :- main_function(x, w), n = count : {{ direct_call(x, _, _) }}.
.decl use(target, site, position)
use(t, s, i) :- {link("s", "t", "references", "i")}.
.decl fan_in(f, called)
fan_in(w, n) :- main_function(x, w), n = count : {{ use(x, _, _) }}.
.decl branch(s)
branch(s) :- branch_kind(k), {node("s", kind="k")}.
.decl branching(function, site)
branching(f, s) :- main_function(f, _), branch(s), descendant(f, s).
.decl branchiness(f, branches)
branchiness(w, n) :- main_function(x, w), n = count : {{ branching(x, _) }}.
.decl line_span(f, lines)
line_span(w, m - l + 1) :- main_function(x, w), node_location(x, _, l, _, m, _), m >= l.
.output body_size
.output parameter_count
.output fan_out
.output fan_in
.output branchiness
.output line_span
""",
    "writeback": _CALLS
    + """
.decl call_symbol(caller_usr, callee_usr, line)
call_symbol(u, v, l) :- calls(x, y, l), node_symbol(x, u, _, _), node_symbol(y, v, _, _).
.output calls
.output reach
.output call_symbol
""",
    "dataflow": _one_of("variable_kind", ("variable", "parameter"), KIND)
    + f"""
.decl variable(v, name)
variable(v, w) :- variable_kind(k), {node("v", kind="k", spelling="w", file="f")}, main_file(f).
.decl flow_anchor(id)
flow_anchor(x) :- variable(x, _).
flow_anchor(x) :- main_scope(x), {node("x", kind="call")}.
flow_anchor(x) :- main_scope(x), {node("x", kind="return")}.
.decl argument(call, node, index)
argument(c, a, i - 1) :- main_scope(c), {node("c", kind="call")}, {link("c", "a", "child", "i")}, i >= 1.
.decl within(outer, inner)
within(x, x) :- flow_anchor(x).
within(x, x) :- argument(_, x, _).
within(x, y) :- within(x, m), child(m, y).
.decl flow_read_site(id)
flow_read_site(x) :- main_scope(x).
flow_read_site(x) :- node_in_main_file(x).
.decl reads_variable(site, v)
reads_variable(r, v) :- {node("r", kind="name_use")}, refers(r, v), variable(v, _), flow_read_site(r).
.decl callee_definition(call, f)
callee_definition(c, f) :- main_scope(c), {node("c", kind="call")}, refers(c, f), function_definition(f, _).
callee_definition(c, f) :- main_scope(c), {node("c", kind="call")}, refers(c, p), {link("p", "f", "definition")}.
.decl parameter(function, node, position)
parameter(f, p, i) :- main_function(f, _), {link("f", "p", "child", "i")}, {node("p", kind="parameter")}.
.decl before(function, node, earlier)
before(f, p, q) :- parameter(f, p, i), parameter(f, q, j), j < i.
.decl parameter_index(f, p, index)
parameter_index(f, p, n) :- parameter(f, p, _), n = count : {{ before(f, p, _) }}.
.decl initialised(v)
initialised(v) :- variable(v, _), {node("v", kind="variable")}.
.decl function_returns(f, u)
function_returns(f, u) :- main_function(f, _), descendant(f, x), {node("x", kind="return")}, within(x, r), reads_variable(r, u).
.decl value_flow(from, to)
value_flow(u, v) :- initialised(v), descendant(v, r), reads_variable(r, u).
value_flow(u, p) :- argument(c, a, i), within(a, r), reads_variable(r, u), callee_definition(c, f), parameter_index(f, p, i).
value_flow(u, v) :- initialised(v), descendant(v, c), callee_definition(c, f), function_returns(f, u).
{_steps("influences", ("src", "dst"), "value_flow")}
.decl value_flow_named(from, from_line, to, to_line)
value_flow_named(a, l, b, m) :- value_flow(u, v), variable(u, a), variable(v, b), {node("u", line="l")}, {node("v", line="m")}.
.decl parameter_influence(function, parameter, variable, line)
parameter_influence(w, a, b, l) :- parameter_index(f, p, _), function_definition(f, w), node_in_main_file(f), variable(p, a), influences(p, d), d != p, variable(d, b), {node("d", line="l")}.
.output value_flow_named
.output parameter_influence
""",
    "control_flow": f"""
.decl main_function_info(id, usr, name)
main_function_info(x, u, w) :- main_function(x, _), node_symbol(x, u, w, _).
.decl control_site(function, kind, line)
{_site(("if", "switch", "while", "do", "for", "return"))}
.decl control_site_display(function_usr, function, kind, line)
control_site_display(u, w, k, l) :- main_function_info(f, u, w), control_site(f, k, l).
.decl loop_site(function, line)
"""
    + "".join(f'loop_site(f, l) :- control_site(f, "{w}", l).\n' for w in ("while", "do", "for"))
    + """
.decl control_summary(function_usr, function, ifs, switches, loops, returns)
control_summary(u, w, a, b, c, d) :- main_function_info(f, u, w), a = count : { control_site(f, "if", _) }, b = count : { control_site(f, "switch", _) }, c = count : { loop_site(f, _) }, d = count : { control_site(f, "return", _) }.
.output control_site_display
.output control_summary
""",
    "templates": f"""
.decl template_argument(owner, owner_spelling, position, argument, argument_spelling)
template_argument(o, w, i, a, v) :- {link("o", "a", "template_arg", "i")}, {node("o", kind="k", spelling="w")}, k >= 1000, {node("a", spelling="v")}.
.decl specialization(what, what_usr, what_name, primary, primary_usr, primary_name)
specialization(s, u, w, t, v, x) :- {link("s", "t", "specializes")}, node_symbol(s, u, w, _), node_symbol(t, v, x, _).
.decl main_template_use(declaration, name, type, type_spelling)
main_template_use(d, w, t, v) :- template_argument(t, v, _, _, _), {node("d", type="t", spelling="w")}, node_in_main_file(d).
.output template_argument
.output specialization
.output main_template_use
""",
    "dependencies": f"""
.decl file_pair(source, target)
file_pair(p, q) :- file_reference(p, q, _, _).
.decl file_dependency(source, target, references)
file_dependency(p, q, n) :- file_pair(p, q), n = count : {{ file_reference(p, q, _, _) }}.
.decl file_dependency_display(source, target, references)
file_dependency_display(v, w, n) :- file_dependency(p, q, n), file(p, v, _), file(q, w, _).
.decl anonymous_reference(site, target, spelling)
anonymous_reference(s, t, w) :- refers(s, t), {node("t", symbol=0, spelling="w")}, w != "".
.output file_dependency_display
.output anonymous_reference
""",
    "inventory": f"""
.decl of_kind(kind, id)
of_kind(k, x) :- {node("x", kind="k")}.
.decl node_kind_inventory(kind, name, category, node_count)
node_kind_inventory(k, w, c, n) :- node_kind(k, w, c), n = count : {{ of_kind(k, _) }}.
.decl relation_inventory(relation, name, edge_count)
relation_inventory(r, w, n) :- relation_kind(r, w), n = count : {{ edge(_, _, r, _) }}.
.decl main_file_nodes(node_count)
main_file_nodes(n) :- n = count : {{ node_in_main_file(_) }}.
.decl in_header(id)
in_header(x) :- file(f, _, 0), {node("x", file="f")}, x != 0.
.decl header_nodes(node_count)
header_nodes(n) :- n = count : {{ in_header(_) }}.
.decl locationless_cursors(id, kind)
locationless_cursors(x, k) :- {node("x", kind="k", file=0)}, k < 1000.
.decl usrless_named_cursors(id, kind, spelling)
usrless_named_cursors(x, k, w) :- {node("x", kind="k", symbol=0, spelling="w")}, k < 1000, w != "".
.decl reference_without_usr(site, target, spelling)
reference_without_usr(s, t, w) :- refers(s, t), {node("t", symbol=0, spelling="w")}, w != "".
.output node_kind_inventory
.output relation_inventory
.output main_file_nodes
.output header_nodes
.output locationless_cursors
.output usrless_named_cursors
.output reference_without_usr
""",
}


#: What tells the rows of the tables of a tree apart.
KEYS = {"node": (0,), "symbol": (0,), "file": (0,), "edge": (0, 1, 2)}
#: Relations of types, which are few where nodes are many, and many nodes have one type.
HELD = {"type_reach", "asked_type", "readonly_pointer", "template_argument"}


def run(spark: SparkSession, name: str, tables: dict[str, DataFrame], wanted: list[str] | None = None, unit: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """The outputs of a program (those `wanted`, all by default) over the tables of a tree; query_seed and
    query_target, a column of names each, are among the tables where a program asks for them. unit: a
    function of a node's id that says which nodes' subtrees lie together, see closure.reach()."""
    program = Program(PRELUDE + PROGRAMS[name])
    outputs = wanted or program.outputs
    return program.run(spark, {k: v for k, v in tables.items() if k in program.reads(outputs)}, outputs, keys=KEYS, units={"child": unit} if unit else None, held=HELD)


def walks(name: str, wanted: list[str]) -> bool:
    """Whether outputs read the trees' edges between nodes, and not only nodes."""
    return bool(Program(PRELUDE + PROGRAMS[name]).needs(wanted) & {"child", "refers"})
