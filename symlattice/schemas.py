"""Numbers and columns of the code-graph facts.

Fixed values: the kinds below are contracts of the fact tables; they must equal those the indexer writes.
"""

from __future__ import annotations

SYMBOL_KIND = {
    "struct": 2, "union": 3, "class": 4, "enum": 5, "member": 6, "enum-constant": 7, "function": 8, "variable": 9,
    "typedef": 20, "method": 21, "namespace": 22, "constructor": 24, "destructor": 25, "function-template": 30,
    "class-template": 31, "type-alias": 36, "macro": 501,
}
EDGE_KIND = {
    "calls": 1, "inherits": 2, "contains": 3, "specializes": 4, "instantiates": 5, "overrides": 6, "uses": 7, "field_of": 8,
    "method_of": 9, "construct-value": 10, "construct-temp": 11, "construct-heap": 12, "construct-copy": 13,
    "construct-move": 14, "factory-construct": 15, "destroy": 16, "friend": 17, "dispatch_calls": 18,
}
ENTITY_EDGE_KIND = {
    "generalizes": 1, "implements": 2, "specializes": 3, "composes": 4, "aggregates": 5, "associates": 6,
    "creates": 7, "uses": 8, "destroys": 9, "befriends": 10, "instantiates": 11, "declares": 12,
}
ENTITY_KIND = {
    "other": 0, "class": 1, "abstract_class": 2, "interface": 3, "union": 4, "enum": 5, "class_template": 6,
    "abstract_class_template": 7, "interface_template": 8, "namespace": 9,
}
#: create_form by kind of construct edge; 2 is a method's return by value.
CREATE_FORM = {10: 3, 11: 4, 12: 5, 15: 6, 13: 7, 14: 8}
ACCESS = {"public": 0, "protected": 1, "private": 2}

RECORDS = (SYMBOL_KIND["struct"], SYMBOL_KIND["union"], SYMBOL_KIND["class"])
ENTITIES = (*RECORDS, SYMBOL_KIND["enum"])
CALLABLES = tuple(SYMBOL_KIND[k] for k in ("function", "method", "constructor", "destructor", "function-template"))

#: Columns of each fact table, as Spark DDL.
TABLES = {
    "component": "id long, name string, path string, kind string, version string, repository_id long",
    "directory": "id long, component_id long, path string",
    "file": "id long, directory_id long, name string, mtime double, md5 string, indexed int, compile_options string",
    "symbol": "id long, usr string, spelling string, qual_name string, display_name string, kind int, type_info string, file_id long, line int, col int, end_line int, end_col int, "
    "decl_file_id long, decl_line int, decl_path string, is_definition int, is_pure int, is_static int, is_instantiation int, is_named_instance int, linkage string, access string, "
    "parent_usr string, resolved int, multi_def int",
    "edge": "id long, src_id long, dst_id long, kind int, count long, base_access int, is_virtual int",
    "edge_site": "edge_id long, file_id long, line int, col int, conditional int",
    "call_arg": "edge_id long, file_id long, line int, col int, position int, src_kind string, type_usr string, decl_usr string, callee_usr string, type_is_value int",
    "decl_site": "symbol_id long, file_id long, line int, col int",
    "template_param": "owner_id long, position int, param_kind int, name string, default_txt string",
    "template_arg": "owner_id long, position int, arg_kind int, ref_id long, literal string",
    "definition": "id long, symbol_id long, component_id long, file_id long, line int, col int, end_line int, end_col int, init_text string",
    "def_edge": "id long, src_def_id long, dst_id long, kind int, count long",
    "entity_node": "id long, kind int",
    "entity_edge": "src_id long, dst_id long, kind int, count long, via_member_id long, multiplicity int, access int, is_virtual int, create_form int, partial int",
    "possible_call": "src_def_id long, dst_def_id long, count long",
    "diagnostic": "id long, file_id long, severity int, line int, col int, message string",
    "repository": "id long, name string, kind string, remote_url string, active_clone_id long",
    "clone": "id long, repository_id long, path string, label string",
    "label": "name string, path string",
    "meta": "key string, value string",
}


def kind_ids(names, table: dict[str, int] = EDGE_KIND) -> list[int]:
    """Numbers of the named kinds; an unknown name is an error."""
    unknown = [n for n in names if n not in table]
    if unknown:
        raise ValueError(f"unknown kind: {', '.join(unknown)}")
    return [table[n] for n in names]
