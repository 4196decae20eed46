"""What C++ type spellings say: pure functions, run over distinct spellings by one Arrow-batched UDF."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.schemas import ENTITY_EDGE_KIND

# The wrappers that the classification knows, with and without their namespace.
UNIQUE = ("unique_ptr", "optional")
SHARED = ("shared_ptr",)
WEAK = ("weak_ptr",)
CONTAINERS = ("vector", "list", "deque", "set", "unordered_set")
#: Known with the namespace only.
MAPS = ("std::map", "std::unordered_map")

_HEAD = re.compile(r"^((?:std::)?)([a-z_]+)<(.*)$", re.S)


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts between separators outside all brackets, trimmed; an empty end is no part."""
    parts, depth, start = [], 0, 0
    for m in re.finditer(r"[<(\[{]|[>)\]}]|" + re.escape(sep), text):
        c = m.group()
        if c == sep:
            if depth == 0:
                parts.append(text[start : m.start()].strip())
                start = m.end()
        else:
            depth += 1 if c in "<([{" else -1
    last = text[start:].strip()
    return [*parts, last] if last else parts


def bare(spelling: str) -> str:
    """Without const and volatile."""
    return re.sub(r"const |volatile ", "", spelling).strip()


def wrapper(spelling: str) -> tuple[str, str] | None:
    """(class of wrapper, the last argument) of a spelling that begins with a known wrapper."""
    m = _HEAD.match(spelling)
    if not m:
        return None
    space, name, inner = m.groups()
    group = next((g for g, names in (("unique", UNIQUE), ("shared", SHARED), ("weak", WEAK), ("container", CONTAINERS)) if name in names), None)
    if group is None and space + name in MAPS:
        group = "container"
    if group is None:
        return None
    inner = inner.strip()
    inner = inner[:-1].strip() if inner.endswith(">") else inner
    args = split_top(inner)
    return group, args[-1] if args else inner


def ownership(spelling: str) -> tuple[int, int]:
    """(entity edge kind, multiplicity) of a field of this type."""
    composes, aggregates, associates = (ENTITY_EDGE_KIND[k] for k in ("composes", "aggregates", "associates"))
    s, many = bare(spelling), False
    while True:
        if s.endswith("]"):
            return composes, 3 if many else 4
        found = wrapper(s)
        if not found or found[0] != "container":
            break
        s, many = bare(found[1]), True
    kind, multiplicity = composes, 1
    if found:
        kind, multiplicity = {"unique": composes, "shared": aggregates, "weak": associates}[found[0]], 2
    elif s.endswith(("*", "&")):
        kind, multiplicity = associates, 2
    return kind, 3 if many else multiplicity


def core(spelling: str) -> str:
    """The innermost type: no qualifiers, references, arrays or known wrappers."""
    s = bare(spelling)
    while True:
        while s.endswith(("&", "*", "]")):
            s = s[: s.rfind("[")].strip() if s.endswith("]") else s[:-1].strip()
        s = bare(s)
        found = wrapper(s)
        if not found:
            return s
        s = bare(found[1])


def return_type(signature: str) -> str:
    at = signature.find("(")
    return (signature[:at] if at > 0 else signature).strip()


def parse_signature(signature: str | None) -> tuple[str | None, list[str] | None]:
    """(return type, parameter types) of `RET (ARGS)`; (None, None) without a parameter list."""
    if not signature or "(" not in signature:
        return None, None
    head, _, tail = signature.partition("(")
    depth, end = 1, len(tail)
    for i, c in enumerate(tail):
        depth += (c == "(") - (c == ")")
        if not depth:
            end = i
            break
    inner = tail[:end].strip()
    return head.strip() or None, [] if inner in ("", "void") else split_top(inner)


def normal(text: str) -> str:
    """A spelling for tolerant comparison: std::__1 as std, no blanks that say nothing."""
    t = re.sub(r"\s+", " ", text.replace("std::__1::", "std::")).strip()
    return re.sub(r"\s*([<>,*&()\[\]])\s*", r"\1", t)


def same_type(want: str, got: str) -> bool:
    a, b = normal(want), normal(got)
    return a == b or re.sub(r"\w+::", "", a) == re.sub(r"\w+::", "", b)


def classified(spellings: DataFrame, column: str) -> DataFrame:
    """(column, field_kind, multiplicity, core, returns) for the distinct values of a column."""

    @F.arrow_udf("struct<field_kind:int,multiplicity:int,core:string,returns:string>")
    def told(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            if t is None:
                rows.append(None)
                continue
            kind, multiplicity = ownership(t)
            rows.append({"field_kind": kind, "multiplicity": multiplicity, "core": core(t), "returns": core(return_type(t)) if return_type(t) not in ("", "void", "auto") else None})
        return pa.array(rows, pa.struct([("field_kind", pa.int32()), ("multiplicity", pa.int32()), ("core", pa.string()), ("returns", pa.string())]))

    return spellings.select(column).where(F.col(column).isNotNull()).distinct().select(column, told(F.col(column)).alias("t")).select(column, "t.*")


def base_type(spelling: str) -> str:
    """The bare name of a type: without qualifiers, pointers, references, scope and arguments."""
    return without_arguments(core(spelling)).rpartition("::")[2]


def top_level_const(spelling: str) -> bool:
    """Whether a variable of this type is const itself, and not only what it points to."""
    at = max(spelling.rfind("*"), spelling.rfind("&"))
    return bool(re.search(r"\b(const|constexpr)\b", spelling[at + 1 :] if at >= 0 else spelling))


def without_scope(text: str) -> str:
    return re.sub(r"\w+::", "", text)


def without_arguments(name: str) -> str:
    """`app::Box` of `app::Box<int>`."""
    return name.split("<", 1)[0] if name.endswith(">") else name


def instance_name(name: str | None) -> tuple[str | None, list[str] | None]:
    """(`app::Box`, [`int`, `char`]) of `app::Box<int, char>`; the arguments are None if there are none."""
    if not name or not name.endswith(">") or "<" not in name:
        return name, None
    head, _, inner = name.partition("<")
    return head, split_top(inner[:-1])


def unqualified(name: str) -> str:
    """The last part of a qualified name; scopes within arguments do not count."""
    depth, at = 0, 0
    for i, c in enumerate(name):
        depth += (c in "<(") - (c in ">)")
        if not depth and name[i : i + 2] == "::":
            at = i + 2
    return name[at:]


def return_and_name(head: str) -> tuple[str | None, str]:
    """(type, name) of what stands before a parameter list; blanks within arguments do not part them."""
    depth, at = 0, -1
    for i, c in enumerate(head.strip()):
        depth += (c == "<") - (c == ">")
        if not depth and c in " *&":
            at = i
    head = head.strip()
    return (head[: at + 1].strip() or None, head[at + 1 :]) if at >= 0 else (None, head)


class Signature:
    """A constraint on a callable: a return type and parameter types; None says nothing."""

    def __init__(self, ret: str | None = None, params: list[str] | None = None):
        self.ret, self.params = ret, params

    @classmethod
    def from_parts(cls, ret: str | None = None, params: list[str] | None = None) -> Signature:
        return cls(ret, None if params is None else list(params))

    @classmethod
    def parse_ret_params(cls, text: str) -> Signature:
        """Of `ret(param, ...)`; without a type before the parenthesis any type will do."""
        if "(" not in text:
            raise ValueError(f"no parameter list: {text}")
        return cls(*parse_signature(text))

    @classmethod
    def parse_full(cls, text: str) -> tuple[Signature, str]:
        """(signature, name) of `ret name(param, ...)`."""
        if "(" not in text:
            raise ValueError(f"no parameter list: {text}")
        head, params = parse_signature(text)
        ret, name = return_and_name(head or "")
        return cls(ret, params), name

    def matches(self, type_info: str | None) -> bool:
        """Whether a callable whose type is spelled so satisfies it."""
        ret, params = parse_signature(type_info)
        if self.ret is not None and not same_type(self.ret, ret or ""):
            return False
        return self.params is None or (params is not None and len(params) == len(self.params) and all(same_type(a, b) for a, b in zip(self.params, params, strict=True)))


def matching(symbols: DataFrame, signature: Signature, column: str = "type_info") -> DataFrame:
    """The symbols whose type satisfies a signature; distinct spellings are told once, on the executors."""
    if signature.ret is None and signature.params is None:
        return symbols
    ret, params = signature.ret, signature.params

    @F.arrow_udf("boolean")
    def fits(texts: pa.Array) -> pa.Array:
        want = Signature(ret, params)
        return pa.array([want.matches(t) for t in texts.to_pylist()], pa.bool_())

    ok = symbols.where(F.col(column).isNotNull()).select(column).distinct().where(fits(column))
    return symbols.join(ok, column, "left_semi").select(symbols.columns)
