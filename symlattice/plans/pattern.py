"""A small text language over the code graph, compiled to DataFrames.

    match function f, class c where f.name ~ "rank" and c inherits+ "geo::Shape" select f, c.name
    show path from "main" to "app::normalize" via calls
    rank f in match function f select f by count(callers+ f) desc limit 10

A match is the product of its bindings, filtered (a bag); closure tests between two variables that
must hold are joins, so that the product is not made. What differs from the usual reading:
values are compared as text (booleans as True and False); a null passes != only; ~ searches
unanchored; calls+ follows dispatch calls as well and never leads back to its start, callers+ does
on a cycle; implements+ holds for the base itself; count(v) is a real count of the rows by default
and 1 a row with compat=True; via inherits goes from a class to its direct subclasses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.functions.names import basename
from symlattice.operators.closure import backward, path, reach
from symlattice.operators.graph import Graph
from symlattice.schemas import ENTITY_KIND, SYMBOL_KIND

# The kinds that can be bound, as kinds of symbols.
KINDS = {
    "function": ("function",), "method": ("method",), "class": ("class",), "struct": ("struct",), "interface": ("class",),
    "record": ("class", "struct", "union"), "namespace": ("namespace",), "enum": ("enum",), "field": ("member",),
    "callable": ("function", "method", "constructor", "destructor", "function-template"),
    "any": ("function", "method", "class", "struct", "enum", "namespace"),
    "union": ("union",), "variable": ("variable",), "typedef": ("typedef",), "class-template": ("class-template",),
    "function-template": ("function-template",), "constructor": ("constructor",), "destructor": ("destructor",),
}
CLOSURES = ("calls+", "calls*", "inherits+", "inherits*", "implements+")
METRICS = ("callers+", "callers", "callees+", "callees")
TOKEN = re.compile(r"""\s+|("[^"]*"|'[^']*')|([A-Za-z_][\w-]*[+*]?)|(\d+)|(!=|[=~,.()\[\]])""")


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Attribute:
    var: str
    attr: str
    op: str
    value: str | tuple[str, ...]


@dataclass(frozen=True)
class Closure:
    left: str
    op: str
    right: str
    left_var: bool
    right_var: bool


@dataclass(frozen=True)
class Logic:
    op: str
    parts: tuple


@dataclass
class Match:
    bindings: list[tuple[str, str]]
    condition: object | None
    select: list[tuple[str, str | None]]  # (variable, attribute); attribute None: the entity, "count()": its count


@dataclass
class Rank:
    inner: Match
    var: str
    metric: str
    desc: bool
    limit: int | None


@dataclass
class Path:
    start: str
    end: str
    via: str


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected {text[at]!r} at {at}")
            at = m.end()
            if m.lastindex:
                self.tokens.append(m[m.lastindex])
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, *want: str) -> str:
        t = self.peek()
        if not t or (want and t not in want):
            raise ParseError(f"expected {' or '.join(want) or 'more'}, found {t or 'the end'}")
        self.at += 1
        return t

    def text(self) -> str:
        t = self.take()
        if t[0] not in "\"'":
            raise ParseError(f"expected a string, found {t}")
        return t[1:-1]

    def query(self):
        if self.peek() == "show":
            self.take()
            self.take("path")
            self.take("from")
            a = self.text()
            self.take("to")
            b = self.text()
            self.take("via")
            out = Path(a, b, self.take("calls", "inherits"))
        elif self.peek() == "rank":
            self.take()
            var = self.take()
            self.take("in")
            out = self.rank(self.match(), var)
        else:
            out = self.match()
            if self.peek() == "rank":
                self.take()
                out = self.rank(out, self.take())
        if self.peek():
            raise ParseError(f"unexpected {self.peek()}")
        return out

    def rank(self, inner: Match, var: str) -> Rank:
        self.take("by")
        self.take("count")
        self.take("(")
        metric = self.take(*METRICS)
        if self.take() != var:
            raise ParseError("the metric is of another variable")
        self.take(")")
        desc = self.peek() == "desc" and bool(self.take())
        limit = None
        if self.peek() == "limit":
            self.take()
            limit = int(self.take())
        return Rank(inner, var, metric, desc, limit)

    def match(self) -> Match:
        self.take("match")
        bindings = []
        while True:
            if self.peek() == "match":
                self.take()
            bindings.append((self.take(*KINDS), self.take()))
            if self.peek() != ",":
                break
            self.take()
        condition = None
        if self.peek() == "where":
            self.take()
            condition = self.either()
        self.take("select")
        select = [self.projection()]
        while self.peek() == ",":
            self.take()
            select.append(self.projection())
        known = {v for _, v in bindings}
        for v, _ in select:
            if v not in known:
                raise ParseError(f"unknown variable {v}")
        return Match(bindings, condition, select)

    def projection(self) -> tuple[str, str | None]:
        if self.peek() == "count" and self.peek(1) == "(":
            self.take()
            self.take()
            v = self.take()
            self.take(")")
            return v, "count()"
        v = self.take()
        if self.peek() == ".":
            self.take()
            return v, self.take()
        return v, None

    def either(self):
        parts = [self.both()]
        while self.peek() == "or":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Logic("or", tuple(parts))

    def both(self):
        parts = [self.unary()]
        while self.peek() == "and":
            self.take()
            parts.append(self.unary())
        return parts[0] if len(parts) == 1 else Logic("and", tuple(parts))

    def unary(self):
        if self.peek() == "not":
            self.take()
            return Logic("not", (self.unary(),))
        if self.peek() == "(":
            self.take()
            inner = self.either()
            self.take(")")
            return inner
        if self.peek(1) in CLOSURES:
            a, op, b = self.take(), self.take(), self.take()
            is_var = lambda t: t[0] not in "\"'"
            out = Closure(a.strip("\"'"), op, b.strip("\"'"), is_var(a), is_var(b))
            if not (out.left_var or out.right_var) or (op == "implements+" and not out.left_var):
                raise ParseError(f"{op} needs a variable")
            return out
        var = self.take()
        self.take(".")
        attr, op = self.take(), self.take("=", "!=", "~", "in")
        if op != "in":
            return Attribute(var, attr, op, self.text())
        self.take("[")
        values = [self.text()]
        while self.peek() == ",":
            self.take()
            values.append(self.text())
        self.take("]")
        return Attribute(var, attr, op, tuple(values))


def parse(text: str):
    return Parser(text).query()


class Engine:
    """Runs queries over a resolved catalog. limit bounds the candidates of a kind (shortest names
    first), before any condition; None takes all. As the language has it, a name in a closure stands
    for its 20 best matches, an end of a path for 10, and a path has 64 steps at most; `named`, `ends`
    and `steps` say otherwise, None without a bound."""

    def __init__(self, graph: Graph, limit: int | None = None, compat: bool = False, named: int | None = 20, ends: int | None = 10, steps: int | None = 64):
        self.g, self.limit, self.compat, self.named, self.ends, self.steps = graph, limit, compat, named, ends, steps
        self.calls = graph.pairs(["calls", "dispatch_calls"]).distinct()
        self.down = graph.pairs(["inherits"], "in").distinct()

    def run(self, text: str) -> DataFrame:
        q = parse(text)
        return self.path(q) if isinstance(q, Path) else self.rank(q) if isinstance(q, Rank) else self.match(q)

    # --- entities

    def entities(self) -> DataFrame:
        s = self.g.symbols()
        flag = lambda c: F.when(F.coalesce(c, F.lit(False)), "True").otherwise("False")
        virtual = self.g.virtual_methods().select("id", F.lit(True).alias("virtual"))
        node = self.g.c["entity_node"].select("id", F.col("kind").alias("design"))
        s = s.join(virtual, "id", "left").join(node, "id", "left")
        paren = F.instr("type_info", "(")
        returns = F.when(paren > 0, F.trim(F.substring("type_info", F.lit(1), paren - 1)))
        space = F.regexp_extract("name", "^(.*)::[^:]*$", 1)
        place = F.when(F.col("path").isNotNull(), F.concat_ws(":", "path", F.coalesce("line", F.lit(0)).cast("string"))).otherwise(F.col("decl_path"))
        abstract = [ENTITY_KIND[k] for k in ("abstract_class", "interface", "abstract_class_template", "interface_template")]
        return s.select(
            "id", "kind", F.col("design"), F.col("name"), F.col("name").alias("fqn"), "spelling", F.col("kind_name"), F.col("type_info").alias("signature"), returns.alias("return_type"),
            flag(F.col("virtual")).alias("is_virtual"), flag(F.col("is_pure") == 1).alias("is_pure"), flag(F.col("is_static") == 1).alias("is_static"),
            flag(F.col("design").isin(abstract)).alias("is_abstract"), flag(F.col("design") == ENTITY_KIND["interface"]).alias("is_interface"),
            "access", F.when(space != "", space).alias("namespace"), place.alias("location"), basename(F.col("path")).alias("file"), "usr", F.col("is_definition").cast("string").alias("is_definition"),
        )

    def candidates(self, kind: str) -> DataFrame:
        e = self.entities().where(F.col("kind").isin([SYMBOL_KIND[k] for k in KINDS[kind]]))
        if self.limit is not None:
            e = e.orderBy(F.length("name"), "name", "id").limit(self.limit)
        return e.where(F.col("design") == ENTITY_KIND["interface"]) if kind == "interface" else e

    def _column(self, var: str, attr: str) -> Column:
        names = {"kind": "kind_name"}
        return F.col(f"{var}.{names.get(attr, attr)}")

    # --- conditions

    def _named(self, text: str) -> DataFrame:
        return self.g.symbols().where((F.col("name") == text) | (F.col("spelling") == text)).select("id")

    def _pairs(self, op: str, seeds: DataFrame | None, left: bool) -> DataFrame:
        """(a, b): a op b, for the a's (left) or the b's among seeds, or all."""
        reflexive = op.endswith("*") or op == "implements+"
        edges = self.calls if op.startswith("calls") else backward(self.down)
        found = reach(edges if left or seeds is None else backward(edges), seeds).where("a <> b").select("a", "b")
        found = found if left or seeds is None else backward(found)
        if reflexive:
            own = (seeds if seeds is not None else edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))).toDF("a")
            found = found.unionByName(own.select("a", F.col("a").alias("b"))).distinct()
        return found

    def _closure_column(self, df: DataFrame, c: Closure, name: str) -> DataFrame:
        """df with a boolean column of the test."""
        if c.left_var and c.right_var:
            p = self._pairs(c.op, None, True).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias(name))
            hit = (F.col(f"{c.left}.id") == F.col("_a")) & (F.col(f"{c.right}.id") == F.col("_b"))
            if c.op.endswith("*") or c.op == "implements+":
                out = df.join(p, hit, "left")
                return out.withColumn(name, F.coalesce(name, F.col(f"{c.left}.id") == F.col(f"{c.right}.id"))).drop("_a", "_b")
            return df.join(p, hit, "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_a", "_b")
        var, text = (c.left, c.right) if c.left_var else (c.right, c.left)
        seeds = self._named(text) if c.op.startswith("calls") else self.g.find(text, limit=self.named).select("id")
        p = self._pairs(c.op, seeds, not c.left_var)
        ids = p.select((F.col("a") if c.left_var else F.col("b")).alias("_a")).distinct().withColumn(name, F.lit(True))
        return df.join(ids, F.col(f"{var}.id") == F.col("_a"), "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_a")

    def _condition(self, df: DataFrame, c, made: list[str]) -> tuple[DataFrame, Column]:
        if isinstance(c, Logic):
            cols = []
            for part in c.parts:
                df, col = self._condition(df, part, made)
                cols.append(col)
            out = cols[0]
            for col in cols[1:]:
                out = out & col if c.op == "and" else out | col
            return df, ~out if c.op == "not" else out
        if isinstance(c, Closure):
            made.append(f"_t{len(made)}")
            return self._closure_column(df, c, made[-1]), F.col(made[-1])
        col = self._column(c.var, c.attr)
        test = {"=": lambda: col == c.value, "!=": lambda: col.isNull() | (col != c.value), "~": lambda: col.rlike(c.value), "in": lambda: col.isin(*c.value)}[c.op]()
        return df, F.coalesce(test, F.lit(False))

    def rows(self, q: Match) -> DataFrame:
        """A struct column for each variable, one row for each match."""
        parts = list(q.condition.parts) if isinstance(q.condition, Logic) and q.condition.op == "and" else [q.condition] if q.condition else []
        each = {}
        for kind, var in q.bindings:
            e = self.candidates(kind)
            df = e.select(F.struct(*e.columns).alias(var))
            # conditions on one variable alone come before any product
            for c in [c for c in parts if isinstance(c, Attribute) and c.var == var]:
                df, col = self._condition(df, c, [])
                df = df.where(col)
                parts.remove(c)
            each[var] = df
        joins = [c for c in parts if isinstance(c, Closure) and c.left_var and c.right_var and c.left != c.right and c.op in ("calls+", "inherits+")]
        out, bound = None, []
        for _, var in q.bindings:
            df = each[var]
            if out is None:
                out, bound = df, [var]
                continue
            link = next((c for c in joins if {c.left, c.right} - {var} <= set(bound) and var in (c.left, c.right)), None)
            if link is None:
                out = out.crossJoin(df)
            else:
                joins.remove(link)
                parts.remove(link)
                p = self._pairs(link.op, None, True).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
                out = out.join(p, F.col(f"{link.left if link.left in bound else link.right}.id") == (F.col("_a") if link.left in bound else F.col("_b")))
                out = out.join(df, F.col(f"{var}.id") == (F.col("_b") if link.left in bound else F.col("_a"))).drop("_a", "_b")
            bound.append(var)
        made: list[str] = []
        for c in parts:
            out, col = self._condition(out, c, made)
            out = out.where(col)
        return out.select(*bound)

    # --- statements

    def match(self, q: Match) -> DataFrame:
        """Columns var.attr, `var` (struct of name, kind, location) and count(var)."""
        rows = self.rows(q)
        cols, counts = [], []
        for var, attr in q.select:
            if attr == "count()":
                counts.append(var)
            elif attr is None:
                cols.append(F.struct(F.col(f"{var}.name").alias("name"), F.col(f"{var}.kind_name").alias("kind"), F.col(f"{var}.location").alias("location")).alias(var))
            else:
                cols.append(self._column(var, attr).alias(f"{var}.{attr}"))
        if counts and not self.compat:
            names = [f"_g{i}" for i in range(len(cols))]
            flat = rows.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)])
            told = [x for x in q.select if x[1] != "count()"]
            final = [F.col(n).alias(v if a is None else f"{v}.{a}") for n, (v, a) in zip(names, told, strict=True)]
            return flat.groupBy(*names).agg(F.count("*").alias("_n")).select(*final, *[F.col("_n").alias(f"count({v})") for v in counts])
        return rows.select(*cols, *[F.lit(1).alias(f"count({v})") for v in counts])

    def rank(self, q: Rank) -> DataFrame:
        """(score, id, name, kind, location), ties by length of name, name and id."""
        if q.var not in [v for _, v in q.inner.bindings]:
            raise ParseError(f"unknown variable {q.var}")
        v = q.var
        rows = self.rows(q.inner).select(F.col(f"{v}.id").alias("id"), F.col(f"{v}.name").alias("name"), F.col(f"{v}.kind_name").alias("kind"), F.col(f"{v}.location").alias("location")).distinct()
        edges = self.calls if q.metric.startswith("callees") else backward(self.calls)
        if q.metric.endswith("+"):
            n = reach(edges, rows.select("id")).select("a", "b")
            n = n.where("a <> b") if q.metric == "callees+" else n
        else:
            n = edges
        n = n.groupBy(F.col("a").alias("id")).agg(F.countDistinct("b").alias("score"))
        out = rows.join(n, "id", "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("long"))
        out = out.orderBy(F.desc("score") if q.desc else F.asc("score"), F.length("name"), "name", "id")
        return (out if q.limit is None else out.limit(q.limit)).select("score", "id", "name", "kind", "location")

    def path(self, q: Path) -> DataFrame:
        """(step, id, name) of a shortest way between the first of ten candidates each that are connected."""
        edges = self.calls if q.via == "calls" else self.down
        first, last = ([r["id"] for r in self.g.find(t, limit=self.ends).collect()] for t in (q.start, q.end))
        way = next((w for a in first for b in last if (w := path(edges, a, b, self.steps))), [])
        steps = self.g.spark.createDataFrame(list(enumerate(way)), "step long, id long")
        return steps.join(self.g.symbols().select("id", "name"), "id").select("step", "id", "name").orderBy("step")
