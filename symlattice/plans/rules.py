"""Datalog programs over DataFrames: parsed, stratified, and run as joins with semi-naive rounds.

Supported: rules with atoms, !negation, comparisons, + - * on numbers, count/sum/min/max aggregates
(`n = count : { body }`), match(regex, x), contains(part, x), cat(x, y), strlen(x), constants and _;
facts; several heads; disjunction by `;`. .decl names the attributes; .input, .output, .type and
#include lines are directives for the caller, who passes the input relations as DataFrames (their
columns by position). Relations are sets. A relation that is used under a negation or an aggregate
must not depend on the rule's head.

Before a program runs, rules that are the only ones of their relation are put in place where they are
used, and atoms of one input relation with the same key become one; unary facts become filters, rows are
made distinct where a rule forgets what tells them apart, and a closure H(a, y) :- H(a, m), S(m, y) is
walked by operators/closure.py, from those a's only that the rules around it ask for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.operators.closure import reach, ready
from symlattice.staging import cut, drop_staged, sent

TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|("(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_?][\w.?]*)|(:-|!=|<=|>=|[-+*<>=!(){}\[\],.;:|])', re.S)


class RuleError(ValueError):
    pass


@dataclass
class Atom:
    name: str
    args: list
    negated: bool = False


@dataclass
class Compare:
    op: str
    left: object
    right: object


@dataclass
class Test:
    name: str
    args: list
    negated: bool = False


@dataclass
class Aggregate:
    var: str
    op: str
    of: object
    body: list


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple


@dataclass
class Rule:
    head: Atom
    body: list = field(default_factory=list)


ANY = Var("_")
TESTS = ("match", "contains")


class Parser:
    def __init__(self, text: str):
        self.attributes: dict[str, list[str]] = {}
        self.outputs: list[str] = []
        lines = []
        for line in text.splitlines():
            if re.match(r"\s*\.decl\b", line):
                m = re.match(r"\s*\.decl\s+(\w+)\s*\(([^)]*)\)", line)
                if not m:
                    raise RuleError(f"declaration: {line.strip()}")
                self.attributes[m[1]] = [a.split(":")[0].strip() for a in m[2].split(",") if a.strip()]
            elif m := re.match(r"\s*\.output\s+(\w+)", line):
                self.outputs.append(m[1])
            elif not re.match(r"\s*(\.|#)", line):
                lines.append(line)
        self.tokens: list[str] = []
        src, at = "\n".join(lines), 0
        while at < len(src):
            m = TOKEN.match(src, at)
            if not m:
                raise RuleError(f"unexpected {src[at : at + 20]!r}")
            at = m.end()
            if m.lastindex:
                token = m[m.lastindex]
                # a word does not hold the full stop that ends a rule
                while m.lastindex == 3 and token.endswith("."):
                    token, at = token[:-1], at - 1
                self.tokens.append(token)
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or (want and t != want):
            raise RuleError(f"expected {want or 'more'}, found {t or 'the end'}")
        self.at += 1
        return t

    def rules(self) -> list[Rule]:
        out = []
        while self.peek():
            heads = [self.atom()]
            while self.peek() == ",":
                self.take()
                heads.append(self.atom())
            bodies = [[]]
            if self.peek() == ":-":
                self.take()
                bodies = [self.body()]
                while self.peek() == ";":
                    self.take()
                    bodies.append(self.body())
            self.take(".")
            out += [Rule(h, b) for h in heads for b in bodies]
        return out

    def body(self) -> list:
        out = [self.literal()]
        while self.peek() == ",":
            self.take()
            out.append(self.literal())
        return out

    def literal(self):
        negated = False
        while self.peek() == "!":
            self.take()
            negated = not negated
        if self.peek(1) == "(" and re.match(r"[A-Za-z_]", self.peek()) and self.peek() not in ("cat", "strlen"):
            atom = self.atom()
            return Test(atom.name, atom.args, negated) if atom.name in TESTS else Atom(atom.name, atom.args, negated)
        left = self.term()
        op = self.take()
        if op not in ("=", "!=", "<", ">", "<=", ">="):
            raise RuleError(f"unexpected {op}")
        if op == "=" and self.peek() in ("count", "sum", "min", "max"):
            fn = self.take()
            of = None if self.peek() == ":" else self.term()
            self.take(":")
            self.take("{")
            body = self.body()
            self.take("}")
            return Aggregate(left.name, fn, of, body)
        return Compare(op, left, self.term())

    def atom(self) -> Atom:
        name = self.take()
        self.take("(")
        args = []
        while self.peek() != ")":
            args.append(self.term())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return Atom(name, args)

    def term(self):
        t = self.factor()
        while self.peek() in ("+", "-", "*"):
            t = Call(self.take(), (t, self.factor()))
        return t

    def factor(self):
        t = self.take()
        if t == "(":
            inner = self.term()
            self.take(")")
            return inner
        if t == "-":
            return Call("-", (0, self.factor()))
        if t[0] == '"':
            return t[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        if t[0].isdigit():
            return int(t)
        if t in ("cat", "strlen"):
            self.at -= 1
            a = self.atom()
            return Call(t, tuple(a.args))
        return Var(t)


def _names(literals: list) -> set[str]:
    return {x.name for x in literals if isinstance(x, Atom)} | {n for x in literals if isinstance(x, Aggregate) for n in _names(x.body)}


def _all_names(literals: list) -> list[str]:
    return [x.name for x in literals if isinstance(x, Atom)] + [n for x in literals if isinstance(x, Aggregate) for n in _all_names(x.body)]


def _variables(x) -> set[str]:
    """The variables of a term, a literal or a list of them."""
    if isinstance(x, Var):
        return set() if x == ANY else {x.name}
    if isinstance(x, (list, tuple)):
        return {v for y in x for v in _variables(y)}
    if isinstance(x, (Atom, Test, Call)):
        return _variables(x.args)
    if isinstance(x, Compare):
        return _variables([x.left, x.right])
    if isinstance(x, Aggregate):
        return {x.var} | _variables(x.body) | (_variables(x.of) if x.of is not None else set())
    return set()


def _put(x, of: dict):
    """A term or literal with variables replaced by terms."""
    if isinstance(x, Var):
        return of.get(x.name, x)
    if isinstance(x, Call):
        return Call(x.op, tuple(_put(a, of) for a in x.args))
    if isinstance(x, (Atom, Test)):
        return replace(x, args=[_put(a, of) for a in x.args])
    return Compare(x.op, _put(x.left, of), _put(x.right, of)) if isinstance(x, Compare) else x


class Program:
    """A parsed program. run() gives the derived relations, with the attributes that .decl names."""

    def __init__(self, text: str):
        p = Parser(text)
        self.rules, self.attributes, self.outputs = p.rules(), p.attributes, p.outputs
        self.heads = list(dict.fromkeys(r.head.name for r in self.rules))
        self._sets: dict[str, list] = {}

    def reads(self, wanted: list[str] | None = None) -> list[str]:
        """The input relations that the wanted ones (all by default) need."""
        need, more = set(), set(wanted or self.heads)
        while more:
            need |= more
            more = {n for r in self.rules if r.head.name in more for n in _names(r.body)} - need
        return sorted(need - set(self.heads))

    def strata(self) -> list[list[str]]:
        """Groups of mutually recursive relations, each after those it needs."""
        needs = {h: set() for h in self.heads}
        for r in self.rules:
            needs[r.head.name] |= _names(r.body) & set(self.heads)
        reach = {h: set(needs[h]) for h in self.heads}
        for _ in self.heads:
            for h in self.heads:
                reach[h] |= {y for x in reach[h] for y in reach[x]}
        groups: list[list[str]] = []
        for h in self.heads:
            if not any(h in g for g in groups):
                groups.append([x for x in self.heads if x == h or (h in reach[x] and x in reach[h])])
        order: list[list[str]] = []
        while groups:
            done = {x for g in order for x in g}
            ready = next(g for g in groups if all(n in done or n in g for x in g for n in needs[x]))
            order.append(ready)
            groups.remove(ready)
        for r in self.rules:
            group = next(g for g in order if r.head.name in g)
            held = {x.name for x in r.body if isinstance(x, Atom) and x.negated} | {n for x in r.body if isinstance(x, Aggregate) for n in _names(x.body)}
            if held & set(group):
                raise RuleError(f"{r.head.name} depends on its own negation or count")
        return order

    def needs(self, wanted: list[str]) -> set[str]:
        """The wanted relations and all that they rest on."""
        need, more = set(), set(wanted)
        while more:
            need |= more
            more = {n for r in self.rules if r.head.name in more for n in _names(r.body)} - need
        return need

    def given(self, names: set[str]) -> Program:
        """The program with some of its relations as inputs."""
        out = Program.__new__(Program)
        out.attributes, out.outputs, out._sets = self.attributes, self.outputs, {}
        out.rules = [r for r in self.rules if r.head.name not in names]
        out.heads = [h for h in self.heads if h not in names]
        return out

    def typed(self, inputs: dict[str, tuple[int, ...]]) -> dict[str, list[int]]:
        """The positions of each derived relation that hold what some positions of the inputs hold."""
        got = {k: set(v) for k, v in inputs.items()} | {h: set() for h in self.heads}
        while True:
            before = sum(map(len, got.values()))
            for r in self.rules:
                of = {a.name for x in r.body if isinstance(x, Atom) and not x.negated for i, a in enumerate(x.args) if isinstance(a, Var) and i in got.get(x.name, ())}
                got[r.head.name] |= {i for i, a in enumerate(r.head.args) if isinstance(a, Var) and a.name in of}
            if sum(map(len, got.values())) == before:
                return {h: sorted(got[h]) for h in self.heads}

    def _facts(self) -> dict[str, list]:
        """The unary relations that are constants only."""
        own = {h: [r for r in self.rules if r.head.name == h] for h in self.heads}
        return {h: [r.head.args[0] for r in rs] for h, rs in own.items() if all(not r.body and len(r.head.args) == 1 and not isinstance(r.head.args[0], (Var, Call)) for r in rs)}

    def unfolded(self, wanted: list[str], keys: dict[str, tuple[int, ...]], whole: set[str]) -> Program:
        """The same program for the wanted relations with rules put in place where that costs nothing twice:
        those used once, and those of an atom or two; relations in `whole` stay."""
        need, facts = self.needs(wanted), self._facts()
        rules = [r for r in self.rules if r.head.name in need]
        uses = Counter(n for r in rules for n in _all_names(r.body))
        recursive = {h for g in self.strata() for h in g if any(_names(r.body) & set(g) for r in self.rules if r.head.name in g)}
        out = Program.__new__(Program)
        out.attributes, out.outputs, out.rules, out._sets = self.attributes, self.outputs, [], {}
        inline: dict[str, Rule] = {}
        fresh = 0
        for group in self.strata():
            mine = [r for r in rules if r.head.name in group]
            for r in mine:
                body = []
                for x in r.body:
                    if not (isinstance(x, Atom) and not x.negated and x.name in inline):
                        body.append(x)
                        continue
                    fresh += 1
                    y = inline[x.name]
                    of = {v: Var(f"{v}__{fresh}") for v in _variables(y.body) | _variables(y.head)}
                    for h, a in zip(y.head.args, x.args):
                        if a != ANY:
                            of[h.name] = a
                    body += [_put(z, of) for z in y.body]
                made = Rule(r.head, self._merged(body, keys))
                out.rules.append(made)
            name = group[0]
            if len(mine) == 1 and len(group) == 1 and name not in recursive and name not in whole:
                r = out.rules[-1]
                plain = all(isinstance(a, Var) for a in r.head.args) and len({a.name for a in r.head.args}) == len(r.head.args) and r.body and not any(isinstance(x, Aggregate) for x in r.body)
                atoms = [x for x in r.body if isinstance(x, Atom) and x.name not in facts]
                if plain and (uses[name] == 1 or (len(atoms) <= 2 and all(x.name in keys for x in atoms))):
                    inline[name] = r
        out.heads = list(dict.fromkeys(r.head.name for r in out.rules))
        left = out.needs(wanted)
        out.rules = [r for r in out.rules if r.head.name in left]
        out.heads = [h for h in out.heads if h in left]
        return out

    @staticmethod
    def _merged(body: list, keys: dict[str, tuple[int, ...]]) -> list:
        """The body with one atom for each key of an input relation; a key stands for one row."""
        out, at = [], {}
        for x in body:
            place = None
            if isinstance(x, Atom) and not x.negated and x.name in keys:
                key = tuple(x.args[i] for i in keys[x.name])
                place = None if ANY in key else (x.name, key)
            if place is None or place not in at:
                if place is not None:
                    at[place] = len(out)
                out.append(x)
                continue
            old, args, more = out[at[place]], [], []
            for a, b in zip(old.args, x.args):
                args.append(b if a == ANY else a)
                if a != ANY and b != ANY and a != b:
                    more.append(Compare("=", a, b))
            out[at[place]] = replace(old, args=args)
            out += more
        return out

    def _tells(self, rule: Rule, keys: dict[str, tuple[int, ...]]) -> bool:
        """Whether a row of the head stands for one row of the body: then rows need not be made distinct."""
        got = _variables(rule.head.args)
        atoms = [x for x in rule.body if isinstance(x, Atom) and not x.negated]
        while True:
            before = len(got)
            for x in atoms:
                if all(x.args[i] != ANY and _variables(x.args[i]) <= got for i in keys.get(x.name, range(len(x.args)))):
                    got |= _variables(x.args)
            if len(got) == before:
                break
        return all(all(x.args[i] != ANY for i in keys.get(x.name, range(len(x.args)))) and _variables(x.args) <= got for x in atoms)

    def _closure(self, spark, name: str, known: dict[str, DataFrame], keys, units, wanted: list[str], written: set[str]) -> DataFrame | None:
        """A relation of pairs H(a, y) :- H(a, m), S(m, y) over whole numbers, whose other rules are S itself,
        S from guarded a's, or H(x, x); or a set H(y) :- H(m), S(m, y). None: it is none of these."""
        rules = [r for r in self.rules if r.head.name == name]
        rec, base = [r for r in rules if name in _names(r.body)], [r for r in rules if name not in _names(r.body)]
        if len(rec) != 1 or not base or any(not isinstance(a, Var) for r in rules for a in r.head.args):
            return None
        r, width = rec[0], len(rec[0].head.args)
        mine = [x for x in r.body if isinstance(x, Atom) and x.name == name]
        rest = [x for x in r.body if x is not mine[0]]
        if len(mine) != 1 or mine[0].negated or width > 2 or any(isinstance(x, Aggregate) or (isinstance(x, Atom) and x.negated) for x in rest) or any(not isinstance(a, Var) or a == ANY for a in mine[0].args):
            return None
        m, y = mine[0].args[-1].name, r.head.args[-1].name
        if m == y or (width == 2 and (mine[0].args[0] != r.head.args[0] or r.head.args[0].name in _variables(rest) | {m, y})) or not {m, y} <= _variables(rest):
            return None
        pair = lambda body, a, b: (lambda d, e: d.select(F.col(e[a]).alias("a"), F.col(e[b]).alias("b")))(*self._body(spark, body, known, {}))
        step = pair(rest, m, y)
        if any(f.dataType.typeName() not in ("long", "integer") for f in step.schema):
            return None
        if len(rest) == 1 and isinstance(rest[0], Atom) and rest[0].name in written and len(rest[0].args) == 2:
            step = ready(step)
        single = rest[0] if len(rest) == 1 and isinstance(rest[0], Atom) else None
        unit = (units or {}).get(single.name) if single is not None and [a for a in single.args] == [Var(m), Var(y)] else None
        if width == 1:
            seeds = self._union(spark, [self._rule(spark, b, known) for b in base])
            seeds = cut(seeds, "seeds")
            return seeds.unionByName(reach(step, seeds, unit=unit).select(F.col("b").alias("c0"))).distinct()
        if all(b.head.args[0] == b.head.args[1] for b in base):
            seeds = cut(self._union(spark, [self._rule(spark, Rule(Atom(name, b.head.args[:1]), b.body), known) for b in base]), "seeds")
            far = reach(step, seeds, unit=unit).where("a <> b").select("a", "b")
            return seeds.select(F.col("c0").cast("long").alias("c0"), F.col("c0").cast("long").alias("c1")).unionByName(far.toDF("c0", "c1"))
        if len(base) != 1:
            return None
        a, b = (x.name for x in base[0].head.args)
        same = [_put(x, {m: Var(a), y: Var(b)}) for x in rest]
        local = (_variables(rest) - {m, y})
        if local and len(base[0].body) == len(rest):
            same = base[0].body if repr(Program._shape(base[0].body, a, b)) == repr(Program._shape(rest, m, y)) else same
        guard = [x for x in base[0].body if x not in same]
        if len(guard) + len(same) != len(base[0].body) or b in _variables(guard) or (guard and (a not in _variables(guard) or local)):
            return None
        if guard:
            seeds = cut(self._rule(spark, Rule(Atom(name, [Var(a)]), guard), known), "seeds")
        else:
            asked = None if name in wanted else self._asked(name, keys)
            seeds = None if asked is None else self._union(spark, [self._rule(spark, q, known, few=True) for q in asked], few=True)
        return reach(step, seeds, unit=unit).select(F.col("a").alias("c0"), F.col("b").alias("c1"))

    @staticmethod
    def _shape(body: list, a: str, b: str) -> list:
        names: dict[str, Var] = {a: Var("a"), b: Var("b")}
        for x in body:
            for v in (t.name for t in getattr(x, "args", []) if isinstance(t, Var) and t != ANY):
                names.setdefault(v, Var(f"v{len(names)}"))
        return [_put(x, names) for x in body]

    def _asked(self, name: str, keys) -> list[Rule] | None:
        """Rules for the a's of name(a, _) that the other rules can use: what their input atoms with the key a
        say. None if some rule says nothing about its a."""
        facts, out = self._facts(), []
        for r in self.rules:
            if r.head.name == name:
                continue
            inside = [x for x in r.body if isinstance(x, Atom)] + [y for x in r.body if isinstance(x, Aggregate) for y in x.body if isinstance(y, Atom)]
            for x in inside:
                if x.name != name:
                    continue
                a = x.args[0]
                about = [y for y in r.body if isinstance(y, Atom) and not y.negated and y.name in keys and a != ANY and [y.args[i] for i in keys[y.name]] == [a]]
                if x.negated or not isinstance(a, Var) or not about:
                    return None
                got = _variables(about)
                for y in r.body:
                    if isinstance(y, Atom) and not y.negated and y not in about and ((y.name in facts) or (y.name in keys and len(keys[y.name]) == 1)) and _variables([y.args[i] for i in keys.get(y.name, (0,))]) <= got and y.args[keys.get(y.name, (0,))[0]] != ANY:
                        # a look-up of what is said about a: its file, its kind
                        if y.name in facts or y.name == "file":
                            about.append(y)
                out.append(Rule(Atom(name, [a]), about))
        return out or None

    def run(self, spark: SparkSession, relations: dict[str, DataFrame], only: list[str] | None = None, most_rounds: int = 10_000, keys: dict[str, tuple[int, ...]] | None = None, units: dict[str, Callable[[Column], Column]] | None = None, held: set[str] = frozenset()) -> dict[str, DataFrame]:
        """The relations `only` (all that have rules), with what they need computed once; what they do not
        need is not run. most_rounds bounds the rounds of a recursion; one that is not done by then is an error
        (a closure that goes without rounds is always done). keys: positions that tell an input relation's rows
        apart; units: for relations of pairs, a function that is the same for both ends (see reach()); held: relations that are as a
        rule few rows: they are written once, and sent where that is so, so that a join with them moves nothing else."""
        keys, wanted = keys or {}, only or self.heads
        return self.unfolded(wanted, keys, {*(units or {}), *held})._run(spark, relations, wanted, most_rounds, keys, units, held)

    def _run(self, spark, relations, wanted, most_rounds, keys, units, held) -> dict[str, DataFrame]:
        written = {k for k, v in relations.items() if getattr(v, "_ready", False)}
        known = {k: v.toDF(*[f"c{i}" for i in range(len(v.columns))]) for k, v in relations.items()}
        need = self.needs(wanted)
        self._sets = self._facts()
        uses = Counter(n for r in self.rules if r.head.name in need for n in _all_names(r.body))
        for group in self.strata():
            if not need & set(group):
                continue
            recursive = any(_names(r.body) & set(group) for r in self.rules if r.head.name in group)
            rules = [r for r in self.rules if r.head.name in group]
            if not recursive:
                few = len(rules) == 1 and group[0] not in wanted and self._tells(rules[0], keys)
                made = self._union(spark, [self._rule(spark, r, known, few=True) for r in rules], few)
                # what several rules read is computed once, unless it is one table's rows as they stand
                plain = few and sum(isinstance(x, Atom) and x.name not in self._sets for x in rules[0].body) <= 1
                if group[0] in held and uses[group[0]]:
                    known[group[0]] = sent(cut(made.distinct(), "relation"))
                else:
                    known[group[0]] = cut(made, "relation") if uses[group[0]] > 1 and not plain and group[0] not in self._sets else made
                continue
            if len(group) == 1 and most_rounds >= 10_000:
                made = self._closure(spark, group[0], known, keys, units, wanted, written)
                if made is not None:
                    known[group[0]] = sent(cut(made, "closure")) if group[0] in held else cut(made, "closure") if uses[group[0]] > 1 + (group[0] in _all_names([x for r in rules for x in r.body])) else made
                    continue
            base = {h: [self._rule(spark, r, known) for r in rules if r.head.name == h and not _names(r.body) & set(group)] for h in group}
            width = {h: len(next(r for r in rules if r.head.name == h).head.args) for h in group}
            delta = {h: cut(self._union(spark, base[h]), "delta") for h in group if base[h]}
            full = dict(delta)
            for _ in range(most_rounds):
                if not any(not d.isEmpty() for d in delta.values()):
                    break
                fresh: dict[str, list[DataFrame]] = {h: [] for h in group}
                for r in rules:
                    at = [i for i, x in enumerate(r.body) if isinstance(x, Atom) and x.name in group]
                    for i in at:
                        if r.body[i].name in delta and all(r.body[j].name in full for j in at):
                            fresh[r.head.name].append(self._rule(spark, r, known | full, {i: delta[r.body[i].name]}))
                new = {}
                for h, parts in fresh.items():
                    if parts:
                        found = self._union(spark, parts)
                        new[h] = cut(found.join(full[h], found.columns, "left_anti") if h in full else found, "delta")
                for h, d in new.items():
                    old = full.get(h)
                    full[h] = cut(old.unionByName(d), "full") if old is not None else d
                    if old is not None and old is not delta.get(h):
                        drop_staged(old)
                delta = new
            else:
                if any(not d.isEmpty() for d in delta.values()):
                    raise RuleError(f"{', '.join(group)}: not done after {most_rounds} rounds")
            for h in group:
                known[h] = full.get(h) if h in full else spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(width[h])))
        return {h: known[h].toDF(*self.attributes.get(h, known[h].columns)) for h in wanted}

    @staticmethod
    def _union(spark: SparkSession, parts: list[DataFrame], few: bool = False) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out if few else out.distinct()

    def _rule(self, spark: SparkSession, rule: Rule, known: dict[str, DataFrame], swap: dict[int, DataFrame] | None = None, few: bool = False) -> DataFrame:
        """The rows of a rule's head; few: they need not be distinct here."""
        df, env = self._body(spark, rule.body, known, swap or {})
        out = df.select(*[self._value(a, env).alias(f"c{i}") for i, a in enumerate(rule.head.args)])
        return out if few else out.distinct()

    def _value(self, term, env: dict[str, str]) -> Column:
        if isinstance(term, Var):
            if term.name not in env:
                raise RuleError(f"{term.name} is not bound")
            return F.col(env[term.name])
        if isinstance(term, Call):
            args = [self._value(a, env) for a in term.args]
            if term.op == "cat":
                return F.concat(*args)
            if term.op == "strlen":
                return F.length(args[0]).cast("long")
            a, b = args
            return {"+": a + b, "-": a - b, "*": a * b}[term.op]
        return F.lit(term) if isinstance(term, str) else F.lit(term).cast("long")

    def _ready(self, term, env: dict[str, str]) -> bool:
        if isinstance(term, Var):
            return term.name in env
        return all(self._ready(a, env) for a in term.args) if isinstance(term, Call) else True

    def _body(self, spark, body: list, known: dict[str, DataFrame], swap: dict[int, DataFrame], outer: tuple | None = None):
        df, env = outer or (None, {})
        left = list(enumerate(body))
        while left:
            # whatever can be decided now comes first, then an atom that shares a variable, then any atom
            pick = next((x for x in left if self._decidable(x[1], env)), None)
            if pick is None:
                atoms = [x for x in left if isinstance(x[1], Atom) and not x[1].negated]
                if atoms:
                    # facts are filters once their variable is there
                    atoms = [x for x in atoms if x[1].name not in self._sets] or atoms
                    share = [x for x in atoms if any(isinstance(a, Var) and a.name in env for a in x[1].args)]
                    changed = [x for x in atoms if x[0] in swap]
                    pick = (share or changed or atoms)[0]
                else:
                    # a count of everything
                    pick = next((x for x in left if isinstance(x[1], Aggregate) and not env), None)
                    if pick is None:
                        raise RuleError("a variable is bound by no atom")
                    df = spark.range(1).select(F.lit(1).alias("_one"))
            left.remove(pick)
            df, env = self._add(spark, df, env, pick[1], known, swap.get(pick[0]))
        if df is None:
            df = spark.range(1).select(F.lit(1).alias("_one"))
        return df, env

    def _decidable(self, x, env) -> bool:
        if isinstance(x, Atom) and not x.negated and x.name in self._sets:
            return bool(env) and x.args[0] != ANY and self._ready(x.args[0], env)
        if isinstance(x, Atom):
            return x.negated and bool(env) and all(a == ANY or self._ready(a, env) for a in x.args)
        if isinstance(x, Compare):
            if self._ready(x.left, env) and self._ready(x.right, env):
                return bool(env)
            return x.op == "=" and bool(env) and (self._ready(x.left, env) or self._ready(x.right, env)) and (isinstance(x.left, Var) or isinstance(x.right, Var))
        if isinstance(x, Test):
            return bool(env) and all(self._ready(a, env) for a in x.args)
        return isinstance(x, Aggregate) and bool(env)

    def _add(self, spark, df, env, x, known, swapped):
        if isinstance(x, Compare):
            for a, b in ((x.left, x.right), (x.right, x.left)):
                if x.op == "=" and isinstance(a, Var) and a.name not in env:
                    name = f"v_{a.name}"
                    return df.withColumn(name, self._value(b, env)), env | {a.name: name}
            a, b = self._value(x.left, env), self._value(x.right, env)
            ops = {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}
            return df.where(ops[x.op]), env
        if isinstance(x, Test):
            a, b = (self._value(t, env) for t in x.args)
            hit = b.rlike("^(?:" + x.args[0] + ")$") if x.name == "match" else F.contains(b, a)
            return df.where(~hit if x.negated else hit), env
        if isinstance(x, Aggregate):
            return self._aggregate(spark, df, env, x, known)
        if x.name in self._sets and not x.negated and x.args[0] != ANY and df is not None and self._ready(x.args[0], env):
            return df.where(self._value(x.args[0], env).isin(self._sets[x.name])), env
        if x.name not in known:
            raise RuleError(f"no relation {x.name}")
        rel = swapped if swapped is not None else known[x.name]
        if len(rel.columns) != len(x.args):
            raise RuleError(f"{x.name} has {len(rel.columns)} attributes, not {len(x.args)}")
        tag = f"t{len(env)}_{len(df.columns) if df is not None else 0}_"
        rel = rel.toDF(*[f"{tag}{i}" for i in range(len(x.args))])
        mine: dict[str, str] = {}
        on = []
        for i, a in enumerate(x.args):
            c = F.col(f"{tag}{i}")
            if a == ANY:
                continue
            if isinstance(a, Var) and a.name not in env:
                if a.name in mine:
                    rel = rel.where(c == F.col(mine[a.name]))
                else:
                    mine[a.name] = f"{tag}{i}"
            elif isinstance(a, Var) or isinstance(a, Call):
                on.append(self._value(a, env) == c)
            else:
                rel = rel.where(c == self._value(a, {}))
        if df is None:
            return rel.select(*[F.col(v).alias(f"v_{k}") for k, v in mine.items()] or [F.lit(1).alias("_one")]), {k: f"v_{k}" for k in mine}
        cond = None
        for c in on:
            cond = c if cond is None else cond & c
        if x.negated:
            if cond is None:
                return (df if rel.isEmpty() else df.limit(0)), env
            return df.join(rel, cond, "left_anti"), env
        out = df.join(rel, cond) if cond is not None else df.crossJoin(rel)
        keep = [F.col(c) for c in df.columns] + [F.col(v).alias(f"v_{k}") for k, v in mine.items()]
        return out.select(*keep), env | {k: f"v_{k}" for k in mine}

    def _aggregate(self, spark, df, env, x: Aggregate, known):
        # each _ is a variable of its own: what is aggregated are the tuples of the whole body
        body = [Atom(y.name, [Var(f"_{i}_{k}") if a == ANY else a for k, a in enumerate(y.args)]) if isinstance(y, Atom) and not y.negated else y for i, y in enumerate(x.body)]
        inner, inner_env = self._body(spark, body, known, {})
        inner = inner.distinct()
        shared = [v for v in inner_env if v in env]
        keyed = inner.select(*[F.col(inner_env[v]).alias(f"k_{v}") for v in shared], *[F.col(c).alias(f"i_{c}") for c in inner.columns])
        value = None if x.of is None else self._value(x.of, {k: f"i_{v}" for k, v in inner_env.items()})
        fn = {"count": F.count("*"), "sum": F.sum(value) if value is not None else None, "min": F.min(value) if value is not None else None, "max": F.max(value) if value is not None else None}[x.op]
        got = keyed.groupBy(*[f"k_{v}" for v in shared]).agg(fn.cast("long").alias("_n"))
        cond = None
        for v in shared:
            c = F.col(env[v]) == F.col(f"k_{v}")
            cond = c if cond is None else cond & c
        out = df.join(got, cond, "left") if cond is not None else df.crossJoin(got)
        n = F.coalesce("_n", F.lit(0)) if x.op in ("count", "sum") else F.col("_n")
        name = f"v_{x.var}"
        if x.var in env:
            return out.where(F.col(env[x.var]) == n).select(df.columns), env
        out = out.select(*df.columns, n.cast("long").alias(name))
        return (out if x.op in ("count", "sum") else out.where(F.col(name).isNotNull())), env | {x.var: name}
