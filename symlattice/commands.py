"""The commands: `python -m symlattice.commands SNAPSHOT COMMAND [ARGUMENT ...]` over a snapshot folder.

Each command gives a DataFrame, a row or a number; writing ones store the changed tables in the
snapshot's next version, SNAPSHOT/<number>, and the highest number is read.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.operators.entity import EntityGraph
from symlattice.operators.graph import Graph
from symlattice.operators.model import CodeBase
from symlattice.plans.pattern import Engine
from symlattice.sources import facts
from symlattice.sources.facts import Catalog
from symlattice.sources.store import Store

COMMANDS: dict[str, Callable] = {}
WRITES: set[str] = set()


def command(name: str, writes: bool = False):
    def add(f):
        COMMANDS[name] = f
        if writes:
            WRITES.add(name)
        return f

    return add


def _one(store: Store, name: str) -> int:
    """The symbol that a name, usr or number stands for: the best match."""
    g = Graph(store.c)
    row = (g.get(int(name)) if name.isdigit() else g.get(name)).first() or g.find(name, limit=1).first()
    if row is None:
        raise SystemExit(f"no symbol: {name}")
    return row["id"]


def _named(g: Graph, df: DataFrame, column: str = "peer") -> DataFrame:
    names = g.symbols().select(F.col("id").alias(column), "name", "kind_name", "path", "line")
    return df.join(names, column).orderBy("name", column)


# --- browsing

command("search")(lambda s, text, kind=None: s.search_symbols(text, kind))
command("list-components")(lambda s, name=None, kind=None: s.list_components(name, kind))
command("list-dirs")(lambda s, component=None, name=None: s.list_directories(None if component is None else s.get_component_by_name(component)["id"], name))
command("list-files")(lambda s, name=None: s.list_files(name=name))
command("list-symbols")(lambda s, name=None, kind=None: s.list_symbols(name=name, kind=kind))
command("show-symbol")(lambda s, name: Graph(s.c).get(_one(s, name)))
command("component-show")(lambda s, name: s.get_component_by_name(name))
command("repo-list")(lambda s, name=None: s.list_repositories(name))
command("repo-show")(lambda s, name: s.list_clones(s.get_repository_by_name(name)["id"]))
command("label-list")(lambda s: s.list_labels())
command("label-resolve")(lambda s, name: s.get_alias(name))
command("stats")(lambda s: s.stats())
command("query")(lambda s, text: Engine(Graph(s.c)).run(text))


@command("show-file")
def show_file(s: Store, path: str) -> DataFrame:
    """The symbols of a file, in order."""
    f = s.get_file(path)
    if f is None:
        raise SystemExit(f"no file: {path}")
    return s.symbols_in_file(f["id"])


@command("dump-compile-commands")
def dump_compile_commands(s: Store) -> DataFrame:
    """(directory, file, options) of every file that has options."""
    f = s.files().where("compile_options is not null")
    return f.select(F.regexp_extract("abs_path", "^(.*)/[^/]*$", 1).alias("directory"), F.col("abs_path").alias("file"), F.from_json("compile_options", "array<string>").alias("options"))


@command("verify")
def verify(s: Store) -> DataFrame:
    """(table, problem, n): rows that point to nothing, and keys that are there twice; empty if all is well."""
    c, out = s.c, []

    def dangling(table: str, column: str, target: str) -> None:
        lost = c[table].where(F.col(column).isNotNull()).join(c[target].select(F.col("id").alias(column)), column, "left_anti")
        out.append(lost.agg(F.lit(table).alias("table"), F.lit(f"{column} is no {target}").alias("problem"), F.count("*").alias("n")))

    for table, column, target in (
        ("directory", "component_id", "component"), ("file", "directory_id", "directory"), ("symbol", "file_id", "file"), ("edge", "src_id", "symbol"), ("edge", "dst_id", "symbol"),
        ("edge_site", "edge_id", "edge"), ("call_arg", "edge_id", "edge"), ("definition", "symbol_id", "symbol"), ("def_edge", "src_def_id", "definition"), ("template_arg", "owner_id", "symbol"),
        ("entity_edge", "src_id", "symbol"), ("entity_edge", "dst_id", "symbol"), ("clone", "repository_id", "repository"),
    ):
        dangling(table, column, target)
    twice = c["symbol"].groupBy("usr").count().where("count > 1")
    out.append(twice.agg(F.lit("symbol").alias("table"), F.lit("usr is there twice").alias("problem"), F.count("*").alias("n")))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_.where("n > 0")


# --- graph


def _hop(of: Callable[[Graph, int], DataFrame]):
    def run(s: Store, name: str) -> DataFrame:
        g = Graph(s.c)
        return _named(g, of(g, _one(s, name)))

    return run


command("callers")(_hop(lambda g, i: g.callers(i)))
command("callees")(_hop(lambda g, i: g.callees(i)))
command("refs")(_hop(lambda g, i: g.references(i, limit=None)))
command("dispatch")(_hop(lambda g, i: g.dispatch_targets(i).withColumnRenamed("target", "peer")))
command("redefined")(lambda s: Graph(s.c).redefined())
command("definitions")(lambda s, name: Graph(s.c).definitions(_one(s, name)))


@command("neighbors")
def neighbors(s: Store, name: str, kinds: str | None = None, direction: str = "out") -> DataFrame:
    g = Graph(s.c)
    return _named(g, g.neighbors(_one(s, name), kinds.split(",") if kinds else None, direction, limit=None))


@command("walk")
def walk(s: Store, name: str, kinds: str = "calls", direction: str = "out", depth: str = "3") -> DataFrame:
    g = Graph(s.c)
    return _named(g, g.walk(_one(s, name), kinds.split(","), direction, int(depth)), "node").orderBy("depth", "name")


@command("path")
def path(s: Store, start: str, end: str, kinds: str = "calls", depth: str = "8") -> list[int] | None:
    return Graph(s.c).reaches(_one(s, start), _one(s, end), kinds.split(","), max_depth=int(depth))


@command("hierarchy")
def hierarchy(s: Store, name: str, direction: str = "up") -> DataFrame:
    """All bases, or all subclasses, of a record."""
    g = Graph(s.c)
    i = _one(s, name)
    return _named(g, g.bases(i, direct=False) if direction == "up" else g.subclasses(i, direct=False))


@command("callgraph")
def callgraph(s: Store, name: str, depth: str | None = None) -> DataFrame:
    return _named(Graph(s.c), CodeBase(Graph(s.c)).callgraph(_one(s, name), None if depth is None else int(depth)), "node").orderBy("depth", "name")


@command("classes")
def classes(s: Store, name: str) -> DataFrame:
    """The design edges at an entity."""
    e = EntityGraph(Graph(s.c))
    i = _one(s, name)
    return e.edges(src=i).unionByName(e.edges(dst=i))


# --- writing

command("init", True)(lambda s: None)
command("resolve", True)(lambda s: s.resolve_pass())
command("delete-component", True)(lambda s, name: s.delete_component(s.get_component_by_name(name)["id"]))
command("delete-dir", True)(lambda s, component, path: s.delete_directory(s.get_directory(s.get_component_by_name(component)["id"], path)["id"]))
command("delete-file", True)(lambda s, path: s.delete_file(s.get_file(path)["id"]))
command("delete-symbol", True)(lambda s, name: s.delete_symbol(_one(s, name)))
command("component-set-version", True)(lambda s, name, version=None: s.set_component_version(name, version))
command("repo-add-clone", True)(lambda s, name, path, label=None: s.add_clone(s.add_repository(name), path, label))
command("repo-switch", True)(lambda s, name, path: s.set_active_clone(s.get_repository_by_name(name)["id"], s.get_clone_by_path(path)["id"]))
command("repo-rm", True)(lambda s, name: s.delete_repository(s.get_repository_by_name(name)["id"]))
command("label-add", True)(lambda s, name, path: s.add_label(name, path))
command("label-rm", True)(lambda s, name: s.remove_label(name))
command("set", True)(lambda s, key, value: s.set_meta(key, value))
command("add-source", True)(lambda s, name, path, kind="repo", version=None: s.add_component(name, path, kind, version))


@command("file", True)
def file_options(s: Store, path: str, *options: str) -> bool:
    """Sets a file's compile options."""
    return s.set_file_compile_options(s.get_file(path)["id"], list(options))


@command("import", True)
def import_commands(s: Store, database: str) -> int:
    """Files and options of a compilation database; files outside all components are left out."""
    held = facts.compile_commands(s.spark, database)
    full = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    rows = facts.component_of_path(held.withColumn("path", full), s.c["component"]).where("component_id is not null")
    n = 0
    with s.transaction():
        for r in rows.select("path", "options").dropDuplicates(["path"]).orderBy("path").toLocalIterator():
            s.set_file_compile_options(s.add_file_path(r["path"]), r["options"])
            n += 1
    return n


@command("realias", True)
def realias(s: Store, old: str, new: str) -> int:
    """Compile options that mention one path prefix mention another instead; how many files changed."""
    f = s.c["file"]
    hit = F.contains(F.coalesce("compile_options", F.lit("")), F.lit(old))
    n = f.where(hit).count()
    s._replace(file=f.withColumn("compile_options", F.when(hit, F.replace("compile_options", F.lit(old), F.lit(new))).otherwise(F.col("compile_options"))))
    return n


# --- snapshots


def _versions(spark: SparkSession, path: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()) if fs.exists(p) else []


def load(spark: SparkSession, path: str) -> Store:
    """The newest version of a snapshot folder, or an empty store."""
    have = _versions(spark, path)
    return Store(Catalog.read(spark, f"{path}/{have[-1]}") if have else Catalog(spark))


def run(spark: SparkSession, path: str, name: str, *args: str):
    """Runs a command; a writing one stores the next version."""
    if name not in COMMANDS:
        raise SystemExit(f"unknown command {name}; one of {', '.join(sorted(COMMANDS))}")
    store = load(spark, path)
    out = COMMANDS[name](store, *args)
    if name in WRITES:
        store.c.write(f"{path}/{(_versions(spark, path) or [0])[-1] + 1}")
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="symlattice", description=__doc__)
    p.add_argument("snapshot")
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("arguments", nargs="*")
    p.add_argument("--limit", type=int, default=50, help="rows shown; 0: all")
    p.add_argument("--count", action="store_true", help="only how many rows there are")
    p.add_argument("--pretty", action="store_true", help="indented JSON")
    a = p.parse_args(argv)
    out = run(SparkSession.builder.getOrCreate(), a.snapshot, a.command, *a.arguments)
    if isinstance(out, DataFrame):
        if a.count:
            print(out.count())
            return
        for r in out.toLocalIterator() if not a.limit else out.take(a.limit):
            print(json.dumps(r.asDict(recursive=True), default=str, indent=2 if a.pretty else None))
    elif out is not None:
        print(json.dumps(out.asDict() if hasattr(out, "asDict") else out, default=str, indent=2 if a.pretty else None))


if __name__ == "__main__":
    main(sys.argv[1:])
