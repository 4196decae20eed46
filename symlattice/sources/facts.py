"""A catalog of fact tables: read from and written to Parquet snapshots, with keyed writes."""

from __future__ import annotations

import shlex
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symlattice.schemas import TABLES


@lru_cache(maxsize=None)
def columns_of(name: str) -> StructType:
    """A fact table's columns."""
    return StructType.fromDDL(TABLES[name])


class Catalog:
    """The fact tables by name, as DataFrames; a table that was not given is empty. A table may be given
    as a function without arguments: it is called when the table is first asked for."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self.spark, self._tables, self._later = spark, {}, {}
        for name, df in (tables or {}).items():
            if callable(df):
                self._later[name] = df
            else:
                self[name] = df

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._later:
            self[name] = self._later[name]()
        if name not in self._tables:
            self._tables[name] = self.spark.createDataFrame([], columns_of(name))
        return self._tables[name]

    def __setitem__(self, name: str, df: DataFrame) -> None:
        """Missing columns are null; others are dropped and all are cast to the table's types."""
        have = set(df.columns)
        self._later.pop(name, None)
        self._tables[name] = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns_of(name)])

    def names(self) -> list[str]:
        return sorted({*self._tables, *self._later})

    def made(self) -> list[str]:
        """The tables that have been asked for or set."""
        return sorted(self._tables)

    def replaced(self, **tables: DataFrame) -> Catalog:
        out = Catalog(self.spark)
        out._tables, out._later = dict(self._tables), dict(self._later)
        for k, v in tables.items():
            out[k] = v
        return out

    def later(self, name: str, table: Callable[[], DataFrame]) -> Catalog:
        """This catalog with a table that is made when it is first asked for."""
        out = self.replaced()
        out._tables.pop(name, None)
        out._later[name] = table
        return out

    @classmethod
    def read(cls, spark: SparkSession, path: str, names: list[str] | None = None) -> Catalog:
        """Tables of a snapshot folder, a Parquet table each; edges come by kind if they were written so."""
        out = cls(spark)
        for name in names or [k for k in TABLES]:
            try:
                out[name] = spark.read.parquet(f"{path}/{name}")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return out

    def write(self, path: str) -> None:
        """A new snapshot; edges lie in a folder for each kind, so that one kind's readers skip the others."""
        for name in self.names():
            writer = self[name].write.mode("overwrite")
            (writer.partitionBy("kind") if name in ("edge", "entity_edge") else writer).parquet(f"{path}/{name}")

    def sql(self, text: str) -> DataFrame:
        """A read-only query in which {name} stands for a fact table."""
        return self.spark.sql(text, **{k: self[k] for k in TABLES if "{" + k + "}" in text})


def upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Rows of old and new with one row for each key: the one that came last by seq (old rows come before)."""
    both = old.withColumn("_s", F.lit(-1).cast("long")).unionByName(new.withColumn("_s", F.col(seq).cast("long")).drop(seq), allowMissingColumns=True)
    rest = [c for c in old.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), "_s").alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest]).select(old.columns)


def merge_symbols(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Symbols by usr after the rows of new arrived in order of seq.

    The place comes from the newest row that is no less a definition than any before; names, type and
    declaration are the newest that are not null; spelling and kind are the newest; flags are the
    largest. Stored decl_path and is_named_instance stay. Ids stay; new symbols get ids above all old ones.
    """
    place = ["file_id", "line", "col", "end_line", "end_col"]
    newest = ["qual_name", "display_name", "type_info", "decl_file_id", "decl_line", "linkage", "access", "parent_usr"]
    flags = ["is_definition", "is_pure", "is_static", "is_instantiation", "resolved"]
    both = old.withColumn("_s", F.lit(-1).cast("long")).unionByName(new.withColumn("_s", F.col(seq).cast("long")).drop(seq), allowMissingColumns=True)
    order = F.struct(F.coalesce("is_definition", F.lit(0)), F.col("_s"))
    aggs: list[Column] = [F.max_by(F.struct(*place), order).alias("_place"), F.max("id").alias("id"), F.min("_s").alias("_first")]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_s"))).alias(c) for c in newest]
    aggs += [F.max_by(c, "_s").alias(c) for c in ("spelling", "kind")] + [F.max(c).alias(c) for c in flags]
    aggs += [F.min_by(c, "_s").alias(c) for c in ("decl_path", "is_named_instance", "multi_def")]
    got = both.groupBy("usr").agg(*aggs).select("*", *[F.col("_place")[c].alias(c) for c in place])
    base = old.agg(F.max("id")).first()[0] or 0
    fresh = got.where("id is null").select("usr", (F.lit(base) + 1 + F.monotonically_increasing_id()).alias("_id"))
    return got.join(fresh, "usr", "left").withColumn("id", F.coalesce("id", "_id")).select(old.columns)


def replace_file(table: DataFrame, rows: DataFrame, files: DataFrame, column: str = "file_id") -> DataFrame:
    """table without the rows of the given files, and with the new rows of them."""
    return table.join(files.select(F.col("id").alias(column)).distinct(), column, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


#: What hangs on a symbol, by the columns that name it: rows go with any of them.
OF_SYMBOL = {
    "edge": ("src_id", "dst_id"), "decl_site": ("symbol_id",), "template_param": ("owner_id",), "template_arg": ("owner_id",), "definition": ("symbol_id",),
    "def_edge": ("dst_id",), "entity_node": ("id",), "entity_edge": ("src_id", "dst_id"),
}
#: What hangs on a file besides its symbols.
OF_FILE = {"definition": "file_id", "decl_site": "file_id", "diagnostic": "file_id", "edge_site": "file_id", "call_arg": "file_id"}


def without(table: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """table without the rows whose column is among the ids gone; nulls stay."""
    return table.join(gone.select(F.col("id").alias(column)).distinct(), column, "left_anti").select(table.columns)


def delete_symbols(catalog: Catalog, symbols: DataFrame) -> Catalog:
    """The catalog without some symbols (column id) and all that hangs on them, over any number of steps.
    What only mentions one, a bound type or the member that an entity edge goes through, forgets it."""
    gone, new = symbols.select("id").distinct(), {"symbol": without(catalog["symbol"], "id", symbols)}
    for name, keys in OF_SYMBOL.items():
        table = catalog[name]
        for key in keys:
            table = without(table, key, gone)
        new[name] = table
    edges = new["edge"].select(F.col("id").alias("edge_id"))
    for name in ("edge_site", "call_arg"):
        new[name] = catalog[name].join(edges, "edge_id", "left_semi").select(catalog[name].columns)
    bodies = new["definition"].select("id")
    new["def_edge"] = new["def_edge"].join(bodies.withColumnRenamed("id", "src_def_id"), "src_def_id", "left_semi").select(catalog["def_edge"].columns)
    kept = catalog["possible_call"].join(bodies.withColumnRenamed("id", "src_def_id"), "src_def_id", "left_semi")
    new["possible_call"] = kept.join(bodies.withColumnRenamed("id", "dst_def_id"), "dst_def_id", "left_semi").select(catalog["possible_call"].columns)

    def forget(name: str, column: str) -> None:
        known = gone.select(F.col("id").alias(column), F.lit(True).alias("_gone"))
        t = new[name].join(known, column, "left")
        new[name] = t.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(catalog[name].columns)

    forget("template_arg", "ref_id")
    forget("entity_edge", "via_member_id")
    return catalog.replaced(**new)


def delete_files(catalog: Catalog, files: DataFrame) -> Catalog:
    """The catalog without some files (column id) and all that hangs on them: symbols with what hangs on
    those, definitions, places and diagnostics. A symbol only declared there forgets the place."""
    gone = files.select("id").distinct()
    c = catalog.replaced(file=without(catalog["file"], "id", gone), **{name: without(catalog[name], column, gone) for name, column in OF_FILE.items()})
    bodies = c["definition"].select(F.col("id").alias("src_def_id"))
    c = c.replaced(def_edge=c["def_edge"].join(bodies, "src_def_id", "left_semi"))
    declared = c["symbol"].join(gone.select(F.col("id").alias("decl_file_id"), F.lit(True).alias("_gone")), "decl_file_id", "left")
    c = c.replaced(symbol=declared.withColumn("decl_file_id", F.when(F.col("_gone").isNull(), F.col("decl_file_id"))))
    return delete_symbols(c, c["symbol"].join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_semi"))


def delete_directories(catalog: Catalog, directories: DataFrame) -> Catalog:
    """The catalog without some directories (column id), their files, and all that hangs on them."""
    files = catalog["file"].join(directories.select(F.col("id").alias("directory_id")).distinct(), "directory_id", "left_semi")
    return delete_files(catalog.replaced(directory=without(catalog["directory"], "id", directories)), files.select("id"))


def delete_components(catalog: Catalog, components: DataFrame) -> Catalog:
    """The catalog without some components (column id), their directories, and all that hangs on them."""
    held = catalog["directory"].join(components.select(F.col("id").alias("component_id")).distinct(), "component_id", "left_semi")
    return delete_directories(catalog.replaced(component=without(catalog["component"], "id", components)), held.select("id"))


LAUNCHERS = ("ccache", "sccache", "distcc", "icecc", "env", "nice", "time")


def command_options(words: list[str]) -> list[str]:
    """What follows the compiler in a command: environment assignments, launchers and their own options before it are passed over."""
    at = 0
    while at < len(words):
        w = words[at]
        name = w.rsplit("/", 1)[-1]
        if name in LAUNCHERS or ("=" in w and not w.startswith("-") and "/" not in w.split("=", 1)[0]) or (at and w.startswith("-") and words[at - 1].rsplit("/", 1)[-1] in LAUNCHERS):
            at += 1
            continue
        return words[at + 1 :]
    return []


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(directory, file, options) of a compilation database in JSON, one row for each command. A command is
    split as a shell would; unbalanced quotes leave it split at blanks. An `arguments` list is taken as it is."""
    raw = spark.read.option("multiLine", True).schema("directory string, file string, command string, arguments array<string>").json(path)

    @F.pandas_udf("array<string>")
    def options(commands: pd.Series, lists: pd.Series) -> pd.Series:
        def of(command, words):
            if words is None:
                try:
                    words = shlex.split(command or "")
                except ValueError:
                    words = (command or "").split()
            return command_options(list(words))

        return pd.Series([of(c, w) for c, w in zip(commands, lists, strict=True)])

    return raw.select("directory", "file", options("command", "arguments").alias("options"))


def component_of_path(paths: DataFrame, components: DataFrame, path_col: str = "path") -> DataFrame:
    """paths with component_id: the component with the longest path that is the path or a folder above it."""
    c = components.select(F.col("id").alias("component_id"), F.rtrim("path", F.lit("/")).alias("_root"))
    # every folder above a path is a key, so that this is an equi-join
    parts = F.split(F.col(path_col), "/")
    roots = paths.select(path_col).distinct().select(path_col, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_root"))
    best = roots.join(c, "_root").groupBy(path_col).agg(F.max_by("component_id", F.length("_root")).alias("component_id"))
    return paths.join(best, path_col, "left")


def candidate_aliases(catalog: Catalog) -> DataFrame:
    """(file_id, usr): aliases that nothing says what they stand for: without a use of another symbol."""
    s = catalog["symbol"].where("kind in (20, 36) and file_id is not null and usr <> ''")
    used = catalog["edge"].where("kind = 7").select(F.col("src_id").alias("id"))
    return s.join(used, "id", "left_anti").select("file_id", "usr")


def option_uniformity(files: DataFrame, column: str = "options") -> DataFrame:
    """(flag, files, share): how many of the files are compiled with each flag, rarest last."""
    total = files.count()
    each = files.select(F.explode(F.array_distinct(column)).alias("flag")).groupBy("flag").agg(F.count("*").alias("files"))
    return each.withColumn("share", F.col("files") / F.lit(max(total, 1))).orderBy(F.desc("files"), "flag")
