"""Keyed reads and writes over a catalog: components, repositories, clones, labels, folders, files, facts.

Dimension rows are single writes that answer with an id. Facts arrive as DataFrames and are merged by
their keys in one plan. Writes are held until commit(), which writes each changed table once to the
shared folder; within transaction() that happens at its end, and an error takes all of it back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, partial

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from symlattice.operators import resolve as R
from symlattice.operators.graph import Graph, fuzzy
from symlattice.schemas import SYMBOL_KIND, kind_ids
from symlattice.sources import facts
from symlattice.sources.facts import Catalog, columns_of
from symlattice.staging import cut

#: The columns that a row of a table is told by.
KEYS = {
    "component": ("path",), "repository": ("name",), "clone": ("path",), "label": ("name",), "directory": ("component_id", "path"), "file": ("directory_id", "name"), "meta": ("key",),
    "edge": ("src_id", "dst_id", "kind"), "edge_site": ("edge_id", "file_id", "line", "col"), "call_arg": ("edge_id", "file_id", "line", "col", "position"),
    "template_param": ("owner_id", "position"), "template_arg": ("owner_id", "position"), "definition": ("symbol_id", "component_id"), "def_edge": ("src_def_id", "dst_id", "kind"),
    "entity_edge": ("src_id", "dst_id", "kind", "via_member_id", "create_form"),
}


def below(path: Column, folder: str) -> Column:
    """Whether a path is a folder or lies in it."""
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


class Store:
    def __init__(self, catalog: Catalog):
        self.c, self.spark, self._changed, self._depth = catalog, catalog.spark, set(), 0

    # --- writing

    @contextmanager
    def transaction(self) -> Iterator[Store]:
        """Many writes, stored together; an error undoes them all."""
        before, self._depth = (self.c, set(self._changed)), self._depth + 1
        try:
            yield self
        except BaseException:
            self.c, self._changed = before
            raise
        finally:
            self._depth -= 1
        self.commit()

    def commit(self) -> None:
        """Each changed table is written once, when it is next asked for."""
        if self._depth == 0 and self._changed:
            for name in sorted(self._changed):
                self.c = self.c.later(name, cache(partial(cut, self.c[name], name)))
            self._changed = set()

    def _replace(self, **tables: DataFrame) -> None:
        self.c = self.c.replaced(**tables)
        self._changed |= set(tables)
        self.commit()

    def _become(self, catalog: Catalog) -> None:
        self.c, self._changed = catalog, self._changed | set(catalog.made())
        self.commit()

    def _where(self, name: str, /, **equal) -> DataFrame:
        df = self.c[name]
        for k, v in equal.items():
            df = df.where(F.col(k).eqNullSafe(F.lit(v)))
        return df

    def _get(self, name: str, /, **equal) -> Row | None:
        t = self._where(name, **equal)
        return (t.orderBy("id") if "id" in t.columns else t).first()

    def _put(self, name: str, key: dict, values: dict, update: bool = True) -> int | None:
        """The id of the row with this key, which is made if it is not there; values that are not None are set."""
        have, values = self._get(name, **key), {k: v for k, v in values.items() if v is not None}
        if have is not None:
            if update and values:
                self._set(name, key, **values)
            return have["id"] if "id" in have else None
        ident = None
        if "id" in self.c[name].columns:
            ident = (self.c[name].agg(F.max("id")).first()[0] or 0) + 1
        schema = columns_of(name)
        row = self.spark.createDataFrame([tuple(({"id": ident} | key | values).get(c) for c in schema.names)], schema)
        self._replace(**{name: self.c[name].unionByName(row)})
        return ident

    def _set(self, name: str, key: dict, /, **values) -> bool:
        if self._where(name, **key).isEmpty():
            return False
        hit = F.lit(True)
        for k, v in key.items():
            hit = hit & F.col(k).eqNullSafe(F.lit(v))
        types = {f.name: f.dataType for f in columns_of(name)}
        self._replace(**{name: self.c[name].withColumns({k: F.when(hit, F.lit(v).cast(types[k])).otherwise(F.col(k)) for k, v in values.items()})})
        return True

    def _drop(self, name: str, /, **equal) -> bool:
        if self._where(name, **equal).isEmpty():
            return False
        hit = F.lit(True)
        for k, v in equal.items():
            hit = hit & F.col(k).eqNullSafe(F.lit(v))
        self._replace(**{name: self.c[name].where(~hit)})
        return True

    def merge(self, name: str, rows: DataFrame, add: str | None = None) -> None:
        """Rows of a fact table, told by its key: new ones are added, and of those that are there the new
        values that are not null stand; the column `add` adds up instead. Of several new rows with a key the greatest stands."""
        key, old = KEYS[name], self.c[name]
        new = Catalog(self.spark, {name: rows})[name]
        rest = [c for c in old.columns if c not in key and c != "id"]
        both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
        order = F.struct("_s", *rest)
        aggs = [F.sum(c).alias(c) if c == add else F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest]
        if "id" in old.columns:
            aggs.append(F.max(F.when(F.col("_s") == 0, F.col("id"))).alias("id"))
        got = both.groupBy(*key).agg(*aggs)
        if "id" in old.columns:
            got = got.withColumn("id", F.coalesce("id", F.xxhash64(F.lit(name), *key)))
        self._replace(**{name: got.select(old.columns)})

    def ignore(self, name: str, rows: DataFrame) -> None:
        """Rows of a fact table whose key is not there yet."""
        key = list(KEYS[name])
        new = Catalog(self.spark, {name: rows})[name].dropDuplicates(key)
        have = self.c[name].select(*[F.col(k).alias(f"_{k}") for k in key])
        on = [new[k].eqNullSafe(have[f"_{k}"]) for k in key]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        self._replace(**{name: self.c[name].unionByName(new.join(have, cond, "left_anti"))})

    # --- components

    def add_component(self, name: str, path: str, kind: str = "repo", version: str | None = None, repository_id: int | None = None) -> int:
        """The id of the component at a path within its repository; one that is there keeps its row."""
        return self._put("component", {"path": path, "repository_id": repository_id}, {"name": name, "kind": kind, "version": version}, update=False)

    def update_component(self, component_id: int, **values) -> bool:
        return self._set("component", {"id": component_id}, **values)

    def update_component_meta(self, component_id: int, name: str, kind: str, version: str | None = None) -> bool:
        return self.update_component(component_id, name=name, kind=kind, **({} if version is None else {"version": version}))

    def set_component_version(self, name: str, version: str | None) -> bool:
        return self._set("component", {"name": name}, version=version)

    def set_component_effective_version(self, name: str, version: str) -> bool:
        """Sets the version wherever it stands: as the last part of the path, if that is one, else in its column."""
        c = self._get("component", name=name)
        if c is None:
            return False
        head, _, last = c["path"].rpartition("/")
        if c["version"] is None and last[:1].isdigit():
            return self._set("component", {"id": c["id"]}, path=f"{head}/{version}")
        return self._set("component", {"id": c["id"]}, version=version)

    def set_component_repository(self, component_id: int, repository_id: int | None) -> bool:
        return self._set("component", {"id": component_id}, repository_id=repository_id)

    def get_component(self, path: str) -> Row | None:
        return self._get("component", path=path.rstrip("/"))

    def get_component_by_name(self, name: str) -> Row | None:
        return self._get("component", name=name)

    def get_component_by_id(self, component_id: int) -> Row | None:
        return self._get("component", id=component_id)

    def effective_root(self, component: Row) -> str:
        return "/".join(x for x in (component["path"], component["version"]) if x)

    def active_clone_root(self, repository_id: int | None) -> str | None:
        r = None if repository_id is None else self.get_repository_by_id(repository_id)
        clone = None if r is None or r["active_clone_id"] is None else self.get_clone_by_id(r["active_clone_id"])
        return None if clone is None else clone["path"]

    def component_abs_base(self, component: Row) -> str:
        """Where a component's files are: below its repository's live clone if its path is relative."""
        root, base = self.effective_root(component), self.active_clone_root(component["repository_id"])
        return root if root.startswith("/") or base is None else f"{base.rstrip('/')}/{root}".rstrip("/")

    def relativize_component(self, component_id: int, clone_root: str) -> bool:
        c, root = self.get_component_by_id(component_id), clone_root.rstrip("/")
        if c is None or not (c["path"] == root or c["path"].startswith(root + "/")):
            return False
        return self._set("component", {"id": component_id}, path=c["path"][len(root) + 1 :])

    def component_for_path(self, path: str) -> Row | None:
        """The component with the longest path that is the path or a folder above it."""
        held = facts.component_of_path(self.spark.createDataFrame([(path,)], "path string"), self.c["component"]).first()
        return None if held["component_id"] is None else self.get_component_by_id(held["component_id"])

    def list_components(self, name: str | None = None, kind: str | None = None) -> DataFrame:
        return self._fuzzily(self.c["component"], name=name, kind=kind).orderBy("name", "path")

    def components_for_repository(self, repository_id: int, name: str | None = None) -> DataFrame:
        return self._fuzzily(self._where("component", repository_id=repository_id), name=name).orderBy("name", "path")

    @staticmethod
    def _fuzzily(df: DataFrame, **patterns: str | None) -> DataFrame:
        for column, text in patterns.items():
            df = df if text is None else df.where(F.lower(column).like(fuzzy(text.lower())))
        return df

    def component_alias_index(self) -> DataFrame:
        """(name, base, version, bumpable): each component name with its newest version; it can be bumped if it has any."""
        number = F.transform(F.split("version", "[^0-9]+"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
        newest = self.c["component"].groupBy("name").agg(F.min("path").alias("base"), F.max_by("version", number).alias("version"))
        return newest.select("name", "base", "version", F.col("version").isNotNull().alias("bumpable"))

    def list_alias_pairs(self) -> DataFrame:
        """(name, match_path, versioned): labels and components under which include paths are stored, longest path first."""
        labels = self.c["label"].select("name", F.col("path").alias("match_path"), F.lit(False).alias("versioned"))
        own = self.component_alias_index().select("name", F.col("base").alias("match_path"), F.col("bumpable").alias("versioned"))
        return labels.unionByName(own).orderBy(F.desc(F.length("match_path")), "name")

    def get_alias(self, name: str) -> str | None:
        """The path of a label, else that of the one component of the name."""
        label = self.get_label(name)
        held = self._where("component", name=name).select("path").distinct().take(2)
        return label if label is not None else held[0]["path"] if len(held) == 1 else None

    def delete_component(self, component_id: int) -> None:
        self._become(facts.delete_components(self.c, self.spark.createDataFrame([(component_id,)], "id long")))

    # --- labels and settings

    def add_label(self, name: str, path: str) -> None:
        self._put("label", {"name": name}, {"path": path})

    def remove_label(self, name: str) -> bool:
        return self._drop("label", name=name)

    def get_label(self, name: str) -> str | None:
        row = self._where("label", name=name).first()
        return None if row is None else row["path"]

    def list_labels(self) -> DataFrame:
        return self.c["label"].orderBy("name")

    def set_meta(self, key: str, value: str) -> None:
        self._put("meta", {"key": key}, {"value": value})

    # --- repositories and clones

    def add_repository(self, name: str, kind: str = "repo", remote_url: str | None = None) -> int:
        return self._put("repository", {"name": name}, {"kind": kind, "remote_url": remote_url}, update=False)

    def update_repository(self, repository_id: int, **values) -> bool:
        return self._set("repository", {"id": repository_id}, **values)

    def get_repository_by_name(self, name: str) -> Row | None:
        return self._get("repository", name=name)

    def get_repository_by_id(self, repository_id: int) -> Row | None:
        return self._get("repository", id=repository_id)

    def get_repository_by_remote(self, remote_url: str) -> Row | None:
        return self._get("repository", remote_url=remote_url)

    def list_repositories(self, name: str | None = None, kind: str | None = None) -> DataFrame:
        return self._fuzzily(self.c["repository"], name=name, kind=kind).orderBy("name")

    def set_active_clone(self, repository_id: int, clone_id: int | None) -> bool:
        return self._set("repository", {"id": repository_id}, active_clone_id=clone_id)

    def delete_repository(self, repository_id: int) -> None:
        """With its clones; its components stay, on their own."""
        with self.transaction():
            self._drop("clone", repository_id=repository_id)
            self._set("component", {"repository_id": repository_id}, repository_id=None)
            self._drop("repository", id=repository_id)

    def add_clone(self, repository_id: int, path: str, label: str | None = None) -> int:
        return self._put("clone", {"path": path.rstrip("/")}, {"repository_id": repository_id, "label": label}, update=False)

    def get_clone_by_id(self, clone_id: int) -> Row | None:
        return self._get("clone", id=clone_id)

    def get_clone_by_path(self, path: str) -> Row | None:
        return self._get("clone", path=path.rstrip("/"))

    def list_clones(self, repository_id: int | None = None) -> DataFrame:
        return (self.c["clone"] if repository_id is None else self._where("clone", repository_id=repository_id)).orderBy("id")

    def delete_clone(self, clone_id: int) -> None:
        with self.transaction():
            self._set("repository", {"active_clone_id": clone_id}, active_clone_id=None)
            self._drop("clone", id=clone_id)

    # --- folders and files

    def add_directory(self, component_id: int, path: str) -> int:
        return self._put("directory", {"component_id": component_id, "path": path.strip("/")}, {})

    def get_directory(self, component_id: int, path: str) -> Row | None:
        return self._get("directory", component_id=component_id, path=path.strip("/"))

    def get_directory_by_id(self, directory_id: int) -> Row | None:
        return self._get("directory", id=directory_id)

    def list_directories(self, component_id: int | None = None, name: str | None = None) -> DataFrame:
        """Folders with their component's name."""
        d = self.c["directory"] if component_id is None else self._where("directory", component_id=component_id)
        own = self.c["component"].select(F.col("id").alias("component_id"), F.col("name").alias("component"))
        return self._fuzzily(d, path=name).join(own, "component_id").orderBy("component", "path")

    def delete_directory(self, directory_id: int) -> None:
        self._become(facts.delete_directories(self.c, self.spark.createDataFrame([(directory_id,)], "id long")))

    def directory_abs_path(self, directory_id: int) -> str | None:
        d = self.get_directory_by_id(directory_id)
        c = None if d is None else self.get_component_by_id(d["component_id"])
        return None if c is None else "/".join(x for x in (self.component_abs_base(c), d["path"]) if x)

    def split_path(self, path: str) -> tuple[int, str, str]:
        """(component, folder below it, file name) of an absolute path."""
        c = self.component_for_path(path)
        if c is None:
            raise ValueError(f"no component holds {path}")
        inner = path[len(self.component_abs_base(c)) :].strip("/")
        folder, _, name = inner.rpartition("/")
        return c["id"], folder, name

    def add_file(self, directory_id: int, name: str, mtime: float | None = None, md5: str | None = None, compile_options: list[str] | None = None) -> int:
        options = None if compile_options is None else json.dumps(compile_options)
        return self._put("file", {"directory_id": directory_id, "name": name}, {"mtime": mtime, "md5": md5, "compile_options": options})

    def add_file_path(self, path: str, mtime: float | None = None, md5: str | None = None) -> int:
        component_id, folder, name = self.split_path(path)
        with self.transaction():
            return self.add_file(self.add_directory(component_id, folder), name, mtime, md5)

    def get_file(self, path: str) -> Row | None:
        component_id, folder, name = self.split_path(path)
        d = self.get_directory(component_id, folder)
        return None if d is None else self._get("file", directory_id=d["id"], name=name)

    def get_file_by_id(self, file_id: int) -> Row | None:
        return self._get("file", id=file_id)

    def file_abs_path(self, file_id: int) -> str | None:
        f = self.get_file_by_id(file_id)
        folder = None if f is None else self.directory_abs_path(f["directory_id"])
        return None if folder is None else f"{folder}/{f['name']}"

    def files(self) -> DataFrame:
        """Files with their absolute paths, in order of those."""
        paths = Graph(self.c).files().select(F.col("file_id").alias("id"), F.col("path").alias("abs_path"))
        return self.c["file"].join(paths, "id").orderBy("abs_path")

    def list_files(self, component_id: int | None = None, dir_path: str | None = None, name: str | None = None, indexed: bool | None = None) -> DataFrame:
        """files(), of a component, below a folder, by name, or indexed or not."""
        d = self.c["directory"] if component_id is None else self._where("directory", component_id=component_id)
        d = d if dir_path is None else d.where(below(F.col("path"), dir_path))
        f = self.files().join(d.select(F.col("id").alias("directory_id")), "directory_id", "left_semi")
        f = f if indexed is None else f.where((F.coalesce("indexed", F.lit(0)) == 1) == indexed)
        return self._fuzzily(f, name=name).orderBy("abs_path")

    def files_in_directory(self, directory_id: int, name: str | None = None) -> DataFrame:
        return self._fuzzily(self._where("file", directory_id=directory_id), name=name).orderBy("name")

    def update_file(self, file_id: int, **values) -> bool:
        return self._set("file", {"id": file_id}, **values)

    def set_file_indexed(self, file_id: int, indexed: bool) -> bool:
        return self.update_file(file_id, indexed=int(indexed))

    def mark_file_indexed(self, file_id: int, mtime: float | None = None) -> bool:
        return self.update_file(file_id, indexed=1, **({} if mtime is None else {"mtime": mtime}))

    def is_file_indexed(self, path: str, mtime: float | None = None, md5: str | None = None) -> bool:
        """Whether a file is indexed, and not in another state than the one given."""
        f = self.get_file(path)
        return f is not None and f["indexed"] == 1 and (mtime is None or f["mtime"] == mtime) and (md5 is None or f["md5"] == md5)

    def set_file_compile_options(self, file_id: int, options: list[str]) -> bool:
        return self.update_file(file_id, compile_options=json.dumps(options))

    def delete_file(self, file_id: int) -> None:
        self._become(facts.delete_files(self.c, self.spark.createDataFrame([(file_id,)], "id long")))

    def replace_diagnostics(self, file_id: int, rows: DataFrame) -> None:
        new = Catalog(self.spark, {"diagnostic": rows.withColumn("file_id", F.lit(file_id).cast("long"))})["diagnostic"]
        self._replace(diagnostic=self.c["diagnostic"].where(~F.col("file_id").eqNullSafe(F.lit(file_id))).unionByName(new))

    def get_diagnostics(self, file_id: int) -> DataFrame:
        return self._where("diagnostic", file_id=file_id).orderBy("id")

    def diagnostic_counts(self) -> DataFrame:
        return self.c["diagnostic"].groupBy("file_id", "severity").agg(F.count("*").alias("n"))

    def component_id_for_file(self, file_id: int) -> int | None:
        row = R.file_components(self.c).where(F.col("file_id") == file_id).first()
        return None if row is None else row["component_id"]

    # --- symbols

    def add_symbols(self, rows: DataFrame, seq: str = "seq") -> None:
        """Symbols by usr, as facts.merge_symbols() merges them."""
        self._replace(symbol=facts.merge_symbols(self.c["symbol"], rows, seq))

    def mint_symbols(self, rows: DataFrame) -> DataFrame:
        """(usr, id): symbols that are not there become stubs."""
        stub = Catalog(self.spark, {"symbol": rows.dropDuplicates(["usr"])})["symbol"].join(self.c["symbol"].select("usr"), "usr", "left_anti")
        top = self.c["symbol"].agg(F.max("id")).first()[0] or 0
        stub = stub.withColumns({"id": F.lit(top) + 1 + F.monotonically_increasing_id(), "resolved": F.coalesce("resolved", F.lit(0))})
        self._replace(symbol=self.c["symbol"].unionByName(stub.select(self.c["symbol"].columns)))
        self.c["symbol"] = cut(self.c["symbol"], "symbol")  # the new ids are drawn once
        return self.c["symbol"].join(rows.select("usr").distinct(), "usr", "left_semi").select("usr", "id")

    def update_symbol(self, usr: str, **values) -> bool:
        return self._set("symbol", {"usr": usr}, **values)

    def lookup_symbol(self, usr: str) -> Row | None:
        return self._get("symbol", usr=usr)

    def lookup_symbol_by_id(self, symbol_id: int) -> Row | None:
        return self._get("symbol", id=symbol_id)

    def _kind(self, df: DataFrame, kind: str | None) -> DataFrame:
        return df if kind is None else df.where(F.col("kind").isin(kind_ids([kind], SYMBOL_KIND)))

    def lookup_symbols_by_name(self, spelling: str, kind: str | None = None) -> DataFrame:
        return self._kind(self._where("symbol", spelling=spelling), kind).orderBy("usr")

    def lookup_symbols_by_qual_name(self, qual_name: str, kind: str | None = None) -> DataFrame:
        return self._kind(self._where("symbol", qual_name=qual_name), kind).orderBy("usr")

    def search_symbols(self, pattern: str, kind: str | None = None) -> DataFrame:
        s = self._kind(self.c["symbol"], kind).withColumn("_n", F.coalesce("qual_name", "spelling"))
        return s.where(F.lower("_n").like(fuzzy(pattern.lower()))).orderBy(F.length("_n"), "_n", "id").drop("_n")

    def list_symbols(self, component_id: int | None = None, dir_path: str | None = None, file_id: int | None = None, name: str | None = None, kind: str | None = None) -> DataFrame:
        """Symbols of a component, folder or file, and by name."""
        s = self._kind(self.c["symbol"], kind)
        if component_id is not None or dir_path is not None:
            s = s.join(self.list_files(component_id, dir_path).select(F.col("id").alias("file_id")), "file_id", "left_semi")
        s = s if file_id is None else s.where(F.col("file_id") == file_id)
        return self._fuzzily(s, qual_name=name).orderBy("file_id", "line", "col", "id")

    def symbols_in_file(self, file_id: int) -> DataFrame:
        return self._where("symbol", file_id=file_id).orderBy("line", "col", "id")

    def unresolved_symbols(self) -> DataFrame:
        return self.c["symbol"].where("coalesce(resolved, 0) = 0").orderBy("id")

    def delete_symbol(self, symbol_id: int) -> None:
        self._become(facts.delete_symbols(self.c, self.spark.createDataFrame([(symbol_id,)], "id long")))

    # --- edges and what hangs on them

    def add_edges(self, rows: DataFrame) -> None:
        """Edges by ends and kind; counts add up."""
        self.merge("edge", rows, add="count")

    def add_edge_sites(self, rows: DataFrame) -> None:
        self.ignore("edge_site", rows)

    def add_call_args(self, rows: DataFrame) -> None:
        self.ignore("call_arg", rows)

    def add_template_params(self, rows: DataFrame) -> None:
        self.merge("template_param", rows)

    def add_template_args(self, rows: DataFrame) -> None:
        self.merge("template_arg", rows)

    def add_entity_edges(self, rows: DataFrame) -> None:
        self.merge("entity_edge", rows)

    def clear_entity_edges(self) -> None:
        self._replace(entity_edge=self.c["entity_edge"].limit(0))

    def entity_edges(self, src_id: int | None = None, dst_id: int | None = None, kind: int | None = None) -> DataFrame:
        given = {"src_id": src_id, "dst_id": dst_id, "kind": kind}
        return self._where("entity_edge", **{k: v for k, v in given.items() if v is not None})

    def delete_edges_for_file(self, file_id: int) -> None:
        """Edges whose source was indexed from a file, with their sites and arguments."""
        own = self.c["symbol"].where(F.col("file_id") == file_id).select("id")
        edges = facts.without(self.c["edge"], "src_id", own)
        kept = edges.select(F.col("id").alias("edge_id"))
        self._replace(edge=edges, **{t: self.c[t].join(kept, "edge_id", "left_semi").select(self.c[t].columns) for t in ("edge_site", "call_arg")})

    def add_definitions(self, rows: DataFrame) -> None:
        """One body for each symbol and component."""
        self.merge("definition", rows)

    def add_def_edges(self, rows: DataFrame) -> None:
        self.merge("def_edge", rows, add="count")

    def copy_body_edges(self, definitions: DataFrame) -> None:
        """The calls and uses that a symbol has now become those of its body (columns id, symbol_id)."""
        e = self.c["edge"].where("kind in (1, 7)").join(definitions.select(F.col("symbol_id").alias("src_id"), F.col("id").alias("src_def_id")), "src_id")
        self.ignore("def_edge", e.select("src_def_id", "dst_id", "kind", "count").withColumn("id", F.xxhash64("src_def_id", "dst_id", "kind")))

    def delete_definitions_for_file(self, file_id: int) -> None:
        kept = self.c["definition"].where(~F.col("file_id").eqNullSafe(F.lit(file_id)))
        edges = self.c["def_edge"].join(kept.select(F.col("id").alias("src_def_id")), "src_def_id", "left_semi")
        self._replace(definition=kept, def_edge=edges.select(self.c["def_edge"].columns))

    # --- derived tables

    def rollup_edge_counts(self) -> None:
        self._replace(edge=R.edge_counts(self.c))

    def set_multi_def(self) -> None:
        self._replace(symbol=R.multi_def(self.c))

    def materialize_possible_calls(self) -> None:
        self._replace(possible_call=R.possible_calls(self.c))

    def materialize_dispatch_calls(self) -> None:
        plain = self.c["edge"].where("kind <> 18")
        self._replace(edge=plain.unionByName(R.dispatch_calls(self.c), allowMissingColumns=True))

    def cross_repo_edges(self) -> DataFrame:
        return R.cross_component_edges(self.c)

    def resolve_pass(self) -> tuple[int, int]:
        """Derives all derived tables; (stubs that are left, edges between components)."""
        self._become(R.resolve(self.c))
        told = R.summary(self.c)
        return told["stubs"], told["cross_component"]

    def stats(self) -> DataFrame:
        return Graph(self.c).stats()

    def unlisted_files(self, listing: DataFrame) -> DataFrame:
        """Files of the catalog whose absolute path is not in a listing (column path): they are gone from disk."""
        return self.files().join(listing.select(F.col("path").alias("abs_path")), "abs_path", "left_anti")
