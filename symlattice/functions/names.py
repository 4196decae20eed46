"""Display names that never collide, and the NULL-free views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlattice.schemas import SYMBOL_KIND
from symlattice.sources.facts import Catalog
from symlattice.staging import cut, sent


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def starts(text: Column, head: Column) -> Column:
    return F.coalesce(F.instr(text, head) == 1, F.lit(False))


def rest_after(text: Column, head: Column) -> Column:
    return F.substring(text, F.length(head) + 1, F.length(text))


def display_names(catalog: Catalog) -> DataFrame:
    """(id, name), names unique: the qualified name with the signature or template arguments that the
    display name adds; members of a template instance under the instance's name; where several symbols
    still agree, with their place, and then numbered in order of id."""
    s = catalog["symbol"]
    shown = F.col("display_name")
    sig = F.when(F.coalesce(shown != "", F.lit(False)) & starts(shown, F.col("spelling")), rest_after(shown, F.col("spelling"))).otherwise("")
    ann = s.select("id", "usr", "qual_name", "parent_usr", "decl_path", "file_id", F.coalesce("decl_line", "line", F.lit(0)).alias("at"), sig.alias("sig"), F.concat(F.coalesce("qual_name", "spelling", "usr"), sig).alias("base"))
    # only owners whose display name says more than their name change their members' names
    owner = ann.where("base <> qual_name").select(F.col("usr").alias("o_usr"), F.col("base").alias("o_base"), F.col("qual_name").alias("o_name"))
    spliced = F.coalesce(F.col("o_usr").isNotNull() & starts(F.col("qual_name"), F.col("o_name")), F.lit(False))
    # symbols without an owner stay out of the join: all of them would be one key
    inside, alone = ann.where("parent_usr is not null"), ann.where("parent_usr is null")
    owned = inside.join(owner, inside["parent_usr"] == F.col("o_usr"), "left").unionByName(alone, allowMissingColumns=True)
    named = owned.withColumn("nm", F.when(spliced, F.concat("o_base", rest_after(F.col("qual_name"), F.col("o_name")), "sig")).otherwise(F.col("base")))
    files = catalog["file"].select(F.col("id").alias("file_id"), F.col("name").alias("file_name"))
    base = basename(F.col("decl_path"))
    where = named.join(files, "file_id", "left").select("id", "nm", F.concat(F.coalesce(F.when(base != "", base), "file_name", F.lit("?")), F.lit(":"), F.col("at").cast("string")).alias("loc"))
    by_name, by_place = Window.partitionBy("nm"), Window.partitionBy("nm", "loc")
    told = where.withColumns({"n1": F.count("*").over(by_name), "n2": F.count("*").over(by_place), "rn": F.row_number().over(by_place.orderBy("id"))})
    placed = F.concat("nm", F.lit(" @"), "loc")
    return told.select("id", F.when(F.col("n1") == 1, F.col("nm")).when(F.col("n2") == 1, placed).otherwise(F.concat(placed, F.lit(" ["), F.col("rn").cast("string"), F.lit("]"))).alias("name"))


def kind_names() -> Column:
    return F.create_map(*[F.lit(x) for k, v in SYMBOL_KIND.items() for x in (v, k)])


def symbol_facts(catalog: Catalog, names: DataFrame | None = None) -> DataFrame:
    """The symbols in 13 columns without nulls."""
    names = display_names(catalog) if names is None else names
    s = catalog["symbol"]
    files = catalog["file"].select(F.col("id").alias("_f"), F.col("name").alias("file_name"))
    at = F.coalesce(s["file_id"], s["decl_file_id"])
    flags = ["is_definition", "is_pure", "is_static", "is_instantiation", "is_named_instance"]
    return s.join(names, "id").join(files, at == F.col("_f"), "left").select(
        "id",
        "name",
        F.coalesce(F.try_element_at(kind_names(), F.col("kind")), F.lit("unknown")).alias("kind"),
        F.coalesce("type_info", F.lit("")).alias("type_info"),
        F.coalesce("file_name", "decl_path", F.lit("")).alias("file"),
        F.coalesce("line", "decl_line", F.lit(0)).alias("line"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in flags],
        F.coalesce("linkage", F.lit("")).alias("linkage"),
        F.coalesce("access", F.lit("")).alias("access"),
    )


def callable_facts(catalog: Catalog, names: DataFrame | None = None, key: str = "name") -> DataFrame:
    """(name, signature): the names' column `key`, return type, qualified name and parameters; constructors and destructors without the type."""
    names = display_names(catalog) if names is None else names
    kinds = [SYMBOL_KIND[k] for k in ("function", "function-template", "method", "constructor", "destructor")]
    s = catalog["symbol"].where(F.col("kind").isin(kinds)).join(names, "id")
    at = F.instr("type_info", " (")
    head, tail = F.substring("type_info", F.lit(1), at - 1), F.substring("type_info", at + 1, F.length("type_info"))
    full = F.coalesce("qual_name", "spelling", "name")
    bare = F.coalesce(F.col("type_info"), F.lit("")) == ""
    signature = F.when(bare | (at == 0), F.col("name")).when(F.col("kind").isin(SYMBOL_KIND["constructor"], SYMBOL_KIND["destructor"]), F.concat(full, tail)).otherwise(F.concat(head, F.lit(" "), full, tail))
    return s.select(F.col(key).alias("name"), signature.alias("signature"))


def named_edges(catalog: Catalog, kind: int, names: DataFrame | None = None, table: str = "edge") -> DataFrame:
    """(a, b): the names of both ends of all edges of a kind."""
    names = display_names(catalog) if names is None else names
    e = catalog[table].where(F.col("kind") == kind).select("src_id", "dst_id")
    return e.join(names.select(F.col("id").alias("src_id"), F.col("name").alias("a")), "src_id").join(names.select(F.col("id").alias("dst_id"), F.col("name").alias("b")), "dst_id").select("a", "b")


def call_site_facts(catalog: Catalog, names: DataFrame | None = None, callers: DataFrame | None = None) -> DataFrame:
    """Every call with its places, one row for each; a call without a place has one row with zeros.
    callers: a column of symbols' ids, whose calls alone are meant; they are picked before names and places are."""
    names = display_names(catalog) if names is None else names
    e = catalog["edge"].where("kind = 1").select("id", "src_id", "dst_id", "count")
    sites = catalog["edge_site"].select(F.col("edge_id").alias("id"), "file_id", "line", "col", "conditional")
    if callers is not None:
        e = sent(cut(e.join(sent(cut(callers.toDF("src_id"), "callers")), "src_id", "left_semi"), "called"))
        sites = cut(sites.join(e.select("id"), "id", "left_semi"), "sites")
    files = catalog["file"].select(F.col("id").alias("file_id"), F.col("name").alias("file"))
    full = e.join(names.select(F.col("id").alias("src_id"), F.col("name").alias("caller")), "src_id").join(names.select(F.col("id").alias("dst_id"), F.col("name").alias("callee")), "dst_id")
    return full.join(sites, "id", "left").join(files, "file_id", "left").select(
        "caller", "callee", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("col", F.lit(0)).alias("col"), F.coalesce("conditional", F.lit(0)).alias("conditional"), F.col("count").alias("occurrences")
    )


def template_arg_facts(catalog: Catalog, names: DataFrame | None = None, key: str = "name") -> DataFrame:
    names = display_names(catalog) if names is None else names
    a = catalog["template_arg"].join(names.select(F.col("id").alias("owner_id"), F.col(key).alias("owner")), "owner_id")
    a = a.join(names.select(F.col("id").alias("ref_id"), F.col("name").alias("ref")), "ref_id", "left")
    return a.select("owner", "position", "arg_kind", F.coalesce("ref", F.lit("")).alias("referenced"), F.coalesce("literal", F.lit("")).alias("literal"))
