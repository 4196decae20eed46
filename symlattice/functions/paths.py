"""Portable paths as column expressions: version folders, labels, and include paths that move with a component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a folder named after a version looks like.
VERSION = "^v?[0-9]+([._-][0-9]+)*$"
INCLUDE_FLAGS = ("-isystem", "-iquote", "-I")


def is_version_segment(segment: Column) -> Column:
    return segment.rlike(VERSION)


def version_key(version: Column) -> Column:
    """The numbers of a version, in order: an array that sorts as versions do. Parts that are no numbers are left out."""
    parts = F.split(F.regexp_replace(version, "^v", ""), "[._-]")
    return F.transform(F.filter(parts, lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("long"))


def normal_path(path: Column) -> Column:
    """Without empty and `.` parts, and without a part before each `..`; the empty path is `.`."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    rooted = path.startswith("/")

    def step(done: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((p == "..") & rooted, done).otherwise(F.array_append(done, p))

    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), kept)).when(kept == "", F.lit(".")).otherwise(kept)


def split_base_version(root: Column) -> Column:
    """{base, version}: a root whose last folder is a version in two parts; version is null for others."""
    path = normal_path(root)
    head, tail = F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.regexp_extract(path, "[^/]*$", 0)
    versioned = is_version_segment(tail) & (head != "")
    return F.struct(F.when(versioned, head).otherwise(path).alias("base"), F.when(versioned, tail).alias("version"))


def label_expand(text: Column, labels: Column, derive: bool = True) -> Column:
    """The text with each <name> replaced: by the path that the map `labels` has for it, else (derive) by the
    name as a path, `-` for `/`; others stay."""
    pieces = F.split(text, "(?=<[^<>]*>)|(?<=>)")

    def one(p: Column) -> Column:
        name = F.regexp_extract(p, "^<([^<>]*)>$", 1)
        named = F.try_element_at(labels, name)
        spelled = F.when((name != "") & F.lit(derive), F.concat(F.lit("/"), F.replace(name, F.lit("-"), F.lit("/"))))
        return F.when(p.rlike("^<[^<>]*>$"), F.coalesce(named, spelled, p)).otherwise(p)

    return F.array_join(F.transform(pieces, one), "")


def _indirect(value: Column) -> Column:
    return F.contains(value, F.lit("<")) | F.contains(value, F.lit("$")) | ~value.startswith("/")


def include_values(options: DataFrame, column: str = "options") -> DataFrame:
    """options with an id (_row) and a row for each include path among them: (_row, pos, flag, value, glued). A
    flag and its value are one word or two."""
    words = options.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.col(column).alias("words"))
    each = words.select("_row", F.posexplode("words").alias("pos", "word"), "words")
    flag = F.regexp_extract("word", "^(-isystem|-iquote|-I)", 1)
    told = each.withColumns({"flag": flag, "rest": F.substring("word", F.length(flag) + 1, F.length("word")), "next": F.get("words", F.col("pos") + 1)}).where("flag <> ''")
    glued = F.col("rest") != ""
    return told.select("_row", "pos", "flag", F.when(glued, F.col("rest")).otherwise(F.col("next")).alias("value"), glued.alias("glued")).where("value is not null")


def aliased(values: DataFrame, aliases: DataFrame, column: str = "value") -> DataFrame:
    """values with encoded: a path at or below an alias's (name, match_path, versioned) as <name> and what follows,
    the longest alias first and without the version folder after a versioned one. Relative paths and
    those that hold a label or a variable stay."""
    v = values.withColumn("_path", normal_path(F.col(column)))
    # every folder above a path is a key, so that this is an equi-join
    parts = F.split("_path", "/")
    above = v.where(~_indirect(F.col(column))).select("_path").distinct()
    above = above.select("_path", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("match_path"))
    best = above.join(aliases.select("name", "match_path", "versioned"), "match_path").groupBy("_path").agg(F.max_by(F.struct("name", "match_path", "versioned"), F.struct(F.length("match_path"), "name")).alias("m"))
    rest = F.substring("_path", F.length("m.match_path") + 1, F.length("_path"))
    rest = F.when(F.col("m.versioned") & is_version_segment(F.regexp_extract(rest, "^/([^/]*)", 1)), F.regexp_replace(rest, "^/[^/]*", "")).otherwise(rest)
    hit = v.join(best, "_path", "left")
    return hit.withColumn("encoded", F.coalesce(F.when(F.col("m").isNotNull(), F.concat(F.lit("<"), F.col("m.name"), F.lit(">"), rest)), F.col(column))).drop("_path", "m")


def relinked(values: DataFrame, components: DataFrame, column: str = "value", require_version: bool = True) -> DataFrame:
    """values with relinked: an absolute path in which a component's name (`a::b` as a/b) stands before a
    version folder leads to the component's path instead; the longest name wins, then the earliest place."""
    c = components.select(F.replace("name", F.lit("::"), F.lit("/")).alias("fragment"), F.rtrim("path", F.lit("/")).alias("to"), "name")
    v = values.withColumn("_path", normal_path(F.col(column)))
    parts = F.filter(F.split("_path", "/"), lambda p: p != "")
    some = v.where(~_indirect(F.col(column))).select("_path").distinct().withColumn("_parts", parts).where(F.size("_parts") > 0)
    at = some.select("_path", "_parts", F.posexplode("_parts").alias("i", "_p"))
    runs = at.select("_path", "_parts", "i", F.explode(F.sequence(F.lit(1), F.size("_parts") - F.col("i"))).alias("n"))
    runs = runs.withColumn("fragment", F.array_join(F.slice("_parts", F.col("i") + 1, F.col("n")), "/")).join(c, "fragment")
    follows = F.get("_parts", F.col("i") + F.col("n"))
    versioned = F.coalesce(is_version_segment(follows), F.lit(False))
    runs = runs.withColumn("versioned", versioned)
    runs = runs.where("versioned") if require_version else runs
    rest = F.slice("_parts", F.col("i") + F.col("n") + F.when(F.col("versioned"), 2).otherwise(1), F.size("_parts"))
    runs = runs.withColumn("new", F.array_join(F.concat(F.array("to"), rest), "/"))
    best = runs.groupBy("_path").agg(F.max_by("new", F.struct("n", F.length("fragment"), -F.col("i"), "name")).alias("new"))
    return v.join(best, "_path", "left").withColumn("relinked", F.coalesce("new", column)).drop("_path", "new")
