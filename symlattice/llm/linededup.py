"""Near-duplicate lines: a segment-partition edit join, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.operators.components import connected_components
from symlattice.staging import Scratch, cut, sent

#: Shorter lines (after trimming) count as repeats only if they are equal: one edit makes them another line.
MIN_CHARS = 20
#: A class of more lines than this is dealt to so many tasks.
CROWD, SALTS = 10_000, 64


def line_key(line: Column) -> Column:
    """What of a line is compared: it without blanks at its ends, in lower case."""
    return F.lower(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def _segment(length: str, i: int, parts: int) -> tuple[Column, Column]:
    """(start, size) of the i-th of `parts` even segments, the later ones being the longer."""
    base, extra = f"({length} div {parts})", f"({length} % {parts})"
    return F.expr(f"{base} * {i} + greatest(0, {i - parts} + {extra})"), F.expr(f"{base} + int({i} >= {parts} - {extra})")


def segment_rows(lines: DataFrame, edits: int) -> DataFrame:
    """(node, role, key): role 0 for each of a line's edits + 1 segments, keyed by length, number and
    content; role 1 for each substring that can equal such a segment of a line no longer than it.

    A line at most `edits` edits away keeps one of its edits + 1 segments whole. With d characters
    more, i segments before it and edits - i after it, the segment has moved by i places at most,
    and by edits - i at most as seen from the end: only those starts are probed.
    """
    parts, keys = edits + 1, []
    for d in range(edits + 1):
        other = F.col("len") - d
        for i in range(parts):
            start, size = _segment(f"(len - {d})", i, parts)
            if d == 0:
                keys.append(F.struct(F.lit(0).alias("role"), F.xxhash64(other, F.lit(i), F.substring("norm", start + 1, size)).alias("key")))
            for move in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1):
                at = start + move
                ok = (at >= 0) & (at + size <= F.col("len")) & (size > 0)
                keys.append(F.when(ok, F.struct(F.lit(1).alias("role"), F.xxhash64(other, F.lit(i), F.substring("norm", at + 1, size)).alias("key"))))
    return lines.select("node", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("node", "k.role", "k.key").distinct()


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once: as a lambda's argument the optimizer cannot copy it to
    every place where it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _within(q: Column, edits: int) -> Column:
    """Whether strings of characters q.x (q.n of them) and q.y (q.m) are at most `edits` edits apart; x is
    no shorter than y and longer than edits.

    Bit-parallel over the 2 * edits + 1 diagonals that matter: a bit for each says where the
    distance grows down a column (up, down), one step for each character of y; the distance is
    followed along the lowest diagonal to the end of x, and then up the last column. Along the
    diagonal it never falls, so once it is beyond what the last column can take back, the steps
    that are left pass the state on as it is.
    """
    top = 2 * edits
    full = F.lit((1 << (top + 1)) - 1)

    def advance(s: Column, i: Column) -> Column:
        c = F.get(q["y"], i)
        eq = F.lit(0)
        for k in range(top + 1):
            eq = eq + F.when(F.get(q["x"], i + (edits - k)) == c, 1 << (top - k)).otherwise(0)
        up, down, dist = s["up"], s["down"], s["dist"]

        def turn(e: Column) -> Column:
            return ((e.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(e).bitwiseOR(down).bitwiseAND(full)

        def close(d0: Column) -> Column:
            hp, hn, half = down.bitwiseOR(F.bitwise_not(d0.bitwiseOR(up)).bitwiseAND(full)), d0.bitwiseAND(up), F.shiftright(d0, 1)
            late = i - (q["n"] - edits)  # 0 or more once the end of x is reached
            bit = F.call_function("shiftright", F.lit(1 << top), late + 1)
            along = F.when(d0.bitwiseAND(F.lit(1 << top)) == 0, dist + 1).otherwise(dist)
            across = dist + F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
            return F.struct(hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(full)).alias("up"), half.bitwiseAND(hp).alias("down"), F.when(late < 0, along).otherwise(across).alias("dist"))

        hopeless = dist > q["m"] - q["n"] + 2 * edits
        return F.when(hopeless, s).otherwise(_let(_let(eq, turn), close))

    first = F.struct(F.lit(((1 << (edits + 1)) - 1) << (top - edits)).alias("up"), F.lit(0).alias("down"), F.lit(edits).alias("dist"))
    return F.aggregate(F.sequence(F.lit(0), q["m"] - 1), first, advance)["dist"] <= edits


def common_prefix(a: Column, b: Column, most: int = 20) -> Column:
    """Characters at the beginning that two unequal strings share, by halving (2**most - 1 at most)."""
    steps = F.array(*[F.lit(1 << k) for k in range(most - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(F.substring(a, F.lit(1), n + k) == F.substring(b, F.lit(1), n + k), n + k).otherwise(n))


def verified(pairs: DataFrame, edits: int) -> DataFrame:
    """The rows (a, b, s, t) of pairs, s no shorter than t, unequal, whose strings are at most `edits`
    apart. What they share at the beginning does not count for their distance and is left out."""

    def rest(p: Column) -> Column:
        x, y = (F.substring(F.col(c), p + 1, F.length(c)) for c in ("s", "t"))
        return F.struct(F.split(x, "").alias("x"), F.split(y, "").alias("y"), (F.length("s") - p).alias("n"), (F.length("t") - p).alias("m"))

    def near(q: Column) -> Column:
        return F.when(q["n"] <= edits, True).when(q["n"] - q["m"] > edits, False).otherwise(_within(q, edits))

    return pairs.where(_let(_let(common_prefix(F.col("s"), F.col("t")), rest), near)).select("a", "b")


def _pieces(lines: DataFrame, more: int) -> DataFrame:
    """(node, key, middle): each line as all but one of the about sqrt(n) pieces of a line of n = len + more
    characters (key, a hash), and what stands in the place of that piece."""
    n = F.col("len") + more
    places = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.struct(i.alias("i"), F.floor(n * i / F.col("m")).cast("int").alias("lo"), F.floor(n * (i + 1) / F.col("m")).cast("int").alias("hi")))
    cut_out = lines.withColumn("m", F.ceil(F.sqrt(n)).cast("int")).select("node", "norm", "len", F.explode(places).alias("p")).select("node", "norm", "len", "p.*")
    after = n - F.col("hi")
    key = F.xxhash64(n, "i", F.substring("norm", F.lit(1), F.col("lo")), F.substring("norm", F.col("len") - after + 1, after))
    return cut_out.select("node", key.alias("key"), F.substring("norm", F.col("lo") + 1, F.col("len") - after - F.col("lo")).alias("middle"))


def _one_edit_stars(lines: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly those lines that are one edit apart, in a number of rows that
    grows with the lines' length and not with the square of a crowd.

    Lines that agree but for a piece meet first; of a line of n characters that are sqrt(n) rows of
    sqrt(n) characters. Only where several lines meet, characters are left out: those that agree when
    the p-th character of the piece is left out are one substitution apart, all of them from each
    other: each links to the least. A piece without one character is one other piece at most.
    """
    rows = cut(_pieces(lines, 0).withColumn("more", F.lit(0)).unionByName(_pieces(lines, 1).withColumn("more", F.lit(1))), "pieces")
    met = rows.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
    rows = cut(rows.join(met, "key", "left_semi"), "met")
    places = F.sequence(F.lit(1), F.length("middle"))
    rest = F.transform(places, lambda p: F.concat(F.substring(F.col("middle"), F.lit(1), p - 1), F.substring(F.col("middle"), p + 1, F.length("middle"))))
    own = rows.where((F.col("more") == 0) & (F.length("middle") > 0)).select("node", "key", F.posexplode(rest).alias("p", "rest"))
    cuts = cut(own.select("node", F.xxhash64("key", "p", "rest").alias("same"), F.xxhash64("key", "rest").alias("short")), "cuts")
    least = cuts.groupBy("same").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("same", "b")
    swapped = cuts.join(least, "same").where("node <> b").select(F.col("node").alias("a"), "b")
    # a line that lacks a character appears under the keys of lines one longer
    whole = rows.where("more = 1").select(F.col("node").alias("b"), F.xxhash64("key", "middle").alias("short"))
    longer = cuts.select(F.col("node").alias("a"), "short").distinct().join(whole, "short").where("a <> b").select("a", "b")
    return swapped.unionByName(longer)


def line_classes(lines: DataFrame, edits: int = 1, hot: int = 32) -> DataFrame:
    """(node, root) for the lines that have another within `edits` edits, over any number of links.

    lines: node, norm (distinct and longer than 2 * edits), len. Candidates share a segment; each is
    verified. A segment that more than `hot` lines share (edits = 1) is not joined in pairs: its lines
    link by _one_edit_stars(), which are verified as well. With more edits all segments are joined.
    """
    rows = cut(segment_rows(lines, edits), "segments")
    index = rows.where("role = 0").select("key", F.col("node").alias("r"))
    probe = rows.where("role = 1").select("key", F.col("node").alias("q"))
    size = index.groupBy("key").agg(F.count("*").alias("n"))
    crowd = hot if edits == 1 else None
    if crowd is not None:
        crowded = size.where(F.col("n") > crowd).select("key")
        many = cut(crowded, "crowded")
        pairs = probe.join(index.join(many, "key", "left_anti"), "key")
        touched = cut(rows.join(many, "key", "left_semi").select("node").distinct(), "touched")
        stars = _one_edit_stars(lines.join(sent(touched), "node", "left_semi"))
    else:
        pairs, stars = probe.join(index, "key"), None
    edges = pairs.where("r <> q").select(F.greatest("r", "q").alias("a"), F.least("r", "q").alias("b"))
    if stars is not None:
        edges = edges.unionByName(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    edges = cut(edges.distinct(), "candidates")
    needed = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
    n = needed.count()
    texts = cut(lines.join(sent(needed), "node", "left_semi").select("node", "norm", "len"), "texts")
    left = texts.select(F.col("node").alias("a"), F.col("norm").alias("x"), F.col("len").alias("lx"))
    right = texts.select(F.col("node").alias("b"), F.col("norm").alias("y"), F.col("len").alias("ly"))
    both = edges.join(left, "a").join(right, "b").where(F.abs(F.col("lx") - F.col("ly")) <= edits)
    longer = F.col("lx") >= F.col("ly")
    # few bytes, but work: more tasks than the size alone would make
    both = both.repartition(max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 5_000))
    return connected_components(verified(both.select("a", "b", F.when(longer, F.col("x")).otherwise(F.col("y")).alias("s"), F.when(longer, F.col("y")).otherwise(F.col("x")).alias("t")), edits))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, th, positions): the lines (from 0, in order) of each text, told by id and the text's XXH64,
    that repeat an earlier line of the corpus; texts without such lines have no row.

    Lines end at newlines; those of blanks alone are never repeats. The others fall into classes: equal
    in lower case without blanks at the ends, or, with min_chars characters or more each (trimmed),
    linked by `edits` edits or fewer over any number of steps. A class's first line stays, in order of
    id (null last), text hash and position.
    """
    if min_chars <= 2 * edits:
        raise ValueError("lines must be longer than twice the edits")
    each = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    each = each.withColumn("norm", line_key(F.col("line"))).where("norm <> ''").select("id", "th", "pos", "norm")
    kinds = each.groupBy("norm").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("node"), "norm", F.length("norm").alias("len"), "n")
    kinds = cut(kinds, "lines")
    hashes = [F.xxhash64("norm").alias("h"), F.xxhash64(F.lit(1), "norm").alias("g")]
    near = line_classes(kinds.where(F.col("len") >= min_chars).select("node", "norm", "len"), edits)
    linked = near.join(kinds.select("node", "n", *hashes), "node").select("h", "g", "root", "n")
    alone = kinds.where("n > 1").select("node", "n", *hashes).join(near.select("node"), "node", "left_anti").select("h", "g", F.col("node").alias("root"), "n")
    several = cut(linked.unionByName(alone), "several")
    crowds = cut(several.groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") > CROWD).select("root", F.lit(SALTS).alias("salts")), "crowds")
    several = several.select("h", "g", "root").join(sent(crowds), "root", "left").select("h", "g", "root", F.coalesce("salts", F.lit(1)).alias("salts"))
    slim = each.select("id", "th", "pos", *hashes).join(sent(cut(several, "several")), ["h", "g"])
    slim = slim.select("root", "salts", F.pmod(F.xxhash64("id", "th", "pos"), F.col("salts")).alias("salt"), F.struct(F.col("id").isNull().alias("z"), "id", "th", "pos").alias("at"))
    slim = cut(slim, "repeats")
    # a crowd is compared with its first line in SALTS tasks
    first = slim.groupBy("root", "salts").agg(F.min("at").alias("first"))
    first = first.select("root", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"))
    gone = slim.join(first, ["root", "salt"]).where(~F.col("at").eqNullSafe(F.col("first")))
    return gone.groupBy("at.id", "at.th").agg(F.sort_array(F.collect_set("at.pos")).alias("positions"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with each text freed of the lines that repeated_lines() names, and the array column
    removed_lines with their positions (empty if none; _removed_lines if the name is taken).

    Every row stays: a null text stays null, a text all of whose lines are repeats becomes empty.
    Repeated rows (same id and text) count as one document and keep the same lines; extra columns are
    kept; an empty table gives an empty one.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    plain = docs.toDF(*names)
    with Scratch(docs.sparkSession) as scratch:
        gone = scratch.keep(cut(repeated_lines(plain, key, text, edits, min_chars), "gone"))
    gone = gone.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "positions")
    wide = plain.withColumn("_t", F.xxhash64(text)).join(sent(gone), F.col("_t").eqNullSafe(F.col("_th")) & F.col(key).eqNullSafe(F.col("_id")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("positions"), i)), "\n")
    new = F.when(F.col("positions").isNull(), F.col(text)).otherwise(kept)
    extra = "removed_lines" if "removed_lines" not in [c.lower() for c in docs.columns] else "_removed_lines"
    return wide.select(*[new.alias(n) if n == text else F.col(n) for n in names], F.coalesce("positions", F.array().cast("array<int>")).alias("_gone")).toDF(*docs.columns, extra)
