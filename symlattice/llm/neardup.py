"""Near-duplicate documents: SimHash with an exact check, then an exact join for links beyond its radius.

Sets of shingles whose fingerprints differ in a few bits are found by pigeonhole blocks, and each such
pair's Jaccard similarity is checked. No radius that blocks can serve holds all similar pairs, so sets
that these links leave apart go through a prefix join: two sets whose similarity is `similarity` or more
share a value among the first few of each, in any order common to all sets. Values that are common in a
sample of the texts come last: the order decides how many candidates there are, never which pairs are found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.llm.pretokens import give_back
from symlattice.llm.simhash import block_keys, keep_first, majority_bits, shingle_hashes
from symlattice.operators.components import connected_components
from symlattice.staging import cut, drop_staged, sent

#: One text in so many is counted for the order; values seen COMMON times there, at most MOST of them, come last.
SAMPLE, COMMON, MOST = 16, 4, 1 << 16
#: Longs of a set's sketch: a bit for each residue, set if an odd number of values has it.
LONGS = 8
#: Bits that SimHashes of sets held against each other may differ in, and blocks besides that must be equal:
#: 15 keys of about 21 bits, which few sets share by chance in a corpus of millions.
DISTANCE, EXTRA = 4, 2
#: Longs of the sketch that pairs are held against before their sets are; longer, for long texts.
WIDE = 128


def first_values(hashes: pa.Array, values: np.ndarray, counts: np.ndarray, similarity: tuple[int, int]) -> pa.Array:
    """For each list (sig, n, bits, pre, fp): a digest of its set, the set's size, its sketch, the values that
    a set as similar must share one of, in the common order, and its SimHash. values: the common ones, sorted,
    with their counts."""
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    flat, ends = hashes.flatten().to_numpy(zero_copy_only=False), hashes.offsets.to_numpy()
    ends = ends - ends[0]
    up, down = similarity
    sig, size, pre, sets = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int32), [], []
    bits = np.zeros((len(hashes), LONGS * 64), np.uint8)
    for i in range(len(hashes)):
        u = np.unique(flat[ends[i] : ends[i + 1]])
        sig[i] = int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)
        n = size[i] = len(u)
        sets.append(u)
        bits[i] = np.bincount(u & (LONGS * 64 - 1), minlength=LONGS * 64) & 1
        if len(values):
            at = np.minimum(np.searchsorted(values, u), len(values) - 1)
            u = u[np.lexsort((u, np.where(values[at] == u, counts[at], 0)))]
        pre.append(u[: n + 1 + (-up * n) // down] if n else u)
    lists = _lists(pre)
    packed = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<i8")
    sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * LONGS), pa.array(packed, pa.int64()))
    return pa.StructArray.from_arrays([pa.array(sig), pa.array(size), sketch, lists, majority_bits(_lists(sets))], ["sig", "n", "bits", "pre", "fp"])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()))


def sketches(hashes: pa.Array, longs: int = WIDE) -> pa.Array:
    """For each list the sketch of its set, of so many longs."""
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    flat, ends = hashes.flatten().to_numpy(zero_copy_only=False), hashes.offsets.to_numpy()
    ends = ends - ends[0]
    bits = np.zeros((len(hashes), longs * 64), np.uint8)
    for i in range(len(hashes)):
        bits[i] = np.bincount(np.unique(flat[ends[i] : ends[i + 1]]) & (longs * 64 - 1), minlength=longs * 64) & 1
    packed = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * longs), pa.array(packed, pa.int64()))


def _hashed(texts: DataFrame, size: int, *keep: str) -> DataFrame:
    w, h = shingle_hashes(F.col("_text"), size)
    return texts.select(*keep, w.alias("_words")).select(*keep, h.alias("h"))


def _alike(n: Column, m: Column, shared: Column, similarity: tuple[int, int]) -> Column:
    """Whether sets of n and m values with `shared` (or at most so many) in common can be similar enough."""
    up, down = similarity
    return shared.cast("long") * (up + down) >= (n + m).cast("long") * up


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: tuple[int, int] = (4, 5), hot: int = 4, rounds: int = 2, distance: int = DISTANCE) -> DataFrame:
    """(id, component): a row for each row of docs; component is the least id of those that links lead to.

    Two texts are linked if the sets of their shingles of `size` words (of all their words, if fewer)
    have a Jaccard similarity of similarity[0] / similarity[1] or more; texts without words are linked.
    Sets whose SimHashes differ in `distance` bits or fewer are compared first: all of a block of up to
    4 * `hot`, in a larger one with one of its sets. What those links leave in different components
    goes through the prefixes, so `distance` decides which way a link is found, never whether.
    Values in the prefixes of up to `hot` sets give all their pairs. Under a value of more, all are
    compared with one of them, `rounds` times, and then only sets that these links leave in different
    components with each other: such a pair has a side outside the value's largest component. `hot`
    decides how many pairs are compared, never which components are found.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).withColumn("th", F.xxhash64("_text"))
    seen = _hashed(plain.where(F.pmod("th", F.lit(SAMPLE)) == 0).dropDuplicates(["th"]), size).select(F.explode(F.array_distinct("h")).alias("v"))
    common = seen.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "v").limit(MOST).toArrow().sort_by("v")
    told = docs.sparkSession.sparkContext.broadcast((common["v"].to_numpy(), common["n"].to_numpy()))

    @F.arrow_udf("sig long, n int, bits array<bigint>, pre array<bigint>, fp long")
    def fold(h: pa.Array) -> pa.Array:
        out = first_values(h, *told.value, similarity)
        give_back()
        return out

    own = cut(_hashed(plain, size, "id", "th").select("id", "th", fold("h").alias("f")).select("id", "th", "f.*"), "sets", batch_rows=2000)
    # of each set one row stands for all; ids and hashes alone are shuffled for that
    kinds = own.groupBy("sig").agg(F.min("id").alias("least"), F.min(F.struct("th", "id")).alias("r"))
    kinds = cut(kinds.select("sig", "least", F.col("r.th").alias("th"), F.col("r.id").alias("own")), "kinds")
    again = not own.groupBy("id", "th").count().where("count > 1").isEmpty()
    stands = sent(kinds.select(F.col("sig").alias("_s"), F.col("th").alias("_t"), F.col("own").alias("_o")))
    whole = own.join(stands, (F.col("sig") == F.col("_s")) & F.col("th").eqNullSafe(F.col("_t")) & F.col("id").eqNullSafe(F.col("_o")), "left_semi")
    whole = cut((whole.dropDuplicates(["sig"]) if again else whole).select("sig", "n", "bits", "pre", "fp"), "whole")
    members, sets_ = cut(own.select("id", "sig"), "members"), own
    drop_staged(sets_)

    def sides(left: DataFrame, right: DataFrame, more: Column) -> DataFrame:
        """Pairs under a value, told apart and similar in size, for which `more` holds as well."""
        x, y = left.toDF(*["v" if c == "v" else "x" + c for c in left.columns]), right.toDF(*["v" if c == "v" else "y" + c for c in right.columns])
        return x.join(y, (x["v"] == y["v"]) & (F.col("xsig") != F.col("ysig")) & _alike(F.col("xn"), F.col("yn"), F.least("xn", "yn"), similarity) & more)

    def close(x: str, n: Column, y: str, m: Column) -> Column:
        """Whether two sketches differ in no more values than those of similar sets do."""
        apart = sum(F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(LONGS))
        return apart * (similarity[0] + similarity[1]) <= (n + m) * (similarity[1] - similarity[0])

    def hopeful(pairs: DataFrame) -> DataFrame:
        left, right = (whole.select(F.col("sig").alias(c), F.col("n").alias("n" + c), F.col("bits").alias("s" + c)) for c in "ab")
        return pairs.join(left, "a").join(right, "b").where(close("sa", F.col("na"), "sb", F.col("nb"))).select("a", "b")

    def simhash_pairs() -> DataFrame:
        """(a, b): sets that share blocks, whose fingerprints are near and that their sketches do not rule out."""
        keyed = F.array(*[F.xxhash64(F.lit(i), v) for i, (_, v) in enumerate(block_keys(F.col("fp"), distance, EXTRA))])
        keys = whole.select("sig", "n", "fp", F.explode(keyed).alias("v"))
        same = cut(keys.join(keys.groupBy("v").agg(F.count("*").alias("m")).where("m > 1"), "v"), "fingerprints")
        little, large = (same.where(c).select("v", "sig", "n", "fp") for c in (F.col("m") <= 4 * hot, F.col("m") > 4 * hot))
        one = large.groupBy("v").agg(F.min_by(F.struct("sig", "n", "fp"), F.xxhash64("sig")).alias("c")).select("v", "c.*")
        hamming = F.bit_count(F.col("xfp").bitwiseXOR(F.col("yfp"))) <= distance
        ends = F.least("xsig", "ysig").alias("a"), F.greatest("xsig", "ysig").alias("b")
        found = sides(little, little, (F.col("xsig") < F.col("ysig")) & hamming).select(*ends).unionByName(sides(large, one, hamming).select(*ends))
        found = cut(found.distinct(), "near")
        found, all_ = cut(hopeful(found), "candidates", rows=found.count()), found
        for done in (same, all_):
            drop_staged(done)
        return found

    @F.arrow_udf("array<bigint>")
    def sketch(h: pa.Array) -> pa.Array:
        out = sketches(h)
        give_back()
        return out

    def hashed_ends(pairs: DataFrame, rows: int) -> DataFrame:
        """(sig, h) of the sets that a pair has; their texts are read again and not shuffled."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(kinds, "sig")
        ends = cut(ends.select("sig", F.col("th").alias("_t"), F.col("own").alias("_o")), "ends", rows=2 * rows)
        texts = plain.join(sent(ends), F.col("th").eqNullSafe(F.col("_t")) & F.col("id").eqNullSafe(F.col("_o"))).select("sig", "_text")
        return _hashed(texts.dropDuplicates(["sig"]) if again else texts, size, "sig")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of some pairs that are links: wide sketches rule most others out before sets are compared."""
        up, down = similarity
        wide = cut(hashed_ends(pairs, n := pairs.count()).select("sig", F.size(F.array_distinct("h")).alias("n"), sketch("h").alias("w")), "wide", batch_rows=1000)
        left, right = (wide.select(F.col("sig").alias(c), F.col("n").alias("n" + c), F.col("w").alias("w" + c)) for c in "ab")
        apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        near = pairs.join(left, "a").join(right, "b").where(apart * (up + down) <= (F.col("na") + F.col("nb")) * (down - up))
        near = cut(near.select("a", "b"), "near", rows=n)
        sets = cut(hashed_ends(near, near.count()).select("sig", F.array_distinct("h").alias("s")), "values")
        drop_staged(wide)
        x, y = sets.select(F.col("sig").alias("a"), F.col("s").alias("x")), sets.select(F.col("sig").alias("b"), F.col("s").alias("y"))
        alike = _alike(F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y")), similarity)
        links = cut(x.join(sent(near), "a").join(y, "b").where(alike).select("a", "b"), "links", rows=n)
        drop_staged(sets)
        return links

    def split(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(crowds with their components, the rows of them outside the largest component of their value)."""
        root = connected_components(links).withColumnRenamed("node", "sig")
        at = cut(crowds.join(root, "sig", "left").select("v", "sig", "n", F.coalesce("root", "sig").alias("root")), "split", rows=many)
        count = at.groupBy("v", "root").agg(F.count("*").alias("k"))
        main = count.groupBy("v").agg(F.max(F.struct("k", "root"))["root"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("v", "main")
        at = cut(at.join(main, "v"), "split", rows=many)
        return at, at.where("root <> main")

    tested = simhash_pairs()
    links = verified(tested)
    rows = cut(whole.select("sig", "n", F.posexplode("pre").alias("pos", "v")), "prefixes")
    held = rows.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    rows, all_ = cut(rows.join(held, "v"), "blocks"), rows
    drop_staged(all_)
    few = rows.where(F.col("m") <= hot).select("v", "sig", "n", "pos")
    rest = F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos"))  # at most shared from the first shared value on
    near = sides(few, few, (F.col("xsig") < F.col("ysig")) & _alike(F.col("xn"), F.col("yn"), rest, similarity))
    near = near.select(F.col("xsig").alias("a"), F.col("ysig").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    if not links.isEmpty():
        root = connected_components(links)
        ra, rb = root.toDF("a", "ra"), root.toDF("b", "rb")
        near = near.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    near = cut(near, "near")
    pairs = cut(hopeful(near), "candidates", rows=near.count())
    crowds = cut(rows.where(F.col("m") > hot).select("v", "sig", "n"), "crowds")
    many = crowds.count()
    links, tested = links.unionByName(verified(pairs)), tested.unionByName(pairs)
    for step in range(rounds + 1):
        if not many:
            break
        at, out = split(links)
        if out.isEmpty():
            break
        at, apart = at.select("v", "sig", "n", "root"), F.col("xroot") != F.col("yroot")
        if step < rounds:
            chosen = F.min_by(F.struct("sig", "n", "root"), F.xxhash64("sig", F.lit(step)))
            new = sides(at, out.groupBy("v").agg(chosen.alias("c")).select("v", "c.*"), apart)
        else:
            told = whole.select("sig", F.col("bits").alias("s"))
            at, out = (x.join(told, "sig").select("v", "sig", "n", "root", "s") for x in (at, out))
            new = sides(at, out, apart & close("xs", F.col("xn"), "ys", F.col("yn")))
        new = new.select(F.least("xsig", "ysig").alias("a"), F.greatest("xsig", "ysig").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        new = cut(hopeful(new) if step < rounds else new, "candidates", rows=many if step < rounds else None)
        links, tested = links.unionByName(verified(new)), tested.unionByName(new)
    root = connected_components(links).withColumnRenamed("node", "sig")
    named = cut(kinds.select("sig", "least").join(root, "sig", "left").select("sig", "least", F.coalesce("root", "sig").alias("root")), "roots")
    of_root = named.groupBy("root").agg(F.min("least").alias("component"))
    return members.join(named.join(of_root, "root").select("sig", "component"), "sig").select("id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """docs with one row of each of jaccard_groups(), as simhash.keep_first() chooses it."""
    return keep_first(docs, lambda d, i, t: jaccard_groups(d, i, t, size, similarity), id_col, text_col)
