"""Text operators against brute-force versions on small tables, and the cases that every one must take."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from symlattice.llm import bpe, linededup, mixing, pretokens, quality, sharding, simhash, tokenstore, toxicity
from symlattice.llm.eliasfano import EliasFano
from symlattice.llm.factorization import FactorizationMachine
from symlattice.staging import cut, staged_path

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, source string"
ODD = [
    (1, "a b c", None), (1, "a b c", None), (None, None, "s"), (None, "", None), (2, "a b c", "s"), (2, "x y z w", "s"),
    (3, "word " * 4000, "t"), (4, "\x1c　\t\n  ", "t"), (5, "Zoë 北京 🙂 don't", "t"), (6, "one", "u"), (7, None, "u"),
]


@pytest.fixture(scope="module")
def odd(spark):
    # columns that the operators use inside must not clash with those that are there
    return spark.createDataFrame(ODD, DOCS).withColumns({"size": F.lit("mine"), "rank": F.lit(1), "_h": F.lit(2), "fp": F.lit(3), "node": F.lit(4), "taken": F.lit(5), "removed_lines": F.lit("x")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fingerprint(t):
    w = words((t or "").translate({65 + i: 97 + i for i in range(26)}))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def least_reachable(n, links):
    label = list(range(n))
    while True:
        new = label[:]
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_simhash_fingerprints_and_groups(spark, odd, empty):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == len(ODD)
    want = {}
    for i, t, _ in ODD:
        want.setdefault(i, set()).add(fingerprint(t))
    for r in got:
        assert r["fp"] & (2**64 - 1) in want[r["id"]]
    blank = {r["id"]: r["component"] for r in got if r["fp"] == 0}
    assert set(blank.values()) == {7} or set(blank.values()) == {4}
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r["component"] for r in got})
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("hot", [3, 64])
def test_near_fingerprints_have_the_components_of_all_pairs(spark, hot):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(20)]
    values = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) for b in base for _ in range(12)})
    signed = [v - (v >> 63 << 64) for v in values]
    links = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    want = least_reachable(len(values), links)
    from symlattice.operators.components import connected_components

    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    root = {x["node"]: x["root"] for x in connected_components(simhash.near_fingerprints(df, 2, hot=hot)).collect()}
    groups: dict = {}
    for v, w in zip(signed, want, strict=True):
        groups.setdefault(root.get(v, v), set()).add(w)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_sharding_is_even_and_matches_the_mixture(spark, odd, empty):
    rows = [(i, "x" * (i % 50), f"s{0 if i % 3 else i % 7}") for i in range(1000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 7).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    for source in {r[2] for r in rows}:
        n = [sum(r["shard"] == s and r["source"] == source for r in got) for s in range(7)]
        assert max(n) - min(n) <= len({r[2] for r in rows})
    again = sharding.shard_documents(spark.createDataFrame(rows, DOCS).repartition(5), 7).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    told = sharding.shard_documents(odd, 3).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in told) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in ODD)
    assert sharding.shard_documents(empty, 3).count() == 0


def test_mixing_targets():
    t = mixing.targets([("a", 100), ("b", 10), (None, 90)])
    assert t["b"] == 30.0 and math.isclose(t["a"] + t[None], 170.0) and math.isclose(t["a"] / t[None], 5.0)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}
    t = mixing.targets([("a", 1), ("b", 1000)], share=5.0)
    assert t == {"a": 3.0, "b": 3000.0}


def test_mixing(spark, odd, empty):
    r = random.Random(1)
    rows = [(i, "w " * r.choice([1, 5, 20, 300]), f"s{i % 9 if i % 3 else 0}") for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_documents(docs).collect()
    for s in {x["source"] for x in got}:
        mine = [x for x in got if x["source"] == s]
        assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 20 + 0.05 * mine[0]["target"]
    assert all(x["taken"] <= 3 * x["size"] and x["size"] == len(words(rows[x["doc_id"]][1])) for x in got)
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert {(x["doc_id"], x["taken"]) for x in got} == {(x["doc_id"], x["taken"]) for x in again}
    whole = mixing.take(docs)
    assert whole.columns == docs.columns and whole.count() == sum(x["epochs"] for x in got)
    assert mixing.mix_documents(odd).count() == len(ODD) and mixing.take(odd).columns == odd.columns
    assert mixing.mix_documents(empty).count() == 0 and mixing.take(empty).count() == 0


def test_mixing_prefers_heavy_rows(spark):
    rows = [(i, "w", "a") for i in range(2000)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "source", "1L as size", "if(doc_id % 2 = 0, 1.0D, 0.25D) as weight", "doc_id as crc")
    got = mixing.mix(df, "source", "size", "weight", ["doc_id"], share=0.3).where("taken > 0").select("weight").collect()
    heavy = sum(x["weight"] == 1.0 for x in got)
    assert abs(len(got) - 600) <= 1 and heavy > 1.8 * (len(got) - heavy)


def spark_uniform(seed, *values):
    """text.uniform() by hand: XXH64 chained over the columns, nulls left out, with the first 53 bits."""
    h = seed_hash(seed)
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
    return ((h >> 11) + 0.5) / 2**53


def seed_hash(seed):
    return xxhash.xxh64_intdigest(seed.to_bytes(4, "little", signed=True), 42)


def test_sharding_by_hand(spark):
    """Shuffled ranks within each source, sorted by fractional rank, cut evenly: every shard and slot."""
    r = random.Random(4)
    rows = [(i, "x" * r.randrange(9), r.choice(["a", "b", None, "a"])) for i in range(257)]
    plan = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 7)
    crc = {i: zlib.crc32(t.encode()) for i, t, _ in rows}
    u = {i: spark_uniform(17, i, crc[i], len(t) + 16) for i, t, _ in rows}
    order = []
    for source in ("a", "b", None):
        mine = sorted((i for i, _, s in rows if s == source), key=lambda i: (u[i], i, crc[i]))
        order += [((2 * k + 1) / (2 * len(mine)), source is None, source or "", u[i], i) for k, i in enumerate(mine)]
    want, count = {}, [0] * 7
    for rank, (*_, i) in enumerate(sorted(order)):
        shard = rank * 7 // len(rows)
        want[i] = (shard, count[shard])
        count[shard] += 1
    assert {x["doc_id"]: (x["shard"], x["slot"]) for x in plan.collect()} == want


def test_mixing_by_hand(spark):
    """Whole epochs, then rows in order of their exponential keys while they fit, then the words left over."""
    r = random.Random(6)
    rows = [(i, "s" + str(min(i % 7, 3)), r.choice([1, 4, 9, 60]), r.choice([0.25, 0.7, 1.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")
    got = {x["doc_id"]: x["taken"] for x in mixing.mix(df, "source", "size", "weight", ["doc_id"], per_bucket=1).collect()}
    size = {s: sum(x[2] for x in rows if x[1] == s) for s in {x[1] for x in rows}}
    want = mixing.targets(list(size.items()))
    for s in size:
        mine = sorted((-math.log(spark_uniform(23, i)) / w, i, n) for i, src, n, w in rows if src == s)
        left, epochs, took = want[s] % size[s], int(want[s] // size[s]), set()
        for k in range(3):
            past = 0
            start = left
            for _, i, n in mine:
                if i in took or (k and n > start):
                    continue
                if past + (n if k < 2 else n / 2) <= start:
                    took.add(i)
                    left -= n
                past += n
            if left < 1:
                break
        assert {i: got[i] for _, i, _ in mine} == {i: n * (epochs + (i in took)) for _, i, n in mine}


def test_margins_of_pairs_by_hand():
    r = np.random.default_rng(3)
    fm = FactorizationMachine(30, 4)
    fm.bias, fm.linear, fm.pairs = 0.3, r.normal(size=30), r.normal(size=(30, 4))
    sets = [[], [4], [1, 2], [7, 8, 9, 20, 29], list(range(30))]
    want = [fm.bias + sum(fm.linear[i] for i in s) + sum(fm.pairs[i] @ fm.pairs[j] for n, i in enumerate(s) for j in s[:n]) for s in sets]
    assert np.allclose(fm.margins(np.array(sum(sets, []), np.int64), np.array([len(s) for s in sets])), want)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    r, pairs = random.Random(edits), []
    while len(pairs) < 250:
        a = [r.choice("abé") for _ in range(r.randint(edits + 2, 14))]
        b = a[:]
        for _ in range(r.randint(0, edits + 2)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randint(0, 1)] = [r.choice("abé")] * r.randint(0, 1)
        a, b = sorted(("".join(a), "".join(b)), key=len, reverse=True)
        if b and a != b and len(a) - len(b) <= edits < len(a):
            pairs.append((len(pairs), edits, a, b))
    df = spark.createDataFrame(pairs, "a long, b long, s string, t string")
    assert {x["a"] for x in linededup.verified(df, edits).collect()} == {i for i, _, s, t in pairs if levenshtein(s, t) <= edits}


@pytest.mark.parametrize(("edits", "hot"), [(1, 32), (1, 2), (2, 32)])
def test_line_classes(spark, edits, hot):
    r, lines = random.Random(7), set()
    for _ in range(30):
        base = [r.choice("abcdefgh ") for _ in range(r.randint(20, 34))]
        for _ in range(r.choice([1, 3, 9])):
            b = base[:]
            for _ in range(r.randint(0, 3)):
                i = r.randrange(len(b))
                b[i : i + r.randint(0, 1)] = [r.choice("abcdefgh")] * r.randint(0, 1)
            if len(b) >= 20:
                lines.add("".join(b))
    lines = sorted(lines)
    links = [(i, j) for i in range(len(lines)) for j in range(i) if abs(len(lines[i]) - len(lines[j])) <= edits and levenshtein(lines[i], lines[j]) <= edits]
    label = least_reachable(len(lines), links)
    got = {(x["node"], x["root"]) for x in linededup.line_classes(spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(lines)], "node long, norm string, len int"), edits, hot).collect()}
    assert got == {(i, label[i]) for i in range(len(lines)) if label.count(label[i]) > 1}


def test_dedup_lines(spark, odd, empty):
    long, near = "This line is long enough to count.", "  this line is long enough to count!"
    docs = spark.createDataFrame([(1, f"{long}\nshort\nunique to the first document", "s"), (2, f"short\n{near}\nunique to the second document", "s"), (2, f"short\n{near}\nunique to the second document", "s"), (3, long, "s"), (4, None, "s"), (5, "", "s")], DOCS)
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in linededup.dedup_lines(docs).collect()}
    assert got[1] == (f"{long}\nshort\nunique to the first document", [])
    # short lines repeat when they are equal; longer ones also when they are one edit apart
    assert got[2] == ("unique to the second document", [0, 1]) and got[3] == ("", [0])
    assert got[4] == (None, []) and got[5] == ("", [])
    assert linededup.dedup_lines(docs).count() == 6
    assert linededup.dedup_lines(odd).columns == [*odd.columns, "_removed_lines"]
    assert linededup.dedup_lines(empty).count() == 0
    with pytest.raises(ValueError):
        linededup.repeated_lines(docs, edits=10)


def test_lines_that_repeat(spark):
    """Short lines by equality alone, blank ones never, a crowd over many tasks."""
    docs = spark.createDataFrame([(i, f"Read more\n\n  \nread mor{'eabc'[i % 4]}\nown line of document {i} {'x' * i}", "s") for i in range(12)], DOCS)
    linededup.CROWD, most = 5, linededup.CROWD
    try:
        got = {r["doc_id"]: r["removed_lines"] for r in linededup.dedup_lines(docs).collect()}
    finally:
        linededup.CROWD = most
    assert got == {i: ([3] if i == 0 else [] if i == -1 else [0] if i < 4 else [0, 3]) for i in range(12)}


def test_long_lines_in_a_crowd(spark):
    r = random.Random(2)
    base = [r.choice("abcdefghij ") for _ in range(30_000)]
    lines = ["".join(base)]
    for at in (5, 14_999, 15_000, 29_998):
        lines.append("".join(base[:at] + ["#"] + base[at + 1 :]))
    lines += ["".join(base[:20_000] + base[20_001:]), "".join(base[:100] + ["##"] + base[100:])]
    df = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(lines)], "node long, norm string, len int")
    assert {(x["node"], x["root"]) for x in linededup.line_classes(df, 1, hot=1).collect()} == {(i, 0) for i in range(6)}


def test_texts_longer_than_a_span(spark):
    """Past 2**20 characters texts are worked on in parts; the ids are those of the whole."""
    import tokenizers

    r = random.Random(9)
    words = ["word", "don't", "naïve", "x1,", "(so)", "字典", "\n", "two  blanks", "end."]
    long = " ".join(r.choice(words) for _ in range(300_000))
    solid = "ab" * 30_000
    assert len(long) > pretokens.SPAN
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    chunks, _ = tokenstore.shared_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert chunks.cuts
    texts = ["", " lead", "a", long, solid, "tail ", " ", "x"]
    ids, counts = chunks.batch(pa.array(texts))
    ends = np.cumsum(counts)
    for t, a, n in zip(texts, ends - counts, counts, strict=True):
        assert ids[a : a + n].tolist() == library.encode(t, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, long), (2, " ".join(["shout"] * 400_000))], "doc_id long, text string")
    assert [x["kept"] is not None for x in quality.classify(docs).collect()] == [True, True]
    fps = {x["id"]: x["fp"] for x in simhash.fingerprints(docs).collect()}
    shout = xxhash.xxh64_intdigest("shout shout shout".encode(), 42)
    assert fps[2] % (1 << 64) == shout


def test_encoders_that_cannot_be_cut():
    whole = pretokens.ChunkEncoder(lambda texts: [np.array([len(t)], "<u4").tobytes() for t in texts])
    assert not whole.cuts
    ids, counts = whole.batch(pa.array(["a b", "", "abc d"]))
    assert ids.tolist() == [3, 0, 5] and counts.tolist() == [1, 1, 1]
    assert whole.ids("a bc").tolist() == [4]


def test_fetch_tokens(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    docs = spark.createDataFrame([(i, "word " * i) for i in range(50)], "doc_id long, text string")
    tokenstore.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    all_ = {x["id"]: x["n_tokens"] for x in tokenstore.read_tokens(spark, path).collect()}
    got = {x["id"]: x["ids"] for x in tokenstore.fetch_tokens(spark, path, spark.createDataFrame([(7,), (0,), (99,)], "id long")).collect()}
    assert set(got) == {0, 7} and got[0] == [2] and len(got[7]) == all_[7] and got[7][-1] == 2


def test_rank_queue():
    r, q, model = random.Random(3), bpe.RankQueue(70_000), []
    for _ in range(3000):
        if model and r.random() < 0.5:
            model.sort()
            assert q.pop() == model.pop(0)
        else:
            x = (r.choice([r.randrange(70_000), r.randrange(5)]), r.randrange(100))
            q.push(*x)
            model.append(x)
    while model:
        model.sort()
        assert q.pop() == model.pop(0)
    assert q.top == 0


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(library):
    codec = bpe.Codec.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, most=50)
    r, letters = random.Random(1), " \n\t\r\x1c\x0b'stlreabcéñ北京🙂0123.,!?-\x85\xa0　"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 300 + "x", "x y " * 2000, "", " ", "word. word, (word)", "͸x"]
    for t in texts:
        ids = codec.encode(t)
        assert ids.tolist() == library.encode_ordinary(t), t[:50]
        assert codec.decode(ids) == t.encode()


def test_bpe_merges_without_a_call_for_each_step():
    """Merges of a long piece cost no Python call each, also with more ranks than the bitmap's words have bits of one level."""
    import sys

    ranks = {bytes([b]): b for b in range(256)} | {b"ab" * k: 69_000 + k for k in range(1, 40)} | {b"b" * k: 70_000 - k for k in range(2, 9)}
    codec = bpe.Codec(ranks, "(?s).+")
    r, calls = random.Random(2), []

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks), default=None)
            if not found:
                return [ranks[x] for x in parts]
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]

    for _ in range(200):
        piece = bytes(r.choice(b"abb") for _ in range(r.randint(1, 60)))
        assert codec.merge(piece) == plain(piece)
        assert codec.queue.top == 0 and not codec.queue.buckets and not any(codec.queue.words)
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        codec.merge(b"ab" * 500)
    finally:
        sys.setprofile(None)
    assert len(calls) < 10


def test_encode_decode(spark, odd, empty, library):
    run = lambda d: bpe.encode_decode(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = sorted((repr(r["id"]), list(r["ids"]), bytes(r["decoded"])) for r in run(odd).collect())
    assert got == sorted((repr(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in ODD)
    assert run(empty).count() == 0


@pytest.mark.parametrize(("n", "most"), [(0, 0), (1, 0), (5, 7), (700, 1000), (700, 10**8), (700, 3)])
def test_elias_fano(n, most):
    r = random.Random(n)
    x = np.sort(np.array([r.randint(0, most) for _ in range(n)], np.int64))
    e = EliasFano.from_bytes(EliasFano.encode(x).to_bytes())
    assert (e.all() == x).all() and [e[i] for i in range(n)] == x.tolist()
    if n == 700 and most == 10**8:
        assert len(e.low) + len(e.high) < n * (2 + math.log2(most / n) + 0.5) / 8 + 16
    with pytest.raises(IndexError):
        e[n]
    if n > 1 and most:
        with pytest.raises(ValueError):
            EliasFano.encode(x[::-1] + np.arange(n)[::-1])


def test_token_files(spark, odd, empty):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    lib, path = Tokenizer.from_file(file), staged_path(spark, "t")
    tokenstore.write_tokens(odd, path, file, 2, shards=3)
    got = sorted(tokenstore.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["id"] for r in got] == sorted((i for i, _, _ in ODD), key=lambda i: (i is not None, i))
    want = sorted((repr(i), zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t, _ in ODD)
    assert sorted((repr(r["id"]), r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    row = spark.read.parquet(path).where("n_docs > 1").first()
    seg = tokenstore.Segment(row["data"])
    assert len(seg) == row["n_docs"] and all(seg.ids(i)[-1] == 2 for i in range(len(seg)))
    none = staged_path(spark, "t")
    tokenstore.write_tokens(empty, none, file, 2)
    assert tokenstore.read_tokens(spark, none).count() == 0


def test_factorization_machine_learns_a_pair():
    r = np.random.default_rng(0)
    sets = [np.unique(np.r_[r.integers(10, 400, 30), [1] if a else [], [2] if b else []].astype(int)) for a, b in r.random((3000, 2)) < 0.5]
    y = np.array([float(1 in s and 2 in s) for s in sets])
    n = np.array([len(s) for s in sets])
    fm = FactorizationMachine(1000).fit(np.concatenate(sets[:2000]), n[:2000], y[:2000])
    assert ((fm.margins(np.concatenate(sets[2000:]), n[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.9
    assert FactorizationMachine(5).margins(np.zeros(0, int), np.array([0, 0])).tolist() == [0.0, 0.0]


def test_toxicity(spark, odd, empty):
    r = random.Random(2)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(r.choices(vocabulary, k=40)) + (" scoundrel" if i % 4 == 0 else ""), "s") for i in range(800)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    held = [x for x in got if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["id"]).encode()) % 5 == 0) for x in got)
    assert sum(x["predicted"] == (x["id"] % 4 == 0) for x in held) > 0.97 * len(held)
    # labels of the fold that is held out change nothing
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(x["id"], x["score"]) for x in toxicity.toxicity(docs, other).collect()} == {(x["id"], x["score"]) for x in got}
    told = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert len(told) == len(ODD) and all(0 <= x["score"] <= 1 for x in told)
    assert toxicity.toxicity(empty, labels).count() == 0


def test_quality(spark, odd, empty):
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(400):
        w = r.choices(vocabulary, k=60)
        junk = i % 5
        if junk == 1:
            w = [x.upper() + "!!" for x in w]
        elif junk == 2:
            w = [x + "###" for x in w]
        elif junk == 3:
            w = [w[0]] * 60
        rows.append((i, " ".join(w) + ".", "s"))
    got = {x["id"]: x["kept"] for x in quality.classify(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(got[i] == (i % 5 in (0, 4)) for i in got) > 0.95 * len(got)
    assert quality.classify(odd).count() == len(ODD) and quality.accept(odd).columns == odd.columns
    assert quality.classify(empty).count() == 0 and quality.accept(empty).count() == 0


def plain_em(votes, rounds):
    """The same model, a document at a time."""
    of = len(votes[0])
    r = []
    for v in votes:
        bad = [i for i in range(of) if v[i] == 0]
        r.append([0.05 if bad else 0.95] + [(0.95 / len(bad) if i in bad else 0.0) if bad else 0.05 / of for i in range(of)])
    for _ in range(rounds):
        share = [(sum(x[k] for x in r) + 1) / (len(votes) + of + 1) for k in range(of + 1)]

        def rate(classes, j, prior):
            cast = sum(x[k] for x, v in zip(r, votes, strict=True) if v[j] >= 0 for k in classes)
            bad = sum(x[k] for x, v in zip(r, votes, strict=True) if v[j] == 0 for k in classes)
            return (bad + prior[0]) / (cast + sum(prior))

        rates = [[rate([0], j, quality.FALSE) for j in range(of)]]
        rates += [[rate([k], j, quality.KNOWN) if j == k - 1 else rate([c for c in range(1, of + 1) if c != j + 1], j, quality.OTHER) for j in range(of)] for k in range(1, of + 1)]
        r = []
        for v in votes:
            p = [share[k] * np.prod([rates[k][j] if v[j] == 0 else 1 - rates[k][j] for j in range(of) if v[j] >= 0]) for k in range(of + 1)]
            r.append([x / sum(p) for x in p])
    return np.array(r)


def planted_votes(n=3000):
    """Two kinds of junk, each seen by two labellers of four, and a fifth that objects at random."""
    r = np.random.default_rng(1)
    kind = r.choice(3, n, p=[0.85, 0.1, 0.05])
    votes = np.ones((n, 5), int)
    for j, (of, hit) in enumerate(((1, 0.95), (1, 0.8), (2, 0.95), (2, 0.8))):
        votes[:, j] = np.where((kind == of) & (r.random(n) < hit), 0, np.where(r.random(n) < 0.01, 0, 1))
    votes[:, 4] = np.where(r.random(n) < 0.2, 0, 1)
    votes[r.random((n, 5)) < 0.1] = -1
    return kind, votes


def test_em_weighs_labellers_as_shipped():
    kind, votes = planted_votes()
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    m = quality.expectation_maximisation(patterns, counts)
    good = m.posterior(patterns)[where.ravel()] >= 0.5
    any_bad = (votes == 0).any(1)
    # what one can know from the votes, given the rates that planted_votes() used
    rates = np.full((3, 5), 0.01)
    rates[1, :2], rates[2, 2:4], rates[:, 4] = (0.95, 0.8), (0.95, 0.8), 0.2
    z = np.log([0.85, 0.1, 0.05]) + (votes == 0) @ np.log(rates).T + (votes == 1) @ np.log1p(-rates).T
    best = (np.exp(z[:, 0]) >= np.exp(z[:, 1:]).sum(1)) == (kind == 0)
    assert (good == (kind == 0)).mean() > best.mean() - 0.01 and (~any_bad == (kind == 0)).mean() < 0.85
    assert abs(m.bad[0, 4] - 0.2) < 0.04 and m.accuracy[4] < 0.85 < m.accuracy[:4].min()
    assert quality.expectation_maximisation(np.zeros((0, 3), int), np.zeros(0, int)).share[0] > 0


def test_em_equals_a_document_at_a_time():
    _, votes = planted_votes(400)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    m = quality.expectation_maximisation(patterns, counts, rounds=5, settled=0)
    assert np.allclose(m.classes(patterns)[where.ravel()], plain_em(votes.tolist(), 5))


def test_digest_columns(spark):
    from symlattice.llm.queries import digests

    df = spark.createDataFrame([(1, [3, 14], b"xy"), (2, [], b"")], "id long, ids array<int>, decoded binary")
    got = {r["doc_id"]: r for r in digests(df).collect()}
    assert got[1]["ids_sha256"] == hashlib.sha256(b"3,14").hexdigest() and got[1]["decoded_sha256"] == hashlib.sha256(b"xy").hexdigest()
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_pipeline_stages(spark):
    import corpus_pipeline

    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(300)]
    rows = [(i, "\n".join(" ".join(r.choices(vocabulary, k=12)) for _ in range(3)), "en", f"s{i % 4}", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s1", 0), (101, "NOISE!! " * 40, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns, n = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, ""), "stage")
        n.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "line dedup":
            assert {x["doc_id"]: x["text"] for x in docs.collect()}[100] == ""
    assert n[0] == 61 and n[1] == n[0] and n[2] == 61 and before is not docs
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
