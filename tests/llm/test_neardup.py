"""Near copies by Jaccard similarity against all pairs."""

import random

import pyarrow as pa
import pytest

from symlattice.llm import neardup, simhash

DOCS = "doc_id long, text string, source string"


def shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def planted(seed):
    """Copies with 1 to 9 words replaced, in groups of 1, 3 and 40, short texts, a common passage, blanks."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(400)]
    passage, out = r.choices(vocabulary, k=30), ["", None, "  ", "one", "One", "one two", "a b c d e", "a b c d e f"]
    for k in [1, 3, 3, 3, 3, 40]:
        base = r.choices(vocabulary, k=r.randint(60, 160)) + (passage if r.random() < 0.5 else [])
        for _ in range(k):
            w = base[:]
            for _ in range(r.randint(0, 9) if k > 1 else 0):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [2, 8, 64])
def test_components_are_those_of_all_pairs(spark, hot):
    texts = planted(hot)
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    got = neardup.jaccard_groups(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS), hot=hot, rounds=1).collect()
    assert sorted((x["id"], x["component"]) for x in got) == list(enumerate(label))


def majority(values):
    return sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in values) > len(values))


def test_simhash_finds_links_and_the_prefix_join_the_rest(spark, monkeypatch):
    """Pairs within the radius are links by SimHash; with prefixes that find nothing, just those are left."""
    import corpus_pipeline

    texts = planted(5)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    sets = [shingles(t) for t in texts]
    hashed = {s: h & (1 << 64) - 1 for s, h in spark.createDataFrame([(s,) for s in set().union(*sets)], "s string").selectExpr("s", "xxhash64(s)").collect()}
    fps = [majority([hashed[s] for s in x]) for x in sets]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    near = [(i, j) for i, j in pairs if (fps[i] ^ fps[j]).bit_count() <= neardup.DISTANCE]
    assert any(sets[i] != sets[j] for i, j in near) and len(near) < len(pairs)

    def components(links):
        label = list(range(len(texts)))
        for _ in texts:
            for i, j in links:
                label[i] = label[j] = min(label[i], label[j])
        return label

    assert components(near) != components(pairs)
    first = neardup.first_values

    def without_prefixes(*args):
        sig, n, bits, pre, fp = first(*args).flatten()
        return pa.StructArray.from_arrays([sig, n, bits, pa.array([[]] * len(pre), pre.type), fp], ["sig", "n", "bits", "pre", "fp"])

    assert sorted(x["doc_id"] for x in corpus_pipeline.keep_one_of_each_group(spark, df, "").collect()) == sorted(set(components(pairs)))
    monkeypatch.setattr(neardup, "first_values", without_prefixes)
    got = neardup.jaccard_groups(df, hot=64).collect()
    assert [x["component"] for x in sorted(got, key=lambda x: x["id"])] == components(near)


def test_pipeline_drops_planted_near_copies(spark):
    import corpus_pipeline

    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    near = base[:]
    for at in (30, 110):  # ten shingles of 196 change: similarity 186 / 206
        near[at] = "other"
    far = [f"w{r.randrange(10**6)}" for _ in range(200)]
    docs = spark.createDataFrame([(1, " ".join(base), "s"), (2, " ".join(near), "s"), (3, " ".join(far), "s")], DOCS)
    stage = corpus_pipeline.STAGES[2][1]
    assert {x["doc_id"] for x in stage(spark, docs, "").collect()} == {1, 3}
    assert {x["doc_id"] for x in simhash.keep_one(docs).collect()} >= {1, 3}
    assert stage(spark, docs.limit(0), "").count() == 0
