"""Document quality from weak labels: heuristics vote, EM weighs them, a hashed linear scorer learns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlattice.llm.pretokens import give_back
from symlattice.llm.text import words
from symlattice.staging import Scratch, cut, sent

#: Features are hashed to so many numbers.
SIZE = 1 << 16
#: Documents that the scorer is fitted on at most: those whose texts have the least hashes.
SAMPLE = 20_000

#: Beta priors: votes of `bad` and others, for good texts, for the junk a labeller knows, and for other junk.
FALSE, KNOWN, OTHER = (1.0, 49.0), (9.0, 1.0), (1.0, 4.0)

#: Documents whose features a worker gets at a time.
BATCH_ROWS = 2000
#: Features of documents that are folded at a time.
FOLD = 1 << 18

#: Name: (bad from, good to) for a statistic that is large in bad texts; the other way round if bad < good.
LABELLERS: dict[str, tuple[float, float]] = {
    "marks": (0.06, 0.015),  # characters that are no letters, digits, blanks or common punctuation
    "shouting": (0.35, 0.12),  # upper case among the letters
    "decorated": (0.25, 0.05),  # words that end in two marks or more
    "bare": (0.10, 0.03),  # words without a letter or digit
    "echo": (0.10, 0.02),  # words equal to the one before
    "stutter": (0.08, 0.03),  # words equal to the last but one before
    "variety": (0.45, 0.60),  # log of the distinct words to log of the words
    "length": (2.0, 2.8),  # letters and digits in a word
    "bulk": (0.0, 1.0),  # words
}


def statistics(text: Column) -> dict[str, Column]:
    """A number for each labeller, null where it cannot be told. Null texts count as empty."""
    t, w = F.coalesce(text, F.lit("")), F.col("_words")
    n, chars = F.col("_n"), F.greatest(F.length(t), F.lit(1))
    upper, lower = F.col("_upper"), F.col("_lower")
    many = n >= 8
    return {
        "marks": F.when(n > 0, F.col("_marks") / chars),
        "shouting": F.when(upper + lower >= 20, upper / (upper + lower)),
        "decorated": F.when(many, F.col("_decorated") / n),
        "bare": F.when(many, F.col("_bare") / n),
        "echo": F.when(many, F.col("_echo") / n),
        "stutter": F.when(many, F.col("_stutter") / n),
        "variety": F.when(n >= 30, F.log(F.size(F.array_distinct(w)).cast("double")) / F.log(n.cast("double"))),
        "length": F.when(many, (upper + lower) / n),
        "bulk": n.cast("double"),
    }


def _votes(name: str, value: Column) -> Column:
    """1 for good, 0 for bad, -1 where the labeller abstains."""
    bad, good = LABELLERS[name]
    is_bad, is_good = (value >= bad, value <= good) if bad > good else (value <= bad, value >= good)
    return F.when(is_bad, 0).when(is_good, 1).otherwise(-1)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _votes (array<int>, one for each labeller) and _features (array<int>, hashed: the
    shapes of the words, repeats included, and the statistics in steps)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    # one shape character for each character of the text: A a 0, the marks as they are
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "\\p{Lu}", "A"), "[\\p{L}&&[^\\p{Lu}]]", "a"), "\\p{N}", "0")
    one = docs.withColumn("_words", words(F.col(text_col))).withColumn("_shape", shape)
    w = F.col("_words")
    tight = F.regexp_replace(F.regexp_replace(F.col("_shape"), "a{2,}", "aa"), "A{2,}", "AA")
    two = one.withColumns(
        {
            "_n": F.size(w),
            "_upper": F.length("_shape") - F.length(F.replace("_shape", F.lit("A"), F.lit(""))),
            "_lower": F.length("_shape") - F.length(F.replace("_shape", F.lit("a"), F.lit(""))),
            "_marks": F.length(F.regexp_replace("_shape", "[Aa0\\s.,;:'\"()?-]+", "")),
            "_shapes": words(tight),
            "_echo": F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))),
            "_stutter": F.size(F.filter(w, lambda x, i: x == F.get(w, i - 2))),
        }
    )
    three = two.withColumns(
        {
            "_decorated": F.regexp_count("_shape", F.lit("[^Aa0\\s]{2}(?!\\S)")),
            "_bare": F.regexp_count("_shape", F.lit("(?<!\\S)[^Aa0\\s]+(?!\\S)")),
        }
    )
    stats = statistics(F.col(text_col))
    steps = [F.xxhash64(F.lit(k), F.floor(F.coalesce(v, F.lit(-1.0)) * (20 if k not in ("length", "bulk") else 1))) for k, v in stats.items() if k != "bulk"]
    features = F.transform(F.concat(F.array(*steps), F.transform("_shapes", lambda s: F.xxhash64(s))), lambda h: F.pmod(h, F.lit(SIZE)).cast("int"))
    return three.select(*docs.columns, F.array(*[_votes(k, v) for k, v in stats.items()]).alias("_votes"), features.alias("_features"))


@dataclass
class LabelModel:
    """What EM made of the labellers: how common each class is (good first, then the junk that each
    labeller knows), and how often each labeller's vote is bad in each class, when it votes."""

    share: np.ndarray  # (1 + labellers,)
    bad: np.ndarray  # (1 + labellers, labellers)

    @property
    def accuracy(self) -> np.ndarray:
        """How often each labeller is right, where it does not abstain: `good` on good texts and `bad` on those it knows."""
        own = np.diag(self.bad[1:])
        return (self.share[0] * (1 - self.bad[0]) + self.share[1:] * own) / (self.share[0] + self.share[1:])

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """(votes, classes): the probability of each class given the votes."""
        against, cast = (votes == 0).astype(float), (votes >= 0).astype(float)
        z = np.log(self.share) + against @ np.log(self.bad).T + (cast - against) @ np.log1p(-self.bad).T
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.classes(votes)[:, 0]


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 300, settled: float = 1e-7) -> LabelModel:
    """votes: (patterns, labellers) of -1, 0, 1, each pattern seen counts times.

    A text is good or junk of one kind; each labeller knows one kind. Given the class the labellers
    answer independently, and an abstention says nothing. Estimated are the classes' shares and, for
    each labeller, how often it objects to good texts, to the junk it knows, and to junk of other
    kinds. So it counts who agrees with whom: a labeller that objects at random, alone, comes to be a
    labeller that objects to good texts, and a kind of junk that two labellers see is not outvoted by
    the others, who deny other kinds only. The rates have Beta priors (FALSE, KNOWN, OTHER) of a few
    documents' weight, which the data outweigh; nothing is clipped.
    """
    n, of = counts.astype(float), votes.shape[1]
    against, cast, own = (votes == 0).astype(float), (votes >= 0).astype(float), np.eye(of, dtype=bool)
    objected = against.sum(1, keepdims=True)
    # the first guess: any objection is probably right
    r = np.where(objected > 0, np.hstack([np.full((len(n), 1), 0.05), 0.95 * against / np.maximum(objected, 1)]), np.hstack([np.full((len(n), 1), 0.95), np.full((len(n), of), 0.05 / max(of, 1))]))
    for _ in range(rounds):
        w = n[:, None] * r
        b, s = w.T @ against, w.T @ cast

        def rate(x: np.ndarray, y: np.ndarray, prior: tuple[float, float]) -> np.ndarray:
            return (x + prior[0]) / (y + sum(prior))

        others = rate(np.where(own, 0, b[1:]).sum(0), np.where(own, 0, s[1:]).sum(0), OTHER)
        bad = np.vstack([rate(b[0], s[0], FALSE), np.where(own, rate(np.diag(b[1:]), np.diag(s[1:]), KNOWN)[:, None], others[None, :])])
        model = LabelModel((w.sum(0) + 1) / (n.sum() + of + 1), bad)
        new = model.classes(votes)
        if not len(n) or np.abs(new - r).max() < settled:
            break
        r = new
    return model


def _fold(lists: pa.Array, most: int = FOLD) -> pa.Array:
    """{terms, weights} for each list of features: its distinct ones, each with the root of its share of
    the list. About `most` features are worked on at a time, or one longer list."""
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    flat, at, sizes, terms, weights = lists.flatten(), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        length = np.diff(ends[at : to + 1])
        part = flat.slice(ends[at], ends[to] - ends[at]).to_numpy(zero_copy_only=False)
        key, count = np.unique(np.repeat(np.arange(to - at), length) * SIZE + part, return_counts=True)
        doc = key // SIZE
        sizes.append(np.bincount(doc, minlength=to - at))
        terms.append((key % SIZE).astype(np.int32))
        weights.append(np.sqrt(count / np.maximum(length[doc], 1)).astype(np.float32))
        at = to
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32())
    parts = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), kind)) for x, kind in ((terms, pa.int32()), (weights, pa.float32()))]
    return pa.StructArray.from_arrays(parts, ["terms", "weights"])


def _fit_scorer(lists: list[list[int]], values: list[list[float]], labels: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the hashed features and the bias, by AdaGrad on the logistic loss of soft labels."""
    w, bias = np.zeros(SIZE), 0.0
    if not len(labels):
        return w, bias
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    term, value = np.concatenate(lists).astype(np.int64), np.concatenate(values).astype(float)
    g = np.full(SIZE, 1e-6)
    gb = 1e-6
    for _ in range(rounds):
        m = bias + np.bincount(doc, value * w[term], len(labels))
        error = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels) / len(labels)
        grad = np.bincount(term, value * error[doc], SIZE) + decay * w / len(labels)
        g += grad**2
        gb += error.sum() ** 2
        w -= rate * grad / np.sqrt(g)
        bias -= rate * error.sum() / np.sqrt(gb)
    return w, bias


def folded(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with h (the text's XXH64), votes and f (its distinct features and their
    weights): all that the scorer needs of a text, in one pass over the texts, written once."""

    @F.arrow_udf("struct<terms:array<int>,weights:array<float>>")
    def fold(lists: pa.Array) -> pa.Array:
        out = _fold(lists)
        give_back()
        return out

    plain = docs.select(*keep, F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("h"))
    return cut(measured(plain, "_text").select(*keep, "h", F.col("_votes").alias("votes"), fold("_features").alias("f")), "folded", batch_rows=BATCH_ROWS)


def fit(seen: DataFrame, sample: int = SAMPLE):
    """(label model, weights, bias) from a folded() table. The votes of all documents are counted by
    pattern, of which there are 3 ** labellers at most; only the scorer is fitted on a sample: a row
    for each of the `sample` texts with the least hashes, as its few distinct features."""
    patterns = seen.groupBy("votes").agg(F.count("*").alias("n")).collect()
    votes = np.array([p["votes"] for p in patterns], np.int64).reshape(-1, len(LABELLERS))
    labels = expectation_maximisation(votes, np.array([p["n"] for p in patterns], np.int64))
    last = seen.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = seen.where(F.col("h") <= F.lit(last)) if last is not None else seen.limit(0)
    got = chosen.groupBy("h").agg(F.min(F.struct("votes", "f")).alias("r")).select("h", "r.votes", "r.f.terms", "r.f.weights").orderBy("h").toArrow()
    rows = got.to_pydict()
    sampled = np.array(rows["votes"], np.int64).reshape(-1, len(LABELLERS))
    weights, bias = _fit_scorer(rows["terms"], rows["weights"], labels.posterior(sampled))
    return labels, weights, bias


def score(seen: DataFrame, model) -> DataFrame:
    """A folded() table with weak_label and quality_score (doubles, 0 to 1; the latter by the scorer alone)."""
    labels, weights, bias = model
    packed = seen.sparkSession.sparkContext.broadcast((weights, bias))

    @F.arrow_udf("double")
    def judge(f: pa.Array) -> pa.Array:
        w, b = packed.value
        terms, values = f.field("terms"), f.field("weights")
        doc = np.repeat(np.arange(len(f)), terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        m = np.bincount(doc, values.flatten().to_numpy(zero_copy_only=False) * w[terms.flatten().to_numpy(zero_copy_only=False)], len(f))
        return pa.array(1 / (1 + np.exp(-np.clip(b + m, -500, 500))))

    rates = [(float(np.log(p)), [(0.0, float(x), float(y)) for x, y in zip(np.log(r), np.log1p(-r), strict=True)]) for p, r in zip(labels.share, labels.bad, strict=True)]
    # log likelihoods of the classes; an abstention adds nothing
    z = [sum((F.element_at(F.array(*map(F.lit, row)), F.col("votes")[j] + 2) for j, row in enumerate(rows)), F.lit(p)) for p, rows in rates]
    weak = 1 / F.aggregate(F.transform(F.array(*z[1:]), lambda x: F.exp(x - F.col("_z"))), F.lit(1.0), lambda a, x: a + x)
    return seen.withColumn("_z", z[0]).withColumn("weak_label", weak).withColumn("quality_score", judge("f")).drop("f", "_z")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cutoff: float = 0.5) -> DataFrame:
    """(id, quality_score, weak_label, votes, kept) for every row of docs: kept where the score is `cutoff` or more.

    Null texts count as empty; an empty text's score is that of few features, and so it is rejected
    where the labellers say so. Repeated rows get the same; other columns are not read; an empty
    table gives an empty one. Labels given by people are not used.
    """
    seen = folded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"])
    done = score(seen, fit(seen, sample))
    return done.select("id", "quality_score", "weak_label", "votes", (F.col("quality_score") >= cutoff).alias("kept"))


def accept(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, cutoff: float = 0.5) -> DataFrame:
    """The rows of docs that classify() keeps, all columns as they were. The rejected texts are told by
    their hashes, which are sent to all executors if they are few and joined by a shuffle if not."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    with Scratch(docs.sparkSession) as scratch:
        seen = folded(plain.select(F.col(text).alias("text")), [])
        bad = scratch.keep(cut(score(seen, fit(seen, sample)).where(F.col("quality_score") < cutoff).select(F.col("h").alias("_h")).distinct(), "rejected"))
    return plain.join(sent(bad), F.xxhash64(text) == F.col("_h"), "left_anti").toDF(*docs.columns)
