"""The queries opN_<name> over the driver's tables: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.llm import bpe, linededup, mixing, nearest, quality, sharding, simhash, tokenstore, toxicity, vectordedup
from symlattice.staging import staged_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, weak label, votes, and whether it stays."""
    done = quality.classify(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), F.col("quality_score").alias("score"), "weak_label", "votes", "kept")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at a cosine of 0.98 within its label, and its component."""
    return vectordedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(nearest.build_index(vectors), vectors.where(F.col("vec_id") % 100 == 0))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; labels of the fold that is held out are not seen."""
    done = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place among 40 shards under the law `rows`."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones, and which those are."""
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "removed_lines", F.size("removed_lines").cast("long").alias("n_removed"), "text")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of their bytes."""
    import public_tokenizers

    done = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return digests(done)


def digests(done: DataFrame) -> DataFrame:
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files say of every document."""
    import public_tokenizers

    path = staged_path(spark, "tokens")
    tokenstore.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenstore.read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_simhash": op3_simhash,
    "op4_nearest": op4_nearest,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_bpe": op9_bpe,
    "op10_token_files": op10_token_files,
}

#: Only what SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a) c LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = c.vec_id""",
}
