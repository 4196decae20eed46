"""Token ids as binary files: segments of concatenated ids with Elias-Fano document boundaries.

A segment is a byte string: the magic TKEF, a byte with the width of an id, three zero bytes, the
number of ids and the length of the boundary index as 64-bit numbers, the ids one after the other
(little-endian), and the index of the documents' starts and the end. A table of segments, one row
each, holds their place (shard, segment), the documents' ids and the bytes; Spark's Parquet writer
commits it, so that any store Spark writes will do and a lost executor leaves no half file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.llm.eliasfano import EliasFano
from symlattice.llm.pretokens import ChunkEncoder, give_back, slices
from symlattice.llm.ranking import before

MAGIC, _HEAD = b"TKEF", struct.Struct("<4sB3xQQ")
#: A segment is closed when it has so many ids; a longer document has one of its own.
SEGMENT_IDS = 1 << 20
#: Documents of a segment that are read at a time.
BLOCK = 4096


class Segment:
    """One segment read back; ids(i) are those of its i-th document, found by the index alone."""

    def __init__(self, data: bytes):
        magic, width, n_ids, n_index = _HEAD.unpack_from(data)
        if magic != MAGIC or width not in (2, 4):
            raise ValueError("not a token segment")
        self.all_ids = np.frombuffer(data, f"<u{width}", n_ids, _HEAD.size)
        self.starts = EliasFano.from_bytes(data[_HEAD.size + width * n_ids : _HEAD.size + width * n_ids + n_index])

    def __len__(self) -> int:
        return self.starts.n - 1

    def ids(self, i: int) -> np.ndarray:
        return self.all_ids[self.starts[i] : self.starts[i + 1]]


def segment_bytes(ids: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """ids: of all documents one after the other; counts: how many each has."""
    index = EliasFano.encode(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])).to_bytes()
    return _HEAD.pack(MAGIC, width, len(ids), len(index)) + ids.astype(f"<u{width}", copy=False).tobytes() + index


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> tuple[ChunkEncoder, int]:
    """The library's tokenizer of a file behind a cache of chunks, and the number of its ids; one for
    all tasks of a worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    # a byte-level token is written with one character for each of its bytes
    width = np.array([len(tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)

    def encode(texts: list[str]) -> list[bytes]:
        """All in one call where their tokens can be told apart by the bytes they stand for."""
        if len(texts) > 1 and texts[0][:1] == " " and texts[-1][:1] == " ":
            ends = np.cumsum(pc.binary_length(pa.array(texts, pa.string())).to_numpy(), dtype=np.int64)
            ids = np.array(tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, "<u4")
            covered = np.cumsum(width[ids])
            last = np.searchsorted(covered, ends)
            if len(ids) and last[-1] < len(ids) and (covered[last] == ends).all():
                data, cuts = ids.tobytes(), [0, *((last + 1) * 4).tolist()]
                return [data[a:b] for a, b in pairwise(cuts)]
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return ChunkEncoder(encode), size


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Writes the ids of all rows of docs, each with end_id after its last, in ascending order of the id.

    The rows are range-partitioned by id (null ids first, equal ids in order of their texts' hashes) to
    `shards` partitions, by default as many as spark.sql.shuffle.partitions; every task tokenizes its
    rows in order and holds one segment at a time. tokenizer_path is a file of the installation, at
    the same place on every machine. A null text counts as empty; its document is end_id alone. An
    empty table gives an empty table of segments. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    dealt = plain.repartitionByRange(shards, "id").sortWithinPartitions("id", F.xxhash64("t")).select(F.spark_partition_id().alias("shard"), "id", "t")
    kind = plain.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, size = shared_encoder(tokenizer_path)
        width = 2 if max(size - 1, end_id) < 1 << 16 else 4
        shard, segment, names, sizes, parts, held, types = None, 0, [], [], [], 0, None

        def flush() -> pa.RecordBatch:
            counts = np.concatenate(sizes)
            row = [[shard], [segment], [len(counts)], [held], [pa.concat_arrays(names).to_pylist()], [segment_bytes(np.concatenate(parts), counts, width)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["shard", "segment", "n_docs", "n_ids", "ids", "data"])

        for batch in batches:
            types = types or [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(batch.column(1).type), pa.binary()]
            shard = batch.column(0)[0].as_py() if shard is None and batch.num_rows else shard
            for at, texts in slices(batch.column(2)):
                ids, counts = chunks.batch(texts)
                ids, counts = np.insert(ids, np.cumsum(counts), end_id).astype(f"<u{width}"), counts + 1
                ends, i, past = np.cumsum(counts), 0, 0
                while i < len(counts):
                    # the document with which the segment is full is its last
                    to = min(len(counts), int(np.searchsorted(ends, past + SEGMENT_IDS - held)) + 1)
                    names.append(batch.column(1).slice(at + i, to - i))
                    sizes.append(counts[i:to])
                    parts.append(ids[past : ends[to - 1]])
                    held += int(ends[to - 1]) - past
                    i, past = to, int(ends[to - 1])
                    if held >= SEGMENT_IDS:
                        yield flush()
                        segment, names, sizes, parts, held = segment + 1, [], [], [], 0
            give_back()
        if names:
            yield flush()

    dealt.mapInArrow(work, f"shard int, segment int, n_docs int, n_ids long, ids array<{kind}>, data binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, shard, segment, place) for every document of a token table.

    start is the number of ids before the document in the whole table; ids_crc32 is taken over its
    ids as little-endian unsigned 32-bit numbers. Every document is found by its segment's index.
    """
    table = spark.read.parquet(path)
    offsets = before(table.select("shard", "segment", "n_ids"), [], "shard", [F.col("segment")], {"first": F.col("n_ids")}).select("shard", "segment", "first")
    kind = table.schema["ids"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment, names = Segment(batch.column(3)[i].as_py()), batch.column(2).slice(i, 1).flatten()
                for lo in range(0, len(segment), BLOCK):
                    hi = min(lo + BLOCK, len(segment))
                    starts = segment.starts.take(lo, hi + 1)
                    crc = [zlib.crc32(segment.all_ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                    columns = [pa.array([batch.column(k)[i].as_py()] * (hi - lo), pa.int32()) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(range(lo, hi), pa.int32()), names.slice(lo, hi - lo), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())],
                        ["shard", "segment", "place", "id", "local", "n_tokens", "ids_crc32"],
                    )

    found = table.select("shard", "segment", "ids", "data").mapInArrow(work, f"shard int, segment int, place int, id {kind}, local long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["shard", "segment"]).select("id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment", "place")


def fetch_tokens(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, ids array<long>) of the documents of a token table whose id is in `wanted`, each read alone:
    two selects on its segment's index give the range of its ids. Null ids are not found; a document
    that is stored several times comes as often."""
    table = spark.read.parquet(path)
    kind = table.schema["ids"].dataType.elementType.simpleString()
    places = table.select("shard", "segment", F.posexplode("ids").alias("place", "id")).join(wanted.select(F.col(id_col).alias("id")).distinct(), "id")
    of = places.groupBy("shard", "segment").agg(F.collect_list(F.struct("place", "id")).alias("docs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment, docs = Segment(batch.column(1)[i].as_py()), batch.column(0)[i].as_py()
                found = [segment.ids(d["place"]).astype(np.int64) for d in docs]
                yield pa.RecordBatch.from_arrays([pa.array([d["id"] for d in docs], batch.schema.field(0).type.value_type.field("id").type), pa.array(found, pa.list_(pa.int64()))], ["id", "ids"])

    return table.select("shard", "segment", "data").join(of, ["shard", "segment"]).select("docs", "data").mapInArrow(work, f"id {kind}, ids array<long>")
