"""Byte-level BPE: merges picked by a queue of ranks under a hierarchical bitmap."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.llm.pretokens import MOST, ChunkEncoder, give_back, slices


BIT = [1 << i for i in range(256)]


class RankQueue:
    """A priority queue over ranks. Each rank has a bucket of positions, least first.

    A bit for each rank says whether its bucket has entries, in words of 256 bits; a bit of the word
    above says whether any of them is set. push and pop touch one word on either level, whatever the
    length of the text: the least rank is found by two find-first-set operations.
    """

    def __init__(self, n: int):
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((n + 255) >> 8)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.words[rank >> 8] |= BIT[rank & 255]
            self.top |= 1 << (rank >> 8)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """The least rank and its least position, which leaves the queue; it must not be empty."""
        top = self.top
        at = (top & -top).bit_length() - 1
        word = self.words[at]
        rank = at << 8 | ((word & -word).bit_length() - 1)
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        word &= word - 1  # without the bit found
        self.words[at] = word
        if not word:
            self.top = top & (top - 1)
        return rank, bucket[0]


class Codec:
    """Encoding and decoding by a table of ranks, each match of the pattern by itself; no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = MOST):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.vocabulary: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.queue = RankQueue(len(self.vocabulary))
        self.of_two = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        # Rust's \s is the property White_Space; Python's has the four separators 1C to 1F besides
        self.matches = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}")).findall
        self.pieces, self.most = dict[str, list[int]](), max(1, most // 4)
        self.chunks = ChunkEncoder(lambda texts: [array("I", self.encode_chunk(t)).tobytes() for t in texts], most)

    @classmethod
    def from_file(cls, path: str, pattern: str, most: int = MOST) -> Codec:
        """path: lines of a base64 token and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}, pattern, most)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: of all adjacent pairs that form a token the least rank, of equal
        ranks the leftmost, is merged until none is left."""
        ranks, queue = self.ranks, self.queue
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n, get, longest, of_two = len(piece), ranks.get, self.longest, self.of_two
        # a token begins at i and ends before end[i]; pair[i] is the rank of it and the next one, or -1
        end, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [of_two[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        pair.append(-1)
        # push and pop of the queue, which is empty before and after, without their calls
        buckets, words, top = queue.buckets, queue.words, queue.top
        # a pair whose neighbour goes first is not pushed before that neighbour changes
        waits, last = [False] * (n + 1), -1
        for i, rank in enumerate(pair):
            if rank < 0:
                last = -1
                continue
            after = pair[i + 1]
            if 0 <= last <= rank or 0 <= after < rank:
                waits[i] = True
            elif rank in buckets:
                buckets[rank].append(i)  # positions ascend: the bucket stays a heap
            else:
                buckets[rank] = [i]
                words[rank >> 8] |= BIT[rank & 255]
                top |= 1 << (rank >> 8)
            last = rank
        while top:
            at = (top & -top).bit_length() - 1
            word = words[at]
            rank = at << 8 | ((word & -word).bit_length() - 1)
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                word &= word - 1
                words[at] = word
                if not word:
                    top &= top - 1
            if pair[i] != rank:  # stale: a neighbour was merged meanwhile
                continue
            h, j = before[i], end[i]
            pair[j] = -1
            j = end[i] = end[j]
            before[j] = i
            changed = []
            waits[i] = False
            pair[i] = rank = get(piece[i : end[j]], -1) if j < n and end[j] - i <= longest else -1
            if rank >= 0:
                changed.append(i)
            if h >= 0:
                waits[h] = False
                pair[h] = rank = get(piece[h:j], -1) if j - h <= longest else -1
                if rank >= 0:
                    changed.append(h)
                h = before[h]
                if h >= 0 and waits[h]:
                    waits[h] = False
                    changed.append(h)
            if waits[j]:
                waits[j] = False
                changed.append(j)
            for i in changed:
                rank = pair[i]
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= BIT[rank & 255]
                    top |= 1 << (rank >> 8)
        out, i = [], 0
        while i < n:
            j = end[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def encode_chunk(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.matches(text):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) < 64:
                    if len(self.pieces) >= self.most:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            out += ids
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.chunks.ids(text or "")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def shared_codec(path: str, pattern: str) -> Codec:
    """One codec for all tasks of a worker process, so that its vocabulary and chunks are learnt once."""
    return Codec.from_file(path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) for every row of docs: its text's token ids and their bytes again.

    ranks_path is a file of the installation, at the same place on every machine. A null text counts as
    empty and has no ids; repeated rows are encoded each; ids may be null. One pass over the rows, no
    shuffle; a worker holds the vocabulary, a bounded cache of chunks and texts of about 4 MB, or one
    longer text, at a time. Other
    columns of docs are not read.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    schema = plain.select("id", F.array(F.lit(0)).alias("ids"), F.lit(b"").alias("decoded")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(ranks_path, pattern)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, counts = codec.chunks.batch(pc.fill_null(texts, ""))
                ends = _ends(counts)
                decoded = [codec.decode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists, pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])
            give_back()
        codec.chunks.forget()

    return plain.mapInArrow(work, schema)


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
