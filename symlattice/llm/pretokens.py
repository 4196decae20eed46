"""Texts as sequences of independent chunks, so that a tokenizer runs once for each distinct chunk.

The byte-level patterns never match across a space that has no blank on either side, except as the
match's first character. Cutting before every such space therefore changes no token, whatever the
merges are; whether that holds for a given tokenizer is tried on probes, and where it does not, whole
texts are encoded. Corpora repeat their chunks: those of a slice of texts are numbered by Arrow, and
only the distinct ones are looked up or encoded.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that end a chunk as a token of their own when all before them is letters.
MARKS = frozenset(".,;:!?")
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[ord(c) for c in MARKS]] = True
#: Characters of one text, and bytes of several, that are worked on at a time.
SPAN = 1 << 20
SLICE = 1 << 22
#: Chunks that a cache remembers, in each of its two halves; longer chunks than LONG are not remembered.
MOST, LONG = 1 << 19, 100
_PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: In RE2's terms: a space beside another blank of any kind, or at the end.
_ODD = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}] | [\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]| $"
_PROBES = ["a", "word", "Word", "it's", "don't", "I'll", "7", "42", "3.5", "x1", "über", "naïve", "слово", "字", "字典", "🙂", "(a)", "...", "a.", "a,", "--", "'s", "_", "a_b", "<|endoftext|>", "é", "́", "​", "日本語。", "a\nb", "\t"]

EncodeMany = Callable[[list[str]], list[bytes]]


def cuts_at_spaces(encode: EncodeMany) -> bool:
    """Whether, on all probes, what stands before a plain space and from it on are encoded by themselves,
    and a mark after a word of letters is."""
    pairs = [(a, " " + b) for a in _PROBES for b in _PROBES if _PLAIN_SPACE.search(f"{a} {b}")]
    pairs += [(lead + w, m) for w in ("word", "Word", "a", "I") for m in MARKS for lead in ("", " ")]
    whole = encode([a + b for a, b in pairs])
    first, second = encode([a for a, _ in pairs]), encode([b for _, b in pairs])
    return all(w == x + y for w, x, y in zip(whole, first, second, strict=True))


class _Cache:
    """Ids by chunk. When it is full it becomes the old half, which is asked once more before it goes."""

    def __init__(self, encode: EncodeMany, lead: str, most: int):
        self.encode, self.lead, self.most, self.now, self.old = encode, lead, most, {}, {}

    def many(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of some distinct chunks, as little-endian unsigned 32-bit numbers."""
        if len(self.now) >= self.most:
            self.now, self.old = {}, self.now
        now = self.now
        out = list(map(now.get, chunks))
        unknown = [i for i, ids in enumerate(out) if ids is None]
        if unknown and self.old:
            again = list(map(self.old.get, [chunks[i] for i in unknown]))
            for i, ids in zip(unknown, again, strict=True):
                if ids is not None:
                    out[i] = now[chunks[i]] = ids
            unknown = [i for i, ids in zip(unknown, again, strict=True) if ids is None]
        if unknown:
            words = [chunks[i] for i in unknown]
            found = self.encode([self.lead + w for w in words])
            for i, ids in zip(unknown, found, strict=True):
                out[i] = ids
            now.update(zip(words, found, strict=True) if max(map(len, words)) < LONG else ((w, ids) for w, ids in zip(words, found, strict=True) if len(w) < LONG))
        return out


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) for runs of rows of about `most` bytes together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        past = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, past + most, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def give_back() -> None:
    """Returns to the system what the allocators of this worker process hold without use: workers stay for
    the stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        pass


class ChunkEncoder:
    """Token ids of whole texts. encode gives the ids of each of a list of strings, as bytes of
    little-endian unsigned 32-bit numbers; `most` bounds the chunks remembered."""

    def __init__(self, encode: EncodeMany, most: int = MOST):
        self.encode, self.cuts = encode, cuts_at_spaces(encode)
        self.after_space, self.plain = _Cache(encode, " ", most), _Cache(encode, "", most)

    def forget(self) -> None:
        """Gives up the older halves of the caches: between tasks a worker holds what it met last."""
        for cache in (self.after_space, self.plain):
            cache.now, cache.old = (cache.now if len(cache.now) <= cache.most // 4 else {}), {}
        give_back()

    def ids(self, text: str) -> np.ndarray:
        """Unsigned 32-bit numbers; of a text without characters none."""
        if not self.cuts:
            return np.frombuffer(self.encode([text])[0], "<u4")
        parts = []
        for part in self._spans(text):
            chunks = ["", *_PLAIN_SPACE.split(part[1:])] if part[:1] == " " and part[1:2].strip() else _PLAIN_SPACE.split(part)
            parts.append(self._assembled(pa.array(chunks, pa.string()), np.array([0, len(chunks)]))[0])
        return np.concatenate(parts)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has); texts: strings without nulls."""
        if not self.cuts:
            parts = self.encode(texts.to_pylist())
            return np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts], np.int64)
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.greater(pc.binary_length(texts), SLICE)).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(texts)
        some, sizes = self._plain(texts.filter(pa.array(~odd)))
        rest = [self.ids(x) for x in texts.filter(pa.array(odd)).to_pylist()]
        lengths = np.zeros(len(texts), np.int64)
        lengths[~odd], lengths[odd] = sizes, [len(x) for x in rest]
        starts = np.zeros(len(texts), np.int64)
        starts[~odd], starts[odd] = _starts(sizes), len(some) + _starts(lengths[odd])
        return np.concatenate([some, *rest])[_ranges(starts, lengths)], lengths

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        # every text has one chunk at least
        return self._assembled(lists.flatten(), ends - ends[0])

    def _assembled(self, chunks: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for texts whose chunks lie one after the other; all but each text's first
        come after a space."""
        first = np.zeros(len(chunks), bool)
        first[ends[:-1]] = True
        items, kind = _without_marks(chunks, first)
        told = items.dictionary_encode()
        words, codes = told.dictionary.to_pylist(), told.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # the same characters have other ids at the beginning of a text, and as a mark
        used = [np.flatnonzero(np.bincount(codes[of], minlength=len(words))) for of in (kind != 1, kind == 1)]
        known = [cache.many([words[i] for i in u.tolist()]) for cache, u in zip((self.plain, self.after_space), used, strict=True)]
        place = [np.zeros(len(words), np.int64) for _ in known]
        for k, u in enumerate(used):
            place[k][u] = np.arange(len(u)) + (len(known[0]) if k else 0)
        which = np.where(kind == 1, place[1][codes], place[0][codes])
        size = np.array(list(map(len, known[0] + known[1])), np.int64) // 4
        lengths = size[which]
        ids = np.frombuffer(b"".join(known[0] + known[1]), "<u4")[_ranges(_starts(size)[which], lengths)]
        begin = np.flatnonzero(kind != 2)[ends[:-1]]
        return ids, np.add.reduceat(lengths, begin) if len(begin) else np.zeros(0, np.int64)

    @staticmethod
    def _spans(text: str) -> Iterator[str]:
        """Parts of about SPAN characters that begin at a cut, or the rest where there is none."""
        at = 0
        while len(text) - at > SPAN and (cut := _PLAIN_SPACE.search(text, at + SPAN)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text


def _without_marks(chunks: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(items, kind): the chunks, those of unaccented letters and a mark as two items. kind is 0 for the
    first chunk of a text, 1 for a later one and 2 for a mark; marks are encoded like first chunks."""
    chunks = chunks if chunks.offset == 0 else pa.concat_arrays([chunks])
    ends = np.frombuffer(chunks.buffers()[1], np.int32, len(chunks) + 1).astype(np.int64)
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
    if not ends[-1]:
        return chunks, np.where(first, 0, 1)
    others = np.concatenate([[0], np.cumsum(~_LETTER[data[: ends[-1]]], dtype=np.int64)])
    last = data[np.maximum(ends[1:] - 1, 0)]
    cut = (ends[1:] - ends[:-1] > 1) & _MARK[last] & (others[ends[1:]] - others[ends[:-1]] == 1)
    size = 1 + cut
    at = _starts(size)
    kind = np.full(int(size.sum()), 2)
    kind[at] = np.where(first, 0, 1)
    offsets = np.empty(len(kind) + 1, np.int32)
    offsets[at], offsets[-1] = ends[:-1], ends[-1]
    offsets[at[cut] + 1] = ends[1:][cut] - 1
    return pa.StringArray.from_buffers(len(kind), pa.py_buffer(offsets), chunks.buffers()[2]), kind


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths, dtype=np.int64) - lengths


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... lengths[0] of them, then those from starts[1], and so on."""
    return np.repeat(starts - _starts(lengths), lengths) + np.arange(int(lengths.sum()))
