"""Whole texts in Arrow batches, tokenised chunk by chunk: each distinct chunk is given to a tokenizer library once per worker, within a bounded table.

A chunk begins at a text's start and at each single space between two characters that are no white space. No pre-token of a byte-level
tokenizer that splits as GPT-2 does, and no piece of a SentencePiece model that keeps space marks in front, runs over such a place, so the ids of a
text are those of its chunks in turn. The former also split at single line ends and between letters and punctuation (`words`).
Next to characters that might be white space or letters beyond Latin-1 nothing is cut, which is always right.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sweepframe.llm.common import runs_of, texts_of

#: Most chunks, and most bytes of these, that a worker remembers.
MOST_CHUNKS, MOST_BYTES = 600_000, 16 << 20
#: Bytes of text taken at a time.
STEP_BYTES = 3 << 20


def _bytes(which: str | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in which] if isinstance(which, str) else which] = True
    return out


_SOLID = _bytes(list(range(0x21, 256)))
#: Bytes that lead the white space of Unicode beyond ASCII, and other characters.
_DOUBT = _bytes([0xC2, 0xE1, 0xE2, 0xE3])
_LETTER = _bytes([*range(65, 91), *range(97, 123)])
#: Second bytes of the letters U+00C0 to U+00FF.
_LATIN = _bytes([b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])
_POINT = _bytes(".,;:!?")


def chunk_starts(data: np.ndarray, offsets: np.ndarray, words: bool) -> np.ndarray:
    """Where chunks begin in the joined texts of rows (offsets), in order."""
    n = len(data)
    mark, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    ends[offsets] = True
    blank = (data == 0x20) | (data == 0x0A) if words else data == 0x20
    at = np.flatnonzero(blank)
    at = at[(at > 2) & (at < n - 1)]
    before, after = data[at - 1], data[at + 1]
    fine = _SOLID[before] & _SOLID[after] & ~_DOUBT[after] & ~ends[at + 1] & ((before < 0x80) | ~(_DOUBT[data[at - 2]] | _DOUBT[data[at - 3]]))
    at = at[fine]
    mark[at] = True
    if words:
        mark[at[data[at] == 0x0A] + 1] = True
        at = np.flatnonzero(_POINT[data])
        at = at[at > 1]
        before = data[at - 1]
        mark[at[_LETTER[before] | (_LATIN[before] & (data[at - 2] == 0xC3))]] = True
    mark[offsets[:-1]] = True
    return np.flatnonzero(mark[:n])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k], ..., starts[k] + sizes[k] - 1 of each k in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Lists:
    """Many lists in one array: those at some places, in turn, are take(places)."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes.astype(np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def take(self, places: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.begins[places], self.sizes[places])]

    def plus(self, other: Lists) -> Lists:
        return Lists(np.concatenate((self.flat, other.flat)), np.concatenate((self.sizes, other.sizes)))


class Chunks:
    """`compute` turns distinct chunks into as many lists, for each of its results; those of chunks seen of late are remembered."""

    def __init__(self, compute: Callable[[list[bytes]], list[Lists]], words: bool, most: int = MOST_CHUNKS, step: int = STEP_BYTES):
        self.compute, self.words, self.most, self.step = compute, words, most, step
        self.seen, self.lists = pa.array([], pa.large_binary()), None

    def places(self, chunks: pa.Array) -> np.ndarray:
        """Where the results of these distinct chunks are in self.lists."""
        known = pc.index_in(chunks, value_set=self.seen)
        new = chunks.filter(pc.is_null(known))
        if len(new):
            if len(self.seen) and (len(self.seen) + len(new) > self.most or self.seen.nbytes + new.nbytes > MOST_BYTES):
                self.seen, self.lists = new[:0], None
                return self.places(chunks)
            found = self.compute(new.to_pylist())
            self.lists = found if self.lists is None else [a.plus(b) for a, b in zip(self.lists, found, strict=True)]
            self.seen = pa.concat_arrays([self.seen, new])
            known = pc.index_in(chunks, value_set=self.seen)
        return known.to_numpy(zero_copy_only=False).astype(np.int64)

    def steps(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, number of chunks per row, each chunk's place in self.lists) for steps of bounded bytes, or of one longer row."""
        data, offsets = texts_of(column)
        for i, j in runs_of(offsets, self.step):
            own, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not len(own):
                yield i, j, np.zeros(j - i, np.int64), np.zeros(0, np.int64)
                continue
            starts = chunk_starts(own, ends, self.words)
            bounds = np.append(starts, len(own)).astype(np.int64)
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(own))]).dictionary_encode()
            yield i, j, np.diff(np.searchsorted(starts, ends)), self.places(coded.dictionary)[coded.indices.to_numpy()]


def byte_tokenizer(path: str, special: bool) -> Callable[[list[bytes]], list[list[int]]]:
    """Ids of many chunks by the tokenizers library, on one thread; special: strings of special tokens are these tokens, as the library's default is."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special

    def encode(chunks: list[bytes]) -> list[list[int]]:
        # A few at a time: the library's own results are some hundred times as large as the ids.
        parts = (chunks[k : k + 2_000] for k in range(0, len(chunks), 2_000))
        return [e.ids for part in parts for e in tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False)]

    return encode


def id_lists(rows: list[list[int]]) -> Lists:
    sizes = np.array([len(r) for r in rows], np.int64)
    return Lists(np.fromiter((i for r in rows for i in r), np.uint32, int(sizes.sum())), sizes)
