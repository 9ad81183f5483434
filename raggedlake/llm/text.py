"""Bounded slices of Arrow batches, and a bounded word-to-ids cache shared by the encoders."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at a time inside a Python worker (a longer text makes a slice alone).
SLICE_BYTES = 2 << 20
#: Words an encoder's cache holds before it starts again.
CACHE_WORDS = 1_000_000
#: Finds a space with white space or an end of the text on both sides.
APART = re.compile(r" (?!\S)(?<!\S )").search


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each is at most limit bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        size = pc.binary_length(arr).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(size), 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts as str; null is empty."""
    return [x or "" for x in column(batch, name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column(batch, name).cast(pa.binary()).to_pylist()]


def spaced_words(text: str) -> tuple[str, list[str]]:
    """A head and the words after it, each to be read with one space before it.

    Splitting patterns that attach a space to the following word match head and words separately just as they
    match the text. A space between two white-space characters belongs to a longer run; such a text is all head.
    """
    if APART(text):
        return text, []
    words = text.split(" ")
    return words[0], words[1:]


class WordIds:
    """Ids of words, each word encoded once while the cache lasts.

    encode_many maps a list of distinct words to a list of id sequences, or to all their ids and the lengths. The cache is cleared when it
    would pass its limit; results don't depend on that.
    """

    def __init__(self, encode_many: Callable[[list[str]], list], limit: int = CACHE_WORDS):
        self.encode_many, self.limit = encode_many, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.lens = np.zeros(1 << 12, np.int64)
        self.offs = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.int32)
        self.n_flat = 0

    def _add(self, words: list[str]) -> None:
        ids = self.encode_many(words)
        if isinstance(ids, tuple):
            joined, lens = ids
        else:
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            joined = np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum()))
        n0, n1 = len(self.index), len(self.index) + len(words)
        if n1 > len(self.lens):
            self.lens = np.concatenate([self.lens, np.zeros(max(n1, len(self.lens)), np.int64)])
            self.offs = np.concatenate([self.offs, np.zeros(max(n1, len(self.offs)), np.int64)])
        total = int(lens.sum())
        if self.n_flat + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.int32)])
        self.lens[n0:n1] = lens
        self.offs[n0:n1] = self.n_flat + np.cumsum(lens) - lens
        self.flat[self.n_flat : self.n_flat + total] = joined
        self.n_flat += total
        self.index.update(zip(words, range(n0, n1)))

    def lookup(self, words: list[str]) -> np.ndarray:
        """Positions of words in lens and offs, valid until the next call."""
        if not words:
            return np.empty(0, np.int64)
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new = list(dict.fromkeys([words[i] for i in miss]))
            if self.index and len(self.index) + len(new) > self.limit:
                self.clear()
                return self.lookup(words)
            self._add(new)
            at[miss] = np.fromiter((self.index[words[i]] for i in miss), np.int64, len(miss))
        return at

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words at these positions, one after the other."""
        lens = self.lens[at]
        total = int(lens.sum())
        if not total:
            return np.empty(0, np.int32)
        ends = np.cumsum(lens)
        return self.flat[np.arange(total) + np.repeat(self.offs[at] - (ends - lens), lens)]
