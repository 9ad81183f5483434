"""Harmonic packing of token sequences, each worker for itself.

A document's ids are cut into full sequences and a rest. A piece of length L lies in class j = capacity // L
(capacity / (j + 1) < L <= capacity / j), and a bin of class j takes j pieces of that class: no search over
open bins, one open bin a class, no talk between workers. A rest whose class would waste more than
`waste` of its share capacity / j is cut at the next class boundary capacity // (j + 1) and the remainder is
classed again. Bins that are still open when a worker's rows end are joined end to end into full sequences,
and what is then left is cut at powers of two, where no padding is needed.

Defined results: a null text counts as empty and gives one piece, the end id alone. Rows may repeat: each row
is packed. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raggedlake.llm.byte_bpe import RANK, displaced
from raggedlake.llm.text import WordIds, byte_chars, column, slices, texts
from raggedlake.plans.session import prepare_workers, table

CAPACITY = 2048
#: Share of a class's capacity that a piece may leave unused before it is cut instead.
WASTE = 1 / 32
#: The tokenizer's file cuts normalised words into '(s|t|re|ve|m|ll|d), [\p{L}]+, [\p{N}] and [^\s\p{L}\p{N}]+; the kinds of characters in it.
SPACE, LETTER, DIGIT, SIGN = range(4)
KINDS = regex.compile(r"(\s)|(\p{L})|(\p{N})|[^\s\p{L}\p{N}]")
#: Words whose ids a worker remembers; bytes of a piece that the library merges.
MOST_WORDS, LONG = 500_000, 64
#: sequence_id is the task's partition number shifted by so many bits, plus a running number.
TASK_BITS = 38


def kind(char: str) -> int:
    return (KINDS.match(char).lastindex or 4) - 1


class Merger:
    """Byte-level BPE with an end-of-word suffix, for many short pieces at once.

    Pieces of one length are the rows of a matrix of symbols. Each step makes one merge in every row that has one left,
    the lowest rank and of equals the leftmost, so rows that go on stay of one length.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rank = {(vocab[a], vocab[b]): k for k, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.none = len(pairs)
        table = np.array(sorted((a, b, k) for (a, b), k in rank.items()), np.int64).reshape(-1, 3)
        shift, slots = displaced(table, max(vocab.values()) + 1)
        self.shift = shift.astype(np.int32)
        self.left = (slots >> RANK).astype(np.int32)
        self.rank = (slots & ((1 << RANK) - 1)).astype(np.int32)
        back = {v: k for k, v in byte_chars().items()}
        self.inner = np.array([vocab[back[i]] for i in range(256)], np.int32)
        self.final = np.array([vocab[back[i] + end] for i in range(256)], np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.shift[a] + b
        return np.where(self.left[at] == a, self.rank[at], self.none)

    def merge(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbols to rows of ids, and how many of each row count."""
        out, count = sym.copy(), np.ones(len(sym), np.int64)
        rows = np.arange(len(sym))
        rank = self.ranks(sym[:, :-1], sym[:, 1:])
        while sym.shape[1] > 1:
            at = rank.argmin(1)
            low = rank[np.arange(len(rank)), at]
            go = low < self.none
            if not go.all():
                out[rows[~go], : sym.shape[1]] = sym[~go]
                count[rows[~go]] = sym.shape[1]
                sym, rank, rows, at, low = sym[go], rank[go], rows[go], at[go], low[go]
            if not len(rows):
                return out, count
            each = np.arange(len(rows))
            later = np.arange(sym.shape[1] - 1) > at[:, None]
            sym = np.where(later, sym[:, 1:], sym[:, :-1])
            sym[each, at] = new = self.made[low]
            rank = np.where(later[:, :-1], rank[:, 1:], rank[:, :-1])
            i = np.flatnonzero(at > 0)
            rank[i, at[i] - 1] = self.ranks(sym[i, at[i] - 1], new[i])
            i = np.flatnonzero(at < sym.shape[1] - 1)
            rank[i, at[i]] = self.ranks(new[i], sym[i, at[i] + 1])
        out[rows, :1] = sym
        return out, count


class WordEncoder:
    """Ids of whole texts under a tokenizer that drops white space, so that words encode separately."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Merger(path)
        self.words = WordIds(self.word_ids, MOST_WORDS)
        self.kinds = np.array([kind(chr(c)) for c in range(1 << 16)], np.uint8)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has; the library encodes words that may hold a special string or a contraction."""
        odd = np.fromiter(("'" in w or "<|" in w for w in words), bool, len(words))
        if not odd.any():
            return self.plain_ids(words)
        ids, lens = self.plain_ids([w for w, o in zip(words, odd.tolist()) if not o])
        found = self.library_ids([w for w, o in zip(words, odd.tolist()) if o])
        size = np.empty(len(words), np.int64)
        size[~odd], size[odd] = lens, list(map(len, found))
        out, mine = np.empty(int(size.sum()), np.int32), np.repeat(odd, size)
        out[~mine], out[mine] = ids, list(chain.from_iterable(found))
        return out, size

    def library_ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """word_ids() of words without apostrophes and special strings: pieces are runs of letters, digits, and runs of other signs."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        text = " ".join(words)  # no word holds a space
        if not text.isascii():
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        raw = np.frombuffer(text.encode(), np.uint8)
        code = raw if len(raw) == len(text) else np.frombuffer(text.encode("utf-32-le"), "<u4")
        if code is raw:
            kinds = self.kinds[code]
        else:
            kinds = self.kinds[np.minimum(code, 0xFFFF)]
            for c in np.unique(code[code > 0xFFFF]).tolist():
                kinds[code == c] = kind(chr(c))
        new = (kinds != SPACE) & ((kinds == DIGIT) | (np.concatenate([[SPACE], kinds[:-1]]) != kinds))
        last = (kinds != SPACE) & np.append(new[1:] | (kinds[1:] == SPACE), True)
        start, stop = np.flatnonzero(new), np.flatnonzero(last) + 1
        word = np.cumsum(code == 32)[start]
        if code is not raw:
            place = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000).astype(np.int64))])
            start, stop = place[start], place[stop]
        ids, count = self.piece_ids(raw, start, stop)
        return ids, np.bincount(word, count, len(words)).astype(np.int64)

    def piece_ids(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at these places of raw, one after the other, and how many each has."""
        size = stop - start
        count, done = np.empty(len(size), np.int64), []
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order], prepend=0, append=1 << 62))
        for i, j in zip(cuts, cuts[1:]):
            some, n = order[i:j], int(size[order[i]])
            if n > LONG:
                found = self.library_ids([raw[start[k] : stop[k]].tobytes().decode() for k in some.tolist()])
                count[some] = list(map(len, found))
                done.append((some, np.fromiter(chain.from_iterable(found), np.int32), None))
                continue
            data = raw[start[some][:, None] + np.arange(n)]
            sym = self.merger.inner[data]
            sym[:, -1] = self.merger.final[data[:, -1]]
            got, count[some] = self.merger.merge(sym)
            done.append((some, got, np.arange(n) < count[some][:, None]))
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for some, got, mask in done:
            if mask is None:
                n = count[some]
                out[np.arange(int(n.sum())) + np.repeat(at[some] - (np.cumsum(n) - n), n)] = got
            else:
                out[(at[some][:, None] + np.arange(mask.shape[1]))[mask]] = got[mask]
        return out, count

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        # lower case of A-Z first: the tokenizer lowers them anyway, and fewer words are distinct
        split = [t.encode().lower().decode().split(" ") if t else [] for t in batch]
        at = self.words.lookup([w for x in split for w in x])
        ids, ends = self.words.gather(at), np.concatenate([[0], np.cumsum(self.words.lens[at])])
        cuts = ends[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut(length: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Piece lengths of a document of this many tokens."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        j = capacity // rest
        if j * rest >= capacity * (1 - waste):
            out.append(rest)
            break
        size = capacity // (j + 1)  # the largest class boundary below the rest
        out.append(size)
        rest -= size
    return out


class HarmonicBins:
    """The open bins of one worker; place() and close() yield (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, waste: float = WASTE):
        self.next_id, self.capacity, self.waste = first_id, capacity, waste
        self.open: dict[int, list] = {}

    def _emit(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.next_id, offset
            offset += len(ids)
        self.next_id += 1

    def place(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for size in cut(len(ids), self.capacity, self.waste):
            j = self.capacity // size
            pieces = self.open.setdefault(j, [])
            pieces.append((doc, start, ids[start : start + size], len(ids)))
            if len(pieces) == j:
                yield from self._emit(self.open.pop(j))
            start += size

    def close(self) -> Iterator[tuple]:
        left = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        left.reverse()
        for size in sizes:
            pieces, room = [], size
            while room:
                doc, start, ids, n = left.pop()
                if len(ids) > room:
                    left.append((doc, start + room, ids[room:], n))
                    ids = ids[:room]
                pieces.append((doc, start, ids, n))
                room -= len(ids)
            yield from self._emit(pieces)


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, waste: float = WASTE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids on request."""
    prepare_workers(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        bins = HarmonicBins(TaskContext.get().partitionId() << TASK_BITS, capacity, waste)
        id_type = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, seq, offset = zip(*rows)
            cols = [pa.array(doc, id_type), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), *(pa.array(x, pa.int64()) for x in (total, seq, offset))]
            if with_ids:
                cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, ["id", *fields, *["ids"] * with_ids])

        for b in slices(batches):
            id_type = column(b, "id").type
            rows = []
            for doc, ids in zip(column(b, "id").to_pylist(), enc.encode(texts(b))):
                rows += bins.place(doc, np.append(ids, end_id).astype("<u4"))
            if rows:
                yield batch(rows)
        if rows := list(bins.close()):
            yield batch(rows)

    schema = f"id {kind}, " + ", ".join(f"{k} long" for k in fields) + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
