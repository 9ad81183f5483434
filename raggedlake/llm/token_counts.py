"""Exact token counts at every prefix of a text (byte-level BPE), by prefix dynamic programming.

Let a piece be one match of the splitting pattern. The encoding of a byte prefix of a piece is fixed by its
last token: prefix i ends in token t when prefix i - len(t) ends in a token u such that the merges leave the
pair (u, t) as it is. So count[i] = count[i - len(t)] + 1 gives the exact count at every prefix in one pass,
without running the merges over the piece. Across pieces counts add up; only a prefix that ends in white
space regroups the white-space run it ends in.

Defined results: a null text counts as empty (0 tokens, 0 bytes); rows may repeat and each is answered;
columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raggedlake.llm.text import CACHE_WORDS, WordIds, byte_chars, column, slices, spaced_words, texts
from raggedlake.plans.session import prepare_workers, table

#: Pairs of tokens whose stability is remembered; the memory is emptied beyond that.
PAIR_LIMIT = 1_000_000
SPACES = regex.compile(r"\s+")


class PrefixCounter:
    """Counts of one vocabulary file (byte-level BPE, the tokenizers JSON format)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_chars()
        raw = lambda s: bytes(back[c] for c in s)
        self.vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if all(c in back for c in k)}
        self.merges: dict[tuple[int, int], int] = {}  # rank of a pair
        self.made: dict[int, tuple[int, int, int]] = {}  # rank and parts of a token
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            pair = self.vocab[a], self.vocab[b]
            self.merges[pair] = rank
            self.made.setdefault(self.vocab[a + b], (rank, *pair))
        self.endings = dict.fromkeys((t[k:] for t in self.vocab for k in range(1, len(t))), -1) | self.vocab
        self.specials = sorted((t["content"] for t in spec.get("added_tokens", []) if t["special"]), key=len, reverse=True)
        self.pattern = regex.compile(pattern)
        self.stable: dict[tuple[int, int], bool] = {}
        self.words = WordIds(self.word_totals)
        self.pieces: dict[str, int] = {}
        self.whole = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    def is_stable(self, a: int, b: int) -> bool:
        """Whether the merges leave neighbours a, b as they are.

        Undo the later of the two tokens' own merges, again and again: if at any point the tokens that then
        touch would merge before the one just undone, the pair can't stand. Of equal ranks the left goes first.
        """
        known = self.stable.get((a, b))
        if known is not None:
            return known
        pair, limit, merges, made = (a, b), len(self.merges) + 1, self.merges, self.made
        while True:
            m = merges.get((a, b))
            if m is not None and m < limit:
                known = False
                break
            ra, rb = made.get(a), made.get(b)
            if ra is None and rb is None:
                known = True
                break
            if rb is None or (ra is not None and ra[0] > rb[0]):
                limit, a = ra[0], ra[2]
            else:
                limit, b = rb[0] + 1, rb[1]
        if len(self.stable) >= PAIR_LIMIT:
            self.stable.clear()
        self.stable[pair] = known
        return known

    def piece_counts(self, data: bytes) -> list[int]:
        """Counts at the prefixes 0..len(data) of one piece's bytes."""
        return self.extend(data, [-1], [0])[1]

    def extend(self, data: bytes, last: list[int], count: list[int]) -> tuple[list[int], list[int]]:
        """Go on from the prefixes that last and count hold already, in place, to all of data."""
        n, get, stable = len(data), self.endings.get, self.stable.get
        done = len(last)
        last += [-1] * (n + 1 - done)
        count += [0] * (n + 1 - done)
        for i in range(done, n + 1):
            found = []
            for j in range(i - 1, -1, -1):
                t = get(data[j:i])
                if t is None:
                    break
                if t >= 0:
                    found.append((j, t))
            for j, t in reversed(found):  # longest first
                if j:
                    ok = stable((last[j], t))
                    if ok is None:
                        ok = self.is_stable(last[j], t)
                    if not ok:
                        continue
                last[i], count[i] = t, count[j] + 1
                break
        return last, count

    def word_totals(self, words: list[str]) -> list[tuple[int]]:
        """Totals of words, each with a space before it. Sorted pieces go on from the prefix they share."""
        split = [self.pattern.findall(" " + w) for w in words]
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        before, last, count = b"", [-1], [0]
        for data, piece in sorted((p.encode(), p) for p in {p for x in split for p in x} if p not in self.pieces):
            same, most = 0, min(len(before), len(data))
            while same < most and before[same] == data[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            self.extend(data, last, count)
            self.pieces[piece], before = count[-1], data
        get = self.pieces.__getitem__
        return [(sum(map(get, x)),) for x in split]

    def piece_total(self, text: str) -> int:
        return sum(self.piece_counts(p.encode())[-1] for p in self.pattern.findall(text))

    def totals(self, batch: list[str]) -> list[int]:
        """Token counts of texts; special strings count one token each, as the library counts them."""
        out = [0] * len(batch)
        flat, sizes, where = [], [], []
        for k, text in enumerate(batch):
            if self.whole is not None and "<|" in text and self.whole.search(text):
                parts = self.whole.split(text)
                out[k] = sum(self.totals(parts)) + len(parts) - 1
            elif text:
                head, words = spaced_words(text)
                out[k] = self.piece_total(head)
                if words:
                    flat += words
                    sizes.append(len(words))
                    where.append(k)
        if flat:
            at = self.words.lookup(flat)
            ends = np.cumsum(sizes)
            sums = np.concatenate([[0], np.cumsum(self.words.flat[self.words.offs[at]], dtype=np.int64)])
            for k, stop, size in zip(where, ends, sizes):
                out[k] += int(sums[stop] - sums[stop - size])
        return out

    def prefix_table(self, text: str) -> np.ndarray:
        """The token count of every prefix text[:0], text[:1], ... as the library counts it, special strings included."""
        counts, start = np.zeros(len(text) + 1, np.int64), 0
        for m in self.whole.finditer(text) if self.whole is not None else ():
            # a prefix that ends inside a special string holds its beginning as plain text
            counts[start : m.end()] = counts[start] + self.plain_table(text[start : m.end() - 1])
            counts[m.end()] = counts[m.start()] + 1
            start = m.end()
        counts[start:] = counts[start] + self.plain_table(text[start:])
        return counts

    def plain_table(self, text: str) -> np.ndarray:
        """prefix_table() of a text without special strings: the counts inside each piece, added up."""
        counts, pos, total, before = np.zeros(len(text) + 1, np.int64), 0, 0, {0: 0}
        for p in self.pattern.findall(text):
            got = self.char_counts(p)
            if p[0] == "'":  # a contraction that is cut short is no contraction
                got = [self.piece_total(p[:k]) for k in range(len(p))] + got[-1:] if len(p) <= 3 else got
            counts[pos : pos + len(p) + 1] = [total + n for n in got]
            pos, total = pos + len(p), total + got[-1]
            before[pos] = total
        for m in SPACES.finditer(text):  # a final white-space run is one piece
            counts[m.start() : m.end() + 1] = [before[m.start()] + n for n in self.char_counts(m[0])]
        return counts

    def char_counts(self, piece: str) -> list[int]:
        """Counts at the prefixes of one piece that end at a character."""
        got, at, out = self.piece_counts(piece.encode()), 0, [0]
        for c in piece:
            at += len(c.encode())
            out.append(got[at])
        return out

    def count_at(self, text: str, stop: int, stored: np.ndarray) -> int:
        """Exact count of text[:stop], from the stored table alone."""
        return int(stored[max(0, min(stop, len(text)))])

    def truncate(self, text: str, budget: int, stored: np.ndarray) -> int:
        """The length of the longest prefix that takes at most budget tokens (a longer prefix may take fewer tokens)."""
        return int(np.flatnonzero(stored <= max(budget, 0))[-1])


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, n_tokens, and over_limit (n_tokens > limit)."""
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for b in slices(batches):
            got = texts(b)
            n = np.array(c.totals(got), np.int64)
            size = pc.binary_length(column(b, "text")).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([column(b, "id"), size, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def budget_cuts(docs: DataFrame, path: str, pattern: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens of the whole, cut_chars and cut_tokens of its longest prefix within budget."""
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for b in slices(batches):
            rows = []
            for text in texts(b):
                stored = c.prefix_table(text)
                cut = c.truncate(text, budget, stored)
                rows.append((int(stored[-1]), cut, c.count_at(text, cut, stored)))
            cols = [pa.array(x, pa.int64()) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays([column(b, "id"), *cols], ["id", "n_tokens", "cut_chars", "cut_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, cut_chars long, cut_tokens long")
    return out.withColumnRenamed("id", id_col)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_counts(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN)
