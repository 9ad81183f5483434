"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A piece (a match of the splitting pattern) is an array of cells, one a byte at first and one more at each end; aggregate() folds the
ranked merges over it, each step joining the neighbours of the lowest rank, the leftmost of equals, until no neighbours have a
rank. A cell is one number: the symbol that it and its right neighbour make, its place, and its own symbol; so the least cell is the
next merge, and a merge looks up two pairs, whatever the piece's length. A symbol is its token's rank and one. The rank map is a
literal: pair (a, b) lies in slot shift[a] + b of one array, which holds a and the pair's symbol (a displaced table; a look-up in a
Spark map would read it from end to end). Decoding looks each text's ids up in an array of the tokens' bytes.

Each distinct piece is folded once where that is worth a look-up: pieces are counted over the whole table (one row a
task and piece that its texts hold twice or more), those that most tasks meet, at most COMMON, are folded once and broadcast, and a
task folds the others that its own texts hold, each once. Which pieces are common changes the cost alone, never a result. Texts are
read twice and never shuffled. A worker then puts the texts' ids together from those of their pieces.

A fold copies the array at each step, so a piece of more than LONG bytes (a word of base64, say) is merged by the worker
with a heap instead: the same merges in the same order, in n log n steps.

Defined results: a null text is empty: no ids. Rows may repeat. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raggedlake.llm.text import WordIds, column, slices, spaced_words, texts
from raggedlake.plans.session import drop_materialized, materialize, prepare_workers, table

#: Text bytes after which a row is sent; pieces that a task remembers before it starts again, and words; bytes of a piece that is folded.
CHUNK, PIECES, WORDS, LONG = 1 << 19, 300_000, 200_000, 256
#: Text bytes that a worker reads at a time, and new pieces after which a row is sent, as their cells take many times their bytes.
READ, NEW = 1 << 18, 4_096
#: Pieces whose ids are broadcast, at most; pieces of a text that are put together at a time.
COMMON, STEP = 400_000, 1 << 16
#: Bits of a rank in a displaced table, and what a free slot of it holds.
RANK = 20
FREE = ((1 << 22) - 1) << RANK
#: Bits of a cell's place and of a symbol. A cell is, from the top: left symbol of the slot XOR its own (0: the pair has a rank), the
#: pair's symbol, its own, its place: 63 bits.
PLACE, SYMBOL = 9, 18
PAIR = PLACE + SYMBOL
NO_PAIR = 1 << (PAIR + SYMBOL)
NOWHERE = -(1 << 31)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """(a, b, rank of the token that a and b make), for each way to cut each token into two tokens."""
    found = []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                found.append((a, b, rank))
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def displaced(pairs: np.ndarray, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """shift, and slots of a << RANK | rank (FREE: none), with pair (a, b) in slot shift[a] + b and no two in one slot."""
    shift = np.zeros(size, np.int64)
    room = max(1 << 12, 4 * len(pairs))
    slots = np.full(room + size, FREE, np.int64)
    left, first, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    rng = np.random.default_rng(seed)
    for g in np.argsort(-count, kind="stable"):
        mine = pairs[first[g] : first[g] + count[g]]
        while True:
            tries = rng.integers(0, room, 16 if count[g] < 50 else 1)
            fits = (slots[tries[:, None] + mine[:, 1]] == FREE).all(1)
            if fits.any():
                break
        shift[left[g]] = at = tries[int(np.argmax(fits))]
        slots[at + mine[:, 1]] = (mine[:, 0] << RANK) | mine[:, 2]
    return shift, slots


class Merges:
    """The displaced table of a file's pairs (0 in free slots), the bytes' symbols, and the symbol of an end, which no pair has."""

    def __init__(self, ranks: dict[bytes, int]):
        self.end = max(ranks.values()) + 2
        if self.end >= 1 << SYMBOL:
            raise ValueError(f"ranks from {(1 << SYMBOL) - 2} on don't fit the fold's cells")
        self.shift, slots = displaced(rank_pairs(ranks) + 1, self.end + 1)
        self.slots = np.where(slots == FREE, 0, (slots >> RANK << SYMBOL) | (slots & ((1 << RANK) - 1)))
        self.bytes = np.array([ranks[bytes([i])] + 1 for i in range(256)])

    def cells(self, pieces: list[bytes]) -> pa.ListArray:
        """A piece's cells before any merge; pieces have at most LONG bytes."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 2
        ends = np.cumsum(size)
        own = np.full(int(size.sum()), self.end, np.int64)
        place = np.arange(len(own)) - np.repeat(ends - size, size)
        own[(place > 0) & (place < np.repeat(size - 1, size))] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        pair = self.slots[self.shift[own] + np.append(own[1:], self.end)[: len(own)]] ^ (own << SYMBOL)
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array((pair << PAIR) | (own << PLACE) | place))


def ids_of(cells: pa.ListArray) -> pa.ListArray:
    """The ids of pieces, of their cells after all merges."""
    size = cells.value_lengths().to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    inner = np.ones(int(size.sum()), bool)
    inner[ends - size] = inner[ends - 1] = False
    ids = ((cells.flatten().to_numpy()[inner] >> PLACE) & ((1 << SYMBOL) - 1)) - 1
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size - 2)), pa.int32()), pa.array(ids, pa.int32()))


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(read_ranks(path))


@lru_cache(maxsize=2)
def _literals(path: str) -> tuple[str, str]:
    found = _merges(path)
    return tuple(",".join(map(str, x.tolist())) for x in (found.shift, found.slots))


def _if(condition: Column, value: Column, other: Column) -> Column:
    return F.call_function("if", condition, value, other)


def merge_pieces(pieces: Column, path: str) -> Column:
    """array<array<bigint>>: the cells of pieces, to those after all merges."""
    # folded to literals by the optimizer; a variable in their place would have the fold's result copied once more
    shift, slots = (F.split(F.lit(x), ",").cast("array<bigint>") for x in _literals(path))
    number = lambda n: F.lit(n).cast("bigint")
    places, symbols, one = number((1 << PLACE) - 1), number((1 << SYMBOL) - 1), number(1)

    def pair(a: Column, b: Column) -> Column:
        return F.shiftleft(slots[shift[a] + b].bitwiseXOR(F.shiftleft(a, SYMBOL)), PAIR)

    def symbol(cell: Column) -> Column:
        return F.shiftright(cell, PLACE).bitwiseAND(symbols)

    def step(cells: Column, _: Column) -> Column:
        def join(low: Column) -> Column:
            """The least cell takes its right neighbour in: that goes, those after it move up, the one before has another pair."""
            k, new = low.bitwiseAND(places), F.shiftright(low, PAIR)
            joined = pair(new, symbol(cells[k + number(2)])).bitwiseOR(F.shiftleft(new, PLACE)).bitwiseOR(k)

            def each(cell: Column) -> Column:
                at = cell.bitwiseAND(places)
                before = pair(symbol(cell), new).bitwiseOR(cell.bitwiseAND(number((1 << PAIR) - 1)))
                return _if(at > k, cell - one, _if(cell == low, joined, _if(at == k - one, before, cell)))

            return _if(low < number(NO_PAIR), F.transform(F.array_remove(cells, cells[k + one]), each), cells)

        return F.aggregate(F.array(F.array_min(cells)), F.lit(None).cast("array<bigint>"), lambda _, low: join(low))

    return F.transform(pieces, lambda cells: F.aggregate(cells, cells, step))


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes, and by rank where a token's begin and how many it has."""
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    back = b"".join(sorted(ranks, key=ranks.get))
    return np.frombuffer(back, np.uint8), np.cumsum(size) - size, size


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long piece: always the pair of the lowest rank, the leftmost of equals, in n log n steps."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    at = lambda i, j: ranks.get(piece[i : end[j]])
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := at(i, i + 1)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, stop = heapq.heappop(heap)  # parts i..j and j..stop, if they still stand so
        if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != stop:
            continue
        end[i], alive[j] = stop, False
        if stop < n:
            before[stop] = i
            if (r := at(i, stop)) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (h := before[i]) >= 0 and (r := at(h, i)) is not None:
            heapq.heappush(heap, (r, h, i, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def _letters(piece: str) -> str:
    """A piece's UTF-8 bytes as characters 0..255."""
    return piece if piece.isascii() else piece.encode().decode("latin-1")


def common_pieces(docs: DataFrame, pattern: str, most: int = COMMON) -> DataFrame | None:
    """(piece): those in most tasks' texts, no more than most of them; None if no piece is in two.

    Words with a space at each end stand for themselves here; where white space is otherwise, what is missed is only folded more often. A count's bucket grows by a quarter power of two, so the threshold comes from a histogram of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = regex.compile(pattern)
        words: Counter[str] = Counter()

        def found() -> pa.RecordBatch:
            pieces = {p for w, n in words.items() if n > 1 for p in match.findall(" " + w)}
            return pa.RecordBatch.from_arrays([pa.array([_letters(p) for p in pieces if len(p) <= LONG // 4], pa.string())], ["piece"])

        for b in slices(batches):
            for t in texts(b):
                words.update(t.split(" "))
            if len(words) > 2 * PIECES:
                yield found()
                words.clear()
        if words:
            yield found()

    counted = docs.select("text").mapInArrow(run, "piece string").groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = materialize(counted.withColumn("bucket", F.floor(F.log2("n") * 4).cast("int")), "pieces")
    left, least = most, None
    for r in sorted(counted.groupBy("bucket").count().collect(), key=lambda r: -r["bucket"]):  # at most 4 * 63 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["bucket"]
    if least is None:
        drop_materialized(counted)
        return None
    return counted.where(F.col("bucket") >= least).select("piece")


def _trim() -> None:
    """Give back what an earlier task of this worker has freed in the middle of its heap."""
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _one(values: pa.Array) -> pa.ListArray:
    """A list array with all values in one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def fold_common(pieces: DataFrame | None, path: str, merges) -> tuple[list[str], tuple[np.ndarray, np.ndarray]]:
    """Pieces, and how many ids each has and these one after the other; at most COMMON pieces."""
    if pieces is None:
        return [], (np.empty(0, np.int32), np.empty(0, np.int32))
    rows = pieces.groupBy(F.spark_partition_id(), F.pmod(F.xxhash64("piece"), F.lit(64))).agg(F.collect_list("piece").alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                got = column(b.slice(r, 1), "pieces")
                cells = merges.value.cells([p.encode("latin-1") for p in got[0].as_py()])
                yield pa.RecordBatch.from_arrays([got, _one(cells)], ["pieces", "cells"])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                yield pa.RecordBatch.from_arrays([column(one, "pieces"), _one(ids_of(column(one, "cells").flatten()))], ["pieces", "enc"])

    rows = rows.select("pieces").mapInArrow(run, "pieces array<string>, cells array<array<bigint>>")
    rows = rows.select("pieces", merge_pieces(F.col("cells"), path).alias("cells")).mapInArrow(ids, "pieces array<string>, enc array<array<int>>").toArrow()
    drop_materialized(pieces)
    rows = rows.combine_chunks()
    names = [p for c in rows["pieces"].chunks for p in c.flatten().to_pylist()]
    enc = [c.flatten() for c in rows["enc"].chunks]
    size = np.concatenate([np.empty(0, np.int32), *(e.value_lengths().to_numpy() for e in enc)])
    flat = np.concatenate([np.empty(0, np.int32), *(e.flatten().to_numpy() for e in enc)])
    return [p.encode("latin-1").decode() for p in names], (size, flat)


def chunks(docs: DataFrame, pattern: str, common, ranks, merges, chunk: int = CHUNK) -> DataFrame:
    """(ids, places, sizes, begin, cells, long): a chunk's row ids, its texts' pieces as positions, how many each has, whether
    positions begin anew, the cells of the new pieces to fold, and the ids of the new long ones.

    A position from 0 is a common piece, then those to fold follow; from -1 downward are the long ones. Rows of one
    task belong together, in order.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _trim()
        match = regex.compile(pattern)
        names = common.value
        index = dict(zip(names, range(len(names))))
        new, new_big = [], []
        known = big = 0  # pieces besides the common ones

        def place(pieces: list[str]) -> np.ndarray:
            """Positions of pieces; those not met before get one."""
            nonlocal known, big
            at = np.fromiter(map(index.get, pieces, repeat(NOWHERE)), np.int32, len(pieces))
            miss = np.flatnonzero(at == NOWHERE)
            if len(miss):
                missed = [pieces[i] for i in miss.tolist()]
                for p in dict.fromkeys(missed):
                    raw = p.encode()
                    if len(raw) > LONG:
                        big += 1
                        index[p] = -big
                        new_big.append(heap_merge(raw, ranks.value))
                    else:
                        index[p] = len(names) + known
                        known += 1
                        new.append(raw)
                at[miss] = np.fromiter(map(index.__getitem__, missed), np.int32, len(missed))
            return at

        def encode(got: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if all(w and not w[0].isspace() for w in got):  # at once: a piece that begins with a space begins a word
                pieces = match.findall(" " + " ".join(got))
                first = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
                if len(first) == len(got):
                    return place(pieces), np.diff(np.append(first, len(pieces)))
            found = [match.findall(" " + w) for w in got]
            return place(list(chain.from_iterable(found))), np.fromiter(map(len, found), np.int64, len(found))

        words = WordIds(encode, 1 << 40)
        ids, places, sizes, held, begin = [], [], [], 0, True
        id_type = None

        def flush() -> pa.RecordBatch:
            cols = [
                pa.array([ids], pa.list_(id_type)),
                pa.array([np.concatenate(places).astype("<i4").tobytes()]),
                pa.array([np.array(sizes, "<i8").tobytes()]),
                pa.array([begin]),
                _one(merges.value.cells(new)),
                pa.array([new_big], pa.list_(pa.list_(pa.int32()))),
            ]
            return pa.RecordBatch.from_arrays(cols, ["ids", "places", "sizes", "begin", "cells", "long"])

        for b in slices(batches, limit=READ):
            id_type = column(b, "id").type
            got = texts(b)
            split = [spaced_words(t) for t in got]
            at = words.lookup([w for _, rest in split for w in rest])
            flat, ends = words.gather(at), np.concatenate([[0], np.cumsum(words.lens[at])])
            cuts = ends[np.cumsum([0, *(len(rest) for _, rest in split)])]
            for (head, _), s, e in zip(split, cuts, cuts[1:]):
                places.append(np.concatenate([place(match.findall(head)), flat[s:e]]))
                sizes.append(len(places[-1]))
            ids += column(b, "id").to_pylist()
            held += sum(map(len, got))
            if held >= chunk or len(new) >= NEW:
                yield flush()
                ids, places, sizes, held, begin = [], [], [], 0, False
                new.clear()
                new_big.clear()
                if known > PIECES or big > 1_000:
                    index = dict(zip(names, range(len(names))))
                    known = big = 0
                    words.clear()
                    begin = True
                elif len(words.index) > WORDS:
                    words.clear()
        if ids:
            yield flush()

    return docs.mapInArrow(run, f"ids array<{kind}>, places binary, sizes binary, begin boolean, cells array<array<bigint>>, long array<array<int>>")


def gathered(flat: np.ndarray, offs: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What flat holds at the places of these positions, one after the other."""
    lens = size[at].astype(np.int64)
    return flat[np.arange(int(lens.sum())) + np.repeat(offs[at] - (np.cumsum(lens) - lens), lens)]


class Pieces:
    """The ids of a task's pieces so far, by position; plain arrays, as an object for each piece takes several times the memory."""

    def __init__(self, size: np.ndarray, flat: np.ndarray):
        self.size, self.flat = size, flat
        self.offs = np.cumsum(size, dtype=np.int64) - size
        self.long: list[np.ndarray] = []
        self.room: dict[str, np.ndarray] = {}

    def append(self, name: str, more: np.ndarray) -> None:
        """Add to one of the arrays, which is the first part of a longer one, so that few additions copy it."""
        have = getattr(self, name)
        n = len(have) + len(more)
        room = self.room.get(name)
        if room is None or len(room) < n:
            room = self.room[name] = np.empty(n + n // 8, have.dtype)
            room[: len(have)] = have
        room[len(have) : n] = more
        setattr(self, name, room[:n])

    def add(self, enc: pa.ListArray, n_long: int) -> None:
        """Further pieces; the last n_long of them are the long ones."""
        n = len(enc) - n_long
        self.long += [np.array(e.as_py(), np.int32) for e in enc[n:]]
        enc = enc[:n]
        got = enc.value_lengths().to_numpy()
        self.append("offs", len(self.flat) + np.cumsum(got, dtype=np.int64) - got)
        self.append("size", got)
        self.append("flat", enc.flatten().to_numpy())

    def text(self, at: np.ndarray) -> np.ndarray:
        """Ids of the pieces at these positions."""
        if self.long and len(at) and at.min() < 0:
            cut, start, parts = np.flatnonzero(at < 0), 0, []
            for c in [*cut.tolist(), len(at)]:
                parts.append(self.text(at[start:c]))
                if c < len(at):
                    parts.append(self.long[-1 - int(at[c])])
                start = c + 1
            return np.concatenate(parts)
        if len(at) > STEP:
            return np.concatenate([self.text(at[i : i + STEP]) for i in range(0, len(at), STEP)])
        return gathered(self.flat, self.offs, self.size, at)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: the id, token_ids and decoded (their bytes); with digests instead n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    prepare_workers(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # one broadcast for each of the workers that a task has
    merges = spark.sparkContext.broadcast(_merges(path))
    names, found = fold_common(common_pieces(plain, pattern), path, merges)
    common, shared = map(spark.sparkContext.broadcast, (names, found))
    of_tokens = read_ranks(path)
    ranks, tokens = map(spark.sparkContext.broadcast, (of_tokens, token_bytes(of_tokens)))
    rows = chunks(plain, pattern, common, ranks, merges)
    rows = rows.select("ids", "places", "sizes", "begin", "long", merge_pieces(F.col("cells"), path).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _trim()
        have = None
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                if have is None or column(one, "begin")[0].as_py():
                    have = Pieces(*shared.value)
                long = column(one, "long").flatten()
                have.add(pa.concat_arrays([ids_of(column(one, "cells").flatten()), long]), len(long))
                places = np.frombuffer(column(one, "places")[0].as_py(), "<i4")
                sizes = np.frombuffer(column(one, "sizes")[0].as_py(), "<i8")
                ids = column(one, "ids").flatten()
                step = 256
                for s in range(0, len(sizes), step):
                    begin, out = int(sizes[:s].sum()), []
                    for n in sizes[s : s + step].tolist():
                        got = have.text(places[begin : begin + n])
                        begin += n
                        back = b"".join(gathered(*tokens.value, got[i : i + STEP]).tobytes() for i in range(0, len(got), STEP))
                        got = got.astype("<u4")
                        out.append((len(got), hashlib.sha256(got).hexdigest(), hashlib.sha256(back).hexdigest()) if digests else (got.astype(np.int32), back))
                    kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["token_ids", "decoded"]
                    yield pa.RecordBatch.from_arrays([ids.slice(s, step), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["id", *names])

    schema = f"id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>, decoded binary")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode_texts(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True)
