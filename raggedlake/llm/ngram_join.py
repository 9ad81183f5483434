"""Exact n-gram Jaccard join and its components, by T-occurrence search (DivideSkip).

Documents link when their sets of word n-grams reach the Jaccard limit. Three steps, none of which loses a link:

1. Where two sets can meet: equal signatures make candidate pairs, and sets that link have one in common. A high limit
   (from about 9/10) takes parts: linked sets differ in at most d n-grams, d fixed by the limit and the larger set; the
   n-grams are dealt by hash into d + 1 parts, one of which is then the same in both. Sizes are banded so that both
   documents use the same number of parts. At lower limits parts are so thin that unrelated sets share empty ones, so
   there the n-grams have one order, the frequent ones last, and a set of m n-grams takes its first m - limit * m + 1
   (prefix filtering: linked sets share limit * m at least). Frequencies are counted over all texts, where a worker's
   batch has an n-gram twice, and kept by hash in a table of fixed size: that decides the order, hence how many pairs
   are tested, never a result. Where few documents have a
   signature, each pair of them is tested by size and by bitmaps of parities, which can only rule out what can't link. Where many have
   it, all are paired with the smallest id. A worker does this among its own rows first and passes on only the
   smallest id of many: a signature that a third of all documents share is one entry from each worker's batch.
2. The connected components of these pairs. Linked documents are in one component, so each document's set
   travels to one place only. Documents of equal sets travel as one. Passages that many texts share can chain
   unrelated documents; large components are therefore first taken apart by sizes and bitmaps of all their pairs.
3. In a component, the T-occurrence search: a document's n-grams are inverted lists; a partner must occur on at
   least T of them. The L longest lists are set aside; the others are merged, keeping what occurs T - L times or
   more; these candidates are looked up in the long lists by binary search. Documents already joined are not looked
   up again. A component too large for one task is cut into blocks, and every pair of blocks is searched.

N-grams are compared by 64-bit hashes.

Defined results: a null text, or one without words, has an empty set and is linked with nothing. A text of fewer
than n words has its whole word sequence as its one n-gram. Rows of a null id keep a null component. Rows that
share an id are one node. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raggedlake.llm.graph import components
from raggedlake.llm.text import column, raw_texts, slices
from raggedlake.plans.session import drop_materialized, materialize, prepare_workers, table

#: Signatures that a worker gathers before it pairs and sends them.
BATCH = 300_000
#: n-grams that one search task holds; documents that share one bucket of signatures, about.
TASK_GRAMS, BUCKET_DOCS = 2_000_000, 1_000
#: Documents whose bitmaps one task compares at a time.
TASK_DOCS = 6_000
#: So many documents with one signature are all paired; more are paired with the smallest id only.
FEW = 8
#: Bits of a hash below those that choose a cell of the table of frequencies; cells that are kept; n-grams counted at a time.
CELL, OFTEN, COUNTED = np.uint64(41), 500_000, 3_000_000
#: Least bits of a document's bitmap; rows of the broadcast table that spares texts the shuffle.
BITS, MARKS = 2048, 1 << 19

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M2
        h = (h ^ (h >> np.uint64(27))) * _M3
        return h ^ (h >> np.uint64(31))


def gram_sets(raw: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text, in lower case (A-Z), words at \\x20 and \\x09-\\x0D."""
    out = []
    for t in raw:
        words = t.lower().split()
        if not words:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        size = min(n, len(words))
        count = len(words) - size + 1
        g = np.full(count, size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                g = mix(g * _M1 + h[k : k + count])
        out.append(np.unique(g))
    return out


class Bands:
    """Size bands and parts for a Jaccard limit: linked sets, the larger in a band, have one of its parts in common."""

    def __init__(self, limit: Fraction):
        self.limit, self.ratio = limit, max(Fraction(3, 2), 1 / limit)

    def thin(self) -> bool:
        """Whether parts can hold fewer than six n-grams on average, so that many are empty, or one n-gram, in unrelated sets."""
        return 6 * self.ratio * 2 * (1 - self.limit) / (1 + self.limit) > 1

    def band(self, size: int) -> int:
        b, top = 0, Fraction(1)
        while top < size:
            b, top = b + 1, top * self.ratio
        return b

    def top(self, band: int) -> int:
        return int(self.ratio**band)

    def parts(self, band: int) -> int:
        """One more than the most n-grams by which linked sets, the larger in this band, can differ."""
        return int((1 - self.limit) / (1 + self.limit) * 2 * self.top(band)) + 1

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        size = len(grams)
        b = self.band(size)
        out = []
        for band in (b, b + 1) if int(size / self.limit) > self.top(b) else (b,):
            k = self.parts(band)
            part = (mix(grams + _M1) >> np.uint64(20)) % np.uint64(k)
            order = np.argsort(part, kind="stable")
            p = part[order]
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            with np.errstate(over="ignore"):
                sums = np.zeros(k, np.uint64)
                sums[p[first]] = np.add.reduceat(mix(grams)[order], first)
                out.append(mix(sums + mix(np.arange(k, dtype=np.uint64) + np.uint64(band << 40)) * _M1))
        return np.concatenate(out)


def prefix(grams: np.ndarray, limit: Fraction, levels: np.ndarray) -> np.ndarray:
    """A set's signatures: its first n-grams in the order of levels, then hashes; one at least is among those of any set that links with it."""
    size = len(grams)
    count = size - -(-limit.numerator * size // limit.denominator) + 1
    key = (levels[(grams >> CELL).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (grams >> np.uint64(6))
    return mix(np.partition(key, count - 1)[:count] + _M1)


def _levels(docs: DataFrame, n: int) -> np.ndarray:
    """By an n-gram's first bits, how frequent it is: 0, or about three times the binary logarithm of its count, up to 63.

    Counted is what a worker's batch has twice or more; of that the most frequent OFTEN cells are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            grams, count = np.unique(np.concatenate(held), return_counts=True)
            some = count > 1
            return pa.RecordBatch.from_arrays([pa.array((grams[some] >> CELL).astype(np.int32)), pa.array(count[some].astype(np.int64))], ["cell", "c"])

        for b in slices(batches):
            held += gram_sets(raw_texts(b), n)
            size = sum(map(len, held))
            if size > COUNTED:
                yield counted()
                held = []
        if held:
            yield counted()

    cells = docs.select("text").mapInArrow(run, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c"))
    cells = materialize(cells.select("cell", F.least(F.lit(63), F.floor(3 * F.log2("c"))).cast("tinyint").alias("level")), "levels")
    left, least = OFTEN, 64
    for r in sorted(cells.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # at most 64 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    got = cells.where(F.col("level") >= least).toArrow()
    drop_materialized(cells)
    out = np.zeros(1 << (64 - int(CELL)), np.uint8)
    out[got["cell"].to_numpy()] = got["level"].to_numpy()
    return out


def _pair_up(sig: np.ndarray, ids: np.ndarray, wild: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids with equal signatures, and what to pass on: (star pairs, all pairs, sig, ids, wild).

    Up to FEW ids are paired with each other and all passed on. More, or ids of which one is wild (it stands for
    many), are paired with the smallest only, and that one is passed on as wild.
    """
    order = np.lexsort((wild, ids, sig))
    sig, ids, wild = sig[order], ids[order], wild[order]
    if not len(sig):
        return np.empty((0, 2), np.int64), np.empty((0, 2), np.int64), sig, ids, wild
    same = np.concatenate([[False], (sig[1:] == sig[:-1]) & (ids[1:] == ids[:-1])])
    if same.any():  # one entry an id, wild if any was
        at = np.flatnonzero(~same)
        sig, ids, wild = sig[at], ids[at], np.logical_or.reduceat(wild, at)
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(sig)))
    many = (size > FEW) | np.logical_or.reduceat(wild, start)
    group = np.cumsum(first) - 1
    big = many[group]
    star = big & ~first
    stars = np.unique(np.stack([ids[start[group[star]]], ids[star]], 1), axis=0) if star.any() else np.empty((0, 2), np.int64)
    pairs = []
    for step in range(1, FEW):
        i = np.flatnonzero(~big[:-step] & (group[step:] == group[:-step])) if len(ids) > step else np.empty(0, np.int64)
        if not len(i):
            break
        pairs.append(np.stack([ids[i], ids[i + step]], 1))
    few = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
    on = ~big | first
    return stars, few, sig[on], ids[on], big[on]


def bitmap(grams: np.ndarray) -> bytes:
    """Parities of the n-grams dealt to BITS places, or a power of two of at least twice the n-grams: two sets differ in at
    least as many n-grams as bits. A longer map folds to a shorter one (see folded())."""
    bits = max(BITS, 1 << (2 * len(grams) - 1).bit_length()) if len(grams) else BITS
    return np.packbits(np.bincount((mix(grams ^ _M2) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) at a smaller power of two of words: halves are added, bit by bit without carry."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """By how many bits the bitmaps of each pair differ, at the shorter one's length."""
    out = np.empty(len(x), np.int64)
    sizes = np.array([(len(a), len(b)) for a, b in zip(x, y)], np.int64).reshape(-1, 2)
    for a, b in np.unique(sizes, axis=0).tolist():
        rows = np.flatnonzero((sizes[:, 0] == a) & (sizes[:, 1] == b))
        maps = [folded(np.frombuffer(b"".join(v[i] for i in rows.tolist()), np.uint64).reshape(len(rows), -1), min(a, b) // 8) for v in (x, y)]
        out[rows] = np.bitwise_count(maps[0] ^ maps[1]).sum(1)
    return out


class Search:
    """T-occurrence search over a list of sets (sorted hash arrays)."""

    def __init__(self, sets: list[np.ndarray], limit: Fraction):
        self.limit = limit
        self.sizes = np.array([len(s) for s in sets])
        docs = np.repeat(np.arange(len(sets)), self.sizes)
        values, tokens = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.lexsort((docs, tokens))
        self.post = docs[order]
        self.key = tokens[order].astype(np.int64) * len(sets) + self.post
        self.ends = np.cumsum(np.bincount(tokens, minlength=len(values)))
        self.tokens = np.split(tokens, np.cumsum(self.sizes)[:-1])
        self.n = len(sets)

    def needed(self, a: int, b: np.ndarray) -> np.ndarray:
        """Least overlap with which sets of sizes a and b link."""
        x = self.limit.numerator * (a + b)
        y = self.limit.numerator + self.limit.denominator
        return -(-x // y)

    def partners(self, r: int, wanted) -> np.ndarray:
        """The sets after r (by size, then place) that link with r, out of those for which wanted(places) is true."""
        lists, size = self.tokens[r], int(self.sizes[r])
        least = int(self.needed(size, np.array([size]))[0])  # a partner is at least as large
        length = self.ends[lists] - np.where(lists > 0, self.ends[lists - 1], 0)
        order = np.argsort(length, kind="stable")
        longest = int(length[order[-1]])
        aside = min(least - 1, max(int(least / (0.01 * np.log2(longest + 1) + 1)), 0))
        short, long_ = lists[order[: size - aside]], lists[order[size - aside :]]
        runs = [self.post[self.ends[t] - n : self.ends[t]] for t, n in zip(short, length[order])]
        if sum(map(len, runs)) < 64:  # few: a heap merge; many: the same by sorting
            merged = np.fromiter(heapq.merge(*map(np.ndarray.tolist, runs)), np.int64)
        else:
            merged = np.sort(np.concatenate(runs))
        if not len(merged):
            return np.empty(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, count = merged[first], np.diff(np.append(first, len(merged)))
        later = (self.sizes[found] > size) | ((self.sizes[found] == size) & (found > r))
        fits = (self.sizes[found] * self.limit.numerator <= size * self.limit.denominator) & (count >= least - aside)
        keep = later & fits
        found, count = found[keep], count[keep]
        if len(found):
            keep = wanted(found)
            found, count = found[keep], count[keep]
        step = max(1, 2_000_000 // max(1, len(long_)))
        for i in range(0, len(found), step):
            want = (long_.astype(np.int64)[:, None] * self.n + found[None, i : i + step]).ravel()
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            count[i : i + step] += (self.key[at] == want).reshape(len(long_), -1).sum(0)
        return found[count >= self.needed(size, self.sizes[found])]


def forest(sets: list[np.ndarray], limit: Fraction, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (places) that join all linked sets; with side, only links between different sides are looked for."""
    root = np.arange(len(sets))
    links = []
    s = Search(sets, limit)
    members = {i: [i] for i in range(len(sets))}
    for r in np.argsort(s.sizes, kind="stable"):
        wanted = (lambda p: root[p] != root[r]) if side is None else (lambda p: (root[p] != root[r]) & (side[p] != side[r]))
        for p in s.partners(int(r), wanted):
            a, b = root[r], root[p]
            if a != b:
                links.append((int(r), int(p)))
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                moved = members.pop(b)
                root[moved] = a
                members[a] += moved
    return links


def _first_pass(docs: DataFrame, n: int, limit: Fraction, buckets: int, levels: Broadcast | None) -> DataFrame:
    """kind 0: a document's id, set size, key and bitmap; 1 and 2: a bucket's signatures and ids (2: wild ones); 3: pairs of ids that need no test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(limit)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: dict[bytes, int] = {}
        copies: list[tuple[int, int]] = []
        size = 0
        names = ["kind", "id", "n", "key", "bits", "bucket", "x", "y"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]

        def rows(**cols) -> pa.RecordBatch:
            n = max(map(len, cols.values()))
            return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds)], names)

        def flush() -> Iterator[pa.RecordBatch]:
            sig, ids = np.concatenate([s for s, _ in held]), np.concatenate([i for _, i in held])
            stars, _, sig, ids, wild = _pair_up(sig, ids, np.zeros(len(ids), bool))
            bucket = (sig >> np.uint64(32)) % np.uint64(buckets)
            for kind, part in ((1, ~wild), (2, wild)):
                order = np.argsort(bucket[part], kind="stable")
                b, x, y = bucket[part][order], sig[part][order], ids[part][order]
                if len(b):
                    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
                    spans = list(zip(cuts, cuts[1:]))
                    yield rows(kind=[kind] * len(spans), bucket=[int(b[i]) for i, _ in spans], x=[x[i:j].tobytes() for i, j in spans], y=[y[i:j].tobytes() for i, j in spans])
            sure = np.concatenate([stars, np.array(copies, np.int64).reshape(-1, 2)])
            for i in range(0, len(sure), 50_000):
                p = sure[i : i + 50_000]
                yield rows(kind=[3], x=[p[:, 0].tobytes()], y=[p[:, 1].tobytes()])

        for batch in slices(batches):
            sets = gram_sets(raw_texts(batch), n)
            ids = column(batch, "id").to_pylist()
            keys = [hashlib.md5(s.tobytes()).digest() for s in sets]
            yield rows(kind=[0] * len(ids), id=ids, n=[len(s) for s in sets], key=keys, bits=[bitmap(s) for s in sets])
            for i, s, k in zip(ids, sets, keys):
                if i is None or not len(s):
                    continue
                if k in seen:  # an equal set: its signatures are the first one's
                    copies.append((seen[k], i))
                    continue
                seen[k] = i
                got = bands.signatures(s) if levels is None else prefix(s, limit, levels.value)
                held.append((got, np.full(len(got), i, np.int64)))
                size += len(got)
            if size >= BATCH:
                yield from flush()
                held, seen, copies, size = [], {}, [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, "kind int, id long, n long, key binary, bits binary, bucket long, x binary, y binary")


def _bucket_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, sure): pairs that equal signatures of a bucket make."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(t["x"].to_pylist()), np.uint64)
        ids = np.frombuffer(b"".join(t["y"].to_pylist()), np.int64)
        wild = np.repeat(t["kind"].to_numpy() == 2, [len(v) // 8 for v in t["x"].to_pylist()])
        stars, few, *_ = _pair_up(sig, ids, wild)
        both = np.concatenate([stars, few])
        return pa.table({"a": both[:, 0], "b": both[:, 1], "sure": np.arange(len(both)) < len(stars)}, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())]))

    return rows.groupBy("bucket").applyInArrow(run, "a long, b long, sure boolean")


def _unpack(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(column(b, "x").to_pylist(), column(b, "y").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v, np.int64)) for v in (x, y)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _possible(pairs: DataFrame, sets: DataFrame, limit: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps don't rule a link out."""
    p, q = limit.numerator, limit.denominator
    size = sets.select("id", "n", "bits")
    rows = pairs.join(size.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
    rows = rows.join(size.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
    rows = rows.where(F.greatest("na", "nb") * p <= F.least("na", "nb") * q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                most = (q - p) * (column(b, "na").to_numpy() + column(b, "nb").to_numpy()) // (q + p)
                keep = pa.array(apart(column(b, "xa").to_pylist(), column(b, "xb").to_pylist()) <= most)
                yield pa.RecordBatch.from_arrays([column(b, c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return rows.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def _forest_of_possible(n: np.ndarray, bits: list[bytes], side: np.ndarray | None, limit: Fraction) -> list[tuple[int, int]]:
    """Places that sizes and bitmaps allow to link, as a forest; with side, between different sides only."""
    p, q = limit.numerator, limit.denominator
    order = np.argsort(n, kind="stable")
    n = n[order]
    words = np.array([len(bits[i]) // 8 for i in order.tolist()])  # rises with n
    side = None if side is None else side[order]
    stop = np.searchsorted(n * p, n * q, "right")
    root, members, links = np.arange(len(n)), {i: [i] for i in range(len(n))}, []
    for level in np.unique(words).tolist():
        # sets of one length of bitmap, and the longer ones that can be near enough in size, folded to it
        begin, end = int(np.searchsorted(words, level)), int(np.searchsorted(words, level, "right"))
        last = int(stop[end - 1])
        cuts = [begin, *(begin + 1 + np.flatnonzero(np.diff(words[begin:last]))).tolist(), last]
        maps = np.concatenate([folded(np.frombuffer(b"".join(bits[i] for i in order[s:e].tolist()), np.uint64).reshape(e - s, -1), level) for s, e in zip(cuts, cuts[1:])])
        for r in range(begin, end):
            near = np.arange(r + 1, stop[r])
            near = near[root[near] != root[r]]
            if side is not None:
                near = near[side[near] != side[r]]
            if not len(near):
                continue
            differ = np.bitwise_count(maps[near - begin] ^ maps[r - begin]).sum(1)
            for x in near[differ <= (q - p) * (n[near] + n[r]) // (q + p)]:
                a, b = root[r], root[x]
                if a != b:
                    links.append((int(order[r]), int(order[x])))
                    if len(members[a]) < len(members[b]):
                        a, b = b, a
                    moved = members.pop(b)
                    root[moved] = a
                    members[a] += moved
    return links


def _refined(nodes: DataFrame, docs: DataFrame, limit: Fraction) -> DataFrame:
    """nodes with the labels of large components replaced by those of the pairs in them that can link at all.

    Only ids, sizes and bitmaps travel, so blocks can be larger, and cost less to pair, than blocks of texts. Sets that
    link differ in size by the limit's ratio at most, so each band of that ratio meets itself and the next one only;
    a band of more than TASK_DOCS sets is cut into blocks.
    """
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("g")).where(F.col("g") > TASK_GRAMS // 3)
    if sizes.isEmpty():
        return nodes
    # a base a little above the ratio: rounding can't put two sets that link two bands apart
    band = F.floor(F.ln("n") / (math.log(1 / limit) * (1 + 1e-9))).cast("int")
    large = nodes.join(sizes.select("label"), "label", "left_semi").withColumn("band", band)
    per_band = large.groupBy("label", "band").agg(F.ceil(F.count(F.lit(1)) / TASK_DOCS).cast("int").alias("m"))
    blocks = per_band
    for name, step in (("below", 1), ("above", -1)):
        blocks = blocks.join(per_band.select("label", (F.col("band") + step).alias("band"), F.col("m").alias(name)), ["label", "band"], "left")
    rows = large.join(blocks, ["label", "band"]).join(docs.select("id", "bits"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))

    def tasks(count: str, low: Column, high: Column, first: Callable[[Column], Column], second: Callable[[Column], Column]) -> Column:
        """Tasks (low band, high band, block, block) with each of so many blocks."""
        each = F.when(F.coalesce(F.col(count), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(each, lambda o: F.struct(low.alias("low"), high.alias("high"), first(o).alias("i"), second(o).alias("j")))

    mine, at = F.col("block"), F.col("band")
    same = tasks("m", at, at, lambda o: F.least(mine, o), lambda o: F.greatest(mine, o))
    up = tasks("above", at, at + 1, lambda o: mine, lambda o: o)
    down = tasks("below", at - 1, at, lambda o: o, lambda o: mine)
    rows = rows.select("label", "band", "block", "id", "n", "bits", F.explode(F.concat(same, up, down)).alias("t")).select("label", "t.*", "band", "block", "id", "n", "bits")

    def find(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("id")
        ids = part["id"].to_numpy()
        _, low, high, i, j = key
        side = None if low == high and i == j else (part["block"] if low == high else part["band"]).to_numpy()
        links = _forest_of_possible(part["n"].to_numpy().astype(np.int64), part["bits"].tolist(), side, limit)
        return pd.DataFrame([(ids[a], ids[b]) for a, b in links], columns=["a", "b"], dtype="int64")

    found = components(rows.groupBy("label", "low", "high", "i", "j").applyInPandas(find, "a long, b long"))
    inner = nodes.join(sizes.select("label", F.lit(True).alias("big")), "label", "left").join(found.withColumnRenamed("label", "inner"), "id", "left")
    # a document of a large component that can link with none is a component of its own
    return inner.select("id", "key", "n", F.when(F.col("big"), F.coalesce("inner", "id")).otherwise(F.col("label")).alias("label"))


def jaccard_components(docs: DataFrame, n: int = 5, limit: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links)."""
    spark = docs.sparkSession
    prepare_workers(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = max(64, min(1 << 20, plain.count() // BUCKET_DOCS))
    levels = spark.sparkContext.broadcast(_levels(plain, n)) if Bands(limit).thin() else None
    first = materialize(_first_pass(plain, n, limit, buckets, levels), "grams")
    if levels is not None:
        levels.destroy()
    sets = first.where("kind = 0").select("id", "n", "key")
    met = materialize(_bucket_pairs(first.where("kind in (1, 2)").select("kind", "bucket", "x", "y")), "met")
    few = met.where("not sure").select("a", "b").distinct()
    pairs = _possible(few, first.where("kind = 0"), limit).unionByName(met.where("sure").select("a", "b")).unionByName(_unpack(first.where("kind = 3").select("x", "y")))
    maybe = materialize(components(pairs), "maybe")

    # a node for each distinct set of a candidate component: the smallest id that has it
    nodes = sets.where("n > 0").join(maybe, "id").groupBy("label", "key").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    nodes = materialize(nodes, "nodes")
    whole, nodes = nodes, materialize(_refined(nodes, first.where("kind = 0"), limit), "nodes")
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("grams")).where("c > 1")
    total = sizes.agg(F.sum("grams")).first()[0] or 0
    links = sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    if total:
        tasks = max(1, -(-int(total) // (TASK_GRAMS // 3)))
        blocks = F.ceil(F.col("grams") * 2 / TASK_GRAMS).cast("int")
        placed = nodes.join(sizes, "label").select("id", "label", blocks.alias("m"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
        # small components share tasks; in a large one each pair of blocks is a task
        other = F.explode(F.when(F.col("grams_small"), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("m") - 1)))
        placed = placed.withColumn("grams_small", F.col("m") <= 2).withColumn("other", other)
        task = F.when(F.col("grams_small"), F.struct(F.pmod(F.xxhash64("label"), F.lit(tasks)).alias("t"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))).otherwise(F.struct(F.col("label").alias("t"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
        placed = placed.select("id", "label", "block", task.alias("task"))
        # before the texts are shuffled, most others are left out by a table of at most MARKS rows
        mark = F.pmod(F.xxhash64("id"), F.lit(MARKS))
        marks = placed.select(mark.alias("_mark")).distinct()
        texts = plain.withColumn("_mark", mark).join(F.broadcast(marks), "_mark", "left_semi").drop("_mark")
        work = texts.join(placed, "id").select("task.t", "task.i", "task.j", "label", "block", "id", "text")

        def find(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, part in rows.groupby("label", sort=False):
                part = part.drop_duplicates(["id", "text"])
                ids = part["id"].to_numpy()
                grams = gram_sets([(t or "").encode() for t in part["text"]], n)
                side = part["block"].to_numpy() if key[1] != key[2] else None
                out += [(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in forest(grams, limit, side)]
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        links = work.groupBy("t", "i", "j").applyInPandas(find, "a long, b long")
        # equal sets link too
    same = sets.where("n > 0").join(maybe, "id").join(whole.select("label", "key", F.col("id").alias("node")), ["label", "key"]).where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    final = components(links.unionByName(same))
    out = sets.join(final, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, Fraction(9, 10))
