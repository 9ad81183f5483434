"""Removal of long repeated byte strings, by suffix arrays of shards.

A byte is removed if it is covered by a string of `length` bytes that also starts anywhere else in the table, in
the same text or in another. Strings never cross texts, overlaps count, and all is judged on the input.

1. Every window of `length` bytes is given to one anchor: the smallest hash of the `gram`-byte strings in it. Equal
   windows have equal anchors, so windows of different anchors need not be compared, and an anchor that occurs
   once has no repeats (but inside one run of a periodic text, see runs()). A run is a maximal row of windows of one anchor; there is one in about 70 bytes.
2. Runs with equal bytes (128 bits of hash) are repeats as a whole, and one of them stands for all. This keeps a
   passage that a third of all texts share from meeting in one place.
3. The distinct runs of an anchor meet in a shard. A shard's bytes get a suffix array by Larsson-Sadakane
   refinement (groups that are not yet sorted are sorted by the rank h bytes further, h doubling), and Kasai's
   method, all runs in step, gives the common prefix with each suffix's predecessor: `length` or more means a repeat.
4. An anchor with too many distinct runs for a shard is cut into blocks, and each pair of blocks is merged by
   binary search of the windows of one block in the suffix array of the other.

Defined results: a null text is empty. Texts shorter than `length` lose nothing. Repeated rows are each other's
copies. A null id is allowed. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raggedlake.llm.text import column, raw_texts, slices
from raggedlake.plans.session import materialize, prepare_workers, table

LENGTH, GRAM = 200, 64
#: Bytes of one shard's suffix array, about.
SHARD = 1_000_000
NO_ID = -(1 << 63)

_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        both = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            a = np.full(n, np.uint64(base))
            a[0] = 1
            with np.errstate(over="ignore"):
                both.append(np.multiply.accumulate(a))
        _powers[:] = both
    return _powers[0], _powers[1]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while w * 2 <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    r = width - w
    return np.minimum(x[: len(x) - r], x[r:]) if r else x


def runs(raw: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of several texts: text number, first start, number of starts and anchor of each run, and whether it may repeat itself.

    Two windows of one run can only be equal if the anchor leaves at the front of a window and yet is the next one's.
    """
    sizes = np.array([len(t) for t in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    power, inverse = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(data * power[:n] + power[:n], out=c[1:])
        h = (c[gram:] - c[:-gram]) * inverse[: n - gram + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    low = _sliding_min(h, length - gram + 1)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc = np.repeat(np.arange(len(raw)), np.maximum(sizes - length + 1, 0))
    first = np.repeat(starts, np.maximum(sizes - length + 1, 0))
    begin = np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0)
    at = np.arange(len(doc)) - np.repeat(begin, np.maximum(sizes - length + 1, 0)) + first
    v = low[at]
    if not len(v):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    cut = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.append(cut, len(v)))
    again = (h[at[:-1]] == v[:-1]) & (v[1:] == v[:-1]) & (doc[1:] == doc[:-1])
    return doc[cut], at[cut] - first[cut], count, v[cut], np.logical_or.reduceat(np.append(again, False), cut)


def suffix_array(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of symbols 0..256, by Larsson-Sadakane refinement."""
    n, h = len(sym), 7
    wide = np.zeros(n + h, np.int64)
    wide[:n] = sym
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = (key << 9) | wide[k : k + n]
    sa = np.argsort(key, kind="stable")
    ks = key[sa]
    new = np.concatenate([[True], ks[1:] != ks[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    slot = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = slot
    single = new & np.append(new[1:], True)
    todo = np.flatnonzero(~single)
    while len(todo):
        i = sa[todo]
        r1, r2 = rank[i], rank[np.minimum(i + h, n)]
        order = np.lexsort((r2, r1))
        i, r1, r2 = i[order], r1[order], r2[order]
        sa[todo] = i
        new = np.concatenate([[True], (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])])
        rank[i] = np.maximum.accumulate(np.where(new, todo, 0))
        todo = todo[~(new & np.append(new[1:], True))]
        h *= 2
    return sa, rank[:n]


class Shard:
    """The suffix array over some runs' bytes. off, size: each run's place and bytes; starts: its number of windows."""

    def __init__(self, parts: list[bytes], starts: np.ndarray, length: int):
        self.length, self.starts = length, starts
        self.size = np.array([len(p) for p in parts], np.int64)
        self.off = np.cumsum(self.size + 1) - self.size - 1
        text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        sym = text.astype(np.int64) + 1
        sym[self.off + self.size] = 0
        self.n = len(sym)
        self.sa, self.rank = suffix_array(sym)
        pad = np.concatenate([text, np.zeros(length + 8, np.uint8)])
        word = np.zeros(self.n + length, np.uint64)  # 8 bytes from each place, first byte highest
        for k in range(8):
            word = (word << np.uint64(8)) | pad[k : k + self.n + length]
        self.word = word
        self.left = np.zeros(self.n, np.int64)  # bytes from each place to its run's end; separators have 0
        total = int(self.size.sum())
        begin = np.cumsum(self.size) - self.size
        inside = np.arange(total) + np.repeat(self.off - begin, self.size)
        self.left[inside] = np.repeat(self.off + self.size, self.size) - inside

    def judged(self) -> np.ndarray:
        """The places of all windows, run after run."""
        total = int(self.starts.sum())
        begin = np.cumsum(self.starts) - self.starts
        return np.arange(total) + np.repeat(self.off - begin, self.starts)

    def repeats(self) -> np.ndarray:
        """For each window whether it equals another one of this shard: Kasai's method, all runs in step."""
        before = np.full(self.n, -1)
        before[self.sa[1:]] = self.sa[:-1]
        after = np.full(self.n, -1)
        after[self.sa[:-1]] = self.sa[1:]
        hit = np.zeros(self.n, bool)
        order = np.argsort(-self.starts, kind="stable")
        off, count = self.off[order], self.starts[order]
        common = np.zeros(len(off), np.int64)
        for j in range(int(count[0]) if len(count) else 0):
            live = int(np.searchsorted(-count, -j, "left"))  # runs with more than j windows
            p = off[:live] + j
            q = before[p]
            k = np.where(q >= 0, np.maximum(common[:live] - 1, 0), 0)
            go = np.flatnonzero(q >= 0)
            while len(go):
                diff = self.word[p[go] + k[go]] ^ self.word[q[go] + k[go]]
                same = diff == 0
                part = sum((diff < np.uint64(1 << b)).astype(np.int64) for b in range(56, 0, -8))  # equal leading bytes
                k[go] += np.where(same, 8, part)
                go = go[same & (k[go] < self.length)]
            # the separators' zero bytes are no part of a text: a common prefix ends where q's run does
            k = np.where(q >= 0, np.minimum(k, self.left[q]), 0)
            common[:live] = np.minimum(k, self.length)
            full = k >= self.length
            hit[p[full]] = True
            hit[q[full]] = True
        return hit[self.judged()]

    def holds(self, other: Shard) -> np.ndarray:
        """For each window of the other shard whether it is one of this one: binary search in the suffix array."""
        at = other.judged()
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n)
        first = ~np.array([(1 << (64 - 8 * w)) - 1 for w in range(9)], np.uint64)  # masks of the first 0..8 bytes

        def compare(places: np.ndarray, mine: np.ndarray) -> np.ndarray:
            """-1, 0 or 1: whether the suffix at mine is below, begins with or is above the other's window at places.

            A suffix whose run ends within the window, all bytes being equal until then, is below it.
            """
            sign = np.zeros(len(mine), np.int8)
            open_ = np.arange(len(mine))
            for k in range(0, self.length, 8):
                take = min(8, self.length - k)
                left = self.left[mine[open_]] - k
                mask = first[np.clip(left, 0, take)]
                a, b = self.word[mine[open_] + k] & mask, other.word[places[open_] + k] & mask
                short = (a == b) & (left < take)
                sign[open_] = np.where(short, -1, (a > b).astype(np.int8) - (a < b))
                open_ = open_[(a == b) & ~short]
                if not len(open_):
                    break
            return sign

        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = compare(at[open_], self.sa[mid]) < 0
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        found = np.zeros(len(at), bool)
        open_ = np.flatnonzero(lo < self.n)
        found[open_] = compare(at[open_], self.sa[lo[open_]]) == 0
        return found


def spans(hit: np.ndarray, starts: np.ndarray, first: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(run, start, end) of the bytes covered by the windows that hit; windows run after run."""
    run = np.repeat(np.arange(len(starts)), starts)
    begin = np.cumsum(starts) - starts
    pos = np.arange(len(run)) - begin[run] + first[run]
    run, pos = run[hit], pos[hit]
    if not len(run):
        return []
    cut = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (pos[1:] > pos[:-1] + length)]))
    last = np.append(cut[1:], len(run)) - 1
    return list(zip(run[cut].tolist(), pos[cut].tolist(), (pos[last] + length).tolist()))


def _runs_of(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 19):
            raw = raw_texts(b)
            doc, first, count, v, own = runs(raw, length, gram)
            ids, tks = (column(b, c).to_numpy() for c in ("id", "tk"))
            views = list(map(memoryview, raw))
            same = [xxhash.xxh3_64_intdigest(views[d][s : s + n + length - 1]) for d, s, n in zip(doc.tolist(), first.tolist(), count.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(ids[doc]), pa.array(tks[doc]), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(own)], ["v", "same", "id", "tk", "first", "count", "own"])

    return docs.mapInArrow(run, "v long, same long, id long, tk long, first int, count int, own boolean")


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, tk, start, end), maybe overlapping: the bytes to remove. docs: id (not null), tk (xxhash64 of the text), text."""
    gram = min(gram, length)
    found = _runs_of(docs.select("id", "tk", "text"), length, gram)
    often = found.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("o")).where("c > 1 or o").select("v")
    rows = materialize(found.join(often, "v"), "runs")
    kinds = rows.groupBy("v", "same").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "tk", "first", "count")).alias("r"), F.max("own").alias("own"))
    kinds = materialize(kinds, "kinds")
    whole = rows.join(kinds.where("c > 1").select("v", "same"), ["v", "same"]).select("id", "tk", F.col("first").alias("start"), (F.col("first") + F.col("count") + (length - 1)).alias("end"))
    mixed = kinds.groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.sum(F.col("r.count") + length).alias("bytes"), F.max("own").alias("o")).where("d > 1 or o")
    total = mixed.agg(F.sum("bytes")).first()[0] or 0
    if not total:
        return whole
    tasks = max(1, -(-int(total) // SHARD))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("bytes") * 2 / SHARD)).cast("int")
    asked = kinds.join(mixed, "v").select("v", "r", (F.col("c") > 1).alias("known"), blocks.alias("m"))
    of_doc = asked.groupBy(F.col("r.id").alias("id"), F.col("r.tk").alias("tk")).agg(F.collect_list(F.struct("v", F.col("r.first").alias("first"), F.col("r.count").alias("count"), "known", "m")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "i", "j", "block", "v", "id", "tk", "first", "count", "known", "bytes"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        for b in slices(batches):
            raw = raw_texts(b)
            out = []
            for k, want in enumerate(column(b, "runs").to_pylist()):
                for r in want or ():
                    data = raw[k][r["first"] : r["first"] + r["count"] + length - 1]
                    loc = (r["v"], column(b, "id")[k].as_py(), column(b, "tk")[k].as_py(), r["first"], r["count"], r["known"], data)
                    if r["m"] <= 2:
                        out.append(((r["v"] & (2**63 - 1)) % tasks, -1, -1, 0, *loc))
                    else:
                        block = xxhash.xxh3_64_intdigest(data) % r["m"]
                        out += [(r["v"], min(block, o), max(block, o), block, *loc) for o in range(r["m"])]
            for s in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[s : s + 10_000]), kinds)], names)

    # a left join on purpose: the same exchange of the texts then serves remove()
    texts = docs.join(of_doc, ["id", "tk"], "left").mapInArrow(cut, "t long, i int, j int, block int, v long, id long, tk long, first int, count int, known boolean, bytes binary")

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        def shard(part: pd.DataFrame) -> Shard:
            return Shard(part["bytes"].tolist(), part["count"].to_numpy().astype(np.int64), length)

        parts = [rows] if key[1] == key[2] else [p for _, p in rows.groupby("block")]
        if len(parts) == 1 and key[1] == key[2]:
            hits = [shard(rows).repeats()]
        elif len(parts) == 2:
            a, b = map(shard, parts)
            hits = [b.holds(a), a.holds(b)]
        else:
            hits = [np.zeros(int(p["count"].sum()), bool) for p in parts]
        out = []
        for part, hit in zip(parts, hits):
            ids, tks = part["id"].to_numpy(), part["tk"].to_numpy()
            out += [(ids[r], tks[r], s, e) for r, s, e in spans(hit, part["count"].to_numpy().astype(np.int64), part["first"].to_numpy().astype(np.int64), length)]
        return pd.DataFrame(out, columns=["id", "tk", "start", "end"], dtype="int64")

    mixed_spans = texts.groupBy("t", "i", "j").applyInPandas(search, "id long, tk long, start long, end long")
    return whole.select("id", "tk", F.col("start").cast("long"), F.col("end").cast("long")).unionByName(mixed_spans)


def merged(pairs: list, limit: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, min(e, limit)])
    return [(s, min(e, limit)) for s, e in out]


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """id (with a stand-in for null: rows with the same text lose the same bytes), tk, text, own (the id as it is), and the columns carry as one."""
    more = [F.struct(*carry).alias("carry")] if carry else []
    return docs.select(*more, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("own"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256; with_bytes adds kept and spans; carry: further columns, as one."""
    prepare_workers(docs.sparkSession)
    plain = keyed(docs, id_col, text_col, carry)
    cut = removed_spans(plain, length, gram).groupBy("id", "tk").agg(F.collect_set(F.struct("start", "end")).alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in slices(batches):
            rows = []
            for t, c in zip(raw_texts(b), column(b, "cut").to_pylist()):
                gone = merged([(x["start"], x["end"]) for x in c or ()], len(t))
                at, keep = 0, []
                for s, e in gone:
                    keep.append(t[at:s])
                    at = e
                keep = b"".join([*keep, t[at:]])
                rows.append((len(t), len(t) - len(keep), len(gone), hashlib.sha256(keep).hexdigest(), keep, gone))
            n, removed, count, sha, keep, gone = zip(*rows)
            cols = [column(b, "own"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                cols += [pa.array(keep, pa.binary()), pa.array([[{"start": s, "end": e} for s, e in g] for g in gone], span)]
                names += ["kept", "spans"]
            if carry:
                cols.append(column(b, "carry"))
                names.append("carry")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start:bigint,end:bigint>>" * with_bytes
    if carry:
        schema += f", carry {plain.schema['carry'].dataType.simpleString()}"
    out = plain.join(cut, ["id", "tk"], "left").mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
