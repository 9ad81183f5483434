"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

The index is fitted on at most SAMPLE rows (those of the smallest hash of their id): coarse centroids by
k-means, about the square root of the table's rows in number (at most SAMPLE / 20), and for each of PARTS slices of the residual a
codebook of at most CODES words. How many lists a query visits is measured on the sample too: as few as hold the share RECALL
of the true nearest neighbours of up to TRIALS sample rows, by brute force within the sample. In the whole table, which is
denser, neighbours are nearer and the share is higher; vectors that cluster need few lists, vectors that don't need many. Every valid row is then
assigned to its centroid's list and stored with its code, the distance between itself and what its code stands
for, and its original vector. A query visits the lists of its nearest centroids. In a list the asymmetric
distance table gives d', which is off by at most that stored distance e: a row with d' - e above the k-th
smallest d' + e can't be among the k nearest. All other rows are reranked exactly, so nothing that the visited
lists hold is lost, even among thousands of near copies.

Lists meet queries in blocks of at most about BLOCK_ROWS rows and BLOCK_QUERIES queries, dealt by a hash of the id.

Defined results: rows that repeat with id and vector count once. Vectors that are null, zero, of another length than the fitted ones, or that hold null or
non-finite components take no part, nor do rows without id. Ties go to the smaller id. A query visits further
lists until these hold more than k rows, so with few rows it gets all candidates. No valid rows: no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raggedlake.llm.text import column
from raggedlake.plans.session import materialize, prepare_workers, table

SAMPLE, SEED, PARTS, CODES, ROUNDS = 20_000, 11, 8, 64, 8
#: Share of the sample's true neighbours that the visited lists must hold, and the sample rows tried.
RECALL, TRIALS = 0.96, 500
#: Rows of a list, and queries, that one task compares at a time.
BLOCK_ROWS, BLOCK_QUERIES = 8_000, 8_000


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centers)
        n = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ centers.T - half, 1) for i in range(0, len(x), 8192)]) if len(x) else np.empty(0, np.int64)


class Codebooks:
    """Coarse centroids and residual codebooks; small, of a size fixed by the parameters."""

    def __init__(self, x: np.ndarray, lists: int | None = None, parts: int = PARTS, codes: int = CODES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dim = x.shape[1]
        self.coarse = kmeans(x, max(1, min(lists or int(len(x) ** 0.5), len(x))), rng)
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.cuts = np.linspace(0, self.dim, min(parts, self.dim) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], codes, rng) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and distance to what these stand for, of each row."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        code = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)], 1).astype(np.uint8)
        stands = np.concatenate([book[code[:, p]] for p, book in enumerate(self.books)], 1)
        return at, code, np.sqrt(((rest - stands) ** 2).sum(1))

    def needed(self, x: np.ndarray, k: int, share: float = RECALL, trials: int = TRIALS, seed: int = SEED) -> int:
        """How many lists hold this share of the k nearest rows of x to rows of x, on average."""
        at = nearest(x, self.coarse)
        picks = np.random.default_rng(seed).permutation(len(x))[:trials]
        ranks = []
        for i in range(0, len(picks), 64):
            mine = picks[i : i + 64]
            dist = (x**2).sum(1)[None] - 2 * x[mine] @ x.T
            dist[np.arange(len(mine)), mine] = np.inf
            found = np.argpartition(dist, min(k, len(x) - 1) - 1, 1)[:, : min(k, len(x) - 1)] if len(x) > 1 else np.empty((len(mine), 0), int)
            order = np.argsort((self.coarse**2).sum(1)[None] - 2 * x[mine] @ self.coarse.T, 1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
            ranks.append(np.take_along_axis(place, at[found], 1).ravel())
        ranks = np.sort(np.concatenate(ranks))
        return 1 + int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)]) if len(ranks) else 1

    def distances(self, q: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
        """Asymmetric distances from one query to coded rows of list at."""
        rest = q - self.coarse[at]
        total = np.zeros(len(code))
        for p, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            total += ((self.books[p] - rest[a:b]) ** 2).sum(1)[code[:, p]]
        return np.sqrt(total)


def valid(vec: Column) -> Column:
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return vec.isNotNull() & F.forall(vec, fine) & F.exists(vec, lambda v: v != 0)


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float64).reshape(-1, dim)


def search(vectors: DataFrame, is_query: Column, k: int = 10, probed: float | None = None, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query row, exact distances.

    probed: the share of the lists that a query visits, in place of the measured number.
    """
    spark = vectors.sparkSession
    prepare_workers(spark)
    schema = f"query_id long, rank int, {id_col} long, score double"
    rows = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q"))
    taken = [r.vec for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()]  # bounded by sample
    if not taken:
        return spark.createDataFrame([], schema)
    sizes = pd.Series([len(v) for v in taken]).value_counts()
    dim = int(sizes.index[0])
    fitted = np.array([v for v in taken if len(v) == dim])
    books = Codebooks(fitted, lists or max(1, min(int(rows.count() ** 0.5), len(fitted) // 20)))
    shared = spark.sparkContext.broadcast(books)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = column(b, "vec").flatten().to_numpy().reshape(-1, dim)
                at, code, err = shared.value.encode(x)
                data = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "q"), pa.array(at, pa.int32()), data(code), pa.array(err), data(x)], ["id", "q", "list", "code", "err", "vec"])

    indexed = rows.where(F.size("vec") == dim).mapInArrow(index, "id long, q boolean, list int, code binary, err double, vec binary")
    indexed = materialize(indexed, "ivfpq")
    counts = {r["list"]: (r.n, r.q) for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("q")).collect()}  # a row a list
    n_lists = len(books.coarse)
    sizes_of = np.array([counts.get(i, (0, 0))[0] for i in range(n_lists)])
    row_blocks = np.maximum(1, -(-sizes_of // BLOCK_ROWS))
    visit = max(1, round(probed * n_lists)) if probed is not None else books.needed(fitted, k)
    # the queries that visit a list are at most all, and about the share of lists that a query visits
    n_queries = sum(q for _, q in counts.values())
    query_blocks = max(1, -(-int(n_queries * min(1.0, 2 * visit / n_lists)) // BLOCK_QUERIES))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(column(b, "vec").to_pylist(), dim)
            dist = (shared.value.coarse**2).sum(1)[None] - 2 * x @ shared.value.coarse.T
            order = np.argsort(dist, 1, kind="stable")
            held = np.cumsum(sizes_of[order], 1)
            rank_needed = np.minimum((held <= k).sum(1) + 1, n_lists)
            ids, vecs = column(b, "id").to_pylist(), column(b, "vec").to_pylist()
            out = [(ids[i], int(at), int(block), xxhash.xxh3_64_intdigest(str(ids[i])) % query_blocks, vecs[i]) for i in range(len(ids)) for at in order[i, : max(visit, rank_needed[i])] if sizes_of[at] for block in range(row_blocks[at])]
            for s in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[s : s + 20_000]), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["query_id", "list", "block", "qblock", "qvec"])

    asked = indexed.where("q").select("id", "vec").mapInArrow(probes, "query_id long, list int, block int, qblock int, qvec binary")
    blocks = F.element_at(F.array(*[F.lit(int(n)) for n in row_blocks]), F.col("list") + 1)
    held = indexed.select("list", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qblock"), "id", "code", "err", "vec")

    def compare(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            b = shared.value
            rows = rows.drop_duplicates(["id", "vec"])
            ids = rows["id"].to_numpy()
            x = _matrix(rows["vec"], dim)
            code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            err = rows["err"].to_numpy() * (1 + 1e-9) + 1e-9
            for qid, q in zip(queries["query_id"], _matrix(queries["qvec"], dim)):
                d = b.distances(q, key[0], code)
                other = ids != qid
                high = np.where(other, d + err, np.inf)
                bound = np.partition(high, k - 1)[k - 1] if len(high) > k else np.inf
                keep = np.flatnonzero(other & (d - err <= bound))
                exact = np.sqrt(((x[keep] - q) ** 2).sum(1))
                best = np.lexsort((ids[keep], exact))[:k]
                found.append(pd.DataFrame({"query_id": qid, "id": ids[keep][best], "score": exact[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    key = ["list", "block", "qblock"]
    pairs = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(compare, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = pairs.dropDuplicates(["query_id", "id", "score"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op3_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
