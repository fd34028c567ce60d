"""Exact top-k search (Fagin's threshold algorithm) and approximate neighbours (additive quantisation).

Both look up a stated query set against all vectors: equal vectors are brought together first, the
distinct ones are dealt into blocks by hash, and each task answers all queries on its block; the answers of
the blocks meet by query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Scratch, slots

#: Distinct vectors in a block, at most; and in a block of a small table, where tasks would be few.
BLOCK, SMALL_BLOCK = 65_536, 4_096
#: Queries in a chunk, and chunks that are broadcast at once (some 30 MB of 64 dimensions).
QUERY_CHUNK, CHUNKS_AT_ONCE = 16_384, 4


def valid(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: with an id, no null or non-finite component."""
    v = F.col("v")
    d = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    d = d.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return d.where(F.exists(v, lambda x: x != 0)) if nonzero else d


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """(v, ids): each distinct vector with its ``copies`` smallest ids. More copies can be in no result.

    Spark cuts each group in every task before the shuffle, so a vector that a third of all rows hold is short.
    """
    n = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    return rows.dropDuplicates(["v", "vec_id"]).withColumn("_n", n).where(F.col("_n") <= copies).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def query_chunks(queries: DataFrame):
    """Queries in chunks of (ids, matrix), each of one length of vector; no more than a chunk a length is held at once."""
    by: dict[int, list] = {}

    def chunk(rows: list) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows])

    for r in queries.toLocalIterator():
        rows = by.setdefault(len(r["v"]), [])
        rows.append(r)
        if len(rows) == QUERY_CHUNK:
            yield chunk(by.pop(len(r["v"])))
    for _, rows in sorted(by.items()):
        yield chunk(rows)


def search(rows: DataFrame, queries: DataFrame, k: int, make: Callable, kind: str, ascending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of all blocks.

    ``make(matrix)`` indexes a block and gives a function of a query, which returns (rows of the block,
    scores): all that can be among the best k + 1 distinct vectors of the block. Ties go to smaller ids. Rows with
    the query's id aren't its candidates, nor are vectors of another length.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    each = scratch.keep(distinct_vectors(rows, k + 1))
    n = each.count()
    blocks = max(1, -(-n // BLOCK), min(slots(spark), -(-n // SMALL_BLOCK)))
    number = pa.int64() if kind == "long" else pa.float64()

    def run(batches, given):
        found: dict[int, list] = {}
        for b in batches:
            v, ids = b.column(0), b.column(1).to_pylist()
            flat, ends = np.asarray(v.flatten()), np.concatenate([[0], np.cumsum(v.value_lengths())])
            for i, x in enumerate(ids):
                found.setdefault(int(ends[i + 1] - ends[i]), []).append((flat[ends[i] : ends[i + 1]], x))
        for size, mine in found.items():
            mine.sort(key=lambda x: x[1])
            ids = [x[1] for x in mine]
            look = make(np.array([x[0] for x in mine]))
            for chunk in given:
                qids, matrix = chunk.value
                if matrix.shape[1] != size:
                    continue
                out: list[tuple] = []
                for qid, q in zip(qids.tolist(), matrix, strict=True):
                    at, scores = look(q)
                    best = sorted((s if ascending else -s, i) for a, s in zip(at.tolist(), scores.tolist(), strict=True) for i in ids[a] if i != qid)[:k]
                    out += [(qid, i, s if ascending else -s) for s, i in best]
                q, i, s = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, number)], names=["query_id", "vec_id", "score"])

    order = W.partitionBy("query_id").orderBy(F.col("score") if ascending else F.desc("score"), "vec_id")
    rank = F.row_number().over(order)
    parts, waiting = [], []

    def answered() -> DataFrame:
        given = [spark.sparkContext.broadcast(x) for x in waiting]
        got = each.repartition(blocks, F.xxhash64("v")).mapInArrow(lambda b: run(b, given), f"query_id long, vec_id long, score {kind}")
        return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    for chunk in query_chunks(queries):
        if len(waiting) == CHUNKS_AT_ONCE:  # more queries than may be broadcast: the blocks are gone through again
            parts.append(scratch.keep(answered()))
            waiting = []
        waiting.append(chunk)
    out = answered()
    for p in parts:
        out = out.unionByName(p)
    return out


# --- exact: Fagin's threshold algorithm ---

K_EXACT, EVERY_EXACT, SCALE, FIRST_DEPTH = 5, 50, 256, 8


def threshold_index(x: np.ndarray, k: int) -> Callable:
    """Sorted lists of a block's dimensions, and the threshold algorithm over them.

    Sorted access goes down all lists at once (from the top where the query is positive, from the bottom
    where it is negative), in steps of doubling depth; what a step first meets is scored in full. The bound
    of the unseen is the sum of the lists' values at the depth; it must fall below the kth score, since an unseen
    vector of equal score may have the smaller id.
    """
    n, d = x.shape
    order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32).copy()  # by dimension, rising
    at = np.take_along_axis(x, order.T.astype(np.int64), axis=0).T.copy()
    exact = x.astype(np.float64)
    stamp = np.zeros(n, np.int64)
    calls = [0]

    def look(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        calls[0] += 1
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        if not len(up) and not len(down):  # all scores are 0: the smallest ids, which come first in the block
            return np.arange(min(n, k + 1)), np.zeros(min(n, k + 1))
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        depth, step = 0, FIRST_DEPTH
        while True:
            to = min(n, depth + step)
            met = np.concatenate([order[up, n - to : n - depth].ravel(), order[down, depth:to].ravel()])
            met = met[stamp[met] != calls[0]]
            stamp[met] = calls[0]
            met = np.unique(met)
            rows, scores = np.concatenate([rows, met]), np.concatenate([scores, exact[met] @ q])
            if len(rows) > k + 1:  # keep the best; equal scores keep the smaller row, whose least id is smaller
                best = np.lexsort((rows, -scores))[: k + 1]
                rows, scores = rows[best], scores[best]
            bound = q[up] @ at[up, n - to] + q[down] @ at[down, to - 1]
            if to == n or len(rows) > k and scores[-1] > bound:
                return rows, scores
            depth, step = to, 2 * to

    return look


def exact_top_k(vectors: DataFrame, *, k: int = K_EXACT, every: int = EVERY_EXACT, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products of floor(scale * x).

    Queries are the rows whose vec_id is divisible by ``every``. Rows without id or vector, and vectors with
    null or non-finite components, take no part; rows that repeat an id and vector count once.
    """
    d = valid(vectors, nonzero=False)
    d = d.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    queries = d.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    return search(d, queries, k, lambda x: threshold_index(x, k), "double", ascending=False).withColumn("score", F.col("score").cast("long"))


# --- approximate: additive quantisation ---

K_NEAR, EVERY_NEAR = 10, 100
#: The codebooks are fitted on this many vectors at most, picked by a hash of the vector; all are encoded.
TRAIN_VECTORS = 8_192
BOOKS, CODES, BEAM, RERANK, ROUNDS, SWEEPS = 16, 256, 8, 256, 2, 3


@dataclass
class AdditiveQuantiser:
    """A vector is approximated by a sum of full-dimensional codewords, one from each book."""

    books: np.ndarray  # books x codes x dimensions

    @staticmethod
    def fit(x: np.ndarray, books: int = BOOKS, codes: int = CODES, seed: int = 3) -> AdditiveQuantiser:
        """Residual k-means for a start; then beam-search codes and least-squares books by turns."""
        rng = np.random.default_rng(seed)
        codes = max(1, min(codes, len(x) // 4))
        rest, found = x.copy(), []
        for _ in range(books):
            c = rest[rng.choice(len(rest), codes, replace=False)]
            for _ in range(8):
                near = ((c**2).sum(axis=1) - 2 * rest @ c.T).argmin(axis=1)
                sums, n = np.zeros_like(c), np.bincount(near, minlength=codes)
                np.add.at(sums, near, rest)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rest[rng.integers(0, len(rest), codes)])
            near = ((c**2).sum(axis=1) - 2 * rest @ c.T).argmin(axis=1)
            rest = rest - c[near]
            found.append(c)
        q = AdditiveQuantiser(np.stack(found))
        for _ in range(ROUNDS):
            code, found = q.encode(x), q.books.copy()
            rest = x - sum(found[m][code[:, m]] for m in range(books))
            for _ in range(SWEEPS):  # least squares, one book at a time
                for m in range(books):
                    sums, n = np.zeros_like(found[m]), np.bincount(code[:, m], minlength=codes)
                    np.add.at(sums, code[:, m], rest)
                    step = sums / np.maximum(n, 1)[:, None]
                    found[m] += step
                    rest -= step[code[:, m]]
            q = AdditiveQuantiser(found)
        return q

    def encode(self, x: np.ndarray, beam: int = BEAM, tile: int = 512) -> np.ndarray:
        """Beam search over the books: the ``beam`` sums with the least error go on from book to book."""
        out = np.zeros((len(x), len(self.books)), np.int64)
        size = self.books.shape[1]
        norms = (self.books**2).sum(axis=2)
        for at in range(0, len(x), tile):
            part = x[at : at + tile]
            rest, picked = part[:, None, :], np.zeros((len(part), 1, 0), np.int64)
            error = (part**2).sum(axis=1)[:, None]
            for m, c in enumerate(self.books):
                e = error[:, :, None] - 2 * (rest @ c.T) + norms[m]
                flat = e.reshape(len(part), -1)
                width = min(beam, flat.shape[1])
                best = np.argpartition(flat, width - 1, axis=1)[:, :width]
                source, code = best // size, best % size
                rest = np.take_along_axis(rest, source[:, :, None], axis=1) - c[code]
                picked = np.concatenate([np.take_along_axis(picked, source[:, :, None], axis=1), code[:, :, None]], axis=2)
                error = np.take_along_axis(flat, best, axis=1)
            out[at : at + tile] = picked[np.arange(len(part)), error.argmin(axis=1)]
        return out

    def index(self, x: np.ndarray, k: int, rerank: int = RERANK) -> Callable:
        """Codes and stored norms of a block; look-up tables score it, the best are ranked by the vectors."""
        codes = self.encode(x)
        approx = sum(self.books[m][codes[:, m]] for m in range(len(self.books)))
        norms = (approx**2).sum(axis=1).astype(np.float32)
        columns = [np.ascontiguousarray(codes[:, m]) for m in range(len(self.books))]

        def look(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            tables = (-2 * (self.books @ q)).astype(np.float32)
            s = norms.copy()
            for t, c in zip(tables, columns, strict=True):
                s += t[c]
            best = np.argpartition(s, rerank - 1)[:rerank] if len(s) > rerank else np.arange(len(s))
            best.sort()
            distance = np.sqrt(((x[best] - q) ** 2).sum(axis=1))
            keep = np.lexsort((best, distance))[: k + 1]
            return best[keep], distance[keep]

        return look


def nearest(vectors: DataFrame, *, k: int = K_NEAR, every: int = EVERY_NEAR, train_vectors: int = TRAIN_VECTORS, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by Euclidean distance (exact, in double precision).

    Queries are the rows whose vec_id is divisible by ``every``. Rows without id or vector, zero vectors and vectors
    with null or non-finite components take no part; rows that repeat an id and vector count once.
    """
    spark = vectors.sparkSession
    d = Scratch(spark).keep(valid(vectors, nonzero=True))
    queries = d.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    n = d.count()
    key = F.pmod(F.xxhash64("v", F.lit("train")), F.lit(1 << 30))
    some = d.where(key < int((1 << 30) * min(1.0, train_vectors / max(1, n)))).select("v").distinct().collect()
    by: dict[int, list] = {}
    for r in some:
        by.setdefault(len(r[0]), []).append(r[0])
    models = spark.sparkContext.broadcast({size: AdditiveQuantiser.fit(np.array(sorted(x))) for size, x in by.items()})

    def make(x: np.ndarray) -> Callable:
        model = models.value.get(x.shape[1]) or AdditiveQuantiser.fit(x)
        return model.index(x, k, rerank)

    return search(d, queries, k, make, "double", ascending=True)
