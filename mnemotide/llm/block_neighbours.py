"""Nearest neighbours by a block matrix join: int8 tiles bound every cosine, surviving pairs are recomputed, heaps merge."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .topk import valid_vector
from .vec_dedup import unit

SLACK = 1e-9  # beyond the rounding of double precision in a bound
STEP_QUERIES, STEP_ROWS, STEP_PAIRS = 256, 2048, 32768


def codes(mat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the decoded row, length of what decoding loses) for the rows of `mat` scaled to length 1."""
    u = unit(mat)
    scale = np.abs(u).max(axis=1) / 127
    code = np.rint(u / scale[:, None]).astype(np.int8)
    back = code * scale[:, None]
    return code, scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((u - back) ** 2).sum(axis=1))


def tile_products(a: np.ndarray, b: np.ndarray, width: int = 1024) -> np.ndarray:
    """Inner products of int8 rows. Sums of up to 1,024 products of bytes are whole numbers below 2^24, which single precision
    adds without error, so the fast matrix product is exact; longer rows are added up from pieces."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], width):
        out += a[:, at : at + width].astype(np.float32) @ b[:, at : at + width].astype(np.float32).T
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision: components are added in their order, then dot / sqrt(|a|^2 |b|^2).

    Rows whose squares leave the range of doubles are scaled by their largest component first.
    """
    def sums(x, y):
        s = np.zeros(len(x))
        for j in range(x.shape[1]):
            s += x[:, j] * y[:, j]
        return s

    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        size = sums(a, a) * sums(b, b)
        out = sums(a, b) / np.sqrt(size)
    odd = np.flatnonzero(~((size > 1e-280) & (size < 1e280)))
    if len(odd):
        x, y = (m[odd] / np.abs(m[odd]).max(axis=1)[:, None] for m in (a, b))
        out[odd] = sums(x, y) / np.sqrt(sums(x, x) * sums(y, y))
    return np.clip(out, -1.0, 1.0)


class _Best:
    """The k best (score, id) of one query: a heap with the worst on top; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def floor(self) -> float:
        return self.heap[0][0] if len(self.heap) == self.k else -np.inf

    def add(self, score: float, i: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -i))
        elif (score, -i) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -i))


def _search(k: int, stats: bool = False):
    def run(key, table):
        table = table.combine_chunks()
        asked = np.asarray(table.column("asks"))
        ids_of = table.column("ids").to_pylist()
        flat = table.column("vec").combine_chunks().flatten()
        mat = np.asarray(flat, np.float64).reshape(len(asked), -1)
        q, c = np.flatnonzero(asked), np.flatnonzero(~asked)
        order = c[np.argsort([ids_of[i][0] for i in c], kind="stable")] if len(c) else c
        qm, cm = mat[q], mat[order]
        cand = [ids_of[i] for i in order]
        own = np.array([ids_of[i][0] for i in q], np.int64)
        alone = defaultdict(list)  # rows that are no candidate for the query of that id
        for n, i in enumerate(cand):
            if len(i) == 1:
                alone[i[0]].append(n)
        best, looked = [_Best(k) for _ in q], 0
        if len(q) and len(c):
            qc, qs, _, qe = codes(qm)
            cc, cs, cl, ce = codes(cm)
            for a in range(0, len(q), STEP_QUERIES):
                rows = np.arange(a, min(a + STEP_QUERIES, len(q)))
                for b in range(0, len(c), STEP_ROWS):
                    cols = np.arange(b, min(b + STEP_ROWS, len(c)))
                    near = tile_products(qc[rows], cc[cols]) * (qs[rows, None] * cs[None, cols])
                    loss = qe[rows, None] * cl[None, cols] + ce[None, cols] + SLACK
                    for r, i in enumerate(rows):
                        for n in alone.get(int(own[i]), ()):
                            if b <= n < b + len(cols):
                                near[r, n - b] = -np.inf
                    floor = np.array([best[i].floor() for i in rows])
                    if len(cols) >= k:
                        floor = np.maximum(floor, np.partition(near - loss, len(cols) - k, axis=1)[:, len(cols) - k])
                    x, y = np.nonzero((near + loss >= floor[:, None]) & np.isfinite(near))
                    looked += len(x)
                    for s in range(0, len(x), STEP_PAIRS):
                        i, j = rows[x[s : s + STEP_PAIRS]], cols[y[s : s + STEP_PAIRS]]
                        score = cosines(qm[i], cm[j])
                        turn = np.lexsort((j, -score, i))  # the best of each query first: the rest of its pairs then fail at the floor
                        for p in turn:
                            if score[p] >= best[i[p]].floor():
                                for n in cand[j[p]]:
                                    if n != own[i[p]]:
                                        best[i[p]].add(float(score[p]), n)
        hits = [(int(o), -n, s) for o, h in zip(own, best, strict=True) for s, n in h.heap]
        columns = [pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64())]
        names = ["query_id", "vec_id", "score"]
        if stats:
            columns, names = [*columns, pa.array([looked] * len(hits), pa.int64())], [*names, "looked"]
        return pa.Table.from_arrays(columns, names=names)

    return run


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5, tile_queries: int = 2048, block_rows: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row the k rows with the largest cosine, nearest first.

    Queries are dealt into tiles and candidates into blocks; each pair of a tile and a block is one task with int8 codes of
    both. The error of a product of codes is bounded by what coding loses of either row, so a pair whose upper bound is
    below the k-th lower bound cannot be among the nearest; all others are recomputed from the original vectors and go through
    a heap for each query, whose floor prunes what follows. A task returns k rows for each query at most, however many
    pairs tie or nearly tie; lists of blocks merge by a partial top k before the shuffle. So the result is exact (recall 1).

    Exact copies collapse to one candidate with their k + 1 smallest ids before anything is dealt out, so a vector that a third of
    all rows share is compared once. A row is no candidate for a query with the same id; ids that repeat with other vectors
    are candidates once each and rank once for each, but an id that repeats with the same vector counts once. A repeated query
    id asks once, with its smallest vector. Null, zero and non-finite vectors and rows with a null id take no part; vectors of
    different lengths never meet. Ties go to the smaller id. Fewer candidates than k give all. Empty in, empty out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    good = rows.where(F.col("id").isNotNull() & valid_vector("vec") & F.coalesce(F.exists("vec", lambda c: c != 0), F.lit(False)))
    keyed = good.groupBy(F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), F.reverse("vec")).alias("h2"), "id").agg(F.first("vec").alias("vec"))
    least = keyed.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k + 1)  # limited before the shuffle
    reps = scratch.save(least.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec")))
    asked = scratch.save(good.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vec").alias("vec")))
    tiles, blocks = (max(1, -(-df.count() // n)) for df, n in ((asked, tile_queries), (reps, block_rows)))
    d, zero = F.size("vec").alias("d"), F.lit(0).cast("long")
    left = asked.select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(tiles)).alias("tile"), F.explode(F.sequence(zero, F.lit(blocks - 1).cast("long"))).alias("block"), d, F.lit(True).alias("asks"), F.array("id").alias("ids"), "vec")
    right = reps.select(F.explode(F.sequence(zero, F.lit(tiles - 1).cast("long"))).alias("tile"), F.pmod(F.xxhash64("h1", "h2", F.lit(7)), F.lit(blocks)).alias("block"), d, F.lit(False).alias("asks"), "ids", "vec")
    found = left.unionAll(right).groupBy("tile", "block", "d").applyInArrow(_search(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
