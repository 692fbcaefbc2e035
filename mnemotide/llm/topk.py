"""Exact top-k search: tiled matrix products, partial selection for each tile, tree merging of the lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def valid_vector(col: str):
    """True for vectors that are neither null nor hold null or non-finite components."""
    bad = F.exists(F.col(col), lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.col(col).isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in double precision; whole numbers, kept as double while products are exact in it."""
    return np.floor(np.asarray(values, dtype=np.float64) * scale)


def _digits(m: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """Whole numbers as digits of so many bits, with their sign, each with its place; exact for doubles of any size.
    Places at which all are 0 are left out, so a number far from the others costs a few digits."""
    sign, rest, out, place = np.sign(m), np.abs(m), [], 0
    while rest.any():
        low = np.fmod(rest, 2.0**bits)
        if low.any():
            out.append((place, sign * low))
        rest, place = (rest - low) / 2.0**bits, place + 1
    return out


def _long_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of any size, cut at the limits of 64 bits: matrix products of digits, added as whole numbers."""
    bits = (53 - max(1, a.shape[1]).bit_length()) // 2
    total = np.zeros((len(a), len(b)), object)
    right = _digits(b, bits)
    for p, x in _digits(a, bits):
        for q, y in right:
            total += (x @ y.T).astype(np.int64).astype(object) << bits * (p + q)
    return np.clip(total, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b, as doubles where all of these are exact, else as 64-bit
    numbers. Only rows whose sums could leave what doubles hold exactly are added in digits; results that 64 bits cannot hold
    are cut at their limits."""
    top_a, top_b = np.abs(a).max(axis=1, initial=0.0), np.abs(b).max(axis=1, initial=0.0)
    with np.errstate(over="ignore", invalid="ignore"):
        wide = np.multiply.outer(top_a * max(1, a.shape[1]), top_b) >= 2.0**53
        plain = a @ b.T
    if not wide.any():
        return plain
    out = np.where(wide, 0, plain).astype(np.int64)
    rows = wide.mean(axis=1) > 0.5
    for some in (np.flatnonzero(rows), np.flatnonzero(~rows & wide.any(axis=1))):
        if len(some):
            cols = np.flatnonzero(wide[some].any(axis=0))
            at = np.ix_(some, cols)
            out[at] = np.where(wide[at], _long_products(a[some], b[cols]), out[at])
    return out


def _select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, best: list) -> None:
    """Merge one tile's scores into the running lists. best: for each query its (scores, ids), sorted."""
    take = ids[None, :] != own[:, None]
    n = scores.shape[1]
    for q in range(scores.shape[0]):
        s, keep = scores[q], take[q]
        old_s, old_i = best[q]
        if len(old_s) == k:
            keep = keep & (s >= old_s[-1])
        elif n > 4 * k:
            # ties at the border stay in, so that the smaller id can win them
            inside = s[keep]
            if len(inside) > k:
                keep = keep & (s >= np.partition(inside, len(inside) - k)[len(inside) - k])
        at = np.flatnonzero(keep)
        if not len(at):
            continue
        s, i = np.concatenate([old_s, s[at].astype(np.int64)]), np.concatenate([old_i, ids[at]])
        order = np.lexsort((i, -s))[:k]
        best[q] = (s[order], i[order])


def _rows(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of a batch, by vector length."""
    ids, vecs = np.asarray(batch.column(0)), batch.column(1)
    lengths = np.diff(np.asarray(vecs.offsets))
    flat = np.asarray(vecs.flatten())
    if len(lengths) and (lengths == lengths[0]).all():
        return {int(lengths[0]): (ids, flat.reshape(len(ids), int(lengths[0])))}
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, int)
    out = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        out[int(d)] = (ids[at], flat[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0)))
    return out


def _tile_search(k: int, scale: float, step: int = 512):
    def run(key, table):
        table = table.combine_chunks()
        asks, ids = np.asarray(table.column("asks")), np.asarray(table.column("id"))
        mat = quantised(np.asarray(table.column("vec").combine_chunks().flatten()).reshape(len(ids), -1), scale)
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        own, queries, cand, names = ids[q], mat[q], mat[c], ids[c]
        empty = np.zeros(0, np.int64)
        best = [(empty, empty)] * len(own)
        for a in range(0, len(own), step):
            some = best[a : a + step]
            if len(c):
                _select(products(queries[a : a + step], cand), names, own[a : a + step], k, some)
            best[a : a + step] = some
        found = [(o, s, i) for o, (s, i) in zip(own, best, strict=True) if len(s)]
        top = [[{"neg": -int(x), "id": int(y)} for x, y in zip(s, i, strict=True)] for _, s, i in found]
        kind = pa.list_(pa.struct([("neg", pa.int64()), ("id", pa.int64())]))
        return pa.table({"query_id": pa.array([o for o, _, _ in found], pa.int64()), "part": pa.array([key[1].as_py()] * len(found), pa.int64()), "top": pa.array(top, kind)})

    return run


def exact_topk(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding", tile_rows: int = 2048, shard_rows: int = 8192, fan_in: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest integer inner product for every query row.

    A score that 64 bits cannot hold is the nearest that they can, so such scores tie.

    Queries are dealt into tiles of about `tile_rows`, candidates into shards of about `shard_rows`; each pair of a tile and a
    shard is one group of one job, with one matrix product for each 512 queries, so a task holds one tile and one shard and
    nothing is broadcast. A pair keeps k rows for each query, and lists meet in a tree of `fan_in` at most. Ties go to
    the smaller id. Vectors that are null, or hold null or non-finite components, take no part; vectors of different
    lengths never meet. Repeated candidate rows take a rank each; a repeated query id counts once, with its smallest
    vector. Rows with a null id take no part. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & valid_vector("vec") & (F.size("vec") > 0))
    asked = scratch.save(good.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vec").alias("vec")))
    tiles, shards = (max(1, -(-df.count() // n)) for df, n in ((asked, tile_rows), (good, shard_rows)))
    first, last = F.lit(0).cast("long"), lambda n: F.lit(n - 1).cast("long")
    # wholly equal rows, of which k can matter, are counted before they move and go to shards of their own
    copies = good.groupBy("id", "vec").agg(F.count(F.lit(1)).alias("n")).select("id", "vec", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))).alias("n"))
    left = asked.select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(tiles)).alias("tile"), F.explode(F.sequence(first, last(shards))).alias("shard"), F.lit(True).alias("asks"), "id", "vec")
    right = copies.select(F.explode(F.sequence(first, last(tiles))).alias("tile"), F.pmod(F.xxhash64("id", "n", F.lit(7)), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "id", "vec")
    lists = left.unionAll(right).withColumn("d", F.size("vec")).groupBy("tile", "shard", "d").applyInArrow(_tile_search(k, scale), "query_id long, part long, top array<struct<neg: bigint, id: bigint>>")
    merge = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
    while shards > fan_in:
        lists = lists.groupBy("query_id", F.floor(F.col("part") / fan_in).alias("part")).agg(merge)
        shards = -(-shards // fan_in)
    row = lists.groupBy("query_id").agg(merge).select("query_id", F.posexplode("top").alias("pos", "hit"))
    return row.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))
