"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one row kept for each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..scratch import Scratch
from .topk import _rows, valid_vector


def unit(mat: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; first by their largest component, so that no square overflows."""
    mat = np.asarray(mat, np.float64)
    mat = mat / np.abs(mat).max(axis=1, initial=0.0)[:, None]
    return mat / np.sqrt((mat * mat).sum(axis=1))[:, None]


def spherical_kmeans(points: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of `points` (unit rows); an emptied cell restarts at the point that fits worst."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(points)))
    centres = points[rng.choice(len(points), cells, replace=False)].copy()
    for _ in range(rounds):
        sims = points @ centres.T
        home = sims.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        norms = np.sqrt((sums * sums).sum(axis=1))
        worst = iter(np.argsort(sims.max(axis=1), kind="stable"))
        for c in np.flatnonzero(norms < 1e-12):
            sums[c], norms[c] = points[next(worst)], 1.0
        centres = sums / norms[:, None]
    return centres


def nearest(mat: np.ndarray, centres: np.ndarray, probes: int, cells: int = 1 << 20) -> np.ndarray:
    """Each row's `probes` nearest of `centres`, the lower number at ties; the products in hand have about `cells` cells."""
    m = min(probes, len(centres))
    out = np.empty((len(mat), m), np.int64)
    step = max(1, cells // len(centres))
    for at in range(0, len(mat), step):
        out[at : at + step] = np.argsort(-(unit(mat[at : at + step]) @ centres.T), axis=1, kind="stable")[:, :m]
    return out


def _assign(centres: np.ndarray | None, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (_, mat) in _rows(batch.select(["id", "vec"])).items():
                at = np.flatnonzero(np.diff(np.asarray(batch.column("vec").offsets)) == d)
                part = batch.take(pa.array(at))
                if centres is not None and centres.shape[1] == d:
                    near = nearest(mat, centres, probes)
                else:  # vectors of another length than the sample's: one cell for each length
                    near = np.full((len(at), 1), -1 - d)
                cells = pa.array(np.sort(near, axis=1).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("weight"), part.column("vec"), cells], names=["id", "weight", "vec", "cells"])

    return run


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest cell that both rows have; a, b: sorted cells, a row for each pair."""
    hit = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return a[np.arange(len(a)), hit.argmax(axis=1)]


def local_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links (x, y)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(threshold: float):
    def run(key, table):
        cell, left, right = (k.as_py() for k in key)
        table = table.combine_chunks()
        block = np.asarray(table.column("block"))
        order = np.argsort(np.asarray(table.column("id")), kind="stable")
        block = block[order]
        ids, weight = np.asarray(table.column("id"))[order], np.asarray(table.column("weight"))[order]
        vecs = table.column("vec").combine_chunks()
        mat = unit(np.asarray(vecs.flatten()).reshape(len(ids), -1))[order]
        cells = np.array(table.column("cells").to_pylist(), np.int32)[order]
        if left == right:
            x, y = np.nonzero(np.triu(mat @ mat.T >= threshold, 1))
        else:
            a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
            x, y = np.nonzero(mat[a] @ mat[b].T >= threshold)
            x, y = a[x], b[y]
        once = first_common(cells[x], cells[y]) == cell
        x, y = x[once], y[once]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
        root = local_roots(len(ids), x, y)
        hit = np.flatnonzero(links)
        return pa.table({"id": ids[hit], "links": links[hit], "root": ids[root[hit]]})

    return run


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.95, target_cell: int = 2048, max_cells: int = 4096, probes: int = 4, sample_rows: int = 16384, block_rows: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links are pairs with a cosine >= threshold.

    Exact copies collapse to one row with a weight before anything is compared. Spherical k-means is fitted on
    at most `sample_rows` distinct vectors (those with the lowest hash); every vector is then assigned to its
    `probes` nearest cells, and pairs that share a cell are compared in double precision. A pair counts in the
    first cell that both have, so no link counts twice. A cell with more than `block_rows` rows is dealt out as
    pairs of blocks, so no task holds more than two blocks. Tasks return counts and local roots, never pairs.
    A link is missed only where two vectors that close share none of their nearest cells; tests measure this.

    Null, zero and non-finite vectors link with nothing and stay. Vectors of another length never link. Rows
    that repeat an id are vectors of their own. Rows with a null id stay without links. Empty in, empty out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vecdedup")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    usable = F.col("id").isNotNull() & valid_vector("vec") & F.coalesce(F.exists("vec", lambda c: c != 0), F.lit(False))
    key = [F.when(usable, F.xxhash64("vec")).alias("h1"), F.when(usable, F.xxhash64(F.lit(1), F.reverse("vec"))).alias("h2")]
    keyed = rows.select("id", "vec", *key)
    reps = scratch.save(keyed.where(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec")))
    total = reps.count()
    centres = None
    if total:
        found = reps.orderBy("h1", "h2").limit(sample_rows).select("vec").collect()
        lengths = [len(r.vec) for r in found]
        d = max(set(lengths), key=lambda n: (lengths.count(n), n))
        centres = spherical_kmeans(unit(np.array([r.vec for r in found if len(r.vec) == d])), min(max_cells, -(-total // target_cell)))
    placed = scratch.save(reps.select("id", "weight", "vec").mapInArrow(_assign(centres, probes), f"id long, weight long, vec {vectors.schema[vec_col].dataType.simpleString()}, cells array<int>"))
    spread = placed.select("id", "weight", "vec", "cells", F.explode("cells").alias("cell"))
    # at most max_cells rows, and one more for each vector length
    sizes = spread.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    blocked = spread.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "id", "weight", "vec", "cells", "block")
    links = scratch.save(dealt.groupBy("cell", "left", "right").applyInArrow(_links(threshold), "id long, links long, root long"))
    comps = connected_components(links.select(F.col("id").alias("u"), F.col("root").alias("v")), scratch)
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    known = reps.select("h1", "h2", "id", "weight").join(counts, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = keyed.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
