"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links of every node's larger neighbours to its smallest one, the table of minima they rest on)."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionAll(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    low = scratch.save(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
    return both.where("b > a").join(low, "a").select(F.col("low").alias("u"), F.col("b").alias("v")), low


def _small_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    low = scratch.save(edges.groupBy("v").agg(F.min("u").alias("low")))
    moved = edges.join(low, "v").where("u <> low").select(F.col("low").alias("u"), F.col("u").alias("v"))
    return low.select(F.col("low").alias("u"), "v").unionAll(moved).distinct(), low


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _at_once(table: pa.Table) -> pa.Table:
    """Components of all edges of one task: labels fall to the smallest of both ends until none does."""
    u, v = table.column("u").to_pylist(), table.column("v").to_pylist()
    names = sorted({*u, *v})
    place = {n: i for i, n in enumerate(names)}
    a, b = (np.fromiter((place[x] for x in side), np.int64, len(side)) for side in (u, v))
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    kind = table.schema.field("u").type
    return pa.table({"node": pa.array(names, kind), "component": pa.array([names[i] for i in label], kind)})


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60, local_edges: int = 0) -> DataFrame:
    """(node, component) for every node of the undirected `edges` (u, v); component is the smallest node reachable.

    A hub with a third of all edges is safe: minima are combined before the shuffle and written, so that they join
    as a table with one row for each key, and the hub's side of the join can be split among tasks. Nulls and loops
    are dropped. At most `local_edges` edges go through one task instead, with the same result and without the rounds.
    """
    e = scratch.save(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before = _digest(e)
    if 0 < before[0] <= local_edges:
        kind = e.schema["u"].dataType.simpleString()
        return scratch.save(e.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda table: _at_once(table), f"node {kind}, component {kind}"))
    rounds = 0
    while before[0]:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        large, low_1 = _large_star(e, scratch)
        large = scratch.save(large)
        small, low_2 = _small_star(large, scratch)
        nxt = scratch.save(small)
        after = _digest(nxt)
        for used in (e, low_1, low_2, large):
            scratch.drop(used)
        e = nxt
        if after == before:
            break
        before = after
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
