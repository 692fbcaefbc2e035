"""Hybrid search over blocks of near vectors: blocks whose best possible score is below the k-th found are never read."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import fit_centres, usable
from ..functions.vectors import cosine
from ..model import days_between
from ..scratch import Scratch
from .retrieval import DECAY, hybrid_search, importance_rank, question_keywords, weights
from .substrings import SIZE, grams

TEXTS = ("query", "episodic_text")

MARGIN = 1e-6  # beyond the rounding of angles and sums; a bound that is a little high costs a read, never a row


def _near(centres: np.ndarray):
    """Each vector's nearest centre and the angle to it."""

    @F.pandas_udf("struct<home: int, angle: double>")
    def place(vectors):
        import pandas as pd

        m = np.stack(vectors.to_list()).astype(np.float64) if len(vectors) else np.zeros((0, centres.shape[1]))
        m = m / np.abs(m).max(axis=1, initial=0.0)[:, None]
        near = (m / np.sqrt((m * m).sum(axis=1))[:, None]) @ centres.T
        home = near.argmax(axis=1)
        return pd.DataFrame({"home": home.astype(np.int32), "angle": np.arccos(np.clip(near[np.arange(len(home)), home], -1.0, 1.0))})

    return place(F.col("embedding"))


class BlockIndex:
    """Nodes in blocks under `path`, and a summary with one row for each block.

    `build` deals nodes out by the nearest of at most 4,096 centres, fitted to a bounded sample of vectors, and by
    importance, so that a block is narrow in what weighs most. A summary row holds the block's centre, its largest angle,
    its newest time (null where a row has none, as such rows count as new) and its importance. Vectors that have no direction (null, zero, odd components, another length than
    `dim`) are blocks of their own whose cosine is at most 0. A block may be any number of files, so one with a third of
    all rows is written and read by many tasks. Of the texts, the index holds which three-character grams a block has,
    sorted by gram: a keyword of which a block lacks a gram is in none of its rows. All columns of the nodes are kept; extra ones are no matter, but `block`,
    `_at` and `_rank` are the index's own. An empty table gives an index that finds nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        shape = spark.read.parquet(f"{path}/shape").schema  # folders of blocks tell no types, and an empty table has no folders
        self.rows = spark.read.schema(shape).parquet(f"{path}/rows")
        self.blocks, self.grams = (spark.read.parquet(f"{path}/{part}") for part in ("blocks", "grams"))

    @classmethod
    def build(cls, nodes: DataFrame, path: str, dim: int, block_rows: int = 65_536, sample: int = 16_384, texts: tuple[str, ...] = TEXTS) -> BlockIndex:
        spark = nodes.sparkSession
        fits = usable("embedding") & (F.size("embedding") == dim)
        centres = fit_centres(nodes.where(fits).select("id", "embedding"), dim, block_rows, sample)
        rank = (importance_rank() * 10).cast("int")
        none = F.struct(F.lit(-1).alias("home"), F.lit(math.pi).alias("angle"))
        # rows with and without a direction apart, as the placing takes only the former
        placed = nodes.where(fits).withColumn("_at", _near(centres)).unionByName(nodes.where(~fits).withColumn("_at", none))
        placed = placed.withColumn("_rank", rank).withColumn("block", F.concat_ws("-", F.col("_at.home"), F.col("_rank")))
        placed.hint("rebalance", "block").write.partitionBy("block").parquet(f"{path}/rows")
        middle = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "home int, centre array<double>")
        placed.limit(0).write.parquet(f"{path}/shape")
        written = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        summary = written.groupBy("block").agg(F.first("_at.home").alias("home"), F.first("_rank").alias("rank"), F.max("_at.angle").alias("angle"), F.when(F.count_if(F.col("ts").isNull()) == 0, F.max("ts")).alias("newest"), F.count(F.lit(1)).alias("n"))
        summary.join(F.broadcast(middle), "home", "left").write.parquet(f"{path}/blocks")
        text = F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts if t in nodes.columns])
        held = written.select("block", F.explode(grams(text)).alias("gram")).distinct()
        held.repartitionByRange("gram").sortWithinPartitions("gram", "block").write.parquet(f"{path}/grams")
        return cls(spark, path)

    def bounds(self, question: str, query_vector: list[float], as_of: Column) -> DataFrame:
        """(block, n, bound): no row of the block scores higher. By the triangle inequality a row's angle to the question is at
        least its centre's less the block's largest; a keyword counts where the block has all of its grams. The texts asked
        for must be those of the index."""
        w = weights(question)
        asked = F.array(*[F.lit(float(x)) for x in query_vector])
        apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("centre"), asked)))) - F.col("angle")
        near = F.when(F.col("home") < 0, 0.0).when(F.lit(not any(query_vector)), 0.0).otherwise(F.cos(F.greatest(F.lit(0.0), apart)))
        fresh = F.exp(-DECAY * F.greatest(F.lit(0.0), F.coalesce(days_between(as_of, F.col("newest")), F.lit(0.0))))
        words = question_keywords(question)
        parts = {k: sorted({k[i : i + SIZE] for i in range(len(k) - SIZE + 1)}) for k in words}
        held = self.grams.where(F.col("gram").isin(*{g for p in parts.values() for g in p})).groupBy("block").agg(F.collect_set("gram").alias("held"))
        here = [F.forall(F.array(*map(F.lit, p)), lambda g: F.array_contains("held", g)).cast("int") if p else F.lit(1) for p in parts.values()]
        share = sum(here, F.lit(0)) / F.lit(float(len(words) or 1))
        blocks = self.blocks.join(held, "block", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
        return blocks.select("block", "n", (w[0] * near + w[1] * fresh + w[2] * share + w[3] * F.col("rank") / 10.0 + MARGIN).alias("bound"))

    def to_read(self, question: str, query_vector: list[float], as_of: Column, scratch: Scratch, k: int = 10, session: str | None = None, texts: tuple[str, ...] = TEXTS, first: int = 8) -> DataFrame:
        """(block, n, bound) of the blocks that can hold one of the k best: those whose bound reaches the k-th score within the
        `first` blocks of the highest bounds; all, where those hold fewer than k rows that count."""
        bounds = scratch.save(self.bounds(question, query_vector, as_of))
        lead = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]
        some = hybrid_search(self.rows.where(F.col("block").isin(*lead)), question, query_vector, as_of, k, session, texts)
        found = some.agg(F.count("score").alias("n"), F.min("score").alias("kth")).first()
        return bounds.where(F.col("bound") >= found.kth) if found.n >= k else bounds

    def search(self, question: str, query_vector: list[float], as_of: Column, scratch: Scratch, k: int = 10, session: str | None = None, texts: tuple[str, ...] = TEXTS, first: int = 8) -> DataFrame:
        """The same rows as `hybrid_search` over all nodes, ties by id, from the blocks of `to_read` alone: blocks are folders,
        and the list of those wanted, a table of one row each, prunes them as the scan starts."""
        wanted = self.to_read(question, query_vector, as_of, scratch, k, session, texts, first).select("block")
        return hybrid_search(self.rows.join(wanted, "block", "left_semi"), question, query_vector, as_of, k, session, texts).drop("block", "_at", "_rank")
