"""Rollups that are kept up to date: daily bitmaps of what carries a name, from which distinct counts over any days come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .windows import placed


def numbered(values: DataFrame, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """(value, n): a number from 0 for each distinct `value`; those that `known` has keep theirs, new ones follow by value.

    Dense numbers keep bitmaps small. Null has no number. New values are numbered by ranges, so no task sees them all.
    """
    fresh = values.where("value is not null").select("value").distinct()
    start = 0
    if known is not None:
        fresh = fresh.join(known.select("value"), "value", "left_anti")
        start = (known.agg(F.max("n")).first()[0] or -1) + 1
    new = placed(fresh, ["value"], scratch).select("value", (F.col("i") + start).cast("long").alias("n"))
    return scratch.save(new if known is None else known.select("value", "n").unionByName(new))


def daily_bitmaps(rows: DataFrame, kinds: dict[str, Column], by: str = "name", day: str = "day") -> DataFrame:
    """(name, day, kind, bucket, bits): for each name and day the numbers of each kind, as bitmaps of 32,768 places.

    kinds: columns of numbers by kind. Bits are set before the shuffle, so a name or day with most rows moves one row for
    each task and bucket. Null names, days and numbers set nothing.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("long").alias("n")) for k, c in kinds.items()]))
    found = rows.select(F.col(by).alias("name"), F.col(day).alias("day"), cells.alias("c")).where("name is not null and day is not null and c.n is not null")
    bucket, place = F.bitmap_bucket_number("c.n").alias("bucket"), F.bitmap_bit_position("c.n")
    return found.withColumn("place", place).groupBy("name", "day", "c.kind", bucket).agg(F.bitmap_construct_agg("place").alias("bits"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables of bitmaps as one; days that both have, as late rows bring, are joined bit by bit. Repeated rows change nothing."""
    return old.unionByName(new).groupBy("name", "day", "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def span_counts(bitmaps: DataFrame, kinds: tuple[str, ...], first: Column | None = None, last: Column | None = None) -> DataFrame:
    """(name, a distinct count of each kind, days) over the days from first to last, ends included; none given, over all."""
    rows = bitmaps
    if first is not None:
        rows = rows.where(F.col("day") >= first)
    if last is not None:
        rows = rows.where(F.col("day") <= last)
    days = rows.select("name", "day").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("days"))
    whole = rows.groupBy("name", "kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("c"))
    counts = whole.groupBy("name").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("c"))), F.lit(0)).alias(k) for k in kinds])
    return counts.join(days, "name")
