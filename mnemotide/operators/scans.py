"""Running values within a key, in order, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def running(
    rows: DataFrame,
    key: list[str],
    order: list[str],
    scratch: Scratch,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    before: bool = False,
    spread: list[str] | None = None,
) -> DataFrame:
    """`rows` with running columns by name, each over the rows of the same key up to and including this one in `order`.

    sums: running sums; maxes: running maxima (structs too, null where none is known yet); previous and following: the
    value one row earlier or later, null at the ends. With `before`, sums and maxima leave the row itself out, and sums
    begin at 0. Null counts as nothing in sums and maxima. Null keys are a key; rows that tie in `order` come in any
    order, so it should name enough columns where that matters. An empty table gives an empty result.

    Ranges of (key, order) are dealt out and written. Each range computes its own running values; what comes before it
    is a fold over one row for each range. Ranges are contiguous, so each continues at most one key from the range
    before and hands at most one on: the table of carries has at most two rows for each range, whatever the input, and
    is broadcast. A key with most rows is many ranges and so many tasks. `spread` names columns that part ties of
    `order`, so that many rows at one place of one key can still be several ranges.
    """
    sums, maxes, previous, following = sums or {}, maxes or {}, previous or {}, following or {}
    parts = scratch.save(rows.repartitionByRange(*key, *order, *(spread or [])).withColumn("_part", F.spark_partition_id()))
    return running_ranges(parts, key, order, scratch, sums, maxes, previous, following, before)


def running_ranges(parts: DataFrame, key: list[str], order: list[str], scratch: Scratch, sums: dict, maxes: dict, previous: dict, following: dict, before: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """The second half of `running`, for written rows whose column `_part` numbers contiguous ranges of (key, order).

    `rows`: what gets the running columns, if not the written rows themselves but a summary of them with the same sums,
    maxima and ends for each range.
    """
    place = F.struct(*order)
    folds = [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()] + [F.max(c).alias(f"_m_{n}") for n, c in maxes.items()]
    folds += [F.max_by(c, place).alias(f"_p_{n}") for n, c in previous.items()] + [F.min_by(c, place).alias(f"_f_{n}") for n, c in following.items()]
    whole, line = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("_part")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    ranges = parts.groupBy(*key, "_part").agg(*folds, F.count(F.lit(1)).alias("_rows")).withColumn("_ranges", F.count(F.lit(1)).over(whole)).where("_ranges > 1")
    carried = [F.sum(f"_s_{n}").over(past).alias(f"_s_{n}") for n in sums] + [F.max(f"_m_{n}").over(past).alias(f"_m_{n}") for n in maxes]
    carried += [F.lag(f"_p_{n}").over(line).alias(f"_p_{n}") for n in previous] + [F.lead(f"_f_{n}").over(line).alias(f"_f_{n}") for n in following]
    keys = [F.col(k).alias(f"_k_{i}") for i, k in enumerate(key)]
    carries = F.broadcast(scratch.save(ranges.select(*keys, F.col("_part").alias("_from"), *carried)))

    own = Window.partitionBy(*key, "_part").orderBy(*order)
    frame = own.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = {f"_l_s_{n}": F.sum(c).over(frame) for n, c in sums.items()} | {f"_l_m_{n}": F.max(c).over(frame) for n, c in maxes.items()}
    local |= {f"_l_p_{n}": F.lag(c).over(own) for n, c in previous.items()} | {f"_l_f_{n}": F.lead(c).over(own) for n, c in following.items()}
    if previous:
        local["_first"] = F.row_number().over(own) == 1
    if following:
        local["_last"] = F.lead(F.lit(1)).over(own).isNull()
    met = (parts if rows is None else rows).withColumns(local)
    meets = F.col("_part") == F.col("_from")
    for i, k in enumerate(key):
        meets &= F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    met = met.join(carries, meets, "left")
    found = {n: F.coalesce(F.col(f"_s_{n}") + F.coalesce(F.col(f"_l_s_{n}"), F.lit(0)), F.col(f"_l_s_{n}"), F.lit(0)) for n, c in sums.items()}
    found |= {n: F.greatest(f"_m_{n}", f"_l_m_{n}") if not _is_struct(parts, c) else _later(F.col(f"_m_{n}"), F.col(f"_l_m_{n}")) for n, c in maxes.items()}
    found |= {n: F.when(F.col("_first"), F.col(f"_p_{n}")).otherwise(F.col(f"_l_p_{n}")) for n in previous}
    found |= {n: F.when(F.col("_last"), F.col(f"_f_{n}")).otherwise(F.col(f"_l_f_{n}")) for n in following}
    kept = [c for c in (parts if rows is None else rows).columns if c != "_part" and c not in found]
    return met.select(*kept, *[c.alias(n) for n, c in found.items()])


def _is_struct(df: DataFrame, c: Column) -> bool:
    return df.select(c.alias("c")).schema["c"].dataType.typeName() == "struct"


def _later(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).when(a > b, a).otherwise(b)
