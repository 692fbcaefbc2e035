"""Packing: optimal length buckets by dynamic programming over the global histogram, token-budget batches inside."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def word_count(text: str) -> Column:
    """Tokens of a text: runs of anything but blanks; null counts as empty."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def optimal_boundaries(levels: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` ranges of sorted levels with the least total length after padding.

    best[j] = min over i < j of best'[i] + level[j] * (rows in i+1..j). The cost is a Monge array, so the best i
    does not fall as j grows; each layer is solved by halving the range of j. Ties go to the smallest i.
    """
    m = len(levels)
    if not m:
        return []
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    levels = levels.astype(np.int64)
    best = levels * upto[1:]
    choice = []
    for layer in range(1, min(buckets, m)):
        new, arg = np.full(m, np.iinfo(np.int64).max // 2), np.zeros(m, np.int64)
        todo = [(layer, m - 1, layer - 1, m - 2)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + levels[j] * (upto[j + 1] - upto[i + 1])
            at = int(cost.argmin())
            new[j], arg[j] = cost[at], i[at]
            todo += [(lo, j - 1, a, int(i[at])), (j + 1, hi, int(i[at]), b)]
        best = new
        choice.append(arg)
    j, out = m - 1, [int(levels[-1])]
    for arg in reversed(choice):
        j = int(arg[j])
        out.append(int(levels[j]))
    return out[::-1]


def pack(docs: DataFrame, budget: int = 65536, buckets: int = 8, shard_rows: int = 250_000, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_length, batch, slot) for every row of `docs`.

    The histogram of all lengths goes to the driver, which chooses the boundaries; it has a row of two numbers for each
    length that occurs, so no more than the longest text has tokens. A bucket's padded length is the largest length in it.
    Every batch of a bucket holds max(1, budget // padded_length) rows, so only the last one of each bucket is short.
    Rows are numbered without a global sort: by (hash of the id, id) within each bucket, from the counts of the groups
    that share the first digits of the hash and a row number inside each. The digits grow with the rows, so a group has
    about `shard_rows` rows at most, and the numbers do not depend on how many there are.

    Null and empty texts have length 0. A text longer than the budget is a batch of its own and is never cut.
    Null ids come first by the hash of nothing. Repeated rows are packed each. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    ident = F.col(id_col).cast("long")
    lens = scratch.save(docs.select(ident.alias("id"), (word_count(text_col) if length is None else length.cast("long")).alias("n")))
    hist = lens.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).toPandas().sort_values("n")
    bounds = optimal_boundaries(hist.n.to_numpy(np.int64), hist.rows.to_numpy(np.int64), buckets) or [0]
    bucket, padded = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for b in range(len(bounds) - 2, -1, -1):
        bucket, padded = F.when(F.col("n") <= bounds[b], b).otherwise(bucket), F.when(F.col("n") <= bounds[b], F.lit(bounds[b])).otherwise(padded)
    digits = 2
    while 16**digits * shard_rows < hist.rows.sum():
        digits += 1
    spot = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    placed = lens.select("id", "n", bucket.cast("int").alias("bucket"), padded.cast("long").alias("padded_length"), spot.alias("spot")).withColumn("shard", F.substring("spot", 1, digits))
    counts = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("spot", "id", "n")) - 1
    numbered = placed.withColumn("at", inside).join(scratch.save(starts), ["bucket", "shard"])
    at, room = F.col("start") + F.col("at"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_length"), F.lit(1))))
    return numbered.select(F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), "bucket", "padded_length", F.floor(at / room).cast("long").alias("batch"), F.pmod(at, room).cast("long").alias("slot"))


def pack_sql(budget: int = 65536, buckets: int = 8) -> str:
    """The same in DuckDB SQL, with one subquery for each layer of the dynamic programme."""
    layers = ["d1 as (select j, [l] as path, l * upto as cost from h)"]
    for k in range(2, buckets + 1):
        layers.append(
            f"d{k} as (select j, path, cost from (select b.j, list_append(a.path, b.l) as path, a.cost + b.l * (b.upto - s.upto) as cost, "
            f"row_number() over (partition by b.j order by a.cost + b.l * (b.upto - s.upto), a.j) as r from d{k - 1} a join h s on s.j = a.j join h b on a.j < b.j) where r = 1)"
        )
    tops = " union all ".join(f"select {k} as k, path from d{k} where j = (select max(j) from h)" for k in range(1, buckets + 1))
    return rf"""
with n as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n from documents),
g as (select n as l, count(*)::bigint as c from n group by 1),
h as (select row_number() over (order by l)::bigint as j, l, (sum(c) over (order by l))::bigint as upto from g),
{", ".join(layers)},
pick as (select path from ({tops}) order by k desc limit 1),
bounds as (select unnest(path) as b, unnest(range(0, len(path))) as bucket from pick),
placed as (select doc_id, n, (select min(b) from bounds where b >= n) as padded from n),
numbered as (select doc_id, n, bucket, padded, row_number() over (partition by bucket order by md5(coalesce(doc_id::varchar, '')), doc_id nulls first, n) - 1 as i,
  greatest(1, floor({budget} / greatest(padded, 1)))::bigint as room from placed join bounds on b = padded)
select doc_id, n as n_tokens, bucket::int as bucket, padded as padded_length, floor(i / room)::bigint as batch, (i % room)::bigint as slot from numbered
"""
