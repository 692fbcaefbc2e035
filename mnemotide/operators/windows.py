"""Sequences: turn segments, tails of continued sessions, visits, sliding rates, drift and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .scans import running


def _scratch(df: DataFrame, scratch: Scratch | None, label: str) -> Scratch:
    return scratch or Scratch(df.sparkSession, label)


def segments(lines: DataFrame, boundary: Column, by: str, order: list[str], scratch: Scratch | None = None) -> DataFrame:
    """`lines` with `segment`: how many boundaries came up to and including each line of its file. A file with most lines is
    many tasks, see `scans.running`, as everything here that counts within a key."""
    return running(lines, [by], order, _scratch(lines, scratch, "segments"), sums={"segment": F.when(boundary, 1).otherwise(0)})


def new_tail(incoming: DataFrame, stored: DataFrame, order: list[str], scratch: Scratch | None = None) -> DataFrame:
    """(session, status, turn columns) of a continued export: turns beyond those stored, chained to the last one.

    `stored` has session, turns and last_id. A session with fewer incoming turns than stored has shrunk and nothing
    of it is imported.
    """
    rows = running(incoming, ["session"], order, _scratch(incoming, scratch, "tail"), sums={"n": F.lit(1)}, previous={"before": F.col("id")})
    sessions = incoming.groupBy("session").agg(F.count(F.lit(1)).alias("incoming")).join(stored, "session", "left").withColumn("turns", F.coalesce("turns", F.lit(0)))
    tail = rows.join(sessions.where(F.col("incoming") > F.col("turns")), "session").where(F.col("n") > F.col("turns"))
    return tail.withColumn("parent", F.when(F.col("n") == F.col("turns") + 1, F.col("last_id")).otherwise(F.col("before"))).drop("before", "incoming")


def import_report(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(status, conversations, turns): new, resumed, unchanged or shrunk sessions of an import."""
    n = incoming.groupBy("session").agg(F.count(F.lit(1)).alias("incoming")).join(stored.select("session", "turns"), "session", "left")
    status = F.when(F.col("turns").isNull(), "new").when(F.col("incoming") > F.col("turns"), "resumed").when(F.col("incoming") == F.col("turns"), "unchanged").otherwise("shrunk")
    added = F.greatest(F.col("incoming") - F.coalesce("turns", F.lit(0)), F.lit(0))
    return n.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("conversations"), F.sum(added).alias("turns"))


def visits(events: DataFrame, by: str, ts: str = "ts", gap_seconds: int = 1800, order: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """`events` with `visit`: a pause longer than the gap begins a new one, from 1 for each key."""
    scratch, places = _scratch(events, scratch, "visits"), [ts, *order]
    seen = running(events, [by], places, scratch, previous={"_last": F.col(ts).cast("double")})
    pause = F.col(ts).cast("double") - F.col("_last")
    return running(seen, [by], places, scratch, sums={"visit": F.when(pause.isNull() | (pause > gap_seconds), 1).otherwise(0)}).drop("_last")


def sliding_rate(events: DataFrame, by: str, ts: str = "ts", seconds: int = 60, most: int = 30, scratch: Scratch | None = None) -> DataFrame:
    """`events` with `recent` (events of the key in the window that ends at each second) and `allowed`.

    An event counts from its second on and no longer once the window has passed it, so the rate is a running sum of such
    changes, one row for each key and second, that events meet by an equi-join.
    """
    rows = events.withColumn("_at", F.col(ts).cast("long"))
    per = rows.where("_at is not null").groupBy(by, "_at").agg(F.count(F.lit(1)).alias("_c"))
    changes = per.unionAll(per.select(by, F.col("_at") + seconds + 1, -F.col("_c"))).groupBy(by, "_at").agg(F.sum("_c").alias("_c"))
    rate = running(changes, [by], ["_at"], _scratch(events, scratch, "rate"), sums={"recent": F.col("_c")}).select(F.col(by).alias("_by"), F.col("_at").alias("_when"), "recent")
    met = rows.join(rate, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_at") == F.col("_when")), "left").drop("_at", "_by", "_when")
    return met.withColumn("allowed", F.col("recent") <= most)


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread: str = "id", salts: int = 1024) -> DataFrame:
    """`rows` with the columns of `table` by `key`, as a left join; rows without a key are dealt over `salts` places
    by column `spread`, as they would otherwise all go to one task."""
    salted = rows.withColumn("_salt", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(salts)) + 1).otherwise(F.lit(0)).cast("int"))
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")  # a literal would not be part of the join's key
    return salted.join(table.withColumn("_salt", zero), [key, "_salt"], "left").drop("_salt")


def drift_keywords(text: Column) -> Column:
    """Distinct words over three letters; paths count as words, numbers and options do not."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[/\\.]", " ")), r"\s+")
    bare = F.transform(words, lambda w: F.btrim(w, F.lit("_-:(),;'\"")))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) > 3) & ~F.startswith(w, F.lit("-")) & ~F.rlike(w, F.lit(r"^\d+$"))))


def drift(calls: DataFrame, by: str, order: list[str], every: int = 5, back: int = 10, floor: float = 0.15, chunk: int = 1000, scratch: Scratch | None = None) -> DataFrame:
    """(by, id, n, similarity, keyword): calls whose words hardly overlap the up to `back` calls before.

    Every `every`-th call of a session is compared; the keyword is the longest new word, the first at ties. Calls are numbered,
    and each piece of `chunk` of them is looked at with the `back` calls before it, so a session is many groups.
    """
    rows = running(calls.withColumn("k", drift_keywords(F.col("query"))), [by], order, _scratch(calls, scratch, "drift"), sums={"n": F.lit(1)})
    own = F.floor((F.col("n") - 1) / chunk)
    rows = rows.withColumn("_own", own).withColumn("_piece", F.explode(F.array_distinct(F.array(own, F.floor((F.col("n") - 1 + back) / chunk)))))
    w = Window.partitionBy(by, "_piece").orderBy("n").rowsBetween(-back, -1)
    rows = rows.withColumn("past", F.array_distinct(F.flatten(F.collect_list("k").over(w)))).where(F.col("_own") == F.col("_piece"))
    rows = rows.where((F.col("n") % every == 0) & (F.col("n") > every) & (F.size("k") > 0))
    share = F.size(F.array_intersect("k", "past")) / F.size(F.array_union("k", "past"))
    rows = rows.withColumn("similarity", F.when(F.size("past") == 0, 1.0).otherwise(share)).where(F.col("similarity") < floor)
    fresh = F.array_except("k", "past")
    longest = F.array_sort(F.transform(F.when(F.size(fresh) > 0, fresh).otherwise(F.col("k")), lambda x: F.struct((-F.length(x)).alias("l"), x.alias("w"))))
    return rows.select(by, "id", "n", "similarity", F.element_at(longest, 1)["w"].alias("keyword"))


def counter_triggers(calls: DataFrame, by: str, order: list[str], every: int = 25, scratch: Scratch | None = None) -> DataFrame:
    """Calls at which a counter that restarts when it fires has reached `every`: every 25th call of each session."""
    return running(calls, [by], order, _scratch(calls, scratch, "counter"), sums={"n": F.lit(1)}).where(F.col("n") % every == 0)


def once_per(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first event of each key."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def longest_streak(rows: DataFrame, flag: Column, by: str, order: list[str], scratch: Scratch | None = None) -> DataFrame:
    """(by, streak): the longest run of consecutive rows with the flag. A run is what has the same count of rows without it."""
    flagged = rows.select(by, *order, flag.alias("_f"))
    runs = running(flagged, [by], order, _scratch(rows, scratch, "streak"), sums={"_g": F.when(F.col("_f"), 0).otherwise(1)}).groupBy(by, "_g").agg(F.count_if("_f").alias("n"))
    return runs.groupBy(by).agg(F.max("n").alias("streak"))


def placed(rows: DataFrame, by: list[str], scratch: Scratch, within: list[str] | None = None) -> DataFrame:
    """`rows` with i: numbers from 0 in the order of `by`, or within each group of `within`, whose columns begin `by`.

    Ranges of the order are dealt out, written, and numbered each by itself; what comes before a range is summed over one
    row for each range and group. So one order or group with most rows is no single task.
    """
    within = within or []
    parts = scratch.save(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    before = F.sum("c").over(Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.groupBy(*within, "part").agg(F.count(F.lit(1)).alias("c")).select(*within, "part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*within, "part").orderBy(*by)) - 1
    return parts.withColumn("i", inside).join(scratch.save(starts), [*within, "part"]).withColumn("i", F.col("start") + F.col("i")).drop("part", "start")
