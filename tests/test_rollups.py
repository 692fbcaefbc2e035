"""Bitmap rollups against distinct counts, and tables whose folds need no shuffle."""

import random
import uuid

from pyspark.sql import functions as F

from mnemotide.operators import bitmaps, dynamics
from mnemotide.scratch import Scratch
from mnemotide.sources.sinks import write_bucketed


def _counts(rows, first, last):
    out = {}
    for name, day, node, session in rows:
        if name is not None and day is not None and first <= day <= last:
            n, s, d = out.setdefault(name, (set(), set(), set()))
            n.add(node)
            s.add(session)
            d.add(day)
    return sorted((k, len(n - {None}), len(s - {None}), len(d)) for k, (n, s, d) in out.items() if (n | s) - {None})


def test_counts_over_any_days(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(1, 20)]), rng.choice([rng.randrange(200_000), rng.randrange(50)]), rng.randrange(90)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "name string, day int, node long, session long").repartition(6)
    kinds = {"nodes": F.col("node"), "sessions": F.col("session")}
    first = bitmaps.daily_bitmaps(df.where("day < 9 and node % 3 <> 0"), kinds)
    late = bitmaps.daily_bitmaps(df.where("not (day < 9 and node % 3 <> 0)"), kinds)
    both = bitmaps.merged(bitmaps.merged(first, late), late)
    for a, b in ((1, 19), (4, 12), (30, 40)):
        got = bitmaps.span_counts(both, ("nodes", "sessions"), F.lit(a), F.lit(b)).collect()
        assert sorted((r.name, r.nodes, r.sessions, r.days) for r in got) == _counts(rows, a, b)
    assert bitmaps.span_counts(bitmaps.daily_bitmaps(df.limit(0), kinds), ("nodes",)).collect() == []


def test_numbers_are_kept_and_dense(spark):
    scratch = Scratch(spark, "n")
    one = bitmaps.numbered(spark.createDataFrame([("b",), ("d",), ("b",), (None,)], "value string"), scratch)
    two = bitmaps.numbered(spark.createDataFrame([("c",), ("d",), ("a",)], "value string"), scratch, one)
    assert sorted((r.value, r.n) for r in two.collect()) == [("a", 2), ("b", 0), ("c", 3), ("d", 1)]


def test_folding_bucketed_tables_needs_no_shuffle(spark, tmp_path):
    nodes = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("active").alias("status"), F.lit(False).alias("flagged"), F.lit(1).alias("memory_tier"), F.lit(2.0).alias("stability_days"))
    at = F.timestamp_seconds(F.col("id").cast("long"))
    changes = nodes.where("cast(id as int) % 7 = 0").select("id", F.lit("memory_tier").alias("field"), F.lit("2").alias("value"), at.alias("at")).union(nodes.where("cast(id as int) % 11 = 0").select("id", F.lit("status"), F.lit("void"), at))
    tables = [write_bucketed(df, f"t_{uuid.uuid4().hex}", str(tmp_path / name), buckets=4) for name, df in (("nodes", nodes), ("changes", changes))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = dynamics.fold_changes(*tables)
        rows = sorted(map(tuple, found.collect()))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        cited = dynamics.mark_cited(tables[0].select(F.col("id").alias("node_id"), F.col("flagged").alias("cited")), tables[1].select("id"))
        assert cited.where("cited").count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == sorted(map(tuple, dynamics.fold_changes(nodes, changes).collect()))
