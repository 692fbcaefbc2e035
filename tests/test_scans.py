"""Running values against a plain loop, with a key that has half of all rows."""

import random

from pyspark.sql import functions as F

from mnemotide.operators import windows
from mnemotide.operators.scans import running
from mnemotide.scratch import Scratch

ROWS = "k string, t long, id long, v long"


def _rows(n):
    rng = random.Random(n)
    keys = ["hot"] * (n // 2) + [rng.choice(["a", "b", "c", None]) for _ in range(n - n // 2)]
    return [(k, rng.randrange(40), i, rng.choice([None, *range(-5, 9)])) for i, k in enumerate(keys)]


def _brute(rows, before):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        total, top = 0, None
        for i, (k, t, n, v) in enumerate(own):
            now = (total, top)
            if v is not None:
                total, top = total + v, max((v, n), top or (v, n))
            s, m = now if before else (total, top)
            out.append((str(k), t, n, s, m, own[i - 1][3] if i else None, own[i + 1][1] if i + 1 < len(own) else None))
    return sorted(out, key=str)


def _found(df):
    return sorted(((str(r.k), r.t, r.id, r.s, tuple(r.m) if r.m else None, r.p, r.f) for r in df.collect()), key=str)


def _scan(spark, df, before):
    top = F.when(F.col("v").isNotNull(), F.struct("v", "id"))
    return running(df, ["k"], ["t", "id"], Scratch(spark, "scan"), {"s": F.col("v")}, {"m": top}, {"p": F.col("v")}, {"f": F.col("t")}, before)


def test_running_equals_a_loop(spark):
    rows = _rows(800)
    for before in (False, True):
        assert _found(_scan(spark, spark.createDataFrame(rows, ROWS).repartition(7), before)) == _brute(rows, before)
    few = _rows(9)
    assert _found(_scan(spark, spark.createDataFrame(few, ROWS), False)) == _brute(few, False)
    assert _scan(spark, spark.createDataFrame([], ROWS), True).collect() == []


def test_a_hot_key_is_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = _scan(spark, spark.createDataFrame(_rows(8000), ROWS), False)
        tasks = df.groupBy(F.spark_partition_id()).agg(F.count("k").alias("n"), F.max("s"), F.max("f"), F.max("p"), F.max("m"))
        assert max(r.n for r in tasks.collect()) < 2000  # the hot key alone has 4,000 rows
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_windows_of_a_hot_session_equal_plain_loops(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        session = "hot" if i % 2 else rng.choice(["a", "b"])
        rows.append((session, rng.randrange(40_000), i, rng.choice(["parser cache retry", "vector deploy token", "schema index budget stream"]), rng.random() < 0.7, f"e{i}"))
    df = spark.createDataFrame(rows, "session string, sec long, seq long, query string, flag boolean, id string").withColumn("ts", F.timestamp_seconds("sec")).repartition(6)
    got = {
        "visit": {r.id: r.visit for r in windows.visits(df, "session", gap_seconds=60, order=("seq",)).collect()},
        "recent": {r.id: (r.recent, r.allowed) for r in windows.sliding_rate(df, "session", seconds=600, most=8).collect()},
        "streak": {r.session: r.streak for r in windows.longest_streak(df, F.col("flag"), "session", ["ts", "seq"]).collect()},
        "counter": {r.id for r in windows.counter_triggers(df, "session", ["ts", "seq"]).collect()},
        "segment": {r.id: r.segment for r in windows.segments(df, F.col("flag"), "session", ["ts", "seq"]).collect()},
    }
    drift = {c: sorted(map(str, windows.drift(df, "session", ["ts", "seq"], floor=0.9, chunk=c).collect())) for c in (13, 100_000)}
    assert drift[13] == drift[100_000] != []
    for session in ("hot", "a", "b"):
        own = sorted((r for r in rows if r[0] == session), key=lambda r: (r[1], r[2]))
        visit = segment = run = longest = 0
        for n, r in enumerate(own):
            visit += n == 0 or r[1] - own[n - 1][1] > 60
            segment += r[4]
            run = run + 1 if r[4] else 0
            longest = max(longest, run)
            recent = sum(r[1] - 600 <= x[1] <= r[1] for x in own)
            assert (got["visit"][r[5]], got["segment"][r[5]], got["recent"][r[5]]) == (visit, segment, (recent, recent <= 8))
            assert (r[5] in got["counter"]) == ((n + 1) % 25 == 0)
        assert got["streak"][session] == longest
