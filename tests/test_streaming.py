import pytest
from pyspark.sql import functions as F

from mnemotide.model import Store
from mnemotide.operators import windows
from mnemotide.streaming import triggers

SF = "/root/testdata/sf0.001"


@pytest.fixture
def calls(spark, tmp_path):
    """(batch frame, stream frame, folder) of tool calls in three files, in time order."""
    rows = Store(spark, SF).base.where("session in ('user-1', 'user-2', 'user-3', 'user-4')").select("session", "id", "seq", "query", "tool", "result_count", "latency_ms", "ts")
    folder = str(tmp_path / "in")
    total = rows.count()
    every = rows.orderBy("ts", "seq").collect()
    for i in range(3):
        part = spark.createDataFrame(every[i * total // 3 : (i + 1) * total // 3], schema=rows.schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows, stream, str(tmp_path)


def _run(df, name, tmp, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp}/cp-{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return df.sparkSession.table(name)


def test_heartbeats_equal_batch(spark, calls):
    rows, stream, tmp = calls
    got = _run(triggers.heartbeats(stream, every=3, ttl_ms=None), "beats", tmp)
    want = windows.counter_triggers(rows, "session", ["ts", "seq"], every=3)
    assert sorted(map(tuple, got.collect())) == sorted((r.session, r.n) for r in want.collect()) and got.count() > 0


def test_drift_equals_batch(spark, calls):
    rows, stream, tmp = calls
    got = _run(triggers.drifts(stream, every=2, floor=0.9, ttl_ms=None), "drifts", tmp)
    want = windows.drift(rows, "session", ["ts", "seq"], every=2, floor=0.9)
    assert sorted((r.session, r.n, round(r.similarity, 9), r.keyword) for r in got.collect()) == sorted((r.session, r.n, round(r.similarity, 9), r.keyword) for r in want.collect())
    assert want.count() > 0


def test_once_and_visits(spark, calls):
    rows, stream, tmp = calls
    tagged = stream.withColumns({"tool": F.lit("Read"), "query": F.concat(F.lit("f"), (F.col("seq") % 3).cast("string"))})
    got = _run(triggers.once_per_file(tagged, delay="60 days"), "once", tmp)
    assert got.count() == rows.select("session", F.col("seq") % 3).distinct().count()
    late = spark.createDataFrame([("user-1", "z", 10**9, "q", None, None, None, "2025-01-01")], "session string, id string, seq long, query string, tool string, result_count int, latency_ms int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    late.coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    seen = _run(triggers.visit_windows(stream, gap="30 minutes", delay="40 days"), "visits", tmp)
    want = windows.visits(rows, "session", order=("seq",)).select("session", "visit").distinct()
    assert seen.where("year(start) < 2025").count() == want.count()


def test_attached_turns(spark, tmp_path):
    schema = "session string, ts timestamp, seq long, is_turn boolean, turn_id string, tool string"
    rows = [("s", 1, False, None, "Grep"), ("s", 2, False, None, "Read"), ("s", 3, True, "t1", None), ("s", 4, True, "t2", None), ("z", 5, False, None, "Bash"), ("s", 6, False, None, "Edit"), ("z", 7, True, "t3", None)]
    for half in (rows[:2], rows[2:]):
        spark.createDataFrame([(r[0], None, *r[1:]) for r in half], schema).withColumn("ts", F.timestamp_seconds("seq")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.turn_id: list(r.tool_calls) for r in _run(triggers.attached_turns(stream, ttl_ms=None), "attached", str(tmp_path)).collect()}
    assert got == {"t1": ["Grep", "Read"], "t2": [], "t3": ["Bash"]}


def test_reminders(spark):
    schema = "seq long, session string, tool string, query string, result_count int, latency_ms int"
    calls = [(1, "s", "Grep", "parser find/cache -vvvv", 0, 5), (2, "s", "Bash", "parser cache", 0, 5), (3, "s", "Grep", "parser", 0, 9000), (4, "s", "Grep", "find parser cache", 0, 5), (5, "other", "Grep", "Parser cache", 0, 5)]
    memory = [("a", "other", "decision", "the parser cache grows", 1, 5, None), ("b", "other", "decision", "only the parser", 0, 9, None), ("c", "s", "decision", "parser cache", 0, 9, None), ("d", "other", "warning", "cache of the parser", 1, 9, None),
              ("e", "other", "idea", "parser cache", 0, 9, None), ("f", "third", "resolved", None, 1, 4, "PARSERS fill caches")]
    nodes = spark.createDataFrame([(*m[:6], "active", None, m[6]) for m in memory], "id string, session string, kind string, query string, memory_tier int, importance int, status string, output_preview string, episodic_text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    shown = spark.createDataFrame([("d", "s", "hook")], "node_id string, session string, channel string")
    found = sorted((r.seq, r.place, r.id) for r in triggers.reminders(spark.createDataFrame(calls, schema), nodes, shown).collect())
    assert found == [(1, 1, "a"), (1, 2, "f"), (5, 1, "c"), (5, 2, "f")]  # "find" opens the fourth call, and no memory holds it
    few = triggers.reminders(spark.createDataFrame(calls[:1], schema), nodes, shown, pool=1).collect()
    assert few == []  # the one memory that is looked at shares one word only



def test_rate_forward_feed_and_sink(spark, calls):
    rows, stream, tmp = calls
    dense = stream.withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("seq") % 7))
    rates = _run(triggers.over_rate(dense, seconds=60, most=2, delay="0 seconds"), "rates", tmp)
    assert set(rates.columns) == {"session", "start", "n"}
    mark = F.lit("2024-01-15").cast("timestamp")
    q = triggers.append_once(triggers.forward_only(stream, mark), f"{tmp}/out", f"{tmp}/cp-out")
    assert q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp}/out").count() == rows.where(F.col("ts") >= mark).count()
    pushed = []
    q = triggers.live_feed(stream, pushed.append, f"{tmp}/cp-feed", most=5, trigger={"availableNow": True})
    assert q.awaitTermination(120)
    assert pushed and all(len(p) <= 5 and [r["ts"] for r in p] == sorted(r["ts"] for r in p) for p in pushed)


def test_keys_with_nothing_to_say_yield_no_frame():
    """A micro-batch has many sessions with a few calls each; frames made for each of them took most of the time."""
    import pandas as pd

    from mnemotide.streaming.triggers import drifts, heartbeats

    class Calls:
        def __getattr__(self, name):
            return lambda *args, **_: setattr(self, "step", args[0]) or self if name == "applyInPandasWithState" else self

    class State:
        exists, hasTimedOut, kept = False, False, None

        def update(self, value):
            self.kept = value

    frame = pd.DataFrame({"session": ["a"] * 3, "ts": pd.to_datetime(["2024-01-03", "2024-01-01", "2024-01-01"]), "seq": [3, 2, 1], "k": [["c"], ["b"], ["a"]]})
    for make, kept in ((drifts, (3, [["a"], ["b"], ["c"]])), (heartbeats, (3,))):
        calls, state = Calls(), State()
        if make is drifts:
            import mnemotide.streaming.triggers as triggers

            held, triggers.drift_keywords = triggers.drift_keywords, lambda _: None
            triggers_f, triggers.F = triggers.F, Calls()
            try:
                drifts(calls, ttl_ms=None)
            finally:
                triggers.drift_keywords, triggers.F = held, triggers_f
        else:
            heartbeats(calls, ttl_ms=None)
        assert list(calls.step(("a",), iter([frame[:1], frame[1:]]), state)) == [] and state.kept == kept


def test_few_words_need_no_index_and_calls_stay_one_row(spark):
    """Both ways of finding words give the same, and pools pass over what a session holds or was shown."""
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    rows = [(i, f"m{i}", f"s{i % 3}", "warning", ("parser cache" if i % 2 else "cache token") + f" {i}", "active", 1, i % 5, at + timedelta(minutes=i), None, 0, "Grep") for i in range(40)]
    calls = [(100 + i, f"c{i}", f"s{i}", "tool_call", "cache parser token", "active", 1, 5, at, 0, 0, "Grep") for i in range(4)]
    nodes = spark.createDataFrame(rows + calls, "seq long, id string, session string, kind string, query string, status string, memory_tier int, importance int, ts timestamp, result_count int, latency_ms int, tool string")
    shown = spark.createDataFrame([("m39", "s1", "hook"), ("m39", "s1", "hook"), ("m34", "s3", "fetch")], "node_id string, session string, channel string")
    best = sorted(rows, key=lambda r: (r[6], -r[7], -r[8].timestamp(), r[1]))
    want = set()
    for c in calls:
        pool = [r for r in best if r[2] != c[2]][:6]
        pool = [r for r in pool if (r[1], c[2]) != ("m39", "s1")]
        want |= {(c[0], r[1], p + 1) for p, r in enumerate(pool[:3])}
    for few in (64, 0):
        out = triggers.reminders(nodes.where("kind = 'tool_call'"), nodes, shown, pool=6, few=few)
        assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "Window" not in plan
