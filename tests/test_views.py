import json

import pytest
from pyspark.sql import functions as F

from mnemotide.model import Store, as_of
from mnemotide.operators import dynamics, reports, views
from mnemotide.plans import sleep
from mnemotide.plans.sleep import sleep_cycle
from mnemotide.sources.sinks import read_current

SF = "/root/testdata/sf0.001"


def test_sleep_cycle_publishes_and_survives_a_failing_stage(spark, tmp_path):
    s = Store(spark, SF)
    vectors = s.vectors
    args = (spark, s.nodes, vectors, s.sessions, s.ledger)
    out = sleep_cycle(*args, root=str(tmp_path / "a"), as_of=as_of(), current="user-12", tiers=(0.3, 0.35, 0.4), floor=0.3)
    assert out == {k: "1" for k in ("embedded", "consolidated", "demoted", "edges", "communities", "atlas", "book", "page_one", "report", "audit", "registry")}, out
    assert {r.type for r in read_current(spark, str(tmp_path / "a/edges")).select("type").distinct().collect()} >= {"chain", "semantic"}
    again = sleep_cycle(*args, root=str(tmp_path / "a"), as_of=as_of(), current="user-12", tiers=(0.3, 0.35, 0.4), floor=0.3)
    assert set(again.values()) == {"unchanged"}
    moved = sleep_cycle(*args, root=str(tmp_path / "a"), as_of=as_of(), current="user-12", tiers=(0.3, 0.35, 0.41), floor=0.3)
    assert {k for k, v in moved.items() if v == "2"} == {"edges", "communities", "atlas"} and {v for v in moved.values()} == {"2", "unchanged"}
    broken = sleep_cycle(spark, s.nodes, vectors.drop("embedding"), s.sessions, s.ledger, root=str(tmp_path / "b"), as_of=as_of(), current="user-12")
    assert broken["consolidated"].startswith("failed") and broken["demoted"] == "1" and broken["audit"] == "1"
    assert broken["communities"] == "failed: RuntimeError: needs edges" and broken["atlas"] == "failed: RuntimeError: needs communities"


def test_a_broken_cycle_goes_on_where_it_ended_and_a_finished_one_runs_no_stage(spark, tmp_path, monkeypatch):
    s = Store(spark, SF)
    args = (spark, s.nodes, s.vectors, s.sessions, s.ledger)
    options = {"root": str(tmp_path / "c"), "as_of": as_of(), "current": "user-12", "tiers": (0.3, 0.35, 0.4), "floor": 0.3}
    with monkeypatch.context() as m:
        m.setattr(sleep.graph, "communities", lambda *a, **k: 1 / 0)
        first = sleep_cycle(*args, **options)
    assert first["communities"].startswith("failed: ZeroDivisionError") and first["atlas"].endswith("needs communities")
    second = sleep_cycle(*args, **options)
    assert {k: v for k, v in second.items() if v != "unchanged"} == {"communities": "1", "atlas": "1"}
    with monkeypatch.context() as m:
        m.setattr(sleep, "publish", lambda *a: 1 / 0)
        kind = type(spark.range(1))
        m.setattr(kind, "collect", _no_tables(kind.collect))
        assert set(sleep_cycle(*args, **options).values()) == {"unchanged"}
    other = sleep_cycle(*args, **options, marks={"ledger": "later"})
    assert {k: v for k, v in other.items() if v != "unchanged"} == {"audit": "2"}


def _no_tables(collect):
    """Collects only the one-column texts of pointers and marks."""
    def only(df):
        assert df.columns == ["value"]
        return collect(df)

    return only


def test_a_table_without_files_needs_a_mark(spark):
    with pytest.raises(ValueError):
        sleep.source_mark(spark.range(3))


def test_findings_repeat_only_when_they_change(spark):
    last = spark.createDataFrame([("stale", 2, None), ("dates", 1, "x")], "check string, n long, detail string")
    now = spark.createDataFrame([("stale", 2, None), ("dates", 3, "x")], "check string, n long, detail string")
    assert [(r.check, r.n) for r in reports.fresh_findings(now, last).collect()] == [("dates", 3)]


def test_notify_turns(spark):
    rows = [
        {"type": "agent-turn-complete", "thread-id": "t", "turn-id": "1", "input-messages": ["a", "b"], "last-assistant-message": "c"}, {"type": "other"},
        {"type": "agent-turn-complete", "thread-id": "t", "turn-id": "2", "input-messages": ["Write a title for this"]},
    ]
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("bad",)], "value string")
    got = views.notify_turns(raw, ("Write a title",)).collect()
    assert [tuple(r) for r in got] == [("t", "1", "a\nb", "c")]


def test_definitions_and_digest(spark):
    nodes = spark.createDataFrame([("a", "insight", "Golden angle: a turn that spreads", "active"), ("b", "insight", "no term here", "active")], "id string, kind string, query string, status string")
    assert [tuple(r) for r in reports.definitions(nodes).collect()] == [("golden angle", "a")]
    lines = spark.range(30).select(F.lit("open").alias("section"), (F.col("id") + 1).alias("place"), F.lit("x").alias("line"))
    assert views.orient_digest(lines, {"open": 20}).count() == 20


def test_galaxy_bodies_keeps_more_galaxies_than_ten_thousand(spark):
    n = 12_000
    points = spark.range(2 * n).select((F.col("id") % n).cast("string").alias("galaxy"), (F.col("id") % n).cast("double").alias("map_x"), F.floor(F.col("id") / n).cast("double").alias("map_y"))
    got = views.galaxy_bodies(points, floor=0.25).collect()
    assert {(r.galaxy, r.x, r.y, r.body) for r in got} == {(str(i), float(i), 0.5, 0.5) for i in range(n)} and len(got) == n


def test_sleep_cycle_names_more_communities_than_a_hundred_thousand(spark):
    n = 100_500
    ids = spark.range(n).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.col("id").cast("int").alias("cid"))
    got = sleep.named(ids, ids.select("cid", F.lit("n").alias("name")))
    assert got.select("community").distinct().count() == n


def test_live_fill_places_nodes_of_every_community(spark):
    points = spark.range(200).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("c"), (F.col("id") % 100).cast("string")).alias("cid"), F.lit("g").alias("galaxy"), F.col("id").cast("double").alias("map_x"), F.lit(0.0).alias("map_y"))
    fresh = spark.range(150).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") < 120, F.concat(F.lit("c"), F.col("id").cast("string"))).alias("cid"), F.when(F.col("id") % 2 == 0, "g").otherwise("other").alias("galaxy"), F.timestamp_seconds(F.col("id")).alias("ts"))
    got = views.live_fill(fresh, points).collect()
    assert len(got) == 150 and len({(r.map_x, r.map_y) for r in got}) == 150


def test_coverage_takes_exact_halves_to_even(spark):
    """23 of 40 is 57.5 percent, but as a quotient times a hundred it falls below the half."""
    rows = [("a", 0, i) for i in range(23)] + [("a", 2, 23 + i) for i in range(17)] + [("b", 1, i) for i in range(1)] + [("b", 2, 1 + i) for i in range(7)]
    nodes = spark.createDataFrame(rows, "session string, memory_tier int, id int").withColumn("status", F.lit("active"))
    got = {r.session: r.coverage for r in dynamics.schedule_summary(nodes).collect()}
    assert got == {"a": "58%", "b": "12%"}


def test_audit_query_agrees_with_its_sql_where_nodes_are_shown_over_sixty_times_a_week(spark, tmp_path):
    import os

    import duckdb

    from mnemotide.plans.catalogue import ORACLE_SQL, QUERIES

    spark.read.parquet(f"{SF}/events.parquet").withColumns({"event_id": F.col("event_id") * 1000, "event_type": F.lit("view"), "ts": F.lit("2024-01-30").cast("timestamp_ntz")}).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    os.symlink(f"{SF}/embeddings.parquet", tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'; create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    for name in ("e_audit_findings", "e_audit_attention"):
        got = {tuple(r[x] for x in ("check", "n", "detail")) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == set(c.execute(f"select \"check\", n, detail from ({ORACLE_SQL[name]})").fetchall()) != set()
    s = Store(spark, str(tmp_path))
    assert [tuple(r) for r in reports.audit(s.base, s.ledger, s.vectors, as_of(), {}).where("check = 'attention hoarding'").collect()] == [("attention hoarding", 1, "e0")]
