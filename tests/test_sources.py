import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemotide.operators.windows import new_tail
from mnemotide.sources import exports, files, sinks, transcripts

def _never():
    return F.lit("2000-01-01").cast("timestamp")


@settings(max_examples=120, deadline=None)
@given(st.lists(st.recursive(st.one_of(st.text(alphabet='a"\\[]{},: \n', max_size=6), st.integers(), st.none()), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=3), x, max_size=3)), max_leaves=6), max_size=5), st.integers(1, 7))
def test_array_elements_come_one_by_one(values, size):
    text = json.dumps(values)
    got = list(exports.stream_array(text[i : i + size] for i in range(0, len(text), size)))
    assert [json.loads(x) for x in got] == values


def test_array_elements_pass_at_the_speed_of_expressions():
    import time

    text = json.dumps([{"text": "word " * 200_000, "n": i} for i in range(8)])
    began = time.perf_counter()
    assert len(list(exports.stream_array(text[i : i + 65536] for i in range(0, len(text), 65536)))) == 8
    assert time.perf_counter() - began < 0.5


def _message(role, text, at, kind="text", **more):
    content = {"content_type": kind, "text": text} if kind in ("code", "execution_output") else {"content_type": kind, "parts": more.get("parts", [text])}
    return {"message": {"author": {"role": role}, "create_time": at, "content": content, "metadata": {"model_slug": more.get("model")}}}


GRAPH = [{"id": "c1", "title": "A [tricky], \"title\"", "create_time": 1700000000, "mapping": {
    "x": _message("assistant", "second, with [brackets]", 1700000020, model="m-1"), "a": _message("user", "first", 1700000010), "s": _message("system", "plumbing", 1700000001),
    "t": _message("tool", "browsing", 1700000030), "o": _message("tool", "42", 1700000040, "execution_output"), "e": _message("assistant", "", 1700000050), "n": {"message": None},
    "i": _message("user", "", 1700000060, "multimodal_text", parts=[{"content_type": "image_asset_pointer", "asset_pointer": "file-service://file-9"}, "look"]),
}}]


def test_graph_export(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(GRAPH))
    rows = exports.graph_turns(exports.read_array(spark, str(tmp_path / "c.json"), exports.GRAPH_EXPORT), _never()).orderBy("place").collect()
    assert [(r.role, r.text) for r in rows] == [("user", "first"), ("agent", "second, with [brackets]"), ("agent", "42"), ("user", "[image · made 2023-11-14 · id file-9] look")]
    assert rows[1].model == "m-1" and rows[0].model == "gpt-imported" and list(rows[2].extra) == ["code", "output"] and list(rows[3].extra) == ["image"]


def test_zipped_export(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("conversations-000.json", json.dumps(GRAPH))
        z.writestr("conversations-001.json", json.dumps([GRAPH[0] | {"id": "c2"}]))
        z.writestr("conversations.json", "[]")
        z.writestr("conversation_asset_file_names.json", json.dumps({"file-9.dat": "cat.jpg"}))
    talks, names = exports.read_zip(spark, str(tmp_path / "e.zip"))
    assert [tuple(r) for r in names.collect()] == [("file-9.dat", "cat.jpg")]
    assert {(r.conversation, r["count"]) for r in exports.graph_turns(talks, _never()).groupBy("conversation").count().collect()} == {("c1", 4), ("c2", 4)}


def test_list_and_activity_exports(spark, tmp_path):
    talks = [{"uuid": "u", "name": "N", "chat_messages": [
        {"sender": "human", "text": " hi ", "created_at": "2024-01-02T03:04:05Z"}, {"sender": "assistant", "text": "", "content": [{"type": "text", "text": "yes"}, {"type": "image"}, {"type": "tool_use", "input": "ls"}]},
        {"sender": "system", "text": "x"}, {"sender": "assistant", "text": ""}]}]
    (tmp_path / "l.json").write_text(json.dumps(talks))
    rows = exports.list_turns(exports.read_array(spark, str(tmp_path / "l.json"), exports.LIST_EXPORT), _never()).orderBy("place").collect()
    assert [(r.role, r.text, list(r.extra)) for r in rows] == [("user", "hi", []), ("agent", "yes [image] ls", ["code"])]
    acts = [{"title": 'Prompted "why"', "time": "2024-01-02T10:00:00Z", "subtitles": [{"name": "Prompted x"}, {"name": "because"}]}, {"title": "Searched", "time": "2024-01-02T11:00:00Z"}, {"title": "Prompted how", "time": "2024-01-03T01:00:00Z"}]
    (tmp_path / "a.json").write_text(json.dumps(acts))
    rows = exports.activity_turns(exports.read_array(spark, str(tmp_path / "a.json"), exports.ACTIVITY_EXPORT), _never()).orderBy("conversation", "place").collect()
    assert [(r.conversation, r.role, r.text) for r in rows] == [("activity-2024-01-02", "user", "why"), ("activity-2024-01-02", "agent", "because"), ("activity-2024-01-03", "user", "how")]


def test_import_is_idempotent_and_takes_tails(spark):
    def turns(n):
        return spark.createDataFrame([("c", "Talk", i, "user" if i % 2 == 0 else "agent", f"text {i}" if i != 1 else "Unsupported message type", None) for i in range(n)], "conversation string, title string, place int, role string, text string, model string").withColumns({"ts": F.timestamp_seconds(F.lit(1700000000) + F.col("place")), "extra": F.array().cast("array<string>")})

    first = exports.to_nodes(turns(4), "x")
    rows = first.orderBy("n").collect()
    assert len(rows) == 3 and rows[0].parent is None and rows[1].parent == rows[0].id and rows[0].session == rows[2].session
    stored = first.groupBy("session").agg(F.count(F.lit(1)).alias("turns"), F.max_by("id", "n").alias("last_id"))
    assert new_tail(exports.to_nodes(turns(4), "x").drop("n", "parent"), stored, ["ts"]).count() == 0
    tail = new_tail(exports.to_nodes(turns(6), "x").drop("n", "parent"), stored, ["ts"]).orderBy("ts").collect()
    assert len(tail) == 2 and tail[0].parent == rows[2].id and tail[1].parent == tail[0].id
    assert new_tail(exports.to_nodes(turns(2), "x").drop("n", "parent"), stored, ["ts"]).count() == 0
    long = exports.to_nodes(turns(1).withColumn("text", F.repeat(F.lit("y"), 9000)), "x").first()
    assert len(long.episodic_full) == 9000 and len(long.output_preview) == 8000 and len(long.query) == 2000


def _event(kind, **payload):
    return {"type": kind, "timestamp": payload.pop("ts", None), "payload": payload}


def test_rollout(spark, tmp_path):
    lines = [
        _event("session_meta", id="s1"), _event("session_meta", id="s0"), _event("turn_context", turn_id="t1", model="m"), _event("event_msg", type="user_message", message="ask", ts="2024-01-01T00:00:00Z"),
        _event("event_msg", type="agent_message", message="one", ts="2024-01-01T00:00:05Z"), "not json", _event("compacted"), _event("event_msg", type="agent_message", message="two"), _event("event_msg", type="task_complete"),
        _event("event_msg", type="agent_message", message="stray"), _event("turn_context", turn_id="t2", model="m2"), _event("event_msg", type="user_message", message="again", ts="2024-01-02T00:00:00Z"),
        _event("event_msg", type="user_message", message="no time"), _event("event_msg", type="agent_message", message="x"),
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    rows = transcripts.numbered_lines(spark, str(tmp_path / "r.jsonl"))
    got = transcripts.rollout_turns(rows).orderBy("user_line").collect()
    assert [(r.turn_id, r.model, r.user_text, r.agent_text) for r in got] == [("t1", "m", "ask", "one\ntwo"), ("t2", "m2", "again", "")]
    assert transcripts.rollout_session(rows).first().session == "s1"
    report = transcripts.log_report(rows).first()
    assert (report.lines, report.bad, report.compacted) == (14, 1, 1)
    turns = transcripts.rollout_turns(rows).withColumn("session", F.lit("s1"))
    mark, known = F.lit("2024-01-02").cast("timestamp"), spark.createDataFrame([], "session string, turn_id string")
    assert [r.turn_id for r in transcripts.forward_import(turns, known, mark).collect()] == ["t2"]
    both = transcripts.forward_import(turns, known, mark, floor=F.lit("2023-12-31").cast("timestamp"))
    assert {r.turn_id: r.part for r in both.collect()} == {"t1": "floor", "t2": "forward"}
    assert transcripts.forward_import(turns, both.select("session", "turn_id"), mark).count() == 0


def test_transcript(spark, tmp_path):
    def line(kind, content, uuid, **more):
        return json.dumps({"type": kind, "uuid": uuid, "timestamp": "2024-01-01T00:00:00Z", "message": {"content": content, **more.pop("message", {})}, **more})

    lines = [
        line("user", "question", "u1"), line("assistant", [{"type": "text", "text": "part"}, {"type": "tool_use", "text": None}], "a1", message={"model": "m", "usage": {"input_tokens": 5, "output_tokens": 7, "cache_read_input_tokens": 100}}),
        line("user", [{"type": "tool_result", "text": "echo"}], "u2"), line("assistant", "rest", "a2", message={"model": "m", "usage": {"input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 40, "cache_creation_input_tokens": 9}}),
        line("user", "ghost", "u3", isSynthetic=True), line("user", "alone", "u4"),
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    got = transcripts.transcript_turns(transcripts.numbered_lines(spark, str(tmp_path))).orderBy("turn").collect()
    assert [(r.turn_id, r.user_text, r.agent_text) for r in got] == [("a2", "question", "part\nrest"), ("u4", "alone", "")]
    assert (got[0].tokens_in, got[0].tokens_out, got[0].tokens_cache_write, got[0].tokens_cache_read) == (6, 9, 9, 40)


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n\ny = 2\n")
    (tmp_path / "src" / "b.bin").write_text("no")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.js").write_text("no")
    none = spark.createDataFrame([], "id string, tags array<string>")
    found = files.scan_files(spark, str(tmp_path))
    nodes, stale = files.ingest(found, none, "p")
    rows = nodes.collect()
    assert len(rows) == 1 and rows[0].query.startswith("a.py [1/1]: x = 1") and "ext:py" in rows[0].tags and stale.count() == 0
    again, stale = files.ingest(found, nodes.select("id", "tags"), "p")
    assert again.count() == 0 and stale.count() == 0
    changed, stale = files.ingest(found.withColumn("mtime", F.col("mtime") + 5), nodes.select("id", "tags"), "p")
    assert changed.count() == 1 and [r.id for r in stale.collect()] == [rows[0].id]


def test_session_lines_and_claims(spark):
    lines = [{"ref": "r1", "when": "2024-01-05", "text": "a", "kind": "idea"}, {"text": "b", "parent": "r1", "tags": ["t"]}, {"when": "2024-01-06T01:02:03Z", "gist": "g"}, {}]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "line int, value string")
    got = {r.query: r for r in files.session_lines(rows, "s", F.lit("2024-01-01").cast("timestamp")).collect()}
    assert str(got["a"].ts) == "2024-01-05 12:00:00" and str(got["b"].ts) == "2024-01-01 00:00:01" and got["b"].parent == got["a"].id and list(got["b"].tags) == ["t", "backfill"] and len(got) == 3
    claims = spark.createDataFrame([("s", " Sharp claim ", ["A", " b "], ["X"], "lesson", None, ["t1", "t2"]), ("s", " ", None, None, None, None, None)], "session string, claim string, keywords array<string>, entities array<string>, kind string, stance string, evidence array<string>")
    sessions = spark.createDataFrame([("s", "2024-01-01")], "id string, d string").selectExpr("id", "cast(d as timestamp) as started_at")
    r = files.claim_nodes(claims, sessions, kind_map={"lesson": "procedure"}).collect()
    assert len(r) == 1 and r[0].kind == "procedure" and r[0].parent == "t1" and list(r[0].tags) == ["claim", "prov:distilled", "by:agent", "stance:asserted", "kw:a", "kw:b", "entity:X", "distills:t1", "distills:t2"]


def test_tool_events(spark):
    events = [{"session_id": "s", "tool_name": "Grep", "tool_input": {"pattern": "p"}, "tool_result": "a\n\nb", "duration_ms": 5, "timestamp": "2024-01-01T00:00:00Z"}, {"tool_name": "TodoWrite"}, {"x": 1}]
    got = files.tool_events(spark.createDataFrame([(json.dumps(e),) for e in events] + [("bad",)], "value string")).collect()
    assert len(got) == 1 and (got[0].query, got[0].result_count, got[0].latency_ms) == ("p", 2, 5)


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.range(5)
    assert sinks.publish(df, root, None) == 1 and sinks.current_version(spark, root) == 1
    assert sinks.publish(spark.range(7), root, 1) == 2 and sinks.read_current(spark, root).count() == 7
    assert sinks.publish(spark.range(9), root, 1) is None and sinks.read_current(spark, root).count() == 7
    df.write.parquet(str(tmp_path / "a"))
    assert sinks.verified_backup(spark, str(tmp_path / "a"), str(tmp_path / "b"))[0] == 5
    nodes = spark.createDataFrame([("n1", "import-x-1"), ("n2", "s")], "id string, session string")
    sinks.append_nodes(nodes, str(tmp_path / "n"))
    assert {r.session_family for r in spark.read.parquet(str(tmp_path / "n")).collect()} == {"import", "live"}
    before = spark.createDataFrame([("s", 3)], "id string, node_count int")
    assert not sinks.write_manifest(spark, str(tmp_path / "m.json"), nodes.limit(0), before)
    assert sinks.write_manifest(spark, str(tmp_path / "m.json"), nodes, before)
    assert json.loads((tmp_path / "m.json").read_text()) == {"added": ["n1", "n2"], "count": 2, "sessions": [{"id": "s", "node_count": 3}]}
    many = spark.range(100_001).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.col("id").cast("int").alias("node_count"))
    assert sinks.write_manifest(spark, str(tmp_path / "m2.json"), nodes, many)
    ids, sessions = sinks.read_manifest(spark, str(tmp_path / "m2.json"), "id string, node_count int")
    assert {r.id for r in ids.collect()} == {"n1", "n2"} and sessions.count() == 100_001
    lines = spark.createDataFrame([("b", 1, "x"), ("a", 2, "z"), ("a", 1, "y")], "section string, place int, line string")
    assert sinks.render(lines, "T", 34) == "# T\n\n## a\n- y\n- z\n\n## b\n- x\n"
    with pytest.raises(Exception):
        sinks.verified_backup(spark, str(tmp_path / "a"), str(tmp_path / "b"))


def test_lines_without_a_parent_are_dealt_out(spark):
    """Most lines have no parent; looked up by a null key they would all lie in one partition."""
    from mnemotide.operators.windows import looked_up

    n = F.col("n")
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("r"), F.col("id").cast("string"))).alias("parent"))
    table = spark.range(0, 4000, 20).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("parent"), F.col("id").alias("n"))
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = looked_up(rows, table, "parent")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) < 2000 and sum(sizes) == 4000 and found.where(n.isNotNull() & (F.concat(F.lit("r"), n.cast("string")) == F.col("parent"))).count() == 200
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
