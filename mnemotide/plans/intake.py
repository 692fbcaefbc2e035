"""Catalogue: readers, each over records built from the tables in the reader's own format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Store, as_of
from ..operators import views
from ..operators.windows import looked_up
from ..scratch import Scratch
from ..sources import exports, files, transcripts
from .places import CHUNKS
from .registry import query

T0 = 1704067200


def _stamp(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _turns(s: Store) -> DataFrame:
    rows = s.table("conversations").select("conv_id", "turn", "role", "text")
    return rows.withColumn("at", F.lit(T0) + F.col("conv_id") * 3600 + F.col("turn") * 60)


def _list_export(s: Store) -> DataFrame:
    """One JSON text for each conversation, with a list of messages: odd turns carry their text in a content block."""
    odd = F.col("turn") % 2 == 1
    message = F.struct(
        F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.when(~odd, F.col("text")).otherwise("").alias("text"), _stamp(F.col("at")).alias("created_at"),
        F.when(odd, F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<type: string, text: string>>")).alias("content"),
    )
    talks = _turns(s).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias("chat_messages"))
    return talks.select("conv_id", F.to_json(F.struct(F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("uuid"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("name"), "chat_messages")).alias("value"))


SPOKEN = "select 'u' || conv_id as conversation, turn::int as place, case when role = 'assistant' then 'agent' else 'user' end as role, trim(text) as text, make_timestamp(({t} + conv_id * 3600 + turn * 60) * 1000000) as ts from conversations where role in ('user', 'assistant', 'human') and trim(text) <> ''".format(t=T0)


@query(" " + SPOKEN)
def s_list_export(s: Store) -> DataFrame:
    talks = _list_export(s).select(F.from_json("value", exports.LIST_EXPORT).alias("c")).select("c.*")
    return exports.list_turns(talks, as_of()).select("conversation", "place", "role", "text", "ts")


@query(" " + SPOKEN)
def s_array_reader(s: Store) -> DataFrame:
    """The same records as arrays in files, which the streaming reader takes apart."""
    from pyspark.sql import Window

    root = f"{Scratch(s.spark, 'arrays').root}/export"
    rows = _list_export(s).withColumn("part", F.pmod(F.xxhash64("conv_id"), F.lit(8)))
    w = Window.partitionBy("part")
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy("conv_id")), "n": F.count(F.lit(1)).over(w)})
    line = F.concat(F.when(F.col("i") == 1, "[").otherwise(""), "value", F.when(F.col("i") == F.col("n"), "]").otherwise(","))
    rows.repartition("part").sortWithinPartitions("part", "i").select("part", line.alias("value")).write.partitionBy("part").text(root)
    talks = exports.read_array(s.spark, root, exports.LIST_EXPORT)
    return exports.list_turns(talks, as_of()).select("conversation", "place", "role", "text", "ts")


@query(" select conversation, count(*) as turns, sum(length(text))::bigint as chars from (" + SPOKEN + ") group by 1")
def s_export_sizes(s: Store) -> DataFrame:
    talks = _list_export(s).select(F.from_json("value", exports.LIST_EXPORT).alias("c")).select("c.*")
    return exports.export_sizes(exports.list_turns(talks, as_of()))


@query(" select 'c' || conv_id as conversation, (row_number() over (partition by conv_id order by turn) - 1)::int as place, case when role = 'user' then 'user' else 'agent' end as role, trim(text) as text, case when turn % 3 = 0 then 'm-1' else 'slug' end as model from conversations where role in ('user', 'assistant') and trim(text) <> ''")
def s_graph_export(s: Store) -> DataFrame:
    author, content = F.struct(F.col("role").alias("role")), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts"))
    message = F.struct(author.alias("author"), F.col("at").cast("string").alias("create_time"), content.alias("content"), F.struct(F.when(F.col("turn") % 3 == 0, "m-1").alias("model_slug")).alias("metadata"))
    node = F.struct(F.concat(F.lit("n"), F.col("turn").cast("string")).alias("k"), F.struct(message.alias("message")).alias("v"))
    talks = _turns(s).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(node)).alias("mapping"))
    value = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.lit("T").alias("title"), F.lit("slug").alias("default_model_slug"), "mapping"))
    rows = talks.select(F.from_json(value, exports.GRAPH_EXPORT).alias("c")).select("c.*")
    return exports.graph_turns(rows, as_of()).select("conversation", "place", "role", "text", "model")


def _zipped(root: str):
    """Writes the conversations of a task as one archive with shards of at most 50, and a list of assets."""
    def run(batches):
        import json
        import os
        import uuid
        import zipfile
        from urllib.parse import urlparse

        folder = urlparse(root).path
        os.makedirs(folder, exist_ok=True)
        held, shards, archive = [], 0, None
        path = f"{folder}/{uuid.uuid4().hex}.zip"

        def shard():
            nonlocal shards, archive
            archive = archive or zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
            archive.writestr(f"conversations-{shards:03d}.json", "[" + ",".join(held) + "]")
            held.clear()
            shards += 1

        for batch in batches:
            for value in batch.column(0).to_pylist():
                held.append(value)
                if len(held) == 50:
                    shard()
        if held:
            shard()
        if archive:
            archive.writestr("conversation_asset_file_names.json", json.dumps({f"file-{path[-9:-4]}.dat": "x.png"}))
            archive.close()
        yield from ()

    return run


@query(
    " select 'c' || conv_id as conversation, (row_number() over (partition by conv_id order by turn) - 1)::int as place, case when role = 'user' then 'user' else 'agent' end as role, trim(text) as text"
    " from conversations where role in ('user', 'assistant') and trim(text) <> ''"
)
def s_zip_export(s: Store) -> DataFrame:
    """Archives of shards, which tasks write and tasks read, a shard each."""
    author, content = F.struct(F.col("role").alias("role")), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts"))
    message = F.struct(author.alias("author"), F.col("at").cast("string").alias("create_time"), content.alias("content"))
    node = F.struct(F.concat(F.lit("n"), F.col("turn").cast("string")).alias("k"), F.struct(message.alias("message")).alias("v"))
    talks = _turns(s).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(node)).alias("mapping"))
    value = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.lit("T").alias("title"), "mapping"))
    root = f"{Scratch(s.spark, 'zips').root}/zip"
    talks.select(value.alias("value")).repartition(3).mapInArrow(_zipped(root), "value string").write.format("noop").mode("overwrite").save()
    talks, _ = exports.read_zip(s.spark, root)
    return exports.graph_turns(talks, as_of()).select("conversation", "place", "role", "text")


@query(" select 'c' || conv_id as conversation, turn, role, length(text) as chars from conversations")
def s_followed_log(s: Store) -> DataFrame:
    """Logs that grow between the runs of a stream: the second run begins where the first one's checkpoint ends."""
    from ..sources.logs import follow
    from ..streaming.triggers import append_once

    scratch = Scratch(s.spark, "follow")
    lines = s.table("conversations").select("conv_id", F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conversation"), "turn", "role", "text")).alias("value"))
    for part in (0, 1):
        lines.where(F.col("conv_id") % 2 == part).select("value").write.text(f"{scratch.root}/logs/{part}")
        append_once(follow(s.spark, f"{scratch.root}/logs", split=1 << 16), f"{scratch.root}/out", f"{scratch.root}/state").awaitTermination()
    read = s.spark.read.schema("file string, offset long, line string").parquet(f"{scratch.root}/out")
    rows = read.select(F.from_json("line", "conversation string, turn long, role string, text string").alias("x")).select("x.*")
    return rows.select("conversation", "turn", "role", F.length("text").cast("long").alias("chars"))


@query(""", pr as (select *, ts as t, strftime(ts, '%Y-%m-%d') as day, 'ask ' || seq as prompt, case when seq % 4 <> 0 then 'said ' || seq end as reply from nodes where kind = 'tool_call'), bo as (select day, t, prompt, 0 as o, 'user' as role, prompt as text from pr union all select day, t, prompt, 1, 'agent', reply from pr where reply is not null)
 select 'activity-' || day as conversation, (row_number() over (partition by day order by t, prompt, o) - 1)::int as place, role, text from bo""")
def s_activity_export(s: Store) -> DataFrame:
    n = F.col("seq").cast("string")
    rows = s.base.where("kind in ('tool_call', 'decision')").select(
        F.when(F.col("kind") == "tool_call", F.concat(F.lit('Prompted "ask '), n, F.lit('"'))).otherwise("Searched").alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
        F.when(F.col("seq") % 4 != 0, F.array(F.struct(F.lit("Prompted more").alias("name")), F.struct(F.concat(F.lit("said "), n).alias("name")))).alias("subtitles"),
    )
    items = rows.select(F.from_json(F.to_json(F.struct("*")), exports.ACTIVITY_EXPORT).alias("c")).select("c.*")
    return exports.activity_turns(items, as_of()).select("conversation", "place", "role", "text")


def _line(kind: str, at: Column | None = None, **payload: Column) -> Column:
    stamp = at if at is not None else F.lit(None).cast("string")
    return F.to_json(F.struct(F.lit(kind).alias("type"), stamp.alias("timestamp"), F.struct(*[c.alias(k) for k, c in payload.items()] or [F.lit(None).cast("string").alias("id")]).alias("payload")))


def _log(s: Store) -> DataFrame:
    """(file, line, value): a rollout for each conversation. Before a user's turn come a context line and a bad one."""
    rows, n = _turns(s), F.col("turn")
    turn = F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("_"), n.cast("string"))
    lines = F.when(F.col("role") == "user", F.array(_line("turn_context", turn_id=turn, model=F.lit("m")), F.lit("not json"), _line("event_msg", _stamp(F.col("at")), type=F.lit("user_message"), message=F.col("text")))).when(
        F.col("role") == "assistant", F.array(_line("event_msg", _stamp(F.col("at")), type=F.lit("agent_message"), message=F.col("text")), _line("compacted"))
    ).otherwise(F.array(_line("event_msg", type=F.lit("task_complete"))))
    head = rows.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("turn"), F.lit(0).alias("p"), _line("session_meta", id=F.concat(F.lit("s"), F.col("conv_id").cast("string"))).alias("value"))
    every = rows.select("conv_id", "turn", F.posexplode(lines).alias("p", "value")).unionByName(head)
    return every.select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file"), (F.col("turn") * 10 + F.col("p") + 10).cast("int").alias("line"), "value")


ROLL = """, cv as (select *, sum((role <> 'assistant')::int) over (partition by conv_id order by turn) as g from conversations), us as (select conv_id, g, turn, text from cv where role = 'user'), ag as (select conv_id, g, string_agg(text, chr(10) order by turn) as text from cv where role = 'assistant' group by 1, 2)"""


@query(ROLL + " select 'f' || u.conv_id as file, 't' || u.conv_id || '_' || turn as turn_id, 'm' as model, u.text as user_text, coalesce(a.text, '') as agent_text, make_timestamp((1704067200 + u.conv_id * 3600 + turn * 60) * 1000000) as ts from us u left join ag a on a.conv_id = u.conv_id and a.g = u.g")
def s_rollout(s: Store) -> DataFrame:
    return transcripts.rollout_turns(_log(s)).select("file", "turn_id", "model", "user_text", "agent_text", "ts")


@query(" select 'f' || conv_id as file, 's' || conv_id as session, (1 + sum(case role when 'user' then 3 when 'assistant' then 2 else 1 end))::bigint as lines, (count(*) filter (where role = 'user'))::bigint as bad, (count(*) filter (where role = 'assistant'))::bigint as compacted from conversations group by conv_id")
def s_rollout_report(s: Store) -> DataFrame:
    log = _log(s)
    return transcripts.log_report(log).join(transcripts.rollout_session(log), "file").select("file", "session", "lines", "bad", "compacted")


def _transcript(s: Store) -> DataFrame:
    rows, n = _turns(s), F.col("turn")
    usage = F.struct((n + 1).alias("input_tokens"), (n * 2).alias("output_tokens"), (n * 10).alias("cache_read_input_tokens"), (n % 2).alias("cache_creation_input_tokens"))
    content = F.when(F.col("role") == "assistant", F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))).otherwise(F.col("text"))
    message = F.struct(content.alias("content"), F.when(F.col("role") == "assistant", "m").alias("model"), F.when(F.col("role") == "assistant", usage).alias("usage"))
    value = F.to_json(F.struct(F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("type"), F.concat(F.lit("x"), n.cast("string")).alias("uuid"), _stamp(F.col("at")).alias("timestamp"), (F.col("role") == "system").alias("isSynthetic"), message.alias("message")))
    return rows.select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file"), n.cast("int").alias("line"), value.alias("value"))


TRAN = """, cv as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as g from conversations where role <> 'system')"""


@query(TRAN + " select 'f' || conv_id as file, coalesce('x' || max(turn) filter (where role = 'assistant'), 'x' || min(turn)) as turn_id, max(text) filter (where role = 'user') as user_text, coalesce(string_agg(text, chr(10) order by turn) filter (where role = 'assistant' and text <> ''), '') as agent_text, sum(turn + 1) filter (where role = 'assistant')::bigint as tokens_in, sum(turn * 2) filter (where role = 'assistant')::bigint as tokens_out, sum(turn % 2) filter (where role = 'assistant')::bigint as tokens_cache_write, max(turn * 10) filter (where role = 'assistant') as tokens_cache_read from cv where g > 0 group by conv_id, g")
def s_transcript(s: Store) -> DataFrame:
    return transcripts.transcript_turns(_transcript(s)).select("file", "turn_id", "user_text", "agent_text", "tokens_in", "tokens_out", "tokens_cache_write", "tokens_cache_read")


@query(" select 's' || conv_id as session, 't' || turn as turn_id, case when conv_id >= 5 then 'forward' else 'floor' end as part from conversations where conv_id >= 2 and turn % 3 <> 0")
def s_forward_import(s: Store) -> DataFrame:
    rows = _turns(s).select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("turn_id"), F.timestamp_seconds("at").alias("ts"), "turn")
    known = rows.where("turn % 3 = 0").select("session", "turn_id")

    def begin(conv: int) -> Column:
        return F.timestamp_seconds(F.lit(T0 + conv * 3600))

    return transcripts.forward_import(rows, known, begin(5), floor=begin(2)).select("session", "turn_id", "part")


@query(" select seq, case when seq % 4 = 0 then timestamp '2024-01-05 12:00:00' when seq % 4 = 1 then timestamp '2024-01-06 01:02:03' else timestamp '2024-01-01' + to_seconds(seq::int) end as ts, case when seq % 3 = 0 then 'idea' else 'conversation_turn' end as kind, case when seq % 5 = 4 then seq - 4 end as parent, case when seq % 2 = 0 then 'x,backfill' else 'backfill' end as tags from nodes")
def s_session_lines(s: Store) -> DataFrame:
    n = F.col("seq")
    when = F.when(n % 4 == 0, "2024-01-05").when(n % 4 == 1, "2024-01-06T01:02:03Z")
    value = F.to_json(F.struct(F.concat(F.lit("r"), n.cast("string")).alias("ref"), when.alias("when"), F.when(n % 3 == 0, "idea").alias("kind"), n.cast("string").alias("text"), F.when(n % 2 == 0, F.array(F.lit("x"))).alias("tags"), F.when(n % 5 == 4, F.concat(F.lit("r"), (n - 4).cast("string"))).alias("parent")))
    rows = files.session_lines(s.base.select(n.cast("int").alias("line"), value.alias("value")), "s", F.lit("2024-01-01").cast("timestamp"))
    up = rows.select(F.col("id").alias("parent"), F.col("query").cast("long").alias("up"))
    return looked_up(rows, up, "parent").select(F.col("query").cast("long").alias("seq"), "ts", "kind", F.col("up").alias("parent"), F.array_join("tags", ",").alias("tags"))


@query(" select session, tool, query, case when seq % 3 = 0 then '' else 'a' || chr(10) || chr(10) || 'b' end as preview, case when tool in ('Grep', 'Bash', 'WebSearch') then case when seq % 3 = 0 then 0 else 2 end end as result_count, latency_ms from nodes where kind = 'tool_call' and seq % 7 <> 0")
def s_tool_events(s: Store) -> DataFrame:
    n = F.col("seq")
    given = F.when(n % 2 == 0, F.create_map(F.lit("pattern"), F.col("query"))).otherwise(F.create_map(F.lit("command"), F.col("query")))
    value = F.to_json(F.struct(F.col("session").alias("session_id"), F.when(n % 7 == 0, "TodoWrite").otherwise(F.col("tool")).alias("tool_name"), given.alias("tool_input"), F.when(n % 3 != 0, "a\n\nb").alias("tool_result"), F.col("latency_ms").alias("duration_ms")))
    raw = s.base.where("kind = 'tool_call'").select(value.alias("value")).unionByName(s.spark.createDataFrame([("broken",)], "value string"))
    return files.tool_events(raw).select("session", "tool", "query", "preview", "result_count", "latency_ms")


@query(" select session, id as turn_id, 'ask' || chr(10) || query as user_text, output_preview as agent_text from nodes where seq % 5 <> 0 and seq % 3 <> 0")
def s_notify_turns(s: Store) -> DataFrame:
    n = F.col("seq")
    asked = F.array(F.when(n % 5 == 0, "Write a title for this").otherwise("ask"), F.col("query"))
    value = F.to_json(F.struct(F.when(n % 3 == 0, "other").otherwise("agent-turn-complete").alias("type"), F.col("session").alias("thread-id"), F.col("id").alias("turn-id"), asked.alias("input-messages"), F.col("output_preview").alias("last-assistant-message")))
    return views.notify_turns(s.base.select(value.alias("value")), ("Write a title",))


@query(" select session, case seq % 3 when 0 then 'procedure' when 1 then 'warning' else 'insight' end as kind, query, query || '  ·  kw, two' as output_preview, 't' || seq as parent, 'claim,prov:distilled,by:agent,stance:' || case when seq % 2 = 0 then 'doubted' else 'asserted' end || ',kw:kw,kw:two,entity:X,distills:t' || seq as tags, s.started_at as ts from nodes n left join sessions s on s.id = n.session where kind = 'idea'")
def w_claims(s: Store) -> DataFrame:
    n = F.col("seq")
    claims = s.base.where("kind = 'idea'").select(
        "session", F.concat(F.lit(" "), "query", F.lit("\n")).alias("claim"), F.array(F.lit("KW"), F.lit(" two "), F.lit(" ")).alias("keywords"), F.array(F.lit("X")).alias("entities"), F.when(n % 3 == 0, " Lesson").when(n % 3 == 1, "warning").otherwise("odd").alias("kind"),
        F.when(n % 2 == 0, "Doubted ").alias("stance"), F.array(F.concat(F.lit("t"), n.cast("string"))).alias("evidence"),
    )
    out = files.claim_nodes(claims.withColumn("claim", F.regexp_replace("claim", r"\s+$", "")), s.sessions, kind_map={"lesson": "procedure"})
    return out.select("session", "kind", "query", "output_preview", "parent", F.array_join("tags", ",").alias("tags"), "ts")


INGEST = CHUNKS.replace(" select doc_id, (row_number() over (partition by doc_id order by c) - 1)::int as place, length(chunk)::int as chars, md5(chunk) as digest from ch where regexp_matches(chunk, '\\S')", "")


@query(INGEST + r""", parts as (select doc_id, chunk, row_number() over (partition by doc_id order by c) as i, count(*) over (partition by doc_id) as n from ch where regexp_matches(chunk, '\S') and doc_id % 3 <> 0)
 select 'new' as part, 'd' || doc_id || '.txt [' || i || '/' || n || ']: ' || left(chunk, 300) as query, left(chunk, 1800) as output_preview, 'file,file:/p/d' || doc_id || '.txt,mtime:7,ext:txt,proj' as tags from parts union all select 'stale', 'old' || doc_id, null, null from documents where doc_id % 3 = 1""")
def s_ingest(s: Store) -> DataFrame:
    """A third of the files is known as it is, a third in an older form, and a third is new."""
    d = F.col("doc_id").cast("string")
    path = F.concat(F.lit("/p/d"), d, F.lit(".txt"))
    found = s.table("documents").select(path.alias("path"), F.lit(7).cast("long").alias("mtime"), F.lit("txt").alias("ending"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    known = s.table("documents").where("doc_id % 3 < 2").select(F.concat(F.lit("old"), d).alias("id"), F.array(F.concat(F.lit("file:"), path), F.when(F.col("doc_id") % 3 == 0, "mtime:7").otherwise("mtime:6")).alias("tags"))
    nodes, stale = files.ingest(found, known, "proj")
    new = nodes.select(F.lit("new").alias("part"), "query", "output_preview", F.array_join("tags", ",").alias("tags"))
    gone = stale.select(F.lit("stale").alias("part"), F.col("id").alias("query"), F.lit(None).cast("string").alias("output_preview"), F.lit(None).cast("string").alias("tags"))
    return new.unionByName(gone)
