"""Line-oriented session logs: rollouts and transcripts, as gaps and islands over numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROLLOUT = "type string, timestamp string, payload struct<id: string, turn_id: string, model: string, type: string, message: string>"
TRANSCRIPT = (
    "type string, uuid string, sessionId string, session_id string, timestamp string, _audit_timestamp string, isSynthetic boolean, isReplay boolean, "
    "message struct<content: string, model: string, usage: struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long>>"
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) for every line of the files under a path. Order within a file is kept by reading each file
    as one row; a session log is one conversation, so that bounds it."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return files.select("file", F.posexplode(F.split("text", "\n")).alias("line", "value")).where(F.trim("value") != "")


def forward_part(ts: Column, watermark: Column, floor: Column | None = None) -> Column:
    """forward from the watermark on, floor where history is asked for explicitly, else history."""
    out = F.when(ts >= watermark, "forward")
    if floor is not None:
        out = out.when(ts >= floor, "floor")
    return out.otherwise("history")


def rollout_turns(lines: DataFrame) -> DataFrame:
    """(file, turn_id, model, user_text, agent_text, ts, user_line) from rollout lines.

    A turn context sets the id and model of what follows and ends a turn; a user message begins one; agent messages
    join with line breaks; completion and abortion end it. Other lines and bad ones are ignored. A turn takes the
    first time of its lines; one without any is dropped.
    """
    w = Window.partitionBy("file").orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("file", "line", F.from_json("value", ROLLOUT).alias("r")).where("r.type is not null")
    event = F.when(F.col("r.type") == "event_msg", F.col("r.payload.type")).otherwise(F.col("r.type"))
    rows = rows.select("file", "line", event.alias("event"), F.col("r.payload.turn_id").alias("tid"), F.col("r.payload.model").alias("model"), F.col("r.payload.message").alias("message"), F.to_timestamp("r.timestamp").alias("ts"))
    context = F.col("event") == "turn_context"
    rows = rows.withColumns({"turn_id": F.last(F.when(context, F.col("tid")), ignorenulls=True).over(upto), "model": F.last(F.when(context, F.col("model")), ignorenulls=True).over(upto)})
    ends = F.col("event").isin("turn_context", "task_complete", "turn_aborted")
    starts = F.col("event") == "user_message"
    rows = rows.withColumns({"segment": F.sum((starts | ends).cast("int")).over(upto), "user_line": F.last(F.when(starts, F.col("line")).when(ends, F.lit(-1)), ignorenulls=True).over(upto)}).where("user_line >= 0 and event in ('user_message', 'agent_message')")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == "agent_message", F.struct("line", "message")))), lambda x: x["message"]), "\n")
    turns = rows.groupBy("file", "user_line").agg(F.first("turn_id", ignorenulls=True).alias("turn_id"), F.first("model", ignorenulls=True).alias("model"), F.max(F.when(F.col("event") == "user_message", F.col("message"))).alias("user_text"), said.alias("agent_text"), F.min("ts").alias("ts"))
    return turns.where("ts is not null")


def rollout_session(lines: DataFrame) -> DataFrame:
    """(file, session): the first session_meta of each file; forked logs carry a second one that does not count."""
    rows = lines.select("file", "line", F.from_json("value", ROLLOUT).alias("r")).where("r.type = 'session_meta'")
    return rows.groupBy("file").agg(F.min_by("r.payload.id", "line").alias("session"))


def log_report(lines: DataFrame) -> DataFrame:
    """(file, lines, bad, compacted): what the reader of rollouts skipped."""
    parsed = F.from_json("value", ROLLOUT)
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(parsed["type"].isNull()).alias("bad"), F.count_if(parsed["type"] == "compacted").alias("compacted"))


def text_of(content: Column) -> Column:
    """Text of a message content, a string or a JSON array of blocks: its text blocks, joined by line breaks."""
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    parts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), F.array_join(parts, "\n")).otherwise(content)


def transcript_turns(lines: DataFrame) -> DataFrame:
    """(file, turn_id, user_text, agent_text, ts, model, tokens): a user's message with the assistant's texts after it.

    Synthetic and replayed lines, and user lines that only return a tool's result, begin no turn. The id is that of
    the last assistant line, else of the user's. Tokens in, out and written add up; of tokens read from a cache the
    last line's count.
    """
    rows = lines.select("file", "line", F.from_json("value", TRANSCRIPT).alias("r")).where("r.type in ('user', 'assistant') and not coalesce(r.isSynthetic, false) and not coalesce(r.isReplay, false)")
    rows = rows.select("file", "line", F.col("r.type").alias("type"), F.col("r.uuid").alias("uuid"), text_of(F.col("r.message.content")).alias("text"), F.coalesce(F.to_timestamp("r.timestamp"), F.to_timestamp("r._audit_timestamp")).alias("ts"), F.col("r.message.model").alias("model"), F.col("r.message.usage").alias("u"))
    real = (F.col("type") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("turn", F.sum(real.cast("int")).over(upto)).where((F.col("turn") > 0) & (real | (F.col("type") == "assistant")))
    agent = F.col("type") == "assistant"
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(agent & (F.coalesce("text", F.lit("")) != ""), F.struct("line", "text")))), lambda x: x["text"]), "\n")
    return rows.groupBy("file", "turn").agg(
        F.coalesce(F.max_by(F.when(agent, F.col("uuid")), F.when(agent, F.col("line"))), F.max(F.when(~agent, F.col("uuid")))).alias("turn_id"),
        F.max(F.when(~agent, F.col("text"))).alias("user_text"), said.alias("agent_text"), F.min("ts").alias("ts"), F.max_by("model", F.when(agent, F.col("line"))).alias("model"),
        F.sum("u.input_tokens").alias("tokens_in"), F.sum("u.output_tokens").alias("tokens_out"), F.sum("u.cache_creation_input_tokens").alias("tokens_cache_write"), F.max_by("u.cache_read_input_tokens", F.when(F.col("u.cache_read_input_tokens").isNotNull(), F.col("line"))).alias("tokens_cache_read"),
    )


def forward_import(turns: DataFrame, known: DataFrame, watermark: Column, floor: Column | None = None, since: Column | None = None) -> DataFrame:
    """Turns to import, with `part`: from the watermark on, or from an explicit floor; never those already known by
    (session, turn_id); nothing before `since`."""
    rows = turns.withColumn("part", forward_part(F.col("ts"), watermark, floor)).where("part <> 'history'")
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    return rows.join(known.select("session", "turn_id"), ["session", "turn_id"], "left_anti")
