"""Project files as chunk nodes, session files of JSON lines, and tool events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MAX_FILE_BYTES, PREVIEW_CHARS, chunks_of
from ..operators.windows import looked_up

# Endings of files that are read, and folders that are not.
ENDINGS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".md", ".txt", ".json", ".html", ".css", ".sql", ".sh", ".yaml", ".yml", ".toml", ".rs",
    ".go", ".java", ".c", ".cpp", ".h", ".rb", ".php", ".vue", ".svelte",
)
SKIPPED = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".cache", "target", ".idea", ".vscode", "media")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, ending, text) of the files worth reading under a root; size and name filter before content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    inside = F.split(F.col("path"), "/")
    keep = ending.isin(*ENDINGS) & ~F.arrays_overlap(inside, F.array(*[F.lit(x) for x in SKIPPED])) & (F.col("length") <= MAX_FILE_BYTES)
    return files.where(keep).select("path", F.unix_seconds("modificationTime").alias("mtime"), F.substring(ending, 2, 10).alias("ending"), F.decode("content", "utf-8").alias("text"))


def ingest(files: DataFrame, existing: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(new chunk nodes, ids to void): files whose (path, mtime) has chunks already are left; changed ones replace theirs.

    `existing` has id and tags of active nodes.
    """
    known = existing.select("id", F.try_element_at(F.filter("tags", lambda t: F.startswith(t, F.lit("file:"))), F.lit(1)).alias("f"), F.try_element_at(F.filter("tags", lambda t: F.startswith(t, F.lit("mtime:"))), F.lit(1)).alias("m")).where("f is not null")
    rows = files.withColumns({"f": F.concat(F.lit("file:"), "path"), "m": F.concat(F.lit("mtime:"), F.col("mtime").cast("string"))})
    fresh = rows.join(known.select("f", "m").distinct(), ["f", "m"], "left_anti")
    stale = known.join(fresh.select("f"), "f", "left_semi").select("id")
    parts = fresh.withColumn("chunks", chunks_of("text", "path")).select("*", F.size("chunks").alias("n"), F.posexplode("chunks").alias("i", "chunk"))
    name = F.element_at(F.split("path", "/"), -1)
    nodes = parts.select(
        F.substring(F.sha2(F.concat_ws("|", "f", "m", F.col("i").cast("string")), 256), 1, 12).alias("id"), F.lit(f"files-{project}").alias("session"), F.lit("file_chunk").alias("kind"),
        F.concat(name, F.lit(" ["), (F.col("i") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("]: "), F.substring("chunk", 1, 300)).alias("query"), F.substring("chunk", 1, PREVIEW_CHARS).alias("output_preview"),
        F.lit("ingest").alias("model"), F.lit(2).alias("memory_tier"), F.array(F.lit("file"), F.col("f"), F.col("m"), F.concat(F.lit("ext:"), "ending"), F.lit(project)).alias("tags"),
    )
    return nodes, stale


SESSION_LINE = "ref string, when string, kind string, speaker string, gist string, text string, tags array<string>, parent string, importance int"


def session_lines(lines: DataFrame, session: str, base: Column) -> DataFrame:
    """Nodes of a session file (columns line, value): times as given, whole days at noon, else the base and a second
    for each line; parents by reference to earlier lines."""
    rows = lines.select("line", F.from_json("value", SESSION_LINE).alias("r")).where("r.text is not null or r.gist is not null").select("line", "r.*")
    day = F.when(F.rlike("when", F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat("when", F.lit("T12:00:00Z"))).otherwise(F.col("when"))
    ts = F.coalesce(day.try_cast("timestamp"), F.timestamp_seconds(base.cast("double") + F.col("line")))
    ident = F.substring(F.sha2(F.concat_ws("|", F.lit(session), F.col("line").cast("string")), 256), 1, 12)
    rows = rows.withColumns({"id": ident, "ts": ts})
    refs = rows.where("ref is not null").select(F.col("ref").alias("parent"), F.col("id").alias("parent_id"))
    out = looked_up(rows, refs, "parent")
    return out.select("id", F.lit(session).alias("session"), F.coalesce("kind", F.lit("conversation_turn")).alias("kind"), F.coalesce("speaker", F.lit("agent")).alias("speaker"), F.col("text").alias("query"), "gist", F.col("parent_id").alias("parent"), "ts", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("backfill"))).alias("tags"), "importance")


TOOL_EVENT = "session_id string, tool_name string, tool_input map<string, string>, tool_result string, duration_ms long, latency_ms long, timestamp string"


def tool_events(raw: DataFrame, skip: tuple[str, ...] = ("TodoWrite", "Task")) -> DataFrame:
    """(session, tool, query, preview, result_count, latency_ms, ts) from JSON text in `value`, for batch and stream.

    The query is the first of the input's known fields; the count is of the result's lines, for tools that list.
    """
    e = F.from_json("value", TOOL_EVENT)
    rows = raw.select(e.alias("e")).where("e.tool_name is not null").where(~F.col("e.tool_name").isin(*skip))
    given = F.col("e.tool_input")
    query = F.coalesce(*[given[k] for k in ("pattern", "file_path", "command", "query", "url", "description")])
    result = F.coalesce(F.col("e.tool_result"), F.lit(""))
    lines = F.size(F.filter(F.split(result, "\n"), lambda x: F.trim(x) != ""))
    return rows.select(F.col("e.session_id").alias("session"), F.col("e.tool_name").alias("tool"), query.alias("query"), F.substring(result, 1, 500).alias("preview"), F.when(F.col("e.tool_name").isin("Grep", "Glob", "Bash", "WebSearch"), lines).alias("result_count"), F.coalesce("e.latency_ms", "e.duration_ms").cast("int").alias("latency_ms"), F.to_timestamp("e.timestamp").alias("ts"))


CLAIM_KINDS = ("decision", "insight", "idea", "question", "warning", "open_item", "procedure", "resolved", "hypothesis")


def claim_nodes(claims: DataFrame, sessions: DataFrame, distiller: str = "agent", kind_map: dict[str, str] | None = None) -> DataFrame:
    """Nodes from distilled claims (session, claim, keywords, entities, kind, stance, evidence), dated to their session."""
    def cleaned(col, n, lower=False):
        parts = F.filter(F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: F.trim(F.lower(x) if lower else x)), lambda x: x != "")
        return F.slice(parts, 1, n)

    kinds = F.create_map(*[F.lit(x) for p in {**{k: k for k in CLAIM_KINDS}, **(kind_map or {})}.items() for x in p])
    rows = claims.withColumn("claim", F.trim("claim")).where("claim <> ''").join(sessions.select(F.col("id").alias("session"), "started_at"), "session", "left")
    rows = rows.withColumns({"k": cleaned(F.col("keywords"), 8, True), "e": cleaned(F.col("entities"), 8), "v": cleaned(F.col("evidence"), 20)})

    def tagged(prefix, col):
        return F.transform(col, lambda x: F.concat(F.lit(prefix), x))

    stance = F.concat(F.lit("stance:"), F.lower(F.trim(F.coalesce("stance", F.lit("asserted")))))
    tags = F.concat(F.array(F.lit("claim"), F.lit("prov:distilled"), F.lit(f"by:{distiller}"), stance), tagged("kw:", F.col("k")), tagged("entity:", F.col("e")), tagged("distills:", F.col("v")))
    shown = F.substring(F.concat("claim", F.when(F.size("k") > 0, F.concat(F.lit("  ·  "), F.array_join("k", ", "))).otherwise("")), 1, 2000)
    return rows.select(F.substring(F.sha2(F.concat_ws("|", "session", "claim"), 256), 1, 12).alias("id"), "session", F.coalesce(kinds[F.lower(F.trim("kind"))], F.lit("insight")).alias("kind"), F.substring("claim", 1, 500).alias("query"), shown.alias("output_preview"), F.try_element_at("v", F.lit(1)).alias("parent"), F.lit(f"distilled:{distiller}").alias("model"), tags.alias("tags"), F.col("started_at").alias("ts"))
