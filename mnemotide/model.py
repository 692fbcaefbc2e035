"""Data model: schemas, fixed values that drive semantics, and the store over the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schemas as DDL, for spark.createDataFrame and readers.
NODE = (
    "id string, session string, kind string, tool string, query string, output_preview string, result_count int, latency_ms int, parent string, "
    "agent_id string, model string, agent_role string, speaker string, memory_tier int, status string, flagged boolean, trust int, ts timestamp, "
    "tags array<string>, episodic_text string, embedding array<float>, importance int, stability_days double, last_injected timestamp, gist string, community string"
)
SESSION = "id string, name string, started_at timestamp, account string, harness string, account_locked boolean"
EDGE = "src string, dst string, type string, tier string, weight double"
LEDGER = "node_id string, session string, channel string, position int, trigger string, shown_at timestamp, cited boolean"

# Importance of each kind; any other kind has 5.
KIND_IMPORTANCE = {
    "warning": 9, "decision": 8, "compress_summary": 8, "procedure": 8, "artifact": 8, "open_item": 7, "insight": 7,
    "idea": 6, "resolved": 6, "hypothesis": 6, "blocker": 6, "context_stamp": 5, "question": 5,
    "conversation_turn": 4, "tool_call": 3, "file_chunk": 3, "interrupt": 2,
}

# Tags that begin so are a machine's, and bare tags that name no project.
PROJECT_MACHINE_PREFIXES = ("kw:", "entity:", "prov:", "by:", "stance:", "account:", "turn:", "member:", "due:")
NOT_PROJECTS = (
    "conversation", "user", "agent", "context", "intent", "session-start", "garden", "human-capture", "reply", "backfill", "consolidated", "compress-event", "pre-compact", "checkpoint",
    "session-end", "agent-authored", "decision", "resolved", "warning", "insight", "strategy", "stack", "pipeline", "scraping", "data", "style", "white-paper", "hardware", "ip",
    "verification", "protocol", "dev", "origin", "parked", "second-brain", "claim", "import", "mcp", "codex", "claude", "human", "distilled", "test", "codex-test", "verified", "shipped",
    "handoff", "registry", "backlog", "sprint", "hygiene", "audit", "codex-audit", "audit-brief", "owner-ruling", "owner-rulings", "owner-approved", "g2", "g2-early", "phase-0", "lane-a",
    "lane-b", "lane-c", "lane-d", "lane-e", "for-codex", "for-all-agents", "ia", "vault", "spec", "correction", "ux", "docs", "doc", "dashboard", "brain", "naming", "feedback", "idea",
    "ideas", "capture", "open-items", "open-item", "open_item", "compact-event", "session", "launch", "security", "federation", "tools", "tooling",
)

# Entities that link nothing. A store's own name is added by whoever knows it.
ENTITY_STOP = (
    "user", "agent", "system", "ai", "model", "claude", "gpt", "gemini", "it", "this", "that", "thing", "things", "project", "app", "code", "session", "node", "nodes", "data", "file",
    "files", "tool", "tools", "human", "you", "stuff",
)

# Kinds that carry meaning. Graph naming, reports and audits share one set; consolidation has no procedure.
MEANING_KINDS = ("decision", "warning", "open_item", "resolved", "insight", "idea", "hypothesis", "question", "blocker", "procedure")
CONSOLIDATION_KINDS = ("decision", "warning", "open_item", "resolved", "insight", "idea", "hypothesis", "question", "blocker")
METHOD_KINDS = ("warning", "resolved", "blocker")
HEARTBEAT_KINDS = ("decision", "warning", "open_item", "resolved", "context_stamp", "insight", "procedure", "idea")
SPARSE_TOOLS = ("Grep", "Glob", "WebSearch")

SLOW_MS, DAY = 2000, 86400.0


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a double, also parts of days."""
    return (later.cast("double") - earlier.cast("double")) / DAY


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "active")


def not_void(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") != "void")


def struggled(latency: str = "latency_ms", found: str = "result_count", tool: str = "tool") -> Column:
    """Slow, empty, or sparse for a tool that usually finds much; nulls do not count."""
    sparse = (F.col(found) <= 2) & F.col(tool).isin(*SPARSE_TOOLS)
    return F.coalesce(F.col(latency) > SLOW_MS, F.lit(False)) | F.coalesce(F.col(found) == 0, F.lit(False)) | F.coalesce(sparse, F.lit(False))


def importance_of(kind: Column, trust: Column, flagged: Column) -> Column:
    """By kind; two less (1 at least) for negative trust, one more (10 at most) for a flag."""
    table = F.create_map(*[F.lit(x) for pair in KIND_IMPORTANCE.items() for x in pair])
    base = F.coalesce(table[kind], F.lit(5))
    base = F.when(trust < 0, F.greatest(F.lit(1), base - 2)).otherwise(base)
    return F.when(flagged, F.least(F.lit(10), base + 1)).otherwise(base).cast("int")


# The vocabulary of the store over the driver's tables; event numbers choose from it.
WORDS = ("parser", "cache", "schema", "token", "index", "retry", "budget", "stream", "vector", "deploy")
VERBS = ("rewrite", "measure", "guard", "split", "rename", "pin", "trace", "drop", "merge", "check")


def _pick(words: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))


@dataclass
class Store:
    """Tables of one memory store. Frames are lazy; readers prune columns and push filters down to parquet."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        """Event nodes without what needs a window or a join."""
        e = F.col("event_id")
        kind = F.expr(
            "case event_type when 'error' then 'warning' when 'purchase' then 'decision' when 'signup' then 'open_item' when 'click' then 'tool_call' "
            "else element_at(array('idea', 'insight', 'resolved', 'conversation_turn'), cast(event_id % 4 + 1 as int)) end"
        )
        query = F.concat(_pick(VERBS, e), F.lit(" the "), _pick(WORDS, F.floor(e / 10)), F.lit(" "), _pick(WORDS, F.floor(e / 100) + e), F.lit(" before "), _pick(WORDS, e * 7), F.lit(" limit "), (e % 13).cast("string"))
        tags = F.filter(
            F.array(
                F.concat(F.lit("entity:"), _pick(WORDS, e)), F.when(e % 6 == 0, F.concat(F.lit("proj-"), (e % 4).cast("string"))), F.when(e % 9 == 0, F.concat(F.lit("kw:"), _pick(VERBS, e))),
                F.when(e % 31 == 0, F.lit("backfill")), F.when(e % 13 == 0, F.concat(F.lit("due:2024-02-"), F.lpad((e % 28 + 1).cast("string"), 2, "0"))), F.when(e % 37 == 0, F.lit("prov:distilled")),
            ),
            lambda t: t.isNotNull(),
        )
        ts = F.col("ts").cast("timestamp")
        session = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("import-chat-"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string")))
        click = F.col("event_type") == "click"
        raw = self.table("events").select(
            e.alias("seq"), F.concat(F.lit("e"), e.cast("string")).alias("id"), session.alias("session"), kind.alias("kind"),
            F.when(click, F.expr("element_at(array('Grep', 'Bash', 'WebSearch', 'Edit'), cast(event_id % 4 + 1 as int))")).alias("tool"),
            query.alias("query"), F.when(e % 3 != 0, F.concat(F.lit("saw "), _pick(WORDS, e * 3), F.lit(" and "), _pick(VERBS, F.floor(e / 7)))).alias("output_preview"),
            F.when(click, (F.get_json_object("props", "$.k").cast("long") % 5).cast("int")).alias("result_count"), F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
            F.expr("element_at(array('model-a', 'model-b', 'unknown'), cast(user_id % 3 + 1 as int))").alias("model"), F.when(e % 11 == 0, "auditor").otherwise("worker").alias("agent_role"),
            F.when(e % 2 == 0, "user").otherwise("agent").alias("speaker"), (e % 3).cast("int").alias("memory_tier"),
            F.when(e % 17 == 0, "void").when(e % 101 == 0, "core").otherwise("active").alias("status"), (e % 23 == 0).alias("flagged"), F.when(e % 29 == 0, -1).otherwise(0).alias("trust"),
            ts.alias("ts"), tags.alias("tags"), (F.lit(1.0) + (e % 40).cast("double")).alias("stability_days"),
            F.when(e % 3 != 0, ts + F.make_dt_interval(days=(e % 20).cast("int"))).alias("last_injected"), F.concat(F.lit("c"), (e % 12).cast("string"), F.lit("|"), F.when(e % 12 == 5, F.lit("12")).when(e % 12 == 7, F.lit("unlabeled")).otherwise(_pick(WORDS, e % 12))).alias("community"),
        )
        return raw.withColumn("importance", importance_of(F.col("kind"), F.col("trust"), F.col("flagged")))

    @cached_property
    def nodes(self) -> DataFrame:
        """Nodes with the previous node of the session as parent."""
        return self.base.withColumn("parent", F.lag("id").over(Window.partitionBy("session").orderBy("ts", "seq")))

    @cached_property
    def vectors(self) -> DataFrame:
        """Embedded nodes: base columns and `embedding`."""
        v = self.table("embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"))
        return self.base.join(v, "seq")

    @cached_property
    def sessions(self) -> DataFrame:
        users = self.base.groupBy("session").agg(F.min("ts").alias("started_at"), F.count(F.lit(1)).alias("node_count"))
        n = F.regexp_extract("session", r"(\d+)$", 1).cast("long")
        return users.select(
            F.col("session").alias("id"), "started_at", "node_count", F.element_at(F.array(F.lit("Ann"), F.lit("bob"), F.lit(None), F.lit("Corp")), (n % 4 + 1).cast("int")).alias("account"),
            F.when(F.startswith("session", F.lit("import-")), "import-chat").otherwise(F.element_at(F.array(F.lit("cli"), F.lit("desk")), (n % 2 + 1).cast("int"))).alias("harness"), (n % 3 == 0).alias("account_locked"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        e = F.col("event_id")
        shown = self.table("events").where(F.col("event_type").isin("view", "click"))
        return shown.select(
            F.concat(F.lit("e"), (e * 7 % 1000).cast("string")).alias("node_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session"),
            F.element_at(F.array(F.lit("hook"), F.lit("fetch"), F.lit("heartbeat")), (e % 3 + 1).cast("int")).alias("channel"), (e % 10).cast("int").alias("position"),
            F.col("ts").cast("timestamp").alias("shown_at"), (e % 5 == 0).alias("cited"), e.alias("seq"),
        )

    @cached_property
    def positions(self) -> DataFrame:
        """Counters of loads, loads in the middle third, and hits in compiled output."""
        return self.ledger.groupBy("node_id").agg(
            F.count(F.lit(1)).alias("total_loads"), F.count_if(F.col("position").between(3, 5)).alias("middle_hits"), F.count_if(F.col("cited") & (F.col("position") == 0)).alias("compiled_hits")
        )

    @cached_property
    def turns(self) -> DataFrame:
        """Nodes of chat turns."""
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
        return self.table("conversations").select(
            F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("import-chat-"), F.col("conv_id").cast("string")).alias("session"),
            F.lit("conversation_turn").alias("kind"), F.when(F.col("role") == "user", "user").otherwise("agent").alias("speaker"), F.col("role"), F.col("turn"), F.substring("text", 1, 500).alias("query"), F.col("text"), at.alias("ts"),
        )


def _sql_pick(words: tuple[str, ...], n: str) -> str:
    return f"[{', '.join(repr(w) for w in words)}][(({n}) % {len(words)}) + 1]"


_SQL_IMPORTANCE = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in KIND_IMPORTANCE.items()) + " else 5 end"

#: The same tables in DuckDB SQL, as the beginning of every query's SQL.
CTE = f"""with recursive base0 as (
  select event_id as seq, 'e' || event_id as id, case when user_id % 5 = 0 then 'import-chat-' else 'user-' end || user_id as session,
    case event_type when 'error' then 'warning' when 'purchase' then 'decision' when 'signup' then 'open_item' when 'click' then 'tool_call'
      else ['idea', 'insight', 'resolved', 'conversation_turn'][event_id % 4 + 1] end as kind,
    case when event_type = 'click' then ['Grep', 'Bash', 'WebSearch', 'Edit'][event_id % 4 + 1] end as tool,
    {_sql_pick(VERBS, 'event_id')} || ' the ' || {_sql_pick(WORDS, 'floor(event_id / 10)::bigint')} || ' ' || {_sql_pick(WORDS, 'floor(event_id / 100)::bigint + event_id')} || ' before ' || {_sql_pick(WORDS, 'event_id * 7')} || ' limit ' || (event_id % 13) as query,
    case when event_id % 3 <> 0 then 'saw ' || {_sql_pick(WORDS, 'event_id * 3')} || ' and ' || {_sql_pick(VERBS, 'floor(event_id / 7)::bigint')} end as output_preview,
    case when event_type = 'click' then (json_extract(props, '$.k')::bigint % 5)::int end as result_count, floor(value * 10)::int as latency_ms,
    ['model-a', 'model-b', 'unknown'][user_id % 3 + 1] as model, case when event_id % 11 = 0 then 'auditor' else 'worker' end as agent_role,
    case when event_id % 2 = 0 then 'user' else 'agent' end as speaker, (event_id % 3)::int as memory_tier,
    case when event_id % 17 = 0 then 'void' when event_id % 101 = 0 then 'core' else 'active' end as status, event_id % 23 = 0 as flagged, case when event_id % 29 = 0 then -1 else 0 end as trust, ts,
    list_filter(['entity:' || {_sql_pick(WORDS, 'event_id')}, case when event_id % 6 = 0 then 'proj-' || (event_id % 4) end, case when event_id % 9 = 0 then 'kw:' || {_sql_pick(VERBS, 'event_id')} end,
      case when event_id % 31 = 0 then 'backfill' end, case when event_id % 13 = 0 then 'due:2024-02-' || lpad((event_id % 28 + 1)::varchar, 2, '0') end, case when event_id % 37 = 0 then 'prov:distilled' end], lambda t: t is not null) as tags,
    1.0::double + event_id % 40 as stability_days, case when event_id % 3 <> 0 then ts + to_days((event_id % 20)::int) end as last_injected,
    'c' || (event_id % 12) || '|' || case when event_id % 12 = 5 then '12' when event_id % 12 = 7 then 'unlabeled' else {_sql_pick(WORDS, 'event_id % 12')} end as community
  from events
), base as (
  select *, case when flagged then least(10, i2) else i1 end::int as importance from (
    select *, i1 + 1 as i2 from (select *, case when trust < 0 then greatest(1, i0 - 2) else i0 end as i1 from (select *, {_SQL_IMPORTANCE} as i0 from base0)))
), nodes as (select *, lag(id) over (partition by session order by ts, seq) as parent from base),
vectors as (select base.*, embedding::double[] as embedding from base join embeddings on vec_id = seq),
sessions as (
  select session as id, min(ts) as started_at, count(*) as node_count, ['Ann', 'bob', null, 'Corp'][regexp_extract(session, '(\\d+)$', 1)::bigint % 4 + 1] as account,
    case when starts_with(session, 'import-') then 'import-chat' else ['cli', 'desk'][regexp_extract(session, '(\\d+)$', 1)::bigint % 2 + 1] end as harness,
    regexp_extract(session, '(\\d+)$', 1)::bigint % 3 = 0 as account_locked from base group by session
), ledger as (
  select 'e' || (event_id * 7 % 1000) as node_id, 'user-' || user_id as session, ['hook', 'fetch', 'heartbeat'][event_id % 3 + 1] as channel, (event_id % 10)::int as position, ts as shown_at, event_id % 5 = 0 as cited, event_id as seq
  from events where event_type in ('view', 'click')
), positions as (
  select node_id, count(*) as total_loads, count(*) filter (where position between 3 and 5) as middle_hits, count(*) filter (where cited and position = 0) as compiled_hits from ledger group by node_id
), turns as (
  select 't' || conv_id || '_' || turn as id, 'import-chat-' || conv_id as session, 'conversation_turn' as kind, case when role = 'user' then 'user' else 'agent' end as speaker, role, turn, left(text, 500) as query, text,
    make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000) as ts from conversations
)"""

AS_OF = "2024-02-01 00:00:00"


def as_of() -> Column:
    """The pinned clock of the catalogue's queries; operators take clocks as parameters."""
    return F.lit(AS_OF).cast("timestamp")
