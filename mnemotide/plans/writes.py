"""Catalogue: what is written back: growth, receipts, workflows, sinks, and the batch and stream forms of triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CTE, HEARTBEAT_KINDS, Store, active, as_of
from ..operators import compiled, dynamics, graph, reports, workflow
from ..operators.substrings import GramIndex
from ..scratch import Scratch
from ..sources import sinks
from ..streaming import triggers
from . import places  # noqa: F401  registers the SQL that the cycle's rests on
from .composed import PROJECTS
from .memory import DUE
from .registry import ORACLE_SQL, query
from .sequences import DRIFTED

HEART = ", ".join(f"'{k}'" for k in HEARTBEAT_KINDS)
NOW = "timestamp '2024-02-01'"


@query(f" select id, round(case when hit and status <> 'void' then least(365, stability_days * 1.3) else stability_days end, 6) as stability_days, case when hit and status <> 'void' and memory_tier = 1 then 2 else memory_tier end as memory_tier, case when hit and status <> 'void' then {NOW} else last_injected end as last_injected from (select *, seq % 10 < 3 as hit from nodes)")
def e_member_growth(s: Store) -> DataFrame:
    rows = s.base.withColumn("last_injected", F.least("last_injected", as_of()))
    changes = dynamics.absorbed_members(s.base.where("seq % 10 < 3").select("id"), rows, as_of())
    out = dynamics.fold_changes(s.base, changes)
    shown = F.when((F.col("seq") % 10 < 3) & (F.col("status") != "void"), F.least("last_injected", as_of())).otherwise(F.col("last_injected"))
    return out.select("id", F.round("stability_days", 6).alias("stability_days"), "memory_tier", shown.alias("last_injected"))


RECEIPTS = ", rc as (select id as node_id, session, (row_number() over (partition by session order by ts, seq) - 1)::int as position from nodes qualify position < 5)"


def _receipts(s: Store) -> DataFrame:
    first = s.base.groupBy("session").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ts", "seq", "id"))), 1, 5), lambda x: x["id"]).alias("ids"))
    return dynamics.record_shown(first, "user-12", "heartbeat", "count", F.lit("2024-01-25").cast("timestamp"))


@query(RECEIPTS + " select node_id, 'user-12' as session, 'heartbeat' as channel, position, 'count' as trigger, timestamp '2024-01-25' as shown_at, false as cited from rc")
def e_record_shown(s: Store) -> DataFrame:
    return _receipts(s)


@query(RECEIPTS + " select id, case when id in (select node_id from rc) then greatest(timestamp '2024-01-25', coalesce(last_injected, timestamp '2000-01-01')) else last_injected end as last_injected from nodes")
def e_exposures(s: Store) -> DataFrame:
    return dynamics.fold_changes(s.base, dynamics.exposures(_receipts(s))).select("id", "last_injected")


@query(", ci as (select distinct session, 'e' || (seq + 1) as id from nodes where kind = 'decision'), pv as (select distinct n.id, 'report' as why from nodes n join ci using (id) where n.status = 'active' and (n.session = ci.session or memory_tier = 0) union select id, 'review' from nodes where seq % 11 = 0), g as (select id, product(case why when 'report' then 1.6 else 1.2 end) as f from pv group by 1) select id, round(least(365, stability_days * f), 6) as stability_days from nodes join g using (id) where status <> 'void'")
def e_citation_growth(s: Store) -> DataFrame:
    text = F.array_join(F.collect_list(F.concat(F.lit("see `e"), (F.col("seq") + 1).cast("string"), F.lit("`"))), " ")
    texts = s.base.where("kind = 'decision'").groupBy("session").agg(text.alias("text"))
    proven = dynamics.cited_in(s.base, texts).unionByName(s.base.where("seq % 11 = 0").select("id", F.lit("review").alias("why")))
    changes = dynamics.grown(s.base, proven, as_of())
    return changes.select("id", F.round(F.col("value").cast("double"), 6).alias("stability_days"))


@query(", st as (select id, memory_tier, greatest(0, least(2, memory_tier + case when seq % 5 = 0 then -1 else 0 end + case when seq % 7 = 0 then 1 else 0 end))::int as t from nodes) select id, t as memory_tier from st where t <> memory_tier")
def e_tier_steps(s: Store) -> DataFrame:
    steps = s.base.where("seq % 5 = 0").select("id", F.lit(-1).alias("step")).unionByName(s.base.where("seq % 7 = 0").select("id", F.lit(1).alias("step")))
    return dynamics.tier_steps(s.base, steps, as_of()).select("id", F.col("value").cast("int").alias("memory_tier"))


_STAGES = ("embedded", "consolidated", "demoted", "edges", "communities", "atlas", "book", "page_one", "report", "audit", "registry")
# Stages of which the query also shows what they published, as the columns of one text for each row.
_SHOWN = {"embedded": ("id",), "consolidated": ("kind", "query", "parent"), "demoted": ("id", "session", "memory_tier"), "edges": ("src", "dst", "type", "tier")}


def _cycle_sql() -> str:
    """Rows and digests of what the cycle must publish, from the whole SQL of the queries that show the same results."""
    demoted = " select id, session, 2 as memory_tier from nodes where memory_tier = 1 and status = 'active' and session <> 'user-12' and session not in (select id from sessions order by started_at desc, id limit 3)"
    chain = " select p.id as src, c.id as dst, 'chain' as type, null as tier from nodes c join nodes p on c.parent = p.id where c.status = 'active' and p.status = 'active'"
    edges = f"select src, dst, type, tier from ({ORACLE_SQL['g_knn_edges']}) union all select * from ({CTE}{chain})"
    results = {"embedded": ORACLE_SQL["w_embed_pending"], "consolidated": ORACLE_SQL["e_synthesis"], "demoted": CTE + demoted, "edges": edges}
    parts = []
    for stage in _STAGES:
        n = digest = "null::bigint"
        if stage in results:
            text = " || '|' || ".join(f"coalesce({c}::varchar, '-')" for c in _SHOWN[stage])
            n, digest = "count(*)", f"coalesce(sum(('0x' || left(md5({text}), 8))::bigint), 0)::bigint"
        source = f" from ({results[stage]})" if stage in results else ""
        parts.append(f"select '{stage}' as stage, '1' as outcome, 'unchanged' as again, {n} as n, {digest} as digest{source}")
    return " union all ".join(parts)


def e_sleep(s: Store) -> DataFrame:
    """The cycle run twice over the same tables: (stage, outcome, again, n, digest), the last two of what is published."""
    from ..functions.vectors import hash_embedding
    from .sleep import sleep_cycle

    root = f"{Scratch(s.spark, 'cycle').root}/out"

    def cycle() -> dict[str, str]:
        return sleep_cycle(
            s.spark, s.nodes, s.vectors, s.sessions, s.ledger, root, as_of(), "user-12", tiers=(0.3, 0.35, 0.4), floor=0.3, projects={k: v[1] for k, v in PROJECTS.items()},
            encode=lambda c: hash_embedding(c, 16), encoder="hash-16",
        )

    first, again = cycle(), cycle()
    shown = None
    for stage, cols in _SHOWN.items():
        if first[stage] != "1":
            continue
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols])
        one = sinks.read_current(s.spark, f"{root}/{stage}").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")), F.lit(0)).alias("digest"))
        one = one.withColumn("stage", F.lit(stage))
        shown = one if shown is None else shown.unionByName(one)
    out = s.spark.createDataFrame([(k, v, again[k]) for k, v in sorted(first.items())], "stage string, outcome string, again string")
    return out if shown is None else out.join(shown, "stage", "left")



query()(e_sleep)
ORACLE_SQL["e_sleep"] = _cycle_sql()  # holds the common tables once for each result


PACKS = f""", du as (select n.id, session as own, memory_tier, {DUE} / (1 + coalesce(shows, 0) / 25.0) * case when memory_tier = 0 then 2.0 else 1.0 end as due from nodes n left join (select node_id, count(*) as shows from ledger group by 1) l on l.node_id = n.id where status = 'active' and kind in ({HEART}) and memory_tier <= 1),
 sent as (select l.session, sum(case when position < 3 then 1.0::double else 1 / 3.0::double end) as sent from ledger l join nodes n on n.id = l.node_id where channel = 'heartbeat' and n.memory_tier = 1 group by 1),
 asked as (select s.id as session, coalesce(sent, 0) >= 9 as hot from sessions s left join sent on sent.session = s.id)
 select session, place, id, case when place < 3 then 'verbatim' else 'gist' end as form from (select session, id, (row_number() over (partition by session order by due desc, id) - 1)::int as place from asked a join du on own <> session and (not hot or memory_tier = 0)) where place < 9"""


@query(PACKS)
def x_heartbeat_packs(s: Store) -> DataFrame:
    fired = s.base.select("session").distinct()
    return dynamics.heartbeat_packs(fired, s.base, s.ledger, as_of(), context_tokens=45_000)


WORDS4 = r"list_transform(list_filter(regexp_split_to_array(regexp_replace(query, '[/\\\\]', ' ', 'g'), '\s+'), lambda w: length(w) > 3 and not starts_with(w, '-')), lambda w: lower(w))"


def _told(s: Store) -> DataFrame:
    """Nodes with an episodic text, which holds words inside longer ones."""
    word = F.substring_index("query", " ", -4)
    return s.base.withColumn("episodic_text", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("Un"), F.upper(F.substring_index(word, " ", 1)), F.lit("ed, re"), F.substring_index("query", " ", 1), F.lit("d"))))


TOLD = ", told as (select *, case when seq % 3 = 0 then 'Un' || upper(string_split(query, ' ')[-4]) || 'ed, re' || string_split(query, ' ')[1] || 'd' end as episodic_text from nodes)"


@query(
    f"""{TOLD}, cl as (select seq, session as own, {WORDS4} as k from nodes where kind = 'tool_call' and (coalesce(latency_ms > 2000, false) or coalesce(result_count = 0, false) and tool <> 'Bash')),
 hit as (select c.seq, c.own, c.k, m.id, lower(concat_ws(' ', query, output_preview, episodic_text)) as text, row_number() over (partition by c.seq order by memory_tier, importance desc, ts desc, id) as r
  from cl c join told m on m.session <> own and len(list_distinct(k)) >= 2 and (contains(lower(query), k[1]) or coalesce(contains(lower(output_preview), k[1]), false) or coalesce(contains(lower(episodic_text), k[1]), false))
  where status = 'active' and kind in ('decision', 'warning', 'resolved', 'open_item')),
 fit as (select seq, id, row_number() over (partition by seq order by r) as place from hit where r <= 24 and len(list_filter(list_distinct(k), lambda w: contains(text, w))) >= 2 and not exists (select 1 from ledger l where channel = 'hook' and l.node_id = hit.id and l.session = own))
 select seq, id, place::int as place from fit where place <= 3"""
)
def x_reminders(s: Store) -> DataFrame:
    return triggers.reminders(s.base.where("kind = 'tool_call'"), _told(s), s.ledger)


@query(f"{TOLD} select word, id from told, (values ('pars'), ('tch'), ('cache'), ('edrop'), ('limit 1'), ('zzz'), ('uncache')) as w(word) where contains(lower(query), word) or coalesce(contains(lower(output_preview), word), false) or coalesce(contains(lower(episodic_text), word), false)")
def p_substring_index(s: Store) -> DataFrame:
    asked = s.spark.createDataFrame([(w,) for w in ("pars", "tch", "cache", "edrop", "limit 1", "zzz", "uncache")], "word string")
    return GramIndex(_told(s), "id", ["query", "output_preview", "episodic_text"], Scratch(s.spark, "grams")).words_in(asked).select("word", "id")


@query(" select session, count(*) as tools, max(ts) as last_ts, case when epoch(timestamp '2024-01-30') - epoch(max(ts)) > 86400 then 'stale' when epoch(timestamp '2024-01-30') - epoch(max(ts)) > 900 then 'idle' else 'live' end as state from nodes where kind = 'tool_call' and ts <= timestamp '2024-01-30' group by 1")
def x_live_buffers(s: Store) -> DataFrame:
    now = F.lit("2024-01-30").cast("timestamp")
    return triggers.live_buffers(s.base.where("kind = 'tool_call'").where(F.col("ts") <= now), now)


def _stream(s: Store, scratch: Scratch) -> DataFrame:
    """The nodes as a stream: written as a table and read as it grows."""
    rows = s.base.select("seq", "id", "session", "kind", "tool", "ts")
    rows.write.parquet(f"{scratch.root}/in")
    return s.spark.readStream.schema(rows.schema).parquet(f"{scratch.root}/in")


def _collected(stream: DataFrame, scratch: Scratch) -> DataFrame:
    triggers.append_once(stream, f"{scratch.root}/out", f"{scratch.root}/state").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{scratch.root}/out")


@query(" select distinct session, 't' || (seq // 3) as turn_id from nodes")
def x_turn_capture(s: Store) -> DataFrame:
    scratch = Scratch(s.spark, "capture")
    rows = _stream(s, scratch).select("session", F.concat(F.lit("t"), F.floor(F.col("seq") / 3).cast("string")).alias("turn_id"), "ts")
    return _collected(triggers.once_per_turn(rows), scratch).select("session", "turn_id")


@query(", m as (select *, kind <> 'tool_call' as turn, coalesce(sum((kind <> 'tool_call')::int) over (partition by session order by ts, seq rows between unbounded preceding and 1 preceding), 0) as g from nodes) select session, max(id) filter (where turn) as turn_id, coalesce(string_agg(tool, ',' order by ts, seq) filter (where not turn), '') as tools from m group by session, g having count(*) filter (where turn) > 0")
def x_turn_attach(s: Store) -> DataFrame:
    scratch = Scratch(s.spark, "attach")
    rows = _stream(s, scratch).select("session", "ts", "seq", (F.col("kind") != "tool_call").alias("is_turn"), F.col("id").alias("turn_id"), "tool")
    out = _collected(triggers.attached_turns(rows, ttl_ms=None), scratch)
    return out.select("session", "turn_id", F.array_join("tool_calls", ",").alias("tools"))


def _restarted(s: Store, rows: DataFrame, make, label: str) -> DataFrame:
    """What a stream over `rows` gives, whose first run ends in the middle of the month and whose second begins at its checkpoint."""
    scratch = Scratch(s.spark, label)
    for part in (F.col("ts") < F.lit("2024-01-15").cast("timestamp"), F.col("ts") >= F.lit("2024-01-15").cast("timestamp")):
        rows.where(part).write.mode("append").parquet(f"{scratch.root}/in")
        out = make(s.spark.readStream.schema(rows.schema).parquet(f"{scratch.root}/in"))
        triggers.append_once(out, f"{scratch.root}/out", f"{scratch.root}/state").awaitTermination()
    return s.spark.read.schema(out.schema).parquet(f"{scratch.root}/out")


@query(DRIFTED.replace("select session, id, n::int as n", "select session, n"))
def x_stream_drift(s: Store) -> DataFrame:
    rows = s.base.where("kind = 'tool_call'").select("session", "ts", "seq", "query")
    return _restarted(s, rows, lambda x: triggers.drifts(x, floor=0.4, ttl_ms=None), "drift")


@query(" select session, n * 25 as n from (select session, unnest(range(1, count(*) // 25 + 1)) as n from nodes group by session)")
def x_stream_heartbeat(s: Store) -> DataFrame:
    return _restarted(s, s.base.select("session", "ts"), lambda x: triggers.heartbeats(x, ttl_ms=None), "heartbeat")


@query(
    ", v as (select session, ts, sum(new) over (partition by session order by ts, seq) as visit from (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by session order by ts, seq)) < 1800000000 then 0 else 1 end as new from nodes)),"
    " w as (select session, min(ts) as a, max(ts) + interval 30 minutes as b, count(*) as events from v group by session, visit) select session, a as start, b as \"end\", events from w where b <= (select date_trunc('millisecond', max(ts)) - interval 1 hour from nodes)"
)
def x_stream_visits(s: Store) -> DataFrame:
    """Visits that have ended for certain: a later event is an hour and more beyond their end."""
    return _restarted(s, s.base.select("session", "ts"), triggers.visit_windows, "visits")


@query(" select session, query from nodes where kind = 'tool_call' and tool in ('Edit', 'Bash') group by 1, 2")
def x_stream_files(s: Store) -> DataFrame:
    """Files touched, once for each session, in a stream whose keys are kept for longer than it is."""
    rows = s.base.where("kind = 'tool_call' and tool in ('Edit', 'Bash')").select("session", "query", F.lit("Edit").alias("tool"), "ts")
    return _restarted(s, rows, lambda x: triggers.once_per_file(x, "60 days"), "files").select("session", "query")


@query(" select id, ts from nodes order by ts desc, id desc limit 20")
def x_live_tail(s: Store) -> DataFrame:
    scratch, seen = Scratch(s.spark, "tail"), []
    triggers.live_feed(_stream(s, scratch).select("id", "ts"), seen.extend, f"{scratch.root}/state", trigger={"availableNow": True}).awaitTermination()
    return s.spark.createDataFrame([(r["id"], r["ts"]) for r in seen], "id string, ts timestamp")


@query(" select session, 25 * unnest(range(1, count(*)::bigint // 25 + 1)) as n from nodes group by session")
def x_heartbeat_stream(s: Store) -> DataFrame:
    scratch = Scratch(s.spark, "beats")
    return _collected(triggers.heartbeats(_stream(s, scratch), ttl_ms=None), scratch)


def _written(s: Store) -> DataFrame:
    """All workflows on their own slices of the nodes, as one table of the nodes that they append."""
    note = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("note "), "id"))
    asked = s.base.select("id", "seq", note.alias("note"))
    rows, now, me = s.base, as_of(), "user-12"
    closed, _ = workflow.done(rows, asked.where("seq % 20 = 0"), now, me)
    receipts = s.base.where("seq % 20 = 1").withColumns({"kind": F.lit("resolved"), "parent": F.concat(F.lit("e"), (F.col("seq") + 1).cast("string"))}).select("id", "kind", "parent", "query", "output_preview", "tags")
    others = s.base.where("seq % 20 <> 1").select("id", "kind", F.lit(None).cast("string").alias("parent"), "query", "output_preview", "tags")
    again, _ = workflow.undone(others.unionByName(receipts), receipts.select("id"), now, me)
    wanted = workflow.research(rows, asked.where("seq % 20 = 3"), now, me)
    replied = workflow.replies(rows, s.base.where("seq % 20 = 4").select("id", F.concat(F.lit(" re "), "query").alias("text"), (F.col("seq") % 40 == 4).alias("memory")), now, me)
    raised = workflow.promoted(rows.withColumn("query", F.concat("query", F.lit(" due:2024-03-01"))), s.base.where("seq % 20 = 5").select("id", F.when(F.col("seq") % 3 == 0, "idea").when(F.col("seq") % 3 == 1, "open_item").otherwise("chore").alias("kind")), now, me)
    out = None
    for verb, part in (("done", closed), ("undone", again), ("research", wanted), ("reply", replied), ("promoted", raised)):
        one = part.select(F.lit(verb).alias("verb"), "kind", "query", "output_preview", "parent", "memory_tier", F.array_join("tags", ",").alias("tags"))
        out = one if out is None else out.unionByName(one)
    return out


_ABOUT = "array_to_string(list_concat(list_filter(tags, lambda t: not regexp_matches(t, '^(entity:|kw:|due:|prov:|garden|backfill)')), ['promoted']), ',')"


@query(f""" select 'done' as verb, 'resolved' as kind, case when seq % 2 = 0 then 'note ' || id else 'done: ' || query end as query, case when seq % 2 = 0 then 'note ' || id else 'done: ' || query end as output_preview, id as parent, 1 as memory_tier, 'garden,desk-done' as tags from nodes where seq % 20 = 0
 union all select 'undone', kind, query, coalesce(output_preview, query), id, 1, array_to_string(list_append(tags, 'restored-after-misclick'), ',') from nodes where seq % 20 = 2
 union all select 'research', 'open_item', 'RESEARCH: ' || query, case when seq % 2 = 0 then 'note ' || id else 'requested from the Ideas tab — findings go on the idea node' end, id, 1, 'research-queue,garden' from nodes where seq % 20 = 3
 union all select 'reply', 'note', 're ' || query, 're ' || query, id, case when seq % 40 = 4 then 1 else 2 end, 'annotation,garden,' || case when seq % 40 = 4 then 'memory' else 'quiet' end from nodes where seq % 20 = 4
 union all select 'promoted', case when seq % 3 = 0 then 'idea' else 'open_item' end, query, query, id, 1, {_ABOUT} from nodes where seq % 20 = 5 and seq % 3 < 2""")
def f_workflows(s: Store) -> DataFrame:
    return _written(s)


@query(" select id, case when seq % 20 = 0 then 'void' else status end as status from nodes")
def f_workflow_voids(s: Store) -> DataFrame:
    _, changes = workflow.done(s.base, s.base.where("seq % 20 = 0").select("id", F.lit("").alias("note")), as_of(), "user-12")
    return dynamics.fold_changes(s.base, changes).select("id", "status")


@query(" select case when starts_with(session, 'import-') then 'import' when starts_with(session, 'files-') then 'files' else 'live' end as session_family, count(*) as nodes, count(distinct session) as sessions from nodes group by 1")
def k_append(s: Store) -> DataFrame:
    root = f"{Scratch(s.spark, 'append').root}/nodes"
    half = F.col("seq") % 2 == 0
    sinks.append_nodes(s.base.where(half), root)
    sinks.append_nodes(s.base.where(~half), root)
    return s.spark.read.parquet(root).groupBy("session_family").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("session").alias("sessions"))


@query(" select p.id as src, c.id as dst, 2 as version from nodes c join nodes p on c.parent = p.id where c.status = 'active' and p.status = 'active'")
def k_rebuild(s: Store) -> DataFrame:
    """Edges published twice; a third build that began before the second is overtaken."""
    root = f"{Scratch(s.spark, 'rebuild').root}/edges"
    first = sinks.publish(graph.chain_edges(s.nodes).limit(3), root, None)
    second = sinks.publish(graph.chain_edges(s.nodes), root, first)
    sinks.publish(graph.chain_edges(s.nodes).limit(1), root, first)
    return sinks.read_current(s.spark, root).select("src", "dst", F.lit(second).alias("version"))


def _mark(*columns: str):
    """A sum over rows that any engine can compute, and that no change of a row leaves as it is."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.coalesce(F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")), F.lit(0))


def _mark_sql(*columns: str) -> str:
    return "coalesce(sum(('0x' || left(md5(concat_ws('|', " + ", ".join(f"coalesce({c}::varchar, '')" for c in columns) + ")), 8))::bigint), 0)::bigint"


@query(f" select session, count(*) as nodes, {_mark_sql('id', 'kind', 'query', 'output_preview', 'importance')} as mark from nodes group by session")
def k_backup(s: Store) -> DataFrame:
    """What the verified copy holds."""
    root = Scratch(s.spark, "backup").root
    s.base.write.parquet(f"{root}/a")
    sinks.verified_backup(s.spark, f"{root}/a", f"{root}/b")
    return s.spark.read.parquet(f"{root}/b").groupBy("session").agg(F.count(F.lit(1)).alias("nodes"), _mark("id", "kind", "query", "output_preview", "importance").alias("mark"))


@query(" select 'added' as part, id, null::bigint as node_count from nodes where seq % 3 = 0 union all select 'session', id, node_count from sessions")
def k_manifest(s: Store) -> DataFrame:
    path = f"{Scratch(s.spark, 'manifest').root}/m.json"
    sinks.write_manifest(s.spark, path, s.base.where("seq % 3 = 0"), s.sessions.select("id", "node_count"), most=200)
    ids, sessions = sinks.read_manifest(s.spark, path, "id string, node_count long")
    return ids.select(F.lit("added").alias("part"), "id", F.lit(None).cast("long").alias("node_count")).unionByName(sessions.select(F.lit("session").alias("part"), "id", "node_count"))


_LINKS = "(select p.id as src, c.id as dst from {0} c join {0} p on c.parent = p.id where c.status = 'active' and p.status = 'active')"


@query(
    ", fewer as (select * from nodes where kind <> 'warning'), "
    f"a as (select count(*) as edges, {_mark_sql('src', 'dst')} as mark from {_LINKS.format('nodes')}), b as (select count(*) as edges, {_mark_sql('src', 'dst')} as mark from {_LINKS.format('fewer')})"
    " select 'first' as step, 'built' as outcome, * from a union all select 'again', 'fresh', * from a union all select 'during a write', 'overtaken', * from a union all select 'after it', 'built', * from b"
)
def k_generations(s: Store) -> DataFrame:
    """The edges are built, found fresh though the nodes changed unseen, overtaken by a write that comes while they are built, and
    built again from the changed nodes; with what is published after each step."""
    root = f"{Scratch(s.spark, 'generations').root}/edges"
    some = s.nodes.where("kind <> 'warning'")

    def disturbed() -> DataFrame:
        sinks.touch(s.spark, root)
        return graph.chain_edges(some)

    steps = [("first", lambda: graph.chain_edges(s.nodes)), ("again", lambda: graph.chain_edges(some)), ("during a write", disturbed), ("after it", lambda: graph.chain_edges(some))]
    out = None
    for step, build in steps:
        if step == "during a write":
            sinks.touch(s.spark, root)
        outcome = sinks.rebuild_if_stale(s.spark, root, build)
        now = sinks.read_current(s.spark, root).agg(F.count(F.lit(1)).alias("edges"), _mark("src", "dst").alias("mark"))
        row = Scratch(s.spark, "step").save(now.select(F.lit(step).alias("step"), F.lit(outcome).alias("outcome"), "edges", "mark"))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def k_pages(s: Store) -> DataFrame:
    """The lines of the book and its first page as written; `f_book` and `f_page_one` compare their content."""
    root = Scratch(s.spark, "pages").root
    sinks.write_pages(s.spark, root, compiled.book(s.base, s.sessions, PROJECTS, as_of()), compiled.page_one(s.base, s.sessions, PROJECTS, as_of()))
    out = None
    for name in ("BOOK.md", "PAGE_ONE.md"):
        one = s.spark.read.text(f"{root}/{name}").select(F.lit(name).alias("file"), "value")
        out = one if out is None else out.unionByName(one)
    return out


@query(", reg as (select 'p' || (seq % 5) as slug, arg_max(['blessed', 'proposed', 'archived'][seq % 3 + 1], (ts, id)) as status, arg_max((seq % 50)::int, (ts, id)) as evidence from nodes where status = 'active' group by 1) select slug, row_number() over (order by case status when 'blessed' then 0 when 'proposed' then 1 when 'archived' then 3 end, evidence desc, slug)::int as place from reg")
def k_finish_lines(s: Store) -> DataFrame:
    from .composed import _registry

    rows = reports.finish_lines(_registry(s)).select("slug").collect()
    return s.spark.createDataFrame([(r.slug, i + 1) for i, r in enumerate(rows)], "slug string, place int")


@query(" select status, count(*) as nodes, true as same_in_another_order, true as other_when_changed from nodes group by status")
def k_digest(s: Store) -> DataFrame:
    """For the nodes of each status: the digest stays when rows are dealt anew, and not when one query text changes."""
    out = []
    for (status,) in sorted(s.base.select("status").distinct().collect()):
        own = s.base.where(F.col("status") == status)
        one = own.agg(F.min("seq")).first()[0]
        first, again, changed = (sinks.digest(d) for d in (own, own.repartition(5, "query"), own.withColumn("query", F.when(F.col("seq") == one, "other").otherwise(F.col("query")))))
        out.append((status, first[0], first == again, first != changed))
    return s.spark.createDataFrame(out, "status string, nodes long, same_in_another_order boolean, other_when_changed boolean")
