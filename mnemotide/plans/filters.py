"""Catalogue: filters, joins and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import attribution as at
from ..model import MEANING_KINDS, NOT_PROJECTS, PROJECT_MACHINE_PREFIXES, Store, active, as_of, not_void
from ..operators import bitmaps
from ..operators import filters as f
from ..operators import retrieval, rollups
from ..scratch import Scratch
from .registry import query

MEANING = ", ".join(f"'{k}'" for k in MEANING_KINDS)
SLOW = "coalesce(latency_ms > 2000, false) or coalesce(result_count = 0, false) or coalesce(result_count <= 2 and tool in ('Grep', 'Glob', 'WebSearch'), false)"


@query(" select id, session, kind, importance from nodes where status = 'active' and not starts_with(session, 'import-')")
def p_active_scan(s: Store) -> DataFrame:
    return active(s.base).where(~F.startswith("session", F.lit("import-"))).select("id", "session", "kind", "importance")


@query(f" select id, tool, latency_ms, result_count from nodes where status <> 'void' and ({SLOW})")
def p_struggle(s: Store) -> DataFrame:
    return f.struggles(s.base).select("id", "tool", "latency_ms", "result_count")


@query(" select id, latency_ms from nodes where status = 'active' and kind = 'tool_call' and (coalesce(latency_ms > 800, false) or coalesce(result_count <= 1, false))")
def p_struggle_report(s: Store) -> DataFrame:
    return f.report_struggles(s.base).select("id", "latency_ms")


@query(" select id, 0.0::double as score from nodes where status <> 'void' and (query ilike '%PARSER cache%' or coalesce(output_preview ilike '%PARSER cache%', false)) order by ts desc, id limit 10")
def p_keyword_fallback(s: Store) -> DataFrame:
    return retrieval.keyword_fallback(s.base, "PARSER cache").select("id", "score")


@query(" select id, ts from nodes where status = 'active' and kind = 'warning' and starts_with(session, 'user-1') and contains(lower(concat_ws(' ', query, output_preview)), 'cache') order by ts desc, id limit 60")
def p_live_log(s: Store) -> DataFrame:
    return f.live_log(s.base, limit=99, kind="warning", session_prefix="user-1", contains="Cache").select("id", "ts")


@query(" select id, kind, ts from nodes where status = 'active' and kind in ('decision', 'warning', 'open_item', 'insight', 'resolved') order by ts desc, id limit 12")
def p_recent_set(s: Store) -> DataFrame:
    return f.recent_set(s.base).select("id", "kind", "ts")


@query(", asked(prefix) as (values ('e77'), ('e999'), ('zz'), ('e0')) select prefix, count(id) as matches, case when count(id) = 1 then min(id) end as id, case count(id) when 0 then 'none' when 1 then 'hit' else 'ambiguous' end as status from asked left join nodes on starts_with(id, prefix) group by prefix")
def p_prefix_lookup(s: Store) -> DataFrame:
    return retrieval.lookup(s.base, ["e77", "e999", "zz", "e0"])


def _hidden(s: Store) -> DataFrame:
    archived = s.base.where("seq % 19 = 0").select("id")
    snoozed = s.base.where("seq % 7 = 0").select("id", (F.col("ts") + F.expr("interval 10 days")).alias("until"))
    return f.hidden_ids(archived, snoozed, F.lit("2024-01-20").cast("timestamp"))


HIDDEN = ", hidden as (select id from nodes where seq % 19 = 0 union select id from nodes where seq % 7 = 0 and ts + interval 10 day > timestamp '2024-01-20')"


@query(HIDDEN + " select id, kind from nodes where status = 'active' and id not in (select id from hidden)")
def p_hidden_anti(s: Store) -> DataFrame:
    return active(s.base).join(_hidden(s), "id", "left_anti").select("id", "kind")


@query(" select id, session from nodes where status = 'active' and not starts_with(session, 'import-') and not list_contains(tags, 'prov:distilled')")
def p_live_gate(s: Store) -> DataFrame:
    return f.live(active(s.base)).select("id", "session")


@query(" select id, ts from nodes where status = 'active' and ts >= timestamp '2024-01-15' and ts < timestamp '2024-01-16' and not starts_with(session, 'import-')")
def p_day_view(s: Store) -> DataFrame:
    return f.day_view(s.base, F.lit("2024-01-15 13:00:00").cast("timestamp")).select("id", "ts")


@query(" select id, seq from nodes where status <> 'void' order by ts, id limit 300 offset 600")
def p_offset_page(s: Store) -> DataFrame:
    return not_void(s.base).orderBy("ts", "id").offset(600).limit(300).select("id", "seq")


@query(" select id, case when length(query) >= length(coalesce(output_preview, '')) then query else output_preview end as body from nodes")
def p_canonical_body(s: Store) -> DataFrame:
    return s.base.select("id", retrieval.canonical_body(("query", "output_preview")).alias("body"))


@query(" select maturity, count(*) as nodes from (select case when kind = 'procedure' or stability_days >= 30 then 'evergreen' when stability_days >= 3 then 'budding' else 'seedling' end as maturity from nodes where status = 'active') group by maturity")
def p_maturity(s: Store) -> DataFrame:
    return active(s.base).groupBy(f.maturity().alias("maturity")).agg(F.count(F.lit(1)).alias("nodes"))


@query(" select id from nodes where list_has_any(tags, ['backfill', 'consolidated', 'prov:distilled', 'audit', 'registry-row']) and not list_contains(tags, 'human-capture')")
def p_process_register(s: Store) -> DataFrame:
    return s.base.where(f.is_process()).select("id")


@query(HIDDEN + ", page as (select * from nodes where status = 'active' and ts < timestamp '2024-01-25' order by ts desc, id limit 40) select id, ts from page where id not in (select id from hidden) order by ts desc, id limit 10")
def p_just_landed(s: Store) -> DataFrame:
    return f.just_landed(s.base, _hidden(s), F.lit("2024-01-25").cast("timestamp")).select("id", "ts")


@query(" select id, kind, query, case when memory_tier = 0 then 1 else memory_tier end as memory_tier, importance, model from nodes")
def p_node_card(s: Store) -> DataFrame:
    return s.base.select(*f.node_card())


@query(r" select id from nodes where query like '%limit 1\_%' escape '\' or query like '%retry%' escape '\'")
def p_like_escape(s: Store) -> DataFrame:
    return s.base.where(F.expr(rf"query like '%{f.like_literal('limit 1_')}%' escape '\\' or query like '%retry%' escape '\\'".replace("\\_", "\\\\_"))).select("id")


@query(" select n.id, s.account, s.harness from nodes n join sessions s on n.session = s.id where n.status <> 'void'")
def j_nodes_sessions_inner(s: Store) -> DataFrame:
    return not_void(s.base).select("id", "session").join(s.sessions.select(F.col("id").alias("session"), "account", "harness"), "session").select("id", "account", "harness")


@query(" select n.id, s.account from nodes n left join sessions s on n.session = s.id and s.account = 'Ann'")
def j_left_atlas(s: Store) -> DataFrame:
    ann = s.sessions.where("account = 'Ann'").select(F.col("id").alias("session"), "account")
    return s.base.select("id", "session").join(ann, "session", "left").select("id", "account")


@query(" select s.id, s.account, count(n.id) as nodes from sessions s left join nodes n on n.session = s.id and n.kind = 'warning' group by s.id, s.account")
def j_sessions_left_count(s: Store) -> DataFrame:
    warned = s.base.where("kind = 'warning'").groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return s.sessions.select("id", "account").join(warned.withColumnRenamed("session", "id"), "id", "left").select("id", "account", F.coalesce("n", F.lit(0)).alias("nodes"))


@query(" select n.id, coalesce(shows, 0) as shows from nodes n left join (select node_id, count(*) as shows from ledger group by node_id) l on l.node_id = n.id where status = 'active'")
def j_ledger_preagg(s: Store) -> DataFrame:
    shows = s.ledger.groupBy("node_id").agg(F.count(F.lit(1)).alias("shows"))
    return active(s.base).select("id").join(shows.withColumnRenamed("node_id", "id"), "id", "left").select("id", F.coalesce("shows", F.lit(0)).alias("shows"))


@query(" select n.id from nodes n where n.kind = 'open_item' and n.status = 'active' and not exists (select 1 from nodes c where c.parent = n.id and c.status = 'active')")
def j_no_children_anti(s: Store) -> DataFrame:
    children = active(s.nodes).where("parent is not null").select(F.col("parent").alias("id"))
    return active(s.nodes).where("kind = 'open_item'").select("id").join(children, "id", "left_anti")


@query(" select id from nodes where session not in (select id from sessions order by started_at desc, id limit 3)")
def j_not_in_newest_sessions_anti(s: Store) -> DataFrame:
    newest = s.sessions.orderBy(F.desc("started_at"), "id").limit(3).select(F.col("id").alias("session"))
    return s.base.select("id", "session").join(F.broadcast(newest), "session", "left_anti").select("id")


@query(" select id from nodes where session in (select id from sessions where lower(account) = 'bob')")
def j_account_semi(s: Store) -> DataFrame:
    bob = s.sessions.where("lower(account) = 'bob'").select(F.col("id").alias("session"))
    return s.base.select("id", "session").join(bob, "session", "left_semi").select("id")


@query(" select c.id, p.kind || ': ' || left(p.query, 80) as hint from nodes c join nodes p on c.parent = p.id")
def j_parent_self(s: Store) -> DataFrame:
    parents = s.base.select(F.col("id").alias("parent"), F.concat("kind", F.lit(": "), F.substring("query", 1, 80)).alias("hint"))
    return s.nodes.where("parent is not null").select("id", "parent").join(parents, "parent").select("id", "hint")


def _consolidated(s: Store) -> DataFrame:
    """Nodes of which every 50th stands for the two after it."""
    member = [F.concat(F.lit("member:e"), (F.col("seq") + i).cast("string")) for i in (1, 2)]
    return s.base.withColumn("tags", F.when(F.col("seq") % 50 == 0, F.concat("tags", F.array(F.lit("consolidated"), *member))).otherwise(F.col("tags")))


MEMBERS = ", named as (select id, 'e' || (seq + i) as member from nodes, (values (1), (2)) v(i) where seq % 50 = 0 and status = 'active')"


@query(MEMBERS + " select named.id as src, n.id as dst from named join nodes n on n.id = member where n.status = 'active'")
def j_member_unnest(s: Store) -> DataFrame:
    from ..operators.graph import dendrite_edges

    return dendrite_edges(_consolidated(s)).select("src", "dst")


CHANNELS = [("user-", "everyone"), ("user-1", "Ann "), ("user-12", "bob"), ("import-", "archive")]


@query(", ch(prefix, account) as (values ('user-', 'everyone'), ('user-1', 'Ann'), ('user-12', 'bob'), ('import-', 'archive')) select id, (select account from ch where starts_with(id, prefix) order by length(prefix) desc limit 1) as routed from sessions")
def j_longest_prefix(s: Store) -> DataFrame:
    channels = s.spark.createDataFrame(CHANNELS, "prefix string, account string")
    return at.channel_route(s.sessions.select("id"), channels, session="id")


@query(" select id from nodes where status = 'active' and kind in ('decision', 'warning') and contains(lower(query), 'cache')::int + contains(lower(query), 'guard')::int + contains(lower(query), 'token')::int >= 2")
def j_contains_min2(s: Store) -> DataFrame:
    words = F.array(F.lit("cache"), F.lit("guard"), F.lit("token"))
    return active(s.base).where(F.col("kind").isin("decision", "warning") & (F.size(F.filter(words, lambda w: F.contains(F.lower("query"), w))) >= 2)).select("id")


@query(r""", refs as (select distinct unnest(regexp_extract_all('answers ' || lpad(lower(to_hex(seq * 7)), 12, '0') || ' and more', '\b[0-9a-f]{12}\b')) as ref from nodes where kind = 'resolved' and status = 'active')
 select id from nodes where kind = 'warning' and status = 'active' and lpad(lower(to_hex(seq)), 12, '0') not in (select ref from refs)""")
def j_regex_reference_anti(s: Store) -> DataFrame:
    """Warnings that no resolution mentions by its 12-digit id."""
    def hexed(n):
        return F.lpad(F.lower(F.hex(n)), 12, "0")

    text = F.concat(F.lit("answers "), hexed(F.col("seq") * 7), F.lit(" and more"))
    refs = active(s.base).where("kind = 'resolved'").select(F.explode(F.regexp_extract_all(text, F.lit(r"\b[0-9a-f]{12}\b"), F.lit(0))).alias("ref"))
    return active(s.base).where("kind = 'warning'").select("id", hexed(F.col("seq")).alias("ref")).join(refs, "ref", "left_anti").select("id")


@query(" select count(*) as nodes, count(*) filter (where status = 'active') as active, count(*) filter (where status = 'void') as void, count(*) filter (where flagged) as flagged, count(distinct session) as sessions from nodes")
def a_stats(s: Store) -> DataFrame:
    return rollups.stats(s.base)


@query(" select count(*) as tracked, sum(total_loads)::bigint as loads, sum(compiled_hits)::bigint as hits, count(*) filter (where middle_hits >= 2 and compiled_hits = 0) as underattended, sum(compiled_hits)::double / sum(total_loads) as efficiency from positions")
def a_attention(s: Store) -> DataFrame:
    return rollups.attention(s.positions)


STRUGGLED = "(coalesce(latency_ms > 2000, false) or coalesce(result_count = 0, false) or coalesce(result_count <= 2 and tool in ('Grep', 'Glob', 'WebSearch'), false))"
# some nodes of the kinds that the store's events lack
SAID = (
    ", said as (select * replace (case seq % 14 when 1 then 'question' when 2 then 'blocker' when 3 then 'context_stamp' else kind end as kind, case when seq % 15 = 4 then '' when seq % 7 = 5 then null else query end as query,"
    " case seq % 8 when 1 then null when 2 then '' else model end as model) from nodes where status <> 'void')"
)


def _said(s: Store) -> DataFrame:
    n = F.col("seq")
    return s.base.withColumns({
        "kind": F.when(n % 14 == 1, "question").when(n % 14 == 2, "blocker").when(n % 14 == 3, "context_stamp").otherwise(F.col("kind")),
        "query": F.when(n % 15 == 4, "").when(n % 7 == 5, None).otherwise(F.col("query")), "model": F.when(n % 8 == 1, None).when(n % 8 == 2, "").otherwise(F.col("model")),
    })


@query(
    SAID + f" select session, count(*) as nodes, count(*) filter (where flagged) as flagged, count(*) filter (where {STRUGGLED}) as struggles, min(ts) as first_ts, max(ts) as last_ts, count(*) filter (where kind = 'context_stamp') as stamps,"
    " count(*) filter (where kind = 'conversation_turn') as turns, count(*) filter (where kind = 'decision') as decisions, count(*) filter (where kind = 'question') as questions, count(*) filter (where kind = 'blocker') as blockers,"
    " count(*) filter (where kind = 'resolved') as resolved, (select string_agg(k, ',' order by k) from (select kind || '=' || count(*) as k from said x where x.session = said.session group by kind)) as kinds,"
    " (select string_agg(m, ',' order by m) from (select coalesce(nullif(model, ''), 'unknown') || '=' || count(*) as m from said x where x.session = said.session group by coalesce(nullif(model, ''), 'unknown'))) as models from said group by session"
)
def a_session_summary(s: Store) -> DataFrame:
    return rollups.session_summary(_said(s))


@query(SAID + " select session, case kind when 'context_stamp' then 'stamp_text' when 'question' then 'open_questions' else 'open_blockers' end as list, ts, id, query as text from said where kind in ('context_stamp', 'question') and query <> '' or kind = 'blocker' and query <> '' and status = 'active'")
def a_session_texts(s: Store) -> DataFrame:
    return rollups.session_texts(_said(s))


@query(" select session, count(*) as nodes, count(*) filter (where memory_tier = 0) as hot, count(*) filter (where memory_tier = 1) as warm, count(*) filter (where kind in ('decision', 'warning', 'open_item', 'insight', 'resolved')) as intent from nodes where status <> 'void' group by session")
def a_session_tiers(s: Store) -> DataFrame:
    return rollups.session_tiers(s.base)


@query(" select memory_tier, count(*) as nodes, count(v.id) as embedded, floor(100 * count(v.id) / count(*))::bigint as percent from nodes n left join (select id from vectors) v using (id) where status <> 'void' group by memory_tier")
def a_tier_embed_coverage(s: Store) -> DataFrame:
    return rollups.tier_coverage(s.base, s.vectors)


@query(" select channel, count(*) as shown, count(*) filter (where cited) as cited from ledger group by channel")
def a_ledger_channel(s: Store) -> DataFrame:
    return rollups.ledger_by_channel(s.ledger)


AGE = "(epoch(timestamp '2024-02-01') - epoch(ts)) / 86400.0"


@query(f" select session, model, count(*) as nodes, max(ts) as last_ts from nodes where status = 'active' and {AGE} between 0 and 7 group by 1, 2 order by nodes desc, session, model limit 10")
def a_activity_week(s: Store) -> DataFrame:
    return rollups.activity(s.base, as_of())


@query(" select coalesce(account, 'unlabeled') as account, count(distinct n.session) as sessions, count(*) as nodes, min(ts) as first_ts, max(ts) as last_ts from nodes n join sessions s on s.id = n.session where status <> 'void' group by 1")
def a_volumes(s: Store) -> DataFrame:
    return rollups.volumes(s.base, s.sessions)


@query(" select session, count(*) as nodes, max(ts) as last_ts from nodes where status <> 'void' and not starts_with(session, 'import-') group by session order by last_ts desc, session limit 50")
def a_live_sessions(s: Store) -> DataFrame:
    return rollups.live_sessions(s.base)


@query(", hit as (select distinct id, kind, importance, ts, case t when 'proj-0' then 'zero' when 'proj-2' then 'zero' end as project from (select *, unnest(tags) as t from nodes where status = 'active') where t in ('proj-0', 'proj-2')), ranked as (select *, row_number() over (partition by project, kind order by importance desc, ts desc, id) as r from hit) select project, kind, count(*) as nodes, string_agg(id, ',' order by r) filter (where r <= 3) as exemplars from ranked group by 1, 2")
def a_project_chapters(s: Store) -> DataFrame:
    return rollups.project_chapters(s.base, {"zero": ["proj-0", "proj-2"]})


IGNORED = ", ".join(f"'{t}'" for t in NOT_PROJECTS)
MACHINE = "^(" + "|".join(PROJECT_MACHINE_PREFIXES) + ")"


QUOTE = "''"  # one quote inside a text of SQL


def family_sql(tag: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower(trim({tag})), '^[^\w]+|[^\w]+$', '', 'g'), '{QUOTE}s$', '')"
    return f"case when ends_with({bare}, 's') and length({bare}) > 3 then left({bare}, length({bare}) - 1) else {bare} end"


# nodes with a few spellings of a tag that no project declares
SPELLED = ", spelt as (select * replace (list_concat(tags, case seq % 10 when 3 then ['(Kites)'] when 4 then ['kite'] when 5 then ['Kite''s', 'docs'] when 6 then ['ok'] else [] end) as tags) from nodes)"


def spelled(nodes: DataFrame) -> DataFrame:
    n = F.col("seq") % 10
    more = F.when(n == 3, F.array(F.lit("(Kites)"))).when(n == 4, F.array(F.lit("kite"))).when(n == 5, F.array(F.lit("Kite's"), F.lit("docs"))).when(n == 6, F.array(F.lit("ok"))).otherwise(F.array().cast("array<string>"))
    return nodes.withColumn("tags", F.concat("tags", more))


@query(
    SPELLED + f", u as (select *, {family_sql('tag')} as family from (select id, session, ts, unnest(tags) as tag from spelt where status = 'active') where not regexp_matches(tag, '{MACHINE}') and tag not in ({IGNORED}) and tag <> 'proj-0')"
    " select family, count(distinct id) as nodes, count(distinct session) as sessions, count(distinct ts::date) as days, max(ts) as last_ts, (select tag from u v where v.family = u.family group by tag order by count(*) desc, tag desc limit 1) as display"
    " from u where family <> '' group by family having count(distinct id) >= 6 and count(distinct session) >= 2 and count(distinct ts::date) >= 2"
)
def a_emerging_families(s: Store) -> DataFrame:
    return rollups.emerging_families(spelled(s.base), ["proj-0"])


@query(
    SPELLED + f", u as (select id, session, ts::date as day, {family_sql('tag')} as name from (select id, session, ts, unnest(tags) as tag from spelt where status = 'active') where not regexp_matches(tag, '{MACHINE}'))"
    " select name, count(distinct id) as nodes, count(distinct session) as sessions, count(distinct day) as days from u where name <> '' and day between date '2024-01-05' and date '2024-01-20' group by name"
)
def a_family_bitmaps(s: Store) -> DataFrame:
    """Families over some days, from bitmaps that were built in two steps; the second brings new days, nodes and sessions, and
    late rows of old days."""
    scratch = Scratch(s.spark, "bitmaps")
    rows = active(spelled(s.base)).select("id", "session", "seq", F.to_date("ts").alias("day"), F.explode("tags").alias("tag")).where(rollups.names_a_project(F.col("tag"), ()))
    rows = scratch.save(rows.withColumn("name", rollups.family_key(F.col("tag"))).where("name <> ''"))
    early = (F.col("day") < F.lit("2024-01-12")) & (F.col("seq") % 5 != 0)
    nodes = sessions = held = None
    for part in (rows.where(early), rows.where(~early)):
        nodes = bitmaps.numbered(part.select(F.col("id").alias("value")), scratch, nodes)
        sessions = bitmaps.numbered(part.select(F.col("session").alias("value")), scratch, sessions)
        met = part.join(nodes.select(F.col("value").alias("id"), F.col("n").alias("node")), "id").join(sessions.select(F.col("value").alias("session"), F.col("n").alias("place")), "session")
        new = bitmaps.daily_bitmaps(met, {"nodes": F.col("node"), "sessions": F.col("place")})
        held = scratch.save(new if held is None else bitmaps.merged(held, new))
    return bitmaps.span_counts(held, ("nodes", "sessions"), F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))


GATHERED = SPELLED + f", g as (select * from (select *, unnest(tags) as tag from spelt where status = 'active') where contains(regexp_replace(regexp_replace(lower(tag), '{MACHINE}', ''), '[^a-z0-9]+', '', 'g'), 'ite'))"


@query(GATHERED + " select tag, count(distinct id) as nodes from g group by tag order by nodes desc, tag limit 24")
def a_deep_gather(s: Store) -> DataFrame:
    return rollups.deep_gather(spelled(s.base), "kw:I-te!")


@query(GATHERED + " select count(distinct id) as total, (select string_agg(q, ' | ' order by ts, id) from (select distinct id, ts, left(query, 90) as q from g order by ts, id limit 3)) as samples from g")
def a_gather_total(s: Store) -> DataFrame:
    return rollups.gather_total(spelled(s.base), "ite").withColumn("samples", F.array_join("samples", " | "))


@query(" select tag, count(*) as nodes from (select unnest(tags) as tag from nodes where status = 'active') where not starts_with(tag, 'member:') and tag not in ('backfill', 'consolidated') group by tag order by nodes desc, tag limit 24")
def a_tag_hubs(s: Store) -> DataFrame:
    return rollups.tag_hubs(s.base)


@query(" select tag, count(*) as nodes from (select unnest(tags) as tag from nodes where status = 'active') where not regexp_matches(tag, '^(entity:|kw:|due:|prov:)') group by tag having count(*) >= 2 order by lower(tag), tag limit 1000")
def a_tag_index(s: Store) -> DataFrame:
    return rollups.tag_index(s.base)


TOPICS = f", t as (select split_part(community, '|', 1) as cid, split_part(community, '|', 2) as label, count(*) as total, count(*) filter (where list_contains(tags, 'prov:distilled')) as distilled, count(*) filter (where kind in ({MEANING})) as meaning, max(ts) filter (where kind in ({MEANING})) as last_meaning from nodes where status = 'active' and (seq % 12 <> 3 or list_contains(tags, 'prov:distilled')) group by 1, 2) select * from t where not regexp_matches(label, '^\\d+$') and label not in ('', 'unlabeled') and "


@query(TOPICS + "not (total >= 20 and distilled / total > 0.8)")
def a_topics_gate(s: Store) -> DataFrame:
    return rollups.topics(s.base.where("seq % 12 <> 3 or array_contains(tags, 'prov:distilled')"))


@query(TOPICS + "total >= 20 and distilled / total > 0.8")
def a_topics_gated_log(s: Store) -> DataFrame:
    return rollups.topics(s.base.where("seq % 12 <> 3 or array_contains(tags, 'prov:distilled')"), gated=True)


@query(
    SPELLED + f", week as (select * from spelt where status = 'active' and {AGE} <= 7 and not starts_with(session, 'import-')), per as (select session, count(*) as n from week group by 1),"
    f" x as (select id, session, tag, case when tag in ('proj-0', 'proj-2') then 'proj-0' when tag = 'proj-9' then 'proj-9' end as project, {family_sql('tag')} as fk from (select id, session, unnest(tags) as tag from week)),"
    f" y as (select *, coalesce('p:' || project, 'e:' || fk) as k from x where project is not null or (not regexp_matches(tag, '{MACHINE}') and tag not in ({IGNORED}) and fk <> '')),"
    " z as (select k, any_value(project) as project, count(distinct id) as nodes, count(distinct session) as sessions, (select sum(n) from per where session in (select session from y v where v.k = y.k))::bigint as approx,"
    " (select tag from y v where v.k = y.k group by tag order by count(*) desc, tag desc limit 1) as spelling from y group by k)"
    " select coalesce(project, spelling) as tag, case project when 'proj-0' then 'the first' when 'proj-9' then 'no one''s' else spelling end as name, nodes, sessions, approx, project is not null as declared from z where project is not null or nodes >= 3"
    " union all select null, 'untagged', count(*), 0, 0, false from week where id not in (select id from y)"
)
def a_weekly_families(s: Store) -> DataFrame:
    return rollups.weekly_families(spelled(s.base), as_of(), {"proj-0": ("the first", ["proj-2"]), "proj-9": ("no one's", [])})


@query(f" select count(*) as nodes, count(*) filter (where {AGE} between 0 and 14) as recent, count(*) filter (where {AGE} between 0 and 14 and kind = 'decision') as decisions, count(*) filter (where kind = 'open_item') as open_items from nodes where status = 'active'")
def a_page_one(s: Store) -> DataFrame:
    return rollups.page_one(s.base, as_of())


@query(" select session, count(*) as turns, sum(greatest(length(query), length(text)))::bigint as chars, floor(sum(greatest(length(query), length(text))) * 0.35)::bigint as tokens from turns where session not in (select 'import-chat-' || conv_id from conversations where conv_id % 3 = 0) group by session")
def a_backfill_plan(s: Store) -> DataFrame:
    done = s.turns.where(F.regexp_extract("session", r"(\d+)$", 1).cast("long") % 3 == 0).select("session").distinct()
    return rollups.backfill_plan(s.turns, done)


@query(" select tag, count(distinct session) as sessions, count(*) as nodes from (select session, unnest(tags) as tag from nodes where status = 'active') where starts_with(tag, 'entity:') group by tag having count(distinct session) >= 2 order by sessions desc, tag limit 25")
def a_entity_bridges(s: Store) -> DataFrame:
    return rollups.entity_bridges(s.base)


@query(" select account, count(*) as sessions, sum(node_count)::bigint as nodes, string_agg(distinct harness, ',' order by harness) as harnesses from sessions group by account")
def a_account_harness_list(s: Store) -> DataFrame:
    return rollups.account_harnesses(s.sessions)


@query(" select parent, count(*) as children from nodes where status = 'active' and parent is not null group by parent")
def a_child_counts(s: Store) -> DataFrame:
    return rollups.child_counts(s.nodes)


@query(f" select model, count(*) as nodes, count(*) filter (where {SLOW}) as struggles, count(*) filter (where flagged) as flags, arg_min(agent_role, (ts, id)) as first_role from nodes where status = 'active' group by model")
def a_model_attribution(s: Store) -> DataFrame:
    return rollups.model_attribution(s.base)


@query(" select kind, count(*) as nodes from nodes where status = 'active' and kind in ('decision', 'insight', 'resolved', 'open_item', 'warning') group by kind")
def a_decision_count(s: Store) -> DataFrame:
    return active(s.base).where(F.col("kind").isin(*rollups.INTENT_KINDS)).groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))


@query(" select id, started_at, node_count + n as node_count, coalesce(case when not account_locked and proven is not null and account is not null then proven end, account, proven, anyone) as account, account_locked or lock as account_locked from sessions join (select session, count(*) as n, arg_min('new-' || (seq % 2), ts) filter (where seq % 50 = 0) as proven, 'new-0' as anyone, bool_or(seq % 50 = 0) as lock from nodes where seq % 2 = 0 group by session) i on i.session = id")
def a_session_upsert(s: Store) -> DataFrame:
    incoming = s.base.where("seq % 2 = 0").select("session", "ts", F.concat(F.lit("new-"), (F.col("seq") % 2).cast("string")).alias("account"), (F.col("seq") % 50 == 0).alias("account_locked"))
    met = incoming.select(F.col("session").alias("id")).distinct()
    return rollups.session_upsert(s.sessions.join(met, "id", "left_semi"), incoming)
