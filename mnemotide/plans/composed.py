"""Catalogue: reports that are composed of several searches, registries, and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MEANING_KINDS, Store, active, as_of
from ..operators import compiled, reports, views
from .filters import AGE, HIDDEN, IGNORED, MACHINE, SPELLED, _consolidated, _hidden, family_sql, spelled
from .memory import DAYS, DUE
from .registry import query

MEANING = ", ".join(f"'{k}'" for k in MEANING_KINDS)
NEWS = ", ".join(f"'{k}'" for k in reports.NEWS_KINDS)
LIVE = "status = 'active' and not starts_with(session, 'import-') and not list_contains(tags, 'prov:distilled')"
DATED = "(select id, strptime(list_filter(tags, lambda t: starts_with(t, 'due:'))[1][5:], '%Y-%m-%d')::date as d from {} where status = 'active' and len(list_filter(tags, lambda t: starts_with(t, 'due:'))) > 0)"


def _rows(section: str, source: str, order: str, note: str = "null") -> str:
    return f"select '{section}' as section, row_number() over (order by {order})::int as place, id::varchar as id, ({note})::varchar as note from ({source})"


def _top(where: str, k: int, table: str = "a") -> str:
    return f"select * from (select * from {table} where {where} order by ts desc, id limit {k}) where id not in (select id from hidden)"


HUB = (
    HIDDEN + f", a as (select * from nodes where status = 'active'), fad as (select id, importance, unseen, {DUE} / importance as neglect from a join (select node_id, count(*) as unseen from ledger where not cited group by 1 having count(*) >= 2) on node_id = id order by importance desc, neglect desc, unseen desc, id limit 5),"
    f" act as (select session as id, model, count(*) as n from a where {AGE} between 0 and 7 and not starts_with(session, 'import-') group by 1, 2 order by n desc, session, model limit 10), dated as (select * from {DATED.format('nodes')} where id not in (select id from hidden)) "
    + " union all ".join([
        _rows("open", _top("kind = 'open_item'", 8), "ts desc, id"), _rows("fading", "select * from fad where id not in (select id from hidden)", "importance desc, neglect desc, unseen desc, id", "unseen"), _rows("ideas", _top("kind = 'idea'", 6), "ts desc, id"),
        _rows("activity", "select * from act", "n desc, id, model", "model || ' ' || n"), f"select 'chat', 1, count(*)::varchar, null from a where {AGE} <= 7 and starts_with(session, 'user-1')",
        _rows("overdue", "select * from dated where d < date '2024-02-01'", "d, id", "d"), _rows("today", "select * from dated where d = date '2024-02-01'", "d, id", "d"), _rows("upcoming", "select * from dated where d > date '2024-02-01' order by d, id limit 5", "d, id", "d"),
        _rows("news", _top(f"kind in ({NEWS}) and not starts_with(session, 'import-')", 10), "ts desc, id", "kind"),
    ])
)


@query(HUB)
def f_hub(s: Store) -> DataFrame:
    return reports.hub(s.base, s.ledger, _hidden(s), as_of(), rooms="user-1")


@query(f" select id, d as due, case when d < date '2024-02-14' then 'overdue' when d = date '2024-02-14' then 'today' else 'upcoming' end as state from {DATED.format('nodes')}")
def f_due_split(s: Store) -> DataFrame:
    return reports.due_split(s.base, F.lit("2024-02-14").cast("date"))


# Nodes with every kind, with resolutions that name others, and with the tags of workflows.
_KIND = "case when kind = 'idea' and seq % 5 = 0 then 'question' when kind = 'idea' and seq % 5 = 1 then 'hypothesis' when kind = 'open_item' and seq % 6 = 0 then 'blocker' when kind = 'conversation_turn' and seq % 8 = 3 then 'context_stamp' else kind end"
_TAGS = "case when seq % 97 = 0 then ['inbox'] when seq % 41 = 0 then ['parked'] when seq % 43 = 0 then ['research-queue'] else []::varchar[] end"
DESK_NODES = f", dn as (select * replace ({_KIND} as kind, case when kind = 'resolved' then 'answers e' || (seq * 7) || '.' else output_preview end as output_preview, list_concat(tags, {_TAGS}) as tags) from nodes)"
NAMED = r"\be[0-9]+\b"


def _desk_nodes(s: Store) -> DataFrame:
    more = F.when(F.expr("seq % 97 = 0"), F.array(F.lit("inbox"))).when(F.expr("seq % 41 = 0"), F.array(F.lit("parked"))).when(F.expr("seq % 43 = 0"), F.array(F.lit("research-queue"))).otherwise(F.array().cast("array<string>"))
    said = F.when(F.col("kind") == "resolved", F.concat(F.lit("answers e"), (F.col("seq") * 7).cast("string"), F.lit("."))).otherwise(F.col("output_preview"))
    return s.nodes.withColumns({"kind": F.expr(_KIND), "output_preview": said, "tags": F.concat("tags", more)})


TEND = f""", tl as (select *, {DUE} as dp from dn where {LIVE}), kids as (select distinct parent from dn where status = 'active' and parent is not null),
 e0 as (select id, importance, 0 as o, row_number() over (order by dp desc, id) as r, 'overdue review' as reason from (select * from tl where kind in ({MEANING}) and memory_tier <= 1 and {AGE} >= 3 order by dp desc, id limit 12)),
 e1 as (select id, importance, 1 as o, row_number() over (order by importance desc, neglect desc, unseen desc, id) as r, 'fading' as reason from (select id, importance, unseen, dp / importance as neglect from tl join (select node_id, count(*) as unseen from ledger where not cited group by 1 having count(*) >= 2) on node_id = id order by importance desc, neglect desc, unseen desc, id limit 8)),
 e2 as (select id, importance, 2 as o, row_number() over (order by ts, id) as r, 'loose thread' as reason from (select * from tl where kind in ('question', 'hypothesis') and id not in (select parent from kids) order by ts, id limit 8)),
 e3 as (select id, importance, 3 as o, row_number() over (order by dp desc, id) as r, 'from the deep' as reason from (select * from tl where kind in ('insight', 'decision', 'hypothesis') and importance >= 6 and {AGE} >= 3 order by dp desc, id limit 6)),
 found as (select * from (select * from e0 union all select * from e1 union all select * from e2 union all select * from e3) where id not in (select id from shown)),
 tend as (select id, string_agg(reason, ',' order by o) as reasons, row_number() over (order by count(*) desc, max(importance) desc, min(o), arg_min(r, o))::int as place from found group by id)"""


@query(DESK_NODES + ", shown as (select id from nodes where seq % 19 = 0)" + TEND + " select * from tend where place <= 12")
def f_tend(s: Store) -> DataFrame:
    return reports.tend(_desk_nodes(s), s.ledger, as_of(), s.base.where("seq % 19 = 0"))


LANES = HIDDEN + DESK_NODES + rf""", done as (select distinct unnest(regexp_extract_all(concat_ws(' ', query, output_preview), '{NAMED}')) as id from dn where status = 'active' and kind = 'resolved'),
 lv as (select *, list_filter(tags, lambda t: starts_with(t, 'due:'))[1][5:] as due from dn where {LIVE}), loops as (select * from lv where kind in ('open_item', 'blocker', 'question') order by importance desc, ts, id limit 60), watch as (select * from lv where kind = 'warning' or flagged order by ts desc, id limit 30),
 both_ as (select distinct id, kind, importance, ts, due from (select * from loops union all select * from watch)),
 lanes as (select *, case when kind in ('open_item', 'blocker') then case when due is null then 'open' else 'dated' end when kind = 'question' then case when due is not null then 'dated' end else 'watch' end as lane from both_ where id not in (select id from hidden) and id not in (select id from done)),
 w8 as (select * from lanes where lane = 'watch' order by ts desc, id limit 8), inbox as (select * from (select * from dn where status = 'active' and list_contains(tags, 'inbox') order by ts desc, id limit 30) where id not in (select id from hidden)),
 shown as (select id from lanes where lane <> 'watch' union select id from w8 union select id from inbox union select id from hidden union select id from done)"""


@query(LANES + TEND + " " + " union all ".join([
    _rows("dated", "select * from lanes where lane = 'dated'", "due, id", "due"), _rows("open", "select * from lanes where lane = 'open'", "importance desc, ts, id"), "select 'tend', place, id, reasons from tend where place <= 12", _rows("watch", "select * from w8", "ts desc, id"),
    _rows("inbox", "select * from inbox", "ts desc, id"), _rows("problems", "select 'flagged' as id, count(*) as n from nodes where status = 'active' and flagged union all select 'stale open items', 3", "id", "n"),
]))
def f_desk(s: Store) -> DataFrame:
    findings = s.spark.createDataFrame([("stale open items", 3)], "check string, n long")
    return reports.desk(_desk_nodes(s), s.ledger, _hidden(s), findings, as_of(), NAMED)


IDEAS = HIDDEN + DESK_NODES + f""", a as (select * from dn where status = 'active'), f as (select parent, count(*) as n from a where parent is not null group by 1),
 shelf as (select *, case when {DAYS.format('ts')} <= 14 then 'fresh' else 'bank' end as section from (select * from a where kind = 'idea' order by ts desc, id limit 100) union all select *, 'parked' from (select * from a where kind <> 'idea' and list_contains(tags, 'parked') order by ts desc, id limit 20)
 union all select *, 'queue' from (select * from a where kind = 'open_item' and list_contains(tags, 'research-queue') order by ts desc, id limit 20))
 select section, row_number() over (partition by section order by ts desc, s.id)::int as place, s.id, coalesce(n, 0) as findings, case when section in ('fresh', 'bank') then stability_days >= 2 and coalesce(n, 0) >= 1 end as ripe from shelf s left join f on f.parent = s.id where s.id not in (select id from hidden)"""


@query(IDEAS)
def f_ideas(s: Store) -> DataFrame:
    return reports.ideas(_desk_nodes(s), _hidden(s), as_of())


@query(HIDDEN + " select id, ts from (select * from nodes where status = 'active' and flagged order by ts desc, id limit 100) where id not in (select id from hidden)")
def f_flagged(s: Store) -> DataFrame:
    return reports.flagged(s.base, _hidden(s)).select("id", "ts")


@query(", own as (select * from nodes where status = 'active' and list_has_any(tags, ['proj-0', 'proj-2'])), p as (select * from own order by ts desc, id limit 200) " + " union all ".join([
    _rows("attention", "select * from p where kind in ('open_item', 'warning', 'blocker') or flagged order by ts desc, id limit 12", "ts desc, id"), _rows("decisions", "select * from p where kind = 'decision' order by ts desc, id limit 10", "ts desc, id"), _rows("procedures", "select * from p where kind = 'procedure' order by ts desc, id limit 10", "ts desc, id"),
    _rows("knowledge", "select * from p where kind in ('insight', 'hypothesis') order by ts desc, id limit 10", "ts desc, id"), _rows("recent", "select * from p where kind not in ('tool_call', 'interrupt') order by ts desc, id limit 10", "ts desc, id"),
    "select 'stats', 1, 'stats', concat_ws(' ', count(*), count(distinct session), strftime(min(ts), '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S')) from own",
]))
def f_project(s: Store) -> DataFrame:
    return reports.project_detail(s.base, ["proj-0", "proj-2"])


_INDEX = ", ix as (select * replace (case seq % 40 when 0 then 'artifact' when 1 then 'term' when 2 then 'procedure' else kind end as kind, case seq % 40 when 0 then 'DOC: ' || query when 1 then query || ': the ' || seq when 2 then '[consolidated x3] [consolidated x' || (seq % 9) || ' of many] ' || query else query end as query, case seq % 40 when 0 then ['file:/d/' || seq, 'made:hand'] when 2 then ['consolidated'] else tags end as tags) from nodes)"


@query(HIDDEN + _INDEX + f""", a as (select * from ix where status = 'active'), t as (select unnest(tags) as tag from a), tops as (select split_part(community, '|', 1) as cid, split_part(community, '|', 2) as label, count(*) as total, count(*) filter (where list_contains(tags, 'prov:distilled')) as d from a group by 1, 2)
 select 'tags' as section, row_number() over (order by lower(label), label)::int as place, label, note from (select tag as label, count(*)::varchar as note from t where not regexp_matches(tag, '^(entity:|kw:|due:|prov:|file:|made:)') group by 1 having count(*) >= 2)
 union all select 'docs', row_number() over (order by query, id)::int, query[6:], tags[1][6:] from a where kind = 'artifact' union all select 'terms', row_number() over (order by query, id)::int, split_part(query, ':', 1), trim(query[strpos(query, ':') + 1:]) from a where kind = 'term'
 union all select 'topics', row_number() over (order by total desc, cid)::int, label, total::varchar from tops where not regexp_matches(label, '^\\d+$') and label not in ('', 'unlabeled') and not (total >= 20 and d / total > 0.8)
 union all select 'consolidated', row_number() over (order by ts desc, id)::int, '[consolidated x' || greatest(3, seq % 9) || '] ' || regexp_replace(query, '\\[[^\\]]*\\]\\s*', '', 'g'), id from (select * from a where kind in ('insight', 'procedure') and list_contains(tags, 'consolidated') order by ts desc, id limit 200) where id not in (select id from hidden)""".replace("\\\\", "\\"))
def f_index(s: Store) -> DataFrame:
    n = F.col("seq") % 40
    text = F.when(n == 0, F.concat(F.lit("DOC: "), "query")).when(n == 1, F.concat("query", F.lit(": the "), F.col("seq").cast("string"))).when(n == 2, F.concat(F.lit("[consolidated x3] [consolidated x"), (F.col("seq") % 9).cast("string"), F.lit(" of many] "), "query")).otherwise(F.col("query"))
    tags = F.when(n == 0, F.array(F.concat(F.lit("file:/d/"), F.col("seq").cast("string")), F.lit("made:hand"))).when(n == 2, F.array(F.lit("consolidated"))).otherwise(F.col("tags"))
    rows = s.base.withColumns({"kind": F.when(n == 0, "artifact").when(n == 1, "term").when(n == 2, "procedure").otherwise(F.col("kind")), "query": text, "tags": tags})
    return reports.index(rows, _hidden(s))


PROJECTS = {"proj-0": ("the first", ["proj-2"]), "proj-1": ("the second", []), "proj-9": ("no one's", [])}
_CHAPTER = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in compiled.CHAPTERS.items()) + " end"
BOOK = SPELLED + f""", a as (select * from spelt where status = 'active'), w as (select * from a where kind in ({MEANING}) and kind <> 'warning' and {AGE} <= 7 order by importance desc, ts desc, id limit 10),
 pr as (select distinct id, kind, importance, ts, query, case t when 'proj-0' then 'proj-0' when 'proj-2' then 'proj-0' when 'proj-1' then 'proj-1' end as project from (select *, unnest(tags) as t from a) where t in ('proj-0', 'proj-1', 'proj-2')),
 wh as (select project, count(*) as total, row_number() over (order by max(ts) filter (where kind <> 'tool_call') desc nulls last, project) as p from pr group by 1),
 kn as (select * from (select project, kind, count(*) as n, row_number() over (partition by project order by count(*) desc, kind) as k from pr where kind in ({MEANING}) and kind <> 'warning' group by 1, 2) where k <= 5),
 ln as (select p as x, 0 as y, 0 as z, '## ' || project || ' - ' || case project when 'proj-0' then 'the first' else 'the second' end || '  (' || total || ' nodes)' as line from wh union all select p, k, 0, '### ' || {_CHAPTER} || '  (' || n || ')' from kn join wh using (project)
  union all select p, k, r, '- ' || left(query, 84) || '  `' || id || '`' from (select *, row_number() over (partition by project, kind order by importance desc, ts desc, id) as r from pr) join kn using (project, kind) join wh using (project) where r <= 2),
 fam as (select *, {family_sql('tag')} as family from (select id, session, ts, unnest(tags) as tag from a) where not regexp_matches(tag, '{MACHINE}') and tag not in ({IGNORED}, 'proj-0', 'proj-1', 'proj-2')),
 big as (select family, count(distinct id) as n, max(ts) as last_ts, (select tag from fam v where v.family = u.family group by tag order by count(*) desc, tag desc limit 1) as display from fam u group by family having count(distinct id) >= 6 and count(distinct session) >= 2 and count(distinct ts::date) >= 2 order by last_ts desc, family limit 12),
 vol as (select coalesce(account, 'unlabeled') as account, count(distinct n.session) as s, count(*) as n, min(ts) as x, max(ts) as y from nodes n join sessions s on s.id = n.session where status <> 'void' and starts_with(n.session, 'import-') group by 1)
 select '1 week' as o, row_number() over (order by importance desc, ts desc, id)::int as place, '- [' || kind || '] ' || left(query, 90) || '  `' || id || '`' as line from w union all select '2 projects', row_number() over (order by x, y, z)::int, line from ln
 union all select '3 others', row_number() over (order by last_ts desc, family)::int, '- ' || display || ': ' || n || ' nodes' from big
 union all select '4 volumes', row_number() over (order by n desc, account)::int, '- ' || account || ': ' || s || ' convos, ' || n || ' turns (' || strftime(x, '%Y-%m-%d') || ' -> ' || strftime(y, '%Y-%m-%d') || ')' from vol"""


@query(BOOK)
def f_book(s: Store) -> DataFrame:
    return compiled.book(spelled(s.base), s.sessions, PROJECTS, as_of())


PAGE = f""", a as (select * from nodes where status = 'active'), own as (select * from a where {AGE} <= 14 and session in (select id from sessions where lower(account) = 'ann')),
 c as (select * from (values (1, 'proj-0', 'the first'), (2, 'proj-1', 'the second'), (3, 'proj-9', 'no one''s')) v(i, name, about), lateral (select count(*) as n from own where list_contains(tags, name)))
 select '1 store' as o, 1 as place, 'STORE: ' || format('{{:,}}', count(*) filter (where status = 'active')) || ' memories · ' || format('{{:,}}', count(distinct session)) || ' sessions' as line from nodes
 union all select '2 active', i, '  ' || name || ' - ' || about || ' (' || n || ' nodes/14d)' from c where n > 0 union all select '3 dormant', 1, 'DORMANT: ' || string_agg(name, ', ' order by i) from c where n = 0 having count(*) > 0
 union all select '4 warnings', row_number() over (order by importance desc, ts desc, id)::int, '  - ' || left(query, 100) from (select * from a where kind = 'warning' order by importance desc, ts desc, id limit 3)"""


@query(PAGE)
def f_page_one(s: Store) -> DataFrame:
    return compiled.page_one(s.base, s.sessions, PROJECTS, as_of(), "ANN")


COUNTS = DESK_NODES + """, rp as (select distinct session, parent as id from dn where status <> 'void' and parent is not null), sc as (select n.session, count(*) as nodes, count(*) filter (where kind = 'conversation_turn') as turns, count(*) filter (where kind = 'context_stamp') as stamps, count(rp.id) as threads,
 count(*) filter (where coalesce(latency_ms > 800, false) or coalesce(result_count <= 1, false)) as struggles, count(*) filter (where flagged) as flagged, count(*) filter (where kind = 'decision') as decisions, count(*) filter (where kind in ('question', 'open_item')) as questions,
 count(*) filter (where kind in ('question', 'open_item') and status = 'active') as open_questions from dn n left join rp on rp.id = n.id and rp.session = n.session where n.status <> 'void' group by n.session)"""


@query(COUNTS + " select * from sc")
def f_session_counts(s: Store) -> DataFrame:
    return compiled.session_counts(_desk_nodes(s))


@query(COUNTS + ", lastp as (select session, lag(session) over (order by t, session) as previous from (select session, max(ts) as t from nodes group by session)) select a.session, previous, a.nodes, b.nodes as before, a.nodes - coalesce(b.nodes, 0) as delta from sc a join lastp using (session) left join sc b on b.session = previous")
def f_session_delta(s: Store) -> DataFrame:
    return compiled.session_deltas(compiled.session_counts(_desk_nodes(s)), s.base.select("session", F.col("ts").alias("at")))


def _part(i: int, section: str, source: str, order: str, line: str) -> str:
    return f"select {i} as part, '{section}' as section, row_number() over (order by {order})::int as place, id::varchar as id, {line} as line from ({source})"


_MARK, _MODEL = "'  `' || id || '`'", "case when model <> 'unknown' then ' [' || model || ']' else '' end"
_WHY = "concat_ws(', ', case when latency_ms > 800 then latency_ms || 'ms' end, case when result_count <= 1 then result_count || case when result_count = 1 then ' result' else ' results' end end)"
_HARD = "coalesce(latency_ms > 800, false) or coalesce(result_count <= 1, false)"
REPORT = DESK_NODES + ", ow as (select * from dn where session = 'user-12' and status <> 'void'), op as (select * from dn where session = 'user-11' and status <> 'void'), mo as (select model as id, count(*) as n, count(*) filter (where coalesce(latency_ms > 800, false) or coalesce(result_count = 1, false)) as st, count(*) filter (where flagged) as fl, arg_min(agent_role, (ts, id)) as role, count(*) over () as models from ow where model <> 'unknown' group by model) " + " union all ".join([
    _part(0, "stamps", "select * from ow where kind = 'context_stamp'", "ts, id", f"'**' || strftime(ts, '%Y-%m-%d %H:%M') || '** — ' || coalesce(nullif(output_preview, ''), query) || {_MARK}"),
    _part(1, "user intent", "select * from ow where kind = 'conversation_turn' and speaker = 'user' order by ts desc, id desc limit 10", "ts, id", f"query || {_MARK}"), _part(2, "agent conclusions", "select * from ow where kind = 'conversation_turn' and speaker <> 'user' order by ts desc, id desc limit 8", "ts, id", f"query || {_MARK}"),
    _part(3, "decisions", "select * from ow where kind = 'decision'", "ts, id", f"query || {_MODEL} || {_MARK}"), _part(4, "open questions", "select * from ow where kind = 'question' and status = 'active'", "ts, id", f"'? ' || query || {_MARK}"),
    _part(5, "blockers", "select * from ow where kind = 'blocker' and status = 'active'", "ts, id", f"'⛔ ' || query || {_MARK}"), _part(6, "tasks", "select * from ow where kind = 'open_item' and status = 'active'", "ts, id", f"'📌 ' || query || {_MARK}"),
    _part(7, "resolved", "select * from ow where kind = 'resolved'", "ts, id", f"'✓ ' || query || {_MARK}"),
    _part(8, "path", "select * from ow where kind = 'tool_call' and tool <> '' order by ts, id limit 50", "ts, id", f"'`' || tool || '`' || {_MODEL} || case when agent_role <> 'worker' then ' (' || agent_role || ')' else '' end || '  ' || left(query, 90) || coalesce(' → ' || result_count, '') || case when latency_ms > 0 then ' [' || latency_ms || 'ms]' else '' end || case when flagged then ' 🚩' else '' end || {_MARK}"),
    _part(9, "threads", "select * from ow where id in (select parent from ow where parent is not null)", "ts, id", f"'**`' || id || '`** `' || kind || '`' || {_MODEL} || ' — ' || coalesce(nullif(output_preview, ''), query)"),
    _part(10, "hard points", f"select * from ow where {_HARD}", "ts, id", f"'`' || id || '` `' || coalesce(tool, kind) || '`' || {_MODEL} || '  ' || left(query, 80) || '  — ' || {_WHY}"),
    _part(11, "insights", "select * from ow where kind in ('insight', 'hypothesis', 'warning')", "case when kind = 'warning' then 1 else 0 end, ts, id", f"case when kind = 'warning' then '⚠️' else '💡' end || ' `' || kind || '` ' || query || {_MARK}"),
    _part(12, "models", "select * from mo where models > 1", "n desc, id", "'`' || id || '`' || case when role <> 'worker' then ' [' || role || ']' else '' end || ': ' || n || ' nodes' || case when st > 0 then ' | ' || st || ' struggles (' || round(st * 100.0 / n)::int || '%)' else '' end || case when fl > 0 then ' | ' || fl || ' flagged' else '' end"),
    _part(13, "previous decisions", "select * from op where kind = 'decision'", "ts, id", "query"), _part(14, "previous open items", "select * from op where kind in ('question', 'blocker', 'open_item') and status = 'active'", "case kind when 'question' then 0 when 'blocker' then 1 else 2 end, ts, id", "case when kind = 'blocker' then '⛔ ' else '' end || query"),
    _part(15, "flagged", "select * from ow where flagged", "ts, id", "'`' || id || '` — ' || query"),
])


@query(REPORT)
def f_session_report(s: Store) -> DataFrame:
    return compiled.session_report(_desk_nodes(s), "user-12", "user-11")


DIGEST = REPORT.replace(DESK_NODES + ", ow as", DESK_NODES + ", ow as", 1)


@query(DIGEST.replace(" select 0 as part", ", rep as (select 0 as part", 1) + r"""), g as (select *, case when section = 'decisions' then 'decisions' when section in ('open questions', 'blockers', 'tasks', 'resolved') then 'open items' when section = 'hard points' then 'hard points' when starts_with(section, 'previous') then 'previous' when section = 'insights' then 'insights' end as g from rep)
 select g as section, r::int as place, left(regexp_replace(regexp_replace(line, '\s*`[0-9A-Za-z]{1,12}`\s*$', ''), '^`[0-9A-Za-z]{1,12}`\s*', ''), 160) as line from (select *, row_number() over (partition by g order by part, place) as r from g where g is not null) where r <= case g when 'decisions' then 20 when 'open items' then 15 when 'hard points' then 10 else 8 end""")
def f_digest(s: Store) -> DataFrame:
    return views.digest_lines(compiled.session_report(_desk_nodes(s), "user-12", "user-11"))


def _audit_rows(s: Store) -> DataFrame:
    return s.spark.createDataFrame([("stale", 2, None), ("dates", 3, "x"), ("new", 1, None)], "check string, n long, detail string")


@query(" select 'dates' as check, 3::bigint as n, 'x' as detail union all select 'new', 1, null")
def f_fresh_findings(s: Store) -> DataFrame:
    last = s.spark.createDataFrame([("stale", 2, None), ("dates", 1, "x")], "check string, n long, detail string")
    return reports.fresh_findings(_audit_rows(s), last)


REGISTRY = ", reg as (select 'p' || (seq % 5) as slug, arg_max(['blessed', 'proposed', 'archived'][seq % 3 + 1], (ts, id)) as status, arg_max((seq % 50)::int, (ts, id)) as evidence from nodes where status = 'active' group by 1)"


def _registry(s: Store) -> DataFrame:
    blob = F.to_json(F.struct(F.concat(F.lit("p"), (F.col("seq") % 5).cast("string")).alias("slug"), F.expr("element_at(array('blessed', 'proposed', 'archived'), cast(seq % 3 + 1 as int))").alias("status"), (F.col("seq") % 50).cast("int").alias("evidence")))
    rows = s.base.withColumns({"query": F.concat(F.lit("row "), blob, F.lit(" end")), "tags": F.array(F.lit("registry-row"))})
    return reports.registry_fold(rows)


@query(REGISTRY + " select * from reg")
def f_registry_fold(s: Store) -> DataFrame:
    return reports.finish_lines(_registry(s)).select("slug", "status", "evidence")


@query(REGISTRY + ", pro as (select 'p' || (seq % 8) as slug, (seq % 50)::int as evidence, 'P ' || (seq % 8) as name from nodes where seq % 8 <> 6 or seq % 3 = 0), best as (select slug, max(evidence) as evidence from pro where slug not in (select slug from reg) and slug <> 'p7' group by 1) select slug, 'REGISTRY ' || slug || ' — proposed — ' || upper(slug) || '! (' || evidence || ' notes) — seen' as line from best")
def f_registry_propose(s: Store) -> DataFrame:
    proposals = s.base.where("seq % 8 <> 6 or seq % 3 = 0").select(F.concat(F.lit("P"), (F.col("seq") % 8).cast("string"), F.lit("!")).alias("name"), F.array(F.lit("x")).alias("aliases"), (F.col("seq") % 50).cast("int").alias("evidence"), F.lit("seen").alias("why"))
    return reports.registry_propose(_registry(s), proposals, ["p7"], as_of()).select("slug", "line")


@query(REGISTRY + ", act as (select 'p' || (seq % 7) as slug, arg_max(['bless', 'pass', 'archive', 'revive'][seq % 4 + 1], (ts, ['bless', 'pass', 'archive', 'revive'][seq % 4 + 1])) as action from nodes group by 1) select slug, 'REGISTRY ' || slug || ' — ' || case action when 'bless' then 'blessed' when 'pass' then 'passed' when 'archive' then 'archived' else 'revived' end || ' by human — as said' as line from reg join act using (slug)")
def f_registry_act(s: Store) -> DataFrame:
    actions = s.base.select(F.concat(F.lit("p"), (F.col("seq") % 7).cast("string")).alias("slug"), F.expr("element_at(array('bless', 'pass', 'archive', 'revive'), cast(seq % 4 + 1 as int))").alias("action"), F.lit("as said").alias("reason"), F.lit("human").alias("by"), F.col("ts").alias("at"))
    return reports.registry_act(_registry(s), actions).select("slug", "line")


@query(f" select tag, max(ts) as last_ts from (select ts, unnest(tags) as tag from nodes where status = 'active') where tag in ('proj-0', 'proj-2', 'backfill') group by tag having {DAYS.format('max(ts)')} >= 1")
def f_dormant(s: Store) -> DataFrame:
    return reports.dormant_projects(s.base, ["proj-0", "proj-2", "backfill"], as_of(), days=1)


PROOF = ", proof as (select id, case when n % 2 = 0 then lower(account) else 'other' end as slug from (select *, regexp_extract(id, '(\\d+)$', 1)::bigint as n from sessions) where n % 5 <> 1)"


def _proof(s: Store) -> DataFrame:
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    return s.sessions.where(n % 5 != 1).select("id", F.when(n % 2 == 0, F.lower("account")).otherwise("other").alias("slug"))


@query(PROOF + ", j as (select s.id, account, account_locked, slug from sessions s left join proof using (id) where account is not null) select class, count(*) as sessions from (select 'unprovable' as class from j where not starts_with(id, 'user-') union all select case when slug is null then 'uncovered' else 'covered' end from j where starts_with(id, 'user-') union all select case when lower(slug) = lower(account) then 'agree' else 'mismatch' end from j where starts_with(id, 'user-') and slug is not null union all select 'locked' from j where starts_with(id, 'user-') and account_locked) group by 1")
def f_account_doctor(s: Store) -> DataFrame:
    return reports.account_doctor(s.sessions, _proof(s), provable="^user-")


@query(PROOF + " select case when starts_with(id, 'import-') then 'imports' when id = 'user-12' then 'canary' when slug is null then 'leave' when coalesce(lower(slug) = lower(account), false) then 'agree' else 'repair' end as class, count(*) as sessions from sessions left join proof using (id) group by 1")
def f_account_backfill(s: Store) -> DataFrame:
    return reports.account_backfill(s.sessions, _proof(s), ["user-12"])


@query(" select seq, case when seq % 3 = 0 then '[consolidated x7] ' || query when seq % 3 = 1 then '[consolidated x4] ' || query else query end as shown from nodes")
def f_consolidated_label(s: Store) -> DataFrame:
    head = F.expr("case when seq % 3 = 0 then '[consolidated x3 across 2 sessions] [consolidated x7] ' when seq % 3 = 1 then '[consolidated x4 across 1 sessions] ' else '' end")
    return s.base.select("seq", reports.consolidated_label(F.concat(head, "query")).alias("shown"))


@query(" select split_part(query, ': ', 1) as term, id from (select id, lower(query) as query from (select id, case when seq % 3 = 0 then query || ': and more' else query end as query, kind, status from nodes) where status = 'active' and kind in ('insight', 'decision') and regexp_matches(query, '^[A-Za-z][A-Za-z0-9 _-]{1,40}: \\S'))".replace("\\\\", "\\"))
def f_definitions(s: Store) -> DataFrame:
    return reports.definitions(s.base.withColumn("query", F.when(F.col("seq") % 3 == 0, F.concat("query", F.lit(": and more"))).otherwise(F.col("query"))))


@query(" select id, case when seq % 50 = 0 then 1 else 0 end as stands from nodes where status = 'active' and (seq % 50 = 0 or id in (select 'e' || (seq + i) from nodes, (values (1), (2)) v(i) where seq % 50 = 0 and status = 'active' and kind = 'insight'))")
def f_absorbed(s: Store) -> DataFrame:
    from ..operators.dynamics import absorbed

    rows = _consolidated(s)
    gone = absorbed(rows)
    named = active(rows).join(gone, "id", "left_semi").select("id", F.when(F.col("seq") % 50 == 0, 1).otherwise(0).alias("stands"))
    return active(rows).where("seq % 50 = 0").select("id", F.lit(1).alias("stands")).unionByName(named).distinct()
