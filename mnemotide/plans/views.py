"""Catalogue: views of single nodes, projects and days, and small writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MEANING_KINDS, Store, active, as_of
from ..operators import graph, rollups, views
from .memory import DAYS, DUE, KNN, PAIRS, _semantic
from .registry import query

MEANING = ", ".join(f"'{k}'" for k in MEANING_KINDS)


@query(", k as (select parent, id, row_number() over (partition by parent order by ts, id) as r from nodes where status = 'active' and parent is not null) select n.id, n.parent as previous, coalesce((select string_agg(id, ',' order by r) from k where k.parent = n.id and r <= 3), '') as next from nodes n")
def n_thread(s: Store) -> DataFrame:
    return views.thread(s.nodes)


@query(" select session, lag(session) over (order by t, session) as previous from (select session, max(ts) as t from nodes group by session)")
def n_previous_session(s: Store) -> DataFrame:
    return views.previous_sessions(s.base.select("session", F.col("ts").alias("at")))


@query(f" select id, importance from nodes where status = 'active' order by case when kind in ({MEANING}) then 0 else 1 end, importance desc, ts desc, id limit 900")
def p_cross_view(s: Store) -> DataFrame:
    return views.cross_view(s.base).select("id", "importance")


@query(PAIRS + KNN + " select case when src = 'e0' then dst when dst = 'e0' then src end as other, type, tier, weight from semantic where src = 'e0' or dst = 'e0' order by case tier when 'strong' then 0 when 'medium' then 1 else 2 end, weight desc, other, type limit 40".replace("'e0'", "'e7'"))
def g_strongest(s: Store) -> DataFrame:
    return views.strongest(_semantic(s), "e7")


@query(" select n.id, concat_ws('/', account, harness) as origin from nodes n left join sessions s on s.id = n.session where n.kind = 'decision'")
def r_provenance(s: Store) -> DataFrame:
    return views.provenance(s.base.where("kind = 'decision'").select("id", "session"), s.sessions).select("id", "origin")


@query(" select p.id as src, c.id as dst from nodes c join nodes p on c.parent = p.id where c.status = 'active' and p.status = 'active' and c.importance >= 6 and p.importance >= 6")
def g_payload(s: Store) -> DataFrame:
    return views.graph_payload(s.base.where("importance >= 6"), graph.chain_edges(s.nodes)).select("src", "dst")


def _points(s: Store) -> DataFrame:
    return s.base.select("id", "ts", F.substring_index("community", "|", 1).alias("cid"), F.col("session").alias("galaxy"), (F.col("seq") % 100).cast("double").alias("map_x"), (F.col("seq") % 37).cast("double").alias("map_y"))


POINTS = ", p as (select id, ts, split_part(community, '|', 1) as cid, session as galaxy, (seq % 100)::double as map_x, (seq % 37)::double as map_y from nodes)"


@query(POINTS + " select cid, count(*) as n, round(avg(map_x), 6) as x, round(avg(map_y), 6) as y from p group by cid order by n desc, cid limit 80")
def a_centroids(s: Store) -> DataFrame:
    return rollups.centroids(_points(s)).select("cid", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(POINTS + ", c as (select galaxy, avg(map_x) as x, avg(map_y) as y from p group by galaxy) select galaxy, round(x, 6) as x, round(y, 6) as y, round(greatest(20, max(sqrt(pow(map_x - x, 2) + pow(map_y - y, 2)))), 6) as body from p join c using (galaxy) group by galaxy, x, y")
def a_galaxy_bodies(s: Store) -> DataFrame:
    return views.galaxy_bodies(_points(s), floor=20.0).select("galaxy", *[F.round(c, 6).alias(c) for c in ("x", "y", "body")])


@query(", m as (select split_part(community, '|', 1) as cid, min(id) as seed from nodes group by 1) select cid, seed, case when right(cid, 1) in ('1', '3') then length(cid) + right(cid, 1)::int else (select max(length(cid) + right(cid, 1)::int) from m where right(cid, 1) in ('1', '3')) + row_number() over (partition by right(cid, 1) in ('1', '3') order by cid) end::int as born from m")
def g_stable_places(s: Store) -> DataFrame:
    members = s.base.select("id", F.substring_index("community", "|", 1).alias("cid"))
    last = F.substring("cid", -1, 1)
    known = members.groupBy("cid").agg(F.min("id").alias("seed")).where(last.isin("1", "3")).select("seed", (F.length("cid") + last.cast("int")).alias("born"))
    return views.stable_places(members, known)


@query(
    ", own as (select *, case when kind = 'procedure' or stability_days >= 30 then 'evergreen' when stability_days >= 3 then 'budding' else 'seedling' end as m from nodes where status = 'active' and list_has_any(tags, ['proj-0', 'proj-2']))"
    " select count(*) as nodes, count(*) filter (where kind = 'open_item') as open_items, count(*) filter (where kind = 'decision') as decisions, count(*) filter (where kind = 'procedure') as procedures, count(*) filter (where kind = 'warning') as warnings,"
    " count(*) filter (where m = 'seedling') as seedling, count(*) filter (where m = 'budding') as budding, count(*) filter (where m = 'evergreen') as evergreen,"
    " (select string_agg(k, ',' order by k) from (select kind || '=' || count(*) as k from own group by kind)) as kinds, max(ts) filter (where kind <> 'tool_call') as last_ts, arg_max(left(query, 80), (ts, id)) filter (where kind <> 'tool_call') as last_said from own"
)
def a_project_rollup(s: Store) -> DataFrame:
    return views.project_rollup(s.base, "proj-0", ("proj-2",))


@query(", t as (select tag, count(*) as total, max(ts) as last_ts from (select ts, unnest(tags) as tag from nodes where status = 'active') group by tag) select * from t where not starts_with(tag, 'entity:') or tag < 'entity:m'")
def a_dismissed(s: Store) -> DataFrame:
    rollup = active(s.base).select("ts", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("total"), F.max("ts").alias("last_ts"))
    gone = rollup.where("startswith(tag, 'entity:')").select("tag", (F.col("total") - F.when(F.col("tag") < "entity:m", 1).otherwise(0)).alias("total"), "last_ts")
    return views.not_dismissed(rollup, gone)


@query(" select kind, case when kind = 'conversation_turn' then least(count(*), 99) else count(*) end as nodes from nodes where status = 'active' and ts > timestamp '2024-01-20 12:00:00' group by kind")
def f_since_visit(s: Store) -> DataFrame:
    return views.since_visit(s.base, F.lit("2024-01-20 12:00:00").cast("timestamp"))


@query(f" select id, importance from nodes where status = 'active' and kind in ({MEANING}) and kind <> 'warning' and {DAYS.format('ts')} between 0 and 7 order by importance desc, ts desc, id limit 12")
def f_book_week(s: Store) -> DataFrame:
    return views.book_week(s.base, as_of()).select("id", "importance")


@query(" select id from nodes where status = 'active' and split_part(community, '|', 1) = 'c2' order by importance desc, ts desc, id limit 120")
def f_topic_members(s: Store) -> DataFrame:
    return views.topic_members(s.base, "c2").select("id")


@query(" select id, ts + interval 1 day as archived_at from nodes where status <> 'void' and seq % 19 = 0")
def f_archived(s: Store) -> DataFrame:
    drawer = s.base.where("seq % 19 = 0").select("id", (F.col("ts") + F.expr("interval 1 day")).alias("archived_at"))
    return views.archived_drawer(s.base, drawer).select("id", "archived_at")


@query(" select id, 'f' || (seq % 5) as path, case when seq % 2 = 0 then 'hand' end as made from nodes where status = 'active'")
def f_doc_cards(s: Store) -> DataFrame:
    tags = F.array_compact(F.array(F.concat(F.lit("file:f"), (F.col("seq") % 5).cast("string")), F.when(F.col("seq") % 2 == 0, "made:hand")))
    return views.doc_cards(s.base.withColumns({"kind": F.lit("artifact"), "tags": tags}))


@query(f" select count(*) filter (where kind = 'open_item') as open, count(*) filter (where flagged) as flagged, count(*) filter (where kind = 'idea') as ideas, count(*) filter (where {DUE} >= 6 * importance) as due from nodes where status = 'active'")
def f_router_counts(s: Store) -> DataFrame:
    return views.router_counts(s.base, as_of())


@query(" select node_id, case when action = 'undo' then 'open' else action end as state from (select node_id, arg_max(['done', 'undo', 'parked'][seq % 3 + 1], (shown_at, ['done', 'undo', 'parked'][seq % 3 + 1])) as action from ledger group by node_id)")
def f_workflow_state(s: Store) -> DataFrame:
    events = s.ledger.select("node_id", F.expr("element_at(array('done', 'undo', 'parked'), cast(seq % 3 + 1 as int))").alias("action"), F.col("shown_at").alias("at"))
    return views.workflow_state(events)


@query(" select id, left(text, 30) as query, left(text, 80) as output_preview, case when length(text) > 80 then text end as episodic_full from turns")
def w_turn_writer(s: Store) -> DataFrame:
    return views.write_turn(s.turns.drop("query"), 30, 80).select("id", "query", "output_preview", "episodic_full")


@query(", a as (select id, seq % 7 as f, ts from nodes where status = 'active' and seq % 3 = 0), o as (select id from (select id, row_number() over (partition by f order by ts desc, id desc) as r from a) where r > 1) select id, 'void' as value from (select id from o union select 'e' || (seq + 1) from nodes where status = 'active' and seq % 100 = 0 and seq % 3 <> 0)")
def w_supersede(s: Store) -> DataFrame:
    n = F.col("seq")
    tags = F.when(n % 3 == 0, F.array(F.concat(F.lit("file:"), (n % 7).cast("string")))).when(n % 100 == 0, F.array(F.concat(F.lit("supersedes:e"), (n + 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = s.base.withColumns({"tags": tags, "kind": F.when(n % 3 == 0, "artifact").otherwise(F.col("kind"))})
    return views.superseded(rows, as_of()).select("id", "value")
