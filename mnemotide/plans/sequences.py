"""Catalogue: text transforms, windows and batch forms of streaming triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import attribution as at
from ..functions import text as t
from ..model import Store, importance_of
from ..operators import dynamics
from ..operators import windows as w
from ..scratch import Scratch
from .registry import query


def _with_secrets(s: Store) -> DataFrame:
    """Documents with secrets put in by number; their own text has none of these shapes."""
    d = F.col("doc_id") % 8
    secret = (
        F.when(d == 0, F.concat(F.lit(" AKIA"), F.lpad(F.col("doc_id").cast("string"), 16, "0"), F.lit(" ")))
        .when(d == 1, F.concat(F.lit(" sk-ant-"), F.repeat(F.lit("a1"), 10), F.lit(" and sk-"), F.repeat(F.lit("b2"), 9)))
        .when(d == 2, F.lit(" password: 'hunter2hunter2' "))
        .when(d == 3, F.lit(" Authorization: Bearer abcdef.ghijkl-mnop "))
        .when(d == 4, F.lit(" postgres://u:p@db.test/x "))
        .when(d == 5, F.concat(F.lit(" ghp_"), F.repeat(F.lit("Zz9"), 12), F.lit(" ")))
        .otherwise(" api_key = none ")
    )
    return s.table("documents").select("doc_id", F.concat("text", secret).alias("text"))


SECRETS_SQL = """, secrets as (select doc_id, text || case doc_id % 8 when 0 then ' AKIA' || lpad(doc_id::varchar, 16, '0') || ' ' when 1 then ' sk-ant-' || repeat('a1', 10) || ' and sk-' || repeat('b2', 9)
 when 2 then ' password: ''hunter2hunter2'' ' when 3 then ' Authorization: Bearer abcdef.ghijkl-mnop ' when 4 then ' postgres://u:p@db.test/x ' when 5 then ' ghp_' || repeat('Zz9', 12) || ' ' else ' api_key = none ' end as text from documents)"""


def _sql_redacted() -> str:
    out, steps = "r0 as (select doc_id, text, 0 as hits from secrets)", []
    for i, (pattern, label) in enumerate(t.SECRETS):
        p = pattern.replace("'", "''")
        steps.append(f"r{i + 1} as (select doc_id, regexp_replace(text, '{p}', '[REDACTED:{label}]', 'g') as text, hits + len(regexp_extract_all(text, '{p}')) as hits from r{i})")
    n = len(t.SECRETS)
    p = t.ASSIGNMENT.replace("'", "''")
    steps.append(f"r{n + 1} as (select doc_id, regexp_replace(text, '{p}', '\\1[REDACTED:SECRET_ASSIGN]', 'g') as text, hits + len(regexp_extract_all(text, '{p}')) as hits from r{n})")
    return SECRETS_SQL + ", " + ", ".join([out, *steps]) + f" select doc_id, md5(text) as digest, hits::int as hits from r{n + 1}"


@query(_sql_redacted())
def w_redact_named(s: Store) -> DataFrame:
    return t.redact_named(_with_secrets(s), "text").select("doc_id", F.md5("text").alias("digest"), "hits")


@query(f", a as (select seq, 'set ' || ['password', 'my_password', 'API-KEY', 'token', 'secret'][seq % 5 + 1] || [' = ', ': ''', '='][seq % 3 + 1] || repeat('k', (seq % 12)::int) || ''' now' as text from nodes) select seq, regexp_replace(text, '{t.ASSIGNMENT.replace(chr(39), chr(39) * 2)}', '\\1[REDACTED:SECRET_ASSIGN]', 'g') as text from a")
def w_redact_assign(s: Store) -> DataFrame:
    n = F.col("seq")
    key = F.expr("element_at(array('password', 'my_password', 'API-KEY', 'token', 'secret'), cast(seq % 5 + 1 as int))")
    sep = F.expr("element_at(array(' = ', ': ''', '='), cast(seq % 3 + 1 as int))")
    text = F.concat(F.lit("set "), key, sep, F.repeat(F.lit("k"), (n % 12).cast("int")), F.lit("' now"))
    return s.base.select("seq", F.regexp_replace(text, t.ASSIGNMENT, "$1[REDACTED:SECRET_ASSIGN]").alias("text"))


ENTROPY_SQL = r""", d as (select doc_id, text || case when doc_id % 4 = 0 then ' Ab1' || md5(doc_id::varchar) || 'Zq9xWv7' || md5((doc_id * 3)::varchar) else ' ' || md5(doc_id::varchar) end as text from documents),
runs as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9_\-+/=]+|[^A-Za-z0-9_\-+/=]+') as r from d),
one as (select doc_id, i, r[i] as run from (select doc_id, r, unnest(range(1, len(r) + 1)) as i from runs)),
bits as (select *, length(run) >= 28 and regexp_matches(run, '[a-z]') and regexp_matches(run, '[A-Z]') and regexp_matches(run, '[0-9]') and
  list_sum(list_transform(list_distinct(string_split(run, '')), lambda c: case when c = '' then 0 else -(length(run) - length(replace(run, c, ''))) / length(run)::double * log2((length(run) - length(replace(run, c, ''))) / length(run)::double) end)) >= 3.5 as secret from one)
select doc_id, md5(string_agg(case when secret then '[REDACTED:HIGH_ENTROPY]' else run end, '' order by i)) as digest, count(*) filter (where secret) as hits from bits group by doc_id"""


@query(ENTROPY_SQL)
def w_redact_entropy(s: Store) -> DataFrame:
    d = F.col("doc_id")
    end = F.when(d % 4 == 0, F.concat(F.lit(" Ab1"), F.md5(d.cast("string")), F.lit("Zq9xWv7"), F.md5((d * 3).cast("string")))).otherwise(F.concat(F.lit(" "), F.md5(d.cast("string"))))
    masked, hits = t.redact_entropy("text")
    return s.table("documents").select("doc_id", F.concat("text", end).alias("text")).select("doc_id", F.md5(masked).alias("digest"), hits.cast("long").alias("hits"))


@query(" select kind, trust, flagged, min(importance) as low, max(importance) as high, count(*) as n from nodes group by 1, 2, 3")
def w_importance(s: Store) -> DataFrame:
    i = importance_of(F.col("kind"), F.col("trust"), F.col("flagged"))
    return s.base.groupBy("kind", "trust", "flagged").agg(F.min(i).alias("low"), F.max(i).alias("high"), F.count(F.lit(1)).alias("n"))


def _gist_sql() -> str:
    seps = [x.replace("'", "''") for x in t.SEPARATORS]
    def cut(x, pick):
        arms = " ".join(f"when instr({x}, '{s}') between 2 and 90 then " + (f"left({x}, instr({x}, '{s}') - 1)" if pick == "head" else f"ltrim(substr({x}, instr({x}, '{s}') + {len(s)}))") for s in seps)
        return f"(case {arms} else {x if pick == 'head' else chr(39) * 2} end)"
    openers = ", ".join("'" + o.replace("'", "''") + "'" for o in t.STATUS_OPENERS)
    return (
        ", src as (select doc_id, trim(replace(case doc_id % 4 when 0 then 'Done. OK — ' when 1 then 'on it; ' when 2 then 'Sure. ' else '' end || text, chr(10), ' ')) as s from documents),"
        f" peel as (select doc_id, s, 0 as step from src union all select doc_id, {cut('s', 'rest')}, step + 1 from peel where {cut('s', 'rest')} <> '' and lower(trim({cut('s', 'head')}, ' .,!?—-:;|')) in ({openers})),"
        f" last as (select doc_id, arg_max(s, step) as s from peel group by doc_id), w as (select doc_id, array_to_string(string_split(trim(regexp_replace({cut('s', 'head')}, '\\s+', ' ', 'g')), ' ')[1:14], ' ') as w from last)"
        " select doc_id, case when length(w) <= 110 then w when instr(reverse(left(w, 110)), ' ') > 0 and 110 - instr(reverse(left(w, 110)), ' ') > 40 then left(w, 110 - instr(reverse(left(w, 110)), ' ')) || ' …' else left(w, 110) || ' …' end as gist from w"
    )


@query(_gist_sql())
def w_gist(s: Store) -> DataFrame:
    opening = F.expr("case doc_id % 4 when 0 then 'Done. OK — ' when 1 then 'on it; ' when 2 then 'Sure. ' else '' end")
    return s.table("documents").select("doc_id", t.gist(F.concat(opening, "text")).alias("gist"))


@query(r""", p as (select n.*, p.kind || ': ' || left(p.query, 80) as hint from nodes n left join nodes p on p.id = n.parent), q as (select *, case when model = 'unknown' then 'agent' else model end as actor,
 case when model = 'unknown' then 'agent' else model end || case when agent_role = 'worker' then '' else ' [' || agent_role || ']' end as who, case when hint is null then '' else ' — following: ' || hint end as chain,
 list_filter([case when latency_ms > 2000 then latency_ms || 'ms' end, case when result_count = 0 then 'found nothing' end, case when result_count between 1 and 2 and tool in ('Grep', 'Glob', 'WebSearch') then 'only ' || result_count || ' result(s)' end], lambda x: x is not null) as bad from p)
 select id, case kind when 'decision' then who || ' decided: ' || query || case when hint is null then '' else ' — after: ' || hint end when 'insight' then who || ' decided: ' || query || case when hint is null then '' else ' — after: ' || hint end
 when 'open_item' then 'open item [' || actor || ']: ' || query || coalesce(' — ' || output_preview, '') when 'idea' then who || ' had an idea: ' || query || coalesce(' — ' || output_preview, '') when 'resolved' then who || ' resolved: ' || query || chain
 when 'warning' then who || ' warned: ' || query || chain when 'conversation_turn' then case when speaker = 'user' then 'user' else actor end || ' said: ' || coalesce(output_preview, query)
 else who || ' ' || case tool when 'Grep' then 'searched for' when 'Bash' then 'ran' when 'WebSearch' then 'searched the web for' when 'Edit' then 'edited' end || ' ' || query || coalesce(' — found: ' || output_preview, '')
 || case when len(bad) > 0 then ' [struggled: ' || array_to_string(bad, ', ') || ']' else '' end || chain end as text from q""")
def w_episodic_text(s: Store) -> DataFrame:
    parents = s.base.select(F.col("id").alias("parent"), F.concat("kind", F.lit(": "), F.substring("query", 1, 80)).alias("hint"))
    return s.nodes.join(parents, "parent", "left").select("id", t.episodic_text(F.col("hint")).alias("text"))


STOP_SQL = ", ".join(f"'{x}'" for x in t.DUPLICATE_STOP)
KEYWORDS = f"list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: length(w) >= 4 and not starts_with(w, '-')), lambda w: trim(lower(w), '.,;:!?()[]')), lambda w: w not in ({STOP_SQL})))"


@query(f", k as (select id, kind, status, seq, query, {KEYWORDS} as k from nodes where kind in ('decision', 'open_item', 'warning')), m as (select a.id, b.id as match, len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k)))::double as jaccard from k a join k b on a.kind = b.kind and a.id <> b.id where length(a.query) >= 20 and len(a.k) >= 3 and b.status = 'active' and len(b.k) > 0) select id, match, jaccard from (select *, row_number() over (partition by id order by jaccard desc, match) as r from m where jaccard >= 0.45) where r = 1")
def w_near_duplicate(s: Store) -> DataFrame:
    return dynamics.near_duplicates(s.base, s.base)


NOISE_SQL = " or ".join(f"contains(lower(trim(x)), '{p}')" for p in t.IMPORT_NOISE)


@query(f" select id, trim(x) = '' or {NOISE_SQL} as noise from (select id, case when turn % 5 = 4 then '  ' when turn % 5 = 3 then text || ' Unsupported Message Type' else text end as x from turns)")
def w_noise_filter(s: Store) -> DataFrame:
    x = F.when(F.col("turn") % 5 == 4, "  ").when(F.col("turn") % 5 == 3, F.concat("text", F.lit(" Unsupported Message Type"))).otherwise(F.col("text"))
    return s.turns.select("id", t.is_noise(x).alias("noise"))


MACHINE_SQL = " or ".join("starts_with(lower(x), '" + p + "')" for p in t.HARNESS_OPENINGS)


@query(rf" select id, x <> '' and not (speaker = 'user' and ({MACHINE_SQL})) and not regexp_matches(x, '{t.PLEASANTRY}') and regexp_matches(x, '[A-Za-z0-9]') and length(x) >= case when speaker = 'user' then 4 else 40 end as salient from (select id, speaker, trim(case turn % 7 when 6 then 'Thanks!!' when 5 then '<task-notification> ' || text when 4 then '…!' when 3 then left(text, 20) else text end) as x from turns)")
def w_salience(s: Store) -> DataFrame:
    n = F.col("turn") % 7
    x = F.when(n == 6, "Thanks!!").when(n == 5, F.concat(F.lit("<task-notification> "), "text")).when(n == 4, "…!").when(n == 3, F.substring("text", 1, 20)).otherwise(F.col("text"))
    return s.turns.select("id", t.is_salient(x, F.col("speaker")).alias("salient"))


@query(" select doc_id, case when s = '' then 'untitled' else s end as slug from (select doc_id, left(trim(regexp_replace(lower(case when doc_id % 9 = 0 then '!?' else text end), '[^a-z0-9]+', '-', 'g'), '-'), 28) as s from documents)")
def w_slug(s: Store) -> DataFrame:
    return s.table("documents").select("doc_id", t.slug(F.when(F.col("doc_id") % 9 == 0, "!?").otherwise(F.col("text"))).alias("slug"))


@query(" select id, regexp_extract(d, 'due:(.*)', 1) as due, trim(query) as shown from (select id, query, list_filter(tags, lambda t: starts_with(t, 'due:'))[1] as d from nodes) where d is not null")
def w_due_tag(s: Store) -> DataFrame:
    rows = s.base.select("id", t.due_date(F.col("tags")).alias("due"), F.concat("query", F.lit(" due:soon")).alias("query")).where("due is not null")
    return rows.select("id", "due", t.without_due(F.col("query")).alias("shown"))


@query(" select seq, case when seq % 4 = 0 then make_timestamp((1700000000 + seq) * 1000000) when seq % 4 = 1 then make_timestamp((1700000000 + seq) * 1000000) when seq % 4 = 2 then timestamp '2024-02-01' else timestamp '2024-02-01' end as at from nodes")
def w_iso(s: Store) -> DataFrame:
    n = F.col("seq")
    stamp = F.date_format(F.timestamp_seconds(1700000000 + n), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.when(n % 4 == 0, (1700000000 + n).cast("string")).when(n % 4 == 1, stamp).when(n % 4 == 2, "-5").otherwise("not a time")
    from ..model import as_of

    return s.base.select("seq", t.to_timestamp(raw, as_of()).alias("at"))


@query(" select id, upper(account[1]) || account[2:] as account, case when starts_with(id, 'import-') then 'import-chat' when seq % 2 = 0 then 'cli' end as harness, 'Unknown' as maker, case i when 0 then 'Claude' when 1 then 'GPT' when 2 then 'Qwen' else 'Unknown' end as by_name from (select id, account, regexp_extract(id, '(\\d+)$', 1)::bigint as seq, regexp_extract(id, '(\\d+)$', 1)::bigint % 4 as i from sessions)")
def w_attribution(s: Store) -> DataFrame:
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    name = F.when(n % 4 == 0, "lab/claude-x").when(n % 4 == 1, "o3-mini").when(n % 4 == 2, "lab/qwen-2").otherwise("")
    return s.sessions.select("id", at.canonical_account(F.col("account")).alias("account"), at.harness_of(F.col("id"), default=F.when(n % 2 == 0, "cli")).alias("harness"), at.maker_for_session(F.col("id")).alias("maker"), at.maker_of(name).alias("by_name"))


@query(" select seq, case seq % 5 when 0 then 'mapped' when 1 then 'part' when 2 then 'web' when 3 then 'app' end as tag from nodes")
def w_project_tag(s: Store) -> DataFrame:
    n = F.col("seq") % 5
    path = F.when(n == 0, "C:\\Work\\Alpha\\src").when(n == 1, "/home/betamax/x").when(n == 2, "/srv/web/a/b/").when(n == 3, "/opt/app").otherwise("/web/1/2/3/4")
    return s.base.select("seq", at.project_tag(path, {"alpha": "mapped", "beta": "part"}, ["web", "app"]).alias("tag"))


@query(" select id, explicit, account, coalesce(explicit is not null and explicit = 'Ann' or explicit is null and routed is not null, false) as locked from (select id, case when n % 6 = 0 then 'Ann' when n % 6 = 1 then 'typo' end as explicit, case when n % 6 = 2 then 'chan' end as routed, coalesce(case when n % 6 = 0 then 'Ann' when n % 6 = 1 then 'typo' end, case when n % 6 = 2 then 'chan' end, case when n % 6 = 3 then 'login' end, case when n % 6 = 4 then 'me' end) as account, n from (select id, regexp_extract(id, '(\\d+)$', 1)::bigint as n from sessions))")
def w_account_ladder(s: Store) -> DataFrame:
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 6
    none = F.lit(None).cast("string")
    explicit = F.when(n == 0, " Ann ").when(n == 1, "typo")
    account, locked = at.account_ladder(explicit, F.trim(explicit) == "Ann", F.when(n == 2, "chan"), none, F.when(n == 3, "login"), F.lit(False), F.when(n == 4, "me"), F.lit(False))
    return s.sessions.select("id", F.trim(explicit).alias("explicit"), account.alias("account"), F.coalesce(locked, F.lit(False)).alias("locked"))


@query(" select i, (i * 0.3819660112501051::double) - floor(i * 0.3819660112501051::double) as position from (select (row_number() over (order by seq) - 1)::int as i from nodes)")
def n_golden_positions(s: Store) -> DataFrame:
    rows = w.placed(s.base.select("seq"), ["seq"], Scratch(s.spark, "places"))
    return rows.select(F.col("i").cast("int").alias("i")).select("i", dynamics.golden_position(F.col("i")).alias("position"))


@query(", m as (select session, id, memory_tier, row_number() over (partition by session, memory_tier order by ts, seq) - 1 as i from nodes where status <> 'void' and memory_tier <= 1) select session, id, memory_tier, position, (position // 10000)::int as band from (select *, case when memory_tier = 0 then 0 else floor((i * 0.3819660112501051::double - floor(i * 0.3819660112501051::double)) * 200000) end::int as position from m)".replace("(position // 10000)::int", "floor(position / 10000)::int"))
def n_manifest(s: Store) -> DataFrame:
    return dynamics.manifest(s.base)


@query(
    " select session, count(*) filter (where memory_tier = 0 and status <> 'void') as hot, count(*) filter (where memory_tier = 1 and status <> 'void') as warm, count(*) filter (where memory_tier = 2 and status = 'active') as cold, 200000 as window,"
    " round_even(count(*) filter (where memory_tier < 2 and status <> 'void') * 100.0::double / greatest(1, count(*) filter (where (memory_tier < 2 and status <> 'void') or (memory_tier = 2 and status = 'active'))), 0)::int || '%' as coverage from nodes group by session"
)
def n_schedule_summary(s: Store) -> DataFrame:
    return dynamics.schedule_summary(s.base)


SCHEDULE = """, r as (select n.*, case when status = 'core' then 0 when coalesce(middle_hits, 0) >= 2 and coalesce(compiled_hits, 0) = 0 and coalesce(total_loads, 0) >= 2 then 1 else 2 end as s0, row_number() over (order by ts, seq) as o from nodes n left join positions p on p.node_id = n.id where session = 'user-12'),
 s1 as (select *, row_number() over (partition by s0 order by ts desc, o) as nw from r), s2 as (select *, case when s0 = 2 and nw <= 3 then 3 else s0 end as section from s1), s3 as (select *, row_number() over (partition by section order by o) - 1 as i from s2),
 s4 as (select *, case section when 2 then i * 0.3819660112501051::double - floor(i * 0.3819660112501051::double) when 3 then nw else o end::double as k from s3), s5 as (select *, row_number() over (order by section, k, o) - 1 as place from s4), s6 as (select *, count(*) over () as n from s5 where place < 40)
 select id, section, place::int as place, place >= floor(n / 3) and place < floor(2 * n / 3) as in_middle from s6"""


@query(SCHEDULE)
def n_schedule_context(s: Store) -> DataFrame:
    return dynamics.schedule_context(s.base.where("session = 'user-12'"), s.positions, [F.col("ts"), F.col("seq")])


@query(", l as (select session, node_id, row_number() over (partition by session order by shown_at, seq) - 1 as i, count(*) over (partition by session) as n from ledger), c as (select session, string_agg(node_id, ' ' order by node_id) as report from ledger where cited group by session) select node_id, count(*) as loads, count(*) filter (where i >= floor(n / 3) and i < floor(2 * n / 3)) as middle, count(*) filter (where contains(report, node_id)) as hits from l left join c using (session) group by node_id")
def n_position_feedback(s: Store) -> DataFrame:
    report = s.ledger.where("cited").groupBy("session").agg(F.array_join(F.array_sort(F.collect_list("node_id")), " ").alias("report"))
    return dynamics.position_feedback(s.ledger, ["shown_at", "seq"], report)


STORED = ", stored as (select 'import-chat-' || conv_id as session, count(*) filter (where turn < 3) + case when conv_id % 11 = 0 then 9 else 0 end as turns, arg_max('t' || conv_id || '_' || turn, turn) filter (where turn < 3) as last_id from conversations where conv_id % 4 <> 0 group by conv_id)"


def _stored(s: Store) -> DataFrame:
    some = s.turns.withColumn("c", F.regexp_extract("session", r"(\d+)$", 1).cast("long")).where("c % 4 <> 0").groupBy("session", "c").agg(F.count_if(F.col("turn") < 3).alias("n"), F.max_by(F.when(F.col("turn") < 3, F.col("id")), F.when(F.col("turn") < 3, F.col("turn"))).alias("last_id"))
    return some.select("session", (F.col("n") + F.when(F.col("c") % 11 == 0, 9).otherwise(0)).alias("turns"), "last_id")


@query(STORED + ", i as (select t.*, row_number() over (partition by session order by turn) as n, count(*) over (partition by session) as total, lag(id) over (partition by session order by turn) as before from turns t) select session, i.id, case when n = coalesce(turns, 0) + 1 then last_id else before end as parent, n::int as n from i left join stored using (session) where total > coalesce(turns, 0) and n > coalesce(turns, 0)")
def n_tail_dedup(s: Store) -> DataFrame:
    return w.new_tail(s.turns, _stored(s), ["turn"]).select("session", "id", "parent", "n")


@query(STORED + ", i as (select session, count(*) as n from turns group by session) select status, count(*) as conversations, sum(greatest(n - coalesce(turns, 0), 0))::bigint as turns from (select *, case when turns is null then 'new' when n > turns then 'resumed' when n = turns then 'unchanged' else 'shrunk' end as status from i left join stored using (session)) group by status")
def n_import_report(s: Store) -> DataFrame:
    return w.import_report(s.turns, _stored(s))


@query(" select session, segment::bigint as segment, count(*) as lines, string_agg(id, ',' order by turn) as ids from (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by session order by turn) as segment from turns) group by 1, 2")
def n_turn_segments(s: Store) -> DataFrame:
    rows = w.segments(s.turns, F.col("role") == "user", "session", ["turn"])
    return rows.groupBy("session", "segment").agg(F.count(F.lit(1)).alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"]), ",").alias("ids"))


@query(", v as (select total_loads::double as v, row_number() over (order by total_loads) as i, count(*) over () as n from positions) select round(2 * sum(i * v) / (max(n) * sum(v)) - (max(n) + 1) / max(n)::double, 9) as gini from v")
def n_gini(s: Store) -> DataFrame:
    return dynamics.gini(s.positions, "total_loads").select(F.round("gini", 9).alias("gini"))


@query(", f as (select session, ts, seq, memory_tier = 1 as f from nodes), g as (select *, row_number() over (partition by session order by ts, seq) - sum(f::int) over (partition by session order by ts, seq) as g from f), r as (select session, g, count(*) as n from g where f group by 1, 2) select session, coalesce(max(n), 0) as streak from (select distinct session from f) left join r using (session) group by session")
def n_longest_streak(s: Store) -> DataFrame:
    return w.longest_streak(s.base, F.col("memory_tier") == 1, "session", ["ts", "seq"])


@query(" select id, session, (sum(new) over (partition by session order by ts, seq))::bigint as visit from (select *, case when lag(ts) over (partition by session order by ts, seq) is null or epoch(ts) - epoch(lag(ts) over (partition by session order by ts, seq)) > 1800 then 1 else 0 end as new from nodes)")
def x_session_gap(s: Store) -> DataFrame:
    return w.visits(s.base, "session", order=("seq",)).select("id", "session", "visit")


@query(" select id, recent, recent <= 2 as allowed from (select id, count(*) over (partition by session order by floor(epoch(ts)) range between 86400 preceding and current row) as recent from nodes)")
def x_sliding_rate(s: Store) -> DataFrame:
    return w.sliding_rate(s.base, "session", seconds=86400, most=2).select("id", "recent", "allowed")


@query(" select case when ts >= timestamp '2024-01-20' then 'forward' when ts >= timestamp '2024-01-15' then 'floor' else 'history' end as part, count(*) as nodes from nodes group by 1")
def x_forward_split(s: Store) -> DataFrame:
    from ..sources.transcripts import forward_part

    return s.base.groupBy(forward_part(F.col("ts"), F.lit("2024-01-20").cast("timestamp"), F.lit("2024-01-15").cast("timestamp")).alias("part")).agg(F.count(F.lit(1)).alias("nodes"))


DRIFT_WORDS = r"list_distinct(list_filter(list_transform(regexp_split_to_array(lower(regexp_replace(query, '[/\\.]', ' ', 'g')), '\s+'), lambda w: trim(w, '_-:(),;''\"')), lambda w: length(w) > 3 and not starts_with(w, '-') and not regexp_matches(w, '^\d+$')))"


DRIFTED = f""", k as (select session, id, row_number() over (partition by session order by ts, seq) as n, {DRIFT_WORDS} as k, ts, seq from nodes where kind = 'tool_call'),
 p as (select *, list_distinct(flatten(list(k) over (partition by session order by n rows between 10 preceding and 1 preceding))) as past from k),
 q as (select *, case when len(coalesce(past, [])) = 0 then 1.0 else len(list_intersect(k, past)) / len(list_distinct(list_concat(k, past)))::double end as similarity, list_filter(k, lambda w: not list_contains(coalesce(past, []), w)) as fresh from p where n % 5 = 0 and n > 5 and len(k) > 0)
 select session, id, n::int as n, similarity, list_sort(list_transform(case when len(fresh) > 0 then fresh else k end, lambda w: {{'l': -length(w), 'w': w}}))[1].w as keyword from q where similarity < 0.4"""


@query(DRIFTED)
def x_drift_windows(s: Store) -> DataFrame:
    return w.drift(s.base.where("kind = 'tool_call'"), "session", ["ts", "seq"], floor=0.4)


@query(" select id, n::int as n from (select id, row_number() over (partition by session order by ts, seq) as n from nodes) where n % 25 = 0")
def x_heartbeat_counter(s: Store) -> DataFrame:
    return w.counter_triggers(s.base, "session", ["ts", "seq"]).select("id", "n")


@query(" select id, session, file from (select *, row_number() over (partition by session, file order by ts, seq) as r from (select *, 'f' || (seq % 6) as file from nodes where kind = 'tool_call')) where r = 1")
def x_once_per_file(s: Store) -> DataFrame:
    calls = s.base.where("kind = 'tool_call'").withColumn("file", F.concat(F.lit("f"), (F.col("seq") % 6).cast("string")))
    return w.once_per(calls, ["session", "file"], ["ts", "seq"]).select("id", "session", "file")
