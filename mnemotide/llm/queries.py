"""Queries of this subpackage, by name, with production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import bounded_batches
from . import knn_quality, langid
from .block_neighbours import nearest_neighbours
from .minhash import near_duplicates
from .packing import pack, pack_sql
from .pii_anchor import personal_data
from .pit_features import point_in_time_features
from .prefix_trie import conversation_trie
from .sp_nbest import default_model, nbest_pieces
from .span_dedup import dedup_spans
from .topk import exact_topk
from .url_equiv import Rule, judge
from .vec_dedup import embedding_near_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), budget=65536, buckets=8)


def op2_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(_table(spark, sf_dir, "documents"), least=2, least_words=24, every=6)


def op3_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = knn_quality.fit_on(docs, labels.where(~held_out), sample_rows=3000)
    scored = knn_quality.quality_scores(docs, model, threshold=0.7)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


URL_RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]


def op4_url_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest_pieces(_table(spark, sf_dir, "documents"), default_model(spark), nbest=8)


def op8_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no markup or address; their source stands for the host."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_on(docs, sample_rows=2000), host=F.col("source"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over raw pages: visible text, declared language, host suffix and host priors."""
    pages = _table(spark, sf_dir, "pages")
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[a-z]+;", " ")
    rows = pages.select("page_id", text.alias("text"), langid.host_of(F.col("url")).alias("host"), langid.declared_in(F.col("html")).alias("declared"))
    model = langid.fit_on(_table(spark, sf_dir, "documents"), sample_rows=2000)
    found = langid.identify(rows, model, id_col="page_id", host=F.col("host"), declared=F.col("declared"))
    return found.withColumnRenamed("doc_id", "page_id")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(_table(spark, sf_dir, "embeddings"), lambda c: c % 100 == 0, k=10, scale=1024.0)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"), heads=6, every=100).drop("key_hi", "key_lo")


def op12_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), lambda c: c % 50 == 0, k=5)


def op13_point_in_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, sales, lines = (_table(spark, sf_dir, t) for t in ("clicks", "sales", "sale_lines"))
    return point_in_time_features(clicks, sales, lines, windows=(2, 14), delay_minutes=240, label_days=7)


QUERIES = {
    "op1_length_bucket_packing": op1_length_bucket_packing,
    "op2_sentence_span_dedup": op2_sentence_span_dedup,
    "op3_knn_quality": op3_knn_quality,
    "op4_url_redirect_equivalence": op4_url_redirect_equivalence,
    "op5_pii_anchor_expansion": op5_pii_anchor_expansion,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_sentencepiece_nbest": op7_sentencepiece_nbest,
    "op8_language_evidence": op8_language_evidence,
    "language_of_pages": language_of_pages,
    "op9_exact_topk": op9_exact_topk,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_block_neighbours": op12_block_neighbours,
    "op13_point_in_time_features": op13_point_in_time_features,
}

# crc32 from its table of 256 remainders, which SQL builds from the polynomial
CRC_TABLE = """crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, list_transform(range(8), lambda k: 0::bigint)),
  lambda a, k: case when a % 2 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end)) as remainders)"""


def crc_sql(column: str) -> str:
    """Unsigned crc32 of a number's decimal form, for rows joined with `crc`."""
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({column}::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, c: xor(a >> 8, remainders[(xor(a, c) % 256) + 1])), 4294967295::bigint)"""


#: What the links of `_linked_pages` name, written down for each form: (page_id, url, the base, the reference).
LINKED_SQL = r"""(select page_id, url, case when page_id % 16 = 12 then 'http://hub2.com/en/x/' else url end as base, unnest(case page_id % 16
  when 0 then ['http://hub' || page_id % 3 || '.com/en/' || page_id % 5] when 1 then ['../' || page_id % 4 || '?id=' || page_id % 6 || '#f'] when 2 then ['?page=' || page_id % 3 || '&r=1']
  when 3 then ['//hub' || page_id % 3 || '.com/en/' || page_id % 5] when 4 then ['./a/../b/./' || page_id % 3 || '/..'] when 5 then ['/en/' || page_id % 9] when 8 then ['http://hub' || page_id % 3 || '.com/en/' || page_id % 5]
  when 9 then ['http://hub' || page_id % 3 || '.com/es/' || page_id % 5] when 10 then ['http://hub1.com/en/' || page_id % 5 || '?a=1&b=2'] when 11 then ['/en/' || page_id % 4 || ';a=2'] when 12 then [(page_id % 5)::varchar]
  when 13 then ['http://hub1.com/es/' || page_id % 3] when 15 then ['http://hub1.com/en/' || page_id % 5, 'http://hub2.com/es/1'] else [] end) as t
  from (select page_id, case page_id % 11 when 9 then 'page-' || page_id else url end as url from pages))"""


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with canonical links and redirects of every form, by number; some without a URL that names a page."""
    n = F.col("page_id")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    forms = {
        0: ['<link rel="canonical" href="http://hub', n % 3, ".com/en/", n % 5, '">'],
        1: ["<html><LINK href='../", n % 4, "?id=", n % 6, "#f' rel=canonical>"],
        2: ['<meta http-equiv="refresh" content="0;url=?page=', n % 3, '&amp;r=1">'],
        3: ["<link rel=canonical href=//hub", n % 3, ".com/en/", n % 5, ">"],
        4: ['<meta content="5; url=./a/../b/./', n % 3, '/.." http-equiv=refresh>'],
        5: ['<link rel="canonical" href="mailto:a@b.c"><link rel="canonical" href="/en/', n % 9, '">'],
        6: ['<link rel="stylesheet" href="x.css"><link rel="canonical" href="#top">'],
        8: ['<link rel="canonical" href=" http://hub', n % 3, ".com/en/", n % 5, '\n">'],
        9: ["<link rel='nofollow Canonical' href='http://hub", n % 3, ".com/es/", n % 5, "'/>"],
        10: ['<link rel=canonical href="http:&#47;/hub1.com&#x2F;en/', n % 5, '?a=1&amp;b=2">'],
        11: ['<meta http-equiv=Refresh content="0;url=/en/', n % 4, ';a=2">'],
        12: ['<base href="http://hub2.com/en/x/"><link rel=canonical href="', n % 5, '">'],
        13: ['<link rel="canonical" data-href="http://hub0.com/en/0" href="http://hub1.com/es/', n % 3, '">'],
        14: ['<!-- <link rel="canonical" href="http://hub0.com/en/0"> --><script>x = \'<link rel=canonical href="http://hub1.com/en/1">\';</script>'],
        15: ['<link title="a>b" href=\'http://hub1.com/en/', n % 5, "' rel=\"CANONICAL\"><meta http-equiv=\"refresh\" content=\"3; URL='http://hub2.com/es/1'\">"],
    }
    html = F.col("html")
    for k, parts in forms.items():
        html = F.when(n % 16 == k, text(*parts)).otherwise(html)
    return _table(spark, sf_dir, "pages").select("page_id", F.when(n % 11 == 9, text("page-", n)).otherwise(F.col("url")).alias("url"), html.alias("html"))


def url_equivalence_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over pages that carry links, which those of the test tables do not."""
    return judge(_linked_pages(spark, sf_dir), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES["url_equivalence_of_links"] = url_equivalence_of_links


def embedding_cells_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with cells so small that also small tables have many."""
    return embedding_near_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.95, target_cell=64)


QUERIES["embedding_cells_near_dedup"] = embedding_cells_near_dedup


#: References of pages as (url, base, t), read from their tags.
READ_SQL = r"""(select url, url as base, replace(case when regexp_matches(tag, '(?is)^<link') and regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') then regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    when regexp_matches(tag, '(?is)^<meta') and regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') then regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) end, '&amp;', '&') as t
  from (select url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) as tag from pages))"""


def _url_sql(pages: str, references: str) -> str:
    """Verdicts for `pages`: links resolved against the page or its base (RFC 3986, 5.2), components by reachability, rules by length."""
    return (
        r"""
with recursive page as (
  select page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as rest from PAGES
), part as (
  select page_id, url, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from page
), rules(verdict, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
key as (select *, case when contains(url, '://') then host || path || regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)?', 1) end as k from part),
targets as (
  select *, regexp_extract(t, '(?s)^([^?#]*)', 1) as tpath, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) as trest, regexp_extract(base, '(?s)^([^?#]*?://[^/?#]*)', 1) as origin, regexp_extract(base, '(?s)^[^?#]*?://[^/?#]*([^?#]*)', 1) as own
  from (select distinct k, base, t from REFERENCES join (select distinct url, k from key where k is not null) using (url))
), joined as (
  select *, case when starts_with(tpath, '/') then tpath else case when contains(own, '/') then regexp_extract(own, '(?s)^(.*/)', 1) else '/' end || tpath end as whole from targets where t <> ''
), cut as (
  select *, string_split(whole, '/')[2:] as seg from joined
), dots as (
  select *, list_reduce(list_prepend([]::varchar[], list_transform(seg, lambda x: [x])), lambda a, x: case when x[1] = '..' then a[1:len(a) - 1] when x[1] = '.' then a else list_concat(a, x) end) as kept from cut
), clean as (
  select *, case when contains(whole, '/.') then '/' || array_to_string(kept, '/') || case when seg[-1] in ('.', '..') and len(kept) > 0 then '/' else '' end else whole end as tidy from dots
), absolute as (
  select k as u, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') or starts_with(t, '#') then null
    when starts_with(t, '//') then regexp_extract(base, '(?s)^([^?#]*?:)//', 1) || t when starts_with(t, '?') then origin || own || t else origin || tidy || trest end as t from clean
), one as (
  select u, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1)
    || regexp_extract(t, '(?s)^[^?#]*(\?[^#]*)?', 1) as v from absolute where contains(t, '://')
), edges as (select u, v from one where u <> v union select v, u from one where u <> v),
reach as (select distinct u as node, u as seen from edges union select r.node, e.v from reach r join edges e on e.u = r.seen),
nodes as (select distinct seen as k, regexp_extract(seen, '^([^/?#]*)', 1) as host, regexp_extract(seen, '^[^/?#]*([^?#]*)', 1) as path from reach),
ruled as (select k, verdict, row_number() over (partition by k order by length(h || p) desc) as r from nodes join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
grouped as (select node as k, bool_or(verdict = 'allow') as allowed, bool_or(verdict = 'block') as blocked from reach join ruled on ruled.k = seen and r = 1 group by node),
found as (
  select page_id, host, path, k, h || p as rule, verdict, row_number() over (partition by page_id, url order by length(h || p) desc nulls last) as r
  from key left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
)
select page_id, host, path, rule, coalesce(verdict, case when allowed then 'allow' when blocked then 'block' end, 'allow') as verdict
from found left join grouped using (k) where r = 1
""".replace("PAGES", pages).replace("REFERENCES", references)
    )


ORACLE_SQL = {
    "op1_length_bucket_packing": pack_sql(budget=65536, buckets=8),
    "op4_url_redirect_equivalence": _url_sql("pages", READ_SQL),
    "url_equivalence_of_links": _url_sql("(select page_id, case page_id % 11 when 9 then 'page-' || page_id else url end as url from pages)", LINKED_SQL),
    "op6_minhash_near_dedup": r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), runs as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [w]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) end as s from words
), sizes as (select doc_id, len(s) as n from runs),
flat as (select doc_id, unnest(s) as x from runs),
frequent as (select x from flat group by x having count(*) > 1),
kept as (select f.doc_id, f.x from flat f join frequent using (x)),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as k from kept a join kept b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select u, v from pairs join sizes a on a.doc_id = u join sizes b on b.doc_id = v where 100 * k >= 85 * (a.n + b.n - k)),
edges as (select u, v from links union all select v, u from links),
reach as (select distinct u as node, u as seen from edges union select r.node, e.v from reach r join edges e on e.u = r.seen),
lowest as (select node, min(seen) as c from reach group by node)
select s.doc_id, s.n::bigint as n_shingles, coalesce(c, s.doc_id) as component_id, coalesce(c, s.doc_id) = s.doc_id as kept
from sizes s left join lowest on node = s.doc_id
""",
    "op9_exact_topk": """
with z as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v)::bigint as score
  from z q join z c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, n::int as rank, vec_id, score from r where n <= 10
""",
    "op10_embedding_near_dedup": """
with recursive x as (
  select vec_id, case when embedding is null or len(embedding) = 0 or len(list_filter(embedding, lambda c: c is null or not isfinite(c))) > 0
    or len(list_filter(embedding, lambda c: c <> 0)) = 0 then null else embedding::double[] end as v from embeddings
), links as (
  select a.vec_id as u, b.vec_id as v from x a join x b on a.vec_id <> b.vec_id and a.v is not null and b.v is not null
  where list_cosine_similarity(a.v, b.v) >= 0.95
), reach as (select distinct u as node, u as seen from links union select r.node, l.v from reach r join links l on l.u = r.seen),
lowest as (select node, min(seen) as c from reach group by node),
degree as (select u, count(*) as n from links group by u)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept
from x left join lowest on node = vec_id left join degree on u = vec_id
""",
}

ORACLE_SQL["op12_block_neighbours"] = """
with x as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_cosine_similarity(q.v, c.v) as score from x q join x c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, n::int as rank, vec_id, score from r where n <= 5
"""

ORACLE_SQL["op13_point_in_time_features"] = f"""
with {CRC_TABLE}, s as (
  select sale_id, client_id, epoch_us(sold_at) as sold, epoch_us(arrived_at) + 14400000000 as known, coalesce(floor(100 * total + 0.5), 0)::bigint as cents from sales where client_id is not null and sold_at is not null
), p as (select row_number() over () as r, sale_id, client_id, sold + coalesce({crc_sql("sale_id")} % 259200, 0) * 1000000 as t from s, crc),
w as (select *, d * 86400000000 as span from p, (values (2), (14)) as v(d)),
c as (select distinct * from clicks),
clicked as (
  select r, d, count(*) as n, count(*) filter (kind = 'purchase') as bought, sum(coalesce(floor(100 * value + 0.5), 0))::bigint as cents, arg_max(click_id, {{'ts': ts, 'id': click_id}}) as last
  from w join c using (client_id) where epoch_us(ts) <= t and epoch_us(ts) > t - span and epoch_us(arrived_at) + 14400000000 <= t group by r, d
), held as (select r, d, t, s.sale_id, s.cents from w join s using (client_id) where sold <= t and sold > t - span and known <= t),
sold as (select r, d, count(*) as n, sum(cents)::bigint as cents from held group by r, d),
lined as (
  select r, d, count(*) as n, count(distinct item_id) as items, sum(coalesce(floor(100 * amount + 0.5), 0))::bigint as cents
  from held join sale_lines l on l.sale_id = held.sale_id where epoch_us(shipped_at) <= t group by r, d
)
select w.sale_id, w.d::int as d, t as t_us, exists (select 1 from s where s.client_id = w.client_id and s.sold > w.t and s.sold <= w.t + 604800000000) as label,
  coalesce(a.n, 0)::bigint as n_clicks, coalesce(a.bought, 0)::bigint as n_purchases, coalesce(a.cents, 0)::bigint as click_cents, a.last as last_click_id,
  coalesce(b.n, 0)::bigint as n_sales, coalesce(b.cents, 0)::bigint as sale_cents, coalesce(e.n, 0)::bigint as n_lines, coalesce(e.items, 0)::bigint as n_items, coalesce(e.cents, 0)::bigint as line_cents
from w left join clicked a using (r, d) left join sold b using (r, d) left join lined e using (r, d)
"""

ORACLE_SQL["op11_conversation_prefix_trie"] = f"""
with {CRC_TABLE}, turns as (
  select conv_id, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as i
  from conversations where conv_id is not null
), orig as (select conv_id, list({{'r': r, 'x': x}} order by i) as s from turns group by conv_id),
heads as (select conv_id as c, s, {crc_sql("conv_id")} % 6 as h from orig, crc),
reb as (select c, list_concat(coalesce(b.s[1:h], []), a.s[h + 1:]) as s from heads a left join orig b on b.conv_id = c - c % 100),
mem as (select c, d, s[1:d] as p, d = len(s) as fin from (select c, s, unnest(range(0, len(s) + 1)) as d from reb)),
nodes as (select p, d, min(c) as conv_id, count(*) as n, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (fin), '')) as e from mem group by p, d),
kids as (select p[1:d - 1] as p, count(*) as k from nodes where d > 0 group by 1),
counted as (select nodes.*, coalesce(k, 0) as k from nodes left join kids using (p)),
above as (select p[1:i] as q, case when k = 0 then 1 else 0 end as leaf, case when d > 0 then (n - 1) * length(p[d].x) else 0 end as v from (select *, unnest(range(0, d + 1)) as i from counted)),
sums as (select q, sum(leaf) as leaves, sum(v) as saved from above group by q)
select a.conv_id, a.d as depth, b.conv_id as parent_conv_id, a.n as n_convs, a.k as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, a.e as ends_sha256
from counted a join sums on q = a.p left join nodes b on a.d > 0 and b.d = a.d - 1 and b.p = a.p[1:a.d - 1]
"""

ORACLE_SQL["embedding_cells_near_dedup"] = ORACLE_SQL["op10_embedding_near_dedup"]
