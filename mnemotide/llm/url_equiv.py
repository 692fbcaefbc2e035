"""URL filters with redirect equivalence: block decisions reach all aliases; explicit allow rules come first."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`; verdict is allow or block."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of a URL; both empty without `://` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(rows: DataFrame, rules: list[Rule], host: str, path: str, inline: int = 256) -> DataFrame:
    """`rows` with columns rule and rule_verdict: the longest rule that fits, or null.

    Up to `inline` rules are part of the expression, longest first: no join and no shuffle. More become a table
    that is joined on each suffix of the host, so the work for a row grows with its labels, not with the rules.
    """
    order = sorted(set(rules), key=lambda r: (-len(r.text), r.text, r.verdict))
    if len(order) <= inline:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in reversed(order):
            fits = ((F.col(host) == r.host) | F.endswith(F.col(host), F.lit("." + r.host))) & F.startswith(F.col(path), F.lit(r.path))
            rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
        return rows.withColumns({"rule": rule, "rule_verdict": verdict})
    table = rows.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict, i) for i, r in enumerate(order)], "rule_host string, rule_path string, rule_text string, rule_said string, rule_place int")
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    places = rows.select(host, path).distinct().withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where(F.startswith(F.col(path), F.col("rule_path")))
    best = places.groupBy(host, path).agg(F.min(F.struct("rule_place", "rule_text", "rule_said")).alias("best"))
    best = best.select(host, path, F.col("best.rule_text").alias("rule"), F.col("best.rule_said").alias("rule_verdict"))
    return rows.join(best, [host, path], "left")


def _without_dots(path: Column) -> Column:
    """An absolute path without its `.` and `..` segments."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    out = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.concat(out, F.lit("/"))).otherwise(out)


def resolved(ref: Column, base: Column) -> Column:
    """The absolute URL that `ref` names on a page at the URL `base` (RFC 3986, 5.2); null without `://`, for other
    schemes and for mere fragments."""
    origin = F.regexp_extract(base, r"(?s)^([^?#]*?://[^/?#]*)", 1)
    own = F.regexp_extract(base, r"(?s)^[^?#]*?://[^/?#]*([^?#]*)", 1)
    path, rest = F.regexp_extract(ref, r"(?s)^([^?#]*)", 1), F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(F.contains(own, F.lit("/")), F.regexp_extract(own, r"(?s)^(.*/)", 1)).otherwise(F.lit("/"))
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), ref)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (origin == "") | (ref == "") | F.startswith(ref, F.lit("#")), F.lit(None).cast("string"))
        .when(F.startswith(ref, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*?:)//", 1), ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(origin, own, ref))
        .otherwise(F.concat(origin, F.when(F.contains(whole, F.lit("/.")), _without_dots(whole)).otherwise(whole), rest))
    )


# Comments, and elements whose text is no markup; one that is not closed reaches to the page's end.
_NOT_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|template)\b[^<>]*+>.*?(?:</\1\b|\Z)", re.S | re.I)
# A tag ends before the next one begins, so that pages full of tags without an end are read once.
_TAG = re.compile(r"""<(link|meta|base)(?=[\s/>])((?:"[^"]*"|'[^']*'|[^<>"'])*+)>""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_REFRESH = re.compile(r"""\s*[0-9.]*\s*[;,]?\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)


def _attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by name in lower case, the first of each name, entities decoded and blanks around taken away."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = m.group(2) or ""
        value = value[1:-1] if value[:1] in ("'", '"') else value
        found.setdefault(m.group(1).lower(), html.unescape(value).strip())
    return found


def references(page: str) -> tuple[str | None, list[str]]:
    """(base, references): what a page's canonical links and refresh redirects name, as written, and its `<base>`, if any.

    A link is canonical if `canonical` is one of the words of its `rel`. Comments and texts of scripts, styles, titles,
    text areas and templates are no markup.
    """
    base, out = None, []
    for tag in _TAG.finditer(_NOT_MARKUP.sub(" ", page)):
        kind, found = tag.group(1).lower(), _attributes(tag.group(2))
        if kind == "base":
            base = base or found.get("href")
        elif kind == "link":
            if "canonical" in found.get("rel", "").lower().split():
                out.append(found.get("href", ""))
        elif found.get("http-equiv", "").lower() == "refresh":
            m = _REFRESH.match(found.get("content", ""))
            out.append(next((x for x in m.groups() if x), "").strip())
    return base, [x for x in dict.fromkeys(out) if x]


def _read_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, b, v = [], [], []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base, found = references(page)
            u += [url] * len(found)
            b += [base] * len(found)
            v += found
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (u, b, v)], names=["u", "base", "v"])


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): pairs of page URLs and the URLs that their canonical links or refresh redirects name, made absolute against the
    page's URL, or its `<base>` if it has one. Only pages that hold such a word at all are parsed."""
    low = F.lower(html_col)
    tags = pages.where(F.col(url_col).isNotNull() & (F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("refresh"))))
    found = tags.select(F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("html")).mapInArrow(_read_links, "u string, base string, v string")
    found = found.withColumn("at", F.coalesce(F.when(F.col("base").isNotNull() & (F.col("base") != ""), resolved(F.col("base"), F.col("u"))), F.col("u")))
    return found.select("u", resolved(F.col("v"), F.col("at")).alias("v")).where("v is not null")


def page_key(url: Column) -> Column:
    """What makes two URLs the same page: host in lower case, path and query; scheme and fragment do not count. Null for
    null and without `://`: such a URL names no page, so it shares a key with none."""
    host, path = host_and_path(url)
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)?", 1)))


def judge(pages: DataFrame, rules: list[Rule], links: DataFrame | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, group) for every row of `pages`.

    A page with a fitting rule takes its verdict. Another takes that of its group, the connected component over
    canonical links, refresh redirects (read from the pages) and `links` (u, v: URLs, from a crawl log): allow if a
    rule allows any member, else block if a rule blocks any member, else `default`. Members that are only named by
    links count. Only linked URLs enter the components; all else is decided in place, and a group's flags are
    combined before the shuffle, so a group or host with a third of all rows is safe.

    A null URL or one without `://` has an empty host and path, no rule and the default verdict, whatever its links say.
    Very long pages are read whole. Rows repeat as they come; ties between rules go to the first by text. An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url_col))
    rows = matching_rule(pages.select(F.col(id_col), F.col(url_col).alias("url"), host.alias("host"), path.alias("path")), rules, "host", "path")
    edges = page_links(pages, url_col, html_col)
    if links is not None:
        edges = edges.unionByName(links.select("u", "v"))
    edges = scratch.save(edges.where("u is not null and v is not null").select(page_key(F.col("u")).alias("u"), page_key(F.col("v")).alias("v")).where("u <> v").distinct())
    if edges.isEmpty():
        return rows.select(id_col, "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("group"))
    groups = scratch.save(connected_components(edges, scratch))
    # a key is a URL without scheme, so rules read it as one
    named = groups.withColumn("as_url", F.concat(F.lit("x://"), "node"))
    h, p = host_and_path(F.col("as_url"))
    members = matching_rule(named.select("node", "component", h.alias("host"), p.alias("path")), rules, "host", "path")
    flags = members.groupBy("component").agg(F.bool_or(F.col("rule_verdict") == "allow").alias("allowed"), F.bool_or(F.col("rule_verdict") == "block").alias("blocked"))
    said = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise(default)
    found = groups.join(flags, "component").select(F.col("node").alias("key"), F.col("component").alias("group"), said.alias("group_verdict"))
    out = rows.withColumn("key", page_key(F.col("url"))).join(found, "key", "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("rule_verdict", "group_verdict", F.lit(default)).alias("verdict"), "group")
