import itertools

from urllib.parse import urljoin

from mnemotide.llm.url_equiv import Rule, judge, page_key, page_links, references, resolved

PAGES = "page_id long, url string, html string, host int, rule int, key int, component int"
RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]


def _page(i, url, html=None):
    return (i, url, html, 1, 2, 3, 4)


def _rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


CANON = '<html><head><LINK href="{}" data-x=1 rel=canonical></head></html>'


def test_groups_and_rules(spark):
    rows = [
        _page(1, "https://A.Example.com/en/1?x#y", "<p>"),
        _page(2, "http://mirror.test/a", CANON.format("https://a.example.com/en/1?x")),
        _page(3, "http://mirror.test/b", '<meta http-equiv="refresh" content="0; url=http://mirror.test/a">'),
        _page(4, "http://x.example.com/en/77", CANON.format("//w.org/es/1")),
        _page(5, "http://other.test/q", CANON.format("http://x.example.com/en/77")),
        _page(6, None, None), _page(7, "no scheme", ""), _page(8, "https://w.org/es/1", None), _page(8, "https://w.org/es/1", None),
        _page(9, "http://z.test/", CANON.format("/en/9") + CANON.format("http://z.test/")), _page(10, "ftp://net/de/x?u=a://b", ""),
        _page(None, "http://q.example.net/de/88", None), _page(11, "://com/en/", ""), _page(12, "http://crawl.test/1", None), _page(13, "http://notcom/en/1", None),
    ]
    links = spark.createDataFrame([("http://crawl.test/1", "http://crawl.test/2"), ("http://crawl.test/2", "https://u.com/en/0"), (None, "x")], "u string, v string")
    got = judge(spark.createDataFrame(rows, PAGES), RULES, links).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for r in got:
        own = _rule(r.host, r.path)
        assert r.rule == (own.text if own else None)
        assert not own or r.verdict == own.verdict
    assert (by[1].host, by[1].path, by[1].verdict) == ("a.example.com", "/en/1", "block")
    assert by[2].verdict == by[3].verdict == "block" and by[2].group == by[1].group == by[3].group
    assert by[4].verdict == "allow" and by[5].verdict == "allow" and by[8].verdict == "block"
    assert (by[6].host, by[6].path, by[6].verdict, by[7].host) == ("", "", "allow", "")
    assert by[10].verdict == "allow" and by[11].verdict == "block" and by[12].verdict == "block" and by[13].rule is None


def test_joined_rules_equal_inlined_ones(spark):
    urls = [f"http://{h}{p}" for h, p in itertools.product(["com", "a.com", "example.com", "b.example.net", "net", "org", "xorg"], ["", "/", "/en/", "/en/71", "/de/8", "/es/"])]
    pages = spark.createDataFrame([_page(i, u) for i, u in enumerate(urls)], PAGES)
    few = judge(pages, RULES).collect()
    many = judge(pages, RULES + [Rule("block", f"h{i}.invalid", "/") for i in range(300)]).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))


def test_empty_and_unlinked(spark):
    empty = spark.createDataFrame([], PAGES)
    assert judge(empty, RULES).collect() == []
    one = spark.createDataFrame([("HTTP://A.b/c?d#e",), ("x",)], "u string")
    from pyspark.sql import functions as F

    assert [r[0] for r in one.select(page_key(F.col("u"))).collect()][0] == "a.b/c?d"


def test_relative_references_are_resolved(spark):
    bases = ["http://h.org/a/b/c.html?x=1#f", "http://h.org/a/", "https://h.org/a"]
    refs = ["home.html", "./8", "../8", "../../../8", "?id=8", "/x/../y", "a/./b/..", ".", "..", "//o.net/z", "http://o.net/q", "d/e?u=http://z.com/../k#s", "/go?u=http://z.com", "a.b", ".hidden", "..."]
    table = spark.createDataFrame(list(itertools.product(refs, bases)), "r string, b string")
    for row in table.select("r", "b", resolved(table.r, table.b).alias("v")).collect():
        assert row.v == urljoin(row.b, row.r), row
    odd = spark.createDataFrame([("mailto:a@b.c", bases[0]), ("#top", bases[0]), ("x", "no-scheme/y"), (None, bases[0])], "r string, b string")
    assert [r[0] for r in odd.select(resolved(odd.r, odd.b)).collect()] == [None] * 4
    bare = spark.createDataFrame([("x.html", "http://h.org"), ("../x.html", "http://h.org?q=/a/b")], "r string, b string")
    assert {r[0] for r in bare.select(resolved(bare.r, bare.b)).collect()} == {"http://h.org/x.html"}


def test_verdicts_reach_pages_over_relative_links(spark):
    rows = [
        (1, "http://bad.com/d/7.html", "<link rel=canonical href='8.html'>"), (2, "http://bad.com/d/8.html", ""),
        (3, "http://bad.com/e/x", "<meta http-equiv=refresh content='0;url=../home.html'>"), (4, "http://bad.com/home.html", ""),
        (5, "http://bad.com/f?id=1", "<link rel='canonical' href='?id=8'>"), (6, "http://bad.com/f?id=8", ""), (7, "http://bad.com/g", ""),
    ]
    rules = [Rule("block", "bad.com", "/d/7"), Rule("block", "bad.com", "/e/"), Rule("allow", "bad.com", "/none")]
    got = {r.page_id: (r.verdict, r.group) for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert {i: v for i, (v, _) in got.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}
    assert got[5][1] == got[6][1] is not None and got[7][1] is None


def test_urls_without_a_scheme_share_nothing(spark):
    link = '<link rel="canonical" href="http://a.com/en/1">'
    pages = spark.createDataFrame([(1, "foo", link), (2, "bar", ""), (3, None, link), (4, "http://a.com/en/1", ""), (5, "http://x.org/q", link)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in judge(pages, [Rule("block", "com", "/en/")]).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block"}


def test_references_of_every_form():
    cases = {
        '<link rel="canonical" href=" http://b.com/en/1\t">': ["http://b.com/en/1"],
        '<link rel="nofollow canonical" href=/x>': ["/x"],
        "<link rel=canonicals href=/x>": [],
        '<link rel=canonical href="&#47;a&#x2f;b?c=1&amp;d&lt;">': ["/a/b?c=1&d<"],
        '<meta http-equiv="refresh" content="0;url=/en/1;a=2">': ["/en/1;a=2"],
        '<meta http-equiv="refresh" content="0; URL=\'/en/1 x\'; y">': ["/en/1 x"],
        '<meta http-equiv="refresh" content="5">': [],
        '<meta name="refresh" content="0;url=/x">': [],
        '<link rel=canonical data-href="/no" href="/yes">': ["/yes"],
        '<link rel=canonical data-href="/no">': [],
        '<!-- <link rel=canonical href="/no"> -->': [],
        '<!-- <link rel=canonical href="/no">': [],
        '<script>"<link rel=canonical href=/no>"</script><LINK REL=CANONICAL HREF=/yes />': ["/yes"],
        '<link title="a>b" href="/x" rel=canonical>': ["/x"],
        '<linker rel=canonical href=/x>': [],
        '<link rel=canonical href=/a href=/b><link rel=canonical href=/a>': ["/a"],
    }
    for page, want in cases.items():
        assert references(page)[1] == want, page
    assert references('<base target=_top><base href="/b/"><link rel=canonical href=c>') == ("/b/", ["c"])


def test_base_and_very_long_pages(spark):
    filler = "<p title='>'>" + "word " * 400_000
    rows = [_page(1, "http://a.com/x/y", '<base href="../z/">' + filler + '<link rel="canonical" href=" q?r ">'), _page(2, "http://a.com/x/y", "<link rel=canonical " * 20_000)]
    assert [tuple(r) for r in page_links(spark.createDataFrame(rows, PAGES)).collect()] == [("http://a.com/x/y", "http://a.com/z/q?r")]
