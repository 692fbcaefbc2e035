import math

import numpy as np
from pyspark.sql import functions as F

from mnemotide.llm import langid
from mnemotide.llm.queries import language_of_pages, op8_language_evidence

SF = "/root/testdata/sf0.01"
ROWS = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the house and the tree", "en"), (4, "das haus und der baum", "de"), (5, "the the and", "en")]


def _model():
    return langid.fit(np.stack([langid.counts_of(t) for _, t, _ in ROWS]), [n for _, _, n in ROWS])


def test_fusion_equals_brute_force(spark):
    m = _model()
    data = [(1, "the dog", "a.b.de", "de"), (2, "der baum", "a.b.de", None), (3, "the the the", "c.b.de", "en"), (4, "", "a.b.de", "de"), (5, None, None, None), (6, "und und", "x.org", "xx"), (6, "und und", "x.org", "xx")]
    rows = spark.createDataFrame(data, "doc_id long, text string, host string, said string")
    got = {(r.doc_id, r.language): r for r in langid.identify(rows, m, host=F.col("host"), declared=F.col("said")).collect()}
    like, share = {}, {}
    for i, (_, text, _, _) in enumerate(data):
        c = langid.counts_of(text or "").astype(float)
        n = c.sum()
        mean = m.log_p @ c / max(n, 1)
        row = mean * min(n, 60.0)
        known = any(x.isalpha() for x in text or "") and (mean.max() >= m.floor or n < 20)
        like[i] = row - row.max() if known else row * 0
        share[i] = np.exp(like[i]) / np.exp(like[i]).sum() if known else row * 0
    keys = [((h or "").split(".")[-1], ".".join((h or "").split(".")[-2:]), h or "") for _, _, h, _ in data]
    every = sum(share.values())
    for i, (doc, _, _, said) in enumerate(data):
        w = (every + 1) / (every.sum() + 2)
        for level in range(3):
            own = np.maximum(sum(share[j] for j in range(len(data)) if keys[j][: level + 1] == keys[i][: level + 1]) - share[i], 0)
            w = (own + 20 * w) / (own.sum() + 20)
        post = like[i] + np.log(w)
        for at, name in enumerate(m.languages):
            if said in m.languages:
                post[at] += math.log(0.8 if said == name else 0.2)
            if keys[i][0] == "de":
                post[at] += math.log(0.6 if name == "de" else 0.4)
        p = np.exp(post - post.max())
        best = m.languages[int(post.argmax())]
        assert abs(got[doc, best].probability - p.max() / p.sum()) < 1e-9, (doc, got)
    assert not got[4, "de"].accepted and len(got) == 6


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_on(docs.where("doc_id % 2 = 0"), sample_rows=300)
    got = langid.identify(docs, model, host=F.col("source"), keep=("lang",)).where("doc_id % 2 = 1").toPandas()
    assert (got.language == got.lang).mean() > 0.98 and got.accepted.mean() > 0.98
    assert op8_language_evidence(spark, SF).count() == docs.count()
    assert language_of_pages(spark, SF).where("accepted").count() > 230


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x" * 200_000, "en", "h"), (None, "the dog", None, None), (2, "12345 !!", "de", "h"), (2, "12345 !!", "de", "h")], "doc_id long, text string, lang string, _host string")
    got = langid.identify(docs, _model(), host=F.col("_host"), keep=("_host",)).collect()
    assert len(got) == 4 and not any(r.accepted for r in got if r.doc_id == 2)
    assert langid.identify(docs.where(F.lit(False)), _model()).collect() == []
    none = langid.fit_on(docs.where(F.lit(False)))
    assert {r.language for r in langid.identify(docs, none).collect()} == {None}


def test_declared_and_host(spark):
    row = spark.createDataFrame([('<!DOCTYPE html><HTML class="x" LANG="fr-CA"><p>', "https://u:p@News.Example.FR:80/x?y://z")], "html string, url string")
    assert tuple(row.select(langid.declared_in(F.col("html")), langid.host_of(F.col("url"))).first()) == ("fr", "news.example.fr")


def test_language_declared_behind_a_long_comment(spark):
    pages = spark.createDataFrame([("<!-- " + "x" * 50_000 + " -->\n<HTML class='a' lang='de'>",), ("y" * 5000,)], "html string")
    assert [r[0] for r in pages.select(langid.declared_in(F.col("html"))).collect()] == ["de", None]
