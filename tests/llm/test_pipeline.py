import re

import pytest

import corpus_pipeline as P
from mnemotide.llm.packing import word_count
from mnemotide.llm.pii_anchor import all_spans, anchors

from test_span_dedup import _brute, _cut

SF = "/root/testdata/sf0.001"


def _shingles(text, width=5):
    w = re.split(r"[\x20\x09-\x0D]+", text.lower().strip())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    out["input"] = docs.toPandas()
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.toPandas()
    return out


def test_columns_and_ids(stages):
    for name, df in stages.items():
        if name != "packing":
            assert sorted(df.columns) == sorted(P.COLUMNS)
        assert df.doc_id.is_unique
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "span_dedup", "pii", "packing"]


def test_languages_stay(stages):
    before, after = stages["input"].set_index("doc_id"), stages["language_id"].set_index("doc_id")
    assert len(after) >= 0.98 * len(before)
    assert (after.lang == before.lang[after.index]).mean() > 0.97


def test_near_duplicates_equal_brute_force(stages):
    df = stages["language_id"].sort_values("doc_id")
    sets = [_shingles(t) for t in df.text]
    ids, root = list(df.doc_id), list(range(len(df)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(stages["near_dedup"].doc_id) == [ids[i] for i in range(len(ids)) if find(i) == i]


def test_spans_repeat_no_more(stages):
    before, after = stages["near_dedup"].set_index("doc_id"), stages["span_dedup"].set_index("doc_id")
    assert (after.n_chars == after.text.str.len()).all()
    gone = _brute(list(before.text.items()))
    want = {}
    for doc, text in before.text.items():
        drop = gone.get((doc, text), set())
        want[doc] = "".join(t for i, (_, t) in enumerate(_cut(text)) if i not in drop) if drop else text
    assert {d: t for d, t in want.items() if t.strip(" ") or d not in {x for x, _ in gone}} == dict(after.text.items())


def test_personal_data_is_gone(stages):
    a = anchors()
    for t in stages["pii"].text:
        assert not all_spans(t, a)[0]
    assert len(stages["pii"]) == len(stages["span_dedup"])


def test_packing_places_every_document(spark, stages):
    packed = stages["packing"].set_index("doc_id")
    words = spark.createDataFrame(stages["pii"][["doc_id", "text"]]).select("doc_id", word_count("text").alias("n")).toPandas().set_index("doc_id").n
    assert (packed.n_tokens == words[packed.index]).all() and len(packed) == len(words)


def test_run_equals_stages(spark, stages):
    got = P.run(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = stages["packing"].sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns])


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, spans string, accepted string, batch map<string, int>"
PASSAGE = "This passage is long enough that a run of its sentences repeats. It has several sentences of its own. Each of them has words that no other text has here, such as marmalade and lanterns. So it is found wherever it is copied whole. Then it ends."


def _odd(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text) if text is not None else None, None, "x", None, None)


def _odd_rows(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and length(text) between 900 and 3000").orderBy("doc_id").limit(6).collect()]
    rows = [
        _odd(1, texts[0]), _odd(1, texts[0]), _odd(2, texts[0] + " x"), _odd(3, None), _odd(4, ""), _odd(None, texts[1]), _odd(None, None, None, None), _odd(5, texts[2] + " " + PASSAGE), _odd(6, texts[3] + " " + PASSAGE, None, None),
        _odd(7, texts[4] + " call +1 202 555 0147 or mail ann@example.org now"), _odd(8, " ".join(texts) * 60), _odd(9, "12345 !!"), _odd(10, texts[5], "de"),
    ]
    return rows, spark.createDataFrame(rows, ODD).repartition(3)


def test_odd_rows_in_every_stage(spark):
    rows, docs = _odd_rows(spark)
    by = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        by[name] = out.collect()
        if name != "packing":
            assert tuple(out.columns) == P.COLUMNS

    def ids(name):
        return sorted(str(r.doc_id) for r in by[name])

    # without letters or text a document has no language and goes; rows without an id stay, repeated ones together
    assert ids("language_id") == sorted(["1", "1", "2", "5", "6", "7", "8", "10", "None", "None"])
    assert {r.lang for r in by["language_id"] if r.doc_id == 6} == {"en"}  # it had none
    # the near copy of 1 goes; empty texts are near nothing
    assert ids("near_dedup") == sorted(str(r[0]) for r in rows if r[0] != 2)
    cut = {str(r.doc_id): r for r in by["span_dedup"]}
    assert "marmalade" in cut["5"].text and "marmalade" not in cut["6"].text and cut["6"].n_chars == len(cut["6"].text)
    assert sum(r.doc_id is None for r in by["span_dedup"]) == 2 and cut["3"].text is None and cut["4"].text == ""
    clean = {str(r.doc_id): r for r in by["pii"]}
    assert len(by["pii"]) == len(rows) and "[EMAIL]" in clean["7"].text and "[PHONE]" in clean["7"].text and "0147" not in clean["7"].text and clean["3"].text is None
    assert clean["10"].text == rows[-1][1] and clean["10"].n_chars == rows[-1][4]
    packed = by["packing"]
    assert len(packed) == len(rows) and len({(r.bucket, r.batch, r.slot) for r in packed}) == len(rows)
    assert sorted(r.n_tokens for r in packed) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)


def test_stages_on_an_empty_table(spark):
    _, docs = _odd_rows(spark)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
