import math

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemotide.llm.sp_nbest import Pieces, Segmenter, decoded, default_model, nbest_pieces

TOY = Pieces([("a", -3.0, 10), ("b", -4.0, 11), ("ab", -5.0, 12), ("aba", -7.5, 13), ("▁", -1.0, 14), ("▁a", -2.5, 15), ("ba", -6.0, 16), ("!", -2.0, 17), ("!!", -3.0, 18)], {i: 100 + i for i in range(256)}, 0)


def _brute(pieces, text):
    """Scores and ids of all segmentations of a text, best first."""
    text = "▁" + text.replace(" ", "▁") if text else ""
    table = {p: (s, (i,)) for p, s, i in pieces.pieces}
    out = []

    def walk(at, score, ids):
        if at == len(text):
            out.append((score, ids))
        for j in range(at + 1, len(text) + 1):
            hit = table.get(text[at:j])
            if hit is None and j == at + 1:
                hit = (pieces.unknown_score, tuple(pieces.byte_ids[b] for b in text[at].encode()))
            if hit:
                walk(j, score + hit[0], ids + hit[1])

    walk(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


ACROSS = Pieces([*TOY.pieces, ("a▁b", -4.0, 19), ("▁▁", -1.5, 20)], TOY.byte_ids, 0)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab! é", max_size=9), st.integers(1, 6), st.sampled_from([TOY, ACROSS]))
def test_equals_brute_force(text, n, pieces):
    every = _brute(pieces, text)
    m = Segmenter(pieces, n)
    for got in (m.encode(text), m.encode(text)):
        assert [s for s, _ in got] == pytest.approx([s for s, _ in every[:n]])
        assert len({tuple(i) for _, i in got}) == len(got)
        for score, ids in got:
            assert any(tuple(ids) == i and math.isclose(score, s) for s, i in every)
            assert m.decode(ids) == text
    (ways, back), _ = m.encode_all(pa.array([text, "b a"]))
    assert back == text and [s for s, _ in ways] == pytest.approx([s for s, _ in every[:n]])


def test_long_and_repetitive_texts():
    m = Segmenter(TOY, 4)
    for text, ways in (("a" * 20_000, 2), ("ab" * 10_000, 4), ("é" * 5_000, 1), ("a b " * 5_000, 4)):
        got = m.encode(text)
        assert len(got) == ways and all(m.decode(i) == text for _, i in got)
        assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


def test_small_cache_gives_the_same():
    big, small = Segmenter(TOY, 3), Segmenter(TOY, 3, capacity=2)
    for text in ("ab a!b ab", "b!! aba a", "ab a!b ab"):
        assert big.encode(text) == small.encode(text)


def test_public_model_round_trip(spark):
    pieces = default_model(spark)
    rows = [(1, "Plain words, two  blanks.", "x", 1), (1, "Plain words, two  blanks.", "x", 1), (2, None, None, None), (3, "", "", 0), (None, "\n\ttabs ▁ é 漢字 🙂", "y", 2), (4, " lead and trail ", "z", 3), (5, "word " * 30_000, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, scores int")
    got = nbest_pieces(docs, pieces, nbest=3, with_ids=True)
    texts = {r.doc_id: r.text for r in decoded(got.selectExpr("doc_id", "ids[0] as ids"), pieces).collect()}
    back = {r.doc_id: r for r in got.collect()}
    for doc, text, _, _ in rows:
        want = (text or "").replace("▁", " ")  # the blank's mark itself reads as a blank
        assert texts[doc] == want and back[doc].round_trip == (want == (text or ""))
    assert back[2].n_pieces == 0 and back[2].scores == [0.0] and len(back[1].scores) == 3
    assert nbest_pieces(spark.createDataFrame([], docs.schema), pieces).collect() == []


def test_best_score_is_not_below_the_library(spark):
    import sentencepiece

    pieces = default_model(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    m = Segmenter(pieces, 2)
    for text in ("The quick brown fox", "einheitlich und gut", "l'été dernier"):
        ids = sp.encode(text)
        assert m.encode(text)[0][0] >= sum(sp.get_score(i) for i in ids) and m.decode(ids) == text


def test_many_of_many_words():
    import time

    words = ["ab" * (1 + i % 3) + "a" * (i % 4) + "!" * (i % 3) for i in range(30)]
    m = Segmenter(TOY, 32)
    began = time.perf_counter()
    ways, back = m.joined(" ".join(words))
    assert time.perf_counter() - began < 1 and len(ways) == 32 and back == " ".join(words)
    scores = [s for s, _ in ways]
    assert scores == sorted(scores, reverse=True) and len({w for _, w in ways}) == 32


def _best_scores(pieces, text, n):
    """Scores of the n best segmentations of a whole text, with the n best of every place and without cutting it."""
    text, table = "▁" + text.replace(" ", "▁"), {p: s for p, s, _ in pieces.pieces}
    best, longest = [[0.0]], max(map(len, table))
    for j in range(1, len(text) + 1):
        ways = []
        for i in range(max(0, j - longest), j):
            score = table.get(text[i:j], pieces.unknown_score if i == j - 1 else None)
            if score is not None:
                ways += [b + score for b in best[i]]
        best.append(sorted(ways, reverse=True)[:n])
    return best[-1]


def test_query_gives_the_eight_best(spark):
    from mnemotide.llm.queries import op7_sentencepiece_nbest

    got = {r.doc_id: r for r in op7_sentencepiece_nbest(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 40 and 1500").orderBy("doc_id").limit(20).collect()
    pieces = default_model(spark)
    assert docs
    for d in docs:
        r = got[d.doc_id]
        assert len(r.scores) == 8 == len(set(r.digests)) and r.scores == pytest.approx(_best_scores(pieces, d.text, 8), rel=1e-9)


def test_only_what_a_text_asks_for_is_searched():
    m = Segmenter(TOY, 3)
    text = " ".join("ab" * i for i in range(1, 40))
    ways, _ = m.joined(text)
    assert [s for s, _ in ways] == pytest.approx(_best_scores(TOY, text, 3)) and len(m.searched) <= 2 < len(m)


def test_each_of_the_best_is_decoded(spark):
    """Without byte pieces a character that has no piece of its own is lost where a way takes it alone, and only there."""
    pieces = Pieces([("▁", -1.0, 3), ("b", -1.0, 4), ("ab", -1.5, 5), ("▁b", -1.2, 6), ("!", -1.0, 7)], {}, 0)
    rows = [(1, "ab b! ab"), (2, "b b"), (3, "ab"), (4, ""), (5, None), (6, " ab  b"), (7, "a b")]
    got = {r.doc_id: r for r in nbest_pieces(spark.createDataFrame(rows, "doc_id long, text string"), pieces, nbest=6, with_ids=True).collect()}
    m = Segmenter(pieces, 6)
    for doc, text in rows:
        r = got[doc]
        assert r.round_trips == [m.decode(ids) == (text or "") for ids in r.ids] and r.round_trip == r.round_trips[0]
    assert got[3].round_trips[0] and not all(got[3].round_trips) and all(got[2].round_trips) and not any(got[7].round_trips)
