import random
import re

import numpy as np
import pytest

from mnemotide.llm import span_dedup
from mnemotide.llm.span_dedup import Powers, dedup_spans, sentences

DOCS = "doc_id long, text string, id string, mark int, spans string, h1 int"
P = "One passage has several sentences in it. The second of them is about as long. A third one ends the passage here. And now a fourth comes along, which is longer than those that came before it by far."
M = (1 << 64) - 1


def _mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def _lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def _cut(text, every=6):
    """(words, text) of each sentence, from the rule: word by word, with whole numbers."""
    out, words, start, before = [], [], 0, 0
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    for n, m in enumerate(found):
        word = _lower(m.group())
        b = word.encode()
        h = _mix((sum(c * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(b)) + len(b)) & M)
        words.append(word)
        behind = found[n + 1].start() if n + 1 < len(found) else len(text)
        if word[-1] in ".!?" or "\n" in text[m.end() : behind] or n + 1 == len(found) or (_mix((h + _mix(before)) & M) >> 32) % every == 0:
            out.append((tuple(words), text[start:behind]))
            words, start = [], behind
        before = h
    return out


def _brute(rows, least=2, least_words=24, every=6):
    """Removed sentences of each row, by comparing the words of all runs themselves. Texts of one id come in any order."""
    first, spans, marked = {}, [], {}
    for doc, text in sorted({(d, t) for d, t in rows if d is not None and t is not None}):
        cut = [w for w, _ in _cut(text, every)]
        n, own = len(cut), []
        for i in range(n):
            last = next((j for j in range(i + least - 1, n) if sum(map(len, cut[i : j + 1])) >= least_words), None)
            if last is not None:
                own.append((i, last))
        back = next((i for i in range(n - least, -1, -1) if sum(map(len, cut[i:])) >= least_words), None)
        if back is not None:
            own.append((back, n - 1))
        for i, j in sorted(set(own)):
            key = sum(cut[i : j + 1], ())
            if first.setdefault(key, (doc, text, i)) != (doc, text, i):
                spans.append((doc, text, i, j))
    for doc, text, i, j in spans:
        marked.setdefault((doc, text), set()).update(range(i, j + 1))
    return marked


def _check(spark, rows, table=None):
    table = table or [(d, t, "x", 1, "y", 2) for d, t in rows]
    got = dedup_spans(spark.createDataFrame(table, DOCS), keep=("mark",)).collect()
    assert len(got) == len(table)
    gone, by = _brute(rows), {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in set(rows):
        cut = _cut(text or "")
        drop = gone.get((doc, text), set())
        want = text if not drop else "".join(t for i, (_, t) in enumerate(cut) if i not in drop)
        assert any(r.clean_text == want and r.n_removed == len(drop) and r.n_sentences == len(cut) for r in by[doc]), (doc, want)
    return by


def test_matches_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(70)) + "."
    rows = [
        (1, "Before it something else is said. " + P + " After it."),
        (2, P),
        (3, "Quite another text. With a few words. It stays as it is now, all of it and more."),
        (4, "Start.\n" + P.upper().replace(" ", "  ") + "\nEnd of it."),
        (5, long), (6, "Lead in. " + long), (7, "a. b. c. d. e."), (8, "a. b. c. d. e."),
        (9, "x y z one two.\n" * 12), (10, ""), (11, None), (12, P + " " + P), (12, P + " " + P),
        (13, "!!! ... ?\n\n"), (14, "THE!! OF!! " * 20), (15, "THE!! OF!! " * 21), (16, "  \u00e9t\u00e9 " + P + "\u3000"),
    ]
    by = _check(spark, rows, [(d, t, "x", 1, "y", 2) for d, t in rows] + [(None, P, None, None, None, None)])
    assert by[2][0].clean_text == "" and by[1][0].n_removed == 0 and by[11][0].clean_text is None
    assert by[5][0].n_removed == 0 and len(by[6][0].clean_text) < 30
    assert by[None][0].clean_text == P and by[8][0].n_removed == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_match_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh\u00e9") for _ in range(rng.randint(1, 6))) for _ in range(300)]

    def some(n):
        return " ".join(rng.choice(vocab) + rng.choice(["", "", "", "", ".", ",", "\n"]) for _ in range(n))

    shared = [some(60) for _ in range(6)]
    rows = [(i, some(rng.randint(0, 60)) + " " + " ".join(rng.choice([*shared, some(20), some(5)]) for _ in range(rng.randint(0, 4)))) for i in range(80)]
    _check(spark, rows)


def test_passages_that_begin_and_end_inside_sentences_are_found(spark):
    rng = random.Random(4)

    def some(n, marks):
        return [f"v{rng.randrange(10**9)}" + ("." if marks and rng.random() < 1 / 12 else "") for _ in range(n)]

    for marks, least in ((True, 0.97), (False, 0.9)):
        rows = []
        for k in range(200):
            passage = some(51, marks)
            rows += [(2 * k, " ".join(some(rng.randrange(40), marks) + passage + some(30, marks))), (2 * k + 1, " ".join(some(rng.randrange(40), marks) + passage + some(25, marks)))]
        got = {r.doc_id: r.n_removed for r in dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert not any(got[2 * k] for k in range(200))
        assert sum(got[2 * k + 1] > 0 for k in range(200)) >= least * 200


def test_other_texts_under_one_id_are_others(spark):
    rows = [(1, P + " One."), (1, P + " Two."), (2, "Lead. " + P)]
    got = dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_removed > 0 for r in got if r.doc_id == 1) == [False, True] and all(r.n_removed for r in got if r.doc_id == 2)


def test_rows_that_repeat_are_one_document_and_order_does_not_matter(spark):
    rows = [(d, P + f" {d % 3}.") for d in [*range(40, 0, -1), 1, 1, 40]] + [(d, "Own. " * 30) for d in (7, 7, 70)]
    for parts in (1, 5):
        got = dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert len(got) == len(rows) and {r.doc_id for r in got if not r.n_removed} == {1}
        assert {(r.doc_id, r.n_removed) for r in got if r.clean_text.startswith("Own")} == {(7, 29)}


def test_a_task_passes_on_few_places_of_a_common_run():
    common = span_dedup.Common()
    rng = random.Random(3)
    passed = 0
    for part in range(400):
        rows = np.array([[5, 9], [6, 9], [rng.randrange(10**9), part], [0, 0]], np.int64)
        passed += int((~common.behind(rows, np.array([True, False])))[0])
    assert passed < 25 and common.rows.shape[1] == 1


def test_long_texts_are_hashed_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))
    with np.errstate(over="ignore"):
        whole = sentences([text.encode()], 6, Powers(span_dedup._BYTE_BASE))
        monkeypatch.setattr(span_dedup, "_CHUNK", 50)
        parts = sentences([text.encode()], 6, Powers(span_dedup._BYTE_BASE))
    assert (whole.words == parts.words).all() and (whole.start == parts.start).all() and len(whole.words) == 3000
    monkeypatch.undo()
    huge = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    got = {r.doc_id: r for r in dedup_spans(spark.createDataFrame([(1, huge), (2, "Lead. " + huge)], "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_sentences - got[2].n_removed <= 8


def test_empty_table(spark):
    assert dedup_spans(spark.createDataFrame([], DOCS)).collect() == []
