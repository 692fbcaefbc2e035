import random

import numpy as np
import pytest

from mnemotide.llm.minhash import _block_pairs, _Words, fast_similarity_sketch, intersections, near_duplicates, shingle_set

DOCS = "doc_id long, text string, n int, rep long, home long, component_id long, kept boolean"


def _sets(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def _brute(rows, width, percent):
    ids = sorted({d for d, _ in rows if d is not None})
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, _sets(t, width)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def _text(rng, n, edits=0, base=None):
    words = list(base) if base else [f"w{rng.randrange(5000)}" for _ in range(n)]
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_sketch_coordinates_estimate_similarity():
    rng = np.random.default_rng(2)
    for j in (0.5, 0.85):
        hits = []
        for _ in range(60):
            shared = rng.integers(1, 2**63, int(300 * j), dtype=np.uint64)
            rest = rng.integers(1, 2**63, (2, (300 - len(shared)) // 2), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([shared, r])) for r in rest)
            hits.append((fast_similarity_sketch(a, 128) == fast_similarity_sketch(b, 128)).mean())
        assert abs(np.mean(hits) - len(shared) / (len(shared) + 2 * rest.shape[1])) < 0.03


@pytest.mark.parametrize("n", [1, 2, 7, 40, 3000])
def test_every_coordinate_is_filled(n):
    s = fast_similarity_sketch(np.unique(np.random.default_rng(n).integers(1, 2**63, n, dtype=np.uint64)), 160)
    assert (s != np.iinfo(np.uint64).max).all() and len(s) == 160


def test_intersections_are_exact():
    rng = random.Random(1)
    sets = [np.unique(np.array([rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))], np.uint64)) for _ in range(12)]
    for a, b in ((sets, sets), (sets[:5], sets[5:])):
        got = intersections(a, b, columns=7)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if a is not b or i != j:
                    assert got[i, j] == len(set(x.tolist()) & set(y.tolist()))


def test_words_follow_the_contract():
    words = _Words()
    same = [shingle_set(t, 3, words).tolist() for t in ("A b c\tD", "a b c d", " a\x0bb c \r\n d ")]
    assert same[0] == same[1] == same[2] and len(same[0]) == 1
    assert shingle_set("É a b", 3, words).tolist() != shingle_set("é a b", 3, words).tolist()
    assert len(shingle_set("x", 3, words)) == 1 and len(shingle_set(" \n", 3, words)) == 0 and len(shingle_set(None, 3, words)) == 0


@pytest.mark.parametrize(("width", "percent", "block_rows", "block_shingles"), [(3, 85, 256, 1 << 20), (5, 80, 4, 900)])
def test_equals_brute_force(spark, width, percent, block_rows, block_shingles):
    rng = random.Random(7)
    rows, doc = [], 0
    for size in (60, 120, 200):
        base = _text(rng, size)
        for _ in range(25):
            rows.append((doc, " ".join(_text(rng, size, rng.randrange(0, size // 8), base))))
            doc += 1
    chain = _text(rng, 150)
    for _ in range(12):  # each close to the one before, the ends far apart
        chain = _text(rng, 150, 3, chain)
        rows.append((doc, " ".join(chain)))
        doc += 1
    rows += [(doc + i, " ".join(_text(rng, 30))) for i in range(30)]
    rows += [(900, "same text here"), (901, "Same  TEXT here"), (902, ""), (903, None), (904, "  "), (905, "one"), (906, "one"), (907, "one two"), (907, "one two"), (908, "x " * 60_000), (909, "x " * 50_000), (None, "same text here")]
    rng.shuffle(rows)
    got = near_duplicates(spark.createDataFrame([(d, t, 1, 2, 3, 4, None) for d, t in rows], DOCS), width, percent, block_rows=block_rows, block_shingles=block_shingles).collect()
    assert len(got) == len(rows)
    want = _brute(rows, width, percent)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), r
    sizes = {d: len(_sets(t, width)) for d, t in rows if d is not None}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)
    assert len(set(want.values())) < len(want) - 25


@pytest.mark.parametrize(("block_rows", "block_shingles"), [(5, 10**6), (10**6, 50)])
def test_every_pair_of_a_group_meets_in_one_task(spark, block_rows, block_shingles):
    members = spark.createDataFrame([(g, i, 10) for g, size in ((1, 40), (2, 3), (3, 1)) for i in range(size)], "g long, id long, n long")
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id long, text string")
    tasks = {}
    for r in _block_pairs(members, texts, block_rows, block_shingles).collect():
        assert r.text == f"t{r.id}" and r.a <= r.b and r.side in (r.a, r.b)
        tasks.setdefault((r.g, r.a, r.b), []).append((r.id, r.side))
    assert max(b for _, _, b in tasks) == 7 and all(b == 0 for g, _, b in tasks if g != 1)
    met = [(g, i, j) for (g, a, b), rows in tasks.items() for i, x in rows for j, y in rows if i < j and (a == b or x != y)]
    assert len(met) == len(set(met)) == 40 * 39 // 2 + 3


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
