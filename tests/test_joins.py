"""Containment joins, lessons and substring search against plain loops, with a session that holds nearly all rows."""

import random

from pyspark.sql import functions as F

from mnemotide.operators import dynamics
from mnemotide.operators.containment import contained_sets
from mnemotide.operators.substrings import GramIndex
from mnemotide.scratch import Scratch

NODES = "id string, session string, kind string, query string, result_count int, latency_ms int, status string, sec long"


def _nodes(n, seed=2):
    rng = random.Random(seed)
    words = [f"word{i:03d}" for i in range(60)]
    rows = []
    for i in range(n):
        kind = rng.choice(["tool_call", "tool_call", "resolved", "decision"])
        text = " ".join(rng.sample(words, rng.choice([1, 2, 3, 5]))) if rng.random() < 0.95 else rng.choice(["", "a b", None])
        rows.append((f"n{i:04d}", "hot" if i % 10 else "cold", kind, text, rng.choice([0, 1, None]), rng.choice([10, 5000, None]), rng.choice(["active", "active", "void"]), rng.randrange(n // 2)))
    return rows


def _words(text):
    return {w for w in (text or "").split() if len(w) >= 4}


def _lessons(rows, share=0.34):
    best = {}
    hard = [r for r in rows if r[2] == "tool_call" and r[6] == "active" and (r[4] == 0 or (r[5] or 0) > 2000) and _words(r[3])]
    done = [r for r in rows if r[2] != "tool_call" and r[6] == "active"]
    for h in hard:
        k = _words(h[3])
        fits = [(-s, d[7], d[0]) for d in done if d[1] == h[1] and d[7] > h[7] and (s := len(k & _words(d[3])) / max(3, len(k))) >= share]
        if fits:
            s, _, d = min(fits)
            best.setdefault(d, []).append((s, h[7], h[0]))
    return sorted((min(v)[2], d, round(-min(v)[0], 9)) for d, v in best.items())


def test_lessons_equal_all_pairs(spark):
    rows = _nodes(700)
    df = spark.createDataFrame(rows, NODES).withColumn("ts", F.timestamp_seconds("sec")).repartition(5)
    got = sorted((r.struggle, r.resolution, round(r.score, 9)) for r in dynamics.lessons(df).collect())
    assert got == _lessons(rows) != []
    assert dynamics.lessons(df.limit(0)).collect() == []


def test_sets_meet_on_rare_words(spark):
    rng = random.Random(1)
    sets = [rng.sample([f"w{i}" for i in range(12)], rng.randrange(1, 6)) for _ in range(150)]
    df = spark.createDataFrame([("s", s) for s in sets] + [("s", []), ("t", ["w1"])], "session string, words array<string>")
    for share in (0.34, 0.5, 1.0):
        got = {(r.left_key, r.right_key): round(r.score, 9) for r in contained_sets(df.where("session = 's'"), df, "session", share, least=3).collect()}
        want = {}
        for a in sets:
            for b in sets:
                score = len({*a} & {*b}) / max(3, len({*a}))
                if score >= share:
                    want[" ".join(sorted(a)), " ".join(sorted(b))] = round(score, 9)
        assert got == want


def test_substrings_by_grams(spark):
    rows = [("a", "Parsers and CACHES", None), ("b", None, "the cache"), ("c", "é😀x", ""), ("d", "ca ch e", "pars er"), ("e", "", None), ("f", "x" * 50_000 + "needle", None)]
    df = spark.createDataFrame(rows, "id string, query string, preview string")
    index = GramIndex(df, "id", ["query", "preview"], Scratch(spark, "g"))
    asked = spark.createDataFrame([(w,) for w in ("cache", "CACHE", "parser", "é😀x", "needle", "absent", "ca", None, "xneed")], "word string")
    assert sorted((r.word, r.id) for r in index.words_in(asked).collect()) == [("cache", "a"), ("cache", "b"), ("needle", "f"), ("parser", "a"), ("xneed", "f"), ("é😀x", "c")]
    assert index.candidates(asked.where("word = 'absent'")).count() == 0
    none = GramIndex(df.limit(0), "id", ["query"], Scratch(spark, "g"))
    assert none.words_in(asked).collect() == []


def test_index_reads_few_candidates(spark):
    rng = random.Random(3)
    syllables = ["ba", "ke", "lo", "mi", "tu", "ra", "si", "no"]
    df = spark.createDataFrame([(str(i), " ".join("".join(rng.choices(syllables, k=4)) for _ in range(6))) for i in range(1500)], "id string, query string")
    index = GramIndex(df, "id", ["query"], Scratch(spark, "g"))
    asked = spark.createDataFrame([("bakelomi",), ("sinotura",)], "word string")
    got = sorted((r.word, r.id) for r in index.words_in(asked).collect())
    assert got == sorted((w, r.id) for r in df.collect() for w in ("bakelomi", "sinotura") if w in r.query)
    assert index.candidates(asked).count() < 1200  # of 3,000 pairs
