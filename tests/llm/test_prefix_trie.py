"""The trie against a plain one over whole texts, with long, repeated, null and absent turns."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from mnemotide.llm import prefix_trie
from mnemotide.llm.prefix_trie import conversation_trie

ROWS = "conv_id long, turn long, role string, text string, depth string, a long"


def _brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = turns.get(base, [])[:h] + own[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                kids[tuple(s[: d - 1])].add(tuple(s[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids.get(k)
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, ())), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _found(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def _rows():
    rng = random.Random(3)
    words = ["", "a", "é😀", "b" * 50, None]
    rows = [(c, t, rng.choice(["user", None, ""]), rng.choice(words), "x", 1) for c in [*range(0, 30), *range(95, 130), *range(-105, -95), 777] for t in range(rng.choice([1, 2, 3, 9]))]
    rows += [(5, None, "user", "first", "x", 1), (5, None, None, "first", "x", 1), (6, 0, "user", "tie", "x", 1), (6, 0, "user", "tie", "x", 1), (None, 0, "user", "no one", "x", 1)]
    rows += [(100, t, "user", f"deep {t}", "x", 1) for t in range(40)] + [(101, t, "user", f"deep {t}", "x", 1) for t in range(40)]
    return rows + [(300 + c, t, "user", "same", "x", 1) for c in range(60) for t in range(2)] + [(901, 0, "user", "long " * 40_000, "x", 1)]


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)  # the hash of a list in several pieces
    rows = _rows()
    df = spark.createDataFrame(rows, ROWS).repartition(9)
    assert _found(conversation_trie(df)) == _brute(rows)
    assert conversation_trie(spark.createDataFrame([], ROWS)).collect() == []


def test_a_chain_takes_rounds_by_the_bits_of_its_depth(spark):
    rows = [(c, t, "user", f"turn {t}", "x", 1) for c in (0, 1) for t in range(300)]
    got = conversation_trie(spark.createDataFrame(rows, ROWS)).orderBy("depth").collect()
    assert len(got) == 301 and got[0].n_leaves == 1 and got[0].saved_tokens == sum(len(f"turn {t}") for t in range(300))


@pytest.mark.parametrize("n", [0, 7, 123456789, -45])
def test_crc_in_sql(n):
    import duckdb

    from mnemotide.llm.queries import CRC_TABLE, crc_sql

    assert duckdb.sql(f"with {CRC_TABLE} select {crc_sql('n')} from (select {n} as n), crc").fetchall()[0][0] == zlib.crc32(str(n).encode())

