"""Search over blocks: the same rows as the plain scan, from a part of the blocks."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemotide.operators.blockmax import BlockIndex
from mnemotide.operators.retrieval import hybrid_search
from mnemotide.scratch import Scratch

SCHEMA = "id string, session string, status string, importance int, ts timestamp, query string, embedding array<double>, block_note string"

def _now():
    return F.lit("2024-02-01").cast("timestamp")


def _rows(spark, m, odd=()):
    rng = np.random.default_rng(1)
    words = ["cache", "parser", "limit", "retry"]
    rows = [
        (f"n{i:04d}", f"s{i % 3}", "void" if i % 11 == 0 else "active", None if i % 17 == 0 else i % 10 + 1, None if i % 13 == 0 else f"2024-01-{i % 28 + 1:02d} 00:00:00", None if i % 7 == 0 else f"the {words[i % 4]} of {rng.integers(9)}", [float(x) for x in v], "x")
        for i, v in enumerate(m)
    ]
    rows += [(f"o{i}", "s0", "active", 10, "2024-01-31 00:00:00", "cache parser", v, None) for i, v in enumerate(odd)]
    plain = SCHEMA.replace("ts timestamp", "ts string")
    return spark.createDataFrame(rows, plain).withColumn("ts", F.col("ts").cast("timestamp"))


def _same(index, nodes, question, asked, scratch, **kw):
    got = [(r.id, round(r.score, 9) if r.score is not None else None) for r in index.search(question, asked, _now(), scratch, **kw).orderBy(F.desc("score"), "id").collect()]
    kw.pop("first", None)
    want = [(r.id, round(r.score, 9) if r.score is not None else None) for r in hybrid_search(nodes, question, asked, _now(), **kw).collect()]
    assert got == want
    return got


@pytest.mark.parametrize("block_rows", [20, 10_000])
def test_search_over_blocks_equals_the_plain_scan(spark, tmp_path, block_rows):
    rng = np.random.default_rng(7)
    m = rng.standard_normal((240, 8))
    m[5:9] = m[4]  # ties
    odd = [None, [0.0] * 8, [float("nan")] * 8, [1.0] * 3, [1.0] * 7 + [None], [float("inf")] + [0.0] * 7, []]
    nodes = _rows(spark, m, odd)
    scratch = Scratch(spark, "t")
    index = BlockIndex.build(nodes, str(tmp_path / "i"), 8, block_rows=block_rows)
    assert index.rows.count() == nodes.count()
    for at, question in ((4, "why does the parser cache"), (77, "what changed today"), (0, "a b")):
        asked = [float(x) for x in m[at]]
        for kw in ({}, {"k": 3, "first": 1}, {"k": 500}, {"session": "s1", "k": 4}):
            _same(index, nodes, question, asked, scratch, **kw)
    _same(index, nodes, "cache", [0.0] * 8, scratch)


def test_blocks_that_cannot_hold_a_result_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((40, 16))
    m = np.concatenate([c / np.linalg.norm(c) + 0.02 * rng.standard_normal((50, 16)) for c in middles])
    nodes = _rows(spark, m)
    scratch = Scratch(spark, "t")
    index = BlockIndex.build(nodes, str(tmp_path / "i"), 16, block_rows=50)
    asked = [float(x) for x in m[60]]
    _same(index, nodes, "what does the parser do", asked, scratch)
    every, read = index.blocks.agg(F.sum("n")).first()[0], index.to_read("what does the parser do", asked, _now(), scratch).agg(F.sum("n")).first()[0]
    assert every == len(m) and read < 0.25 * every, (read, every)
    text = io.StringIO()
    with redirect_stdout(text):
        index.search("what does the parser do", asked, _now(), scratch).explain("formatted")
    assert "dynamicpruning" in text.getvalue().lower()


def test_an_empty_table_finds_nothing(spark, tmp_path):
    nodes = _rows(spark, np.ones((1, 4))).where("false")
    index = BlockIndex.build(nodes, str(tmp_path / "i"), 4)
    assert index.search("cache", [1.0] * 4, _now(), Scratch(spark, "t")).collect() == []
