import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from mnemotide.llm.packing import optimal_boundaries, pack

DOCS = "doc_id long, text string, bucket string, batch int, n int"


def _cost(levels, counts, bounds):
    return sum(c * min(b for b in bounds if b >= v) for v, c in zip(levels, counts))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=9, unique_by=lambda x: x[0]), st.integers(1, 5))
def test_boundaries_are_optimal(rows, buckets):
    rows.sort()
    levels, counts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = optimal_boundaries(levels, counts, buckets)
    k = min(buckets, len(rows))
    best = min(_cost(levels, counts, [*c, levels[-1]]) for c in itertools.combinations(levels[:-1], k - 1))
    assert len(got) == k and _cost(levels, counts, got) == best


def test_batches_keep_to_the_budget_and_lose_no_row(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), "x", 1, 2) for i in range(400)] + [(5, "w w", "x", 1, 2), (5, "w w", "x", 1, 2), (None, None, None, None, None), (7000, "w " * 500, "x", 1, 2)]
    got = pack(spark.createDataFrame(rows, DOCS), budget=100, buckets=4, shard_rows=1).toPandas()
    assert len(got) == len(rows)
    assert (got.n_tokens <= got.padded_length).all()
    for (_, _), part in got.groupby(["bucket", "batch"]):
        assert len(part) == 1 or len(part) * part.padded_length.iloc[0] <= 100
        assert sorted(part.slot) == list(range(len(part)))
    for _, part in got.groupby("bucket"):
        full = part.groupby("batch").size().sort_index()
        assert (full.iloc[:-1] == max(1, 100 // max(1, part.padded_length.iloc[0]))).all()
    assert got.n_tokens.max() == 500


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], DOCS)).collect() == []


def test_lengths_beyond_the_budget_pad_to_real_lengths(spark):
    rows = [(i, None, n) for i, n in enumerate([5001, 20001, 20008, 3, 70001])]
    got = {r.doc_id: r for r in pack(spark.createDataFrame(rows, "doc_id long, text string, n long"), buckets=5, length=F.col("n")).collect()}
    assert {i: r.padded_length for i, r in got.items()} == {i: n for i, _, n in rows}


def test_numbers_do_not_depend_on_the_shards(spark):
    docs = spark.range(0, 3 * 1024 * 1024, 1024).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    few, many = (sorted(map(tuple, pack(docs, budget=50, shard_rows=n).collect())) for n in (10**9, 1))
    assert few == many and len(few) == 3072
