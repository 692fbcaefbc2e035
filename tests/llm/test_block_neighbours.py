"""Nearest neighbours against brute force, with copies, ties, odd vectors and tight clusters."""

import math

import numpy as np
import pytest

from mnemotide.llm.block_neighbours import _search, codes, cosines, nearest_neighbours, tile_products
from mnemotide.llm.vec_dedup import unit

VECS = "vec_id long, embedding array<float>, label int, ids string, block string, score double"
NAN, INF = float("nan"), float("inf")


def _rows(mat, start=0):
    return [(start + i, [float(np.float32(x)) for x in v], 0, "x", "x", 1.0) for i, v in enumerate(mat)]


def _odd(start):
    vecs = [None, [1.0, None, 0.5], [NAN, 1.0, 1.0], [INF, 0.0, 1.0], [], [0.0, 0.0, 0.0], [1.0, 2.0], [2.0, 4.0]]
    return [(start + i, v, 0, "x", "x", 1.0) for i, v in enumerate(vecs)]


def _brute(rows, k, every):
    good = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        asks = min(v for i, v in good if i == q)
        near = [(-float(cosines(np.array([asks]), np.array([v]))[0]), i) for i, v in good if i != q and len(v) == len(asks)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(near)[:k])]
    return out


@pytest.mark.parametrize(("tile", "block"), [(3, 7), (2048, 8192)])
def test_neighbours_equal_brute_force(spark, tile, block):
    rng = np.random.default_rng(4)
    ball = np.array([[1.0, 0.2, -0.5]]) + rng.standard_normal((40, 3)) * 1e-5  # nearer to each other than codes can tell
    rows = _rows(rng.integers(-2, 3, (50, 3))) + _rows(ball, 60) + _odd(100) + _rows(np.repeat(ball[:1], 12, axis=0), 200) + _rows(ball[:3] * 2, 300)
    rows += rows[:3] + [(10, [0.5, 0.5, -1.0], 0, "x", "x", 1.0), (None, [1.0, 1.0, 1.0], 0, "x", "x", 1.0)] + _rows([[3e38, 3e38, 1.0], [1e-30, 2e-30, 0.0]], 105)
    df = spark.createDataFrame(rows, VECS).repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest_neighbours(df, lambda c: c % 5 == 0, 6, tile, block).collect())
    assert got == _brute(rows, 6, 5)


def test_few_and_no_candidates(spark):
    got = nearest_neighbours(spark.createDataFrame(_rows(np.eye(3)), VECS), lambda c: c == 0, 5).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 1), (2, 2)]
    assert nearest_neighbours(spark.createDataFrame(_rows(np.eye(1)), VECS), lambda c: c == 0).collect() == []
    assert nearest_neighbours(spark.createDataFrame([], VECS), lambda c: c == 0).collect() == []


def test_bounds_hold_and_prune():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    for d in (3, 64, 1500):
        a, b = rng.standard_normal((30, d)) * 10.0 ** rng.integers(-3, 4, (30, 1)), rng.standard_normal((80, d))
        (qc, qs, _, qe), (cc, cs, cl, ce) = codes(a), codes(b)
        exact = qc.astype(np.int64) @ cc.astype(np.int64).T
        assert (tile_products(qc, cc) == exact).all()
        near, loss = exact * (qs[:, None] * cs), qe[:, None] * cl + ce
        assert (np.abs(near - unit(a) @ unit(b).T) <= loss + 1e-12).all() and loss.max() < 0.05
    mat = rng.standard_normal((4050, 64))
    table = pa.table({"asks": [True] * 50 + [False] * 4000, "ids": [[i] for i in range(4050)], "vec": pa.array(list(mat), pa.list_(pa.float64()))})
    looked = _search(5, stats=True)(None, table).column("looked")[0].as_py()
    assert looked < 0.02 * 50 * 4000  # pairs recomputed
