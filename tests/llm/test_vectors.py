import math

import numpy as np
import pytest

from mnemotide.llm.topk import exact_topk
from mnemotide.llm.vec_dedup import embedding_near_dedup, first_common, local_roots, spherical_kmeans, unit

VECS = "vec_id long, embedding array<float>, label int, id long, weight int, cell string"
NAN, INF = float("nan"), float("inf")


def _rows(mat, start=0):
    return [(start + i, [float(np.float32(x)) for x in v], 0, 1, 2, "c") for i, v in enumerate(mat)]


def _odd(start):
    vecs = [None, [1.0, None, 0.5], [NAN, 1.0, 1.0], [INF, 0.0, 1.0], [], [0.0, 0.0, 0.0], [1.0, 2.0], [2.0, 4.0]]
    return [(start + i, v, 0, 1, 2, "c") for i, v in enumerate(vecs)]


@pytest.mark.parametrize("tile_rows", [3, 8192])
def test_topk_equals_brute_force(spark, tile_rows):
    rng = np.random.default_rng(4)
    mat = rng.integers(-3, 4, (60, 3)) / 7  # few values, so many ties
    rows = _rows(mat) + _odd(100) + _rows(mat[:2]) + 9 * _rows(mat[7:8], 7) + [(None, [1.0, 1.0, 1.0], 0, 1, 2, "c")]
    got = {}
    for r in exact_topk(spark.createDataFrame(rows, VECS).repartition(20), lambda c: c % 5 == 0, k=7, tile_rows=tile_rows, shard_rows=tile_rows, fan_in=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for i, v in good:
        if i % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))[:7]
            if best:
                want[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert exact_topk(spark.createDataFrame([], VECS), lambda c: c % 5 == 0).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(0, [1e6, 1.0], 0, 1, 2, "c"), (1, [1e6, 1.001], 0, 1, 2, "c"), (2, [1e6, 1.002], 0, 1, 2, "c")]
    got = exact_topk(spark.createDataFrame(rows, VECS), lambda c: c % 5 == 0, k=2).orderBy("rank").collect()
    f = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in rows]
    assert [(r.vec_id, r.score) for r in got] == sorted(((j, f[0][0] * f[j][0] + f[0][1] * f[j][1]) for j in (1, 2)), key=lambda x: (-x[1], x[0]))


def test_scores_beyond_64_bits_are_cut_and_rank_first(spark):
    rows = [(0, [1e9, 1e9]), (1, [1e9, 1e9]), (2, [2e6, 2.0]), (3, [-1e9, -1e9]), (4, [5e14, 5e14])]
    got = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c == 0, k=4).orderBy("rank").collect()
    exact = {j: sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(rows[0][1], rows[j][1])) for j in range(1, 5)}
    cut = {j: max(-(2**63) + 1, min(2**63 - 1, v)) for j, v in exact.items()}
    assert [(r.vec_id, r.score) for r in got] == sorted(cut.items(), key=lambda x: (-x[1], x[0])) and got[0].score == 2**63 - 1


def test_vectors_of_doubles(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).standard_normal((20, 5)))] + [(99, [0.0] * 5)]
    rows += [(50, [x * 1.0001 for x in rows[3][1]])]
    got = {r.vec_id: r for r in embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.999).collect()}
    assert got[50].component_id == 3 and got[3].n_links == 1 and got[99].kept


def _brute(rows, threshold):
    good = [(n, r[0], np.array(r[1], np.float64)) for n, r in enumerate(rows) if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links, root = {n: 0 for n in range(len(rows))}, {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (n, i, x) in enumerate(good):
        for m, j, y in good[:a]:
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[n] += 1
                links[m] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((str(r[0]), links[n], str(find(r[0])) if r[0] is not None else "None") for n, r in enumerate(rows))


@pytest.mark.parametrize(("cell", "block"), [(10, 4), (10_000, 1000)])
def test_near_dedup_equals_brute_force(spark, cell, block):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 16))
    near = np.concatenate([base[i] + rng.standard_normal((n, 16)) * 0.05 for i, n in ((0, 30), (1, 6), (2, 2))])
    rows = _rows(base) + _rows(near, 200) + _rows(base[5:8], 300) + _rows(np.repeat(base[9:10], 9, axis=0), 400) + _rows(base[9:10] * 3, 500) + _odd(600) + [(None, [1.0] * 16, 0, 1, 2, "c"), (200, [float(np.float32(x)) for x in near[0]], 0, 1, 2, "c")]
    got = embedding_near_dedup(spark.createDataFrame(rows, VECS), 0.95, target_cell=cell, block_rows=block, probes=8 if cell == 10 else 4).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == _brute(rows, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embedding_near_dedup(spark.createDataFrame([], VECS)).collect() == []


def test_recall_of_the_production_cells(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3000, 64))
    rows = np.concatenate([base, base[:600] + rng.standard_normal((600, 64)) * 0.3])
    u = unit(rows)
    want = sum(int((u[i] @ u[3000 + i]) >= 0.95) for i in range(600))
    got = embedding_near_dedup(spark.createDataFrame(_rows(rows), VECS), 0.95, target_cell=100).where("vec_id >= 3000 and n_links > 0").count()
    assert want > 200 and got >= 0.98 * want


def test_parts():
    assert local_roots(5, np.array([3, 1, 4]), np.array([1, 0, 3])).tolist() == [0, 0, 2, 0, 0]
    assert first_common(np.array([[1, 5, 9]]), np.array([[2, 5, 9]])).tolist() == [5]
    c = spherical_kmeans(unit(np.random.default_rng(0).standard_normal((50, 4))), 7)
    assert c.shape == (7, 4) and np.allclose((c * c).sum(1), 1)
    assert np.allclose(unit(np.array([[3e200, 4e200]])), [[0.6, 0.8]])


def test_long_products_are_exact_and_only_for_the_rows_that_need_them():
    import time

    from mnemotide.llm.topk import products

    rng = np.random.default_rng(5)
    a, b = (np.floor(rng.standard_normal((n, 64)) * 1024) for n in (64, 1000))
    began = time.perf_counter()
    plain = products(a, b)
    short = time.perf_counter() - began
    a[3, 5], b[7, 5], b[8, 0], a[4, 0] = 1e17, -3e15, 1e300, 2.0**60
    began = time.perf_counter()
    got = products(a, b)
    assert time.perf_counter() - began < 5 * short + 0.2  # in whole numbers alone it takes several hundred times as long
    cut = lambda v: max(-(2**63) + 1, min(2**63 - 1, v))
    for i in (0, 3, 4):
        for j in (0, 7, 8, 9):
            assert got[i, j] == cut(sum(int(x) * int(y) for x, y in zip(a[i], b[j])))
    same = np.ones(got.shape, bool)
    same[[3, 4]], same[:, [7, 8]] = False, False
    assert (got[same] == plain[same]).all()


def test_assigning_holds_a_bounded_product():
    import tracemalloc

    from mnemotide.llm.vec_dedup import nearest, unit

    rng = np.random.default_rng(2)
    mat, centres = rng.standard_normal((6000, 8)), unit(rng.standard_normal((4096, 8)))
    tracemalloc.start()
    near = nearest(mat, centres, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # the whole product alone has 188 MB
    some = rng.choice(6000, 50, replace=False)
    assert (near[some] == np.argsort(-(unit(mat[some]) @ centres.T), axis=1, kind="stable")[:, :4]).all()
