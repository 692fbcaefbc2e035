import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemotide.functions.similarity import Blocks, _joined, similar_pairs, similar_roots
from mnemotide.functions.vectors import checked_dimension, cosine_to, dimension_report
from mnemotide.operators import dynamics, graph, retrieval
from mnemotide.operators.components import connected_components
from mnemotide.scratch import Scratch


def _vec(seed, dim=32):
    v = np.zeros(dim)
    v[int(seed) % dim] = 1.0
    v[(int(seed) + 1) % dim] = seed % 1
    return [float(x) for x in v]


def _nodes(spark, seeds, **cols):
    rows = [(f"n{i:02d}", f"s{i % 3}", "decision", "active", _vec(s), ["entity:Alpha"] if i % 4 == 0 else [], i) for i, s in enumerate(seeds)]
    return spark.createDataFrame(rows, "id string, session string, kind string, status string, embedding array<double>, tags array<string>, seq int")


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    for n, m in ((30, 20), (200, 150), (60, 59)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n != 60 else [(i, i + 1) for i in range(59)]
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        table = spark.createDataFrame(pairs, "u long, v long")
        got = {r.node: r.component for r in connected_components(table, Scratch(spark, "t")).collect()}
        at_once = connected_components(table.selectExpr("cast(u as string) u", "cast(v as string) v"), Scratch(spark, "t"), local_edges=10**6).collect()
        assert {frozenset(x for x in got if got[x] == c) for c in got.values()} == {frozenset(int(r.node) for r in at_once if r.component == c) for c in {r.component for r in at_once}}
        assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1] or x in got}
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long"), Scratch(spark, "t")).collect() == []


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_similar_pairs_equal_all_pairs(spark, block_rows):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((23, 8))
    m[5] = m[4]
    df = spark.createDataFrame([(f"v{i:02d}", [float(x) for x in v]) for i, v in enumerate(m)] + [("null", None)], "id string, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(f"v{i:02d}", f"v{j:02d}"): float(u[i] @ u[j]) for i in range(23) for j in range(i + 1, 23) if u[i] @ u[j] >= 0.2}
    got = {(r.src, r.dst): r.cosine for r in similar_pairs(df, 0.2, block_rows=block_rows).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    top = {(r.src, r.dst) for r in similar_pairs(df, -1.0, top=2, block_rows=block_rows).collect()}
    for i in range(23):
        best = sorted((j for j in range(23) if j != i), key=lambda j: -u[i] @ u[j])[:2]
        assert all((f"v{min(i, j):02d}", f"v{max(i, j):02d}") in top for j in best)


def test_odd_vectors_do_not_disturb_others(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 2.0, 0.0]), ("c", [1.0, 2.0, 0.0]), ("b", [nan, 1.0, 1.0]), ("i", [inf, 1.0, 1.0]), ("n", [1.0, None, 1.0]), ("z", [0.0, 0.0, 0.0]), ("e", []), ("two", [1.0, 2.0]), ("two2", [2.0, 4.0]), ("x", None), (None, [1.0, 2.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    for top in (1, None):
        assert {(r.src, r.dst) for r in similar_pairs(df, 0.3, top=top).collect()} == {("a", "c"), ("two", "two2")}
    assert {(r.src, r.dst) for r in similar_roots(df, 0.3).collect()} == {("a", "c"), ("two", "two2")}
    assert similar_pairs(df.limit(0), 0.3, top=2).collect() == []
    assert [r.c for r in df.where("id = 'b'").select(cosine_to("embedding", [1.0, 1.0, 1.0]).alias("c")).collect()] == [None]


def _gathered(spark, groups=24, rows=40, d=16, spread=0.05):
    rng = np.random.default_rng(11)
    m = np.concatenate([g + rng.standard_normal((rows, d)) * spread for g in rng.standard_normal((groups, d))])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(f"v{i:04d}", [float(x) for x in v]) for i, v in enumerate(m)], "id string, embedding array<double>")


def test_blocks_that_cannot_reach_the_floor_are_skipped(spark):
    m, df = _gathered(spark)
    sims = m @ m.T
    want = {(f"v{i:04d}", f"v{j:04d}") for i, j in zip(*np.nonzero(np.triu(sims >= 0.8, 1)))}
    assert Blocks(df, 0.8, None, 40, "id", "embedding").skipped > 0.7
    assert {(r.src, r.dst) for r in similar_pairs(df, 0.8, block_rows=40).collect()} == want
    low = {(r.src, r.dst): r.cosine for r in similar_pairs(df, -1.0, top=3, block_rows=40).collect()}
    np.fill_diagonal(sims, -2)
    for i in range(len(m)):
        for j in np.argsort(-sims[i])[:3]:
            assert math.isclose(low[f"v{min(i, j):04d}", f"v{max(i, j):04d}"], sims[i, j], abs_tol=1e-9)
    assert len(low) < len(m) * 3 * 24 and Blocks(df, -1.0, 3, 40, "id", "embedding").skipped > 0.3  # by the k-th best that rows have
    best = similar_pairs(df, 0.0, most=5, block_rows=40).orderBy(F.desc("cosine"), "src", "dst").limit(5).collect()
    order = sorted(((-sims[i, j], i, j) for i in range(len(m)) for j in range(i + 1, len(m))))[:5]
    assert [(r.src, r.dst) for r in best] == [(f"v{i:04d}", f"v{j:04d}") for _, i, j in order]


def test_roots_connect_what_pairs_connect(spark):
    _, df = _gathered(spark, groups=5, rows=30)
    parts = {}
    for name, links in (("pairs", similar_pairs(df, 0.8, block_rows=20)), ("roots", similar_roots(df, 0.8, block_rows=20))):
        found = connected_components(links.select(F.col("src").alias("u"), F.col("dst").alias("v")), Scratch(spark, "t"))
        parts[name] = sorted((r.node, r.component) for r in found.collect())
    assert parts["pairs"] == parts["roots"] and similar_roots(df, 0.8, block_rows=20).count() < similar_pairs(df, 0.8, block_rows=20).count()


def test_cosine_leaves_out_vectors_of_another_dimension(spark):
    for dim in (3, 20):
        q = [2.0] + [0.0] * (dim - 1)
        rows = [("a", [1.0, 2.0, 2.0] + [0.0] * (dim - 3)), ("zero", [0.0] * dim), ("short", [1.0]), ("null", None)]
        df = spark.createDataFrame(rows, "id string, v array<double>")
        got = {r.id: r.c for r in df.select("id", cosine_to("v", q).alias("c")).collect()}
        assert got["a"] == pytest.approx(1 / 3) and got["zero"] == 0.0 and got["short"] is None and got["null"] is None
    nodes = spark.createDataFrame([("x", "s", "active", "q", 5, [1.0] * 20), ("y", "s", "active", "q", 5, [1.0] * 19)], "id string, session string, status string, query string, importance int, embedding array<double>")
    nodes = nodes.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    found = retrieval.hybrid_search(nodes, "anything", [1.0] * 20, F.lit("2024-01-02").cast("timestamp"))
    assert [r.id for r in found.collect()] == ["x"]
    with pytest.raises(Exception, match="that of y has 19"):
        checked_dimension(nodes, "embedding", 20).collect()
    assert {(r.fits, r.nodes) for r in dimension_report(nodes, "embedding", 20).collect()} == {(True, 1), (False, 1)}


def _sequential(edges, passes=12):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    near = {k: sorted(v) for k, v in near.items()}
    label = {n: n for n in near}
    for _ in range(passes):
        moved = False
        for n in sorted(near):
            votes = {}
            for o, w in near[n]:
                votes[label[o]] = votes.get(label[o], 0.0) + w
            best = min(k for k, v in votes.items() if v == max(votes.values()))
            moved |= best != label[n]
            label[n] = best
        if not moved:
            break
    return label


@pytest.mark.parametrize("local_links", [0, 10**6])
def test_communities_equal_one_global_pass(spark, local_links):
    rng = random.Random(11)
    edges = list({(min(a, b), max(a, b)): (f"n{min(a, b):02d}", f"n{max(a, b):02d}", rng.choice([0.25, 0.5, 1.0])) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(70)) if a != b}.values())
    df = spark.createDataFrame([(a, b, "semantic", "strong", w) for a, b, w in edges], "src string, dst string, type string, tier string, weight double")
    label = _sequential(edges)
    groups = {}
    for n, v in label.items():
        groups.setdefault(v, set()).add(n)
    want = sorted((sorted(g) for g in groups.values() if len(g) >= 4))
    got = {}
    for r in graph.communities(df, Scratch(spark, "t"), local_links=local_links).collect():
        got.setdefault(r.cid, set()).add(r.id)
    assert sorted(sorted(g) for g in got.values()) == want
    assert [len(got[c]) for c in sorted(got)] == sorted((len(g) for g in got.values()), reverse=True)


def test_graph_of_two_clusters(spark):
    nodes = _nodes(spark, [10.0, 10.1, 10.2, 10.3, 20.0, 20.1, 20.2, 20.3])
    edges = graph.semantic_edges(nodes)
    rows = edges.collect()
    assert {r.tier for r in rows} <= {"strong", "medium", "weak"} and all(r.src < r.dst for r in rows)
    assert all((int(r.src[1:]) < 4) == (int(r.dst[1:]) < 4) for r in rows)
    found = {r.id: r.cid for r in graph.communities(edges, Scratch(spark, "t")).collect()}
    assert len(set(found.values())) == 2 and found["n00"] == found["n03"] != found["n04"]
    star = graph.entity_edges(nodes, [F.col("seq")], share=0.9).collect()
    assert [(r.src, r.dst) for r in star] == [("n00", "n04")]


def test_pack_keeps_to_its_budget(spark):
    rows = [(f"n{i}", "insight", "s", "q" * 40, "x" * (40 * i), "g" * 20, float(-i)) for i in range(12)]
    hits = spark.createDataFrame(rows, "id string, kind string, session string, query string, output_preview string, gist string, score double")
    got = retrieval.pack(hits, 100, [F.desc("score")]).orderBy("place").collect()
    used, want = 0, []
    for i, r in enumerate(rows):
        body = r[4] or r[3]
        if used + max(1, len(body) // 4) <= 100 and i < 8:
            used += max(1, len(body) // 4)
            want.append((body, used))
        else:
            used += max(1, len(r[5]) // 4)
            want.append(("", used))
    assert [(r.text, r.used) for r in got] == want


def test_walk_goes_through_better_paths(spark):
    e = [("a", "b", "weak", 0.9), ("b", "c", "strong", 0.9), ("a", "d", "medium", 0.8), ("d", "c", "weak", 0.9), ("c", "e", "weak", 1.0)]
    edges = spark.createDataFrame([(s, d, "semantic", t, w) for s, d, t, w in e], "src string, dst string, type string, tier string, weight double")
    topics = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "id string, topic string")
    got = {r.id: (r.score, r.hops) for r in retrieval.drift_walk(edges, topics, spark.createDataFrame([("a",)], "id string")).collect()}
    near, topic, best, front = {}, {"a": "1", "b": "1", "c": "2"}, {}, {"a": 1.0}
    for x, y, tie, w in e:
        for p, q in ((x, y), (y, x)):
            near.setdefault(p, []).append((q, w * {"weak": 1.0, "medium": 0.9, "strong": 0.5}[tie] * (0.7 if topic.get(p) == topic.get(q) else 1.5) * 0.8))
    for hop in (1, 2, 3):
        found = {}
        for p, score in front.items():
            for q, w in near[p]:
                if q != "a":
                    found[q] = max(found.get(q, 0.0), score * w)
        front = {q: v for q, v in found.items() if v > best.get(q, (0.0,))[0]}
        best |= {q: (v, hop) for q, v in front.items()}
    assert got.keys() == best.keys()
    assert all(got[q] == (pytest.approx(best[q][0]), best[q][1]) for q in best)


def test_chain_survives_a_cycle_and_never_ends_early(spark):
    nodes = spark.createDataFrame([("a", "k", "c"), ("b", "k", "a"), ("c", "k", "b"), ("d", "k", "gone")], "id string, kind string, parent string")
    starts = spark.createDataFrame([("c",), ("d",), ("none",)], "id string")
    assert [tuple(r) for r in retrieval.chain(nodes, starts).orderBy("start", "step").collect()] == [("c", "c", "k", 0), ("c", "b", "k", 1), ("c", "a", "k", 2), ("d", "d", "k", 0)]
    n = 300
    long = spark.range(n).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit("k").alias("kind"), F.when(F.col("id") > 0, F.concat(F.lit("n"), (F.col("id") - 1).cast("string"))).alias("parent"))
    rows = retrieval.chain(long, spark.createDataFrame([(f"n{n - 1}",)], "id string")).orderBy("step").collect()
    assert [r.id for r in rows] == [f"n{n - 1 - i}" for i in range(n)] and [r.step for r in rows] == list(range(n))


def test_more_prefixes_or_ids_than_the_tool_takes_are_an_error(spark):
    nodes = spark.createDataFrame([("a", "q", "p", "e")], "id string, query string, output_preview string, episodic_text string")
    for ask in (retrieval.lookup, retrieval.read_nodes):
        with pytest.raises(ValueError, match="eight"):
            ask(nodes, [str(i) for i in range(9)])


def test_entity_cap_can_be_lifted(spark):
    rows = [(f"n{i}", f"s{i % 2}", "active", ["entity:one thing"], i) for i in range(40)]
    nodes = spark.createDataFrame(rows, "id string, session string, status string, tags array<string>, seq int")
    assert graph.entity_edges(nodes, [F.col("seq")], share=1.0, most=5).count() == 5
    assert graph.entity_edges(nodes, [F.col("seq")], share=1.0, most=None).count() == 39


def test_medoid_equals_all_pairs(spark):
    rng = np.random.default_rng(9)
    m = rng.standard_normal((9, 5))
    nodes = spark.createDataFrame([(f"m{i}", [float(x) for x in v]) for i, v in enumerate(m)], "id string, embedding array<double>")
    members = nodes.select(F.lit("c").alias("cluster"), "id")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = (u @ u.T).sum(1) - 1
    got = dynamics.medoids(members, nodes).first()
    assert got.id == f"m{int(s.argmax())}" and got["mean"] == pytest.approx(s.max() / 8, abs=1e-8)


def test_placement_is_fair(spark):
    at = [r[0] for r in spark.range(1000).select(dynamics.golden_position(F.col("id"))).collect()]
    buckets = np.bincount([int(x * 10) for x in at], minlength=10)
    assert len(set(at)) == 1000 and abs(buckets - 100).max() <= 2


def test_layout_keeps_communities_apart_and_members_inside(spark):
    rows = [("g" if i < 60 else "h", f"n{i:03d}", i % 4 if i % 7 else None, i % 10) for i in range(120)]
    got = graph.layout(spark.createDataFrame(rows, "galaxy string, id string, cid int, importance int")).toPandas()
    assert len(got) == 120 and got.id.is_unique and not got.isna().any(axis=None)
    again = graph.layout(spark.createDataFrame(rows[::-1], "galaxy string, id string, cid int, importance int")).toPandas()
    assert got.sort_values("id").reset_index(drop=True).equals(again.sort_values("id").reset_index(drop=True))
    for spacing in (26.0, 10.0):
        sizes = spark.createDataFrame([("g", c, m) for c, m in enumerate([90, 70, 70, 33, 20, 9, 9, 4, 1] * 3)], "galaxy string, cid int, m long")
        discs = [(r.cx, r.cy, r.radius) for r in graph.community_centres(sizes, spacing).collect()]
        gaps = [math.hypot(a[0] - b[0], a[1] - b[1]) - a[2] - b[2] for i, a in enumerate(discs) for b in discs[:i]]
        assert min(gaps) >= 0.625 * spacing - 1e-6


def test_stable_layout_moves_no_community_when_others_come(spark):
    schema, born = "galaxy string, cid int, m long", spark.createDataFrame([(0, 3), (1, 0), (2, 7)], "cid int, born int")
    few = {r.cid: (r.cx, r.cy) for r in graph.community_centres(spark.createDataFrame([("g", 0, 5), ("g", 1, 9)], schema), born=born).collect()}
    more = {r.cid: (r.cx, r.cy) for r in graph.community_centres(spark.createDataFrame([("g", 0, 500), ("g", 1, 9), ("g", 2, 90)], schema), born=born).collect()}
    assert all(more[c] == few[c] for c in few)


def test_layout_places_nodes_of_more_galaxies_than_ten_thousand(spark):
    n = 10_050
    rows = spark.range(n).select(F.col("id").cast("string").alias("galaxy"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit(0).alias("cid"), F.lit(1).alias("importance"))
    got = graph.layout(rows).collect()
    assert {r.id for r in got} == {f"n{i}" for i in range(n)} and len(got) == n
    assert len({(r.map_x, r.map_y) for r in got}) == n


@pytest.mark.parametrize("local_links", [15, 10**6])
def test_labels_of_components_of_all_sizes_equal_one_global_pass(spark, local_links):
    """Small components by tasks, large ones by rounds, all in one: chains with rising ids, dense groups, a loop, repeated votes."""
    rng = random.Random(3)
    edges = [(f"c{i:02d}", f"c{i + 1:02d}", 1.0) for i in range(40)] + [(f"d{i}", f"d{i + 1}", 1.0) for i in range(4)]
    edges += list({(min(a, b), max(a, b)): (f"g{min(a, b):02d}", f"g{max(a, b):02d}", rng.choice([1.0, 2.0, 3.0])) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(120)) if a != b}.values())
    edges += [("x", "y", 2.0)]
    links = spark.createDataFrame([(a, b, int(w)) for a, b, w in edges] + [(b, a, int(w)) for a, b, w in edges] + [("z", "z", 1)], "src string, dst string, votes long")
    got = {r.id: r.label for r in graph.spread_labels(links, Scratch(spark, "t"), passes=2, local_links=local_links).collect()}
    assert got == _sequential(edges, 2) | {"z": "z"}


def test_a_million_links_take_one_task_seconds(spark):
    import time

    import pyarrow as pa

    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 300_000, (2, 500_000))
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    table = pa.table({"src": pa.array(src).cast(pa.string()), "dst": pa.array(dst).cast(pa.string()), "votes": np.ones(10**6, np.int64)})
    began = time.perf_counter()
    out = graph._labelled(12)(table)
    assert out.num_rows == len(np.unique(src)) and time.perf_counter() - began < 60 and graph.LOCAL_LINKS >= 10**6


@pytest.mark.parametrize("pivots", [64, 2048])
def test_densely_linked_vectors_are_not_all_compared(spark, pivots):
    """Most vectors lie in a cone; a chain leads out of it, and some are alone, in pairs, or of another length."""
    import numpy as np

    rng = np.random.default_rng(3)
    cone = np.hstack([np.ones((500, 1)), 0.25 * rng.standard_normal((500, 7))])
    t = np.arange(1, 12) * 0.3
    chain = np.zeros((len(t), 8))
    chain[:, 0], chain[:, 1] = np.cos(t), np.sin(t)
    alone = -np.eye(8)[[3, 4, 5]]
    m = np.vstack([cone, chain, alone, alone[:1] * 2])
    rows = [(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(m)] + [("w1", [1.0, 0.0]), ("w2", [2.0, 0.1]), ("w3", [-1.0, 3.0]), ("n", None), ("z", [0.0] * 8)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    links = similar_roots(df, 0.9, block_rows=50, pivots=pivots).collect()
    u = m / np.linalg.norm(m, axis=1)[:, None]

    def parts(pairs):
        low = {r[0]: r[0] for r in rows}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                least = min(low[a], low[b])
                changed |= low[a] != least or low[b] != least
                low[a] = low[b] = least
        return low

    x, y = np.nonzero(u @ u.T >= 0.9)
    want = parts([(rows[i][0], rows[j][0]) for i, j in zip(x, y, strict=True) if i < j] + [("w1", "w2")])
    assert parts([(r.src, r.dst) for r in links]) == want and all(r.src < r.dst for r in links)
    every = _joined(df, 0.9, None, None, True, 50, "id", "embedding").count()
    assert len(set(want.values())) > 5 and len(links) < 3 * len(rows) and 2 * len(links) < every


def test_entity_edges_are_not_capped_in_reports(spark):
    """More edges than the rule's own cap of 4,000, over two entities of which the later by name would lose the most."""
    n = 2600
    rows = [(f"n{i:05d}", f"s{i % 2}", "active", [f"entity:thing {i % 2}"], i) for i in range(2 * n)]
    nodes = spark.createDataFrame(rows, "id string, session string, status string, tags array<string>, seq int")
    edges = graph.entity_edges(nodes, [F.col("seq")], share=1.0)
    assert {(r.src, r["count"]) for r in edges.groupBy("src").count().collect()} == {("n00000", n - 1), ("n00001", n - 1)}
    assert [tuple(r) for r in graph.edge_report(graph.build_edges([edges])).collect()] == [("entity", None, 2 * n - 2)]


@pytest.mark.parametrize("local_links", [60, 10**6])
def test_labels_by_numbers_equal_one_global_pass(spark, local_links, monkeypatch):
    """A graph too large to go to its task by names: nodes are numbered, no component is looked for where one task takes all."""
    rng = random.Random(8)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}", 1.0) for i in range(28)]
    edges += list({(min(a, b), max(a, b)): (f"g{min(a, b)}", f"g{max(a, b)}", rng.choice([1.0, 2.0])) for a, b in ((rng.randrange(15), rng.randrange(15)) for _ in range(25)) if a != b}.values())
    links = spark.createDataFrame([(a, b, int(w)) for a, b, w in edges] + [(b, a, int(w)) for a, b, w in edges] + [("z", "z", 1)], "src string, dst string, votes long")
    if local_links > len(edges) * 2:
        monkeypatch.setattr(graph, "connected_components", None)
    got = {r.id: r.label for r in graph.spread_labels(links, Scratch(spark, "t"), passes=3, local_links=local_links, small_links=10).collect()}
    assert got == _sequential(edges, 3) | {"z": "z"}


def test_labels_of_numbers_with_gaps_and_little_held_at_once():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    for names in (np.arange(50) + 7, np.arange(50) * 3, np.sort(rng.choice(10**12, 50, replace=False))):
        a, b, votes = rng.integers(0, 50, 70), rng.integers(0, 50, 70), rng.integers(1, 4, 70)
        pairs = {(min(x, y), max(x, y)): int(v) for x, y, v in zip(a.tolist(), b.tolist(), votes, strict=True) if x != y}
        rows = [(names[x], names[y], v) for (x, y), v in pairs.items()] + [(names[y], names[x], v) for (x, y), v in pairs.items()]
        batches = [pa.RecordBatch.from_arrays([pa.array([int(r[c]) for r in rows[at : at + 9]]) for c in range(3)], names=["src", "dst", "votes"]) for at in range(0, len(rows), 9)]
        got = {k: v for out in graph._labelled_numbers(3, hold=20)(iter(batches)) for k, v in zip(out["id"].to_pylist(), out["label"].to_pylist(), strict=True)}
        assert got == {int(k): int(v) for k, v in _sequential([(int(names[x]), int(names[y]), float(v)) for (x, y), v in pairs.items()], 3).items()}
        links = [np.array([r[c] for r in rows]) for c in range(3)]
        links[:2] = [np.searchsorted(np.unique(links[0]), x).astype(np.int32) for x in links[:2]]
        few = graph._settle(len({r[0] for r in rows}), links, 3, step=5)
        assert np.unique([r[0] for r in rows])[few].tolist() == [got[int(k)] for k in np.unique([r[0] for r in rows])]


def test_packing_looks_only_at_what_is_near_and_places_as_all_discs_would(monkeypatch):
    n, seen, hypot = 1500, [0], np.hypot
    m = np.concatenate([[900, 70], 4 + np.sort(np.random.default_rng(2).geometric(0.12, n - 2))[::-1]])
    rows = pd.DataFrame({"galaxy": "g", "cid": np.arange(n, dtype=np.int32), "rank": np.arange(n), "radius": graph.SPACING * np.sqrt(m) / 1.55})

    class Plain:
        def __init__(self, gap):
            self.gap, self.discs = gap, []

        def clear(self, x, y, radius):
            d = np.array(self.discs).reshape(-1, 3)
            return bool((hypot(d[:, 0] - x, d[:, 1] - y) >= d[:, 2] + radius + self.gap).all())

        def add(self, x, y, radius):
            self.discs.append((x, y, radius))

    def counted(a, b):
        seen[0] += len(a)
        return hypot(a, b)

    monkeypatch.setattr(np, "hypot", counted)
    got = graph._packed(graph.SPACING)(rows)
    looked = seen[0]
    monkeypatch.setattr(graph, "_Discs", Plain)
    assert got.equals(graph._packed(graph.SPACING)(rows))
    assert looked < 150 * n
