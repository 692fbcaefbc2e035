"""Queries that could be right on the smallest tables only, against their SQL on larger ones; and numbering at scale."""

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemotide.plans.catalogue import ORACLE_SQL, QUERIES

from mnemotide.model import Store
from mnemotide.operators import windows
from mnemotide.scratch import Scratch

from test_catalogue import TABLES, _plain

DIR = "/root/testdata/"
@pytest.mark.parametrize("name", ["g_communities", "g_entity_star", "g_edge_report", "g_layout", "g_layout_stable", "g_names_of_topics", "j_sessions_left_count", "n_golden_positions", "r_chain_walk", "w_immutability"])
def test_query_on_the_middle_tables(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}sf0.01/{t}.parquet'")
    df = QUERIES[name](spark, DIR + "sf0.01")
    cols = sorted(df.columns)
    found = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    at = [names.index(x) for x in cols]
    want = sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(_plain(r[x]) for x in cols) for r in df.collect()) == want


def test_layout_places_every_node(spark):
    s = Store(spark, DIR + "sf0.01")
    got = [r.id for r in QUERIES["g_layout"](spark, DIR + "sf0.01").select("id").collect()]
    assert sorted(got) == sorted(r.id for r in s.base.select("id").collect())


def test_places_follow_the_order_over_many_partitions(spark):
    rows = spark.range(0, 30_000, 3, 7).select((F.col("id") * 7919 % 30_011).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in windows.placed(rows, ["k"], Scratch(spark, "test")).select("i", "k").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == list(enumerate(sorted(r.k for r in rows.collect())))
