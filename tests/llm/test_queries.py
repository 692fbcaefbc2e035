"""The subpackage's queries with SQL against DuckDB, over the smallest tables."""

import duckdb
import pytest

from mnemotide.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "clicks", "sales", "sale_lines"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(x) for x in cols]
    assert sorted(str([r[x] for x in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in found.fetchall())


def test_names():
    ops = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in ops) == list(range(1, 14))
