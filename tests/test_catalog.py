"""Every catalog query with SQL against DuckDB at the smallest scale."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from quillon.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    return sorted(tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [k for k, v in catalog.QUERIES.items() if v[1]])
def test_matches_sql(spark, duck, name):
    query, sql = catalog.QUERIES[name]
    assert rows(query(spark, SF).toPandas()) == rows(duck.execute(sql).df())


def test_queries_without_sql_run(spark):
    for name, (query, sql) in catalog.QUERIES.items():
        if sql is None:
            assert query(spark, SF).count() > 0, name


def test_duplicate_pairs_are_whole(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(5000, 8))
    v[200:230] = v[200] + rng.normal(size=(30, 8)) * 0.01  # more partners than 20, all beyond the first hundred
    v[4990] = v[5]
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["qid"], r["key"]): r["score"] for r in catalog.duplicate_pairs(spark, str(tmp_path)).collect()}
    s = v.astype(float) @ v.astype(float).T
    want = {(i, str(j)): s[i, j] for i, j in zip(*np.nonzero(s > 0.95), strict=True) if i != j}
    assert got.keys() == want.keys() and len(got) >= 30 * 29 + 2
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
