"""Corpus queries with oracle SQL agree with it on the smallest tables."""

import duckdb
import pytest

from tripleforge.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("pages", "labels", "documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    listed = ", ".join(f'"{c}"' for c in cols)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want.project(listed).fetchall()))
