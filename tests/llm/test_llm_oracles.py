import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts"))

from check_oracle import digest  # noqa: E402

from clickgap.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in res.description]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(got.columns) == sorted(cols)
    assert digest(got.columns, rows)[0] == digest(cols, res.fetchall())[0]
