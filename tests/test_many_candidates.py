"""The way that many candidates take, as those of 1 GB do, against the SQL, where a table ends in a chunk of nothing but filling."""

from functools import partial

import duckdb
import pytest

from skysift.operators import cluster
from skysift.plans.oracles import oracle_sql
from skysift.plans.queries import QUERIES


@pytest.mark.parametrize("size", [44, 124])
def test_many_candidates_equal_sql(spark, tmp_path, monkeypatch, size):
    for name in ("clusters", "ranked"):
        monkeypatch.setattr(cluster, name, partial(getattr(cluster, name), few=0))
    duckdb.sql(f"copy (select * from '/root/testdata/sf0.001/embeddings.parquet' where vec_id < {size} order by vec_id) to '{tmp_path}/embeddings.parquet' (format parquet)")
    df = QUERIES["recording_search_once"](spark, str(tmp_path))
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = con.sql(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({oracle_sql()['recording_search_once']}) q").fetchall()
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(want)
