"""Queries over tables whose last block, chunk or frame is not full, against their SQL."""

import duckdb
import pytest

from skysift.plans.oracles import oracle_sql
from skysift.plans.queries import QUERIES

NAMES = [
    "indexed_samples",
    "raw_blocks",
    "raw_frames",
    "raw_headers",
    "raw_samples",
    "raw_where",
    "direct_samples",
    "plane_frames",
    "coherent_images",
    "coherent_search",
    "recording_search",
    "recording_search_once",
    "recording_stream",
]


@pytest.fixture(scope="module", params=[41, 42])
def part(request, tmp_path_factory):
    d = tmp_path_factory.mktemp("part")
    duckdb.sql(f"copy (select * from '/root/testdata/sf0.001/embeddings.parquet' where vec_id < {request.param} order by vec_id) to '{d}/embeddings.parquet' (format parquet)")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_part_equals_sql(spark, part, name):
    df = QUERIES[name](spark, str(part))
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{part}/embeddings.parquet'")
    want = con.sql(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({oracle_sql()[name]}) q").fetchall()
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(want)
