"""Queries over tables whose rows have gaps, of some rows, of blocks and of whole files, against their SQL."""

import duckdb
import pytest

from skysift.plans.oracles import oracle_sql
from skysift.plans.queries import QUERIES

NAMES = [
    "indexed_samples",
    "raw_blocks",
    "raw_chunks",
    "raw_frames",
    "raw_headers",
    "raw_samples",
    "raw_where",
    "direct_blocks",
    "direct_samples",
    "recording_search",
    "recording_search_once",
    "recording_stream",
    "command_line",
]
GAPS = {
    "within": "vec_id < 131 and vec_id not in (2, 30, 31) and vec_id not between 8 and 15 and vec_id not between 24 and 27",
    "first": "vec_id between 27 and 131 and vec_id not between 60 and 102",
    "files": "vec_id between 5 and 8 or vec_id between 211 and 391 or vec_id = 499",
}


@pytest.fixture(scope="module", params=GAPS)
def part(request, tmp_path_factory):
    d = tmp_path_factory.mktemp("gaps")
    duckdb.sql(f"copy (select * from '/root/testdata/sf0.001/embeddings.parquet' where {GAPS[request.param]} order by vec_id) to '{d}/embeddings.parquet' (format parquet)")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_gaps_equal_sql(spark, part, name):
    df = QUERIES[name](spark, str(part))
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{part}/embeddings.parquet'")
    want = con.sql(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({oracle_sql()[name]}) q").fetchall()
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(want)
