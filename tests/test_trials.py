"""Trials of a search from the command line reach every measure asked for."""

import duckdb
import pytest
from test_fixtures import voltages

from skysift import __main__ as cli
from skysift.operators import dedisp
from skysift.plans import grids
from skysift.plans.file_queries import command_plan
from skysift.plans.oracles import oracle_sql
from skysift.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_trials_cover_the_measures():
    assert grids.covering_grid(30, 50, 5) == grids.dm_grid(30, 50, 5) == [30, 40]
    assert grids.covering_grid(2, 16, 4) == [2, 6, 10, 14]
    assert len(grids.covering_grid(0.1, 0.7, 7)) == 6
    assert grids.covering_grid(5e-4, 1e-3, 1) == [5e-4] and grids.covering_grid(0, 0, 1) == [0]
    with pytest.raises(ValueError, match="below the smallest"):
        cli.plan_of(cli.options(["-n", "", "-N", "", "-k", "20"]), {"obs_freq": 1400.0, "obs_bw": 1.0, "chan_bw": 0.5, "tbin": 1e-6, "nchan": 2})


def test_the_query_searches_several_measures():
    """Each trial shifts rows, and by other samples than the one before."""
    plan = command_plan()
    assert plan.dms == (2, 6, 10, 14) and max(plan.widths) == 3
    shifts = [dedisp.shifts(plan.rows, dm, plan.f_min, (plan.f_max - plan.f_min) / plan.rows, plan.t_sample * plan.subs, plan.samples) for dm in plan.dms]
    assert all(max(s for _, s in x) > 0 for x in shifts) and len({str(x) for x in shifts}) == len(plan.dms)


def test_the_query_finds_candidates_of_all_trials(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    df = QUERIES["command_line"](spark, SF)
    got = sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert got == sorted(con.sql(f"select {', '.join(sorted(df.columns))} from ({oracle_sql()['command_line']}) q").fetchall())
    assert {r[sorted(df.columns).index("mdt")] // command_plan().subs for r in got} == {0, 1, 2, 3}


def test_a_pulse_at_the_end_of_the_measures_is_found_by_its_trial(spark, tmp_path):
    """Three whole steps of 0.0005 from 0.00035 on end at 0.00185; the pulse has 0.002."""
    path, _ = voltages(tmp_path, at=150)
    given = ["-n", str(path), "-N", str(tmp_path / "out"), "-P", "5e-7", "-b", "9", "-k", "0.002", "-d", "4", "--d-min", "0.00035", "--nbin", "64", "--nfft", "4"]
    plan = cli.run(spark, cli.options(given))
    lines = [r.value.split() for r in spark.read.text(str(tmp_path / "out" / "delegates")).collect() if "SNR" not in r.value]
    best = max(lines, key=lambda x: float(x[5]))
    assert len(plan.dms) == 4 and int(best[3]) // plan.subs == 3
