"""Many small pieces of files share tasks."""

import numpy as np
import pytest

from skysift.sources import arrays, raw


def test_short_ranges_share_tasks(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(50_000, dtype=np.float64))
    got = arrays.read_arrays(spark, str(tmp_path / "a.npy"), each=100)
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.x for r in got.collect()) == list(range(50_000))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    cards = {"BACKEND": "'RAW'", "NBITS": 8, "CHAN_BW": 0.5, "OBSFREQ": 1400.0, "OBSNCHAN": 2, "OBSBW": 1.0, "BLOCSIZE": 64, "NPOL": 4, "TBIN": 1e-6}
    header = ("".join(f"{k:<8}= {v}".ljust(80) for k, v in cards.items()) + "END".ljust(80)).encode()
    for f in range(30):
        (d / f"{f:02d}.raw").write_bytes(b"".join(header + bytes([f * 5 + b] * 64) for b in range(5)))
    return str(d)


def test_small_blocks_and_chunks_share_tasks(spark, folder):
    most = 4 * spark.sparkContext.defaultParallelism
    blocks = raw.index(spark, folder)
    assert blocks.rdd.getNumPartitions() <= most
    got = raw.channels(blocks)
    assert got.rdd.getNumPartitions() <= most
    assert sorted(r.data[0] for r in got.collect()) == sorted([*range(150)] * 2)


def test_small_blocks_share_a_partition_of_the_reader(spark, folder):
    raw.register(spark)
    got = spark.read.format("raw_voltage").load(folder)
    assert got.rdd.getNumPartitions() == 1
    assert sorted((r.block, r.chan, r.data[0]) for r in got.collect()) == [(b, c, b) for b in range(150) for c in (0, 1)]
