"""Hand-made fixtures with known results."""

import json
import math
import struct

import numpy as np
import pytest

from pyspark.sql import functions as F
from skysift.operators import cluster, dedisp, detect, frame, scan, spectral, stats
from skysift.plans import grids
from skysift.sources import files, raw
from skysift.streaming import chunks


def image(spark, n=16):
    x = np.full((3, n), 2.0)
    x[0, 4], x[0, 11], x[2, 4] = 140, 120, 100
    return spark.createDataFrame([(r, t, float(x[r, t])) for r in range(3) for t in range(n)], "chan long, t long, x double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_boxcars_of_doubling_widths(spark):
    got = rows(detect.boxcar(image(spark), [1, 2], 4.0, log_index=True))
    want = [(3, 0, 1, 100.409), (3, 2, 1, 72.125), (4, 0, 0, 140.0), (4, 0, 1, 100.409), (4, 2, 0, 100.0), (4, 2, 1, 72.125), (10, 0, 1, 86.267), (11, 0, 0, 120.0), (11, 0, 1, 86.267)]
    assert [(a, b, c, round(d, 3)) for a, b, c, d in got] == want


@pytest.mark.parametrize("tile", [3, 5, 4096])
def test_tiles_change_nothing(spark, tile):
    assert rows(detect.boxcar(image(spark), [1, 2, 3], 1.0, tile=tile)) == rows(detect.boxcar(image(spark), [1, 2, 3], 1.0, tile=100))


@pytest.mark.parametrize("widths, size", [(2, 3), (4, 10)])
def test_clusters_and_delegates(spark, widths, size):
    cand = detect.boxcar(image(spark), list(range(1, widths + 1)), 4.0)
    got = rows(cluster.delegates(cluster.clusters(cand)))
    assert got == [(4, 0, 1, 140.0, size), (4, 2, 1, 100.0, size), (11, 0, 1, 120.0, size)]


def test_no_candidates_no_delegates(spark):
    assert rows(cluster.delegates(cluster.clusters(detect.boxcar(image(spark), [1], 1e9)))) == []


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_gap_splits_with_ties_over_ranges(spark, parts):
    values = [1, 1, 2, 5, 6, 9, 9, 30, 33, 36, 37, 60]
    df = spark.createDataFrame([(0, v) for v in values], "g long, mt long")
    got = [r.k for r in cluster.gap_groups(df, ["g"], "mt", 2, "k", parts).orderBy("mt").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 3, 4, 5, 5, 6]


def test_excision_zeroes_the_loud_channel(spark):
    rng = np.random.default_rng(1)
    data = [(c, t, float(v)) for c in range(21) for t, v in enumerate(rng.integers(-3, 4, 64) * (500 if c == 20 else 1))]
    got = stats.excise_zscore(spark.createDataFrame(data, "chan long, t long, x double"))
    masks = {r.chan: (r.m, r.x) for r in got.groupBy("chan").agg(F.max("mask").alias("m"), F.max(F.abs("x")).alias("x")).collect()}
    assert masks[20] == (0.0, 0.0) and all(masks[c][0] == 1.0 for c in range(20))


def test_moments(spark):
    df = spark.createDataFrame([(0, v) for v in (4.0, 7.0, 13.0, 16.0)], "g long, v double")
    r = stats.moments(df, "g", "v").first()
    assert (r.n, r.min_v, r.max_v, r.mean_v, r.var_v, r.var_n, r.skew) == (4, 4.0, 16.0, 10.0, 30.0, 22.5, 0.0) and math.isclose(r.kurt, 1.36)


def test_moments_of_negative_values(spark):
    assert stats.moments(spark.createDataFrame([(0, -5.0), (0, -2.0)], "g long, v double"), "g", "v").first().max_v == -2.0


def test_permuted_scan(spark):
    heap = spark.createDataFrame(list(enumerate([2, 5, 8, 11, 14])), "pos long, v long")
    order = spark.createDataFrame([(i, 4 - i) for i in range(5)], "i long, pos long")
    assert [r[1] for r in rows(scan.permuted_prefix_sum(order, heap, "v"))] == [0, 14, 25, 33, 38, 40]


@pytest.mark.parametrize("tile", [7, 256])
def test_scan_of_ones(spark, tile):
    df = spark.range(256).select(F.col("id").alias("i"), F.lit(1).alias("v"))
    assert [r[1] for r in rows(scan.prefix_sum(df, "i", "v", tile=tile))] == list(range(1, 257))
    assert [r[1] for r in rows(scan.prefix_sum(df, "i", "v", exclusive=True, tile=tile))] == list(range(256))


def test_frames(spark):
    nbin, nfft, over = 6, 2, 1
    n = (nbin - 2 * over) * nfft
    got = rows(frame.overlap_frames(spark.createDataFrame([(0, i, float(i + 1)) for i in range(n)], "chan long, isamp long, x double"), nbin, nfft, over, ["chan"], ["x"]))
    want = [(0, f, b, float(i + 1) if 0 <= (i := b + 4 * f - 1) < n else 0.0) for f in range(nfft) for b in range(nbin)]
    assert got == want and got[0][3] == 0 and got[-1][3] == 0


def test_digitize(spark):
    df = spark.createDataFrame([(float(i),) for i in range(128)], "x double")
    assert sorted(r.q for r in frame.digitize(df, "x", 16).collect()) == [int(i * 65536 / 127) for i in range(128)]


def test_fourier_round_trip(spark):
    z = spark.createDataFrame([(0, i, float(i), float(-i)) for i in range(8)], "r long, c long, re double, im double")
    back = rows(spectral.transformed(spectral.transformed(z, ["r"], "c"), ["r"], "c", inverse=True))
    assert np.allclose(back, [(0, i, i, -i) for i in range(8)])


def test_roll_and_back(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "c long, x double")
    assert rows(frame.roll(frame.roll(df, "c", 9, 4), "c", 9, -4)) == rows(df)


def reference_transform(x, delays, plan):
    n = x.shape[1]
    state = {}
    for c, grid in delays.items():
        for k, d in enumerate(grid):
            state[c, k] = np.array([x[c, t - d : t + 1].mean() if t >= d else 0.0 for t in range(n)])
    for nodes in plan:
        new = {}
        for v in nodes:
            out = state[v.tail_sub, v.tail_k].copy()
            if v.head_sub is not None:
                out[v.offset :] += state[v.head_sub, v.head_k][: n - v.offset]
            new[v.sub, v.k] = out
        state = new
    return np.stack([state[0, k] for k in range(len(state))])


@pytest.mark.parametrize("kind", ["truncating", "rounding"])
def test_transforms_equal_numpy(spark, kind):
    x = np.random.default_rng(42).integers(-20, 21, (6, 24)).astype(float)
    w = spark.createDataFrame([(c, t, float(x[c, t])) for c in range(6) for t in range(24)], "chan long, t long, x double")
    if kind == "rounding":
        first, plan, last = grids.rounding_plan(6, 1000, 1500, 8)
        delays = dict(enumerate(first))
        assert last == list(range(9))
    else:
        depth, plan = grids.truncating_plan(6, 1000, 1500, 9)
        delays = {c: list(range(depth + 1)) for c in range(6)}
    want = reference_transform(x, delays, plan)
    for cells in (dedisp.CELLS, 30):
        got = rows(dedisp.image_of(dedisp.transform(w, delays, plan, cells=cells)))
        assert np.allclose(np.array([v for _, _, v in got]).reshape(want.shape), want)
    both = w.withColumn('key', F.lit('a')).union(w.withColumn('key', F.lit('b')))
    assert rows(dedisp.image_of(dedisp.transform(both, delays, plan, ['key'], cells=30), ['key']).where("key = 'b'").drop('key')) == got


def test_plan_ties_and_rounding():
    assert grids.half_away(2.5) == 3 and grids.half_away(-2.5) == -3
    assert grids.closest([0, 2, 4], 1) == 1 and grids.closest([0, 2, 4], 9) == 2
    assert grids.dm_grid(30, 50, 5) == [30, 40]


def test_input_checks():
    grids.check_inputs(4, 10, 40, 3, 30)
    for wrong in ((4, 10, 41, 3, 30), (4, 10, 40, 3, 31)):
        with pytest.raises(ValueError):
            grids.check_inputs(*wrong)


def published_plan(channels, f_min, f_max, rows):
    """The truncating plan written down once more, with plain loops: rows of each band pair take so much of either half."""
    f = np.float32
    bands = [(f(f_min) + f(i) * (f(f_max) - f(f_min)) / f(channels)) for i in range(channels)] + [f(f_max)]
    share = lambda a, b, c, d: (float(a) ** -2 - float(b) ** -2) / (float(c) ** -2 - float(d) ** -2)
    depth = [math.ceil(share(bands[0], bands[0] + (f(f_max) - f(f_min)) / f(channels), f_min, f_max) * (rows - 1.0)) + 1] * channels
    out = []
    while len(depth) > 1:
        step, now, cut = [], [], []
        for i in range(0, len(depth), 2):
            cut.append(bands[i])
            if i + 1 == len(depth):
                now.append(depth[i])
                step += [(i // 2, k, i, k, None, None, 0) for k in range(depth[i])]
            else:
                n = math.ceil(share(bands[i], bands[i + 2], f_min, f_max) * (rows - 1.0)) + 1
                low, high = f(share(bands[i], bands[i + 1], bands[i], bands[i + 2])), f(share(bands[i + 1], bands[i + 2], bands[i], bands[i + 2]))
                now.append(n)
                step += [(i // 2, k, i, min(int(low * f(k)), depth[i] - 1), i + 1, min(int(high * f(k)), depth[i + 1] - 1), int(low * f(k))) for k in range(n)]
        depth, bands = now, [*cut, bands[-1]]
        out.append(step)
    return out


@pytest.mark.parametrize("channels", [2, 7, 8, 11, 32])
def test_truncating_plan_equals_plain_loops(channels):
    plan = grids.truncating_plan(channels, 1000.0, 1500.0, 16)[1]
    got = [[(n.sub, n.k, n.tail_sub, n.tail_k, n.head_sub, n.head_k, n.offset) for n in nodes] for nodes in plan]
    assert got == published_plan(channels, 1000.0, 1500.0, 16)


def exact_rounding_plan(channels, f_min, f_max, dt_max):
    """The published merge of neighbouring bands in exact fractions: (delays of the first rows, of each merge the rows (delay, tail, head, offset), final delays), and how near to a half any rounding came.

    Written apart from the engine: bands are (first channel, channels) and recursion goes by pairs from the left.
    """
    from fractions import Fraction as Q

    width, near = Q(f_max - f_min) / channels, [Q(1)]

    def disp(a, b):
        return 1 / (a * a) - 1 / (b * b)

    def rounded(x):
        near.append(abs(abs(x - int(x)) - Q(1, 2)))
        return int(x + Q(1, 2))

    whole = disp(Q(f_min), Q(f_max))
    edge = lambda c: Q(f_min) + width * c
    bands = [(c, 1) for c in range(channels)]
    depth = lambda band: rounded(dt_max * disp(edge(band[0]), edge(band[0] + band[1])) / whole)
    first, merges = [list(range(depth(b) + 1)) for b in bands], []
    while len(bands) > 1:
        pairs = [bands[i : i + 2] for i in range(0, len(bands), 2)]
        nodes = []
        for pair in pairs:
            lo, n = pair[0][0], sum(b[1] for b in pair)
            if len(pair) == 1:
                nodes.append(None)
                continue
            # The point in the middle belongs half a channel to either side.
            middle, own = edge(lo + pair[0][1]), disp(edge(lo), edge(lo + n))
            for d in range(depth((lo, n)) + 1):
                tail, offset = rounded(d * disp(edge(lo), middle - width / 2) / own), rounded(d * disp(edge(lo), middle + width / 2) / own)
                nodes.append((lo, d, min(tail, depth(pair[0])), min(max(d - offset, 0), depth(pair[1])), offset))
        merges.append(nodes)
        bands = [(p[0][0], sum(b[1] for b in p)) for p in pairs]
    return first, merges, list(range(dt_max + 1)), min(near)


@pytest.mark.parametrize("channels, f_min, f_max, dt_max", [(8, 1000, 1500, 12), (16, 400, 800, 31), (32, 1000, 1500, 12), (4, 100, 120, 9), (64, 1200, 1600, 100)])
def test_rounding_plan_equals_exact_fractions(channels, f_min, f_max, dt_max):
    first, merges, last, near = exact_rounding_plan(channels, f_min, f_max, dt_max)
    got_first, plan, delays = grids.rounding_plan(channels, float(f_min), float(f_max), dt_max)
    assert near > 1e-5 and got_first == first and delays == last and len(plan) == len(merges)
    for nodes, want in zip(plan, merges, strict=True):
        assert [(n.k, n.tail_k, n.head_k, n.offset) for n in nodes] == [w[1:] for w in want]


def test_chunks_end_with_the_block(spark):
    got = grids.chunks(100, 40, 5)
    assert [(c.start, c.start + c.length) for c in got] == [(0, 40), (30, 70), (60, 100)]
    samples = spark.range(100).select(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("chan"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    cut = chunks.cut_chunks(samples, 100, 40, 5)
    assert rows(cut.groupBy("chunk").agg(F.count("*"), F.min("x"), F.max("x"))) == [(0, 40, 0.0, 39.0), (1, 40, 30.0, 69.0), (2, 40, 60.0, 99.0)]


def test_stream_finds_what_batch_finds(spark, tmp_path):
    w = image(spark, 64)
    for k in range(2):
        w.select(F.lit(0).cast("long").alias("block"), F.lit(k).cast("long").alias("chunk"), "chan", "t", (F.col("x") + k).alias("x")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chunks.search_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), [1, 2], 4.0).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = rows(chunks.search(w, [1, 2], 4.0, (2, 1, 2)))
    assert want and rows(got.where("chunk = 0").select("mt", "mdt", "mwidth", "msnr", "num")) == want


def header(nchan=2, size=32, bw=-0.5):
    cards = [f"{k:<8}= {v}" for k, v in {"BACKEND": "'RAW'", "NBITS": 8, "CHAN_BW": bw, "OBSFREQ": -1400.0, "OBSNCHAN": nchan, "OBSBW": -1.0, "BLOCSIZE": size, "TELESCOP": "'GBT'", "NPOL": 4, "TBIN": 1e-6, "DIRECTIO": 0}.items()]
    return "".join(c.ljust(80) for c in [*cards, "END"]).encode()


def test_raw_recording(spark, tmp_path):
    path = tmp_path / "x.raw"
    payload = bytes(range(32))
    path.write_bytes((header() + payload) * 3)
    raw.register(spark)
    got = spark.read.format("raw_voltage").load(str(path))
    assert got.count() == 6
    one = spark.read.format("raw_voltage").option("blocks", "1").load(str(path)).collect()
    assert {(r.block, r.chan, bytes(r.data)) for r in one} == {(1, 1, payload[:16]), (1, 0, payload[16:])}
    assert one[0].chan_bw == 0.5 and one[0].obs_freq == 1400.0 and one[0].telescope == "GBT"
    cells = raw.samples(got.where("block = 0 and chan = 1"))
    assert rows(cells.select("pol", "isamp", "re", "im"))[:2] == [(0, 0, 0.0, 1.0), (0, 1, 4.0, 5.0)]
    for damaged in ((header() + payload) * 2 + b"x" * 90, header() + payload[:-1]):
        path.write_bytes(damaged)
        with pytest.raises(ValueError):
            raw.plan_blocks(str(path))
    path.write_bytes(header().replace(b"DIRECTIO= 0", b"DIRECTIO= 1").ljust(1024) + payload.ljust(512) + header() + payload)
    assert [b.offset for b in raw.plan_blocks(f"file://{path}")] == [1024, 1536 + 960]


def test_command_line_searches_a_recording(spark, tmp_path):
    from skysift import __main__ as cli

    rng = np.random.default_rng(3)
    data = rng.integers(-20, 21, (4, 64 * 4, 4)).astype(np.int8)
    data[:, 100:104] = 120
    cards = {"BACKEND": "'RAW'", "NBITS": 8, "CHAN_BW": 4.0, "OBSFREQ": 1016.0, "OBSNCHAN": 4, "OBSBW": 16.0, "BLOCSIZE": data.size, "TELESCOP": "'GBT'", "NPOL": 4, "TBIN": 1e-3, "DIRECTIO": 0}
    (tmp_path / "x.raw").write_bytes("".join(f"{k:<8}= {v}".ljust(80) for k, v in cards.items()).encode() + b"END".ljust(80) + data.tobytes())
    plan = cli.run(spark, cli.options(["-n", str(tmp_path / "x.raw"), "-N", str(tmp_path / "out"), "-P", "2e-3", "-b", "3", "-k", "0.02", "-d", "5", "--d-min", "0.01", "--nbin", "64", "--nfft", "2"]))
    assert plan.rows == 8 and plan.widths == (1, 2, 3, 4, 5)
    got = spark.read.text(str(tmp_path / "out" / "delegates"))
    assert got.count() > 0 and set(got.columns) == {"value", "block", "chunk"}
    chunks_ = sorted(r.chunk for r in got.select("chunk").distinct().collect())
    log = [r.value for r in spark.read.text(str(tmp_path / "out" / "run")).collect()]
    assert f"Numbers of Successful Chunks: {chunks_}" in log and f"Length of Chunk: {plan.length}" in log


def test_command_line_reports_once_over_a_folder(spark, tmp_path):
    """Recordings of a folder are told apart, trials are shared by tasks, and what two chunks see is one line."""
    from skysift import __main__ as cli

    into = tmp_path / "in"
    into.mkdir()
    voltages(into, at=108, blocks=2)
    voltages(into, name="b.raw", at=108, seed=3)
    given = ["-n", str(into), "-P", "5e-7", "-b", "9", "-k", "0.002", "-d", "4", "--d-min", "0.0005", "--nbin", "64", "--nfft", "4", "--parts", "2"]
    for once in (False, True):
        out = str(tmp_path / f"out{once}")
        plan = cli.run(spark, cli.options([*given, "-N", out, *(["--once"] if once else [])]))
        got = spark.read.text(f"{out}/delegates")
        assert set(got.columns) == {"value", "file", "block"} | (set() if once else {"chunk"})
        assert {(r.file, r.block) for r in got.collect()} == {("a.raw", 0), ("a.raw", 1), ("b.raw", 0)} and len(plan.dms) > 1
        found = [int(r.value[10:20]) for r in got.where("file = 'b.raw'").collect()]
        assert found
        if once:
            assert all(abs(t * plan.subs - 108) < 60 for t in found)


def test_a_frame_too_short_for_its_overlap_is_an_error():
    from skysift import __main__ as cli

    o = cli.options(["-n", "x", "-N", "y", "-P", "2e-6", "-k", "600", "--nbin", "4096"])
    header = {"obs_freq": 1400.0, "obs_bw": 400.0, "chan_bw": 50.0, "tbin": 2e-6, "nchan": 8}
    with pytest.raises(ValueError, match="overlaps"):
        cli.plan_of(o, header | {"obs_freq": 400.0})


def test_chunk_search_equals_numpy(spark):
    """One chunk and trial through frames, filter, power and statistics against plain numpy."""
    from skysift.operators import coherent

    plan = coherent.SearchPlan(1000.0, 1032.0, 2.5e-4, 2, 4, 32, 3, 8, (5.0,), 1.0)
    rng = np.random.default_rng(5)
    n = (plan.nbin - 2 * plan.overlap) * plan.nfft
    z = rng.integers(-9, 10, (2, 2, n)) + 1j * rng.integers(-9, 10, (2, 2, n))
    df = spark.createDataFrame([(7, c, p, i, float(z[c, p, i].real), float(z[c, p, i].imag)) for c in range(2) for p in range(2) for i in range(n)], "chunk long, chan long, pol long, isamp long, re double, im double")
    power = np.zeros((8, 4 * plan.nfft))
    for c in range(2):
        for p in range(2):
            padded = np.concatenate([np.zeros(8), z[c, p], np.zeros(8)])
            for f in range(plan.nfft):
                s = np.fft.fftshift(np.fft.fft(padded[16 * f : 16 * f + 32]))
                for k in range(4):
                    y = np.fft.ifft(s[8 * k : 8 * k + 8] * coherent.chirp_of(plan, c, 5.0)[k]) / 4
                    power[(1 - c) * 4 + 3 - k, 4 * f : 4 * f + 4] += np.abs(y[2:6]) ** 2
    spectra = {c: coherent.spectrum_of(z[c], plan) for c in range(2)}
    assert np.allclose(coherent.power_of(spectra.__getitem__, plan, 5.0), power)
    got = coherent.images(df, plan, ["chunk"])
    assert got.count() == 4 * 12 and got.select("chunk", "trial").distinct().collect() == [(7, 0)]


def test_npy_round_trip(spark, tmp_path):
    files.write_npy(spark.createDataFrame([("a", [2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "name string, shape array<long>, data array<double>"), str(tmp_path))
    r = files.read_npy(spark, str(tmp_path / "a.npy")).first()
    assert r.shape == [2, 3] and r.data == [1, 2, 3, 4, 5, 6]


def test_image_bundle(spark, tmp_path):
    for name, a in {"imaxDT": np.array([8]), "XX": np.arange(32), "iarrShape": np.array([4, 8]), "fmin_max": np.array([1000.0, 1500.0], np.float32)}.items():
        np.save(tmp_path / f"{name}.npy", a)
    image_, meta = files.read_image_bundle(spark, str(tmp_path))
    assert meta == {"rows": 4, "cols": 8, "max_dt": 8, "f_min": 1000.0, "f_max": 1500.0} and image_.where("r = 3 and c = 7").first().x == 31
    assert not files.is_image_shape(2, 8) and not files.is_image_shape(6, 8)


def test_small_readers(spark, tmp_path):
    (tmp_path / "c.txt").write_text("snr sampno secs boxcar idt dm beamno\n 5.5 10 0.1 2 3 40.0 1\nbad row\n")
    assert rows(files.read_candidates(spark, str(tmp_path / "c.txt"))) == [(10, 3, 2, 5.5)]
    (tmp_path / "f.bin").write_bytes(np.array([1, 2.5], "<f4").tobytes())
    assert rows(files.read_floats(spark, str(tmp_path / "f.bin"))) == [(0, 1.0), (1, 2.5)]
    assert files.count_candidates(spark, str(tmp_path / "c.txt")) == 2
    log = files.run_log("x.raw", "p", 64, [3, 5], 9, [30.5, 40])
    assert log[4] == "Numbers of Successful Chunks: [3, 5]" and log[5] == "Successfull coherentD Array: [30.5, 40]"
    files.write_lines(spark.createDataFrame([(x,) for x in log], "line string"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 7 and files.log_values(spark.read.text(str(tmp_path / "log")), "Length of Chunk:").first()[0] == [64.0]
    line = spark.createDataFrame([(1, 10, 3, 2, 5.5)], "n long, mt long, mdt long, mwidth long, msnr double").select(files.candidate_line(1.0, 0.5)).first()[0]
    assert line == "         1        10  6.000000         3         2  5.500000"
    assert files.sibling_planes("a/L1_S0_P0.raw")[3] == "a/L1_S3_P0.raw" and files.plane_shift(4096) == 1024
    assert files.read_packed_header(struct.pack("<iiffff", 7, 2, 50, 100, 200, 4))["samples"] == 7
    log = spark.createDataFrame([("widths: 1, 2 4",), ("other",)], "value string")
    assert files.log_values(log, "widths:").first()[0] == [1.0, 2.0, 4.0]
    h = files.read_sidecar_header(json.dumps({"tstart": 59000.5, "nsamp": 10, "fcen": 1.5e8, "bwchan": 2e5, "tsamp": 1e-6, "nsub": 3, "unit": "Hz"}))
    assert h["cent_freq"] == 150.0 and h["block_size"] == 120
    for i in range(2):
        (tmp_path / f"p{i}.raw").write_bytes(bytes([i, 255, 2, 3]))
    planes = files.read_planes(spark, [str(tmp_path / f"p{i}.raw") for i in range(2)], 2, each=2)
    assert rows(planes)[:2] == [(0, 0, 0, 0.0), (0, 0, 1, 2.0)]
    assert rows(files.plane_samples(planes))[:2] == [(0, 0, 0, 0.0, 1.0), (0, 0, 1, 2.0, 2.0)]


def test_scalar_plans():
    assert grids.sub_channels(1e-3, 3e-4) == 4 and grids.max_dt(1000, 1500, 1e-3, 0) == 1
    assert grids.coherent_count(600, 1000, 1500, 1e-6, 2e-5) == math.ceil(grids.delay(1000, 1500, grids.K_OVERLAP * 600) * 1e-6 / 4e-10)
    n = grids.optimal_overlap(50, 100, 0.2, 1, 5e-6)
    assert n & (n - 1) == 0 and n > 0


def test_without_the_training_data_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "skysift", tmp_path / "skysift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0 and int(run.stdout.split()[0]) > 50, run.stderr


def voltages(tmp_path, n=480, at=None, name="a.raw", nbits=8, channels=4, blocks=1, seed=11):
    """A recording of noise with a dispersed impulse that leaves the highest frequency at a sample; (file, plan)."""
    from skysift.operators.coherent import SearchPlan

    plan = SearchPlan(f_min=400.0, f_max=416.0, t_sample=2.5e-7, channels=channels, subs=2, nbin=64, nfft=4, overlap=16, dms=(0.002,), threshold=9.0)
    rng = np.random.default_rng(seed)
    kind = {8: np.int8, 16: np.dtype("<i2")}[nbits]
    out = b""
    for _ in range(blocks):
        data = np.clip(rng.normal(0, 6, (channels, n, 4)), -127, 127)
        if at is not None:
            for c in range(channels):
                f = plan.f_min + (c + 0.5) * (plan.f_max - plan.f_min) / channels
                lag = 4148.808 * 0.002 * (1 / f**2 - 1 / plan.f_max**2) / plan.t_sample
                data[c, int(round(at + lag)) :][:2] = 90
        cards = {"BACKEND": "'RAW'", "NBITS": nbits, "CHAN_BW": 4.0, "OBSFREQ": 408.0, "OBSNCHAN": channels, "OBSBW": 16.0, "BLOCSIZE": data.size * nbits // 8, "TELESCOP": "'GBT'", "NPOL": 4, "TBIN": plan.t_sample, "DIRECTIO": 0}
        out += "".join(f"{k:<8}= {v}".ljust(80) for k, v in cards.items()).encode() + b"END".ljust(80) + np.round(data).astype(kind).tobytes()
    (tmp_path / name).write_bytes(out)
    return tmp_path / name, plan


def strongest(found):
    return max(found.collect(), key=lambda r: r.msnr)


def test_a_pulse_at_a_chunk_edge_keeps_its_power_and_is_found_once(spark, tmp_path):
    from skysift.operators import coherent

    powers = []
    # Chunks of 128 samples begin every 96; 60 lies within the first one, 100 to 124 where two meet.
    for at in (60, 92, 100, 108, 116, 124):
        path, plan = voltages(tmp_path, at=at)
        found = coherent.search_recordings(raw.index(spark, str(path)), plan, once=True)
        best = strongest(found)
        near = [r for r in found.collect() if abs(r.mt - best.mt) <= 4 and r.msnr > 0.7 * best.msnr]
        assert len(near) == 1 and abs(best.mt * plan.subs - at) < 45
        powers.append(best.msnr)
    assert min(powers) > 0.85 * max(powers)


def test_recordings_are_searched_in_tasks_without_a_shuffle_of_samples(spark, tmp_path, monkeypatch):
    from skysift.operators import coherent

    path, plan = voltages(tmp_path, at=150, blocks=3)
    voltages(tmp_path, name="b.raw", nbits=16, at=40)
    opened = []
    monkeypatch.setattr(raw, "open_file", lambda p: opened.append(p))
    blocks = raw.index(spark, str(tmp_path))
    assert not opened and blocks.count() == 4
    found = coherent.search_recordings(blocks, plan)
    assert {(r.file, r.block) for r in found.collect()} == {("a.raw", 0), ("a.raw", 1), ("a.raw", 2), ("b.raw", 0)}
    physical = found._jdf.queryExecution().toString()
    assert physical.count("Exchange hashpartitioning") == 2  # the same one in the first and the final plan
    parts = coherent.search_recordings(blocks, replace_dms(plan, (0.001, 0.002, 0.003)), parts=2)
    assert rows(parts) == rows(coherent.search_recordings(blocks, replace_dms(plan, (0.001, 0.002, 0.003))))


def replace_dms(plan, dms):
    from dataclasses import replace

    return replace(plan, dms=dms)


def test_stream_over_recordings_gives_the_batch_and_repeats_nothing(spark, tmp_path):
    from skysift.operators import coherent

    into, out = tmp_path / "in", tmp_path / "out"
    into.mkdir()
    path, plan = voltages(into, at=150, blocks=2)
    whole = path.read_bytes()
    path.write_bytes(whole[: len(whole) - 100])  # still growing: its second block is not whole
    start = lambda: chunks.search_recordings_stream(spark, str(into), str(out), str(tmp_path / "cp"), plan).awaitTermination()
    start()
    assert {r.block for r in spark.read.parquet(str(out)).select("block").distinct().collect()} == {0}
    first = {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet")}
    path.write_bytes(whole)
    voltages(into, name="b.raw", at=40, seed=4)
    start()
    want = coherent.search_recordings(raw.index(spark, str(into)), plan)
    names = want.columns
    got = spark.read.schema(want.schema).parquet(str(out))
    assert rows(got.select(names)) == rows(want) and len({r.file for r in want.collect()}) == 2
    assert all(p.stat().st_mtime_ns == t for p, t in first.items())  # what was done was not done again
    start()
    assert rows(spark.read.schema(want.schema).parquet(str(out)).select(names)) == rows(want)


def test_filters_reach_the_reader(spark, tmp_path):
    path, plan = voltages(tmp_path, blocks=5)
    raw.register(spark)
    got = spark.read.format("raw_voltage").load(str(tmp_path)).where("block = 3 and chan >= 2")
    assert got.rdd.getNumPartitions() == 1
    assert "Filter" not in got._jdf.queryExecution().executedPlan().toString().replace("PushedFilters", "").replace("isnotnull", "") or got.count() == 2
    assert rows(got.select("block", "chan")) == [(3, 2), (3, 3)]
    assert spark.read.format("raw_voltage").load(str(tmp_path)).where("block > 7").count() == 0


def test_headers_of_other_modes_and_depths_are_refused(tmp_path):
    path, _ = voltages(tmp_path)
    good = path.read_bytes()
    for old, new in ((b"'RAW'", b"'PSR'"), (b"NBITS   = 8", b"NBITS   = 2")):
        path.write_bytes(good.replace(old, new))
        with pytest.raises(ValueError):
            raw.plan_blocks(str(path))


def test_four_planes_are_searched_like_one_recording(spark, tmp_path):
    """The same samples, interleaved in one file and in four planes."""
    from skysift.operators import coherent

    path, plan = voltages(tmp_path, at=150)
    data = np.frombuffer(path.read_bytes()[-4 * 480 * 4 :], np.int8).reshape(4, 480, 4)
    planes = tmp_path / "planes"
    planes.mkdir()
    for i in range(4):
        (planes / f"L1_S{i}_P0.raw").write_bytes(data[:, :, i].T.tobytes())
    header = {"nbits": 8, "npol": 4, "nchan": 4, "chan_bw": 4.0, "cent_freq": 408.0, "obs_bw": 16.0, "block_size": data.size, "t_resolution": plan.t_sample}
    block = files.plane_block(spark, str(planes / "L1_S0_P0.raw"), header)
    one, four = (coherent.search_recordings(b, plan).drop("file") for b in (raw.index(spark, str(path)), block))
    assert rows(one) and rows(one) == rows(four)
    header["block_size"] *= 2
    with pytest.raises(ValueError):
        files.plane_block(spark, str(planes / "L1_S0_P0.raw"), header)


def test_logs_appear_as_a_whole_or_not_at_all(spark, tmp_path):
    from skysift.sources import sinks

    sinks.register(spark)
    out = tmp_path / "logs"
    out.mkdir()
    found = spark.createDataFrame([(b, c, n, 10 * n, 3, 2, 5.5, 4) for b in range(2) for c in range(3) for n in (2, 1)], "block long, chunk long, n long, mt long, mdt long, mwidth long, msnr double, num long")
    lines = sinks.log_lines(found, files.delegate_line(1.0, 0.5), ["n"])
    lines.write.format("chunk_logs").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == [f"output_{b}_ {c}.log" for b in range(2) for c in range(3)]
    assert (out / "output_1_ 2.log").read_text().splitlines() == [
        "         N    t, bin    t, sec    dedisp     width       SNR       num",
        "         1        10  6.000000         3         2  5.500000         4",
        "         2        20 11.000000         3         2  5.500000         4",
    ]
    # A task that fails, and lines that do not stand together, leave all as it was.
    bad = lines.withColumn("line", F.when(F.col("chunk") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    apart = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 0, "c")], "block long, chunk long, line string").coalesce(1)
    shared = spark.createDataFrame([(0, 0, "a"), (0, 0, "c")], "block long, chunk long, line string").repartition(2)
    before = {p.name: p.read_text() for p in out.iterdir()}
    for rows_ in (bad, apart, shared):
        with pytest.raises(Exception):
            rows_.write.format("chunk_logs").mode("overwrite").save(str(out))
        assert {p.name: p.read_text() for p in out.iterdir()} == before
    lines.where("block = 1 and chunk = 0").write.format("chunk_logs").mode("overwrite").save(str(out))
    assert [p.name for p in out.iterdir()] == ["output_1_ 0.log"]


@pytest.mark.parametrize("order", ["C", "F"])
def test_one_array_is_read_by_many_tasks(spark, tmp_path, order):
    from skysift.sources import arrays

    a = np.random.default_rng(2).integers(-99, 99, (37, 11, 3)).astype(">i2" if order == "C" else "<f8")
    np.save(tmp_path / "a.npy", np.asarray(a, order=order))
    got = arrays.read_arrays(spark, str(tmp_path / "a.npy"), each=100)
    assert got.rdd.getNumPartitions() == 13
    assert [x for _, x in rows(got.select("i", "x"))] == a.ravel().astype(float).tolist() and got.first().shape == [37, 11, 3]
    whole = (tmp_path / "a.npy").read_bytes()
    for damaged in (whole[:-1], b"other" + whole):
        (tmp_path / "a.npy").write_bytes(damaged)
        with pytest.raises(Exception):
            arrays.read_arrays(spark, str(tmp_path / "a.npy")).count()


def test_an_array_is_written_by_many_tasks(spark, tmp_path):
    from skysift.sources import arrays

    cells = spark.range(1000).select((F.col("id") / 8).cast("long").alias("r"), (F.col("id") % 8).alias("c"), (F.col("id") * 0.5).alias("x")).repartition(3)
    files.write_array(cells, ["r", "c"], str(tmp_path / "a.npy"), (125, 8), each=100)
    assert np.array_equal(np.load(tmp_path / "a.npy"), np.arange(1000).reshape(125, 8) * 0.5)
    files.write_array(cells, ["c", "r"], str(tmp_path / "b.npy"), (125, 8), by_columns=True, each=100)
    assert np.array_equal(np.load(tmp_path / "b.npy"), np.arange(1000).reshape(125, 8) * 0.5)
    with pytest.raises(ValueError):
        files.write_array(cells, ["r", "c"], str(tmp_path / "c.npy"), (125, 9))
    files.write_array(cells, ["r", "c"], str(tmp_path / "d" / "x.bin"), None, each=300)
    assert rows(arrays.read_dump(spark, str(tmp_path / "d"), each=64).select("i", "x")) == [(i, i * 0.5) for i in range(1000)]


def test_pictures_decode_to_their_levels(spark, tmp_path):
    from skysift.sources import sinks

    levels = np.random.default_rng(1).integers(-255, 256, (70, 45))
    assert np.array_equal(sinks.decoded(sinks.encoded(levels)), np.abs(levels))
    damaged = bytearray(sinks.encoded(levels))
    damaged[60] ^= 1
    with pytest.raises(ValueError):
        sinks.decoded(bytes(damaged))
    df = spark.createDataFrame([(r, c, int(levels[r, c])) for r in range(70) for c in range(45)], "r long, c long, level long")
    sinks.write_images(df, str(tmp_path), side=32)
    assert len(list(tmp_path.glob("r*_c*.png"))) == 6
    assert rows(sinks.read_images(spark, str(tmp_path))) == [(r, c, abs(int(levels[r, c]))) for r in range(70) for c in range(45)]


@pytest.mark.parametrize("new", [False, True])
def test_container_gives_the_header(spark, tmp_path, new):
    from container_fixture import sidecar

    from skysift.sources import container

    want = {"nbits": 8, "npol": 4, "nchan": 4, "chan_bw": 4.0, "cent_freq": 408.0, "obs_bw": 16.0, "block_size": 7680, "t_resolution": 2.5e-7, "tstart": 59000.5, "ra": 53.2, "dec": 54.5, "source": "B0329+54"}
    name = "L1_SAP002_B001_S0_P000_bf.h5"
    assert container.header_of(sidecar(new), name) == pytest.approx(want)
    assert container.header_of(sidecar(new, centre=408.0, unit="MHz", width=4.0), name) == pytest.approx(want)
    for damaged in (b"", sidecar(new)[:200], b"x" + sidecar(new)):
        with pytest.raises((ValueError, struct.error, IndexError)):
            container.header_of(damaged, name)
    with pytest.raises(ValueError, match="no group"):
        container.header_of(sidecar(new), name.replace("B001", "B007"))
    with pytest.raises(ValueError, match="pointing"):
        container.header_of(sidecar(new), "L1.h5")
    for i in range(3):
        (tmp_path / f"L{i}_SAP002_B001_S0_P000_bf.h5").write_bytes(sidecar(new, samples=10 + i))
    got = container.headers(spark, str(tmp_path))
    assert rows(got.select("block_size", "source")) == [(16 * (10 + i), "B0329+54") for i in range(3)]
    assert container.planes_of(f"a/{name}") == "a/L1_SAP002_B001_S0_P000_bf.raw"


def test_command_line_searches_four_planes_by_their_container(spark, tmp_path):
    from container_fixture import sidecar

    from skysift import __main__ as cli

    path, plan = voltages(tmp_path, at=150)
    data = np.frombuffer(path.read_bytes()[-4 * 480 * 4 :], np.int8).reshape(4, 480, 4)
    for i in range(4):
        (tmp_path / f"L1_SAP002_B001_S{i}_P000_bf.raw").write_bytes(data[:, :, i].T.tobytes())
    (tmp_path / "L1_SAP002_B001_S0_P000_bf.h5").write_bytes(sidecar())
    given = ["-P", "5e-7", "-b", "9", "-k", "0.002", "-d", "4", "--d-min", "0.001", "--nbin", "64", "--nfft", "4"]
    outs = []
    for name, out in (("L1_SAP002_B001_S0_P000_bf.h5", "four"), ("a.raw", "one")):
        cli.run(spark, cli.options(["-n", str(tmp_path / name), "-N", str(tmp_path / out), *given]))
        outs.append(rows(spark.read.text(str(tmp_path / out / "delegates"))))
    assert outs[0] and outs[0] == outs[1]


@pytest.mark.parametrize("keys", [[], ["file"]])
def test_clusters_are_the_same_by_ranges_and_in_one_task(spark, keys):
    rng = np.random.default_rng(8)
    values = [(f"f{rng.integers(3)}", int(rng.integers(60)) * 2, int(rng.integers(12)), int(rng.integers(1, 5)), float(i)) for i in range(900)]
    cand = spark.createDataFrame(values, "file string, mt long, mdt long, mwidth long, msnr double").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # numbers go on from batch to batch
    try:
        for gaps in ((2, 1, 2), (1, 0, 0), (200, 3, 1)):
            got, want = (rows(cluster.clusters(cand if keys else cand.drop("file"), gaps, keys, few)) for few in (0, 10_000))
            assert got == want and len(want) == 900
        best = cluster.delegates(cluster.clusters(cand, (2, 1, 2), ["file"]), ["file"])
        numbers = [rows(cluster.ranked(best if keys else best.drop("file").dropDuplicates(["mt", "mdt", "mwidth"]).cache(), keys, few)) for few in (0, 10_000)]
        assert numbers[0] == numbers[1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = cluster.gap_groups(cand, keys, "mt", 2, "g1")
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()  # what is left after its one shuffle
