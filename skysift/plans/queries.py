"""One query per operator, over views of whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.views import CHANNELS, hours, matrix, raw_candidates, rounded, waterfall
from skysift.operators import cluster, coherent, dedisp, detect, frame, scan, spectral, stats
from skysift.plans import columns, grids
from skysift.sources import files, raw
from skysift.streaming import chunks

# Parameters that queries and SQL share.
THRESHOLD, WIDTHS, POW2, GAPS = 4.0, [1, 2, 3, 4], [1, 2, 4, 8], (2, 1, 2)
F_MIN, F_MAX, T_SAMPLE, DM = 1000.0, 1500.0, 1e-3, 25.0
BANDS, ROWS, DT_MAX = CHANNELS, 16, 12
ODD = 11
SUBS, MBIN, CHAN_BW = 4, 32, 16.0
NBIN, OVERLAP = 96, 8
SEARCH = coherent.SearchPlan(f_min=1000.0, f_max=1032.0, t_sample=2.5e-4, channels=2, subs=4, nbin=32, nfft=10, overlap=8, dms=(5.0, 10.0, 15.0), threshold=2.0)
CHUNK = (SEARCH.nbin - 2 * SEARCH.overlap) * SEARCH.nfft

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


def _z(spark: SparkSession, d: str) -> DataFrame:
    return stats.excise_zscore(waterfall(spark, d))


def _cand(spark: SparkSession, d: str) -> DataFrame:
    return _r(detect.boxcar(_z(spark, d), WIDTHS, THRESHOLD), "msnr")


def _spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Matrix rows as two polarisations of complex samples: (fft, chan, pol, bin, re, im)."""
    m = matrix(spark, d)
    cell = m.select((F.col("r") / 4).cast("long").alias("fft"), ((F.col("r") / 2).cast("long") % 2).alias("chan"), (F.col("r") % 2).alias("pol"), (F.col("c") / 2).cast("long").alias("bin"), (F.col("c") % 2).alias("part"), "x")
    return cell.groupBy("fft", "chan", "pol", "bin").agg(F.sum(F.when(F.col("part") == 0, F.col("x"))).alias("re"), F.sum(F.when(F.col("part") == 1, F.col("x"))).alias("im"))


@query
def row_stats(spark, d):
    return _r(stats.row_stats(waterfall(spark, d)), "mean", "var", digits=3)


@query
def global_stats(spark, d):
    return _r(stats.global_stats(stats.row_stats(waterfall(spark, d))), "mean", "std", digits=3)


@query
def disp_stats(spark, d):
    return _r(stats.variance_stats(stats.row_stats(waterfall(spark, d))), "mean_var", "std_var", digits=1)


@query
def rfi_excise_zscore(spark, d):
    return _r(_z(spark, d), "x")


@query
def rfi_clean(spark, d):
    return stats.clean(waterfall(spark, d))


@query
def quarter_scale(spark, d):
    return _r(stats.quarter_scale(waterfall(spark, d)), "x")


@query
def dispersion_about(spark, d):
    return _r(stats.dispersion_about(waterfall(spark, d), 2000.0), "disp", digits=3)


@query
def summary_moments(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_quantity").alias("q"))
    return _r(stats.moments(items, "l_returnflag", "q"), "mean_v", "var_v", "var_n", "skew", "kurt", digits=5)


@query
def max_element(spark, d):
    return stats.largest(waterfall(spark, d), "x")


@query
def boxcar_pow2(spark, d):
    return _r(detect.boxcar(_z(spark, d), POW2, THRESHOLD, log_index=True), "msnr")


@query
def boxcar_plan(spark, d):
    return detect.boxcar_plan(_z(spark, d), WIDTHS, THRESHOLD)


@query
def boxcar_linear(spark, d):
    return _cand(spark, d)


@query
def below_threshold(spark, d):
    return detect.below(_cand(spark, d), 6.0)


@query
def best_detection(spark, d):
    z = _z(spark, d)
    return _r(detect.best_detection(z.select("chan", "t", "x"), z.select("chan", "t", F.col("mask").alias("x")), list(range(1, 11)), 0.0), "snr")


@query
def energy_ratio(spark, d):
    z = _z(spark, d)
    norm = z.select("chan", "t", (1 + F.col("t") % 3).cast("double").alias("x"))
    return _r(detect.energy_ratio(z.select("chan", "t", "x"), norm, [1, 2, 3], 1.5), "snr")


@query
def gap_split_mt(spark, d):
    one = cluster.gap_groups(raw_candidates(spark, d).withColumn("g", F.col("mwidth")), ["g"], "mt", GAPS[0], "g1")
    return one.select("mt", "mdt", "mwidth", "msnr", "g1")


@query
def split_plan(spark, d):
    one = cluster.gap_groups(raw_candidates(spark, d).withColumn("g", F.col("mwidth")), ["g"], "mt", GAPS[0], "g1")
    return cluster.subgroup_counts(one, "g", "g1")


@query
def cluster_3axis(spark, d):
    return cluster.clusters(_cand(spark, d), GAPS)


@query
def cluster_raw(spark, d):
    return cluster.clusters(raw_candidates(spark, d), (8, 40, 1))


@query
def delegates(spark, d):
    return cluster.delegates(cluster.clusters(_cand(spark, d), GAPS)).drop("num")


@query
def delegates_sorted(spark, d):
    return cluster.ranked(cluster.delegates(cluster.clusters(_cand(spark, d), GAPS)).drop("num"))


@query
def cluster_sizes(spark, d):
    return cluster.clusters(_cand(spark, d), GAPS).groupBy("g1", "g2", "g3").agg(F.count("*").alias("num"))


@query
def segmented_sort_rank(spark, d):
    return cluster.segment_rank(raw_candidates(spark, d), ["mwidth"], "mt", ["mdt", "msnr"])


@query
def index_sort(spark, d):
    return cluster.segment_rank(_cand(spark, d), [], "mt", ["mdt", "mwidth"])


def _indexed(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("v"))


@query
def inclusive_scan(spark, d):
    return scan.prefix_sum(_indexed(spark, d), "i", "v")


@query
def exclusive_scan(spark, d):
    return scan.prefix_sum(_indexed(spark, d), "i", "v", exclusive=True)


@query
def permuted_scan(spark, d):
    heap = _indexed(spark, d).withColumnRenamed("i", "pos")
    last = heap.agg(F.max("pos").alias("last"))
    order = heap.crossJoin(F.broadcast(last)).select((F.col("last") - F.col("pos")).alias("i"), "pos")  # one row
    return scan.permuted_prefix_sum(order, heap, "v")


@query
def overlap_frames(spark, d):
    step = NBIN - 2 * OVERLAP
    w = waterfall(spark, d, multiple=step)
    return frame.overlap_frames(w.withColumnRenamed("t", "isamp"), NBIN, hours(w) // step, OVERLAP, ["chan"], ["x"])


@query
def fftshift(spark, d):
    return frame.fft_shift(matrix(spark, d), "c", 64, ["x"], 1 / 64)


@query
def circular_roll(spark, d):
    return frame.roll(matrix(spark, d), "c", 64, 67)


@query
def rolled_power(spark, d):
    return frame.rolled_power(_spectrum(spark, d), MBIN)


@query
def power_polsum(spark, d):
    return frame.power(_spectrum(spark, d), ["fft", "chan", "bin"])


@query
def unpad_transpose(spark, d):
    p = frame.power(_spectrum(spark, d), ["fft", "chan", "bin"]).withColumn("sub", F.col("fft") % 2).withColumn("fft", (F.col("fft") / 2).cast("long"))
    return frame.unpad_transpose(p, MBIN, 4, 2, 2, "x")


@query
def unpad_transpose_complex(spark, d):
    s = _spectrum(spark, d).where("pol = 0").withColumn("sub", F.col("fft") % 2).withColumn("fft", (F.col("fft") / 2).cast("long"))
    return frame.unpad_transpose(s, MBIN, 4, 2, 2, "re", "im")


@query
def transpose(spark, d):
    return frame.transpose(matrix(spark, d), "r", "c")


@query
def digitize(spark, d):
    return frame.digitize(waterfall(spark, d), "x", 11)


@query
def digitize_floor(spark, d):
    return frame.floored(_cand(spark, d), "msnr")


@query
def scale_complex(spark, d):
    return frame.scale_complex(_spectrum(spark, d), 1 / 32)


@query
def quadratic_cut(spark, d):
    """Around a place beyond the last row, moved inside; the height is the table's."""
    m = matrix(spark, d)
    height = (m.agg(F.max("r")).first()[0] or 0) + 1
    return frame.cut(m, height + 3, 60, height, 64, 16)


@query
def image_scale(spark, d):
    return frame.image_levels(matrix(spark, d))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as observations (obs, dm, f_min, f_max, bandwidth, chan_bw, t_sample, pulse) with bands of their own."""
    k = F.col("s_suppkey")
    o = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("obs"), (20.0 + k % 600).alias("dm"), (400.0 + k % 1000).alias("f_min"), (8.0 * (1 + k % 16)).alias("bandwidth"), (0.25 * (1 + k % 5)).alias("chan_bw"), (F.lit(1e-6) * (1 + k % 7)).alias("t_sample"), (F.lit(1e-4) * (1 + k % 9)).alias("pulse"))
    return o.withColumn("f_max", F.col("f_min") + F.col("bandwidth"))


@query
def subchan_freqs(spark, d):
    return _r(spectral.subchannel_frequencies(observations(spark, d), 8, SUBS).select("obs", "chan", "sub", "f"), "f")


@query
def taper_table(spark, d):
    return _r(spectral.taper(observations(spark, d), MBIN, F.col("bandwidth")).select("obs", "bin", "f", "taper"), "f", "taper")


@query
def chirp_table(spark, d):
    return _r(spectral.chirp(observations(spark, d), 2, SUBS, MBIN).select("obs", "chan", "sub", "bin", "re", "im"), "re", "im", digits=4)


@query
def complex_mul(spark, d):
    band = spark.range(1).select(F.lit(F_MIN).alias("f_min"), F.lit(2 * CHAN_BW).alias("bandwidth"), F.lit(DM).alias("dm"))
    h = spectral.chirp(band, 2, 1, MBIN).select("chan", "bin", "re", "im")
    return _r(spectral.multiply(_spectrum(spark, d), h, ["chan", "bin"]).select("fft", "chan", "pol", "bin", "re", "im"), "re", "im", digits=3)


@query
def dft64(spark, d):
    z = matrix(spark, d).select("r", "c", F.col("x").alias("re"), F.lit(0.0).alias("im"))
    return _r(spectral.transformed(z, ["r"], "c"), "re", "im", digits=3)


@query
def idft64(spark, d):
    z = matrix(spark, d).select("r", "c", F.col("x").alias("re"), F.lit(0.0).alias("im"))
    return _r(spectral.transformed(z, ["r"], "c", inverse=True), "re", "im", digits=6)


@query
def dm_grid(spark, d):
    n = observations(spark, d).withColumns({"n": 2 + F.col("obs") % 50, "low": F.lit(10.0)})
    return _r(columns.dm_grid(n, "low", "dm", "n").select("obs", "i", "dm"), "dm")


@query
def chunk_ranges(spark, d):
    """Overlapping chunks of seven blocks, as long as they have orders."""
    blocks = spark.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_orderkey") % 7).alias("block")).agg(F.count("*").alias("samples"))
    return raw.chunk_table(blocks, NBIN, OVERLAP).select("block", "chunk", "first", "taken")


@query
def chunk_cut(spark, d):
    """Every waterfall sample in the chunks that hold it."""
    w = waterfall(spark, d).withColumn("block", F.col("chan") % 2)
    return chunks.cut_chunks(w, hours(w), NBIN, OVERLAP)


@query
def dedisperse_shift(spark, d):
    w = waterfall(spark, d)
    n = hours(w)
    return dedisp.dedisperse(w, dedisp.shifts(CHANNELS, DM, F_MIN, (F_MAX - F_MIN) / CHANNELS, T_SAMPLE, n), n)


def truncating(bands: int = BANDS):
    first, plan = grids.truncating_plan(bands, F_MIN, F_MAX, ROWS)
    return {c: list(range(first + 1)) for c in range(bands)}, plan


def rounding():
    first, plan, _ = grids.rounding_plan(BANDS, F_MIN, F_MAX, DT_MAX)
    return dict(enumerate(first)), plan


def search_parts(p: coherent.SearchPlan = SEARCH):
    first, plan = grids.truncating_plan(p.rows, p.f_min, p.f_max, p.subs)
    return {c: list(range(first + 1)) for c in range(p.rows)}, plan


#: Channels and rows of the plans that observations have.
PLANNED = (8, 16)


@query
def transform_plans(spark, d):
    """The transform's plan for every observation: which rows of an iteration are added, and by how much the second is late."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                first, plan = grids.truncating_plan(PLANNED[0], r.f_min, r.f_max, PLANNED[1])
                rows += [(r.obs, first, step, n.sub, n.k, n.tail_k, n.head_k, n.offset) for step, nodes in enumerate(plan, 1) for n in nodes]
            yield pd.DataFrame(rows, columns=["obs", "first", "step", "sub", "k", "tail_k", "head_k", "late"])

    o = observations(spark, d).select("obs", "f_min", "f_max")
    return o.mapInPandas(run, "obs long, first long, step long, sub long, k long, tail_k long, head_k long, late long")


@query
def rounding_plans(spark, d):
    """The same of the plan whose delays are rounded."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                _, plan, last = grids.rounding_plan(PLANNED[0], r.f_min, r.f_max, DT_MAX)
                rows += [(r.obs, len(last), step, n.sub, n.k, n.tail_k, n.head_k, n.offset) for step, nodes in enumerate(plan, 1) for n in nodes]
            yield pd.DataFrame(rows, columns=["obs", "delays", "step", "sub", "k", "tail_k", "head_k", "late"])

    o = observations(spark, d).select("obs", "f_min", "f_max")
    return o.mapInPandas(run, "obs long, delays long, step long, sub long, k long, tail_k long, head_k long, late long")


def _image(w: DataFrame, parts) -> DataFrame:
    return dedisp.image_of(dedisp.transform(w, *parts))


def _ones(w: DataFrame) -> DataFrame:
    return w.withColumn("x", F.lit(1.0))


@query
def fdmt_init(spark, d):
    return _r(dedisp.transform(waterfall(spark, d), truncating()[0], []), "x")


@query
def fdmt_a(spark, d):
    return _r(_image(waterfall(spark, d), truncating()), "x", digits=4)


@query
def fdmt_b(spark, d):
    return _r(_image(waterfall(spark, d), rounding()), "x", digits=4)


@query
def fdmt_odd(spark, d):
    """Bands that do not halve evenly: the last one is copied in some iterations."""
    return _r(_image(waterfall(spark, d, channels=ODD), truncating(ODD)), "x", digits=4)


@query
def fdmt_ones(spark, d):
    return _r(_image(_ones(waterfall(spark, d)), truncating()), "x")


@query
def fdmt_ratio(spark, d):
    w = waterfall(spark, d)
    return _r(stats.ratio(_image(w, truncating()), _image(_ones(w), truncating())), "x", digits=4)


@query
def dft_round_trip(spark, d):
    z = matrix(spark, d).select("r", "c", F.col("x").alias("re"), F.lit(0.0).alias("im"))
    return _r(spectral.transformed(spectral.transformed(z, ["r"], "c"), ["r"], "c", inverse=True), "re", "im")


#: Rows of the matrix that make a series.
SERIES = 25


@query
def long_dft(spark, d):
    """Transforms of series over many rows; what the last one lacks is 0."""
    m = matrix(spark, d).select((F.col("r") / SERIES).cast("long").alias("series"), (F.col("r") % SERIES * 64 + F.col("c")).alias("i"), "x")
    full = m.select("series").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SERIES * 64 - 1).cast("long")))).join(m, ["series", "i"], "left")
    return _r(spectral.long_transformed(full.select("series", "i", F.coalesce("x", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im")), ["series"], "i", SERIES, 64), "re", "im", digits=2)


@query
def long_round_trip(spark, d):
    """All of the matrix as one series, there and back."""
    m = matrix(spark, d)
    n = m.agg(F.max("r")).first()[0] + 1
    there = spectral.long_transformed(m.select((F.col("r") * 64 + F.col("c")).alias("i"), F.col("x").alias("re"), F.lit(0.0).alias("im")), [], "i", n, 64)
    return _r(spectral.long_transformed(there, [], "i", 64, n, inverse=True), "re", "im", digits=5)


def _samples(spark, d):
    """Embeddings as complex samples of two channels and polarisations, cut to chunks: (chunk, chan, pol, isamp, re, im)."""
    s = _spectrum(spark, d).withColumn("s", F.col("fft") * 32 + F.col("bin"))
    return s.select((F.col("s") / CHUNK).cast("long").alias("chunk"), "chan", "pol", (F.col("s") % CHUNK).alias("isamp"), "re", "im")


@query
def coherent_images(spark, d):
    return _r(coherent.images(_samples(spark, d), SEARCH, ["chunk"]), "x", digits=4)


@query
def coherent_search(spark, d):
    """The whole search: frames, coherent filters over a grid, transform, detection and clustering of every chunk."""
    cand = _r(coherent.candidates(_samples(spark, d), SEARCH, ["chunk"]), "msnr")
    return coherent.found_in(cand, SEARCH, ["chunk"])


def _flagship(spark, d):
    return cluster.ranked(cluster.delegates(cluster.clusters(_cand(spark, d), GAPS)))


@query
def flagship_search(spark, d):
    return _flagship(spark, d)


@query
def cand_log_lines(spark, d):
    return _flagship(spark, d).select("n", files.delegate_line(0.0, 0.001).alias("line"))


@query
def cand_csv_lines(spark, d):
    return _cand(spark, d).select(files.csv_line().alias("line"))


@query
def candfile_parse(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat_ws(" ", F.lit(""), F.floor("l_extendedprice").cast("long"), "l_orderkey", F.lit("1.5"), "l_linenumber", F.when(F.col("l_linenumber") == 7, F.lit("bad")).otherwise(F.col("l_partkey").cast("string")), F.lit("0.0"), F.lit("1")).alias("value"))
    return files.candidate_lines(lines)


def _reports(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") % 7).alias("block"), F.col("o_custkey").alias("chunk"), F.lit(256).alias("rows"), F.lit(4096).alias("cols"), (F.col("o_orderkey") % 256).alias("suc_row"), (F.col("o_custkey") % 4096).alias("suc_col"), (F.floor(F.col("o_totalprice")) / 16).alias("snr"), F.lit(30.5).alias("coh_disp"), (F.col("o_orderkey") % 9).alias("wind_width"))


@query
def report_lines(spark, d):
    return _reports(spark, d).select(files.report_line().alias("line"))


@query
def report_parse(spark, d):
    return files.parse_report(_reports(spark, d).select(files.report_line().alias("value"))).select("block", "chunk", "suc_row", "suc_col", "wind_width")


@query
def header_normalise(spark, d):
    s = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bw"))
    return s.select("k", *raw.normalised_width(F.col("bw")))
