"""Command line: searches a recording and writes each chunk's delegates as log lines, and a log of the run.

``python -m skysift -n recording.raw -N out -P 1.6e-4 -b 4 -k 50 -d 4``; four
files of planes by the container beside them (``-n ..._S0_....h5``), or by the first
one and ``--sidecar header.json``.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from skysift.functions.lineage import cut
from skysift.operators import coherent
from skysift.plans import grids
from skysift.sources import container, files, raw


def options(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("skysift")
    p.add_argument("-n", dest="recording", required=True, help="raw recording, a folder of them, the container of four planes, or the first of these")
    p.add_argument("-N", dest="out", required=True, help="folder for the logs")
    p.add_argument("-P", dest="pulse", type=float, default=1.6384e-4, help="length of a pulse in seconds")
    p.add_argument("-b", dest="threshold", type=float, default=4.0, help="least signal to noise")
    p.add_argument("-k", dest="d_max", type=float, default=50.0, help="largest dispersion measure")
    p.add_argument("-d", dest="window", type=int, default=4, help="longest window; all up to it are tried")
    p.add_argument("--d-min", type=float, default=30.0)
    p.add_argument("--nbin", type=int, default=262144)
    p.add_argument("--nfft", type=int, default=4)
    p.add_argument("--sidecar", help="header of a four-file recording")
    p.add_argument("--project", default="skysift", help="name in the log of the run")
    p.add_argument("--parts", type=int, default=1, help="tasks that share the trials of a chunk")
    p.add_argument("--once", action="store_true", help="what overlapping chunks both see is reported once, by block")
    return p.parse_args(args)


def plan_of(o: argparse.Namespace, header: dict) -> coherent.SearchPlan:
    """What the options and a recording's header make together, with trials for all measures asked for; frames too short for the overlap are an error."""
    half = header["obs_bw"] / 2
    f_min, f_max = header["obs_freq"] - half, header["obs_freq"] + half
    subs = 1 << max(0, grids.sub_channels(o.pulse, header["tbin"]) - 1).bit_length()
    overlap = max(subs, grids.optimal_overlap(o.d_max, f_min, header["chan_bw"], subs, header["tbin"]))
    n = max(1, grids.coherent_count(o.d_max, f_min, f_max, header["tbin"], o.pulse))
    dms = tuple(grids.covering_grid(o.d_min, o.d_max, n))
    return coherent.SearchPlan(f_min, f_max, header["tbin"], header["nchan"], subs, o.nbin, o.nfft, overlap, dms, o.threshold, tuple(range(1, max(1, o.window) + 1)))


def blocks_of(spark: SparkSession, o: argparse.Namespace):
    if o.recording.endswith(".h5"):
        return files.plane_block(spark, container.planes_of(o.recording), container.read_header(o.recording))
    if not o.sidecar:
        return raw.index(spark, o.recording)
    with raw.open_file(o.sidecar) as f:
        return files.plane_block(spark, o.recording, files.read_sidecar_header(bytes(f.read()).decode()))


def run(spark: SparkSession, o: argparse.Namespace) -> coherent.SearchPlan:
    began = time.time()
    blocks = blocks_of(spark, o)
    header = blocks.first()
    if header is None:
        raise ValueError(f"{o.recording} has no block")
    plan = plan_of(o, header.asDict())
    found = cut(coherent.search_recordings(blocks, plan, o.parts, o.once))
    keys = ["block"] if o.once else ["block", "chunk"]
    if blocks.select("file").distinct().limit(2).count() > 1:
        keys = ["file", *keys]
    spread = found.repartition(4 * spark.sparkContext.defaultParallelism, *keys).sortWithinPartitions(*keys, "n")  # a folder costs more than its lines
    lines = spread.select(*keys, files.delegate_line(0.0, plan.t_sample * plan.subs).alias("line"))
    lines.write.mode("overwrite").partitionBy(*keys).text(f"{o.out}/delegates")
    at = found.select("file", *(["block"] if o.once else ["block", "chunk"])).distinct().orderBy("file", "block", *([] if o.once else ["chunk"]))
    numbers = [r[-1] for r in at.collect()]  # a number for each chunk with detections
    log = files.run_log(o.recording, o.project, plan.length, numbers, int(time.time() - began))
    files.write_lines(spark.createDataFrame([(x,) for x in log], "line string").coalesce(1), f"{o.out}/run")
    return plan


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), options())
