"""Coherent dedispersion over a grid of trials, and the whole search of blocks and chunks.

A chunk is searched in one go, as arrays inside a task: frames and spectrum of a
channel, each trial's filter, power, shifts, excision, the dispersion transform
and the boxcars.  What becomes rows is candidates alone; samples, spectra and
images do not.  Chunks of recordings are read by byte ranges in the task that
searches them, so nothing of a recording is shuffled; chunks of tables are one
shuffle.  Clustering is one more shuffle, of candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.operators import cluster, dedisp
from skysift.operators.stats import EXCISE
from skysift.plans.grids import K_CHIRP, truncating_plan
from skysift.sources import raw

#: Bytes of spectra, and of filters, that a task keeps from trial to trial; beyond them they are made again.
KEPT_BYTES = 256 << 20
#: Digits of a signal to noise that count, as in the logs; which of equal ones leads a cluster must not hang on the order of additions.
DIGITS = 6


@dataclass(frozen=True)
class SearchPlan:
    """What a search needs to know; frequencies in MHz, times in seconds."""

    f_min: float
    f_max: float
    t_sample: float
    channels: int
    subs: int
    nbin: int
    nfft: int
    overlap: int
    dms: tuple[float, ...]
    threshold: float
    widths: tuple[int, ...] = (1, 2, 3, 4)
    gaps: tuple[int, int, int] = (2, 1, 2)
    rows: int = field(init=False)
    samples: int = field(init=False)
    length: int = field(init=False)

    def __post_init__(self):
        if self.nbin % self.subs or self.overlap % self.subs:
            raise ValueError("sub-channels must divide the frame and the overlap")
        if self.nbin <= 2 * self.overlap:
            raise ValueError(f"a frame of {self.nbin} samples must be longer than two overlaps of {self.overlap}")
        object.__setattr__(self, "rows", self.channels * self.subs)
        object.__setattr__(self, "length", (self.nbin - 2 * self.overlap) * self.nfft)
        object.__setattr__(self, "samples", self.length // self.subs)


def chirp_of(plan: SearchPlan, chan: int, dm: float) -> np.ndarray:
    """The filter of one channel by sub-channel and bin; phases are reduced to a turn before the trigonometry."""
    bw, mbin = (plan.f_max - plan.f_min) / plan.channels, plan.nbin // plan.subs
    band = bw / plan.subs
    centre = plan.f_min + bw * (0.5 + chan) + band * (np.arange(plan.subs) - plan.subs / 2 + 0.5)
    f = -band / 2 + (np.arange(mbin) + 0.5) * band / mbin
    phase = dm * (f[None, :] / centre[:, None]) ** 2 / (centre[:, None] + f[None, :]) * K_CHIRP
    return np.exp(-2j * np.pi * (phase - np.floor(phase))) / np.sqrt(1 + (f / (0.47 * band)) ** 80)


@dataclass
class _Kept:
    """What a worker has made for a plan and may use again."""

    delays: dict[int, list[int]]
    nodes: list
    chirps: dict[tuple[int, float], np.ndarray] = field(default_factory=dict)

    def chirp(self, plan: SearchPlan, chan: int, dm: float) -> np.ndarray:
        if (h := self.chirps.get((chan, dm))) is None:
            h = chirp_of(plan, chan, dm)
            if (len(self.chirps) + 1) * h.nbytes <= KEPT_BYTES:
                self.chirps[chan, dm] = h
        return h


@lru_cache(maxsize=2)
def _kept(plan: SearchPlan) -> _Kept:
    first, nodes = truncating_plan(plan.rows, plan.f_min, plan.f_max, plan.subs)
    return _Kept({c: list(range(first + 1)) for c in range(plan.rows)}, nodes)


def spectrum_of(z: np.ndarray, plan: SearchPlan) -> np.ndarray:
    """(polarisation, frame, sub-channel, bin) of a channel's samples (polarisation, sample); samples it lacks count as 0."""
    padded = np.zeros((len(z), plan.length + 2 * plan.overlap), complex)
    padded[:, plan.overlap : plan.overlap + z.shape[1]] = z
    frames = np.lib.stride_tricks.sliding_window_view(padded, plan.nbin, axis=1)[:, :: plan.nbin - 2 * plan.overlap]
    return np.fft.fftshift(np.fft.fft(frames, axis=2), axes=2).reshape(len(z), frames.shape[1], plan.subs, -1)


def power_of(spectrum: Callable[[int], np.ndarray], plan: SearchPlan, dm: float) -> np.ndarray:
    """(row, sample): power of every sub-channel after a trial's filter, overlaps cut off, from the highest frequency down."""
    mbin, pad = plan.nbin // plan.subs, plan.overlap // plan.subs
    out = np.empty((plan.rows, plan.samples))
    for chan in range(plan.channels):
        y = np.fft.ifft(spectrum(chan) * _kept(plan).chirp(plan, chan, dm), axis=3) * (mbin / plan.nbin)
        p = (y.real**2 + y.imag**2).sum(axis=0)[:, ::-1, pad : mbin - pad]
        first = (plan.channels - 1 - chan) * plan.subs
        out[first : first + plan.subs] = p.transpose(1, 0, 2).reshape(plan.subs, -1)
    return out


def excised(power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deviations from the mean of all samples in their standard deviation, disturbed rows 0; and 0 or 1 for each row."""
    mean = power.mean(axis=1)
    var = (power * power).mean(axis=1) - mean * mean
    spread = np.sqrt((var + mean * mean).mean() - mean.mean() ** 2)
    bad = np.abs(var - var.mean()) > EXCISE * var.std()
    with np.errstate(divide="ignore", invalid="ignore"):  # samples that are all the same give no number, and no candidate
        z = (power - mean.mean()) / spread
    z[bad] = 0.0
    return z, np.where(bad, 0.0, 1.0)


def trial_image(spectrum: Callable[[int], np.ndarray], plan: SearchPlan, dm: float, circular: bool = True) -> np.ndarray:
    """(row, sample): the transform of a chunk's data over the root of that of its mask, for one trial.

    Rows are shifted in a circle; else what a shift brings round counts as 0, so
    that a pulse at the end is not seen again at the start.
    """
    kept = _kept(plan)
    power = power_of(spectrum, plan, dm)
    width = (plan.f_max - plan.f_min) / plan.rows
    shifts = dedisp.shifts(plan.rows, dm, plan.f_min, width, plan.t_sample * plan.subs, plan.samples)
    for row, shift in shifts:
        power[row] = np.roll(power[row], shift)
    z, mask = excised(power)
    if not circular:
        for row, shift in shifts:
            z[row, :shift] = 0.0
    # A row's mask is the same at all times, so its transform stays as it is once all delays are reached.
    n = min(plan.samples, dedisp.reach(kept.delays, kept.nodes) + 1)
    norm = dedisp.final_rows(np.repeat(mask[:, None], n, axis=1), kept.delays, kept.nodes)
    image = dedisp.final_rows(z, kept.delays, kept.nodes)
    image[:, :n] /= np.sqrt(norm + 1e-8)
    image[:, n:] /= np.sqrt(norm[:, -1:] + 1e-8)
    return image


def boxes_over(image: np.ndarray, widths: tuple[int, ...], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sample, row, width, signal to noise) of all windows over the threshold that fit."""
    found = []
    total, done = np.zeros_like(image), 0
    for n in sorted(widths):
        fit = image.shape[1] - n + 1
        if fit <= 0:
            break
        total = total[:, :fit]
        for i in range(done, n):
            total = total + image[:, i : i + fit]
        done = n
        snr = total / np.sqrt(n)
        row, at = np.nonzero(snr > threshold)
        found.append((at, row, np.full(len(at), n), snr[row, at]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3 + (np.empty(0),)


Channel = Callable[[int], np.ndarray]
#: What is made of an image: (trial, image) to columns.
Emit = Callable[[int, np.ndarray], list[pa.Array]]


def over_trials(channel: Channel, plan: SearchPlan, trials: list[int], emit: Emit, circular: bool = True) -> Iterator[list[pa.Array]]:
    """emit() of each trial's image; spectra are kept between trials if they fit."""
    spectra: dict[int, np.ndarray] = {}

    def spectrum(chan: int) -> np.ndarray:
        if (s := spectra.get(chan)) is None:
            s = spectrum_of(channel(chan), plan)
            if len(trials) > 1 and plan.channels * s.nbytes <= KEPT_BYTES:
                spectra[chan] = s
        return s

    for i in trials:
        yield emit(i, trial_image(spectrum, plan, plan.dms[i], circular))


def _candidates(plan: SearchPlan, own: tuple[int, int] | None = None, first: int = 0) -> tuple[Emit, str]:
    """Emits candidates over the images of all trials, one below the other; own: samples of the chunk whose candidates are its own, in times from ``first`` on."""

    def emit(trial: int, image: np.ndarray) -> list[pa.Array]:
        at, row, width, snr = boxes_over(image, plan.widths, plan.threshold)
        if own:
            mine = (at * plan.subs >= own[0]) & (at * plan.subs < own[1])
            at, row, width, snr = at[mine] + first // plan.subs, row[mine], width[mine], snr[mine]
        return [pa.array(x) for x in (at, row + trial * plan.subs, width, snr)]

    return emit, "mt long, mdt long, mwidth long, msnr double"


def _images(plan: SearchPlan) -> tuple[Emit, str]:
    def emit(trial: int, image: np.ndarray) -> list[pa.Array]:
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(image) + 1, dtype=np.int32) * image.shape[1]), pa.array(image.ravel()))
        return [pa.array(np.full(len(image), trial)), pa.array(np.arange(len(image))), rows]

    return emit, "trial long, k long, x array<double>"


def _of_samples(samples: DataFrame, plan: SearchPlan, keys: list[str], made: tuple[Emit, str]) -> DataFrame:
    """Chunks of a table (keys, chan, pol, isamp, re, im), each gathered in one task; isamp counts from the chunk's start."""
    emit, ddl = made
    names = [*keys, *(c.split()[0] for c in ddl.split(", "))]
    kinds = dict(samples.dtypes)

    def run(group: pa.Table) -> pa.Table:
        chan, pol, at = (group.column(c).to_numpy() for c in ("chan", "pol", "isamp"))
        z = np.zeros((plan.channels, int(pol.max()) + 1, plan.length), complex)
        z[chan, pol, at] = group.column("re").to_numpy() + 1j * group.column("im").to_numpy()
        out = []
        for columns in over_trials(z.__getitem__, plan, list(range(len(plan.dms))), emit):
            out.append(pa.table([pa.repeat(group.column(k)[0], len(columns[0])) for k in keys] + columns, names=names))
        return pa.concat_tables(out)

    rows = samples.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("chan", "pol", "isamp")], *[F.col(c).cast("double").alias(c) for c in ("re", "im")])
    return rows.groupBy(*keys).applyInArrow(run, "".join(f"{k} {kinds[k]}, " for k in keys) + ddl)


def images(samples: DataFrame, plan: SearchPlan, keys: list[str]) -> DataFrame:
    """(keys, trial, k, t, x): the transform of each chunk and trial over the root of that of its mask."""
    rows = _of_samples(samples, plan, keys, _images(plan))
    return rows.select(*keys, "trial", "k", F.posexplode("x").alias("t", "x")).withColumn("t", F.col("t").cast("long"))


def candidates(samples: DataFrame, plan: SearchPlan, keys: list[str]) -> DataFrame:
    """(keys, mt, mdt, mwidth, msnr) of a table's chunks; mdt counts the rows of all trials' images, mwidth is the width."""
    return _of_samples(samples, plan, keys, _candidates(plan))


def chunk_candidates(chunks: DataFrame, plan: SearchPlan, parts: int = 1, once: bool = False) -> DataFrame:
    """(file, block, chunk, mt, mdt, mwidth, msnr) of raw.CHUNKS, each read by the task that searches it.

    A task holds one chunk as it lies in the file, spectra and filters of at most
    ``KEPT_BYTES`` each, and the power of one trial, which takes 8 bytes for each
    of the chunk's samples and channels, a few times over.

    parts: rows of each chunk, numbered in a column part, that share its trials,
    for few chunks and many trials; each reads the chunk.  once: of overlapping chunks only the one that
    owns a time reports it, shifts are not circular, and mt counts from the start
    of the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                voltages = raw.Voltages(row)
                emit = _candidates(plan, (row["own_from"], row["own_to"]) if once else None, row["first"])[0]
                for columns in over_trials(voltages.channel, plan, list(range(row["part"], len(plan.dms), parts)), emit, not once):
                    keys = [pa.repeat(pa.scalar(row[k]), len(columns[0])) for k in ("file", "block", "chunk")]
                    yield pa.RecordBatch.from_arrays(keys + columns, names=["file", "block", "chunk", "mt", "mdt", "mwidth", "msnr"])

    return chunks.withColumn("part", F.lit(0) if "part" not in chunks.columns else F.col("part")).mapInArrow(run, f"file string, block long, chunk long, {_candidates(plan)[1]}")


def settled(cand: DataFrame) -> DataFrame:
    """Candidates with the digits of msnr that count."""
    return cand.withColumn("msnr", F.round("msnr", DIGITS))


def found_in(cand: DataFrame, plan: SearchPlan, keys: list[str]) -> DataFrame:
    """Delegates of the clusters of each of the keys, numbered by time; keys without candidates give no row.

    A key's candidates meet in one task, sorted: at most one for each cell of its images and width.
    """
    return cluster.numbered_delegates(cluster.keyed_clusters(cand, plan.gaps, keys), keys)


def found_across(cand: DataFrame, plan: SearchPlan, keys: list[str]) -> DataFrame:
    """The same for keys of any length, such as whole blocks: many candidates of one are spread over tasks."""
    return cluster.ranked(cluster.delegates(cluster.clusters(cand, plan.gaps, keys), keys), keys)


def search(samples: DataFrame, plan: SearchPlan, keys: list[str]) -> DataFrame:
    """Delegates of every chunk of a table."""
    return found_in(candidates(samples, plan, keys), plan, keys)


def search_recordings(blocks: DataFrame, plan: SearchPlan, parts: int = 1, once: bool = False) -> DataFrame:
    """Delegates of every chunk of raw.index()'s or files.plane_block()'s blocks; with once, of every block, as if it had no chunks."""
    chunks = raw.chunk_table(blocks, plan.length, plan.overlap)
    chunks = raw.dealt(chunks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    cand = settled(chunk_candidates(chunks, plan, parts, once))
    return found_across(cand.drop("chunk"), plan, ["file", "block"]) if once else found_in(cand, plan, ["file", "block", "chunk"])
