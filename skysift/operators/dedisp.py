"""Incoherent dedispersion and the fast dispersion transform.

The transform works on tiles of time: each tile also gets the samples before it
that its results reach back to, as many as the plan's delays add up to.  A tile
of one block, chunk or coherent trial (``keys``) is one group, dense in memory,
and all of its iterations run there; so a transform is one shuffle, whatever the
number of iterations, and a long recording is many tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.plans.grids import K_DELAY, Node, half_away

#: Cells of a tile, at most (unless the delays alone take more).
CELLS = 4_000_000


def shifts(channels: int, dm: float, f_min: float, chan_bw: float, t_sample: float, samples: int) -> list[tuple[int, int]]:
    """(chan, shift) that aligns each channel with the lowest."""
    out = []
    for i in range(channels):
        f = (channels - 1 - i) * chan_bw + f_min
        out.append((i, half_away(K_DELAY * dm * (1 / (f_min * f_min) - 1 / (f * f)) / t_sample) % samples))
    return out


def dedisperse(w: DataFrame, table: list[tuple], samples: int, keys: list[str] | None = None) -> DataFrame:
    """Every channel rolled by its shift; table: (keys, chan, shift), where keys may be any of w's."""
    keys = keys or []
    kinds = ", ".join(f"{k} {t}" for k, t in w.select(*keys, "chan").dtypes)
    plan = w.sparkSession.createDataFrame(table, f"{kinds}, shift long")  # as many rows as channels and trials
    others = [c for c in w.columns if c not in (*keys, "chan", "t", "x")]
    return w.join(F.broadcast(plan), [*keys, "chan"]).select(*others, *keys, "chan", F.pmod(F.col("t") + F.col("shift"), F.lit(samples)).alias("t"), "x")


State = dict[tuple[int, int], np.ndarray]


def trailing_means(image: np.ndarray, delays: dict[int, list[int]]) -> State:
    """Means of the last d + 1 samples for each delay of a row of the image; 0 until there are so many."""
    total = np.concatenate([np.zeros((len(image), 1)), image.cumsum(axis=1)], axis=1)
    out = {}
    for row, grid in delays.items():
        for k, d in enumerate(grid):
            v = np.zeros(image.shape[1])
            v[d:] = (total[row, d + 1 :] - total[row, : max(0, total.shape[1] - d - 1)]) / (d + 1)
            out[row, k] = v
    return out


def iterated(state: State, nodes: list[Node]) -> State:
    """One iteration: each node's tail plus its head, later by the offset."""
    out = {}
    for n in nodes:
        v = state[n.tail_sub, n.tail_k].copy()
        if n.head_sub is not None and n.offset < len(v):
            v[n.offset :] += state[n.head_sub, n.head_k][: len(v) - n.offset]
        out[n.sub, n.k] = v
    return out


def reach(delays: dict[int, list[int]], plan: list[list[Node]]) -> int:
    """Samples before it that a result can depend on."""
    return max(d for grid in delays.values() for d in grid) + sum(max(n.offset for n in nodes) for nodes in plan)


def final_rows(image: np.ndarray, delays: dict[int, list[int]], plan: list[list[Node]], cells: int = CELLS) -> np.ndarray:
    """(row, sample) after all iterations of a plan that ends in one band, tile by tile of time."""
    halo, n = reach(delays, plan), image.shape[1]
    tile = max(halo, cells // len(image), 1)
    out = []
    for at in range(0, n, tile):
        first = max(0, at - halo)
        state = trailing_means(image[:, first : at + tile], delays)
        for nodes in plan:
            state = iterated(state, nodes)
        out.append(np.array([state[k][at - first :] for k in sorted(state)]))
    return np.concatenate(out, axis=1)


def transform(w: DataFrame, delays: dict[int, list[int]], plan: list[list[Node]], keys: list[str] | None = None, value: str = "x", cells: int = CELLS) -> DataFrame:
    """(keys, sub, k, t, x): the state after all iterations of the plan; without any, the trailing means.

    w: (keys, chan, t, value), t from 0 on.  Samples that are not there count as 0;
    an empty table gives no row.
    """
    keys = keys or []
    halo, channels = reach(delays, plan), len(delays)
    tile = max(halo, cells // channels, 1)
    kinds = dict(w.dtypes)
    own = F.floor(F.col("t") / tile).cast("long")
    each = F.when(F.col("t") % tile >= tile - halo, F.array(own, own + 1)).otherwise(F.array(own))
    rows = w.select(*keys, F.col("chan").cast("long").alias("chan"), F.col("t").cast("long").alias("t"), F.col(value).cast("double").alias("x"), F.explode(each).alias("tile"))

    def run(group: pa.Table) -> pa.Table:
        at = group.column("tile")[0].as_py() * tile
        t = group.column("t").to_numpy()
        names = [*keys, "sub", "k", "t", "x"]
        if not (t >= at).any():
            return pa.table([group.column(k).slice(0, 0) for k in keys] + [pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
        first = max(0, at - halo)
        image = np.zeros((channels, int(t.max()) - first + 1))
        image[group.column("chan").to_numpy(), t - first] = group.column("x").to_numpy()
        state = trailing_means(image, delays)
        for nodes in plan:
            state = iterated(state, nodes)
        n = image.shape[1] - (at - first)
        places = [np.repeat(np.array([p[i] for p in state], np.int64), n) for i in (0, 1)]
        out = [pa.array(p) for p in places] + [pa.array(np.tile(np.arange(at, at + n), len(state))), pa.array(np.concatenate([v[at - first :] for v in state.values()]))]
        return pa.table([pa.repeat(group.column(k)[0], n * len(state)) for k in keys] + out, names=names)

    ddl = "".join(f"{k} {kinds[k]}, " for k in keys) + "sub long, k long, t long, x double"
    return rows.groupBy(*keys, "tile").applyInArrow(run, ddl)


def image_of(state: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, k, t, x) of a finished transform, whose one band is left out."""
    return state.select(*(keys or []), "k", "t", "x")
