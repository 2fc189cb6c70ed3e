"""Clustering of candidates by gaps along three axes, and one delegate per cluster."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions.lineage import cut
from skysift.operators.tiles import numbered


def gap_groups(cand: DataFrame, group: list[str], axis: str, gap: int, name: str, parts: int | None = None) -> DataFrame:
    """Adds the number (from 0) of each row's subgroup, which begins where the axis rises by more than gap.

    A group may hold all candidates: rows are dealt by ranges of group and axis
    and sorted, in one shuffle.  A task then tells where its range begins and
    ends; from these few rows the driver knows what each range goes on from, and
    a second pass over the sorted rows numbers them.  cand is read twice.
    """
    by = [*group, axis]
    n = parts or int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(cand.repartitionByRange(n, *by).sortWithinPartitions(*by))
    kinds = {f.name: f.dataType.simpleString() for f in cand.schema.fields}

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first, whole, schema = None, None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema, fresh = batch.schema, state is None
            count, restarts = _numbered(batch, group, axis, gap, state)
            first = batch.slice(0, 1) if fresh else first
            whole &= not restarts[1 if fresh else 0 :].any()
            state = (batch.slice(batch.num_rows - 1), int(count[-1]))
        if state:
            for row, at in ((first, 0), (state[0], 1)):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([at]), pa.array([state[1]]), pa.array([whole]), *row.columns], names=["part", "at", "count", "whole", *schema.names])

    summary = ordered.select(*by).mapInArrow(ends, "part long, at long, count long, whole boolean, " + ", ".join(f"`{c}` {kinds[c]}" for c in by))
    carry, last = {}, None  # the group, the axis and the number that a range goes on from
    for first, end in itertools.batched(sorted(summary.collect(), key=lambda r: (r.part, r["at"])), 2):  # two rows for each task
        own = tuple(first[c] for c in group)
        start = 0
        if last and last[0] == own:
            carry[first.part] = last
            start = last[2] + (first[axis] - last[1] > gap)
        last = (tuple(end[c] for c in group), end[axis], end["count"] + (start if end.whole else 0))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = carry.get(TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            count, _ = _numbered(batch, group, axis, gap, state)
            state = (batch.slice(batch.num_rows - 1), int(count[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count)], names=[*batch.schema.names, name])

    return ordered.mapInArrow(number, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", `{name}` long")


def _numbered(batch: pa.RecordBatch, group: list[str], axis: str, gap: int, state: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a batch's subgroups, and where another group begins; state: what it goes on from, as a row and its number, or as group, axis and number."""
    n = batch.num_rows
    at = batch.column(axis).to_numpy(zero_copy_only=False)
    rises, restarts = np.empty(n, bool), np.zeros(n, bool)
    rises[1:] = np.diff(at) > gap
    for c in group:
        v = batch.column(c).to_numpy(zero_copy_only=False)
        restarts[1:] |= v[1:] != v[:-1]
    start = 0
    if state is None:
        restarts[0] = True
    else:
        before = state if len(state) == 3 else (tuple(state[0].column(c)[0].as_py() for c in group), state[0].column(axis)[0].as_py(), state[1])
        restarts[0] = before[0] != tuple(batch.column(c)[0].as_py() for c in group)
        rises[0] = at[0] - before[1] > gap
        start = before[2]
    total = np.cumsum(np.where(restarts, False, rises))
    begun = np.maximum.accumulate(np.where(restarts, np.arange(n), -1))
    return np.where(begun < 0, start + total, total - total[begun]), restarts


def keyed_clusters(cand: DataFrame, gaps: tuple[int, int, int], keys: list[str]) -> DataFrame:
    """Candidates with g1, g2, g3, as clusters() has them, each of the keys sorted in one task; one shuffle for all three."""
    out, within = cand, list(keys)
    for axis, gap, name in zip(("mt", "mdt", "mwidth"), gaps, ("g1", "g2", "g3"), strict=True):
        order = Window.partitionBy(*within).orderBy(axis)
        rises = F.coalesce(F.col(axis) - F.lag(axis).over(order) > gap, F.lit(False)).cast("long")
        counted = F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("_new", rises).withColumn(name, counted).drop("_new")
        within.append(name)
    return out.select(*keys, "mt", "mdt", "mwidth", "msnr", "g1", "g2", "g3")


def numbered_delegates(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """delegates() numbered from 1 by time in each of the keys, in the task that has them."""
    at = Window.partitionBy(*keys).orderBy("mt", "mdt", "mwidth")
    return delegates(grouped, keys).withColumn("n", F.row_number().over(at).cast("long"))


#: Candidates that one task may cluster.
FEW = 200_000


def clusters(cand: DataFrame, gaps: tuple[int, int, int] = (2, 1, 2), keys: list[str] | None = None, few: int = FEW) -> DataFrame:
    """Candidates with g1, g2, g3: split by time, then row, then width, within each of the keys (blocks, chunks, trials).

    They are computed once and counted.  A few of them are clustered in one task;
    of more, each axis is one shuffle to sorted ranges, kept because they are
    read twice.
    """
    keys = keys or []
    cand = cut(cand)
    if cand.limit(few + 1).count() <= few:
        return keyed_clusters(cand.withColumn("_all", F.lit(0)), gaps, ["_all", *keys]).drop("_all")
    one = gap_groups(cand, keys, "mt", gaps[0], "g1")
    two = gap_groups(one, [*keys, "g1"], "mdt", gaps[1], "g2")
    return gap_groups(two, [*keys, "g1", "g2"], "mwidth", gaps[2], "g3").select(*keys, "mt", "mdt", "mwidth", "msnr", "g1", "g2", "g3")


def subgroup_counts(grouped: DataFrame, group: str, sub: str) -> DataFrame:
    return grouped.groupBy(group).agg(F.countDistinct(sub).alias("n"))


def delegates(grouped: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The strongest candidate of each cluster (ties: earliest, then lowest row and width) and the cluster's size."""
    keys = keys or []
    key = F.struct(F.col("msnr"), (-F.col("mt")).alias("a"), (-F.col("mdt")).alias("b"), (-F.col("mwidth")).alias("c"))
    best = grouped.groupBy(*keys, "g1", "g2", "g3").agg(F.max(key).alias("m"), F.count("*").alias("num"))
    return best.select(*keys, (-F.col("m.a")).alias("mt"), (-F.col("m.b")).alias("mdt"), (-F.col("m.c")).alias("mwidth"), F.col("m.msnr").alias("msnr"), "num")


def ranked(found: DataFrame, keys: list[str] | None = None, few: int = FEW) -> DataFrame:
    """Delegates numbered from 1 by time, in each of the keys; computed once, a few of them numbered in one task, more in tiles."""
    keys, found = keys or [], cut(found)
    if found.limit(few + 1).count() <= few:
        at = Window.partitionBy(F.lit(0), *keys).orderBy("mt", "mdt", "mwidth")
        return found.withColumn("n", F.row_number().over(at).cast("long"))
    return numbered(found, keys, "mt", ["mdt", "mwidth"], "n").withColumn("n", F.col("n") + 1)


def segment_rank(cand: DataFrame, segment: list[str], axis: str, ties: list[str]) -> DataFrame:
    """Each row's place (from 0) within its segment; a segment may hold all rows."""
    return numbered(cand, segment, axis, ties, "rank")
