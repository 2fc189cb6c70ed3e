"""Best-fit packing of token sequences by minimum bin slack.

How documents pack depends on their lengths alone, and there are at most
``capacity`` lengths, so the driver plans with counts by length, however many
documents there are.  Each bin is seeded with the longest length left; a bitset
subset-sum over the other lengths left, as often as they are left, finds the
fullest feasible combination; it is taken as often as the counts allow.
Documents then find their place by their rank among those of the same length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.common import ROWS, small, written
from skysift.llm.tokens import encoder


def fullest(room: int, counts: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """The combination of lengths, each at most as often as counted, with the largest sum up to room."""
    bits, mask, steps = 1, (1 << room + 1) - 1, []
    for n in lengths:
        left = min(counts[n], room // n) if n <= room else 0
        take = 1
        while left > 0:
            take = min(take, left)
            steps.append((n, take, bits))
            bits |= bits << n * take & mask
            left -= take
            take *= 2
        if bits >> room & 1:
            break
    total, used = bits.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            used[n] = used.get(n, 0) + take
            total -= n * take
    return used


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Segments (length, first rank, copies in a bin, first bin, offset in the bin) and the number of bins."""
    counts = {n: c for n, c in counts.items() if c}
    lengths, ranks, bins, out = sorted(counts, reverse=True), dict.fromkeys(counts, 0), 0, []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        used = fullest(capacity - seed, counts, lengths)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times, offset = min(counts[n] // k for n, k in used.items()), 0
        for n in sorted(used, reverse=True):
            out.append((n, ranks[n], used[n], bins, offset))
            offset += n * used[n]
            ranks[n] += used[n] * times
            counts[n] -= used[n] * times
        bins += times
        lengths = [n for n in lengths if counts[n]]
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5), bins


def encode_pieces(docs: DataFrame, vocab: str, end_id: int, capacity: int) -> DataFrame:
    """Documents as token ids with the end id, those over the capacity cut so that the first piece is the short one.

    nth: a piece's number among those of its length in its task, part.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, seen = TaskContext.get().partitionId(), encoder(vocab), [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows, out = batch.slice(at, ROWS), []
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), enc.encode(rows.column("text").to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        out.append((doc_id, k, a, b - a, ids[4 * a : 4 * b], part, seen[b - a]))
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, part long, nth long")


def pack(docs: DataFrame, vocab: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Packs documents into as few sequences of at most ``capacity`` tokens as the method finds.

    Returns per piece: doc_id, piece, start, length, ids (little-endian unsigned
    32-bit), sequence_id, offset.  A null text is empty and gives the end id
    alone; a null doc_id stays null; repeated rows are packed each on their own;
    other columns don't matter; an empty table gives no row.
    """
    pieces = written(encode_pieces(docs, vocab, end_id, capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = written(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "lengths")
    # At most ``capacity`` rows come to the driver.
    by_length = {r.length: r.n for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments, _ = plan(by_length, capacity)
    span = max(by_length.values(), default=0) + 1
    keys = segments[:, 0] * span + segments[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        s = segments[np.searchsorted(keys, n * span + r, side="right") - 1]
        q, k = np.divmod(r - s[:, 1], s[:, 2])
        return pd.DataFrame({"sequence_id": s[:, 3] + q, "offset": s[:, 4] + k * n})

    return (
        pieces.join(small(first.drop("n")), ["part", "length"])
        .withColumn("place", place("length", F.col("first") + F.col("nth")))
        .select("doc_id", "piece", "start", "length", "ids", "place.sequence_id", "place.offset")
    )
