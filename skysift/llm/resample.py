"""Importance resampling towards a target's distribution of hashed n-grams.

Texts are turned to numbers: distinct words get numbers from a dictionary, an
n-gram is the tuple of its words' numbers, and only distinct tuples are hashed,
as the bytes of their words and spaces, and their hashes joined back to all
their places.  The dictionary lives in the worker and is bounded; a full one
starts afresh, which changes no result.  A task gives its counts of the buckets,
so what is shuffled and collected is one number for each bucket, whatever the
corpus.

Nulls and edges: a null or empty text has no features and weight 0; a null
doc_id is hashed as empty text and comes last among ties; repeated rows are
documents of their own, each with its own rank; an empty table gives no row, and
an empty target counts nothing; other columns stay as they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import checkpointed, free, written

#: Words of lower-cased UTF-8: digits, letters and all bytes of other code points.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
#: Words that a worker remembers, and their bytes.
WORDS, WORD_BYTES = 500_000, 32 << 20
#: Bytes of text turned to numbers at once.
AT_ONCE = 1 << 22
#: Rows of a range of the order, about.
RANGE = 1_000_000


class Dictionary(dict):
    """Distinct words' numbers; by number, each word's crc32 and the word with a space before it."""

    def __init__(self) -> None:
        super().__init__()
        self.crc: list[int] = []
        self.spaced: list[bytes] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.crc.append(zlib.crc32(word))
        self.spaced.append(b" " + word)
        self.bytes += len(word)
        return n

    def restart(self) -> None:
        self.clear()
        self.__init__()


def tuple_hashes(rows: np.ndarray, seen: Dictionary) -> np.ndarray:
    """crc32 of the bytes of each tuple, its words joined by spaces, word after word; rows: numbers of words."""
    crc = map(seen.crc.__getitem__, rows[:, 0].tolist())
    for j in range(1, rows.shape[1]):
        crc = map(zlib.crc32, map(seen.spaced.__getitem__, rows[:, j].tolist()), crc)
    return np.fromiter(crc, np.int64, len(rows))


def features(texts: list[str | None], seen: Dictionary, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every run of 1 to ``most`` words of the texts, with repeats, and each text's number of words."""
    if len(seen) > WORDS or seen.bytes > WORD_BYTES:
        seen.restart()
    cut = [_WORDS(t.encode().lower()) if t else [] for t in texts]
    sizes = np.array([len(c) for c in cut], np.int64)
    ids = np.fromiter(map(seen.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    at, of, code = [], [], ids
    for n in range(1, min(most, len(ids)) + 1):
        if n > 1:
            # Distinct shorter tuples get small numbers again, so that a longer one is a pair of numbers.
            head = code[: len(ids) - n + 1] if n == 2 else np.unique(code[: len(ids) - n + 1], return_inverse=True)[1]
            code = head * np.int64(len(seen)) + ids[n - 1 :]
        places = np.flatnonzero(owner[: len(ids) - n + 1] == owner[n - 1 :])
        if len(places):
            # Each distinct tuple is hashed once, and goes back to all its places.
            _, first, back = np.unique(code[places], return_index=True, return_inverse=True)
            hashes = tuple_hashes(ids[places[first][:, None] + np.arange(n)], seen)
            at.append((hashes % buckets)[back])
            of.append(owner[places])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64), sizes
    return np.concatenate(at), np.concatenate(of), sizes


@lru_cache(maxsize=1)
def dictionary() -> Dictionary:
    """The worker's own; kept from task to task."""
    return Dictionary()


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str | None]]]:
    """A batch's texts, a bounded number of bytes at once (or one text): (first row, texts)."""
    first, size, some = 0, 0, []
    for i, t in enumerate(batch.column(column)):
        some.append(t.as_py())
        size += len(some[-1] or "") + 64
        if size > AT_ONCE:
            yield first, some
            first, size, some = i + 1, 0, []
    if some:
        yield first, some


def bucket_counts(texts: DataFrame, text: str = "text", most: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket's features stand in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dictionary()
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in _pieces(batch, text):
                total += np.bincount(features(some, seen, most, buckets)[0], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r.b] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths: the log of its smoothed share of the target over that of the source."""
    t, s, n = int(target.sum()), int(source.sum()), len(target)
    return np.array([math.floor(1000 * math.log((float(a) + 1) * float(s + n) / ((float(b) + 1) * float(t + n)))) for a, b in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", most: int = 2) -> DataFrame:
    """docs with n_words, n_features and weight, the floored mean of the gains over a document's features (0 without any)."""
    words, number, weight = (free(docs, x) for x in ("n_words", "n_features", "weight"))
    table = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, g = dictionary(), table.value
        for batch in batches:
            for first, some in _pieces(batch, text):
                at, of, sizes = features(some, seen, most, len(g))
                total = np.zeros(len(some), np.int64)
                np.add.at(total, of, g[at])
                n = np.bincount(of, minlength=len(some))
                mean = np.where(n > 0, total // np.maximum(n, 1), 0)
                part = batch.slice(first, len(some))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes), pa.array(n), pa.array(mean)], names=[*part.schema.names, words, number, weight])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{words}` long, `{number}` long, `{weight}` long")


def noise(key: Column, seed: int) -> Column:
    """The key's fixed draw of standard Gumbel noise in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, eligible: Column, score: str, key: str, share: int, rank: str) -> DataFrame:
    """scored with the rank of the best ``share`` hundredths of the eligible rows: 1, 2, 3, ... by score, ties to smaller keys; else null.

    Rows are dealt by ranges of their order, so no task holds all of them, and a
    row's place is its place in its range after the ranges before it.
    """
    at, bad, part, first, size = (free(scored, x) for x in ("_at", "_bad", "_part", "_first", "_size"))
    order = [F.col(bad), F.col(score).desc(), F.col(key).asc_nulls_last()]
    rows = scored.withColumn(bad, ~F.coalesce(eligible, F.lit(False)))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE + 1)
    # The identifier of a row counts on within its partition, whose number is in the upper bits.
    rows = checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn(at, F.monotonically_increasing_id())
    rows = rows.withColumn(part, F.shiftright(at, 33))
    sizes = sorted((r[0], r[1], r[2]) for r in rows.groupBy(part).agg(F.count("*"), F.sum((~F.col(bad)).cast("long"))).collect())  # a row for each task
    start, total = [], 0
    for p, count, _ in sizes:
        start.append((p, total))
        total += count
    most = share * sum(s[2] for s in sizes) // 100
    starts = rows.sparkSession.createDataFrame(start, f"`{part}` long, `{first}` long")
    place = F.col(first) + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(starts), part).withColumn(rank, F.when(place <= most, place)).drop(at, bad, part, first)


def resampled(docs: DataFrame, target: DataFrame, share: int = 25, least: int = 20, seed: int = 7, most: int = 2, buckets: int = 10_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their text, with n_words, n_features, weight, score and rank; rank is null where a document is not drawn.

    ``share`` hundredths of the documents with at least ``least`` words are
    drawn without replacement: the highest sums of weight and Gumbel noise.
    """
    gain = gains(bucket_counts(target, text, most, buckets), bucket_counts(docs, text, most, buckets))
    words, weight, score, rank = (free(docs, x) for x in ("n_words", "weight", "score", "rank"))
    found = weighed(docs, gain, text, most).drop(text)
    found = written(found.withColumn(score, F.col(weight) + noise(F.col(key), seed)), "scores")
    return drawn(found, F.col(words) >= least, score, key, share, rank)
