"""Scoring by a bigram model whose counts lie in a log-frequency Bloom filter.

An n-gram's count is quantised to a level on a logarithmic scale, and the n-gram
is entered once for each level up to its own; a count is read back by probing
level after level until one is missing.  The filter is built in segments: hashes
deal the n-grams to buckets and each bucket's segment is made by one task.  All
n-grams enter, those that occur once too, so the filter grows with their number.
Up to ``FILTER_BITS`` the segments together are broadcast; beyond it they stay
where they are, and the n-grams that texts ask for are sent to them.  Scores are
the same either way.

A word's probability after another is discounted and interpolated::

    p(w | h) = max(c(h, w) - D, 0) / c(h) + (1 - m(h) / c(h)) p(w)

where m(h) is the discounted mass of h's bigrams, entered like a count in units of
1 - D, and p(w) the smoothed unigram probability.  After a history that the
training texts don't have the model is the unigram model.

Exact unigram counts, for the base score, come in two parts: the frequent words
(at most ``TOP`` of them) are broadcast, all others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import ROWS, crc_mod, written
from skysift.llm.hashing import hashed, mixed

#: Scale of the levels, whose first ones are the whole numbers, and the discount of a bigram's count.
BASE, DISCOUNT = 1.25, 0.75
#: Bits of the filter that are broadcast at most (168 MB), bits per entry and probes; one in 77 missing entries seems to be there.
FILTER_BITS, ENTRY_BITS, PROBES = 5 << 28, 9, 6
#: Levels that a task remembers.
REMEMBERED = 1 << 20
#: Frequent words whose exact count is broadcast, at most (12 bytes each).
TOP = 2_000_000
#: Tokens counted in memory at once, and tokens of the corpus per bucket.
CHUNK, BUCKET = 3_000_000, 500_000
#: Bytes of text whose n-grams are looked up together, and bytes in a task of segments that are not broadcast.
ASKED, HELD = 2_000_000, 8_000_000
#: The least count of a frequent word is 2 to the power of one of these.
STEPS = 24

END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))  # no word has a space
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LEVEL = np.uint64(0xD6E8FEB86659FD93)
_MASS = np.uint64(xxhash.xxh3_64_intdigest(b" mass"))
_LAST = np.uint64(0xFFFFFFFF)
_BIT = np.left_shift(np.uint8(1), np.arange(8, dtype=np.uint8))
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFE)

_COUNTED = "bucket int, uni binary, uni_n binary, bi binary, bi_n binary, tokens long, words long, uni_ge array<long>, entries long"


def unigram_keys(w: np.ndarray) -> np.ndarray:
    """Even keys."""
    with np.errstate(over="ignore"):
        return (mixed(w) & ~np.uint64(1)) * _ODD


def bigram_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Odd keys, whose first factor holds 32 bits of the history's hash."""
    with np.errstate(over="ignore"):
        return (mixed(h) & _HIGH | mixed(w) >> np.uint64(32) & _LOW | np.uint64(1)) * _ODD


def mass_keys(high: np.ndarray) -> np.ndarray:
    return mixed(high ^ _MASS)


def _scale() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BASE)))
    return np.array(out, np.float64)


_FROM = _scale()
_MIDDLE = np.concatenate([[0.0], (_FROM + np.append(_FROM[1:] - 1, _FROM[-1])) / 2])


def levels(counts: np.ndarray, least: float) -> np.ndarray:
    """1 for the least count, and 1 more for each factor of BASE, but never two for a step of the least count."""
    return np.searchsorted(_FROM, np.asarray(counts) / least, "right")


def count_of(level: np.ndarray, least: float) -> np.ndarray:
    """A count in the middle of the level's range; the first few are themselves."""
    return least * _MIDDLE[level]


class Filter:
    """Bits in equal segments; a key's segment is its highest bits."""

    def __init__(self, bits: np.ndarray, buckets: int):
        self.bits, self.shift, self.size = bits, np.uint64(64 - int(math.log2(buckets))), len(bits) * 8 // buckets

    @staticmethod
    def places(keys: np.ndarray, level: int | np.ndarray, size: int) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            x = mixed(keys + np.asarray(level, np.uint64) * _LEVEL)
            a, b = x >> np.uint64(32), x & _LAST | np.uint64(1)
            return [(a + np.uint64(i) * b & _LAST) * np.uint64(size) >> np.uint64(32) for i in range(PROBES)]

    def levels(self, keys: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
        """Levels read back by probing; by: where the segment's number is, if not in keys.

        A key has all levels up to its own, so levels are probed in doubling steps
        and then between the last two.  A level that only seems to be there shows
        in the one below it, which is missing; such a key is probed level by level.
        """
        by = keys if by is None else by
        start = (by >> self.shift if self.shift < 64 else by * np.uint64(0)) * np.uint64(self.size)
        low, high = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        live, level = np.arange(len(keys)), 1
        while len(live):
            there = self._there(keys[live], start[live], level)
            high[live[~there]] = level
            live = live[there]
            low[live] = level
            level *= 2
        while len(live := np.flatnonzero(high - low > 1)):
            middle = (low[live] + high[live]) // 2
            there = self._there(keys[live], start[live], middle)
            low[live[there]], high[live[~there]] = middle[there], middle[~there]
        live = np.flatnonzero(low > 2)
        live = live[~self._there(keys[live], start[live], low[live] - 1)]
        low[live], level = 0, 1
        while len(live):
            live = live[self._there(keys[live], start[live], level)]
            low[live] = level
            level += 1
        return low

    def _there(self, keys: np.ndarray, start: np.ndarray, level: int | np.ndarray) -> np.ndarray:
        """Whether each key has the level; probing ends with the first bit that is off."""
        with np.errstate(over="ignore"):
            x = mixed(keys + np.asarray(level, np.uint64) * _LEVEL)
        a, b, size = x >> np.uint64(32), x & _LAST | np.uint64(1), np.uint64(self.size)
        on, live = np.zeros(len(keys), bool), np.arange(len(keys))
        for i in range(PROBES):
            at = start + ((a & _LAST) * size >> np.uint64(32))
            hit = np.flatnonzero(self.bits[at >> np.uint64(3)] & _BIT[at & np.uint64(7)])
            if i + 1 < PROBES and len(hit) < len(at):
                live, a, b, start = live[hit], a[hit], b[hit], start[hit]
            a = a + b
        on[live if len(hit) == len(live) else live[hit]] = True
        return on


class Remembering:
    """A filter's levels, those of keys that occurred more than once kept at hand."""

    def __init__(self, model: Filter):
        self.model, self.keys, self.found = model, np.zeros(REMEMBERED, np.uint64), np.zeros(REMEMBERED, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        slot = (mixed(keys) & np.uint64(REMEMBERED - 1)).astype(np.int64)
        out = self.found[slot].astype(np.int64)
        new = np.flatnonzero((self.keys[slot] != keys) | (keys == 0))
        # Segment by segment, so that probes stay close together.
        new = new[np.argsort((keys[new] >> np.uint64(48)).astype(np.uint16), kind="stable")]
        out[new] = self.model.levels(keys[new])
        often = new[out[new] > 1]
        self.keys[slot[often]], self.found[slot[often]] = keys[often], out[often]
        return out


def _slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys, for the buckets that have any."""
    bits = int(math.log2(buckets))
    own = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.diff(own, prepend=-1))
    return zip(own[at].tolist(), at.tolist(), np.append(at[1:], len(keys)).tolist(), strict=True)


def ended(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text with its end, and each text's number of tokens."""
    w, sizes = hashed(texts)
    return np.insert(w, np.cumsum(sizes), END), sizes + 1


def counts(docs: DataFrame, buckets: int, bigrams: bool = True) -> DataFrame:
    """Counts of all unigrams and bigrams, or of unigrams alone, a row per bucket.

    Tasks count in memory first, so that a common n-gram is sent once by each.
    """
    part_schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            w = np.concatenate(held)
            both = [unigram_keys(w)] + ([bigram_keys(np.concatenate([[END], w[:-1]]), w)] if bigrams else [])
            keys, n = np.unique(np.concatenate(both), return_counts=True)
            n = n.astype("<u4")
            rows = [{"bucket": b, "keys": keys[i:j].tobytes(), "n": n[i:j].tobytes()} for b, i, j in _slices(keys, buckets)]
            return pa.RecordBatch.from_pylist(rows, schema=part_schema)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held.append(ended(batch.column("text").slice(at, ROWS).to_pylist())[0])
                size += len(held[-1])
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(group.column("n").to_pylist()), "<u4").astype(np.int64)
        keys, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        uni = keys & np.uint64(1) == 0
        bi = ~uni
        steps = [1 << i for i in range(STEPS)]
        row = {
            "bucket": group.column("bucket")[0].as_py(),
            "uni": keys[uni].tobytes(), "uni_n": n[uni].tobytes(), "bi": keys[bi].tobytes(), "bi_n": n[bi].tobytes(),
            "tokens": int(n[uni].sum()), "words": int(uni.sum()),
            "uni_ge": [int((n[uni] >= s).sum()) for s in steps],
            "entries": int(levels(n, 1).sum()),
        }
        return pa.Table.from_pylist([row], schema=pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("uni", "uni_n", "bi", "bi_n")], ("tokens", pa.int64()), ("words", pa.int64()), ("uni_ge", pa.list_(pa.int64())), ("entries", pa.int64())]))

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, n binary").groupBy("bucket").applyInArrow(merge, _COUNTED)


def _arrays(batch: pa.RecordBatch, keys: str, n: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for r in batch.select(["bucket", keys, n]).to_pylist():
        yield r["bucket"], np.frombuffer(r[keys], np.uint64), np.frombuffer(r[n], np.int64)


def masses(counted: DataFrame, buckets: int) -> DataFrame:
    """A row per bucket: keys of histories, levels of their masses, and how many levels these are together."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            high, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held]), len(high))
            keys = mass_keys(high)
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            return pa.RecordBatch.from_pylist([{"bucket": b, "keys": keys[i:j].tobytes(), "n": n[i:j].tobytes()} for b, i, j in _slices(keys, buckets)], schema=schema)

        for batch in batches:
            for _, keys, n in _arrays(batch, "bi", "bi_n"):
                with np.errstate(over="ignore"):
                    held.append((keys * _BACK & _HIGH, n - DISCOUNT))
                size += len(keys)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        keys, at = np.unique(np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64), return_inverse=True)
        top = levels(np.bincount(at, np.frombuffer(b"".join(group.column("n").to_pylist()), np.float64), len(keys)), 1 - DISCOUNT)
        row = {"bucket": group.column("bucket")[0].as_py(), "keys": keys.tobytes(), "levels": top.astype(np.uint8).tobytes(), "entries": int(top.sum())}
        return pa.Table.from_pylist([row], schema=pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("levels", pa.binary()), ("entries", pa.int64())]))

    return counted.select("bucket", "bi", "bi_n").mapInArrow(run, "bucket int, keys binary, n binary").groupBy("bucket").applyInArrow(merge, "bucket int, keys binary, levels binary, entries long")


def build(counted: DataFrame, mass: DataFrame, size: int) -> DataFrame:
    """Segments (bucket, bits) of the filter: all unigrams, bigrams and histories' masses.

    Both tables have a bucket in a row, so only bits meet, never n-grams.
    """

    def entered(rows: Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]) -> Iterator[pa.RecordBatch]:
        for bucket, entries in rows:
            on = np.zeros(size, bool)
            for keys, top in entries:
                for level in range(1, int(top.max(initial=0)) + 1):
                    keys, top = keys[top >= level], top[top >= level]
                    for at in Filter.places(keys, level, size):
                        on[at] = True
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["bucket", "bits"])

    def of_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((r["bucket"], [(np.frombuffer(r[k], np.uint64), levels(np.frombuffer(r[n], np.int64), 1)) for k, n in (("uni", "uni_n"), ("bi", "bi_n"))]) for r in batch.to_pylist())
            yield from entered(rows)

    def of_masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from entered((r["bucket"], [(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["levels"], np.uint8))]) for r in batch.to_pylist())

    def united(group: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("bits")])
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    ddl = "bucket int, bits binary"
    both = counted.select("bucket", "uni", "uni_n", "bi", "bi_n").mapInArrow(of_counts, ddl).union(mass.select("bucket", "keys", "levels").mapInArrow(of_masses, ddl))
    return both.groupBy("bucket").applyInArrow(united, ddl)


def asked(kinds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What texts need of the filter, from their distinct words and each token's number among these.

    The number of the word before each token, that of its bigram, and the keys of
    all words, of their masses as histories, and of all bigrams.
    """
    before = np.concatenate([[np.searchsorted(kinds, END)], of[:-1]])
    pairs, of_pair = np.unique(before * len(kinds) + of, return_inverse=True)
    keys = [unigram_keys(kinds), mass_keys(mixed(kinds) & _HIGH), bigram_keys(kinds[pairs // len(kinds)], kinds[pairs % len(kinds)])]
    return before, of_pair, np.concatenate(keys)


def logs(level: np.ndarray, kinds: int, before: np.ndarray, of: np.ndarray, of_pair: np.ndarray, whole: float) -> np.ndarray:
    """Each token's log10 probability, from the levels of what ``asked`` gave."""
    c, mass, both = count_of(level[:kinds], 1), count_of(level[kinds : 2 * kinds], 1 - DISCOUNT), count_of(level[2 * kinds :], 1)[of_pair]
    p = (c + 0.1)[of] / whole
    # No bigram is more frequent than its words, whatever its probes say.
    both = np.where(mass[before] > 0, np.minimum(both, np.minimum(c[before], c[of])), 0)
    seen = np.maximum(c[before], np.maximum(mass[before] + DISCOUNT, both))
    follows = (mass[before] > 0) & (c[before] > 0)
    return np.log10(np.where(follows, np.maximum(both - DISCOUNT, 0) / seen + (1 - mass[before] / seen) * p, p))


def looked_up(held: DataFrame, segments: DataFrame, buckets: int, size: int, whole: float) -> DataFrame:
    """(row, score) of all texts, with a filter in segments that meet only the n-grams looked up in them.

    held: chunks of texts (chunk, rows, sizes, kinds, of).
    """
    each = 1 << max(0, int(math.log2(max(1, HELD * 8 // size))))
    groups = max(1, buckets // each)
    each = buckets // groups

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.unique(asked(np.frombuffer(r["kinds"], np.uint64), np.frombuffer(r["of"], np.int32).astype(np.int64))[2])
                found = list(_slices(keys, groups)) if groups > 1 else [(0, 0, len(keys))]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in found], pa.int32()), pa.array([r["chunk"]] * len(found), pa.int64()), pa.array([keys[i:j].tobytes() for _, i, j in found], pa.binary())], names=["part", "chunk", "keys"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        part = (left if left.num_rows else right).column("part")[0].as_py()
        bits = np.zeros(each * size // 8, np.uint8)
        for b, x in zip(right.column("bucket").to_pylist(), right.column("bits"), strict=True):
            bits[(b - part * each) * size // 8 : (b - part * each + 1) * size // 8] = np.frombuffer(x.as_buffer(), np.uint8)
        model, got = Filter(bits, each), []
        for x in left.column("keys"):
            keys = np.frombuffer(x.as_buffer(), np.uint64)
            # The group's number goes, so that the segment's is highest.
            got.append(model.levels(keys, keys << np.uint64(int(math.log2(groups)))).astype(np.uint8).tobytes())
        return pa.table({"chunk": left.column("chunk"), "part": left.column("part"), "levels": pa.array(got, pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        r = left.to_pylist()[0]
        kinds, of = np.frombuffer(r["kinds"], np.uint64), np.frombuffer(r["of"], np.int32).astype(np.int64)
        before, of_pair, keys = asked(kinds, of)
        got = sorted(zip(right.column("part").to_pylist(), right.column("levels").to_pylist(), strict=True))
        level = np.frombuffer(b"".join(x for _, x in got), np.uint8)[np.unique(keys, return_inverse=True)[1]]
        doc = np.repeat(np.arange(len(r["sizes"])), r["sizes"])
        return pa.table({"row": pa.array(r["rows"], pa.int64()), "score": pa.array(np.bincount(doc, logs(level, len(kinds), before, of, of_pair, whole), len(r["sizes"])))})

    probes = held.select("chunk", "kinds", "of").mapInArrow(ask, "part int, chunk long, keys binary")
    parts = segments.withColumn("part", F.floor(F.col("bucket") / each).cast("int"))
    answers = probes.groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(answer, "chunk long, part int, levels binary")
    return held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, "row long, score double")


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Scores whole texts by a model of those whose crc32(doc_id as text) mod ``folds`` is not 0.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens,
    base_score and score.  A null text is empty, a null doc_id counts as empty
    text for the fold; repeated rows count and are scored each; without any
    text to learn from, all words are unknown and the model is uniform.  Other
    columns don't matter; an empty table gives no row.
    """
    return _scored(docs, folds, True)


def base_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """What score() returns but for the model's score; neither bigrams are counted nor a filter is made."""
    return _scored(docs, folds, False)


def _scored(docs: DataFrame, folds: int, model: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"))
    train = docs.where(~F.col("held_out"))
    tokens = (train.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    buckets = 1 << max(3, math.ceil(math.log2(max(1, tokens / BUCKET))))
    counted = written(counts(train, buckets, model), "counts")
    total = counted.agg(F.sum("tokens"), F.sum("words"), *[F.sum(F.col("uni_ge")[i]) for i in range(STEPS)]).first()
    n_all, n_words, uni_ge = total[0] or 0, total[1] or 0, [x or 0 for x in total[2:]]
    bits, size, whole_filter = np.zeros(0, np.uint8), 0, False
    if model:
        mass = written(masses(counted, buckets), "masses")
        # All segments are as large as the fullest one needs.
        entries = counted.select("bucket", "entries").union(mass.select("bucket", "entries")).groupBy("bucket").agg(F.sum("entries").alias("n")).agg(F.max("n")).first()[0] or 0
        size = -(-max(128, entries * ENTRY_BITS) // 64) * 64
        segments = build(counted, mass, size)
        whole_filter = buckets * size <= FILTER_BITS
        if not whole_filter:
            segments = written(segments, "segments")
    spark._jvm.System.gc()  # lets go of the shuffles behind the tables written
    if whole_filter:
        bits = np.zeros(buckets * size // 8, np.uint8)
        for r in segments.toLocalIterator():  # FILTER_BITS in all
            bits[r.bucket * size // 8 : (r.bucket + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)

    often = next((i for i in range(STEPS) if uni_ge[i] <= TOP), STEPS - 1)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, keys, n in _arrays(batch, "uni", "uni_n"):
                yield pa.RecordBatch.from_pylist([{"bucket": bucket, "keys": keys[n >= 1 << often].tobytes(), "n": n[n >= 1 << often].tobytes()}], schema=pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())]))

    top = sorted(counted.select("bucket", "uni", "uni_n").mapInArrow(frequent, "bucket int, keys binary, n binary").toLocalIterator(), key=lambda r: r.bucket)  # TOP words in all
    top_keys = np.frombuffer(b"".join(r["keys"] for r in top), np.uint64)
    top_n = np.frombuffer(b"".join(r["n"] for r in top), np.int64)
    shared = spark.sparkContext.broadcast((bits, top_keys, top_n))
    whole = n_all + 0.1 * (n_words + 1)

    schema = pa.schema([("chunk", pa.int64()), ("rows", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("held_outs", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64())), ("rest", pa.list_(pa.list_(pa.int64()))), ("kinds", pa.binary()), ("of", pa.binary())])

    def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")]) // ASKED
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if i < j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, top_keys, top_n = shared.value
        remembered = Remembering(Filter(bits, buckets)) if whole_filter else None
        for batch in batches:
            for part in chunks(batch):
                w, sizes = ended(part.column("text").to_pylist())
                doc = np.repeat(np.arange(len(sizes)), sizes)
                kinds, of = np.unique(w, return_inverse=True)
                keys = unigram_keys(kinds)
                found = np.minimum(np.searchsorted(top_keys, keys), max(0, len(top_keys) - 1))
                n = np.where(top_keys[found] == keys, top_n[found], 0) if len(top_keys) else np.zeros(len(keys), np.int64)
                base = np.bincount(doc, np.log10((n + 0.1) / whole)[of], len(sizes))
                known = np.bincount(doc, (n > 0)[of], len(sizes)).astype(np.int64)
                # The model's own counts come from the filter.
                scored = None
                if whole_filter:
                    before, of_pair, wanted = asked(kinds, of)
                    scored = np.bincount(doc, logs(remembered.levels(wanted), len(kinds), before, of, of_pair, whole), len(sizes)).tolist()
                rare = keys[of].view(np.int64) if often else np.empty(0, np.int64)
                rest = [rare[i:j][n[of[i:j]] == 0].tolist() for i, j in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)] if often else [[]] * len(sizes)
                row = {"chunk": part.column("row")[0].as_py(), "rows": part.column("row").to_pylist(), "doc_ids": part.column("doc_id").to_pylist(), "held_outs": part.column("held_out").to_pylist(), "sizes": sizes.tolist(), "known": known.tolist(), "base": base.tolist(), "score": scored, "rest": rest}
                if model and not whole_filter:
                    row |= {"kinds": kinds.tobytes(), "of": of.astype(np.int32).tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    ddl = "chunk long, rows array<long>, doc_ids array<long>, held_outs array<boolean>, sizes array<long>, known array<long>, base array<double>, score array<double>, rest array<array<long>>, kinds binary, of binary"
    held = written(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, ddl), "scores")
    fields = ["rows", "doc_ids", "held_outs", "sizes", "known", "base", "rest"] + ["score"] * whole_filter
    scored = held.select(F.explode(F.arrays_zip(*fields)).alias("d")).select(F.col("d.rows").alias("row"), F.col("d.doc_ids").alias("doc_id"), F.col("d.held_outs").alias("held_out"), F.col("d.sizes").alias("n_tokens"), *[f"d.{x}" for x in fields[4:]])
    if model and not whole_filter:
        found = looked_up(held.select("chunk", "rows", "sizes", "kinds", "of"), segments, buckets, size, whole)
        scored = scored.join(written(found, "found"), "row")
    out = scored.select("row", "doc_id", "held_out", "n_tokens", "known", "base", *["score"] * model)
    if often:

        def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, keys, n in _arrays(batch, "uni", "uni_n"):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[n < 1 << often].view(np.int64)), pa.array(n[n < 1 << often])], names=["k", "n"])

        rare = counted.select("bucket", "uni", "uni_n").mapInArrow(tail, "k long, n long")
        more = scored.select("row", F.explode("rest").alias("k")).groupBy("row", "k").agg(F.count("*").alias("times")).join(rare, "k")
        more = more.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.1) - F.log10(F.lit(0.1)))).alias("more_base"))
        out = out.join(more, "row", "left").withColumn("known", F.col("known") + F.coalesce("more_known", F.lit(0))).withColumn("base", F.col("base") + F.coalesce("more_base", F.lit(0.0)))
    return out.select("doc_id", "held_out", "n_tokens", F.col("known").cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), *["score"] * model)
