"""Toxicity by a small convolutional text classifier, trained in numpy.

Words are hashed to embeddings; filters of several widths run over them, each
filter's largest response over the whole text is kept, and a logistic layer
scores the text.  The model is fitted on the driver to a bounded sample of
labelled texts.  Because a filter is linear before its maximum, scoring needs
no embeddings: for every bucket and every place of a filter the product is
tabled once, and a text's responses are sums of table rows.

Decisions use thresholds by language, chosen on all labelled texts that the fit
has not seen, but for those of fold 0, which are kept for judging; the score
itself knows nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from skysift.llm.common import BROADCAST_ROWS, ROWS, crc_mod
from skysift.llm.licenses import words_of

#: Labelled texts that the model is fitted to, at most; those of each class with the smallest hash of their id.
SAMPLE = 6000
#: Bytes of text in that sample, at most: it ends, in the order of the hashes, before the text that would exceed them.
SAMPLE_BYTES = 24_000_000
BUCKETS, WIDE, FILTERS, WIDTHS = 1 << 16, 16, 12, (1, 2, 3)
#: A word's embedding is the sum of its own and those of its beginnings of so many bytes, as languages build words from stems.
STEMS = (4, 5, 6, 7, 8)
PARTS = 1 + len(STEMS)
#: Bucket of words and stems in fewer than this many sampled texts, which say nothing.
RARE, SEEN_IN = 0, 4
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.01, 1e-4
#: Thresholds to choose from.
CUTS = np.round(np.arange(0.2, 0.96, 0.05), 2)
#: Words whose buckets a worker remembers.
WORDS = 250_000


class _Buckets(dict):
    """Numbers of words, for whose buckets there is a row each in ``rows``, which grows with need."""

    def __init__(self):
        self.rows = np.zeros((WORDS, PARTS), np.int32)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n, 0] = xxhash.xxh3_64_intdigest(word) % (BUCKETS - 1) + 1
        for i, k in enumerate(STEMS):
            self.rows[n, i + 1] = xxhash.xxh3_64_intdigest(word[:k], seed=1) % (BUCKETS - 1) + 1 if len(word) > k else RARE
        self[word] = n
        return n


_buckets = _Buckets()


def parts_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket rows of the distinct words, the words of all texts as numbers of those rows, and each text's count.

    Every text is followed by words of the bucket RARE, so that the widest filter fits.
    """
    words = [words_of(t) for t in texts]
    if len(_buckets) > WORDS:
        _buckets.clear()
    out, extra = [], np.full(max(WIDTHS), -1, np.int64)
    for w in words:
        at = np.fromiter(map(_buckets.__getitem__, w), np.int64, len(w))
        out += [at, extra]
    joined = np.concatenate(out)
    kinds, joined = np.unique(joined, return_inverse=True)
    rows = _buckets.rows[kinds].astype(np.int64)
    rows[kinds < 0] = RARE
    return rows, joined, np.array([len(w) + len(extra) for w in words])


class Model:
    """known: whether a bucket is common enough to have an embedding."""

    def __init__(self, known: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.known = known
        self.p = {"e": (rng.normal(0, 0.1, (BUCKETS, WIDE)) * known[:, None]).astype(np.float32), "out": rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 0.3, (w, WIDE, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.tables: dict[int, list[np.ndarray]] = {}

    def ready(self) -> Model:
        """Tables for scoring, in which rare buckets are zero."""
        for w in WIDTHS:
            self.tables[w] = [(self.p["e"] @ self.p[f"w{w}"][j]).astype(np.float32) for j in range(w)]
        return self

    @staticmethod
    def _responses(by_place: list[np.ndarray], joined: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A filter width's responses at every word, from each place's product with every kind of word."""
        r = by_place[0][joined]
        for j in range(1, len(by_place)):
            r[:-j] += by_place[j][joined[j:]]
            # Windows that would run into the next text take no part.
            r[at + sizes - j] = -np.inf
        return r

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows, joined, sizes = parts_of(texts)
        at, top = np.cumsum(sizes) - sizes, []
        for w in WIDTHS:
            r = self._responses([t[rows].sum(axis=1) for t in self.tables[w]], joined, at, sizes)
            top.append(np.maximum(np.maximum.reduceat(r, at) + self.p[f"b{w}"], 0))
        z = np.concatenate(top, axis=1) @ self.p["out"] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def _gradient(self, rows: np.ndarray, joined: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k != "e"}
        at = np.cumsum(sizes) - sizes
        kinds = self.p["e"][rows].sum(axis=1)
        filters, hidden, picks = np.arange(FILTERS), [], []
        for w in WIDTHS:
            r = self._responses([kinds @ self.p[f"w{w}"][j] for j in range(w)], joined, at, sizes)
            best = np.stack([i + r[i : i + n].argmax(axis=0) for i, n in zip(at, sizes, strict=True)])
            hidden.append(r[best, filters] + self.p[f"b{w}"])
            picks.append(best)
        h = np.concatenate(hidden, axis=1)
        keep = (rng.random(h.shape) > 0.3) / np.float32(0.7)  # dropout
        a = np.maximum(h, 0) * keep
        p = 1 / (1 + np.exp(-np.clip(a @ self.p["out"] + self.p["bias"], -30, 30)))
        d = ((p - y) * weight / len(y)).astype(np.float32)
        g["out"], g["bias"] = a.T @ d, d.sum(keepdims=True)
        dh = (d[:, None] * self.p["out"] * keep * (h > 0)).astype(np.float32)
        of_kind = np.zeros_like(kinds)
        for n, w in enumerate(WIDTHS):
            dw = dh[:, n * FILTERS : (n + 1) * FILTERS]
            g[f"b{w}"] = dw.sum(axis=0)
            for j in range(w):
                kind = joined[picks[n] + j]
                g[f"w{w}"][j] = np.einsum("dfe,df->ef", kinds[kind], dw)
                np.add.at(of_kind, kind.reshape(-1), (dw[:, :, None] * self.p[f"w{w}"][j].T[None]).reshape(-1, WIDE))
        moved = np.flatnonzero(of_kind.any(axis=1))
        g["rows"], at = np.unique(rows[moved], return_inverse=True)
        g["e"] = np.zeros((len(g["rows"]), WIDE), np.float32)
        np.add.at(g["e"], at.reshape(-1), np.repeat(of_kind[moved], PARTS, axis=0))
        g["e"] *= self.known[g["rows"]][:, None]
        return g

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 7) -> Model:
        """Adam over shuffled batches; embeddings move only where a filter looked."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum()))).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                rows, joined, sizes = parts_of([texts[j] for j in pick])
                g = self._gradient(np.where(self.known[rows], rows, RARE), joined, sizes, y[pick], weight[pick], rng)
                step += 1
                moved = g.pop("rows")
                for k, x in g.items():
                    where = moved if k == "e" else slice(None)
                    x = x + DECAY * self.p[k][where]
                    first[k][where] = 0.9 * first[k][where] + 0.1 * x
                    second[k][where] = 0.999 * second[k][where] + 0.001 * x * x
                    self.p[k][where] -= RATE * (first[k][where] / (1 - 0.9**step)) / (np.sqrt(second[k][where] / (1 - 0.999**step)) + 1e-8)
        return self.ready()


def calibrate(counted: list, least: int = 20) -> dict[str, float]:
    """Per language the threshold with the best F1 on unseen texts; that of all languages together (under None) for those with fewer than ``least`` of a class.

    counted: rows (lang, toxic, bin, unseen, n), where n counts all texts of a
    language and label, and unseen those in the bin that the fit has not seen;
    these stand for all of theirs.
    """
    out = {}
    for name in [None, *sorted({r.lang for r in counted})]:
        of = [r for r in counted if name is None or r.lang == name]
        if any(sum(r.unseen for r in of if r.toxic == t) < least for t in (0, 1)):
            continue
        seen_as = np.zeros((2, len(CUTS) + 1))
        for key in {(r.lang, r.toxic) for r in of}:
            rows = [r for r in of if (r.lang, r.toxic) == key]
            unseen = sum(r.unseen for r in rows)
            for r in rows:
                if unseen:
                    seen_as[key[1], r.bin] += r.unseen * r.n / unseen
        over = seen_as[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]  # texts that reach each cut
        f1 = 2 * over[1] / np.maximum(1e-9, over.sum(axis=0) + seen_as[1].sum())
        out[name] = float(CUTS[max(range(len(CUTS)), key=lambda i: (f1[i], -abs(CUTS[i] - 0.5)))])
    return out


def marked(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic")).withColumnRenamed("doc_id", "_id")


def counted(docs: DataFrame, labels: DataFrame, folds: int, model: Model, seen: list[int]) -> list:
    """Rows for ``calibrate``, of all labelled texts outside fold 0; seen: hashes of id and text that the model was fitted to."""
    spark = docs.sparkSession
    marks = marked(labels)
    texts = docs.where(crc_mod(F.col("doc_id"), folds) != 0).select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("doc_id", F.xxhash64("text")).alias("o"))
    few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        texts = texts.join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).drop("_id")
    fitted = spark.createDataFrame([(o,) for o in seen], "_o long").distinct()  # SAMPLE rows
    texts = texts.join(F.broadcast(fitted), F.col("o") == F.col("_o"), "left").withColumn("fresh", F.col("_o").isNull()).drop("_o", "o")
    # Without their texts before anything is shuffled.
    bins = sum((F.col("score") >= float(c)).cast("int") for c in CUTS)
    found = with_scores(texts, model).withColumn("bin", bins).drop("text", "score")
    if not few:
        found = found.join(marks, F.col("doc_id") == F.col("_id")).drop("_id")
    by = ["lang", F.col("_toxic").alias("toxic")]
    rows = found.groupBy(*by, "bin").agg(F.count(F.when(F.col("fresh"), 1)).alias("unseen"), F.count("*").alias("m")).collect()  # a few for each language
    total: dict[tuple, int] = {}
    for r in rows:
        total[r.lang, r.toxic] = total.get((r.lang, r.toxic), 0) + r.m
    return [Row(lang=r.lang, toxic=r.toxic, bin=r.bin, unseen=r.unseen, n=total[r.lang, r.toxic]) for r in rows]


def sample(docs: DataFrame, labels: DataFrame, folds: int) -> list:
    """Labelled texts to learn from: of each class up to SAMPLE / 2 by the hash of their id, none from fold 0.

    They are the first SAMPLE / 2 that together have at most SAMPLE_BYTES / 2: a
    text for which there is no room is passed over, and the next ones are tried,
    up to SAMPLE in all.
    """
    marks = marked(labels)
    texts = docs.where(F.col("text").isNotNull()).where(crc_mod(F.col("doc_id"), folds) != 0)
    texts = texts.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("text").alias("h"))
    # Chosen without their texts, which then come for the chosen alone.
    ids = texts.select("doc_id", "h", F.octet_length("text").alias("size")).join(marks, F.col("doc_id") == F.col("_id"))
    ids = ids.groupBy("doc_id", "h").agg(F.max("_toxic").alias("_toxic"), F.max("size").alias("size")).withColumn("o", F.xxhash64("doc_id", "h"))
    take = []
    for t in (0, 1):
        room, left = SAMPLE_BYTES // 2, SAMPLE // 2
        for r in ids.where(F.col("_toxic") == t).orderBy("o", "doc_id").limit(SAMPLE).collect():
            if left and r["size"] <= room:
                room, left = room - r["size"], left - 1
                take.append((r.doc_id, r.h, r["_toxic"], r.o))
    chosen = docs.sparkSession.createDataFrame(take, "_id long, _h long, _toxic int, o long")  # SAMPLE rows
    rows = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h")))
    rows = rows.groupBy("o", "doc_id", "_toxic").agg(F.min(F.struct("text", "lang")).alias("t")).select("o", "doc_id", "_toxic", "t.text", "t.lang").collect()
    return sorted(rows, key=lambda r: (r.o, r.doc_id))


class Classifier:
    """A fitted model and the thresholds by language."""

    def __init__(self, rows: list):
        texts = [r.text for r in rows]
        y = np.array([r["_toxic"] for r in rows], np.float32)
        n = np.zeros(BUCKETS, np.int64)
        for t in texts:
            n[np.unique(parts_of([t])[0])] += 1
        known = n >= SEEN_IN
        known[RARE] = False
        self.thresholds: dict[str | None, float] = {}
        self.trial: Model | None = None
        self.seen: list[int] = []
        self.model = Model(known)
        if 0 < y.sum() < len(y):
            # The thresholds come from a model that has not seen every fifth text; the scores from one that has seen all.
            seen = np.arange(len(rows)) % 5 != 0
            if 0 < y[seen].sum() < seen.sum():
                self.trial = Model(known).fit([t for t, s in zip(texts, seen, strict=True) if s], y[seen])
                self.trial.p["e"] = np.empty((0, WIDE), np.float32)
                self.seen = [r.o for r, s in zip(rows, seen, strict=True) if s]
            self.model.fit(texts, y)
        else:
            # Nothing to tell the classes apart by: all texts get one score.
            self.model.p["out"][:] = 0
            self.model.p["bias"][:] = 2.0 if len(y) and y.all() else -2.0
            self.model.ready()
        self.model.p["e"] = np.empty((0, WIDE), np.float32)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Classifier:
    fitted = Classifier(sample(docs, labels, folds))
    if fitted.trial is not None:
        fitted.thresholds = calibrate(counted(docs, labels, folds, fitted.trial, fitted.seen))
    return fitted


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs, which have no such column, with the score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 19 MB, by BUCKETS and FILTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(part.column("text").to_pylist()))], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double")


def scored(docs: DataFrame, classifier: Classifier, folds: int = 5) -> DataFrame:
    """docs with held_out, score, threshold (by language) and toxic (score reaches it).

    The score depends on the text alone; a null text counts as empty.  A null or
    unknown language has the threshold of all languages together, or 0.5 if there are too few labels for that.  Repeated rows are scored each
    alike; an empty table gives no row; columns of docs named like the new ones
    are replaced.
    """
    kept = docs.drop("score", "held_out", "threshold", "toxic")
    threshold = F.lit(classifier.thresholds.get(None, 0.5))
    for lang, cut in classifier.thresholds.items():
        threshold = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(threshold) if lang is not None else threshold
    out = with_scores(kept, classifier.model)
    return out.withColumn("held_out", crc_mod(F.col("doc_id"), folds) == 0).withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))
