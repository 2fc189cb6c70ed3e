"""Ranked lexical search as a blocked product of sparse matrices.

The rows of one matrix are a block of query items, with the number of times
each counts a term (once); the rows of the other are terms, with the whole-number
impact of each on the documents of a block.  A row of the product is merged from
the rows of the item's terms, in 64-bit whole numbers, in an array as long as
the block of documents; what may be among an item's best is kept from block to
block, and the best of all tasks are reduced in Spark.

Only a block of items and their terms is held in memory and sent to the
executors, of at most ``TERMS`` terms together; a larger set of items is several
blocks, and each reads the documents once more.  Documents are never shuffled,
and none is left out of a product.

Nulls and edges: a null or empty text has no term; rows of one item_id are one
item with the terms of all; a null item_id is an item too; repeated documents
are documents of their own; a document whose id is null comes last among equal
scores; without any term in the documents, or any item, there is no row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.common import written

#: Terms of lower-cased UTF-8: digits, letters and all bytes of other code points.
_TERMS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
#: Terms, with repeats between items, of a block of items (about 100 MB in a worker).
TERMS = 500_000
#: Documents of a block, and terms of its documents after which it is full.
DOCS, TOKENS = 8192, 2_000_000
#: Stands for a null id: after all others.
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, and their terms' numbers, item by item, in the order of ids."""

    ids: list
    terms: dict[bytes, int]
    first: np.ndarray
    term: np.ndarray


def term_table(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term): each item's distinct terms, lower-cased in A-Z alone."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    return items.select(F.col(item).alias("item"), F.explode(words).alias("term")).distinct()


def blocks(table: DataFrame, most: int) -> Iterator[Items]:
    """The items in blocks of at most so many terms; an item of more is a block of its own.

    Sizes of items come to the driver, and one block's terms at a time.
    """
    table = written(table, "terms")
    sizes = sorted((tuple(r) for r in table.groupBy("item").agg(F.count("*")).collect()), key=lambda r: (r[0] is None, r[0]))
    at = 0
    while at < len(sizes):
        end, n = at + 1, sizes[at][1]
        while end < len(sizes) and n + sizes[end][1] <= most:
            n += sizes[end][1]
            end += 1
        ids = [r[0] for r in sizes[at:end]]
        known = [i for i in ids if i is not None]
        within = F.col("item").between(known[0], known[-1]) if known else F.lit(False)
        some = table.where(within | F.col("item").isNull() if ids[-1] is None else within)
        number: dict[bytes, int] = {}
        rows: dict = {i: [] for i in ids}
        for r in some.collect():
            rows[r.item].append(number.setdefault(r.term.encode(), len(number)))
        first = np.cumsum([0] + [len(rows[i]) for i in ids])
        yield Items(ids, number, first, np.array([t for i in ids for t in sorted(rows[i])], np.int64))
        at = end


def _counts(texts: list[str | None], terms: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, times) of the texts' terms among the items', by term and document, and each text's number of terms."""
    cut = [_TERMS(t.encode().lower()) if t else [] for t in texts]
    n = np.array([len(c) for c in cut], np.int64)
    get = terms.get
    found = np.fromiter((get(w, -1) for c in cut for w in c), np.int64, int(n.sum()))
    known = found >= 0
    key, times = np.unique(found[known] * len(texts) + np.repeat(np.arange(len(texts)), n)[known], return_counts=True)
    return key // max(len(texts), 1), key % max(len(texts), 1), times, n


def _blocks(batches: Iterator[pa.RecordBatch], key: str | None, text: str) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """Blocks of documents: ids and texts."""
    ids, texts, size = [], [], 0
    for batch in batches:
        keys = batch.column(key).cast(pa.int64()).to_pylist() if key else [0] * batch.num_rows
        for k, t in zip(keys, batch.column(text), strict=True):
            t = t.as_py()
            ids.append(LAST if k is None else k)
            texts.append(t)
            size += len(t or "") // 6 + 1
            if len(texts) == DOCS or size >= TOKENS:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
    if texts:
        yield np.array(ids, np.int64), texts


def statistics(docs: DataFrame, items: Items, text: str) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents with repeats, and for each term of the items the documents that hold it."""
    terms = docs.sparkSession.sparkContext.broadcast(items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        out = np.zeros(len(known) + 2, np.int64)
        for _, texts in _blocks(batches, None, text):
            term, _, _, n = _counts(texts, known)
            out[:-2] += np.bincount(term, minlength=len(known))
            out[-2:] += [(n > 0).sum(), n.sum()]
        full = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(out[full])], names=["i", "n"])

    out = np.zeros(len(items.terms) + 2, np.int64)
    for r in docs.select(text).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block
        out[r.i] = r.n
    return int(out[-2]), int(out[-1]), out[:-2]


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * h + 1))) for h in holding.tolist()], np.int64)


def impacts(w: np.ndarray, times: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term adds to a document's score; n: the document's terms."""
    # In Python's numbers where the product might leave 64 bits.
    lengths, back = np.unique(n, return_inverse=True)
    m = np.array([100 - 90 + 90 * x * documents // total for x in lengths.tolist()], np.int64)[back]
    return w * (1_000_000_000 * times // (1000 * times + 8 * m))


def product(items: Items, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, documents: int) -> Iterator[tuple[int, np.ndarray]]:
    """(item, scores of the block's documents), a row of the product at a time; items none of whose terms is there are left out.

    term, doc, impact: the other matrix's entries, by term and document.
    """
    first = np.searchsorted(term, np.arange(len(items.terms) + 1))
    row = np.empty(documents, np.int64)
    sizes = np.diff(first)
    for i in range(len(items.ids)):
        mine = items.term[items.first[i] : items.first[i + 1]]
        mine = mine[sizes[mine] > 0]
        if not len(mine):
            continue
        row[:] = 0
        for t in mine.tolist():
            a, b = first[t], first[t + 1]
            if b - a == documents:
                row += impact[a:b]
            else:
                row[doc[a:b]] += impact[a:b]
        yield i, row


def _best(docs: DataFrame, items: Items, key: str, text: str, top: int) -> DataFrame:
    """(i, doc_id, score): the best of every task's documents for each item of a block."""
    documents, total, holding = statistics(docs, items, text)
    w = weights(documents, holding)
    sent = docs.sparkSession.sparkContext.broadcast((items, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = sent.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(block.ids)
        least = np.ones(len(block.ids), np.int64)
        for ids, texts in _blocks(batches, key, text):
            term, doc, times, n = _counts(texts, block.terms)
            if not len(term):
                continue
            impact = impacts(weight[term], times, n[doc], documents, total)
            for i, row in product(block, term, doc, impact, len(texts)):
                good = np.flatnonzero(row >= least[i])
                if not len(good):
                    continue
                score, who = np.concatenate([best[i][0], row[good]]), np.concatenate([best[i][1], ids[good]])
                order = np.lexsort((who, -score))[:top]
                best[i] = score[order], who[order]
                if len(order) == top:
                    least[i] = score[order[-1]]
        number = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        score, who = (np.concatenate([b[j] for b in best]) if best else np.empty(0, np.int64) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(who, mask=who == LAST), pa.array(score)], names=["i", "doc_id", "score"])

    return docs.select(key, text).mapInArrow(run, "i long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = 10, key: str = "doc_id", item: str = "item_id", text: str = "text", item_text: str = "text", terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0, equal scores by ascending id.

    key: a column of whole numbers.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)[item]
    out = spark.createDataFrame([], f"{item} {kind}, rank int, {key} long, score long")
    for block in blocks(term_table(items, item, item_text), terms):
        found = _best(docs, block, key, text, top)
        order = Window.partitionBy("i").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        few = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # the limit is also taken before the shuffle
        names = spark.createDataFrame(list(enumerate(block.ids)), f"i long, {item} {kind}")
        out = out.unionByName(few.join(F.broadcast(names), "i").select(item, "rank", F.col("doc_id").alias(key), "score"))
    return out
