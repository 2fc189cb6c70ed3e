"""Near-duplicate groups by an LSH forest over MinHash signatures.

Documents with the same set of word shingles are one class from the start.  A
class has a signature of 96 minima.  The forest is 24 sorted orders of all
signatures, each beginning at another four of the minima and going on with the
next ones.  Only classes that meet another one in an order, on its first four
minima, go on; most classes never do.

How deep an order is followed depends on how crowded it is there:

* In a region of at most ``RUN`` classes all neighbours are candidates, if
  their signatures agree enough.
* In a fuller region the order goes on with the next minima, and a class's
  candidates are its neighbours with the longest common prefix; the likeliest
  few of each class are checked.  That joins copies of one another to
  components in linear work, and copies need no pairs among themselves any more.
* Full regions may still hide links between components.  Their classes are
  compared once more by an exact set join with other components: shingles are
  put in one order, rare ones first, and two classes can only be linked if they
  share one among the first few of each and have enough shingles left after it.

So nothing is cut off in a crowd.  Every link is confirmed on full shingle sets
(of 64-bit hashes).  At a similarity of 0.8 two classes meet on four minima of
one order with probability 0.4, so all 24 orders miss them with 4e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import free, map_rows, small, written
from skysift.llm.hashing import hashed, mixed

ORDERS, LEAST = 24, 4
MINIMA = ORDERS * LEAST
#: Classes of a region all of which are compared with one another.
RUN = 32
#: In fuller regions: further minima that order a class, neighbours looked at, the likeliest of a class that are checked.
DEPTH, NEAR, BEST = 20, 3, 3
#: Least share of equal minima for a full check: five standard deviations below 0.8.
ESTIMATE = 0.6
#: Cells in which shingles are counted to put rare ones first; any counts give the same links.
CELLS, BLOCK = 1 << 20, 1 << 12
#: Links that one task contracts in memory.
LINKS = 1_000_000
_ODD = np.array([xxhash.xxh3_64_intdigest(b"times", seed=i) | 1 for i in range(MINIMA)], np.uint64)
_XOR = np.array([xxhash.xxh3_64_intdigest(b"xor", seed=i) for i in range(MINIMA)], np.uint64)
_PLACE = np.array([xxhash.xxh3_64_intdigest(b"place", seed=i) | 1 for i in range(64)], np.uint64)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of all its words if they are fewer."""
    words, sizes = hashed(texts)
    out = []
    for w in np.split(words, np.cumsum(sizes)[:-1]):
        n = min(k, len(w))
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        with np.errstate(over="ignore"):
            h = np.full(len(w) - n + 1, n, np.uint64)
            for j in range(n):
                h += w[j : j + len(h)] * _PLACE[j]
            out.append(np.unique(mixed(h)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima (16 bits of each) of each non-empty set under every hash function."""
    joined = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), MINIMA), np.uint16)
    buf = np.empty_like(joined)
    with np.errstate(over="ignore"):
        for i in range(MINIMA):
            np.bitwise_xor(joined, _XOR[i], out=buf)
            np.multiply(buf, _ODD[i], out=buf)
            out[:, i] = (np.minimum.reduceat(buf, at) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def heads(sig: np.ndarray) -> np.ndarray:
    """For each signature and order a number made of the order and its first minima."""
    first = np.ascontiguousarray(sig.reshape(len(sig), ORDERS, LEAST)).view(np.uint64)[:, :, 0]
    with np.errstate(over="ignore"):
        return mixed(first + np.arange(ORDERS, dtype=np.uint64) * _PLACE[0]).view(np.int64)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles; set_hash, heads and sig (8 bits of each minimum), null without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("heads", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(rows: dict[str, list]) -> dict[str, list]:
        sets = shingle_sets(rows["text"], k)
        full = [i for i, s in enumerate(sets) if len(s)]
        hashes, tops, sigs = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        if full:
            sig = signatures([sets[i] for i in full])
            for i, top, low in zip(full, heads(sig), sig.astype(np.uint8), strict=True):
                hashes[i], tops[i], sigs[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), top, low.tobytes()
        return {"doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "n_shingles": [len(s) for s in sets], "set_hash": hashes, "heads": tops, "sig": sigs}

    return map_rows(docs.select(docs["doc_id"].cast("long"), F.xxhash64("text").alias("text_hash"), "text"), run, schema, "doc_id long, text_hash long, n_shingles long, set_hash binary, heads array<long>, sig binary")


def met(classes: DataFrame) -> DataFrame:
    """(o, h, node, size): classes in the regions of each order that hold more than one, with the region's size."""
    each = classes.select("node", F.posexplode("heads").alias("o", "h"))
    regions = written(each.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "regions")
    return written(each.join(small(regions), "h").select("o", "h", "node", "size"), "met")


def agreeing(sigs: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of signatures, a row each, of which at least such a share is equal."""
    i, j = np.triu_indices(len(sigs), 1)
    good = (sigs[i] == sigs[j]).mean(axis=1) >= least
    return i[good], j[good]


def near(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of classes that meet in a region of at most ``RUN`` and agree enough."""
    rows = found.where(F.col("size") <= RUN).join(classes.select("node", "sig"), "node")
    regions = rows.groupBy("h").agg(F.collect_list("node").alias("nodes"), F.collect_list("sig").alias("sigs"))  # at most RUN of each
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = [np.empty((0, 2), np.int64)]
            for nodes, sigs in zip(batch.column("nodes"), batch.column("sigs"), strict=True):
                node = nodes.values.to_numpy()
                i, j = agreeing(np.frombuffer(b"".join(sigs.as_py()), np.uint8).reshape(len(node), MINIMA), ESTIMATE)
                out.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
            pairs = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return regions.select("nodes", "sigs").mapInArrow(run, "a long, b long").distinct()


def deeper(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a < b) in fuller regions: of each class's neighbours by longest common prefix the likeliest few."""
    key = F.expr(f"substring(concat(sig, sig), {LEAST} * (o + 1) + 1, {DEPTH})")
    rows = found.where(F.col("size") > RUN).join(classes.select("node", "sig"), "node").select("h", key.alias("key"), "node", "sig")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("equal", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, node, sig = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, MINIMA), np.uint8)
        for batch in batches:
            old = len(h)
            h = np.concatenate([h, batch.column("h").to_numpy()])
            node = np.concatenate([node, batch.column("node").to_numpy()])
            sig = np.concatenate([sig, np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, MINIMA)])
            out = []
            for s in range(1, min(NEAR, len(h) - 1) + 1):
                first = max(0, old - s)  # pairs within the rows kept are known
                i = first + np.flatnonzero(h[first:-s] == h[first + s :])
                equal = (sig[i] == sig[i + s]).sum(axis=1)
                i, equal = i[equal >= ESTIMATE * MINIMA], equal[equal >= ESTIMATE * MINIMA]
                out.append((np.minimum(node[i], node[i + s]), np.maximum(node[i], node[i + s]), equal.astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)
            h, node, sig = h[-NEAR:], node[-NEAR:], sig[-NEAR:]

    ordered = rows.repartitionByRange(parts, "h", "key", "node").sortWithinPartitions("h", "key", "node")
    pairs = ordered.mapInArrow(run, "a long, b long, equal long").groupBy("a", "b").agg(F.max("equal").alias("equal"))
    # A class has at most 2 NEAR ORDERS of them.
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    best = pairs.select("equal", both.alias("p")).groupBy("p.x").agg(F.sort_array(F.collect_list(F.struct("equal", "p.y")), asc=False).alias("all"))
    best = best.select("x", F.explode(F.slice("all", 1, BEST)).alias("p"))
    return best.select(F.least("x", "p.y").alias("a"), F.greatest("x", "p.y").alias("b")).distinct()


def needed(p: int, x: Column, y: Column) -> Column:
    """Least common shingles of linked sets of x and y."""
    return F.ceil(p * (x + y) / (100.0 + p) - 1e-9)


_PACKED = "block int, part int, cells binary, n binary"


def packed(n: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    """Counts of cells that aren't 0, a row for each block of them."""
    for block in range(CELLS // BLOCK):
        own = n[block * BLOCK : (block + 1) * BLOCK]
        if len(at := np.flatnonzero(own)):
            yield pa.RecordBatch.from_pylist([{"block": block, "part": part % 256, "cells": at.astype("<u2").tobytes(), "n": own[at].astype("<u8").tobytes()}], schema=pa.schema([("block", pa.int32()), ("part", pa.int32()), ("cells", pa.binary()), ("n", pa.binary())]))


def merged(group: pa.Table) -> pa.Table:
    """The sum of a block's counts, in one row."""
    n = np.zeros(BLOCK, np.int64)
    for cells, more in zip(group.column("cells"), group.column("n"), strict=True):
        n[np.frombuffer(cells.as_buffer(), "<u2").astype(np.int64)] += np.frombuffer(more.as_buffer(), "<u8").astype(np.int64)
    at = np.flatnonzero(n)
    row = {"block": group.column("block")[0].as_py(), "part": group.column("part")[0].as_py(), "cells": at.astype("<u2").tobytes(), "n": n[at].astype("<u8").tobytes()}
    return pa.Table.from_pylist([row], schema=group.schema)


def crowded(sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of classes of different components that can be linked, by a set join with prefix, length and positional bounds.

    sets: (node, items); comps: (node, comp) of those in a component of more than one.
    Shingles stand in one order, by how full their cell is, then by hash.  The first
    common one of two linked sets stands among the first few of each, and enough
    of both must follow it.
    """
    spark, shift = sets.sparkSession, np.uint64(64 - int(np.log2(CELLS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column("items"):
                np.add.at(n, (np.frombuffer(x.as_buffer(), np.uint64) >> shift).astype(np.int64), 1)
        yield from packed(n, TaskContext.get().partitionId())

    counted = sets.select("items").mapInArrow(count, _PACKED)
    for by in (["block", "part"], ["block"]):
        counted = counted.groupBy(*by).applyInArrow(merged, _PACKED)
    often = np.ones(CELLS, np.int64)
    for r in counted.collect():  # CELLS numbers in all
        often[r.block * BLOCK + np.frombuffer(r.cells, "<u2").astype(np.int64)] = np.frombuffer(r.n, "<u8")
    shared = spark.sparkContext.broadcast(often)
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("first", pa.bool_())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for node, x in zip(batch.column("node").to_pylist(), batch.column("items"), strict=True):
                items = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(items)
                # Against a set that is not smaller, and against one that is.
                short, long = n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1
                items = items[np.lexsort((items, often[(items >> shift).astype(np.int64)]))[:long]]
                at = np.arange(long)
                yield pa.RecordBatch.from_arrays([pa.array(items.view(np.int64)), pa.array(np.full(long, node)), pa.array(np.full(long, n)), pa.array(at), pa.array(at < short)], schema=schema)

    rows = written(sets.select("node", "items").mapInArrow(prefixes, "token long, node long, n long, at long, first boolean").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "prefixes")
    # Only shingles of several components matter; of each, pairs within its largest component are not looked at.
    kinds = rows.groupBy("token", "comp").count().groupBy("token").agg(F.max_by("comp", "count").alias("most"), F.count("*").alias("kinds")).where("kinds > 1").select("token", "most")
    mixed_rows = rows.join(kinds, "token").withColumn("minor", F.col("comp") != F.col("most"))
    left = mixed_rows.where("first").select("token", F.when(F.col("minor"), 0).otherwise(1).alias("side"), *[F.col(c).alias(f"{c}_a") for c in ("node", "comp", "n", "at")])
    right = mixed_rows.select("token", F.explode(F.when(F.col("minor"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("side"), *[F.col(c).alias(f"{c}_b") for c in ("node", "comp", "n", "at")])
    x, y = F.col("n_a"), F.col("n_b")
    same = (left["token"] == right["token"]) & (left["side"] == right["side"]) & (F.col("comp_a") != F.col("comp_b"))
    same &= ((x < y) | ((x == y) & (F.col("node_a") < F.col("node_b")))) & (100 * x >= percent * y)
    same &= F.least(x - F.col("at_a"), y - F.col("at_b")) >= needed(percent, x, y)
    return left.join(right, same).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, items): the full sets of some classes."""
    need = written(nodes.join(classes.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "node"), "need")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(small(need), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))

    def sets(rows: dict[str, list]) -> dict[str, list]:
        return {"node": rows["node"], "items": [s.tobytes() for s in shingle_sets(rows["text"], k)]}

    return written(map_rows(texts.select("node", "text"), sets, pa.schema([("node", pa.int64()), ("items", pa.binary())]), "node long, items binary").dropDuplicates(["node"]), "sets")


def confirmed(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets."""
    both = pairs.join(items.toDF("a", "ia"), "a").join(items.toDF("b", "ib"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ia"), batch.column("ib"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ia", "ib").mapInArrow(run, "a long, b long")


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as links (u, v) of each node to the smallest that it reaches within the task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = [(x, r) for x in parent if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that links reach from it, for every node that has a link.

    Tasks of ``LINKS`` links each contract them first; where that takes more than
    one task, large and small stars in turn hang a node's neighbours on their
    smallest, until nothing changes, in rounds that grow with the logarithm of
    the longest chain.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    parts = -(-links.count() // LINKS) or 1
    edges = written(links.coalesce(parts).mapInArrow(contracted, "u long, v long"), "edges")
    was = state(edges) if parts > 1 else (0,)
    while was[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(both.where("v < u").groupBy("u").agg(F.min("v").alias("v")).select("u", "v")).distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = written(large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct(), "edges")
        now = state(edges)
        if now == was:
            break
        was = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)


def with_components(classes: DataFrame, comps: DataFrame) -> DataFrame:
    return classes.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Each document's group of near-duplicates.

    Returns doc_id, text_hash, n_shingles, component_id (the smallest doc_id in
    its group) and first (whether this is the row to keep of the group: that
    with the smallest doc_id, then text hash; repeated rows of it are all
    marked).  Without words, and with null text, a document has no shingles and
    is a group of its own.  Null doc_ids come last; a group of nothing but null
    doc_ids has a null component_id.  Other columns don't matter; an empty table
    gives no row.
    """
    described = written(describe(docs, k), "described")
    rows = described.drop("heads", "sig")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    named = described.where("set_hash is not null").groupBy("set_hash").agg(F.min(best).alias("rep"), F.first("heads").alias("heads"), F.first("sig").alias("sig"))
    classes = written(named.select("set_hash", F.monotonically_increasing_id().alias("node"), "rep", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"), "heads", "sig"), "classes")

    found = met(classes)
    full = written(found.where(F.col("size") > RUN).select("node").distinct(), "crowd")
    crowd = full.limit(1).count() > 0
    pairs = near(found, classes)
    if crowd:
        pairs = pairs.union(deeper(found, classes)).distinct()
    pairs = written(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    items = sets_of((nodes.union(full) if crowd else nodes).distinct(), classes, docs, k)
    links = written(confirmed(pairs, items, percent), "links")
    comps = components(links)
    if crowd:
        more = written(crowded(items.join(full, "node", "left_semi"), comps, percent), "candidates")
        comps = components(written(confirmed(more, items, percent), "links").union(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))

    named = written(with_components(classes.select("set_hash", "node", "rep"), comps), "named")
    top = named.groupBy("comp").agg(F.min("rep").alias("top"))
    grouped = written(named.join(top, "comp").select(F.col("set_hash").alias("_set"), F.col("top.doc_id").alias("component"), F.col("top.text_hash").alias("component_hash")), "grouped")
    return rows.join(grouped, F.col("set_hash") == F.col("_set"), "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        (F.col("set_hash").isNull() | (F.col("doc_id").eqNullSafe(F.col("component")) & (F.col("text_hash") == F.col("component_hash")))).alias("first"),
    )


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns whatever their names; of repeated rows of that document, one.

    Nulls, empty texts and empty tables are as in groups(): a document without words is kept.
    """
    found = written(groups(docs, k, percent), "groups")
    i, h = free(docs, "_id"), free(docs, "_hash")
    key = [F.col("doc_id").alias(i), F.col("text_hash").alias(h)]
    out = small(written(found.where("not first").select(*key).distinct(), "out"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(h))
    left = docs.join(out, same, "left_anti")
    again = written(found.where("first and n_shingles > 0").groupBy(*key).count().where("count > 1").drop("count"), "again")
    if not again.limit(1).count():
        return left
    again = small(again)
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").withColumn(h, F.xxhash64("text")).dropDuplicates(["doc_id", h]).drop(h))
