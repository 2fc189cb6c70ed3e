"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations alone.

A window of an item is a set of shingles with offsets.  All shingles of the
documents are looked up once among those of the windows; what is found is small
and kept.  Shingles are ordered by how often the documents have them: a window
can stand in a document only where its rarest shingle does, so that one is its
necessary prefix.  A candidate's start follows from the shingle's offset; it
must lie in the document (positional and length bounds), and then as many of the
window's shingles as together cover all its words must stand there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.common import free, lowered, small, written

#: Words of a shingle, fewer only for items of fewer words.
SHINGLE = 5
#: A document finds its own row under one of so many marks, which no word has in it, so that no mark has many rows.
MARK, MARKS = "\x01", 1024
#: Shingles of the windows are broadcast up to this many rows (some 50 bytes each); beyond it the lookup is a shuffled join.
BROADCAST_SHINGLES = 400_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _shingles(w: str, k: int) -> str:
    return f"transform(if(size({w}) < {k}, cast(array() as array<int>), sequence(1, size({w}) - {k} + 1)), i -> array_join(slice({w}, i, {k}), ' '))"


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows: words (joined), n (words in it) and the shingles' length k; with every item that has it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    n = f"least(size(w), {window})"
    return items.select("item", F.expr(n).alias("n"), F.explode(F.expr(f"transform(sequence(1, size(w) - {n} + 1), i -> array_join(slice(w, i, {n}), ' '))")).alias("window")).distinct().withColumn("k", F.least("n", F.lit(SHINGLE)))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), and the columns in keep.

    A null text has no words.  An item without words is never found; items
    that share an id are one, and a null id is the empty string.  Repeated
    documents are each judged alike; empty tables give no rows, or no hits.
    """
    keep = keep or []
    windows = written(windows_of(benchmark, window), "windows")
    distinct = windows.select("window", "n", "k").distinct()
    sizes = sorted(r.k for r in distinct.select("k").distinct().collect())  # at most SHINGLE numbers
    parts = distinct.withColumn("w", F.split("window", " "))
    pairs = parts.select("window", "n", F.posexplode(F.expr(f"transform(sequence(1, n - k + 1), i -> array_join(slice(w, i, k), ' '))")).alias("offset", "shingle"))
    marks = docs.sparkSession.range(MARKS).select(F.concat(F.lit(MARK), "id").alias("shingle"))
    wanted = pairs.select("shingle").distinct().union(marks)
    mark = F.concat(F.lit(MARK), F.pmod(F.xxhash64("_row"), F.lit(MARKS)).cast("string"))
    of = F.concat(F.array(mark), *[F.expr(_shingles("w", k)) for k in sizes])
    if len(sizes) > 1:
        # Places begin anew with each length of shingles.
        place = F.flatten(F.array(F.array(F.lit(0)), *[F.expr(f"if(size(w) < {k}, cast(array() as array<int>), sequence(1, size(w) - {k} + 1))") for k in sizes]))
        each = F.explode(F.arrays_zip(place.alias("at"), of.alias("shingle"))).alias("s")
        take = [F.col("s.at").alias("at"), F.col("s.shingle").alias("shingle")]
    else:
        each = F.posexplode(of).alias("at", "shingle")
        take = ["at", "shingle"]
    ids = ["_row", "doc_id", *keep, "n_words"]
    split = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", *keep, words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    found = written(split.select(*ids, each).select(*ids, *take).join(small(wanted, BROADCAST_SHINGLES), "shingle"), "shingles")

    marked = F.col("shingle").startswith(MARK)
    own = found.where(marked).select(*ids)
    at = found.where(~marked).select("_row", "n_words", "at", "shingle")
    often = at.groupBy("shingle").agg(F.count("*").alias("often"))
    rank = Window.partitionBy("window").orderBy("often", "shingle", "offset")
    prefix = written(pairs.join(often, "shingle").withColumn("r", F.row_number().over(rank)).where("r = 1").select("window", "n", "offset", "shingle"), "prefix")
    candidates = at.join(small(prefix, BROADCAST_SHINGLES), "shingle").withColumn("start", F.col("at") - F.col("offset")).where("start >= 1 and start + n - 1 <= n_words").select("_row", "window", "n", "start")
    spots = at.select("_row", "at", "shingle")
    # Shingles side by side, the last one moved back to end with the window.
    cover = range(-(-window // SHINGLE))
    offsets = {j: F.expr(f"least({j} * k, n - k)") for j in cover}
    checked = candidates.join(parts.select("window", *[o.alias(f"o{j}") for j, o in offsets.items()], *[F.expr(f"array_join(slice(w, least({j} * k, n - k) + 1, k), ' ')").alias(f"s{j}") for j in cover]), "window")
    for j in cover:
        checked = checked.withColumn("at", F.col("start") + F.col(f"o{j}")).join(spots.withColumnRenamed("shingle", f"s{j}"), ["_row", "at", f"s{j}"])
    places = written(checked.select("_row", "window", "n", "start"), "places")

    covered = (
        places.select("_row", F.struct("start", F.expr("cast(start + n as int)").alias("end")).alias("span"))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set("span")).alias("spans"))
        .select("_row", F.expr("aggregate(spans, named_struct('to', 0, 'sum', 0L), (a, s) -> named_struct('to', greatest(a.to, s.end), 'sum', a.sum + greatest(0, s.end - greatest(a.to, s.start)))).sum").alias("n_hit"))
    )
    named = places.select("_row", "window").distinct().join(windows.select("window", "item"), "window").groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per = covered.join(named, "_row")
    return own.join(per, "_row", "left").select(
        "doc_id", *keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without those in which hits() found a window, by doc_id; all rows of such a doc_id go, null ones alike; columns may have any names."""
    i = free(docs, "_id")
    bad = small(written(found.where("n_hit > 0").select(F.col("doc_id").alias(i)).distinct(), "contaminated"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(i)), "left_anti")
