"""Lines that many documents share, dropped but for one document's.

Documents are exploded to their lines, a line is known by the hash of its
normal form, and distinct documents are counted for each hash.  What is dropped
comes back to a document as line numbers, so whole texts move once, beside
them, and a hash that is in most documents is never one task's load: counts are
taken by hash and document first, and joins send hot hashes to all tasks.

Nulls and edges: a null or empty text is one empty line; a null doc_id is a
document of its own id, smaller than all others; rows that share a doc_id are
one document when lines are counted, and each of them is returned; an empty
table gives no row; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import BROADCAST_ROWS, free, lowered, written

#: The six ASCII characters of white space.
_EDGE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line's normal form: white space stripped at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_EDGE))
    # lower() changes ASCII alone where there is nothing else, and is faster.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(lowered(bare))


def long_lines(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(who, of, at, h, g): each line of at least so many code points, its text's hash, its number, and 128 bits of hash of its normal form."""
    lines = docs.select(F.col(key).alias("who"), F.xxhash64(text).alias("of"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("at", "line"))
    lines = lines.where(F.char_length("line") >= least).withColumn("bare", line_key(F.col("line"))).where(F.char_length("bare") >= least)
    return lines.select("who", "of", "at", F.xxhash64("bare").alias("h"), F.xxhash64(F.lit(1), "bare").alias("g"))


def frequent(lines: DataFrame, documents: int) -> DataFrame:
    """(h, g, n, lines, holder): hashes found in at least so many distinct documents, how many lines have them, and the largest of the documents."""
    each = lines.groupBy("h", "g", "who").agg(F.count("*").alias("times"))
    counted = each.groupBy("h", "g").agg(F.count("*").alias("n"), F.sum("times").alias("lines"), F.max("who").alias("holder"))
    return counted.where(F.col("n") >= documents)


def _matched(lines: DataFrame, shared: DataFrame, most: int) -> DataFrame:
    """Lines whose hash is shared, with its holder.

    A table of at most ``most`` hashes is broadcast.  Of a larger one the
    hashes of so many lines that there can't be ``most`` of them are broadcast;
    each hash of the rest has fewer lines, and these are joined by a shuffle.
    """
    total = shared.agg(F.count("*"), F.sum("lines")).first()
    on = ["h", "g"]
    if total[0] <= most:
        return lines.join(F.broadcast(shared), on)
    hot = total[1] // most + 1
    often, rest = shared.where(F.col("lines") >= hot), shared.where(F.col("lines") < hot)
    some = lines.join(F.broadcast(often.select(*on)), on, "left_anti").join(rest, on)
    return lines.join(F.broadcast(often), on).unionByName(some)


def deduplicated(docs: DataFrame, least: int = 40, documents: int = 5, key: str = "doc_id", text: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """docs with the text that is left, and n_lines and n_dropped of the text before.

    A line is dropped if its normal form has at least ``least`` code points and
    is in at least ``documents`` documents, unless its document has the largest
    id of these.
    """
    lines = long_lines(docs, key, text, least)
    shared = written(frequent(lines, documents), "lines")
    found = _matched(lines, shared, most).where(~F.col("who").eqNullSafe(F.col("holder")))
    drops = found.groupBy("who", "of").agg(F.collect_set("at").alias("drops"))  # line numbers of one text
    who, of, own, gone, cut, n, lost = (free(docs, x) for x in ("_who", "_of", "_own", "_drops", "_lines", "n_lines", "n_dropped"))
    drops = drops.select(F.col("who").alias(who), F.col("of").alias(of), F.col("drops").alias(gone))
    split = docs.withColumns({own: F.xxhash64(text), cut: F.split(F.coalesce(text, F.lit("")), "\n", -1)})
    both = split.join(drops, F.col(key).eqNullSafe(F.col(who)) & (F.col(own) == F.col(of)), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.col(cut)).otherwise(F.transform(places, lambda i: F.col(cut)[i]))
    out = both.withColumns({n: F.size(cut).cast("long"), lost: F.coalesce(F.size(gone), F.lit(0)).cast("long"), text: F.array_join(kept, "\n")})
    return out.drop(who, of, own, gone, cut)
