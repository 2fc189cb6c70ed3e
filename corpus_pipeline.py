"""A corpus pipeline: quality rules, toxicity, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import decontaminate, neardup, packing, quality, toxicity
from skysift.llm.common import passing, table
from skysift.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule.  They are judged row by row, with their columns beside the measures.

    A null or empty text fails the plain rule; repeated rows stay or go together; an empty table stays empty.
    """
    judged = quality.verdicts(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), keep=["text", "source", "n_chars"])
    return judged.where("kept").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold.

    A null or empty text has a score too; repeated rows stay or go together; an empty table stays empty, and without
    labels all have one score, which no threshold rejects.
    """
    classifier = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), classifier).where("not toxic").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingles and a similarity of 0.8.

    A text without words stays; of repeated rows of the document that stays, one does.
    """
    return neardup.deduplicated(docs.select(*COLUMNS), k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item.

    A null text has none; all rows of a doc_id go if one of them has one; an empty benchmark rejects nothing.
    """
    marked = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"), window=10)
    return decontaminate.clean(docs.select(*COLUMNS), marked)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens.

    A null or empty text is its end alone; repeated rows are packed each on its own.
    """
    packed = packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The learned and hashed stages have no SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark) as keep:  # what a stage wrote for itself goes with it
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
