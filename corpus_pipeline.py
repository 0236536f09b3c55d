"""Cleaning pipeline for the documents table: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldoscope.llm import decontaminate, line_dedup, minhash, pieces, quality
from saldoscope.llm.base import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Similarity of word shingles from which documents are near copies, in hundredths.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more; learnt from the labelled documents here."""
    docs = docs.select(*COLUMNS)
    space = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, space, column="quality_score").where(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated passages are deleted; a document with nothing left goes."""
    docs = docs.select(*COLUMNS)
    out = line_dedup.deduplicate_lines(docs, drop_empty=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    docs = docs.select(*COLUMNS)
    out = minhash.near_duplicates(docs, percent=NEAR_PERCENT).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which benchmark windows cover a twentieth of the words or more."""
    docs = docs.select(*COLUMNS)
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.judge(hits).where(~F.col("contaminated")).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether they decode to it."""
    docs = docs.select(*COLUMNS)
    back = pieces.decode(pieces.encode(docs))
    return back.select("doc_id", "lang", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece", pieces_stage),
]

#: The first and the last stage have no counterpart in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
