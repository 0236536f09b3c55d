"""Sinks: analyses, transactions, subjects."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import base as B
from ..operators import scoring as R
from ..session import durable, exists


def analyses_rows(report: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Stored analysis per account: score, level, legacy score and the report document; with
    ``scored`` also a column for the score of each module, and how many schemes were found."""
    out = report.select(F.col("account_id").alias("analysis_id"), "composite_score", "risk_level", R.legacy_risk_score(F.col("composite_score")).alias("risk_score"), "report")
    if scored is None:
        return out
    return out.join(scored.select(F.col("account_id").alias("analysis_id"), "account_type", "patterns", *R.MODULES), "analysis_id")


BUCKETS = 256


def replace_by_id(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Put ``rows`` in place of the stored rows with the same ids; all other ids stay.

    The table is partitioned by a bucket of the id, whatever the number of ids; only buckets
    that hold a new id are written again. The rows are written to the shared folder first, so
    nothing is read from a folder while it is overwritten.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    new = durable(rows.withColumn("bucket", bucket))
    if exists(spark, path):
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).join(new.select(key).distinct(), key, "left_anti")
        new = durable(old.unionByName(new, allowMissingColumns=True))
    # rows of one id go to up to sixteen tasks, so a huge one is not written by one task
    dealt = new.repartition("bucket", F.pmod(F.hash(*[c for c in new.columns if c != "bucket"]), F.lit(16)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_analyses(report: DataFrame, path: str, scored: DataFrame | None = None) -> None:
    """Replace the analyses at hand and leave the others as they are."""
    replace_by_id(analyses_rows(report, scored), path, "analysis_id")


def write_txn(txn: DataFrame, path: str) -> None:
    """Replace the rows of the analyses at hand and leave the others as they are."""
    replace_by_id(txn.withColumn("analysis_id", F.col("account_id")), path, "analysis_id")


def subjects_of(txn: DataFrame) -> DataFrame:
    """One row per stored subject id of the counterparties."""
    names = txn.select(F.trim(B.cp_strict()).alias("name")).filter("name <> ''").distinct()
    d = names.withColumn("subject_type", N.subject_type("name")).withColumn("unique_identifier", N.unique_identifier("name"))
    return d.groupBy("unique_identifier", "subject_type").agg(F.min("name").alias("name"))


def upsert_subjects(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing rows stay; unknown ids are added once."""
    fresh = new.dropDuplicates(["unique_identifier"]).join(existing.select("unique_identifier"), "unique_identifier", "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def dedupe_subjects(rows: DataFrame) -> DataFrame:
    """Oldest row per id, as an aggregate so that many copies of one id do not meet in a sort."""
    rest = [c for c in rows.columns if c not in ("unique_identifier", "id")]
    g = rows.groupBy("unique_identifier").agg(F.min(F.struct("id", *rest)).alias("r"))
    return g.select("unique_identifier", "r.*")
