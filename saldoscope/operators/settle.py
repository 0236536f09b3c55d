"""Order-dependent folds over long timelines, run slice by slice and in parallel."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop, durable

ANSWER_COLUMNS = ["account_id", "slice", "what", "t", "seq", "amount", "t2", "seq2", "amount2"]


def _schema(key_type) -> T.StructType:
    kinds = [key_type, T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.DoubleType(), T.LongType(), T.LongType(), T.DoubleType()]
    return T.StructType([T.StructField(n, k) for n, k in zip(ANSWER_COLUMNS, kinds)])


def settle(rows: DataFrame, keys, run) -> DataFrame:
    """Fold rows (key, slice, t, seq, amount) with a state that reaches into the next slice.

    ``run`` answers one (key, slice): rows marked ``done`` are results, rows marked ``open``
    are the state it leaves, filed under the next slice. Slices first run side by side from
    an empty state; then only slices whose incoming state differs from the one they assumed
    run again, until none is left. The result equals one pass in time order.
    """
    rows = durable(rows)
    schema = _schema(rows.schema[keys[0]].dataType)
    key = [*keys, "slice"]

    def answer(part: DataFrame) -> DataFrame:
        return durable(part.groupBy(*key).applyInPandas(run, schema))

    done, assumed = answer(rows), None
    while True:
        opened = done.filter("what = 'open'").select(*key, "t", "seq", "amount")
        told = opened.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.xxhash64("t", "seq").cast("decimal(38,0)")).alias("h"))
        if assumed is None:
            wrong = told.select(*key)
        else:
            same = F.col("n").eqNullSafe(F.col("pn")) & F.col("h").eqNullSafe(F.col("ph"))
            wrong = told.join(assumed, key, "full").filter(~same).select(*key)
        # a state matters only where rows follow it
        wrong = durable(wrong.join(rows.select(*key).distinct(), key, "left_semi"))
        if wrong.isEmpty():
            return done.filter("what = 'done'")
        redo = answer(rows.unionByName(opened).join(wrong, key, "left_semi"))
        home = F.when(F.col("what") == "open", F.col("slice") - 1).otherwise(F.col("slice"))
        keep = done.withColumn("home", home).join(wrong.withColumnRenamed("slice", "home"), [*keys, "home"], "left_anti").drop("home")
        before = [done, wrong, redo] + ([assumed] if assumed is not None else [])
        assumed, done = durable(told.withColumnRenamed("n", "pn").withColumnRenamed("h", "ph")), durable(keep.unionByName(redo))
        for table in before:  # their rows are in the new tables
            drop(table)
