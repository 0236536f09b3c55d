"""Velocity: bursts, day spikes, 24-hour outflow, new counterparties."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config.limits import OUTFLOW_FLOOR
from . import base as B
from .base import KEY


def big_enough(evidence: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Keep evidence of accounts that have at least ``least`` rows."""
    enough = B.counts(rows, "n").filter(F.col("n") >= least).select(KEY)
    return evidence.join(enough, KEY, "left_semi")


def velocity_bursts(clean: DataFrame, limits: DataFrame, hours: int = 2, k: int = 10) -> DataFrame:
    """First ten windows with too many rows; a reported window uses up its rows.

    Only the first row of an instant can open a window, so instants are enough.
    """
    width = hours * B.HOUR_US
    lim = limits.select(KEY, "burst_rows")
    least = lim.agg(F.min("burst_rows")).first()[0]  # one number
    rows = B.near_full_slots(clean, [KEY], width, F.lit(1), F.lit(least))
    busy = B.prune_slots(B.by_instant(rows, [KEY], F.abs("amount")), [KEY], width, "n", lim, F.col("burst_rows"))
    cand = B.forward_totals(busy, [KEY], width).join(lim, KEY).filter(F.col("n_w") >= F.col("burst_rows"))
    picks = big_enough(B.greedy_windows(cand, [KEY], width, k), clean, 5)
    return picks.select(KEY, "rank_in_account", B.stamp_us("t").alias("started_at"), F.col("t").alias("t"),
                        F.col("n_w").alias("transaction_count"), (F.col("s_w") / 100.0).alias("total_amount"))


def daily_spikes(clean: DataFrame, z: float = 3.0, factor: float = 4.0, floor: int = 15, k: int = 10) -> DataFrame:
    days = clean.groupBy(KEY, B.day().alias("day")).agg(
        F.count("*").alias("transaction_count"), B.total(F.abs("amount")).alias("total_amount"))
    w = Window.partitionBy(KEY)
    n, c = F.col("c_n"), F.col("transaction_count")
    days = days.select("*", F.count("*").over(w).alias("c_n"), F.sum(c).over(w).cast("double").alias("c_s"),
                       F.sum(c * c).over(w).cast("double").alias("c_q"))
    days = days.withColumn("avg_daily", B.mean_of("c")).withColumn("sd", B.std_samp("c"))
    days = days.filter((n >= 7) & (F.col("sd") > 0)).withColumn("z", (c - F.col("avg_daily")) / F.col("sd"))
    hot = days.filter((F.col("z") > z) & (c >= F.greatest(F.col("avg_daily") * factor, F.lit(float(floor)))))
    hot = hot.withColumn("z_score", B.py_round(F.col("z"), 2))
    top = B.topk(hot, [KEY], [F.desc("z_score"), "day"], k)
    return big_enough(top, clean, 5).select(
        KEY, "rank_in_account", "day", "transaction_count", "total_amount", "z_score",
        B.py_round(F.col("avg_daily"), 1).alias("avg_daily"))


def outflow_24h(clean: DataFrame, limits: DataFrame, share=None, k: int = 10) -> DataFrame:
    """First ten 24-hour windows whose outflow is large against monthly income."""
    months = clean.filter("amount > 0").groupBy(KEY, B.month().alias("m")).agg(F.sum("amount").alias("s"))
    seen = months.groupBy(KEY).agg((F.sum("s").cast("double") / F.count("*")).alias("_seen"))
    lim = limits.join(seen, KEY, "left").select(
        KEY, F.when(F.col("avg_monthly_income") > 0, F.col("avg_monthly_income")).otherwise(F.col("_seen")).alias("_income"),
        (F.lit(share) if share is not None else F.col("outflow_share")).alias("_share"))
    lim = lim.filter("_income > 0").withColumn("_limit", F.greatest(F.col("_income") * F.col("_share"), F.lit(float(OUTFLOW_FLOOR))))
    spent = B.by_instant(clean.filter("amount < 0"), [KEY], F.abs("amount"))
    heavy = B.prune_slots(spent, [KEY], B.DAY_US, "s", lim, F.col("_limit") * 99.999)  # cents, with room for rounding
    cand = B.forward_totals(heavy, [KEY], B.DAY_US).join(lim, KEY).filter((F.col("s_w") / 100.0) >= F.col("_limit"))
    picks = big_enough(B.greedy_windows(cand, [KEY], B.DAY_US, k), clean, 5).join(lim, KEY)
    return picks.select(KEY, "rank_in_account", B.stamp_us("t").alias("started_at"), (F.col("s_w") / 100.0).alias("amount_24h"),
                        ((F.col("s_w") / 100.0) / F.col("_income") * 100.0).alias("pct_of_monthly_income"))


def counterparty_churn(clean: DataFrame) -> DataFrame:
    """How fast new counterparties appear."""
    first = clean.withColumn("cp", B.cp_desc()).filter("cp <> ''").groupBy(KEY, "cp").agg(F.min("ts").alias("ts"))
    days = first.groupBy(KEY, B.day().alias("day")).agg(F.count("*").alias("new"))
    w = Window.partitionBy(KEY)
    days = days.withColumn("avg_new", F.sum("new").over(w).cast("double") / F.count("*").over(w))
    out = days.groupBy(KEY).agg(
        F.sum("new").alias("total_unique"), F.max("avg_new").alias("avg_new_per_day"), F.max("new").alias("max_new_per_day"),
        F.count(F.when(F.col("new") > F.greatest(F.col("avg_new") * 4, F.lit(5.0)), 1)).alias("high_churn_days"))
    return big_enough(out, clean, 5)


def velocity_score(accounts: DataFrame, bursts, spikes, outflow, churn) -> DataFrame:
    s = spikes.groupBy(KEY).agg(
        F.count(F.when(F.col("z_score") > 4.0, 1)).alias("extreme"),
        F.count(F.when((F.col("z_score") > 3.0) & (F.col("z_score") <= 4.0), 1)).alias("high"),
        F.count("*").alias("spikes"))
    d = B.left_all(accounts, B.counts(bursts, "bursts"), s, B.counts(outflow, "outflows"), churn.select(KEY, "high_churn_days"))
    score = (B.ladder(B.n0("bursts"), [(">=", 8, 30), (">=", 5, 15), (">=", 2, 5)])
             + B.ladder(B.n0("extreme"), [(">=", 3, 25), (">=", 1, 10)])
             + B.ladder(B.n0("high"), [(">=", 5, 15), (">=", 3, 8)])
             + B.ladder(B.n0("outflows"), [(">=", 5, 20), (">=", 3, 10), (">=", 1, 3)])
             + B.ladder(B.n0("high_churn_days"), [(">=", 5, 15), (">=", 2, 5)]))
    return d.select(KEY, B.n0("bursts").alias("bursts"), B.n0("spikes").alias("spikes"), B.n0("outflows").alias("outflows"),
                    F.least(score, F.lit(100)).cast("double").alias("score"))
