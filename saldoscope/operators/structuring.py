"""Structuring: sums kept under the reporting threshold, split payments, smurfing."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import keywords as K
from ..config.limits import REPORTING_THRESHOLD, SIGNIFICANT_FLOOR
from ..session import durable
from . import base as B
from .base import KEY


#: Bounds of the tests: share of the threshold for one row and for a day's payments to one payee, least numbers of payments.
UNDER_SHARE, SPLIT_SHARE, SPLIT_ROWS, SMURF_ROWS = 0.95, 0.8, 3, 6


def structuring_limits(prof: DataFrame) -> DataFrame:
    """Reporting threshold and least significant amount, scaled by income."""
    inc = F.col("avg_monthly_income")
    base = F.lit(float(REPORTING_THRESHOLD))
    return prof.select(
        KEY, "account_type", inc.alias("avg_monthly_income"),
        F.when(F.col("account_type") == "salary_employee", base).otherwise(F.greatest(base, inc * 0.8)).alias("threshold"),
        F.greatest(F.lit(float(SIGNIFICANT_FLOOR)), inc * 0.1).alias("min_significant"))


def exclude_regular(txn: DataFrame) -> DataFrame:
    text = F.upper(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("counterparty", F.lit(""))))
    return txn.filter(~B.has_any(text, K.STRUCTURING_REGULAR))


def _cell(v):
    """Monotone value cells: single cents when tiny, then steps of five percent."""
    return F.when(v < 256, v).otherwise(F.lit(256) + F.floor(F.log(v / F.lit(256.0)) / F.lit(0.05))).cast("long")


def _box_hits(points: DataFrame, keys, boxes: DataFrame, length_us: int) -> DataFrame:
    """Boxes [t1, t1 + length) x [v1, v2] that hold at least one point, in near-linear time.

    A box spans two or more value cells, so a bound on one side decides each cell: the
    greatest value for the lowest cell, the least for the highest. Time is cut into blocks
    of the box length, so a box is the end of one block plus the start of the next, and two
    running extremes answer it. No pair of rows is ever formed.
    """
    t2 = F.col("t1") + F.lit(length_us - 1)
    ask = boxes.select(*keys, "t", "v", "v1", "v2", "t1", t2.alias("t2"), _cell(F.col("v1")).alias("c1"), _cell(F.col("v2")).alias("c2"))
    ask = ask.filter("c1 <= c2").withColumn("cell", F.explode(F.sequence("c1", "c2")))
    need = ask.select(*keys, "cell", "t", "v", F.when(F.col("cell") == F.col("c1"), F.col("v1")).alias("low"),
                      F.when(F.col("cell") == F.col("c2"), F.col("v2")).alias("high"),
                      F.explode(F.array(
                          F.struct(F.col("t1").alias("at"), F.lit(1).alias("kind")),
                          F.struct(F.col("t2").alias("at"), F.lit(2).alias("kind")))).alias("p"))
    need = need.select(*keys, "cell", "t", "v", "low", "high", "p.at", "p.kind", F.lit(None).cast("long").alias("pv"))
    have = points.select(*keys, _cell(F.col("v")).alias("cell"), "t", "v", F.lit(None).cast("long").alias("low"),
                         F.lit(None).cast("long").alias("high"), F.col("t").alias("at"), F.lit(0).alias("kind"), F.col("v").alias("pv"))
    line = have.unionByName(need).withColumn("block", F.floor(F.col("at") / F.lit(length_us)))
    part = [*keys, "cell", "block"]
    ahead = Window.partitionBy(*part).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*part).orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    line = line.select("*", F.max("pv").over(ahead).alias("mx2"), F.min("pv").over(ahead).alias("mn2"),
                       F.max("pv").over(back).alias("mx1"), F.min("pv").over(back).alias("mn1"))
    mx = F.when(F.col("kind") == 1, F.col("mx1")).otherwise(F.col("mx2"))
    mn = F.when(F.col("kind") == 1, F.col("mn1")).otherwise(F.col("mn2"))
    ok = mx.isNotNull() & (F.col("low").isNull() | (mx >= F.col("low"))) & (F.col("high").isNull() | (mn <= F.col("high")))
    # a box inside one cell (single cents) is bounded on both sides by that one value
    return line.filter((F.col("kind") > 0) & ok).select(*keys, "t", "v").distinct()


def _near_a_repeat(points: DataFrame, keys, lo: int, hi: int) -> DataFrame:
    """Points of days that have a day ``lo`` to ``hi`` days off whose amounts come within three percent.

    A key is first looked at as a line of days with the least and the greatest amount, so a
    window holds a dozen rows at most. Days without such a partner hold no repeats.
    """
    d = points.withColumn("_day", F.floor(F.col("t") / F.lit(B.DAY_US)))
    days = d.groupBy(*keys, "_day").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    along = Window.partitionBy(*keys).orderBy("_day")
    later, earlier = along.rangeBetween(lo, hi + 1), along.rangeBetween(-hi - 1, -lo)
    least, most = F.col("_lo"), F.col("_hi")
    # a cent of room: the bounds of the boxes are rounded quotients
    after = (F.max("_hi").over(later) * 100 + 100 >= least * 97) & (F.min("_lo").over(later) * 100 <= most * 103 + 100)
    before = (F.max("_hi").over(earlier) * 103 + 103 >= least * 100) & (F.min("_lo").over(earlier) * 97 <= most * 100 + 97)
    live = days.select(*keys, "_day", (F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))).alias("_live")).where("_live")
    return d.join(live.select(*keys, "_day"), [*keys, "_day"], "left_semi").drop("_day")


def recurring_points(txn: DataFrame, lo: int = 25, hi: int = 35) -> DataFrame:
    """(counterparty, amount, instant) that repeats a month apart within three percent."""
    pts = txn.withColumn("cp", F.trim(B.cp_desc())).filter("cp <> '' and amount <> 0")
    pts = pts.select(KEY, "cp", B.us().alias("t"), (F.abs("amount") * 100).cast("long").alias("v"))
    length = (hi - lo + 1) * B.DAY_US
    keys = [KEY, "cp"]
    span = F.max("t") - F.min("t")
    twice = durable(pts.groupBy(*keys).agg(span.alias("span")).filter(F.col("span") >= lo * B.DAY_US).select(*keys))
    pts = durable(pts.join(twice, keys, "left_semi"))
    pts = durable(_near_a_repeat(pts, keys, lo, hi).distinct())
    v = F.col("v")
    later = pts.select(*keys, "t", "v", (F.col("t") + F.lit(lo * B.DAY_US)).alias("t1"),
                       F.ceil(v * 97 / 100).alias("v1"), F.floor(v * 103 / 100).alias("v2"))
    earlier = pts.select(*keys, "t", "v", (F.col("t") - F.lit((hi + 1) * B.DAY_US - 1)).alias("t1"),
                         F.ceil(v * 100 / 103).alias("v1"), F.floor(v * 100 / 97).alias("v2"))
    return _box_hits(pts, keys, later.unionByName(earlier), length)


def reachable(rows: DataFrame) -> DataFrame:
    """Rows that one of the tests below can report, whatever the limits of the account.

    No account has a threshold or a significant amount below the fixed ones, and leaving out monthly repeats
    only makes days and amounts smaller. So a row counts if it comes near the threshold by itself,
    lies on a day whose payments come near it, or has a rounded amount that was sent often enough.
    """
    a = F.abs("amount")
    out, day, rounded = F.col("amount") < 0, F.to_date("ts"), F.bround(a, -2)
    days = rows.filter(out).groupBy(KEY, day.alias("_d")).agg(F.count("*").alias("n"), B.total(a).alias("s"))
    days = durable(days.filter((F.col("n") >= SPLIT_ROWS) & (F.col("s") >= REPORTING_THRESHOLD * SPLIT_SHARE)).select(KEY, "_d", F.lit(True).alias("_split")))
    sent = rows.filter(out & (rounded.cast("double") >= SIGNIFICANT_FLOOR)).groupBy(KEY, rounded.alias("_r")).agg(F.count("*").alias("n"))
    sent = durable(sent.filter(F.col("n") >= SMURF_ROWS).select(KEY, "_r", F.lit(True).alias("_smurf")))
    d = rows.withColumn("_d", day).withColumn("_r", rounded).join(days, [KEY, "_d"], "left").join(sent, [KEY, "_r"], "left")
    near = B.dbl(a) >= REPORTING_THRESHOLD * UNDER_SHARE
    return d.filter(near | (out & (F.col("_split").isNotNull() | F.col("_smurf").isNotNull()))).drop("_d", "_r", "_split", "_smurf")


def structuring_rows(clean: DataFrame) -> DataFrame:
    """Rows the structuring tests can report: no regular words, no monthly repeats."""
    every = durable(exclude_regular(clean)).withColumn("cp", F.trim(B.cp_desc()))  # read several times; words are looked up once
    rows = durable(reachable(every).withColumn("t", B.us()).withColumn("v", (F.abs("amount") * 100).cast("long")))
    payees = durable(rows.select(KEY, "cp").distinct())
    # written first, so that its true size decides whether the rows must be shuffled to meet it
    repeats = durable(recurring_points(every.join(payees, [KEY, "cp"], "left_semi")))
    kept = rows.join(repeats, [KEY, "cp", "t", "v"], "left_anti")
    return kept.drop("cp", "t", "v")


def just_under(rows: DataFrame, lim: DataFrame, share: float = UNDER_SHARE) -> DataFrame:
    a = F.abs(B.dbl("amount"))
    t = F.col("threshold")
    hit = rows.join(lim, KEY).filter((a >= t * share) & (a < t))
    return hit.select(KEY, "seq", B.stamp().alias("at_time"), a.alias("amount"), t.alias("threshold"),
                      B.py_round(a / t * 100.0, 1).alias("pct_of_threshold"), B.cp_desc().alias("counterparty"))


def split_groups(rows: DataFrame, lim: DataFrame, k: int = 10) -> DataFrame:
    """Same payee, same day, three or more payments adding up to most of the threshold."""
    g = rows.filter("amount < 0").groupBy(KEY, B.cp_desc().alias("counterparty"), B.day().alias("day")).agg(
        F.count("*").alias("transaction_count"), B.total(F.abs("amount")).alias("total_amount"))
    g = g.filter(F.col("transaction_count") >= SPLIT_ROWS).join(lim.select(KEY, "threshold"), KEY)
    g = g.filter(F.col("total_amount") >= F.col("threshold") * SPLIT_SHARE)
    g = B.topk(g, [KEY], [F.desc("total_amount"), "day", "counterparty"], k)
    return g.select(KEY, "rank_in_account", "counterparty", "day", "transaction_count", "total_amount",
                    (F.col("total_amount") >= F.col("threshold")).alias("exceeds_threshold"))


def split_members(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The payments behind each split group, one row each."""
    out = rows.filter("amount < 0").withColumn("counterparty", B.cp_desc()).withColumn("day", B.day())
    out = out.join(groups.select(KEY, "counterparty", "day", "rank_in_account"), [KEY, "counterparty", "day"])
    return out.select(KEY, "rank_in_account", "seq", F.abs(B.dbl("amount")).alias("amount"))


def smurfing(rows: DataFrame, lim: DataFrame, least: int = SMURF_ROWS, k: int = 5) -> DataFrame:
    """One rounded amount sent to many different payees."""
    out = rows.filter("amount < 0").withColumn("rounded", F.bround(F.abs("amount"), -2).cast("double"))
    per = out.groupBy(KEY, "rounded", B.cp_desc().alias("cp")).agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    g = per.groupBy(KEY, "rounded").agg(
        F.sum("n").alias("occurrence_count"), F.count("*").alias("unique_counterparties"),
        F.floor((B.us(F.max("last")) - B.us(F.min("first"))) / F.lit(B.DAY_US)).alias("date_span_days"))
    g = g.join(lim.select(KEY, "min_significant"), KEY).filter(
        (F.col("rounded") >= F.col("min_significant")) & (F.col("occurrence_count") >= least) & (F.col("unique_counterparties") >= least))
    g = g.withColumn("total_amount", F.col("rounded") * F.col("occurrence_count"))
    g = B.topk(g, [KEY], [F.desc("total_amount"), "rounded"], k)
    return g.select(KEY, "rank_in_account", F.col("rounded").alias("amount"), "occurrence_count",
                    "unique_counterparties", "date_span_days", "total_amount")


def structuring_score(accounts: DataFrame, clean: DataFrame, under, splits, smurfs) -> DataFrame:
    d = B.left_all(accounts, B.counts(under, "under"), B.counts(splits, "splits"), B.counts(smurfs, "smurfs"), B.counts(clean, "rows"))
    score = (F.least(F.lit(30), B.n0("under") * 10) + F.least(F.lit(40), B.n0("splits") * 15) + F.least(F.lit(30), B.n0("smurfs") * 15))
    score = F.when(B.n0("rows") >= 5, F.least(F.lit(70), score)).otherwise(0)
    return d.select(KEY, B.n0("under").alias("under"), B.n0("splits").alias("splits"), B.n0("smurfs").alias("smurfs"),
                    score.cast("double").alias("score"))
