"""Night payments, duplicates, round amounts, profile mismatch, behaviour."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import keywords as K
from ..config.limits import DUPLICATE_FLOOR, NIGHT_FLOOR, ROUND_FLOOR
from ..session import durable
from . import base as B
from .base import KEY
from .velocity import big_enough



def _a():
    return F.abs("amount")


def _out():
    return F.col("amount") < 0


def _text():
    return F.upper(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("counterparty", F.lit(""))))


# ---- night
def time_data(clean: DataFrame) -> DataFrame:
    """Accounts where half or more of the rows sit at midnight carry dates only."""
    midnight = (F.hour("ts") == 0) & (F.minute("ts") == 0) & (F.second("ts") == 0)
    s = clean.groupBy(KEY).agg(F.count("*").alias("rows"), F.count(F.when(midnight, 1)).alias("midnight"))
    return s.withColumn("has_time", F.col("midnight") / F.col("rows") < 0.5)


def night_rows(clean: DataFrame, times: DataFrame) -> DataFrame:
    hour = F.hour("ts")
    rows = clean.filter(((hour >= 23) | (hour < 6)) & (F.col("amount") <= 0) & ~B.has_any(_text(), K.AUTOPAY))
    return rows.join(times.filter("has_time and rows >= 5").select(KEY), KEY, "left_semi")


def night_summary(night: DataFrame, times: DataFrame) -> DataFrame:
    s = night.groupBy(KEY).agg(F.count("*").alias("night_count"), B.total(_a()).alias("night_total_amount"))
    return s.join(times.select(KEY, "rows"), KEY).withColumn("night_ratio", F.col("night_count") / F.col("rows")).drop("rows")


def large_night(night: DataFrame) -> DataFrame:
    return night.filter(_out() & (_a() >= NIGHT_FLOOR)).select(
        KEY, "seq", B.stamp().alias("at_time"), F.hour("ts").alias("hour"), B.dbl(_a()).alias("amount"),
        F.coalesce(B.blank_to_null("counterparty"), F.lit("неизвестен")).alias("counterparty"))


def night_clusters(night: DataFrame, gap_us: int = 2 * B.HOUR_US) -> DataFrame:
    """Runs of night rows with gaps up to two hours. _a() day lies between two nights, so the
    night itself is the partition and no run crosses it."""
    inst = night.groupBy(KEY, F.to_date(F.col("ts") + F.expr("interval 1 hour")).alias("night"), B.us().alias("t")).agg(
        F.count("*").alias("n"), F.sum(_a()).alias("s"))
    w = Window.partitionBy(KEY, "night").orderBy("t")
    fresh = F.col("t") - F.lag("t").over(w) > gap_us
    inst = inst.withColumn("_new", F.coalesce(fresh.cast("int"), F.lit(1)))
    inst = inst.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = inst.groupBy(KEY, "night", "run").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.sum("n").alias("n"), F.sum("s").cast("double").alias("total_amount"))
    return g.filter("n >= 2").select(KEY, B.stamp_us("a").alias("started_at"), B.stamp_us("b").alias("ended_at"), "n", "total_amount")


def night_score(accounts, summary, large, clusters) -> DataFrame:
    l = large.groupBy(KEY).agg(F.count("*").alias("large"), F.count(F.when(F.col("amount") >= 1000000, 1)).alias("million"))
    c = clusters.groupBy(KEY).agg(F.max("n").alias("longest"), F.count("*").alias("clusters"))
    d = B.left_all(accounts, summary, l, c)
    score = (B.ladder(B.n0("night_ratio"), [(">", 0.5, 20), (">", 0.3, 10)]) + B.ladder(B.n0("large"), [(">=", 5, 25), (">=", 3, 15), (">=", 1, 5)])
             + B.ladder(B.n0("longest"), [(">=", 5, 25), (">=", 3, 15)]) + F.least(F.lit(30), B.n0("million") * 15))
    return d.select(KEY, B.n0("night_count").alias("night_count"), B.n0("large").alias("large"), B.n0("clusters").alias("clusters"),
                    F.least(F.lit(100), score).cast("double").alias("score"))


# ---- duplicates
def dup_candidates(clean: DataFrame) -> DataFrame:
    desc = F.upper(F.coalesce("description", F.lit("")))
    rows = clean.filter(_out() & (_a() >= DUPLICATE_FLOOR) & ~B.has_any(desc, K.DUPLICATE_REGULAR))
    return rows.select(KEY, "seq", "ts", _a().alias("amount"), B.cp_dup().alias("cp"))


def recurring_keys(cand: DataFrame, least: int = 2) -> DataFrame:
    """(payee, amount) paid about monthly: at least half of the gaps are 25 to 35 days.

    Repeats at one instant are gaps of zero days, so instants with counts are enough; gaps
    along a key use the carry between slices.
    """
    keys = [KEY, "cp", "amount"]
    inst = cand.groupBy(*keys, B.us("ts").alias("t")).agg(F.count("*").alias("n"))
    gaps = with_gaps(inst, keys).groupBy(*keys).agg(
        (F.sum("n") - 1).alias("gaps"),
        F.count(F.when(F.abs(F.floor(F.col("gap") / F.lit(B.DAY_US)) - 30) <= 5, 1)).alias("monthly"))
    return gaps.filter((F.col("gaps") >= least) & (F.col("monthly") / F.col("gaps") >= 0.5))


def with_gaps(inst: DataFrame, keys, slice_us: int = 90 * B.DAY_US) -> DataFrame:
    """Time since the instant before, along each key, computed slice by slice."""
    inst = inst.withColumn("_slice", F.floor(F.col("t") / F.lit(slice_us)))
    part = [*keys, "_slice"]
    along = Window.partitionBy(*keys).orderBy("_slice")
    ends = inst.groupBy(*part).agg(F.max("t").alias("_end")).select(*part, F.lag("_end").over(along).alias("_prev"))
    inside = Window.partitionBy(*part).orderBy("t")
    prev = F.coalesce(F.lag("t").over(inside), F.col("_prev"))
    return inst.join(ends, part).withColumn("gap", F.col("t") - prev).drop("_slice", "_prev")


def exact_duplicates(cand: DataFrame, hours: int = 24, least: int = 3) -> DataFrame:
    """First run of three or more equal payments to one payee inside 24 hours.

    Only payments made often enough are looked at for monthly repeats and runs; they are written
    first, so that their true size decides how they meet.
    """
    keys = [KEY, "cp", "amount"]
    many = durable(cand.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(*keys))
    rows = durable(cand.join(many, keys, "left_semi"))
    rows = rows.join(recurring_keys(rows), keys, "left_anti")
    inst = rows.groupBy(*keys, B.us("ts").alias("t")).agg(F.count("*").alias("n"), F.sum(F.lit(0)).alias("s"))
    fw = B.forward_totals(inst, keys, hours * B.HOUR_US, 30 * B.DAY_US).filter(F.col("n_w") >= least)
    first = fw.groupBy(*keys).agg(F.min("t").alias("t"), F.min_by("n_w", "t").alias("n"))
    a = B.dbl("amount")
    return first.select(KEY, F.col("cp").alias("counterparty"), a.alias("amount"), F.col("n").alias("n"), (a * (F.col("n") - 1)).alias("duplicate_amount"),
                        B.stamp_us("t").alias("started_at"))


def amount_broadcast(cand: DataFrame, hours: int = 48, least: int = 5) -> DataFrame:
    """One amount sent to five or more payees, all within 48 hours.

    Payees are told apart only for amounts that were paid often enough and within the time.
    """
    whole = cand.groupBy(KEY, "amount").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    short = durable(whole.filter((F.col("n") >= least) & (B.us("b") - B.us("a") <= hours * B.HOUR_US)).select(KEY, "amount"))
    per = B.having(cand, short, [KEY, "amount"]).groupBy(KEY, "amount", "cp").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    g = per.groupBy(KEY, "amount").agg(F.count("*").alias("recipient_count"), F.sum("n").alias("total_count"), F.min("a").alias("a"), F.max("b").alias("b"))
    span = B.us("b") - B.us("a")
    return g.filter((F.col("recipient_count") >= least) & (span <= hours * B.HOUR_US)).select(
        KEY, B.dbl("amount").alias("amount"), "recipient_count", "total_count", B.py_round(span / float(B.HOUR_US), 1).alias("time_span_hours"))


def duplicate_score(accounts, groups, casts) -> DataFrame:
    g = groups.groupBy(KEY).agg(
        F.sum(F.lit(20) + F.when(F.col("amount") >= 500000, 10).when(F.col("amount") >= 100000, 5).otherwise(0)).alias("p"),
        F.sum(F.col("n") - 1).alias("duplicates"), F.sum(F.col("duplicate_amount").cast("decimal(38,2)")).cast("double").alias("duplicate_amount"))
    c = casts.groupBy(KEY).agg(F.sum(F.when(F.col("recipient_count") >= 10, 35).otherwise(20)).alias("q"), F.count("*").alias("broadcasts"))
    d = B.left_all(accounts, g, c)
    return d.select(KEY, B.n0("duplicates").alias("duplicates"), F.coalesce("duplicate_amount", F.lit(0.0)).alias("duplicate_amount"),
                    B.n0("broadcasts").alias("broadcasts"), F.least(F.lit(100), B.n0("p") + B.n0("q")).cast("double").alias("score"))


# ---- round amounts
def roundness(a):
    return (F.when(a < ROUND_FLOOR, 0).when(a % 100000 == 0, 3).when(a % 50000 == 0, 2).when(a % 10000 == 0, 1).otherwise(0))


def amount_bucket(a):
    return (F.when(a >= 10000000, "10M+").when(a >= 5000000, "5M-10M").when(a >= 1000000, "1M-5M")
            .when(a >= 500000, "500K-1M").when(a >= 100000, "100K-500K").otherwise("50K-100K"))


def round_relevant(clean: DataFrame) -> DataFrame:
    flags = F.col("is_salary") | F.col("is_pension_benefit") | F.col("is_deposit_operation") | F.col("is_atm") | F.col("is_cash_operation")
    rows = clean.filter(_out() & (_a() >= ROUND_FLOOR) & ~flags & ~F.col("type").isin("expense", "fee") & ~B.has_any(_text(), K.ROUND_REGULAR))
    return rows.select(KEY, "seq", "ts", _a().alias("amount"), roundness(_a()).alias("roundness_level"))


def round_rows(relevant: DataFrame, clean: DataFrame) -> DataFrame:
    out = big_enough(big_enough(relevant, relevant, 3), clean, 5)
    return out


def amount_distribution(rows: DataFrame) -> DataFrame:
    return rows.filter("roundness_level > 0").groupBy(KEY, amount_bucket(F.col("amount")).alias("bucket")).agg(F.count("*").alias("n"))


def consecutive_rounds(rows: DataFrame, least: int = 3) -> DataFrame:
    """Runs of round payments in a row. _a() row that is not round starts the next run number,
    so the number is a running total, taken slice by slice."""
    d = rows.withColumn("t", B.us())
    d = B.sliced_cumsum(d, [KEY], "t", ["t", "seq"], {"run": F.when(F.col("roundness_level") < 2, 1).otherwise(0)})
    g = d.filter("roundness_level >= 2").groupBy(KEY, "run").agg(
        F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))
    return g.filter(F.col("n") >= least).select(KEY, B.stamp_us("a").alias("started_at"), B.stamp_us("b").alias("ended_at"), "n", "total")


def round_score(accounts, rows, runs) -> DataFrame:
    lv = F.col("roundness_level")
    s = rows.groupBy(KEY).agg(
        F.count("*").alias("relevant"), F.count(F.when(lv > 0, 1)).alias("round_count"), B.total(F.when(lv > 0, F.col("amount"))).alias("round_total"),
        F.count(F.when((lv > 0) & (F.col("amount") >= 1000000), 1)).alias("million"), F.count(F.when(lv == 3, 1)).alias("perfect"))
    r = runs.groupBy(KEY).agg(F.max("n").alias("longest"), F.count("*").alias("runs"))
    d = B.left_all(accounts, s, r)
    ratio = F.when(B.n0("relevant") > 0, F.col("round_count") / F.col("relevant")).otherwise(0.0)
    score = (B.ladder(ratio, [(">", 0.85, 20), (">", 0.75, 12), (">", 0.60, 5)]) + B.ladder(B.n0("million"), [(">=", 5, 20), (">=", 3, 10)])
             + B.ladder(B.n0("perfect"), [(">=", 10, 15), (">=", 5, 8)]) + B.ladder(B.n0("longest"), [(">=", 7, 15), (">=", 5, 8)]))
    return d.select(KEY, B.n0("round_count").alias("round_count"), ratio.alias("round_ratio"), F.coalesce("round_total", F.lit(0.0)).alias("round_total"),
                    B.n0("runs").alias("runs"), F.least(F.lit(60), score).cast("double").alias("score"))


# ---- profile mismatch
def oversized(clean: DataFrame, limits: DataFrame) -> DataFrame:
    inc = F.col("avg_monthly_income")
    lim = limits.select(KEY, F.when(inc > 0, F.least(F.col("single_cap").cast("double"), inc * 3)).otherwise(F.col("single_cap").cast("double")).alias("threshold"))
    a = B.dbl(_a())
    return clean.join(lim, KEY).filter(a > F.col("threshold")).select(
        KEY, "seq", B.dbl("amount").alias("amount"), "threshold", B.py_round(a / F.col("threshold"), 2).alias("excess_ratio"))


def unexpected_activity(clean: DataFrame, limits: DataFrame) -> DataFrame:
    kind, a, t = F.col("account_type"), B.dbl(_a()), F.col("type")
    inc = F.col("avg_monthly_income")
    d = clean.join(limits.select(KEY, "account_type", "avg_monthly_income"), KEY)
    reason = (F.when((kind == "pensioner") & t.isin("crypto_buy", "crypto_sell"), "Крипто-операция от пенсионера")
              .when((kind == "pensioner") & (F.col("counterparty_type") == "atm") & (a >= 500000), "Крупное снятие наличных пенсионером")
              .when((kind == "student") & (a >= 500000) & (t == "transfer_out"), "Крупный исходящий перевод от студента")
              .when((kind == "student") & (t == "crypto_buy") & (a >= 200000), "Студент покупает крипту на крупную сумму")
              .when((kind == "salary_employee") & t.isin("crypto_buy", "crypto_sell") & (a >= 500000), "Крупная крипто-операция от зарплатника")
              .when(F.col("is_atm") & (a >= F.greatest(F.lit(500000.0), inc * 0.7)) & ~kind.isin("business_owner", "freelancer"),
                    "Крупное снятие наличных через банкомат"))
    return d.withColumn("reason", reason).filter("reason is not null").select(KEY, "seq", B.dbl("amount").alias("amount"), "reason")


def income_anomalies(clean: DataFrame, limits: DataFrame) -> DataFrame:
    inc = F.col("avg_monthly_income")
    d = clean.filter("amount > 0 and not is_salary and not is_pension_benefit").join(limits.select(KEY, "avg_monthly_income"), KEY)
    return d.filter((inc > 0) & (B.dbl("amount") > inc * 2)).select(
        KEY, "seq", B.dbl("amount").alias("amount"), B.py_round(B.dbl("amount") / inc, 2).alias("excess_ratio"))


def mismatch_list(big, odd, extra, k: int = 5) -> DataFrame:
    parts = [("oversized", big, [F.desc(F.abs("amount")), "seq"]), ("unexpected", odd, ["seq"]), ("income_anomaly", extra, [F.desc("amount"), "seq"])]
    out = None
    for kind, df, order in parts:
        p = B.topk(df, [KEY], order, k).select(KEY, F.lit(kind).alias("kind"), "rank_in_account", "seq", "amount")
        out = p if out is None else out.unionByName(p)
    return out


def mismatch_score(accounts, big, odd, extra) -> DataFrame:
    b = big.groupBy(KEY).agg(F.max("excess_ratio").alias("worst"), F.count("*").alias("oversized"))
    d = B.left_all(accounts, b, B.counts(odd, "unexpected"), B.counts(extra, "income_anomalies"))
    score = (B.ladder(B.n0("worst"), [(">=", 10, 35), (">=", 5, 25), (">=", 3, 15)]) + B.ladder(B.n0("oversized"), [(">=", 5, 15), (">=", 3, 10)])
             + F.least(F.lit(25), B.n0("unexpected") * 8) + F.least(F.lit(20), B.n0("income_anomalies") * 10))
    return d.select(KEY, *[B.n0(c).alias(c) for c in ("oversized", "unexpected", "income_anomalies")], F.least(F.lit(100), score).cast("double").alias("score"))


# ---- behaviour (weight zero in the composite, reported all the same)
def weekday_baseline(clean: DataFrame) -> DataFrame:
    """Mean spend per weekday, all seven, zero where nothing was spent."""
    g = clean.groupBy(KEY).agg(*[x for i in range(7) for x in (
        F.sum(F.when(_out() & (F.weekday("ts") == i), _a())).cast("double").alias(f"s{i}"), F.count(F.when(_out() & (F.weekday("ts") == i), 1)).alias(f"n{i}"))])
    days = F.array(*[F.struct(F.lit(i).alias("day_index"), F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")).otherwise(0.0).alias("mean_spend")) for i in range(7)])
    return g.select(KEY, F.explode(days).alias("d")).select(KEY, "d.day_index", "d.mean_spend")


def spending_trend(clean: DataFrame, limits: DataFrame) -> DataFrame:
    m = clean.filter(_out()).groupBy(KEY, B.month().alias("m")).agg(F.sum(_a()).alias("v"))
    w = Window.partitionBy(KEY)
    m = m.withColumn("i", F.row_number().over(w.orderBy("m"))).withColumn("c", F.count("*").over(w))
    first = F.col("i") <= F.floor(F.col("c") / 2)
    g = m.groupBy(KEY).agg(*B.moments("v", "v"), F.sum(F.when(first, F.col("v"))).cast("double").alias("s1"), F.count(F.when(first, 1)).alias("n1"),
                           F.sum(F.when(~first, F.col("v"))).cast("double").alias("s2"), F.count(F.when(~first, 1)).alias("n2"))
    g = g.join(limits.select(KEY, "volatile_cv"), KEY)
    one, two = F.col("s1") / F.col("n1"), F.col("s2") / F.col("n2")
    trend = (F.when(F.col("v_n") < 3, "insufficient_data").when(B.std_pop("v") / B.mean_of("v") > F.col("volatile_cv"), "volatile")
             .when(two > one * 1.3, "increasing").when(two < one * 0.7, "decreasing").otherwise("stable"))
    return g.select(KEY, trend.alias("trend"))


def category_anomalies(clean: DataFrame, z: float = 3.0, k: int = 10) -> DataFrame:
    rows = clean.filter(_out() & (F.col("category") != ""))
    stats = rows.groupBy(KEY, "category").agg(*B.moments("a", _a()), F.min(_a()).alias("lo"), F.max(_a()).alias("hi"))
    stats = stats.filter("a_n >= 3 and hi > lo").select(KEY, "category", B.mean_of("a").alias("category_mean"), B.std_pop("a").alias("sd"))
    hot = rows.join(stats, [KEY, "category"]).withColumn("zz", (B.dbl(_a()) - F.col("category_mean")) / F.col("sd")).filter(F.col("zz") > z)
    hot = hot.withColumn("z_score", B.py_round(F.col("zz"), 2))
    return B.topk(hot, [KEY], [F.desc("z_score"), "ts", "seq"], k).select(KEY, "rank_in_account", "seq", "category", B.dbl(_a()).alias("amount"), "z_score", "category_mean")


def behavioral_score(accounts, trend, odd) -> DataFrame:
    d = B.left_all(accounts, trend, B.counts(odd, "n"))
    score = F.when(F.col("trend") == "volatile", 20).when(F.col("trend") == "increasing", 10).otherwise(0) + F.least(F.lit(30), B.n0("n") * 10)
    return d.select(KEY, F.coalesce("trend", F.lit("insufficient_data")).alias("trend"), B.n0("n").alias("category_anomalies"), score.cast("double").alias("score"))
