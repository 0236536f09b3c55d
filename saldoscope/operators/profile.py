"""Account profile, account type and the whitelist of everyday payments."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import keywords as K
from ..session import durable
from . import base as B
from .base import KEY


def income_regularity(txn: DataFrame) -> DataFrame:
    """1 when income starts on the same day each month, 0 when it wanders by 15 days or more."""
    days = txn.filter("amount > 0").groupBy(KEY, B.month().alias("m")).agg(F.min(F.dayofmonth("ts")).alias("d"))
    stats = days.groupBy(KEY).agg(*B.moments("d", "d"))
    score = F.when(F.col("d_n") < 2, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), 1.0 - B.std_pop("d") / 15.0))
    return stats.select(KEY, score.alias("income_regularity"))


def profile(txn: DataFrame) -> DataFrame:
    """One row per account: monthly averages, breadth of counterparties, flags, type."""
    months = txn.groupBy(KEY, B.month().alias("m")).agg(
        F.sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("inc"),
        F.sum(F.when(F.col("amount") < 0, -F.col("amount"))).alias("exp"))
    flows = months.groupBy(KEY).agg(*B.moments("inc", "inc"), F.count("exp").alias("exp_n"), B.total("exp").alias("exp_s"))
    inc_s = F.coalesce(F.col("inc_s"), F.lit(0.0))
    avg_inc = F.when(F.col("inc_n") > 0, inc_s / F.col("inc_n")).otherwise(0.0)
    flows = flows.select(
        KEY, avg_inc.alias("avg_monthly_income"),
        F.when(F.col("exp_n") > 0, F.col("exp_s") / F.col("exp_n")).otherwise(0.0).alias("avg_monthly_expense"),
        F.when((F.col("inc_n") > 1) & (avg_inc > 0), B.std_pop("inc") / avg_inc).otherwise(0.0).alias("monthly_income_cv"),
        F.when(inc_s > 0, F.least(F.lit(1.0), F.col("exp_s") / inc_s)).otherwise(0.0).alias("pass_through_ratio"))

    name = F.upper(B.cp_profile())
    is_in, is_out = F.col("amount") > 0, F.col("amount") < 0
    salary = is_in & (F.col("is_salary") | B.has_any(name, K.SALARY) | B.has_any(F.upper(F.coalesce("description", F.lit(""))), K.SALARY))
    names = txn.filter("amount <> 0").groupBy(KEY, is_in.alias("incoming"), name.alias("name")).agg(F.max(salary).alias("salary"))
    incoming = F.col("incoming")
    seen = names.groupBy(KEY).agg(
        F.count(F.when(incoming & (F.col("name") != ""), 1)).alias("income_source_count"),
        F.count(F.when(~incoming & (F.col("name") != ""), 1)).alias("expense_destination_count"),
        F.max("salary").alias("has_salary_flag"),
        F.max(incoming & B.has_any(F.col("name"), K.GOVERNMENT)).alias("has_pension_flag"),
        F.max(B.has_any(F.col("name"), K.CRYPTO)).alias("has_crypto_activity"))

    out = B.left_all(flows, seen, income_regularity(txn))
    for c in ("income_source_count", "expense_destination_count"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast("long")))
    for c in ("has_salary_flag", "has_pension_flag", "has_crypto_activity"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(False)))
    out = out.withColumn("income_regularity", F.coalesce("income_regularity", F.lit(0.0)))
    out = out.withColumn("has_business_activity", F.col("expense_destination_count") > 20)
    return out.withColumn("account_type", account_type())


def account_type():
    """Ordered decision list; the first rule that holds names the type."""
    income, cv = F.col("avg_monthly_income"), F.col("monthly_income_cv")
    sources, dests = F.col("income_source_count"), F.col("expense_destination_count")
    return (F.when(F.col("has_pension_flag") & (income < 300000), "pensioner")
            .when(F.col("has_crypto_activity") & (F.col("pass_through_ratio") > 0.6), "trader")
            .when(F.col("has_salary_flag") & (sources <= 8) & (F.col("income_regularity") >= 0.5) & (cv <= 0.35), "salary_employee")
            .when((sources > 10) & (dests > 30) & (income > 2000000), "business_owner")
            .when((sources >= 3) & (cv > 0.30) & ~F.col("has_salary_flag"), "freelancer")
            .when(income < 150000, "student")
            .otherwise("unknown"))


def looks_like_merchant(name):
    up = F.trim(F.upper(name))
    return B.has_any(up, K.MERCHANT + K.UTILITY + K.INSURANCE + K.TRANSPORT + K.MORTGAGE)


def family_counterparties(txn: DataFrame, months: int = 3, cv: float = 0.20) -> DataFrame:
    """Private payees paid in several months with a steady amount.

    Payees are first looked at as a whole, by one aggregate; months are counted and names looked up only
    for those that have enough payments over a long enough time with a steady amount.
    """
    out = txn.filter("amount < 0").withColumn("cp", B.cp_strict()).filter(F.col("cp") != "")
    out = out.withColumn("m", F.year("ts") * 12 + F.month("ts"))
    a = -F.col("amount")
    per = out.groupBy(KEY, "cp").agg(
        F.count("*").alias("a_n"), F.sum(a).cast("double").alias("a_s"), F.sum(a * a).cast("double").alias("a_q"),
        (F.max("m") - F.min("m") + 1 + F.max(F.when(F.col("m").isNull(), 1).otherwise(0))).alias("span"))
    amount_cv = B.std_pop("a") / B.mean_of("a")
    steady = per.filter((F.coalesce("span", F.lit(1)) >= months) & (F.col("a_n") >= 3) & (amount_cv < cv)).filter(~looks_like_merchant(F.col("cp")))
    # written first, so that its true size decides whether the payments must be shuffled to meet it
    steady = durable(steady.select(KEY, "cp", F.col("a_n").alias("payments"), amount_cv.alias("amount_cv")))
    seen = B.having(out.select(KEY, "cp", "m"), steady, [KEY, "cp"]).distinct().groupBy(KEY, "cp").agg(F.count("*").alias("months"))
    seen = seen.filter(F.col("months") >= months).withColumnsRenamed({KEY: "_key", "cp": "_cp"})
    return steady.join(seen, F.col(KEY).eqNullSafe(F.col("_key")) & (F.col("cp") == F.col("_cp"))).select(KEY, "cp", "months", "payments", "amount_cv")


def whitelist_reasons(txn: DataFrame, prof: DataFrame) -> DataFrame:
    """Rows with the reason that takes them out of scoring, or null.

    What the rows meet is cut to the accounts and payees that matter and written first, so that its
    true size decides whether whole rows must be shuffled.
    """
    flags = durable(prof.filter(F.col("has_salary_flag") & (F.col("income_regularity") > 0.5)).select(KEY, F.lit(True).alias("_steady")))
    family = durable(family_counterparties(txn).select(KEY, "cp", F.lit(True).alias("_family")))
    up = F.concat_ws(" ", F.upper(F.col("cp")), F.upper(F.trim(F.coalesce("description", F.lit("")))))
    out = txn.withColumn("cp", B.cp_strict()).join(flags, KEY, "left").join(family, [KEY, "cp"], "left")
    utility = K.UTILITY + K.MORTGAGE + K.INSURANCE
    reason = (F.when((F.col("amount") > 0) & (F.col("is_salary") | F.coalesce("_steady", F.lit(False)) | B.has_any(up, K.SALARY)), "salary")
              .when((F.col("amount") < 0) & B.has_any(up, utility + K.TRANSPORT), F.when(B.has_any(up, utility), "utility").otherwise("transport"))
              .when((F.col("amount") < 0) & F.coalesce("_family", F.lit(False)), "family"))
    return out.withColumn("whitelist_reason", reason).drop("cp", "_steady", "_family")


def apply_whitelist(txn: DataFrame, prof: DataFrame) -> DataFrame:
    return whitelist_reasons(txn, prof).filter("whitelist_reason is null").drop("whitelist_reason")


def investment_rows(txn: DataFrame, prof: DataFrame) -> DataFrame:
    """Rows that count as investing: any row of a trader, else under a tenth of monthly income."""
    p = prof.select(KEY, "account_type", "avg_monthly_income")
    ok = (F.col("account_type") == "trader") | (
        (F.col("avg_monthly_income") > 0) & (F.abs(B.dbl("amount")) / F.col("avg_monthly_income") < 0.10))
    return txn.join(p, KEY).filter(ok)


def payroll_days(txn: DataFrame, prof: DataFrame) -> DataFrame:
    """Days on which a business owner paid three or more payees."""
    paid = txn.filter("amount < 0").withColumn("cp", B.cp_strict()).filter("cp <> ''")
    paid = paid.select(KEY, B.day().alias("day"), "cp").distinct().groupBy(KEY, "day").agg(F.count("*").alias("payees"))
    return paid.filter("payees >= 3").join(prof.filter("account_type = 'business_owner'").select(KEY), KEY, "left_semi")


def cashflow_expenses(txn: DataFrame, hours: int = 48) -> DataFrame:
    """Payments to a merchant or bank that follow some income within 48 hours.

    A payment qualifies when the latest income before it is close enough, so one as-of
    lookup per row replaces the list of pairs.
    """
    hit = (F.col("amount") < 0) & B.has_any(F.upper(B.cp_strict()), K.CASHFLOW_PAYEE)
    rows = txn.filter((F.col("amount") > 0) | hit).select(
        KEY, "seq", B.us().alias("t"), (F.col("amount") > 0).alias("is_income"), "amount")
    latest = last_income(rows)
    gap = F.col("t") - F.col("last_income")
    return latest.filter(~F.col("is_income") & (gap <= hours * B.HOUR_US)).select(
        KEY, "seq", B.dbl("amount").alias("amount"), (gap / float(B.HOUR_US)).alias("gap_hours"))


def last_income(rows: DataFrame, slice_us: int = 2 * B.DAY_US) -> DataFrame:
    from pyspark.sql import Window
    rows = rows.withColumn("_slice", F.floor(F.col("t") / F.lit(slice_us)))
    part = [KEY, "_slice"]
    along = Window.partitionBy(KEY).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    stamp = F.when(F.col("is_income"), F.col("t"))
    ends = rows.groupBy(*part).agg(F.max(stamp).alias("_end")).select(*part, F.max("_end").over(along).alias("_before"))
    inside = Window.partitionBy(*part).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    return rows.join(ends, part).withColumn("last_income", F.coalesce(F.max(stamp).over(inside), F.col("_before")))
