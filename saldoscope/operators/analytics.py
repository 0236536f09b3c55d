"""Financial analytics of an account and checks of a statement."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import keywords as K
from ..session import drop, durable
from . import base as B
from . import habits as H
from .base import KEY


def _in():
    return F.when(F.col("amount") > 0, F.col("amount"))


def _ex():
    return F.when(F.col("amount") < 0, -F.col("amount"))


def _days():
    return F.greatest(F.floor((B.us(F.max("ts")) - B.us(F.min("ts"))) / F.lit(B.DAY_US)), F.lit(1))


def totals(txn: DataFrame) -> DataFrame:
    return txn.groupBy(KEY).agg(
        F.count("*").alias("n"), B.total(_in()).alias("total_income"), B.total(_ex()).alias("total_expense"), F.count(_in()).alias("n_in"), F.count(_ex()).alias("n_out"),
        _days().alias("days"), F.count(F.col("amount")).alias("n_any"))


def safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def general_stats(txn: DataFrame, account: DataFrame) -> DataFrame:
    med = B.exact_median(txn.withColumn("a", F.abs("amount")), [KEY], "a", "median_transaction")
    d = totals(txn).join(med, KEY).join(account.select(KEY, "balance_start", "balance_end"), KEY, "left")
    days = F.when(F.col("n") >= 2, F.col("days")).otherwise(30)
    return d.select(KEY, F.col("n").alias("total_transactions"), "total_income", "total_expense", (F.col("total_income") - F.col("total_expense")).alias("net_flow"),
                    B.dbl("balance_start").alias("balance_start"), B.dbl("balance_end").alias("balance_end"), B.py_round(F.col("total_expense") / days, 2).alias("avg_daily_expense"),
                    "median_transaction", safe_div(F.col("total_income"), F.col("n_in")).alias("avg_income"), safe_div(F.col("total_expense"), F.col("n_out")).alias("avg_expense"),
                    F.col("n_in").alias("income_transactions"), F.col("n_out").alias("expense_transactions"))


def monthly_breakdown(txn: DataFrame) -> DataFrame:
    g = txn.groupBy(KEY, B.month().alias("month")).agg(B.total(_in()).alias("income"), B.total(F.when(F.col("amount") <= 0, -F.col("amount"))).alias("expense"), F.count("*").alias("transaction_count"))
    label = F.element_at(F.array(*[F.lit(m) for m in K.MONTHS_RU]), F.substring("month", 6, 2).cast("int"))
    return g.withColumn("balance", F.col("income") - F.col("expense")).withColumn("month_name", F.concat_ws(" ", label, F.substring("month", 1, 4)))


def category_breakdown(cats: DataFrame) -> DataFrame:
    """Here zero counts as income."""
    side = F.when(F.col("amount") < 0, "expense").otherwise("income")
    g = cats.groupBy(KEY, side.alias("side"), "category").agg(F.sum(F.abs("amount")).alias("a"), F.count("*").alias("n"))
    whole = F.sum("a").over(Window.partitionBy(KEY, "side")).cast("double")
    return g.select(KEY, "side", "category", B.dbl("a").alias("amount"), "n", F.when(whole > 0, B.dbl("a") / whole * 100.0).otherwise(0.0).alias("percentage"))


def top_merchants(labelled: DataFrame, k: int = 10) -> DataFrame:
    g = labelled.filter("label = 'Покупка' and amount < 0").groupBy(KEY, F.substring("description", 1, 40).alias("merchant")).agg(B.total(F.abs("amount")).alias("amount"), F.count("*").alias("n"))
    return B.topk(g, [KEY], [F.desc("amount"), "merchant"], k).withColumn("avg_transaction", F.col("amount") / F.col("n"))


def top_contacts(labelled: DataFrame, k: int = 10) -> DataFrame:
    d = labelled.filter(F.col("label").isin("Перевод", "Пополнение")).withColumn("name", F.trim(F.regexp_extract(F.coalesce("description", F.lit("")), K.CONTACT_REGEX, 1)))
    g = d.filter("name <> ''").groupBy(KEY, "name").agg(
        B.total(_ex()).alias("sent"), B.total(F.when(F.col("amount") >= 0, F.col("amount"))).alias("received"), B.total(F.abs("amount")).alias("volume"), F.count("*").alias("n"))
    return B.topk(g, [KEY], [F.desc("volume"), "name"], k).select(KEY, "rank_in_account", "name", "sent", "received", (F.col("received") - F.col("sent")).alias("balance"), "n")


def recurring_key():
    c = F.regexp_replace(F.upper(F.coalesce("description", F.lit(""))), r"(?<![\p{L}\p{N}_])\d{6,}(?![\p{L}\p{N}_])", "")
    return F.substring(F.trim(F.regexp_replace(c, r"\s+\d+$", "")), 1, 30)


def recurring_payments(txn: DataFrame, k: int = 20) -> DataFrame:
    keys = [KEY, "name"]
    rows = txn.filter("amount < 0").select(KEY, recurring_key().alias("name"), F.abs("amount").alias("amount"), B.us().alias("t"))
    g = rows.groupBy(*keys, "amount").agg(F.count("*").alias("n"), F.max("t").alias("last")).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("amount") * F.col("n")).cast("double").alias("total_amount"), F.max("last").alias("last"))
    g = g.filter("n >= 2 and kinds <= 3")
    inst = rows.join(g.select(*keys), keys, "left_semi").groupBy(*keys, "t").agg(F.count("*").alias("c"))
    gap = H.with_gaps(inst, keys, 365 * B.DAY_US).groupBy(*keys).agg(F.coalesce(F.sum(F.floor(F.col("gap") / F.lit(B.DAY_US))), F.lit(0)).alias("gaps"))
    d = g.join(gap, keys).withColumn("avg_interval_days", F.col("gaps") / (F.col("n") - 1))
    i = F.col("avg_interval_days")
    d = d.withColumn("frequency", F.when(i.between(25, 35), "monthly").when(i.between(6, 8), "weekly").when(i.between(13, 16), "bi-weekly").when(i <= 3, "frequent").otherwise("unknown"))
    d = d.filter("frequency <> 'unknown' or n >= 3")
    return B.topk(d, [KEY], [F.desc("total_amount"), "name"], k).select(
        KEY, "rank_in_account", "name", "n", "total_amount", (F.col("total_amount") / F.col("n")).alias("avg_amount"), "frequency", "avg_interval_days", B.stamp_us("last").alias("last_payment"))


def anomalies(txn: DataFrame, sigma: float = 2.0, day_rows: int = 10, k: int = 20) -> DataFrame:
    out = txn.filter("amount < 0")
    s = out.groupBy(KEY).agg(*B.moments("a", F.abs("amount"))).select(KEY, B.mean_of("a").alias("mean"), F.coalesce(B.std_samp("a"), F.lit(0.0)).alias("sd"))
    big = out.join(s, KEY).withColumn("a", F.abs(B.dbl("amount"))).filter(F.col("a") > F.col("mean") + F.col("sd") * sigma)
    big = big.select(KEY, F.lit("large_transaction").alias("kind"), B.stamp().alias("at_time"), "seq", F.col("a").alias("amount"),
                     safe_div(F.col("a") - F.col("mean"), F.col("sd")).alias("deviation"), F.lit(1).cast("long").alias("n"))
    days = txn.groupBy(KEY, B.day().alias("at_time")).agg(F.count("*").alias("n")).filter(F.col("n") >= day_rows)
    days = days.select(KEY, F.lit("high_frequency_day").alias("kind"), "at_time", F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("amount"), F.lit(0.0).alias("deviation"), "n")
    return B.topk(big.unionByName(days), [KEY], [F.desc("amount"), "kind", "at_time", "seq"], k)


def foreign_currency(txn: DataFrame, base: str = "KZT") -> DataFrame:
    g = txn.filter((F.col("original_currency") != "") & (F.col("original_currency") != base)).groupBy(KEY, F.col("original_currency").alias("currency")).agg(
        F.count("*").alias("n"), B.total(F.abs(F.coalesce("original_amount", F.lit(0)))).alias("total_original"), B.total(F.abs("amount")).alias("total_kzt"))
    return g.withColumn("avg_exchange_rate", safe_div(F.col("total_kzt"), F.col("total_original")))


def financial_health(txn: DataFrame, cats: DataFrame, account: DataFrame) -> DataFrame:
    t = totals(txn)
    e = cats.filter("amount < 0").groupBy(KEY).agg(
        B.total(F.when(F.col("category").isin(*K.ESSENTIAL), -F.col("amount"))).alias("essential"), B.total(F.when(F.col("category").isin(*K.NON_ESSENTIAL), -F.col("amount"))).alias("non_essential"))
    m = monthly_breakdown(txn).groupBy(KEY).agg(F.count("*").alias("months"), F.min_by("balance", "month").alias("first"), F.max_by("balance", "month").alias("last"))
    d = B.left_all(t, e, m, account.select(KEY, "balance_end"))
    first, last = F.col("first"), F.col("last")
    delta = (last - first) / F.greatest(F.abs(first), F.abs(last), F.lit(1.0))
    trend = F.when(F.col("months") < 2, "stable").when(delta > 0.10, "growing").when(delta < -0.10, "declining").otherwise("stable")
    days = F.when(F.col("n") >= 2, F.col("days")).otherwise(30)
    zero = F.lit(0.0)
    inc, exp, ess = F.col("total_income"), F.col("total_expense"), F.coalesce("essential", zero)
    return d.select(KEY, safe_div(inc - exp, inc).alias("savings_rate"), ess.alias("essential_expenses"), F.coalesce("non_essential", zero).alias("non_essential_expenses"),
                    safe_div(ess, exp).alias("essential_ratio"), trend.alias("balance_trend"), "months", (inc / F.col("months")).alias("monthly_avg_income"),
                    (exp / F.col("months")).alias("monthly_avg_expense"), F.when(exp > 0, F.coalesce(B.dbl("balance_end"), zero) / (exp / days)).otherwise(0.0).alias("financial_buffer_days"))


def weekday_analysis(txn: DataFrame) -> DataFrame:
    out, wd = F.col("amount") < 0, F.weekday("ts")
    g = txn.groupBy(KEY).agg(*[x for i in range(7) for x in (B.total(F.when(out & (wd == i), -F.col("amount"))).alias(f"s{i}"), F.count(F.when(out & (wd == i), 1)).alias(f"n{i}"))])
    days = F.array(*[F.struct(F.lit(i).alias("day_index"), F.lit(K.WEEKDAYS_RU[i]).alias("day"), F.col(f"s{i}").alias("amount"), F.col(f"n{i}").alias("n")) for i in range(7)])
    return g.select(KEY, F.explode(days).alias("d")).select(KEY, "d.*").withColumn("avg_transaction", safe_div(F.col("amount"), F.col("n")))


def daily_patterns(txn: DataFrame, account: DataFrame) -> DataFrame:
    """Income, spending and end-of-day balance. Days are summed first, so the running total
    of an account goes over calendar days."""
    g = txn.groupBy(KEY, B.day().alias("day")).agg(B.total(_in()).alias("income"), B.total(F.when(F.col("amount") <= 0, -F.col("amount"))).alias("expense"), F.sum("amount").alias("net"))
    run = F.sum("net").over(Window.partitionBy(KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    d = g.withColumn("run", run).join(account.select(KEY, "balance_start"), KEY, "left")
    return d.select(KEY, "day", "income", "expense", (F.coalesce("balance_start", F.lit(0).cast("decimal(15,2)")) + F.col("run")).cast("double").alias("balance"))


# ---- checks of a statement
def reconcile(txn: DataFrame, account: DataFrame) -> DataFrame:
    t = totals(txn).select(KEY, "n", "total_income", "total_expense")
    d = account.join(t, KEY, "left")
    zero = F.lit(0.0)
    inc, exp = F.coalesce("total_income", zero), F.coalesce("total_expense", zero)
    start, end = B.dbl("balance_start"), B.dbl("balance_end")
    diff, tol = F.abs(start + inc - exp - end), F.greatest(F.lit(1.0), (inc + exp) * 1e-5)
    return d.select(KEY, B.n0("n").alias("total_transactions"), (B.n0("n") > 0).alias("is_valid"), (start + inc - exp).alias("calculated_end"), diff.alias("difference"),
                    tol.alias("tolerance"), F.when((start != 0) | (end != 0), diff <= tol).alias("balance_reconciled"))


def summary_basic(txn: DataFrame) -> DataFrame:
    inc, exp = F.col("total_income"), F.col("total_expense")
    return totals(txn).select(KEY, F.col("n").alias("total_transactions"), "total_income", "total_expense", (inc - exp).alias("net_flow"), ((inc + exp) / F.col("n")).alias("avg_transaction"))


def summary(txn: DataFrame) -> DataFrame:
    med = B.exact_median(txn.withColumn("a", F.abs("amount")), [KEY], "a", "median_high", high=True)
    return totals(txn).join(med, KEY).select(KEY, "total_income", "total_expense", B.py_round(F.col("total_expense") / F.col("days"), 2).alias("avg_daily_expense"), "median_high")


def empty_statements(account: DataFrame, txn: DataFrame) -> DataFrame:
    return account.select(KEY, "owner").join(txn.select(KEY).distinct(), KEY, "left_anti")


def field_completeness(txn: DataFrame) -> DataFrame:
    share = lambda c: F.count(F.when(c, 1)) / F.count("*") * 100.0
    return txn.groupBy(KEY).agg(share(F.col("description") != "").alias("description"), share(F.col("counterparty") != "").alias("counterparty"), share(F.col("merchant_name") != "").alias("merchant_name"),
                                share(F.col("counterparty_type") != "unknown").alias("classified"), share(F.col("is_salary") | F.col("is_atm") | F.col("is_cash_operation")).alias("flagged"))


def _plain_text(c) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def _grams(c: Column, n: int) -> Column:
    """Distinct pieces of ``n`` characters of a text."""
    size = F.length(c) - n + 1
    return F.when(size > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.expr("cast(array() as array<string>)"))


def _carried(t: DataFrame, p: DataFrame, key: list[str]) -> DataFrame:
    """(key, want, have, t, p): true and parsed texts of one day and amount where the one stands inside the other.

    A text can only stand inside one that has all of its pieces of three characters, so they meet
    by its rarest piece of the day and amount; shorter texts meet as a whole.
    """
    have = F.col("have")
    pieces = p.join(t.select(*key).distinct(), key, "left_semi").withColumn("gram", F.explode(F.concat(F.array(F.lit("")), *[_grams(have, n) for n in (1, 2, 3)])))
    often = pieces.groupBy(*key, "gram").agg(F.count("*").alias("n"))
    want = F.col("want")
    asked = F.when(want == "", F.array(F.lit(""))).when(F.length(want) < 3, F.array(want)).otherwise(_grams(want, 3))
    t = t.withColumn("asked", asked)
    met = t.select(*key, "want", F.col("t"), F.size("asked").alias("all"), F.explode("asked").alias("gram")).join(often, [*key, "gram"])
    rare = met.groupBy(*key, "want", "t", "all").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"), F.count("*").alias("found")).where("found = all")
    return rare.join(pieces, [*key, "gram"]).where(F.contains(have, want)).select(*key, "want", "have", "t", "p")


#: True times parsed texts of a day and amount up to which all are compared as they lie; larger ones meet by pieces.
FEW_PAIRS = 250_000


def _settled(edges: DataFrame, key: list[str]) -> DataFrame:
    """One round: ``took`` of the pairs that prefer each other, and what is left of ``t`` and ``p``.

    Pairs that can take no more lose their texts; those that took nothing either are left out.
    """
    by_want, by_have = Window.partitionBy(*key, "want"), Window.partitionBy(*key, "have")
    d = edges.withColumn("_have", F.min("have").over(by_want)).withColumn("_want", F.min("want").over(by_have))
    d = d.withColumn("took", F.when((F.col("have") == F.col("_have")) & (F.col("want") == F.col("_want")), F.least("t", "p")).otherwise(0))
    d = d.withColumn("p", F.col("p") - F.max("took").over(by_have)).withColumn("t", F.col("t") - F.max("took").over(by_want))
    open_ = (F.col("t") > 0) & (F.col("p") > 0)
    return d.where(open_ | (F.col("took") > 0)).select(*[F.when(open_, F.col(c)).alias(c) for c in edges.columns], "took")


def match_truth(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """How much of the true rows (day, amount, text) came through in parsed ones (day, amount, and any of
    description, counterparty and merchant_name).

    Rows match on the day and the amount in cents. First those whose text survives somewhere in
    the parsed row: true texts in order take the first parsed text left that holds them. The
    rest of a day and amount pair up as they are. Equal texts are one row with a count; in
    each round every pair that prefers each other is settled, which gives what one pass in order gives.
    The texts of a day and amount are compared directly while they are few, so only texts and
    counts are shuffled; the first round follows in the same tasks.
    """
    key = ["day", "cents"]
    cents = F.round(F.col("amount") * 100).cast("long").alias("cents")
    parts = [B.blank_to_null(_plain_text(F.col(c))) for c in ("description", "counterparty", "merchant_name") if c in parsed.columns]
    t = durable(truth.groupBy("day", cents, _plain_text(F.col("text")).alias("want")).agg(F.count("*").alias("t")))
    p = durable(parsed.groupBy("day", cents, F.concat_ws(" ", *parts).alias("have")).agg(F.count("*").alias("p")))
    none = F.lit(0).cast("long")
    both = t.select(*key, "t", none.alias("p")).unionByName(p.select(*key, none.alias("t"), "p"))
    both = durable(both.groupBy(*key).agg(F.sum("t").alias("t"), F.sum("p").alias("p"), (F.count_if(F.col("t") > 0) * F.count_if(F.col("p") > 0)).alias("pairs")))
    met = F.when(F.col("day").isNotNull() & F.col("cents").isNotNull(), F.least("t", "p"))  # a missing day or amount meets nothing
    out = both.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("expected"), F.coalesce(F.sum("p"), F.lit(0)).alias("parsed"), F.coalesce(F.sum(met), F.lit(0)).alias("recovered"))
    many = durable(both.where(F.col("pairs") > FEW_PAIRS).select(*key))
    crowded = not many.isEmpty()
    few = lambda d: d.join(many, key, "left_anti") if crowded else d
    table, same = durable(_settled(few(t).join(few(p), key).where(F.contains("have", "want")).select(*key, "want", "have", "t", "p"), key)), 0
    large = durable(_carried(t.join(many, key, "left_semi"), p.join(many, key, "left_semi"), key)) if crowded else None
    while True:
        same += table.agg(F.coalesce(F.sum("took"), F.lit(0))).first()[0]
        edges = table.where("t is not null").drop("took")
        if large is not None:
            edges, large = edges.unionByName(large), None
        if edges.isEmpty():
            break
        after = durable(_settled(edges, key))
        drop(table)
        table = after
    return out.select("*", F.lit(same).cast("long").alias("fully_correct"), (F.col("parsed") - F.col("recovered")).alias("spurious"))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 per class over (expected, predicted)."""
    g = pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("expected").alias("label"), F.col("n").alias("e"), F.lit(0).cast("long").alias("p"), F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0).alias("h")),
                    F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("e"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))
    s = g.select(F.explode(sides).alias("x")).groupBy("x.label").agg(F.sum("x.e").alias("support"), F.sum("x.p").alias("predicted"), F.sum("x.h").alias("hits"))
    pr, rc = safe_div(F.col("hits"), F.col("predicted")), safe_div(F.col("hits"), F.col("support"))
    return s.withColumn("precision", pr).withColumn("recall", rc).withColumn("f1", F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0))


def overall_metrics(pairs: DataFrame) -> DataFrame:
    """Cases, hits, accuracy and macro-F1 (the plain mean over all labels) of (expected, predicted)."""
    per = class_metrics(pairs)
    return per.agg(F.sum("support").alias("cases"), F.sum("hits").alias("correct"), B.py_round(F.sum("hits") / F.sum("support") * 100.0, 6).alias("accuracy"), B.py_round(F.avg("f1"), 6).alias("macro_f1"))


def group_accuracy(pairs: DataFrame) -> DataFrame:
    """Hits and cases by group of difficulty; rows without a group count as one."""
    group = F.coalesce("group", F.lit("—")).alias("group")
    return pairs.groupBy(group).agg(F.count(F.when(F.col("expected") == F.col("predicted"), 1)).alias("correct"), F.count("*").alias("cases"))
