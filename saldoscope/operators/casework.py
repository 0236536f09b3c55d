"""Ledger, case and portfolio queries."""

from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base as B
from .base import KEY
from .settle import ANSWER_COLUMNS, settle


def matching(txn: DataFrame, date_from=None, date_to=None, min_amount=None, max_amount=None, direction="any", name=None, counterparty_type=None) -> DataFrame:
    a, d = F.abs("amount"), txn
    tests = [
        (date_from, lambda v: F.col("ts") >= F.lit(v).cast("timestamp")), (date_to, lambda v: F.col("ts") <= F.lit(v).cast("timestamp")),
        (min_amount, lambda v: a >= v), (max_amount, lambda v: a <= v), (name, lambda v: F.lower(B.cp_desc()).contains(v.lower())),
        (counterparty_type, lambda v: F.col("counterparty_type") == v)]
    for value, test in tests:
        d = d if value is None else d.filter(test(value))
    return {"income": d.filter("amount > 0"), "expense": d.filter("amount < 0")}.get(direction, d)


def query_transactions(txn: DataFrame, limit: int = 50, **filters) -> DataFrame:
    """First rows per account plus totals over all matches."""
    hit = matching(txn, **filters)
    totals = hit.groupBy(KEY).agg(F.count("*").alias("found"), B.total("amount").alias("total_amount"))
    top = B.topk(hit.select(KEY, "seq", B.dbl("amount").alias("amount")), [KEY], ["seq"], limit)
    return top.join(totals, KEY).withColumn("truncated", F.col("found") > limit)


def summarise_counterparties(txn: DataFrame, direction: str = "any", k: int = 20) -> DataFrame:
    d = matching(txn, direction=direction).withColumn("name", F.coalesce(B.blank_to_null(B.cp_desc()), F.lit("—")))
    g = d.groupBy(KEY, "name").agg(F.count("*").alias("operations"), B.total("amount").alias("total_amount"), F.min_by("counterparty_type", "seq").alias("type"))
    return B.topk(g, [KEY], [F.desc(F.abs("total_amount")), "name"], k)


def period_totals(txn: DataFrame) -> DataFrame:
    """Months and the grand total (month is null) in one pass."""
    inc, exp = F.when(F.col("amount") > 0, F.col("amount")), F.when(F.col("amount") <= 0, -F.col("amount"))
    m = txn.groupBy(KEY, B.month().alias("month")).agg(F.count("*").alias("n"), F.sum(inc).alias("i"), F.sum(exp).alias("e"))
    g = m.select(KEY, F.explode(F.array(F.col("month"), F.lit("total"))).alias("period"), "n", "i", "e").groupBy(KEY, "period").agg(
        F.sum("n").alias("n"), B.total("i").alias("income"), B.total("e").alias("expense"))
    return g.withColumn("net_flow", F.col("income") - F.col("expense"))


def list_transactions(txn: DataFrame, skip: int = 0, limit: int = 100, subject=None, tx_type=None, suspicious: DataFrame | None = None) -> DataFrame:
    d = txn if tx_type is None else txn.filter(F.col("type") == tx_type)
    d = d if subject is None else d.filter(B.cp_strict() == subject)
    d = d if suspicious is None else d.join(suspicious.select(KEY, "seq"), [KEY, "seq"], "left_semi")
    return d.orderBy(F.desc("ts"), F.desc("seq"), KEY).offset(skip).limit(limit).select(KEY, "seq", B.stamp().alias("at_time"), B.dbl("amount").alias("amount"), "type")


def list_subjects(subjects: DataFrame, txn: DataFrame, needle=None, subject_type=None) -> DataFrame:
    d = subjects.join(txn.select(B.cp_strict().alias("name")).distinct(), "name", "left_semi")
    d = d if subject_type is None else d.filter(F.col("subject_type") == subject_type)
    return d if needle is None else d.filter(F.lower("name").contains(needle.lower()) | F.lower("unique_identifier").contains(needle.lower()))


def in_band(band: str):
    """Band on the composite score; the legacy score stands in where it is missing."""
    c, r = F.col("composite_score"), F.col("risk_score")
    new = {"low": c <= 30, "medium": (c > 30) & (c <= 60), "high": c > 60}[band]
    old = {"low": r <= 3, "medium": (r > 3) & (r <= 6), "high": r > 6}[band]
    return F.when(c.isNull(), old).otherwise(new)


def list_analyses(analyses: DataFrame, status=None, band=None, date_from=None, date_to=None, search=None, sort="created_at", ascending=False, skip=0, limit=100) -> DataFrame:
    d = analyses if status is None else analyses.filter(F.col("status") == status)
    d = d if band is None else d.filter(in_band(band))
    d = d if date_from is None else d.filter(F.col("created_at") >= F.lit(date_from).cast("timestamp"))
    d = d if date_to is None else d.filter(F.col("created_at") <= F.lit(date_to + " 23:59:59").cast("timestamp"))
    d = d if search is None else d.filter(F.col("name").ilike(f"%{search}%"))
    order = F.col(sort).asc() if ascending else F.col(sort).desc()
    return d.orderBy(order, "analysis_id").offset(skip).limit(limit)


def portfolio_stats(analyses: DataFrame, subjects: DataFrame) -> DataFrame:
    c, st = F.col("composite_score"), F.col("status")
    done = st == "completed"
    n = lambda cond: F.count(F.when(cond, 1))
    g = analyses.agg(F.count("*").alias("total_analyses"), n(done).alias("completed"), n(done & ((c <= 30) | c.isNull())).alias("low_risk"), n(done & (c > 30) & (c <= 60)).alias("medium_risk"),
                     n(done & (c > 60)).alias("high_risk"), n(st == "failed").alias("failed"), n(st == "pending").alias("pending"), n(st.isin("parsing", "analyzing", "in_progress", "processing")).alias("in_progress"),
                     (F.sum(c.cast("decimal(18,2)")).cast("double") / F.count(c)).alias("avg_composite"), F.sum("transaction_count").alias("transactions"), F.sum("total_amount").cast("double").alias("total_amount"))
    g = g.withColumn("completion_rate", B.py_round(F.col("completed") / F.col("total_analyses") * 100.0, 2))
    return g.join(F.broadcast(subjects.agg(F.count("*").alias("total_subjects"))))  # one row each


def monthly_chart(analyses: DataFrame, as_of: str) -> DataFrame:
    start = F.date_trunc("month", F.lit(as_of).cast("timestamp")) - F.expr("interval 180 days")
    c = F.col("composite_score")
    d = analyses.filter(F.col("created_at") >= start)
    return d.groupBy(B.month("created_at").alias("month")).agg(
        F.count("*").alias("total"), F.count(F.when(F.col("status") == "completed", 1)).alias("completed"), F.count(F.when(c > 60, 1)).alias("high_risk"),
        B.py_round(F.coalesce(F.sum(c.cast("decimal(18,2)")).cast("double") / F.count(c), F.lit(0.0)), 1).alias("avg_risk"))


def analysis_stats(txn: DataFrame) -> DataFrame:
    a = F.col("amount")
    return txn.groupBy(KEY).agg(F.count("*").alias("n"), F.count(F.when(a > 0, 1)).alias("incoming"), F.count(F.when(a < 0, 1)).alias("outgoing"), F.count(F.when(F.col("type").startswith("transfer"), 1)).alias("transfers"),
                                B.total(F.when(a > 0, a)).alias("incoming_amount"), B.total(F.when(a < 0, -a)).alias("outgoing_amount"))


def analyst_stats(analyses: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    c = F.when(done, F.col("composite_score").cast("decimal(18,2)"))
    return analyses.groupBy("user_id").agg(F.count("*").alias("total"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("completed", "pending", "processing", "failed")],
                                           (F.sum(c).cast("double") / F.count(c)).alias("avg_risk"))


def transaction_view(txn: DataFrame, needle: str, side: str = "all", sort: str = "amount", k: int = 50) -> DataFrame:
    text = F.lower(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("counterparty", F.lit(""))))
    d = matching(txn.filter(text.contains(needle.lower())), direction={"in": "income", "out": "expense"}.get(side, "any"))
    order = F.desc(F.abs("amount")) if sort == "amount" else F.desc("ts")
    return B.topk(d, [KEY], [order, "seq"], k).select(KEY, "rank_in_account", "seq", B.dbl("amount").alias("amount"))


def close_sessions(logins: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    stale = F.col("stayed").isNull() & (B.us(now) - B.us("login_at") > days * B.DAY_US)
    state = F.when(F.col("stayed").isNotNull(), "closed").when(stale, "expired").otherwise("active")
    return logins.select("login_id", "user_id", B.stamp("login_at").alias("login_at"), F.coalesce("stayed", F.lit(-1)).alias("stayed"), state.alias("state"))


def online_time(logins: DataFrame) -> DataFrame:
    return logins.groupBy("user_id").agg(F.coalesce(F.sum("stayed"), F.lit(0)).alias("seconds_online"), F.count("stayed").alias("sessions"))


def prune_notifications(notes: DataFrame, as_of: str, days: int = 30, cap: int = 100) -> DataFrame:
    """(user_id, note_id, created_at, is_read): old read ones go, then the newest stay."""
    old = F.col("is_read") & (F.col("created_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))
    return B.topk(notes.filter(~old), ["user_id"], [F.desc("created_at"), F.desc("note_id")], cap, "rank")


# ---- sliding-window limit
RATE_LIMITS = {"/api/auth/login": (5, 60), "/api/auth/register": (3, 60), "/api/auth/forgot-password": (3, 300), "/api/auth/reset-password": (5, 300), "/api/analyses/upload": (10, 600)}


def rate_limit(hits: DataFrame, limit: int, window_s: int) -> DataFrame:
    """(account_id, seq, ts) hits of one path: a hit passes while fewer than ``limit`` passed
    hits lie in the window before it; refused hits do not count."""
    window, width = window_s * 1_000_000, max(B.DAY_US, 2 * window_s * 1_000_000)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, sl = pdf[KEY].iat[0], pdf["slice"].iat[0]
        pdf = pdf.sort_values(["t", "seq"])
        start, end = sl * width, (sl + 1) * width
        passed, out = [], []
        for t, seq in zip(pdf["t"].to_numpy(), pdf["seq"].to_numpy()):
            if t < start:  # passed hits of the slice before
                passed.append((t, seq))
                continue
            passed = [p for p in passed if t - p[0] < window]
            ok = len(passed) < limit
            wait = 0.0 if ok else float(max(int((window - (t - passed[0][0])) / 1e6), 1))
            out.append((key, sl, "done", t, seq, float(ok), 0, 0, wait))
            if ok:
                passed.append((t, seq))
        out += [(key, sl + 1, "open", t, seq, 0.0, 0, 0, 0.0) for t, seq in passed if end - t < window]
        return pd.DataFrame(out, columns=ANSWER_COLUMNS)

    rows = hits.select(KEY, F.floor(B.us() / F.lit(width)).alias("slice"), B.us().alias("t"), "seq", F.lit(0.0).alias("amount"))
    done = settle(rows, [KEY], run)
    return done.select(KEY, "seq", (F.col("amount") == 1).alias("allowed"), F.col("amount2").cast("long").alias("retry_after"))


def presence(activity: DataFrame, gap_s: int = 300) -> DataFrame:
    """Spans of activity: a user is offline after five quiet minutes."""
    inst = activity.groupBy("user_id", B.us().alias("t")).agg(F.count("*").alias("n"))
    runs = B.islands(inst, ["user_id"], gap_s * 1_000_000).groupBy("user_id", "run").agg(F.max("t").alias("b"), F.sum("n").alias("n"))
    return runs.select("user_id", B.stamp_us("run").alias("online_from"), B.stamp_us(F.col("b") + gap_s * 1_000_000).alias("offline_at"), "n")


def latest_progress(steps: DataFrame) -> DataFrame:
    return steps.groupBy("session_id").agg(F.max_by("step", F.struct("ts", "seq")).alias("step"), B.stamp(F.max("ts")).alias("at_time"))


AS_OF = datetime(2024, 1, 31).strftime("%Y-%m-%d %H:%M:%S")
