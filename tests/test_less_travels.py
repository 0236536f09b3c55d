"""What an operator hands on to its dear steps is cut to the rows that can matter."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from saldoscope.operators import base as B
from saldoscope.operators import habits as H
from saldoscope.operators import patterns as N
from saldoscope.operators import profile as P
from saldoscope.operators import scoring as R
from saldoscope.operators import structuring as S
from saldoscope.operators import velocity as V
from saldoscope.plans.book import Book

T0 = datetime(2024, 1, 1)
COLS = "account_id string, seq long, ts timestamp, amount decimal(15,2), counterparty string, merchant_name string, description string, is_salary boolean"


def book(spark, rows):
    return spark.createDataFrame([(a, i, t, Decimal(v), cp, None, text, False) for i, (a, t, v, cp, text) in enumerate(rows)], COLS)


@pytest.fixture
def handed(monkeypatch):
    """Rows handed to a function of a module, by its name."""
    seen = {}

    def watch(module, name):
        real = getattr(module, name)

        def step(df, *args, **kwargs):
            seen[name] = df.count()
            return real(df, *args, **kwargs)
        monkeypatch.setattr(module, name, step)
    seen["watch"] = watch
    return seen


def test_whole_rows_stay_where_they_are_in_the_whitelist(spark):
    monthly = [("A", T0 + timedelta(days=31 * i), -500, "Мама", "x") for i in range(4)]
    rows = monthly + [("A", T0, -70, "p", "YANDEX TAXI"), ("A", T0, -70, "p", "Коммунальные услуги"), ("A", T0, -70, "p", "x"), ("B", T0, 90, "q", "x"), ("C", T0, 90, "q", "x"), (None, T0, -1, "q", "x")]
    rows += [("D", T0 + timedelta(days=i), -500, "Мама", "x") for i in range(4)] + [("E", t, -500, "MAGNUM", "x") for _, t, *_ in monthly]
    prof = spark.createDataFrame([("A", False, 0.0), ("B", True, 0.9), ("C", True, 0.5), ("D", None, None), ("E", False, 0.0)], "account_id string, has_salary_flag boolean, income_regularity double")
    got = P.whitelist_reasons(book(spark, rows), prof)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.whitelist_reason for r in got.orderBy("seq").collect()] == ["family"] * 4 + ["transport", "utility", None, "salary", None, None] + [None] * 8


def test_a_steady_payee_without_account_or_date(spark):
    rows = [(None, T0 + timedelta(days=31 * i), -500, "Мама", "x") for i in range(3)]
    rows += [("A", t, -500, "Мама", "x") for t in (T0, T0 + timedelta(days=31), None)] + [("B", t, -500, "Мама", "x") for t in (T0, None, None)]
    got = {(r.account_id, r.cp, r.months, r.payments, r.amount_cv) for r in P.family_counterparties(book(spark, rows)).collect()}
    assert got == {(None, "Мама", 3, 3, 0.0), ("A", "Мама", 3, 3, 0.0)}


def test_structuring_looks_at_rows_within_reach(spark):
    split = [("A", T0 + timedelta(hours=i), -300000, "p", "x") for i in range(3)]
    smurf = [("A", T0 + timedelta(days=2 * i), -120000 - i, f"c{i}", "x") for i in range(1, 7)]
    repeat = [("A", T0 + timedelta(days=60 + 30 * i), 960000, "r", "x") for i in range(2)]
    other = [("A", T0 + timedelta(days=100), 999999, "q", "x"), ("A", T0, -5000, "s", "x"), ("B", T0, -999999, "s", "комиссия"), ("A", T0 + timedelta(days=40), -700000, "t", "x")]
    got = S.structuring_rows(book(spark, split + smurf + repeat + other).select("account_id", "seq", "ts", "amount", "description", "counterparty"))
    seqs = {r.seq for r in got.collect()}
    assert set(range(9)) | {11} <= seqs and not seqs & {9, 10, 14}
    lim = spark.createDataFrame([("A", 1e6, 1e5), ("B", 1e6, 1e5)], "account_id string, threshold double, min_significant double")
    assert [r.seq for r in S.just_under(got.where("account_id = 'A'"), lim).collect()] == [11]
    assert [(r.transaction_count, r.total_amount) for r in S.split_groups(got, lim).collect()] == [(3, 900000.0)]
    assert [(r.amount, r.occurrence_count, r.unique_counterparties) for r in S.smurfing(got, lim).collect()] == [(120000.0, 6, 6)]


def test_only_payees_a_month_apart_are_searched_for_repeats(spark, handed):
    rows = [("A", T0, -100, "p", "x"), ("A", T0 + timedelta(days=30), -101, "p", "x")] + [("A", T0 + timedelta(days=i), -100, f"c{i % 9}", "x") for i in range(20)]
    handed["watch"](S, "_near_a_repeat")
    assert {(r.cp, r.v) for r in S.recurring_points(book(spark, rows)).collect()} == {("p", 10000), ("p", 10100)}
    assert handed["_near_a_repeat"] == 2


def test_only_frequent_payments_are_searched_for_duplicates(spark, handed):
    cand = [("A", T0 + timedelta(hours=i), "p", 60000) for i in range(3)] + [("A", T0 + timedelta(days=i), f"c{i}", 60000 + i) for i in range(30)]
    cand += [("B", T0 + timedelta(hours=i), f"c{i}", 70000) for i in range(5)] + [("C", T0 + timedelta(days=i), f"c{i}", 70000) for i in range(5)]
    cand = spark.createDataFrame([(a, i, t, Decimal(v), cp) for i, (a, t, cp, v) in enumerate(cand)], "account_id string, seq long, ts timestamp, amount decimal(15,2), cp string")
    handed["watch"](H, "recurring_keys")
    assert [(r.account_id, r.counterparty, r.n) for r in H.exact_duplicates(cand).collect()] == [("A", "p", 3)]
    assert handed["recurring_keys"] == 3
    assert [(r.account_id, r.recipient_count, r.total_count) for r in H.amount_broadcast(cand).collect()] == [("B", 5, 5)]


def test_bursts_are_searched_near_full_hours(spark, handed):
    rows = [("A", T0 + timedelta(minutes=i), -1, "p", "x") for i in range(12)] + [("A", T0 + timedelta(days=i, minutes=1), -1, "p", "x") for i in range(1, 40)]
    lim = spark.createDataFrame([("A", 10), ("B", 50)], "account_id string, burst_rows int")
    handed["watch"](B, "by_instant")
    assert [r.transaction_count for r in V.velocity_bursts(book(spark, rows), lim).collect()] == [12]
    assert handed["by_instant"] == 12


def test_layering_looks_at_payments_near_an_income(spark, handed):
    hour = lambda h: T0 + timedelta(hours=h)
    rows = [("A", hour(70), 600000, "boss", "x")] + [("A", hour(h), -150000, cp, "x") for h, cp in ((71, "p"), (100, "q"), (141.9, "r"), (142, "s"))] + [("A", hour(142.1), -150000, "late", "x"), ("A", hour(69), -150000, "early", "x")]
    rows += [("A", hour(h), -150000, f"c{h % 5}", "x") for h in range(400, 900, 7)] + [("B", hour(h), -150000, "p", "x") for h in range(60, 160, 9)] + [("A", None, -150000, "p", "x"), ("A", None, 700000, "boss", "x"), (None, hour(70), 600000, "boss", "x")]
    prof = spark.createDataFrame([("A", "unknown"), ("B", "unknown")], "account_id string, account_type string")
    handed["watch"](B, "islands")
    got = N.layering(book(spark, rows), prof).collect()
    assert [(r.account_id, r.seq, r.outflows, r.destinations, r.total_out) for r in got] == [("A", 0, 4, 4, 600000.0)]
    assert handed["islands"] == 6


def test_a_scheme_is_worked_out_once(spark):
    extra = {"original_currency": "string", "currency": "string", "counterparty_type": "string", "type": "string", "category": "string", "is_atm": "boolean", "is_cash_operation": "boolean", "is_pension_benefit": "boolean", "is_deposit_operation": "boolean"}
    txn = book(spark, [("A", T0 + timedelta(hours=i), -5000, f"p{i % 3}", "x") for i in range(8)] + [("A", T0, 900000, "q", "наличные")])
    for name, kind in extra.items():
        txn = txn.withColumn(name, F.lit({"currency": "USD"}.get(name) if kind == "string" else False).cast(kind))
    b = Book(spark, None, txn=txn)
    for name, df in b.schemes.items():
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString(), name
    flags = sorted((r.seq, r.confidence) for r in R.pattern_flags(b.patterns, b.scheme_reasons).collect())
    assert flags == [(0, 0.72), (8, 0.5)]
