"""Readers work out the date and the amount of a row once, whatever filter follows."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from saldoscope.sources import statements as R


def text_work_below_a_filter(df):
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return [x for x in lines if "Filter" in x and ("regexp" in x or "gettimestamp" in x)]


def test_dates_of_any_shape(spark):
    want = {"05.01.2024": (2024, 1, 5), "05/01/2024 10:00": (2024, 1, 5), "05.01.24": (2024, 1, 5), "05.01.68": (2068, 1, 5), "29.02.72": (1972, 2, 29), "31.12.99": (1999, 12, 31), "2024-01-05T1": (2024, 1, 5),
            "29.02.2023": (2020, 2, 29), "45.01.2024": None, "2023-02-30": None, "x": None, "": None, None: None}
    got = spark.createDataFrame([(k,) for k in want], "c string").select("c", R.parse_date_any(F.col("c")).alias("ts")).collect()
    assert {r.c: r.ts and (r.ts.year, r.ts.month, r.ts.day) for r in got} == want


def test_amounts_of_any_shape(spark):
    want = {"- 1 400,00 ₸": "-1400.00", "1,234.50": "1234.50", "списано 7": "-7.00", "1.2.3": "0.00", ",": "0.00", "-": "0.00", "": "0.00", None: "0.00", "-0,00": "0.00", "5,": "5.00", "9" * 40: "0.00"}
    got = spark.createDataFrame([(k,) for k in want], "c string").select("c", R.parse_amount_any(F.col("c")).alias("v")).collect()
    assert {r.c: r.v for r in got} == {k: Decimal(v) for k, v in want.items()}


def test_cells_are_parsed_once(spark):
    raw = spark.createDataFrame([("a", 1, ["2024-01-05", "shop", "", "7.50", "0"]), ("a", 2, ["", "shop", "1", "", "0"]), ("a", 3, ["05.01.24", "shop", "", "", "0"])], "account_id string, seq long, cells array<string>")
    got = R.rows_to_txn(raw, R.resolve_layout(["Дата", "Описание", "Приход", "Расход", "Остаток"]))
    assert [(r.seq, r.ts, r.amount) for r in got.collect()] == [(1, datetime.datetime(2024, 1, 5), Decimal("-7.50"))]
    assert not text_work_below_a_filter(got)


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("a", 1, " 05.01.2024 n 7,77 -1400,00"), ("a", 2, "no date 1,00"), ("a", 3, "05.01.2024 none"), ("a", 4, "05.01.2024 0,00"), ("a", 5, None)], "account_id string, seq long, line string")
    got = R.text_to_txn(lines)
    assert [(r.seq, r.amount, r.description) for r in got.collect()] == [(1, Decimal("-1400.00"), "n 7,77 -1400,00")]
    assert not text_work_below_a_filter(got)


def test_ledger_rows_are_parsed_once(spark):
    row = lambda d, credit, debit, fee="": [d, "", "Оплата услуг Связь", "", "", credit, debit, fee, "*1"]
    raw = spark.createDataFrame([("a", 1, row("05.01.2024", "1 400,00", "")), ("a", 2, row("05.01.72", "", "-7,5")), ("a", 3, row("", "1", "")), ("a", 4, row("05.01.2024", "", "")), ("a", 5, row("5.1.24", "1", "")), ("a", 6, row("05.01.2024", "", "", "3"))],
                                "account_id string, seq long, cells array<string>")
    got = R.map_rows_ledger(raw)
    assert sorted((r.seq, r.ts.year, r.amount, r.type) for r in got.collect()) == [(1, 2024, Decimal("1400.00"), "expense"), (2, 1972, Decimal("-7.50"), "expense"), (6, 2024, Decimal("3.00"), "fee")]
    assert not text_work_below_a_filter(got)
