"""CSV files that hold several accounts, and how many files the book is printed to."""

import os
from datetime import datetime
from decimal import Decimal
from types import SimpleNamespace

from saldoscope.catalog import cases
from saldoscope.sources import csv_files


def test_a_column_names_the_account(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Date,Amount,Account no\n2024-01-05,10.00,A1\n2024-01-06,bad,A2\n2024-01-07,"1,5", A2 \n2024-01-08,2.00,\n', encoding="utf-8")
    (tmp_path / "y.csv").write_text("Date,Amount,Text\n2024-01-05,3.00,t\n", encoding="utf-8")
    txn, rejects = csv_files.read_statements_csv(spark, str(tmp_path), "Account no")
    got = sorted((r.account_id, r.amount, r.description) for r in txn.collect())
    assert got == [("A1", Decimal("10.00"), ""), ("A2", Decimal("1.50"), ""), ("x", Decimal("2.00"), ""), ("y", Decimal("3.00"), "t")]
    assert [(r.account_id, r.reason) for r in rejects.collect()] == [("A2", "no date or amount in the row")]


def test_files_do_not_grow_with_accounts(spark):
    rows = [(f"C{i}", i % 3 if i % 7 else None, datetime(2024, 1, 1 + i % 28), Decimal(i % 5 - 2), ' "a" ,;' if i % 2 else None, "x|\ty") for i in range(400)]
    rows.append((None, 1, datetime(2024, 1, 1), Decimal(3), None, "y"))
    txn = spark.createDataFrame(rows * 2, "account_id string, seq long, ts timestamp, amount decimal(15,2), counterparty string, description string")
    book = SimpleNamespace(spark=spark, txn=txn)
    folder = cases.csv_folder(book)
    assert sum(f.endswith(".csv") for _, _, files in os.walk(folder.removeprefix("file:")) for f in files) <= 16
    out = cases.csv_statements(book).collect()
    assert len(out) == 802 and sum(r.place == 0 for r in out) == 2 * sum(r[3] == 0 for r in rows)
    good = {(r.account_id, r.place): r for r in out if r.place}
    assert set(good) == {(r[0] or cases.NO_ACCOUNT, p) for r in rows if r[3] for p in (1, 2)}
    assert {r.counterparty for r in good.values()} == {'"a" ,;', None}
