"""Streams against their batch twins: several batches, rows out of order, late rows, restarts."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from saldoscope.operators import casework as C
from saldoscope.streaming import jobs

T0 = datetime(2024, 1, 1)
TXN = "account_id string, seq long, ts timestamp, amount double, counterparty string, description string, merchant_name string"


def txn(spark, rows):
    return spark.createDataFrame([(a, i, t, v, c, None, None) for a, i, t, v, c in rows], TXN)


def random_rows(seed, n, days=6):
    rnd = random.Random(seed)
    return [(rnd.choice("ABBBB"), i, T0 + timedelta(seconds=rnd.randrange(days * 86400)), float(rnd.choice([-900000, -400000, -5, 7])), rnd.choice("pq")) for i in range(n)]


class Feed:
    """A folder that gets one file a step; the job goes on from its checkpoint each time."""

    def __init__(self, spark, path, job, run, schema=TXN):
        self.spark, self.folder, self.job, self.run = spark, str(path), job, run
        self.empty, self.steps = spark.createDataFrame([], schema), 0

    def add(self, frame):
        frame.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        return self.run(self.job(jobs.source(self.empty, f"{self.folder}/in")), self.folder)


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_daily_counts_close_with_the_watermark(spark, tmp_path):
    rows = sorted(random_rows(1, 400), key=lambda r: r[2])
    feed = Feed(spark, tmp_path, jobs.daily_counts, jobs.replayed)
    for part in (rows[:150], rows[150:280], rows[280:]):
        random.Random(2).shuffle(part)
        out = feed.add(txn(spark, part))
    batch = jobs.daily_counts(txn(spark, rows))
    newest = max(r[2] for r in rows)
    assert as_rows(out) == as_rows(batch.where(F.col("end") <= F.lit(newest - timedelta(days=1)))) and out.count() > 3
    # a day that is over is not opened again
    again = feed.add(txn(spark, [("A", 10_000, T0, 5.0, "p"), ("A", 10_001, newest + timedelta(days=30), 5.0, "p")]))
    assert as_rows(again) == as_rows(batch)


@pytest.mark.parametrize("late", ["30 minutes", "3 hours"])
def test_bursts_equal_batch_and_loop(spark, tmp_path, late):
    rows = sorted(random_rows(3, 700, days=2), key=lambda r: r[2])
    job = lambda d: jobs.burst_counts(d, late=late)
    feed = Feed(spark, tmp_path, job, jobs.replayed)
    for part in (rows[:300], rows[300:310], rows[310:]):
        out = feed.add(txn(spark, part[::-1]))
    newest = max(r[2] for r in rows)
    over = newest - (timedelta(minutes=30) if late == "30 minutes" else timedelta(hours=3))
    want = defaultdict(list)
    for a, _, t, v, _ in rows:
        first = t - timedelta(seconds=(t - T0).total_seconds() % 600)
        for k in range(12):
            want[(a, first - timedelta(minutes=10 * k))].append(abs(v))
    want = sorted((a, s, s + timedelta(hours=2), len(v), sum(v)) for (a, s), v in want.items() if len(v) >= 8)
    assert as_rows(job(txn(spark, rows))) == want
    assert as_rows(out) == [w for w in want if w[2] <= over] and len(want) > 20


def test_bursts_hold_slots_instead_of_windows(spark, tmp_path):
    rows = [(a, i, T0 + timedelta(minutes=13 * i), v, "p") for a, v in (("A", 1.0), (None, -2.0), ("C", None)) for i in range(60)]
    rows += [(a, 100 + i, T0 + timedelta(hours=3, seconds=i), v, "p") for a, v in (("A", 1.0), (None, -2.0), ("C", None)) for i in range(9)]
    frame = txn(spark, rows)
    frame.write.parquet(f"{tmp_path}/in")
    stream = jobs.burst_counts(jobs.source(frame, f"{tmp_path}/in"))
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators) <= 3
    over = max(r[2] for r in rows) - timedelta(minutes=30)
    key = lambda r: (str(r[0]), r[1])
    want = jobs.burst_counts(frame).where(F.col("end") <= F.lit(over)).collect()
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key) and len(want) > 30


def test_splits_are_put_in_place_by_id(spark, tmp_path):
    limits = spark.createDataFrame([("A", 1_000_000.0), ("B", 2_000_000.0)], "account_id string, threshold double")
    job = lambda d: jobs.split_payments(d, limits, late="2 days")
    feed = Feed(spark, tmp_path, job, lambda s, folder: jobs.kept_by_id(s, folder, "id"))
    rows = sorted(random_rows(5, 120), key=lambda r: r[2])
    for part in (rows[:50], rows[45:90], rows[88:]):  # some rows come twice
        out = feed.add(txn(spark, part))
    want = defaultdict(list)
    for a, _, t, v, c in rows:
        if v < 0:
            want[(a, c, f"{t:%Y-%m-%d}")].append(-v)
    want = sorted((*k, len(v), sum(v)) for k, v in want.items() if len(v) >= 3 and sum(v) >= 0.8 * (1_000_000 if k[0] == "A" else 2_000_000))
    assert as_rows(out.drop("id")) == want and len(want) > 5
    # a restart without new rows, and a restart that repeats the last batch
    stream = job(jobs.source(feed.empty, f"{feed.folder}/in"))
    assert as_rows(jobs.kept_by_id(stream, feed.folder, "id").drop("id")) == want
    last = max(p.name for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit() and len(p.name) < 5)
    for name in (last, f".{last}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    assert as_rows(jobs.kept_by_id(job(jobs.source(feed.empty, f"{feed.folder}/in")), feed.folder, "id").drop("id")) == want
    # a row older than the watermark is left out
    assert as_rows(feed.add(txn(spark, [("A", 9999, T0 - timedelta(days=9), -9e6, "p")])).drop("id")) == want


def test_hits_out_of_order_in_many_chunks(spark, tmp_path):
    rnd = random.Random(9)
    rows = [("U", i, T0 + timedelta(seconds=rnd.randrange(3 * 86400)), 1.0, "p") for i in range(900)]
    rows = sorted(rows, key=lambda r: r[2])
    rows = [("V" if i % 7 == 0 else "U", *r[1:]) for i, r in enumerate(rows)]
    end = [("end", 5000, T0 + timedelta(days=40), 1.0, "p")]
    job = lambda d: jobs.rate_limit_stream(d.select("account_id", "seq", "ts"), 3, 3600)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        feed = Feed(spark, tmp_path, job, jobs.replayed)
        for part in (rows[:300], rows[300:500], rows[500:], end):
            rnd.shuffle(part)
            out = feed.add(txn(spark, part))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batch = C.rate_limit(txn(spark, rows).select("account_id", "seq", "ts"), 3, 3600)
    assert as_rows(out) == as_rows(batch.select("account_id", "seq", "allowed", "retry_after"))
    # old accounts leave the state: only the end's hit is still there
    feed.add(txn(spark, [("end", 5001, T0 + timedelta(days=80), 1.0, "p")]))
    state = spark.read.format("statestore").load(str(tmp_path / "checkpoint")).select("key.account_id").distinct().collect()
    assert [r.account_id for r in state] == ["end"]


def test_waiting_hits_are_packed_and_answered_alike(spark, tmp_path, monkeypatch):
    rnd = random.Random(11)
    rows = [(rnd.choice("UUUV"), i, T0 + timedelta(seconds=rnd.randrange(4 * 86400) // 7 * 7), 1.0, "p") for i in range(4000)]
    rows += [("U", 9_007_199_254_740_993 + i, T0 + timedelta(hours=i), 1.0, "p") for i in range(3)] + [(None, 4003 + i, T0 + timedelta(minutes=i), 1.0, "p") for i in range(9)]
    odd = [("U", None, T0 + timedelta(days=5, minutes=i), 1.0, "p") for i in range(5)] + [("U", 5000, None, 1.0, "p")]
    monkeypatch.setattr(jobs, "ANSWERS", 100, raising=False)
    job = lambda d: jobs.rate_limit_stream(d.select("account_id", "seq", "ts"), 3, 3600, late="10 days")
    feed = Feed(spark, tmp_path, job, jobs.replayed)
    assert feed.add(txn(spark, rows[:2500])).count() == 0
    assert feed.add(txn(spark, rows[2500:] + odd)).count() == 0
    state = {r.account_id: r for r in spark.read.format("statestore").load(str(tmp_path / "checkpoint")).select("key.account_id", "value.groupState.*").collect()}
    assert set(state) == {"U", "V", None} and sum(r.n for r in state.values()) == len(rows) + 5
    assert sum(len(r.t) + len(r.seq) + len(r.known) for r in state.values()) < 8 * len(rows)
    out = feed.add(txn(spark, [("end", 1, T0 + timedelta(days=40), 1.0, "p")]))
    got = sorted([(str(r[0]), *r[1:]) for r in out.collect()], key=str)
    batch = C.rate_limit(txn(spark, rows + [("U", 10_000 + i, r[2], 1.0, "p") for i, r in enumerate(odd[:5])]).na.fill("None", ["account_id"]).select("account_id", "seq", "ts"), 3, 3600)
    want = [(r.account_id, None if 10_000 <= r.seq < 10_005 else r.seq, r.allowed, r.retry_after) for r in batch.collect()]
    assert got == sorted(want, key=str)


def test_latest_progress_forgets_quiet_sessions(spark, tmp_path):
    rnd = random.Random(4)
    schema = "session_id long, step string, ts timestamp, seq long"
    rows = [(rnd.randrange(5), f"s{i}", T0 + timedelta(seconds=rnd.randrange(3000) + 1000 * (i // 100)), i) for i in range(300)]
    feed = Feed(spark, tmp_path, lambda d: jobs.latest_progress_stream(d, late="1 hour"), lambda s, folder: jobs.kept_by_id(s, folder, "session_id"), schema)
    for k in (0, 100, 200):
        out = feed.add(spark.createDataFrame(rows[k:k + 100], schema))
    batch = C.latest_progress(spark.createDataFrame(rows, schema)).select(F.col("session_id").cast("string").alias("session_id"), "step")
    assert as_rows(out.select("session_id", "step")) == as_rows(batch)
    feed.add(spark.createDataFrame([(77, "x", T0 + timedelta(days=9), 1)], schema))
    feed.add(spark.createDataFrame([(77, "y", T0 + timedelta(days=9, hours=1), 2)], schema))
    state = spark.read.format("statestore").load(str(tmp_path / "checkpoint")).select("key.session_id").distinct().collect()
    assert [r.session_id for r in state] == ["77"]
