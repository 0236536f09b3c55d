"""Order-dependent operators against plain loops on small random books."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from saldoscope import session
from saldoscope.operators import base as B
from saldoscope.operators import casework as C
from saldoscope.operators import flows as W
from saldoscope.operators import structuring as S
from saldoscope.operators import velocity as V
from saldoscope.sources import csv_files, sinks, statements
from saldoscope.streaming import jobs

T0 = datetime(2024, 1, 1)
COLS = "account_id string, seq long, ts timestamp, amount decimal(15,2), counterparty string, description string"


def book(spark, rows):
    return spark.createDataFrame([(a, i, t, Decimal(v).quantize(Decimal("0.01")), cp, "x") for i, (a, t, v, cp) in enumerate(rows)], COLS)


def us(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1e6)


def test_bursts_match_a_loop(spark):
    rnd = random.Random(3)
    rows = [("A", T0 + timedelta(minutes=rnd.randrange(0, 3000)), -100, "p") for _ in range(300)]
    lim = spark.createDataFrame([("A", 8)], "account_id string, burst_rows int")
    got = V.velocity_bursts(book(spark, rows), lim).orderBy("rank_in_account").collect()
    ts, want, i = sorted(t for _, t, _, _ in rows), [], 0
    while i < len(ts):
        n = sum(1 for t in ts[i:] if t - ts[i] <= timedelta(hours=2))
        if n >= 8:
            want.append((us(ts[i]), n))
            i += n
        else:
            i += 1
    assert [(r.t, r.transaction_count) for r in got] == want[:10] and want


def test_pass_through_matches_a_loop(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(260):
        rows.append(("A", T0 + timedelta(minutes=rnd.randrange(0, 60 * 24 * 9)), rnd.choice([1, -1]) * rnd.randrange(200000, 260000), "p"))
    prof = spark.createDataFrame([("A", "unknown")], "account_id string, account_type string")
    got = {(r.seq, r.seq2) for r in W.pass_through_pairs(book(spark, rows), prof).collect()}
    items = sorted((t, i, v) for i, (_, t, v, _) in enumerate(rows))
    used, want = set(), set()
    for t, i, v in items:
        if v < 0:
            continue
        for t2, j, v2 in items:
            if v2 < 0 and j not in used and t <= t2 <= t + timedelta(hours=24) and 0.95 <= -v2 / v <= 1.05:
                used.add(j)
                want.add((i, j))
                break
    assert got == want and want


def test_recurring_points_match_a_loop(spark):
    rnd = random.Random(7)
    rows = [("A", T0 + timedelta(hours=rnd.randrange(0, 24 * 120)), -rnd.choice([0.5, 2.4, 2.47, 100, 101, 103, 104, 5000, 5149, 5151]), rnd.choice("pq")) for _ in range(250)]
    got = {(r.cp, r.t, r.v) for r in S.recurring_points(book(spark, rows)).collect()}
    pts = [(cp, us(t), round(-v * 100)) for _, t, v, cp in rows]
    want = set()
    for a in pts:
        for b in pts:
            if a[0] == b[0] and 25 <= (b[1] - a[1]) // B.DAY_US <= 35 and abs(b[2] - a[2]) / a[2] <= 0.03 + 1e-15:
                want |= {a, b}
    assert got == want and want


def test_exact_median(spark):
    rows = [("A", T0, v, "p") for v in (3, 1, 2, 10)] + [("B", T0, v, "p") for v in (5, 7, 1)]
    d = B.exact_median(book(spark, rows), ["account_id"], "amount")
    assert {r.account_id: r.median for r in d.collect()} == {"A": 2.5, "B": 5.0}


def test_rate_limit_batch_equals_stream_and_loop(spark, tmp_path):
    rnd = random.Random(9)
    rows = sorted(("U", T0 + timedelta(seconds=rnd.randrange(0, 3 * 86400)), 1, "p") for _ in range(400))
    hits = book(spark, rows).select("account_id", "seq", "ts")
    got = {r.seq: (r.allowed, r.retry_after) for r in C.rate_limit(hits, 3, 3600).collect()}
    passed, want = [], {}
    for i, (_, t, _, _) in enumerate(rows):
        passed = [p for p in passed if us(t) - p < 3600 * 10**6]
        ok = len(passed) < 3
        want[i] = (ok, 0 if ok else max(int((3600 * 10**6 - (us(t) - passed[0])) / 1e6), 1))
        if ok:
            passed.append(us(t))
    assert got == want
    src = str(tmp_path / "in")
    hits.union(hits.sparkSession.createDataFrame([("end", 9999, T0 + timedelta(days=30))], hits.schema)).coalesce(1).write.parquet(src)
    stream = jobs.rate_limit_stream(spark.readStream.schema(hits.schema).parquet(src), 3, 3600)
    q = stream.writeStream.format("memory").queryName("rl").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.seq: (r.allowed, r.retry_after) for r in spark.table("rl").collect()} == want


def test_presence_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(11)
    rows = sorted((f"u{rnd.randrange(3)}", T0 + timedelta(seconds=rnd.randrange(0, 40000))) for _ in range(300))
    d = spark.createDataFrame(rows + [("end", T0 + timedelta(days=3))], "user_id string, ts timestamp")
    src = str(tmp_path / "in")
    d.coalesce(1).write.parquet(src)
    out = jobs.presence_stream(spark.readStream.schema(d.schema).parquet(src))
    q = out.writeStream.format("memory").queryName("pr").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.online_from, r.n) for r in spark.table("pr").collect()}
    batch = C.presence(d).filter("user_id <> 'end'").select("user_id", F.to_timestamp("online_from").alias("f"), "n")
    assert got == {(r.user_id, r.f, r.n) for r in batch.collect()}


def test_layout_words_and_csv(spark, tmp_path):
    roles = statements.resolve_layout(["Күні", "Операция түрі", "Қарсы агент", "Сомасы", "Қалдық"])
    assert roles == {"date": 0, "type": 1, "counterparty": 2, "amount": 3, "balance": 4}
    assert statements.resolve_layout(["Дата", "Приход", "Расход", "Остаток"])["amount_split"]
    (tmp_path / "acc7.csv").write_text("Дата,Сумма,Контрагент\n01.02.2024,\"-1 200,50\",ТОО А\n", encoding="utf-8")
    row = csv_files.read_statements_csv(spark, str(tmp_path / "*.csv"))[0].collect()[0]
    assert row.account_id == "acc7" and row.counterparty == "ТОО А" and float(row.amount) == -1200.5


def test_replacing_one_analysis_keeps_the_other(spark, tmp_path):
    path = str(tmp_path / "txn")
    sinks.write_txn(book(spark, [("A", T0, 1, "p"), ("B", T0, 2, "p")]), path)
    sinks.write_txn(book(spark, [("B", T0, 5, "p"), ("B", T0, 6, "p")]), path)
    got = {(r.analysis_id, float(r.amount)) for r in spark.read.parquet(path).collect()}
    assert got == {("A", 1.0), ("B", 5.0), ("B", 6.0)}


def test_stored_analyses_of_many_accounts(spark, tmp_path):
    path = str(tmp_path / "analyses")
    def rows(lo, hi, score):
        return spark.range(lo, hi).select(F.concat(F.lit("A"), "id").alias("account_id"), F.lit(score).alias("composite_score"), F.lit("low").alias("risk_level"), F.lit("{}").alias("report"))
    sinks.write_analyses(rows(0, 1000, 1.0), path)
    sinks.write_analyses(rows(990, 1010, 2.0), path)
    got = {r.analysis_id: r.composite_score for r in spark.read.parquet(path).collect()}
    assert len(got) == 1010 and sum(v == 2.0 for v in got.values()) == 20 and got["A0"] == 1.0
    assert len(list((tmp_path / "analyses").glob("bucket=*"))) <= sinks.BUCKETS


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_row_order_does_not_matter(spark):
    rnd = random.Random(13)
    rows = [(rnd.choice("AB"), T0 + timedelta(hours=rnd.randrange(0, 200)), -100000 * rnd.randrange(1, 4), "p") for _ in range(120)]
    d = book(spark, rows)
    lim = spark.createDataFrame([("A", 4), ("B", 4)], "account_id string, burst_rows int")
    one, two = V.velocity_bursts(d, lim), V.velocity_bursts(d.orderBy(F.rand(1)), lim)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_monthly_repeats_look_at_near_days_only(spark, monkeypatch):
    """Payments without a partner a month off never become boxes; repeats equal all pairs."""
    rnd = random.Random(5)
    rows = [(rnd.choice("AB"), T0 + timedelta(minutes=rnd.randrange(0, 150 * 1440)), -rnd.choice([1, 2, 100, 101, 103, 104, 5000, 90000]), rnd.choice("pqr")) for _ in range(150)]
    rows += [("A", T0 + timedelta(days=d, microseconds=u), -a, "edge") for d, u, a in ((0, 0, 100), (25, -1, 100), (61, -2, 100), (200, 0, 100), (225, 0, 103), (300, 0, 100), (336, 0, 100))]
    lonely = [("C", T0 + timedelta(days=2 * i), -100 * 2 ** i, f"cp{i % 3}") for i in range(20)] + [(None, T0, -100, "p"), (None, T0 + timedelta(days=30), -100, "p")]
    asked, hits = [], S._box_hits

    def watch(points, keys, boxes, length):
        asked.extend(points.collect())
        return hits(points, keys, boxes, length)

    monkeypatch.setattr(S, "_box_hits", watch)
    got = {tuple(r) for r in S.recurring_points(book(spark, rows + lonely)).select("account_id", "cp", "t", "v").collect()}
    pts = {(a, cp, us(t), -v * 100) for a, t, v, cp in rows}
    day = 86_400_000_000
    near = lambda p, q: p[:2] == q[:2] and 25 * day <= q[2] - p[2] < 36 * day and 97 * p[3] <= 100 * q[3] <= 103 * p[3]
    want = {x for p in pts for q in pts if near(p, q) for x in (p, q)}
    assert got == want and want
    assert not [r for r in asked if r["account_id"] not in ("A", "B")]
