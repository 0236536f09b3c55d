"""Structured Streaming twins of the time-driven queries.

Every job has a watermark: a row that is older than the newest row by more than ``late`` is left out, and state
goes when the watermark has passed it. ``replayed`` and ``kept_by_id`` run a job over what a source
holds now, the first into a growing table, the second into a table with one row for each id.
"""

import uuid
import zlib
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import base as B
from ..operators.base import KEY
from ..session import checkpoint_dir, exists
from ..sources.sinks import replace_by_id


# ---- limits on hits
HITS = "account_id string, seq long, allowed boolean, retry_after long"
#: Hits that wait are packed, as they may be millions: steps of their times in order, numbers, and whether these are known.
HIT_STATE = "passed array<long>, n long, t binary, seq binary, known binary"
#: Answers handed on at a time.
ANSWERS = 100_000


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).data, 1)


def _unpacked(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), kind)


def _let_through(t: np.ndarray, passed: list, limit: int, window: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Which hits of an account pass, how many seconds the others wait, and the passed times that still count.

    From a refusal to the end of the oldest passed time's window every hit is refused, so those are answered at once.
    """
    ok, wait, i = np.zeros(len(t), "bool"), np.zeros(len(t), "int64"), 0
    while i < len(t):
        now = int(t[i])
        passed = [p for p in passed if now - p < window]
        if len(passed) < limit:
            ok[i] = True
            passed.append(now)
            i += 1
        else:
            end = int(np.searchsorted(t, passed[0] + window))
            wait[i:end] = np.maximum(((window - (t[i:end] - passed[0])) / 1e6).astype("int64"), 1)
            i = end
    return ok, wait, passed


def rate_limit_stream(hits: DataFrame, limit: int, window_s: int, late: str = "10 minutes") -> DataFrame:
    """(account_id, seq, allowed, retry_after), in append mode: a hit is answered once the watermark has passed it.

    Hits wait in the state of their account until no earlier one can come, whatever the order
    and the number of pieces they arrive in. The state also holds at most ``limit`` passed times;
    it goes when the last of them is out of the window. A hit without a time is never passed and left out.
    """
    window = window_s * 1_000_000

    def run(key, batches, state):
        # column by column, so that what is copied is gone before the next copy is made
        passed, held = [], {"t": [], "seq": [], "known": []}
        if state.exists:
            passed, _, steps, numbers, flags = state.get
            passed, held = list(passed), {"t": [_unpacked(steps, "int64").cumsum()], "seq": [_unpacked(numbers, "int64")], "known": [_unpacked(flags, "bool")]}
            steps = numbers = flags = None
        for pdf in batches:
            for c, parts in held.items():
                parts.append(pdf[c].to_numpy(parts[0].dtype if parts else None, copy=True))
        new = len(held["t"]) > 1 or not state.exists
        t, seq, known = (np.concatenate(held.pop(c) or [np.zeros(0, kind)]) for c, kind in (("t", "int64"), ("seq", "int64"), ("known", "bool")))
        if new:
            order = np.lexsort((seq, known, t))
            t = t[order]
            seq = seq[order]
            known = known[order]
            order = None
        mark = state.getCurrentWatermarkMs() * 1000
        ready = int(np.searchsorted(t, mark))
        ok, wait, passed = _let_through(t[:ready], passed, limit, window)
        passed, last = [p for p in passed if mark - p < window], ready < len(t)
        if last or passed:
            state.update((passed, len(t) - ready, _packed(np.diff(t[ready:], prepend=0)), _packed(seq[ready:]), _packed(known[ready:])))
            state.setTimeoutTimestamp(max((int(t[ready]) if last else passed[-1] + window) // 1000, mark // 1000 + 1))
        elif state.exists:
            state.remove()  # nothing of the account matters any more
        t = None
        for i in range(0, ready, ANSWERS):
            part = slice(i, min(i + ANSWERS, ready))
            number = seq[part] if known[part].all() else pd.Series(seq[part], dtype="Int64").mask(~known[part]).to_numpy(dtype="object", na_value=None)
            yield pd.DataFrame({"account_id": key[0], "seq": number, "allowed": ok[part], "retry_after": wait[part]})

    rows = hits.where("ts is not null").withWatermark("ts", late)
    rows = rows.select("account_id", F.coalesce("seq", F.lit(0)).alias("seq"), F.col("seq").isNotNull().alias("known"), "ts", F.unix_micros("ts").alias("t"))
    return rows.groupBy("account_id").applyInPandasWithState(run, HITS, HIT_STATE, "append", "EventTimeTimeout")


# ---- presence and progress
def presence_stream(activity: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    d = activity.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return d.select("user_id", F.col("w.start").alias("online_from"), F.col("w.end").alias("offline_at"), "n")


STEPS = "session_id string, step string, ts timestamp"
STEP_STATE = "step string, t long, seq long"


def latest_progress_stream(steps: DataFrame, late: str = "10 minutes", idle_s: int = 86_400) -> DataFrame:
    """(session_id, step, ts), in update mode: the latest step of every session with new rows.

    A session that was quiet for ``idle_s`` behind the watermark leaves the state.
    """
    def run(key, batches, state):
        best = state.get if state.exists and not state.hasTimedOut else None
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in batches:
            top = max(zip(pdf["t"].tolist(), pdf["seq"].tolist(), pdf["step"].tolist()))
            if best is None or top > (best[1], best[2], best[0]):
                best = (top[2], top[0], top[1])
        state.update(tuple(best))
        state.setTimeoutTimestamp(max(best[1] // 1000, state.getCurrentWatermarkMs()) + idle_s * 1000)
        yield pd.DataFrame([(key[0], best[0], pd.Timestamp(best[1] * 1000))], columns=["session_id", "step", "ts"])

    rows = steps.withWatermark("ts", late).select(F.col("session_id").cast("string").alias("session_id"), "step", "seq", "ts", F.unix_micros("ts").alias("t"))
    return rows.groupBy("session_id").applyInPandasWithState(run, STEPS, STEP_STATE, "update", "EventTimeTimeout")


# ---- windows over transactions
def daily_counts(txn: DataFrame, late: str = "1 day") -> DataFrame:
    """(account_id, start, n, income, expense) of each day; as a stream, days that are over."""
    g = txn.withWatermark("ts", late).groupBy(KEY, F.window("ts", "1 day").alias("w"))
    money = B.cents("amount")
    out = g.agg(F.count("*").alias("n"), F.sum(F.greatest(money, F.lit(0))).alias("plus"), F.sum(F.greatest(-money, F.lit(0))).alias("minus"))
    return out.select(KEY, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (F.col("plus") / 100.0).alias("income"), (F.col("minus") / 100.0).alias("expense"))


#: Accounts share the state of their group, as a call for each account would cost more than its rows.
ACCOUNT_GROUPS = 4096
SLOTS = "part int, account_id string, slot long, t long, n long, paid long, s long"
SLOT_STATE = "done long, accounts array<string>, code array<long>, slot array<long>, n array<long>, paid array<long>, s array<long>"
BURSTS = "account_id string, w long, n long, s long"


def _full_windows(d: pd.DataFrame, width: int, step: int, least: int) -> pd.DataFrame:
    """(code, w, n, paid, s) of the windows with ``least`` rows; ``d`` are slots (code, slot, n, paid, s) in order.

    Accounts follow each other on one line, further apart than a window reaches.
    """
    code, slot = d["code"].to_numpy(), d["slot"].to_numpy()
    if not len(d):
        return d.rename(columns={"slot": "w"})
    base = slot.min() - width - step
    span = slot.max() - base + width + step
    at = code * span + slot - base
    upto = np.vstack((np.zeros(3, dtype="int64"), d[["n", "paid", "s"]].to_numpy().cumsum(axis=0)))
    # no window whose first slot this is has more rows
    near = upto[np.searchsorted(at, at + width), 0] - upto[:-1, 0] >= least
    starts = slot[near][:, None] // step * step - np.arange(-(-width // step)) * step
    starts = np.unique(code[near][:, None] * span + starts - base)
    sums = upto[np.searchsorted(at, starts + width)] - upto[np.searchsorted(at, starts)]
    full = sums[:, 0] >= least
    starts, sums = starts[full], sums[full]
    return pd.DataFrame({"code": starts // span, "w": starts % span + base, "n": sums[:, 0], "paid": sums[:, 1], "s": sums[:, 2]})


def burst_counts(txn: DataFrame, width: str = "2 hours", step: str = "10 minutes", least: int = 8, late: str = "30 minutes") -> DataFrame:
    """(account_id, start, n, total): windows of ``width``, one every ``step``, with ``least`` rows or more.

    Windows overlap, but the slots between their edges do not: a row is counted in one slot, before the
    shuffle as well, and the state of a stream holds the slots that an open window may need. A
    window is given once the watermark has passed its end; a late row still counts in windows that are open.
    """
    money = F.abs(B.cents("amount"))
    if not txn.isStreaming:
        out = txn.groupBy(KEY, F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.sum(money).alias("s")).where(F.col("n") >= least)
        return out.select(KEY, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (F.col("s") / 100.0).alias("total"))
    wide, pace = (pd.Timedelta(x) // pd.Timedelta(microseconds=1) for x in (width, step))
    size = gcd(wide, pace)
    reach, pace = wide // size, pace // size  # in slots
    held_columns = ["code", "slot", "n", "paid", "s"]

    def collapse(batches):
        for d in batches:
            slots = d.assign(slot=d["t"] // size).groupby(["part", KEY, "slot"], dropna=False, as_index=False, sort=False)
            yield slots.agg({"t": "max", "n": "sum", "paid": "sum", "s": "sum"})

    def run(key, batches, state):
        mark = state.getCurrentWatermarkMs() * 1000
        done, accounts, held = mark, [], pd.DataFrame({c: np.array([], dtype="int64") for c in held_columns})
        if state.exists:
            done, accounts, *columns = state.get
            held = pd.DataFrame({c: np.array(v, dtype="int64") for c, v in zip(held_columns, columns)})
        over = _full_windows(held, reach, pace, least)
        end = (over["w"] + reach) * size
        over = over[(end > done) & (end <= mark)]
        if len(over):
            named = pd.Series(accounts, dtype="object").take(over["code"]).to_numpy()
            yield pd.DataFrame({"account_id": named, "w": over["w"].to_numpy() * size, "n": over["n"].to_numpy(), "s": over["s"].astype("Int64").mask(over["paid"] == 0).to_numpy(dtype="object")})
        last = lambda d: (d["slot"] // pace * pace + reach) * size
        held = held[last(held) > mark]
        new = [d for d in batches] if not state.hasTimedOut else []
        new = pd.concat([pd.DataFrame({"account_id": pd.Series(accounts, dtype="object").take(held["code"]).to_numpy(), **{c: held[c].to_numpy() for c in held_columns[1:]}}), *[d[["account_id", *held_columns[1:]]] for d in new]])
        new = new[last(new) > mark]
        if len(new):
            code, names = pd.factorize(new["account_id"].to_numpy(dtype="object"), use_na_sentinel=False)
            held = new.assign(code=code)[held_columns].astype("int64").groupby(["code", "slot"], as_index=False).sum()
            ends = (_full_windows(held, reach, pace, least)["w"] + reach) * size
            ends = ends[ends > mark]
            state.update((mark, [x if isinstance(x, str) else None for x in names], *[held[c].tolist() for c in held_columns]))
            # fires once the watermark is later than this
            state.setTimeoutTimestamp(max(int(ends.min() if len(ends) else last(held).max()) // 1000 - 1, mark // 1000))
        elif state.exists:
            state.remove()

    rows = txn.where(F.col("ts").isNotNull()).select(F.pmod(F.xxhash64(KEY), F.lit(ACCOUNT_GROUPS)).cast("int").alias("part"), KEY, F.unix_micros("ts").alias("t"), F.lit(1).cast("long").alias("n"),
                                                     F.col("amount").isNotNull().cast("long").alias("paid"), F.coalesce(money, F.lit(0)).alias("s"))
    # the last window of a row ends up to ``width`` after it: rows are late only when that has passed
    slots = rows.mapInPandas(collapse, SLOTS).withColumn("ts", F.timestamp_micros(F.col("t") + wide)).withWatermark("ts", f"{wide} microseconds {late}")
    out = slots.groupBy("part").applyInPandasWithState(run, BURSTS, SLOT_STATE, "append", "EventTimeTimeout")
    return out.select(KEY, F.timestamp_micros("w").alias("start"), F.timestamp_micros(F.col("w") + wide).alias("end"), "n", (F.col("s") / 100.0).alias("total"))


def split_payments(txn: DataFrame, limits: DataFrame, late: str = "1 day", least: int = 3, share: float = 0.8) -> DataFrame:
    """(id, account_id, counterparty, day, n, total): payments to one payee on one day that add up to most of the threshold.

    In update mode, so a group shows as soon as it is large enough, and again when it grows.
    Rows that a source delivers twice within the watermark count once.
    """
    rows = txn.withWatermark("ts", late).dropDuplicatesWithinWatermark([KEY, "seq"]).where("amount < 0")
    g = rows.groupBy(KEY, B.cp_desc().alias("counterparty"), F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum(F.abs(B.cents("amount"))).alias("s"))
    g = g.where(F.col("n") >= least).join(limits.select(KEY, "threshold"), KEY).where(F.col("s") >= F.col("threshold") * 100 * share)
    day = F.date_format("w.start", "yyyy-MM-dd")
    return g.select(F.to_json(F.array(KEY, day, "counterparty")).alias("id"), KEY, "counterparty", day.alias("day"), "n", (F.col("s") / 100.0).alias("total"))


# ---- running a job
def _finish(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def source(frame: DataFrame, folder: str) -> DataFrame:
    """The files of a folder as a stream; a frame with its columns gives the schema."""
    return frame.sparkSession.readStream.schema(frame.schema).parquet(folder)


def stored(frame: DataFrame) -> str:
    """Write a frame to a folder of its own below the shared one, for a stream to read."""
    folder = f"{checkpoint_dir(frame.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    frame.write.parquet(f"{folder}/in")
    return folder


def replayed(stream: DataFrame, folder: str) -> DataFrame:
    """Everything an append-mode job gives for what its source holds now; going on later adds to it."""
    _finish(stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def kept_by_id(stream: DataFrame, folder: str, key: str) -> DataFrame:
    """The table of an update-mode job: a row takes the place of the stored one with its id, so a
    batch that runs a second time after a restart changes nothing."""
    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            replace_by_id(batch, f"{folder}/table", key)

    _finish(stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    spark = stream.sparkSession
    if not exists(spark, f"{folder}/table"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{folder}/table").select(*stream.columns)
