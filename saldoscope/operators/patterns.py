"""Six named schemes, looked for on all rows (the whitelist does not apply here)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import keywords as K
from ..config.limits import LAYERING_FLOOR
from ..session import durable
from . import base as B
from .base import KEY


def _out():
    return F.col("amount") < 0


def _a():
    return B.dbl(F.abs("amount"))


def foreign_currency():
    orig, cur = F.col("original_currency"), F.col("currency")
    return (F.when((orig != "") & ~orig.isin("KZT", "KZT "), orig).when((cur != "") & ~cur.isin("KZT", "₸"), cur))


def is_person():
    """Private person: a name without company words and the class ``person``; names of up to
    four words count when no class is known."""
    cp = F.upper(B.cp_strict())
    kind = F.col("counterparty_type")
    by_kind = F.lower(kind).isin("person", "individual", "физлицо")
    by_length = F.size(F.filter(F.split(cp, r"\s+"), lambda w: w != "")) <= 4
    return (cp != "") & ~B.has_any(cp, K.NOT_A_PERSON) & F.when(kind.isNotNull(), by_kind).otherwise(by_length)


def layering(txn: DataFrame, prof: DataFrame, hours: int = 72) -> DataFrame:
    """Large income spread over several payees within 72 hours.

    For every income instant the number of payments, their sum and the number of payees in
    the window are read from one timeline of running totals. A payee counts from 72 hours
    before its first payment of a run until the last one, so payees are counted by starts
    and ends of runs and no income-payment pair is formed. Payments travel only where they lie
    in the slot of 72 hours of such an income or in the next one, which no window leaves.
    """
    width = hours * B.HOUR_US
    inc = txn.filter(F.col("amount") >= LAYERING_FLOOR).select(KEY, "seq", B.us().alias("t"), B.dbl("amount").alias("income"))
    slot = F.floor(F.col("t") / F.lit(width))
    near = durable(inc.select(KEY, F.explode(F.array(slot, slot + 1)).alias("_slot")).distinct())
    outs = txn.filter(_out()).select(KEY, "ts", F.floor(B.us() / F.lit(width)).alias("_slot"), F.abs("amount").alias("a"), B.cp_strict().alias("cp"))
    outs = outs.join(near, [KEY, "_slot"], "left_semi").drop("_slot")
    inst = outs.groupBy(KEY, "cp", B.us().alias("t")).agg(F.count("*").alias("n"), F.sum(B.cents("a")).alias("s"))
    runs = B.islands(inst.filter("cp <> ''").select(KEY, "cp", "t"), [KEY, "cp"], width).groupBy(KEY, "cp", "run").agg(F.max("t").alias("last"))
    money = inst.schema["s"].dataType
    zero_n, zero_s, none = F.lit(0).cast("long"), F.lit(0).cast(money), F.lit(None).cast("long")

    def mark(at, kind, n, s, u, t0):
        return F.struct(at.alias("t"), F.lit(kind).alias("kind"), n.alias("n"), s.alias("s"), F.lit(u).cast("long").alias("u"), t0.alias("t0"))

    points = inst.groupBy(KEY, "t").agg(F.sum("n").alias("n"), F.sum("s").cast(money).alias("s")).select(
        KEY, mark(F.col("t"), 2, F.col("n"), F.col("s"), 0, none).alias("m"))
    edges = runs.select(KEY, F.explode(F.array(
        mark(F.col("run") - F.lit(width), 0, zero_n, zero_s, 1, none), mark(F.col("last"), 3, zero_n, zero_s, -1, none))).alias("m"))
    asks = inc.select(KEY, "t").distinct().select(KEY, F.explode(F.array(
        mark(F.col("t"), 1, zero_n, zero_s, 0, F.col("t")), mark(F.col("t") + F.lit(width), 4, zero_n, zero_s, 0, F.col("t")))).alias("m"))
    line = points.unionByName(edges).unionByName(asks).select(KEY, "m.*")
    line = B.sliced_cumsum(line, [KEY], "t", ["t", "kind"], {"cn": F.col("n"), "cs": F.col("s"), "cu": F.col("u")})
    at, end = F.col("kind") == 1, F.col("kind") == 4
    got = line.filter(at | end).groupBy(KEY, F.col("t0").alias("t")).agg(
        (F.max(F.when(end, F.col("cn"))) - F.max(F.when(at, F.col("cn")))).alias("outflows"),
        ((F.max(F.when(end, F.col("cs"))) - F.max(F.when(at, F.col("cs")))) / 100.0).alias("total_out"),
        F.max(F.when(at, F.col("cu"))).alias("destinations"))
    d = inc.join(got.filter("outflows >= 3 and destinations >= 3"), [KEY, "t"]).join(prof.select(KEY, "account_type"), KEY)
    d = d.withColumn("coverage", F.col("total_out") / F.col("income")).filter("coverage >= 0.70")
    less = F.when(F.col("account_type") == "business_owner", 0.35).when(F.col("account_type") == "freelancer", 0.30).when(
        F.col("account_type") == "salary_employee", 0.20).otherwise(0.0)
    conf = F.least(F.lit(0.90), F.lit(0.50) + F.col("coverage") * 0.40) - less - F.when(F.col("destinations") < 5, 0.15).otherwise(0.0)
    d = d.withColumn("raw", conf).filter(F.col("raw") >= 0.15)
    return d.select(KEY, "seq", B.stamp_us("t").alias("income_at"), F.col("income").alias("income_amount"), "outflows", "destinations", "total_out",
                    B.py_round(F.col("raw"), 2).alias("confidence"), B.py_round(F.col("raw") * 85, 1).alias("contribution"))


def structuring_pattern(txn: DataFrame, lim: DataFrame) -> DataFrame:
    t = F.col("threshold")
    hit = txn.filter(_out()).join(lim.select(KEY, "threshold"), KEY).filter((_a() >= t * 0.90) & (_a() < t))
    g = hit.groupBy(KEY).agg(F.count("*").alias("n"), F.min("seq").alias("seq")).filter("n >= 2")
    conf = F.least(F.lit(0.85), F.col("n") * 0.15)
    return g.select(KEY, "seq", "n", B.py_round(conf, 2).alias("confidence"), B.py_round(conf * 70, 1).alias("contribution"))


def structuring_evidence(txn: DataFrame, lim: DataFrame, k: int = 10) -> DataFrame:
    t = F.col("threshold")
    hit = txn.filter(_out()).join(lim.select(KEY, "threshold"), KEY).filter((_a() >= t * 0.90) & (_a() < t))
    return B.topk(hit, [KEY], ["seq"], k).select(KEY, "rank_in_account", "seq", _a().alias("amount"))


def carding(txn: DataFrame, gap_hours: int = 2, least: int = 5, below: int = 10000) -> DataFrame:
    """Chains of small payments in foreign currency."""
    rows = txn.filter(_out() & (F.abs("amount") < below) & foreign_currency().isNotNull()).select(
        KEY, B.us().alias("t"), F.abs("amount").alias("a"), B.cp_strict().alias("cp"), "seq")
    runs = B.islands(rows.select(KEY, "t").distinct(), [KEY], gap_hours * B.HOUR_US)
    per = rows.join(runs, [KEY, "t"]).groupBy(KEY, "run", "cp").agg(F.count("*").alias("n"), F.sum("a").alias("s"), F.min("seq").alias("seq"))
    g = per.groupBy(KEY, "run").agg(F.sum("n").alias("n"), F.count("*").alias("merchants"), F.sum("s").cast("double").alias("total_amount"), F.min("seq").alias("seq"))
    conf = F.least(F.lit(0.85), F.lit(0.40) + F.col("n") * 0.04)
    return g.filter(F.col("n") >= least).select(KEY, "seq", B.stamp_us("run").alias("started_at"), "n", "merchants", "total_amount",
                                                B.py_round(conf, 2).alias("confidence"), B.py_round(conf * 75, 1).alias("contribution"))


def pyramid(txn: DataFrame) -> DataFrame:
    """Many small payments from people, then one large one out to a person."""
    people = txn.filter(is_person()).select(KEY, "seq", "amount", B.cp_strict().alias("cp"))
    per = people.filter("amount > 0 and amount < 200000").groupBy(KEY, "cp").agg(F.sum("amount").alias("s"))
    inflow = per.groupBy(KEY).agg(F.count("*").alias("payers"), F.sum("s").cast("double").alias("total_in")).filter("payers >= 5")
    big = people.filter(_out()).join(inflow, KEY).filter(_a() > F.col("total_in") * 0.50)
    g = big.groupBy(KEY, "payers", "total_in").agg(F.min("seq").alias("seq"), F.min_by(_a(), "seq").alias("outflow"))
    conf = F.least(F.lit(0.75), F.lit(0.35) + F.col("payers") * 0.04)
    return g.select(KEY, "seq", "payers", "total_in", "outflow", B.py_round(conf, 2).alias("confidence"), B.py_round(conf * 65, 1).alias("contribution"))


def many_payouts(txn: DataFrame, prof: DataFrame) -> DataFrame:
    """Many middling payments to many people; employers are left out."""
    rows = txn.filter(_out() & F.abs("amount").between(10000, 100000) & is_person()).join(
        prof.filter("account_type <> 'business_owner'").select(KEY), KEY, "left_semi")
    per = rows.groupBy(KEY, B.cp_strict().alias("cp")).agg(F.count("*").alias("n"), F.sum(F.abs("amount")).alias("s"), F.min("seq").alias("seq"))
    g = per.groupBy(KEY).agg(F.sum("n").alias("n"), F.count("*").alias("recipients"), F.sum("s").cast("double").alias("total_amount"), F.min("seq").alias("seq"))
    conf = F.least(F.lit(0.70), F.lit(0.25) + F.col("recipients") * 0.04)
    return g.filter("n >= 10 and recipients >= 5").select(KEY, "seq", "n", "recipients", "total_amount",
                                                         B.py_round(conf, 2).alias("confidence"), B.py_round(conf * 60, 1).alias("contribution"))


def is_cash():
    """A row that says it is cash."""
    cp = F.upper(B.cp_strict())
    return F.col("is_atm") | F.col("is_cash_operation") | cp.contains("БАНКОМАТ") | cp.contains("ATM") | F.upper(F.coalesce("description", F.lit(""))).contains("НАЛИЧН")


def untraced_cash(txn: DataFrame) -> DataFrame:
    flagged = F.col("is_atm") | F.col("is_cash_operation")
    cash = is_cash()
    g = txn.filter("amount > 0").groupBy(KEY).agg(
        B.total(F.when(cash, F.col("amount"))).alias("cash"), B.total(F.when(~flagged, F.col("amount"))).alias("electronic"),
        F.count(F.when(cash, 1)).alias("n"), F.min(F.when(cash, F.col("seq"))).alias("seq"))
    g = g.withColumn("ratio", F.col("cash") / (F.col("electronic") + 1)).filter("cash >= 500000 and ratio >= 0.50")
    conf = F.least(F.lit(0.80), F.lit(0.25) + F.col("ratio") * 0.25)
    return g.select(KEY, "seq", "n", "cash", "electronic", B.py_round(conf, 2).alias("confidence"), B.py_round(conf * 60, 1).alias("contribution"))


NAMES = ["money_laundering_layering", "structuring", "carding", "pyramid_scheme", "human_trafficking_payments", "tax_evasion_cash"]


def all_patterns(parts) -> DataFrame:
    """All schemes in one frame. Readers that show a few rank them by confidence."""
    out = None
    for name, df in zip(NAMES, parts):
        p = df.select(KEY, F.lit(name).alias("pattern"), "seq", "confidence", "contribution")
        out = p if out is None else out.unionByName(p)
    return out
