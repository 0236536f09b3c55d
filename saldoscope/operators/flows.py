"""Cross-reference of income and spending, merchant risk, graph of counterparties."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import keywords as K
from ..config.limits import PASS_THROUGH_FLOOR
from . import base as B
from .base import KEY
from .settle import ANSWER_COLUMNS, settle


def _out():
    return F.col("amount") < 0


def _in():
    return F.col("amount") > 0


# ---- cross-reference
def income_expense_ratio(clean: DataFrame) -> DataFrame:
    s = clean.groupBy(KEY).agg(B.total(F.when(_in(), F.col("amount"))).alias("income"), B.total(F.when(_out(), -F.col("amount"))).alias("expense"))
    return s.withColumn("ratio", F.when(F.col("expense") > 0, B.py_round(F.col("income") / F.col("expense"), 3)).otherwise(0.0))


SLICE_US = 2 * B.DAY_US


class _Earliest:
    """Numbers of open incomes by amount: the smallest number in a range of amounts, in logarithmic time."""

    def __init__(self, amounts: np.ndarray):
        order = np.argsort(amounts, kind="stable")
        self.n = max(len(amounts), 1)
        self.place = np.empty(len(amounts), np.int64)
        self.place[order] = np.arange(len(amounts))
        self.place = self.place.tolist()
        self.values = np.unique(amounts)
        self.edges = np.searchsorted(amounts[order], self.values, "left").tolist() + [len(amounts)]
        self.none = len(amounts)
        self.tree = [self.none] * (2 * self.n)

    def put(self, i: int, value: int) -> None:
        at = self.place[i] + self.n
        self.tree[at] = value
        at >>= 1
        while at:
            low = min(self.tree[2 * at], self.tree[2 * at + 1])
            if self.tree[at] == low:
                break
            self.tree[at] = low
            at >>= 1

    def least(self, lo: int, hi: int) -> int:
        """Smallest number among the amounts from the lo-th to before the hi-th distinct one."""
        a, b, out = self.edges[lo] + self.n, self.edges[hi] + self.n, self.none
        while a < b:
            if a & 1:
                out = min(out, self.tree[a])
                a += 1
            if b & 1:
                b -= 1
                out = min(out, self.tree[b])
            a >>= 1
            b >>= 1
        return out


def _match_slice(window_us: int, tol: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One account, one slice: each expense takes the earliest open income that fits.

        Incomes are open from their time on until they are too old; both bounds only move on.
        """
        key, sl = pdf[KEY].iat[0], pdf["slice"].iat[0]
        inc = pdf[pdf["amount"] > 0].sort_values(["t", "seq"])
        exp = pdf[pdf["amount"] < 0].sort_values(["t", "seq"])
        it, ia, iseq = inc["t"].to_numpy(), inc["amount"].to_numpy(), inc["seq"].to_numpy()
        free = np.ones(len(inc), dtype=bool)
        et, ea = exp["t"].to_numpy(), -exp["amount"].to_numpy()
        since, until = np.searchsorted(it, et - window_us, "left").tolist(), np.searchsorted(it, et, "right").tolist()
        open_ = _Earliest(ia)
        v = open_.values
        # bounds by division may be off by one value: the ratio itself decides
        lows, highs = np.searchsorted(v, ea / (1 + tol), "left"), np.searchsorted(v, ea / (1 - tol), "right")
        out, added, dropped = [], 0, 0
        for k, (t, a, seq) in enumerate(zip(et.tolist(), ea.tolist(), exp["seq"].tolist())):
            while added < until[k]:
                open_.put(added, added)
                added += 1
            while dropped < since[k]:
                open_.put(dropped, open_.none)
                dropped += 1
            lo, hi = int(lows[k]), int(highs[k])
            while lo and a / v[lo - 1] <= 1 + tol:
                lo -= 1
            while lo < len(v) and a / v[lo] > 1 + tol:
                lo += 1
            while hi < len(v) and a / v[hi] >= 1 - tol:
                hi += 1
            while hi and a / v[hi - 1] < 1 - tol:
                hi -= 1
            i = open_.least(lo, hi) if lo < hi else open_.none
            if i < open_.none:
                free[i] = False
                open_.put(i, open_.none)
                out.append((key, sl, "done", it[i], iseq[i], ia[i], t, seq, a))
        end = (sl + 1) * SLICE_US
        for i in np.flatnonzero(free & (it >= end - window_us)):
            out.append((key, sl + 1, "open", it[i], iseq[i], ia[i], 0, 0, 0.0))
        return pd.DataFrame(out, columns=ANSWER_COLUMNS)
    return run


def pass_through_pairs(clean: DataFrame, prof: DataFrame, hours: int = 24, tol: float = 0.05) -> DataFrame:
    """Large income followed within a day by an outflow of about the same size.

    Both sides rank each other by time, so taking incomes in order and taking expenses in
    order give the same one-to-one matching. That lets time be cut into slices: a slice
    needs only the incomes still open at its start.
    """
    big = clean.filter(F.abs("amount") >= PASS_THROUGH_FLOOR).join(prof.select(KEY, "account_type"), KEY)
    excused = _out() & F.col("account_type").isin("freelancer", "business_owner") & B.has_any(F.upper(B.cp_desc()), K.PASS_THROUGH_MERCHANT)
    rows = big.filter(~excused).select(KEY, F.floor(B.us() / F.lit(SLICE_US)).alias("slice"), B.us().alias("t"), "seq", B.dbl("amount").alias("amount"))
    # an income matters only where an expense can follow: in its slice or the next one
    spent = rows.filter("amount < 0").select(KEY, "slice").distinct()
    near = spent.select(KEY, F.explode(F.array(F.col("slice"), F.col("slice") - 1)).alias("slice")).distinct()
    rows = rows.join(near, [KEY, "slice"], "left_semi")
    done = settle(rows, [KEY], _match_slice(hours * B.HOUR_US, tol))
    return done.select(KEY, "t", "seq", "amount", "t2", "seq2", "amount2")


def pass_through(pairs: DataFrame, clean: DataFrame, k: int = 10) -> DataFrame:
    top = B.topk(pairs, [KEY], [F.desc("amount"), "t", "seq"], k)
    cp = clean.select(KEY, F.col("seq"), B.cp_desc().alias("cp"))
    out = top.join(cp, [KEY, "seq"]).withColumnRenamed("cp", "income_source")
    out = out.join(cp.withColumnRenamed("seq", "seq2"), [KEY, "seq2"]).withColumnRenamed("cp", "expense_dest")
    return out.select(
        KEY, "rank_in_account", B.stamp_us("t").alias("income_at"), F.col("amount").alias("income_amount"), "income_source",
        B.stamp_us("t2").alias("expense_at"), F.col("amount2").alias("expense_amount"), "expense_dest",
        B.py_round(F.col("amount2") / F.col("amount"), 3).alias("match_ratio"),
        B.py_round((F.col("t2") - F.col("t")) / float(B.HOUR_US), 1).alias("time_gap_hours"))


def source_dest_map(clean: DataFrame, k: int = 10) -> DataFrame:
    side = F.when(_in(), "source").otherwise("destination")
    g = clean.groupBy(KEY, side.alias("side"), B.cp_desc().alias("name")).agg(B.total(F.abs("amount")).alias("amount"))
    return B.topk(g, [KEY, "side"], [F.desc("amount"), "name"], k, "rank_in_side")


def peer_income(clean: DataFrame, prof: DataFrame) -> DataFrame:
    """Income without salary, pension, cashback or deposit words, against monthly income."""
    rows = clean.filter(_in() & ~B.has_any(F.upper(F.coalesce("description", F.lit(""))), K.NOT_PEER_INCOME))
    d = rows.groupBy(KEY).agg(B.total("amount").alias("peer_income")).join(prof.select(KEY, "account_type", "avg_monthly_income"), KEY)
    base = F.when(F.col("avg_monthly_income") == 0, 1.0).otherwise(F.col("avg_monthly_income"))
    pts = F.when(F.col("peer_income") > base * 36, 25).when(F.col("peer_income") > base * 24, 15).otherwise(0)
    return d.filter(F.col("account_type").isin("salary_employee", "pensioner", "student", "unknown")).select(KEY, "peer_income", pts.alias("points"))


def cross_reference_score(accounts, clean, ratio, pairs_top, peers) -> DataFrame:
    d = B.left_all(accounts, B.counts(clean, "rows"), ratio, B.counts(pairs_top, "pairs"), peers.select(KEY, "points"))
    n = B.n0("pairs")
    score = (F.when((B.n0("ratio") < 0.6) & (B.n0("expense") > 1000000), 20).otherwise(0) + B.n0("points")
             + F.when(n > 8, F.least(F.lit(30), (n - 8) * 8)).when(n > 3, F.least(F.lit(15), (n - 3) * 3)).otherwise(0))
    return d.select(KEY, n.alias("pairs"), F.when(B.n0("rows") >= 5, F.least(F.lit(100), score)).otherwise(0).cast("double").alias("score"))


# ---- merchant risk
def _groups(listing):
    """Word of the first group that matches, and its group."""
    text = F.upper(F.coalesce("description", F.lit("")))
    word = F.coalesce(*[B.first_word(text, words) for words in listing.values()])
    lookup = F.create_map(*[F.lit(x) for g, words in listing.items() for w in words for x in (w, g)])
    return word, lookup


def merchant_hits(clean: DataFrame) -> DataFrame:
    """Amount and count per risky word: high groups first, medium when no high word occurs."""
    rows = clean.filter(_out()).select(KEY, "amount", "description")
    high, high_map = _groups(K.HIGH_RISK)
    medium, medium_map = _groups(K.MEDIUM_RISK)
    text = F.upper(F.coalesce("description", F.lit("")))
    every = [w for g in (K.HIGH_RISK, K.MEDIUM_RISK) for ws in g.values() for w in ws]
    rows = rows.filter(B.has_any(text, every)).withColumn("hi", high).withColumn("me", medium)
    rows = rows.select(KEY, "amount", F.when(F.col("hi").isNotNull(), "high").otherwise("medium").alias("level"), F.coalesce("hi", "me").alias("name"))
    g = rows.groupBy(KEY, "level", "name").agg(B.total(F.abs("amount")).alias("amount"), F.count("*").alias("n"))
    cat = F.when(F.col("level") == "high", high_map[F.col("name")]).otherwise(medium_map[F.col("name")])
    return g.select(KEY, "level", "name", cat.alias("category"), "amount", "n")


def risky_rows(clean: DataFrame) -> DataFrame:
    """(account_id, seq) of payments that hold a high-risk word."""
    words = [w for ws in K.HIGH_RISK.values() for w in ws]
    return clean.filter(_out() & B.has_any(F.upper(F.coalesce("description", F.lit(""))), words)).select(KEY, "seq")


def shell_companies(clean: DataFrame) -> DataFrame:
    text = F.upper(F.coalesce("description", F.lit("")))
    starts = '^(?:%s)' % B.word_pattern(K.LEGAL_PREFIXES)
    quoted = '["«](?:%s)' % B.word_pattern(K.LEGAL_PREFIXES)
    rows = clean.filter(_out() & (text.rlike(starts) | text.rlike(quoted)) & B.has_any(text, K.SHELL_WORDS))
    return rows.groupBy(KEY, text.alias("name")).agg(B.total(F.abs("amount")).alias("amount"), F.count("*").alias("n"))


def merchant_totals(accounts, clean, hits, shells) -> DataFrame:
    spent = clean.filter(_out()).groupBy(KEY).agg(B.total(F.abs("amount")).alias("expense"))
    cat = lambda c: B.total(F.when(F.col("category") == c, F.col("amount")))
    h = hits.filter("level = 'high'").groupBy(KEY).agg(
        F.sum(F.col("amount").cast("decimal(38,2)")).cast("double").alias("high"), F.count("*").alias("high_words"),
        F.sum(F.when(F.col("category") == "crypto", F.col("amount")).cast("decimal(38,2)")).cast("double").alias("crypto"),
        F.sum(F.when(F.col("category") == "gambling", F.col("amount")).cast("decimal(38,2)")).cast("double").alias("gambling"))
    s = shells.groupBy(KEY).agg(F.sum(F.col("amount").cast("decimal(38,2)")).cast("double").alias("shell"), F.count("*").alias("shell_count"))
    d = B.left_all(accounts, spent, h, s)
    d = d.select(KEY, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("expense", "high", "crypto", "gambling", "shell")],
                 B.n0("high_words").alias("high_words"), B.n0("shell_count").alias("shell_count"))
    both = F.col("high") + F.col("shell")
    return d.withColumn("high_risk_amount", both).withColumn(
        "high_risk_pct", F.when(F.col("expense") > 0, B.py_round(both / F.col("expense") * 100.0, 2)).otherwise(0.0))


def merchant_score(totals: DataFrame, prof: DataFrame) -> DataFrame:
    d = totals.join(prof.select(KEY, "account_type", "avg_monthly_income"), KEY)
    exp, inc = F.col("expense"), F.col("avg_monthly_income")
    pct = lambda c: F.when(exp > 0, c / exp * 100.0).otherwise(0.0)
    crypto = F.when(F.col("crypto") <= 0, 0).when(
        F.col("account_type") == "trader",
        F.when(F.col("crypto") > F.when(inc == 0, 1.0).otherwise(inc) * 5, 30).otherwise(0)).otherwise(
        B.ladder(pct(F.col("crypto")), [(">", 30, 40), (">", 15, 20), (">", 5, 10)]))
    gamble = F.when(F.col("gambling") <= 0, 0).when(
        inc > 0, B.ladder(F.col("gambling") / (inc * 12) * 100.0, [(">", 20, 50), (">", 10, 30), (">", 3, 10)])).otherwise(
        B.ladder(pct(F.col("gambling")), [(">", 20, 50), (">", 10, 30), (">", 5, 15)]))
    rest = F.col("high_risk_amount") - F.col("crypto") - F.col("gambling") - F.col("shell")
    other = F.when(rest > 0, B.ladder(pct(rest), [(">", 20, 30), (">", 10, 15), (">", 5, 8)])).otherwise(0)
    shell = B.ladder(F.col("shell_count"), [(">=", 5, 40), (">=", 3, 25), (">=", 1, 10)]) + F.when(
        F.col("shell_count") > 0, B.ladder(pct(F.col("shell")), [(">", 30, 25), (">", 15, 15), (">", 5, 8)])).otherwise(0)
    return d.select(KEY, "high_words", "high_risk_pct", F.least(F.lit(100), crypto + gamble + other + shell).cast("double").alias("score"))


# ---- graph of one account: a star around the owner
OWNER = "OWNER"


def graph_edges(clean: DataFrame) -> DataFrame:
    rows = clean.withColumn("cp", B.cp_graph()).filter(F.length("cp") >= 2)
    src = F.when(_out(), F.lit(OWNER)).otherwise(F.col("cp"))
    dst = F.when(_out(), F.col("cp")).otherwise(F.lit(OWNER))
    return rows.groupBy(KEY, src.alias("source"), dst.alias("target")).agg(
        B.total(F.abs("amount")).alias("weight"), F.count("*").alias("n"), B.day(F.min("ts")).alias("first_day"), B.day(F.max("ts")).alias("last_day"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    w = F.col("weight").cast("decimal(38,2)")
    zero = F.lit(0).cast("decimal(38,2)")
    ends = F.array(F.struct(F.col("source").alias("id"), zero.alias("i"), w.alias("o"), F.lit(0).alias("di"), F.lit(1).alias("do")),
                   F.struct(F.col("target").alias("id"), w.alias("i"), zero.alias("o"), F.lit(1).alias("di"), F.lit(0).alias("do")))
    x = edges.select(KEY, F.explode(ends).alias("e")).groupBy(KEY, F.col("e.id").alias("id")).agg(
        F.sum("e.i").cast("double").alias("in_volume"), F.sum("e.o").cast("double").alias("out_volume"),
        F.sum("e.di").alias("in_degree"), F.sum("e.do").alias("out_degree"))
    return x.select(KEY, "id", (F.col("id") == OWNER).alias("is_owner"), "in_volume", "out_volume",
                    (F.col("in_volume") + F.col("out_volume")).alias("total_volume"), (F.col("in_degree") + F.col("out_degree")).alias("connections"),
                    ((F.col("in_degree") > 0) & (F.col("out_degree") > 0)).alias("is_bidirectional"))


def graph_hubs(nodes: DataFrame, k: int = 15) -> DataFrame:
    return B.topk(nodes.filter("not is_owner and total_volume > 0"), [KEY], [F.desc("total_volume"), "id"], k).drop("is_owner")


def betweenness_star(nodes: DataFrame) -> DataFrame:
    """Only the owner lies between others: paths run from a payer over the owner to a payee."""
    x = nodes.groupBy(KEY).agg(
        F.count("*").alias("n"), F.count(F.when(~F.col("is_owner") & (F.col("out_volume") >= 0) & (F.col("pays")), 1)).alias("payers"),
        F.count(F.when(~F.col("is_owner") & F.col("paid"), 1)).alias("payees"),
        F.count(F.when(~F.col("is_owner") & F.col("is_bidirectional"), 1)).alias("both"))
    n = F.col("n")
    v = (F.col("payers") * F.col("payees") - F.col("both")) / ((n - 1) * (n - 2))
    return x.select(KEY, F.lit(OWNER).alias("id"), F.when(n > 2, B.py_round(v.cast("double"), 4)).otherwise(0.0).alias("betweenness"))


def node_roles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whether each node pays the owner and is paid by the owner."""
    pays = edges.filter(F.col("target") == OWNER).select(KEY, F.col("source").alias("id"), F.lit(True).alias("pays"))
    paid = edges.filter(F.col("source") == OWNER).select(KEY, F.col("target").alias("id"), F.lit(True).alias("paid"))
    no = F.lit(False)
    return nodes.join(pays, [KEY, "id"], "left").join(paid, [KEY, "id"], "left").withColumn(
        "pays", F.coalesce("pays", no)).withColumn("paid", F.coalesce("paid", no))


def communities_star(nodes: DataFrame) -> DataFrame:
    """A star is one community: every member of an account's graph, one row per member."""
    size = nodes.groupBy(KEY).agg(F.count("*").alias("size")).filter("size > 1")
    return nodes.join(size, KEY).select(KEY, F.lit(1).alias("community"), F.col("id").alias("member"), "size")


def star_cycles(edges: DataFrame) -> DataFrame:
    """Directed cycles of three or more nodes. Every edge touches the owner, so two nodes of
    such a cycle would have to be joined by an edge that does not; the filter finds any."""
    odd = edges.filter((F.col("source") != OWNER) & (F.col("target") != OWNER))
    return odd.select(KEY, "source", "target", F.lit(3).alias("length"), F.col("weight").alias("total_flow"))


def graph_score(accounts, nodes, hubs, limits) -> DataFrame:
    h = hubs.groupBy(KEY).agg(F.count(F.when(F.col("is_bidirectional"), 1)).alias("both"),
                              F.max(F.when(F.col("is_bidirectional"), F.col("connections"))).alias("both_max"), F.max("connections").alias("top"))
    d = B.left_all(accounts, h, B.counts(nodes, "nodes"), limits.select(KEY, "account_type", "bidirectional_hub"))
    lim = F.col("bidirectional_hub")
    score = (F.when(B.n0("both_max") > lim, 10).otherwise(0) + F.when(B.n0("top") > lim * 3, 15).otherwise(0)
             + B.ladder(B.n0("both"), [(">=", 15, 30), (">=", 10, 15), (">=", 8, 8)])
             + F.when(F.col("account_type").isin("salary_employee", "pensioner", "student"),
                      B.ladder(B.n0("nodes"), [(">", 30, 15), (">", 20, 8)])).otherwise(0))
    return d.select(KEY, B.n0("nodes").alias("nodes"), B.n0("both").alias("bidirectional"), F.least(F.lit(100), score).cast("double").alias("score"))
