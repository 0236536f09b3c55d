"""Shared frames of one run over a book of accounts. Every frame is lazy."""

import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.limits import ACCOUNT_TYPES, TYPE_LIMITS
from ..operators import enrich as E
from ..operators import evidence as EV
from ..operators import entities as EN
from ..operators import flows as W
from ..operators import habits as H
from ..operators import patterns as N
from ..operators import privacy as PV
from ..operators import profile as P
from ..operators import scoring as R
from ..operators import structuring as S
from ..operators import templates as TP
from ..operators import velocity as V
from ..operators.base import KEY
from ..session import durable, stamp
from ..sources.book import load_accounts, load_analyses, load_logins, load_transfers, load_txn, table

_OPEN: dict = {}
_LOCK = threading.RLock()


class shared:
    """A frame of the book that is built once, also when several threads ask for it."""

    def __init__(self, build):
        self.build, self.name = build, build.__name__

    def __get__(self, book, owner=None):
        with _LOCK:
            if self.name not in book.__dict__:
                book.__dict__[self.name] = self.build(book)
            return book.__dict__[self.name]


class Book:
    def __init__(self, spark: SparkSession, sf_dir: str, txn: DataFrame | None = None, by_user: bool = False):
        """``by_user``: one account for each user of the events instead of eight busy ones."""
        self.spark, self.sf_dir, self.by_user = spark, sf_dir, by_user
        if txn is not None:
            self.__dict__["txn"] = txn

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str, by_user: bool = False) -> "Book":
        """The book of a folder; its written tables are shared by all queries of an application."""
        key = (spark.sparkContext.applicationId, sf_dir, by_user, stamp(spark, sf_dir))
        if key not in _OPEN:
            _OPEN[key] = cls(spark, sf_dir, by_user=by_user)
        book = _OPEN[key]
        return book if book.spark is spark else cls(spark, sf_dir, by_user=by_user)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @shared
    def txn(self) -> DataFrame:
        """Canonical rows, written once: reading a statement source again for every operator
        would repeat its join and its text work each time."""
        return durable(load_txn(self.spark, self.sf_dir, self.by_user))

    @shared
    def profile(self) -> DataFrame:
        """One row per account, written once: every detector reads it."""
        return durable(P.profile(self.txn))

    @shared
    def accounts(self) -> DataFrame:
        return self.profile.select(KEY)

    @shared
    def limits(self) -> DataFrame:
        """Profile with the thresholds of its account type; the type table has seven rows."""
        out = self.profile
        for name, values in TYPE_LIMITS.items():
            arms = None
            for kind, value in zip(ACCOUNT_TYPES, values):
                cond = F.col("account_type") == kind
                arms = F.when(cond, F.lit(value)) if arms is None else arms.when(cond, F.lit(value))
            out = out.withColumn(name, arms)
        return out

    @shared
    def clean(self) -> DataFrame:
        """Rows that scoring looks at: everything outside the whitelist. Written once, since
        every detector reads it and the keyword tests should not run ten times."""
        return durable(P.apply_whitelist(self.txn, self.profile))

    @shared
    def structuring_limits(self) -> DataFrame:
        return S.structuring_limits(self.profile)

    @shared
    def structuring_rows(self) -> DataFrame:
        """With the columns that the tests read; the others need not travel."""
        return durable(S.structuring_rows(self.clean.select(KEY, "seq", "ts", "amount", "description", "counterparty")))

    def _evidence(self, frame: DataFrame, least: int) -> DataFrame:
        from ..operators.velocity import big_enough
        return big_enough(frame, self.clean, least)

    @shared
    def bursts(self):
        return V.velocity_bursts(self.clean, self.limits)

    @shared
    def spikes(self):
        return V.daily_spikes(self.clean)

    @shared
    def outflows(self):
        return V.outflow_24h(self.clean, self.limits)

    @shared
    def velocity_score(self):
        return V.velocity_score(self.accounts, self.bursts, self.spikes, self.outflows, V.counterparty_churn(self.clean))

    @shared
    def just_under(self):
        return self._evidence(S.just_under(self.structuring_rows, self.structuring_limits), 5)

    @shared
    def split_groups(self):
        return self._evidence(S.split_groups(self.structuring_rows, self.structuring_limits), 5)

    @shared
    def smurfing(self):
        return self._evidence(S.smurfing(self.structuring_rows, self.structuring_limits), 5)

    @shared
    def structuring_score(self):
        return S.structuring_score(self.accounts, self.clean, self.just_under, self.split_groups, self.smurfing)

    @shared
    def pass_pairs(self):
        return self._evidence(W.pass_through_pairs(self.clean, self.profile), 5)

    @shared
    def pass_through(self):
        return W.pass_through(self.pass_pairs, self.clean)

    @shared
    def cross_score(self):
        return W.cross_reference_score(
            self.accounts, self.clean, W.income_expense_ratio(self.clean), self.pass_through, W.peer_income(self.clean, self.profile))

    @shared
    def merchant_hits(self):
        return W.merchant_hits(self.clean)

    @shared
    def shells(self):
        return W.shell_companies(self.clean)

    @shared
    def merchant_totals(self):
        return W.merchant_totals(self.accounts, self.clean, self.merchant_hits, self.shells)

    @shared
    def merchant_score(self):
        return W.merchant_score(self.merchant_totals, self.profile)

    @shared
    def edges(self):
        return W.graph_edges(self.clean)

    @shared
    def nodes(self):
        return W.graph_nodes(self.edges)

    @shared
    def hubs(self):
        return W.graph_hubs(self.nodes)

    @shared
    def graph_score(self):
        return W.graph_score(self.accounts, self.nodes, self.hubs, self.limits)

    @shared
    def times(self):
        return H.time_data(self.clean)

    @shared
    def night(self):
        return H.night_rows(self.clean, self.times)

    @shared
    def large_night(self):
        return H.large_night(self.night)

    @shared
    def night_clusters(self):
        return H.night_clusters(self.night)

    @shared
    def night_score(self):
        return H.night_score(self.accounts, H.night_summary(self.night, self.times), self.large_night, self.night_clusters)

    @shared
    def dups(self):
        return H.dup_candidates(self.clean)

    @shared
    def exact_duplicates(self):
        return H.exact_duplicates(self.dups)

    @shared
    def broadcasts(self):
        return H.amount_broadcast(self.dups)

    @shared
    def duplicate_score(self):
        return H.duplicate_score(self.accounts, self.exact_duplicates, self.broadcasts)

    @shared
    def rounds(self):
        return H.round_rows(H.round_relevant(self.clean), self.clean)

    @shared
    def round_runs(self):
        return H.consecutive_rounds(self.rounds)

    @shared
    def round_score(self):
        return H.round_score(self.accounts, self.rounds, self.round_runs)

    @shared
    def oversized(self):
        return self._evidence(H.oversized(self.clean, self.limits), 5)

    @shared
    def unexpected(self):
        return self._evidence(H.unexpected_activity(self.clean, self.limits), 5)

    @shared
    def income_anomalies(self):
        return self._evidence(H.income_anomalies(self.clean, self.limits), 5)

    @shared
    def mismatch_score(self):
        return H.mismatch_score(self.accounts, self.oversized, self.unexpected, self.income_anomalies)

    @shared
    def trend(self):
        return self._evidence(H.spending_trend(self.clean, self.limits), 10)

    @shared
    def category_odd(self):
        return self._evidence(H.category_anomalies(self.clean), 10)

    @shared
    def behavioral_score(self):
        return H.behavioral_score(self.accounts, self.trend, self.category_odd)

    # schemes are a few rows, and patterns, reasons and evidence read them
    @shared
    def layering(self):
        return durable(N.layering(self.txn, self.profile))

    @shared
    def structuring_pattern(self):
        return durable(N.structuring_pattern(self.txn, self.structuring_limits))

    @shared
    def carding(self):
        return durable(N.carding(self.txn))

    @shared
    def pyramid(self):
        return durable(N.pyramid(self.txn))

    @shared
    def many_payouts(self):
        return durable(N.many_payouts(self.txn, self.profile))

    @shared
    def untraced_cash(self):
        return durable(N.untraced_cash(self.txn))

    @shared
    def patterns(self):
        parts = [self.layering, self.structuring_pattern, self.carding, self.pyramid, self.many_payouts, self.untraced_cash]
        return durable(N.all_patterns(parts))

    @shared
    def score_frames(self) -> dict:
        """One small row per account and module, each written once: scores and counts."""
        frames = {
            "velocity": self.velocity_score, "graph": self.graph_score, "behavioral": self.behavioral_score,
            "structuring": self.structuring_score, "cross_reference": self.cross_score, "merchant_risk": self.merchant_score,
            "night_transactions": self.night_score, "duplicate_payments": self.duplicate_score,
            "round_amounts": self.round_score, "profile_mismatch": self.mismatch_score,
        }
        with ThreadPoolExecutor(4) as pool:  # independent jobs; the cluster runs them side by side
            return dict(zip(frames, pool.map(durable, frames.values())))

    @shared
    def module_scores(self):
        return R.module_scores(self.accounts, self.score_frames, self.patterns)

    @shared
    def scored(self):
        return durable(R.composite(self.module_scores, self.profile))

    @shared
    def evidence_counts(self):
        return R.counts_wide(self.accounts, self.score_frames)

    @shared
    def schemes(self) -> dict:
        """The schemes by name, with their numbers."""
        return dict(zip(N.NAMES, [self.layering, self.structuring_pattern, self.carding, self.pyramid, self.many_payouts, self.untraced_cash]))

    @shared
    def scheme_rows(self):
        return durable(EV.scheme_rows(self.txn, self.structuring_limits, self.schemes))

    @shared
    def scheme_reasons(self):
        return durable(EV.scheme_reasons(self.schemes, self.structuring_limits))

    @shared
    def explained_flags(self):
        return R.explained_flags(self.scored, self.evidence_counts, self.patterns, self.scheme_reasons, EV.scheme_evidence(self.patterns, self.scheme_rows))

    @shared
    def txn_flags(self):
        pairs = self.pass_pairs
        mismatch = self.oversized.select(KEY, "seq").unionByName(self.unexpected.select(KEY, "seq")).unionByName(self.income_anomalies.select(KEY, "seq"))
        both = pairs.select(KEY, "seq").unionByName(pairs.select(KEY, F.col("seq2").alias("seq")))
        split = self.just_under.select(KEY, "seq").unionByName(S.split_members(self.structuring_rows, self.split_groups).select(KEY, "seq"))
        return R.txn_flags({"structuring": split, "night_transactions": self.large_night, "profile_mismatch": mismatch, "cross_reference": both,
                            "merchant_risk": W.risky_rows(self.clean), "pattern_detector": self.scheme_rows})

    @shared
    def report(self):
        from ..operators import base as B
        ranked = B.topk(self.patterns, [KEY], [F.desc("confidence"), "pattern", "seq"], 15)
        night = B.topk(self.large_night, [KEY], [F.desc("amount"), "seq"], 10)
        return R.assemble_report(self.scored, self.profile, {
            "bursts": (self.bursts.drop("t"), 10), "daily_spikes": (self.spikes, 10), "split_groups": (self.split_groups, 10),
            "smurfing_patterns": (self.smurfing, 5), "pass_through": (self.pass_through, 10), "hub_nodes": (self.hubs, 15),
            "large_night_transfers": (night, 10), "flagged_patterns": (ranked, 15)})

    @shared
    def account(self):
        return load_accounts(self.spark, self.sf_dir)

    @shared
    def analyses(self):
        return load_analyses(self.spark, self.sf_dir)

    @shared
    def logins(self):
        return load_logins(self.spark, self.sf_dir)

    @shared
    def classes(self):
        """Class of every distinct counterparty name; the reference table is the supplier list."""
        known = self.table("supplier").select(
            F.col("s_name").alias("name"), F.lit("merchant").alias("known_kind"), F.concat("s_name", F.lit(" LLP")).alias("known_name"), F.lit("ТОО").alias("known_type"))
        from ..operators import base as B
        names = self.txn.select(F.trim(B.cp_desc()).alias("name")).filter("name <> ''")
        return E.classify(names, known)

    @shared
    def salary_sources(self):
        return E.salary_sources(self.txn)

    @shared
    def labelled(self):
        return self.txn.withColumn("label", E.statement_label())

    @shared
    def cats(self):
        return E.categorise(self.txn)

    @shared
    def person_tags(self):
        return durable(PV.person_tags(self.txn, self.owner_variants))

    @shared
    def owner_variants(self):
        return PV.owner_variants(self.account)

    @shared
    def subjects(self):
        from ..sources import sinks
        return sinks.subjects_of(self.txn)

    @shared
    def transfers(self):
        return load_transfers(self.spark, self.sf_dir)

    @shared
    def entity_edges(self):
        return durable(EN.entity_edges(self.transfers, self.account))

    @shared
    def strong_edges(self):
        return self.entity_edges.filter(F.col("flow") >= EN.STRONG * 100)

    @shared
    def template_members(self):
        return durable(TP.template_members(self.txn))

    @shared
    def template_clusters(self):
        return durable(TP.template_clusters(self.txn, self.template_members))
