"""Weights, composite score, flags and the report."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import legal as L
from ..config.limits import BASE_WEIGHTS, effective_weights
from . import base as B
from .base import KEY
from .evidence import module_reasons

MODULES = list(BASE_WEIGHTS)


def weight_of(module: str):
    """Effective weight of a module for the row's account type; a fixed table of seven types."""
    arms = None
    for kind, mod, w in effective_weights():
        if mod == module:
            cond = F.col("account_type") == kind
            arms = F.when(cond, F.lit(w)) if arms is None else arms.when(cond, F.lit(w))
    return arms


def weights(prof: DataFrame) -> DataFrame:
    table = F.array(*[F.struct(F.lit(m).alias("module"), weight_of(m).alias("weight")) for m in MODULES])
    return prof.select(KEY, F.explode(table).alias("w")).select(KEY, "w.module", B.py_round(F.col("w.weight"), 4).alias("weight"))


def pattern_summary(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy(KEY).agg(
        F.count("*").alias("patterns"), F.max("confidence").alias("top_confidence"),
        F.sum(F.col("contribution").cast("decimal(18,1)")).cast("double").alias("contributions"))


def module_scores(accounts: DataFrame, scores: dict, patterns: DataFrame) -> DataFrame:
    """One row per account, one column per module; a missing module counts as zero."""
    out = accounts
    for module, df in scores.items():
        out = out.join(df.select(KEY, F.col("score").alias(module)), KEY, "left")
    out = out.join(pattern_summary(patterns), KEY, "left")
    out = out.withColumn("pattern_detector", F.least(F.lit(100.0), F.coalesce("contributions", F.lit(0.0))))
    return out.select(KEY, *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in MODULES],
                      B.n0("patterns").alias("patterns"), F.coalesce("top_confidence", F.lit(0.0)).alias("top_confidence"))


def composite(wide: DataFrame, prof: DataFrame) -> DataFrame:
    d = wide.join(prof.select(KEY, "account_type"), KEY)
    base = F.lit(0.0)
    for m in MODULES:
        base = base + F.col(m) * weight_of(m)
    high = F.lit(0)
    for m in MODULES:
        high = high + F.when(F.col(m) >= 60, 1).otherwise(0)
    score = base + F.when(high > 1, (high - 1) * 3).otherwise(0)
    boost = B.ladder(F.col("patterns"), [(">=", 100, 0.35), (">=", 50, 0.25), (">=", 10, 0.15), (">=", 5, 0.1)], 0.0)
    sure = F.least(F.lit(1.0), F.col("top_confidence") + boost)
    floor = F.when((F.col("patterns") > 0) & (sure >= 0.7), sure * 70).otherwise(0.0)
    d = d.withColumn("composite_score", B.py_round(F.least(F.lit(100.0), F.greatest(score, floor)), 1))
    return d.withColumn("risk_level", risk_level_engine(F.col("composite_score")))


def risk_level_engine(c):
    return F.when(c >= 75, "critical").when(c >= 55, "high").when(c >= 30, "medium").otherwise("low")


def risk_band_dashboard(c):
    return F.when(c >= 60, "high").when(c >= 30, "medium").otherwise("low")


def legacy_risk_score(c):
    return F.least(F.lit(10), F.floor(c / 10).cast("int"))


# module -> (needs, severity bound): the flag is shown when the named count is positive
FLAG_MODULES = {
    "velocity": ("bursts", 60), "structuring": ("splits", 60), "merchant_risk": ("high_words", None),
    "cross_reference": ("pairs", None), "night_transactions": ("night_count", 50), "duplicate_payments": ("duplicates", None),
    "round_amounts": ("round_count", None), "profile_mismatch": ("mismatches", 50),
}


def counts_wide(accounts: DataFrame, scores: dict) -> DataFrame:
    """Evidence counts of all modules, one row per account."""
    take = {
        "velocity": ["bursts", "spikes", "outflows"], "structuring": ["under", "splits", "smurfs"], "merchant_risk": ["high_words", "high_risk_pct"],
        "cross_reference": ["pairs"], "night_transactions": ["night_count", "large", "clusters"],
        "duplicate_payments": ["duplicates", "duplicate_amount", "broadcasts"], "round_amounts": ["round_count", "round_ratio", "runs"],
        "profile_mismatch": ["oversized", "unexpected", "income_anomalies"], "behavioral": ["trend"],
    }
    out = accounts
    for m, cols in take.items():
        out = out.join(scores[m].select(KEY, *cols), KEY, "left")
    capped = sum((F.least(F.col(c), F.lit(5)) for c in ("unexpected", "income_anomalies")), F.least(F.col("oversized"), F.lit(5)))
    return out.withColumn("mismatches", capped)


def pattern_counter():
    counter = F.lit("")
    for name, text in L.PATTERN_COUNTER.items():
        counter = F.when(F.col("pattern") == name, text).otherwise(counter)
    for name, text in L.PATTERN_COUNTER_BUSINESS.items():
        counter = F.when((F.col("pattern") == name) & F.col("account_type").isin("business_owner", "freelancer"), text).otherwise(counter)
    return counter


def explained_flags(scored: DataFrame, counts: DataFrame, patterns: DataFrame, reasons: DataFrame, evidence: DataFrame) -> DataFrame:
    """Flags with severity, reason, confidence, share of the score and the counter-argument; those
    of schemes name up to five rows as evidence."""
    d = scored.join(counts, KEY)
    why, items = module_reasons(), []
    for module, (needs, bound) in FLAG_MODULES.items():
        s = F.col(module)
        severity = F.when(s >= bound, "critical").otherwise("warning") if bound else F.lit("warning")
        counter = F.lit("")
        for (mod, kind), text in L.COUNTER_EVIDENCE.items():
            if mod == module:
                counter = F.when(F.col("account_type") == kind, text).otherwise(counter)
        items.append(F.when((s > 0) & (F.col(needs) > 0), F.struct(
            F.lit(module).alias("module"), severity.alias("severity"), why[module].alias("reason"), F.lit("").alias("evidence"), F.least(F.lit(1.0), s / 100).alias("confidence"),
            B.py_round(s * B.py_round(weight_of(module), 4), 2).alias("contribution"), counter.alias("counter_evidence"))))
    flags = d.select(KEY, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("f")).select(KEY, F.lit(None).cast("long").alias("seq"), "f.*")
    counter = pattern_counter()
    key = [KEY, "pattern", "seq"]
    found = patterns.join(scored.select(KEY, "account_type"), KEY).join(reasons, key).join(evidence, key)
    found = found.select(KEY, "seq", F.lit("pattern_detector").alias("module"), F.when(F.col("confidence") >= 0.8, "critical").otherwise("warning").alias("severity"),
                            "reason", "evidence", "confidence", B.py_round(F.col("contribution"), 2).alias("contribution"), counter.alias("counter_evidence"))
    return flags.unionByName(found)


def _money(c):
    return F.format_number(c, 0)


def risky_names(hits: DataFrame, k: int = 3) -> DataFrame:
    """(account_id, names): the high-risk words with the largest sums."""
    top = B.topk(hits.where("level = 'high'"), [KEY], [F.desc("amount"), "name"], k, "_r")
    return top.groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]), ", ").alias("names"))


def red_flags(scored: DataFrame, counts: DataFrame, hits: DataFrame) -> DataFrame:
    """Ordered flag texts of an account with their numbers and the names of risky merchants."""
    d = scored.join(counts, KEY).join(risky_names(hits), KEY, "left")
    n = lambda c: F.col(c).cast("string")
    rows = [
        (F.col("bursts") > 0, F.concat(F.lit("Обнаружены серии быстрых транзакций ("), n("bursts"), F.lit(" случаев)"))),
        (F.col("spikes") > 0, F.concat(F.lit("Дни с аномальной активностью: "), n("spikes"))),
        (F.col("under") > 0, F.concat(F.lit("Суммы близкие к порогу отчётности: "), n("under"))),
        (F.col("splits") > 0, F.concat(F.lit("Возможное дробление операций: "), n("splits"), F.lit(" групп"))),
        (F.col("pairs") > 0, F.concat(F.lit("Транзитные операции: "), n("pairs"))),
        (F.col("high_words") > 0, F.concat(F.lit("Высокорисковые мерчанты: "), F.coalesce("names", F.lit("")))),
        (F.col("high_risk_pct") > 10, F.concat(F.format_string("%.1f", B.py_round(F.col("high_risk_pct"), 1)), F.lit("% расходов — высокорисковые операции"))),
        (F.col("trend") == "volatile", F.lit("Нестабильный паттерн расходов")),
        (F.col("large") > 0, F.concat(F.lit("Крупные ночные переводы (23:00-06:00): "), n("large"), F.lit(" операций"))),
        (F.col("clusters") > 0, F.concat(F.lit("Серии ночных транзакций: "), n("clusters"), F.lit(" кластеров"))),
        (F.col("duplicates") > 0, F.concat(F.lit("Дублирующие платежи: "), n("duplicates"), F.lit(" повторов на сумму "), _money("duplicate_amount"), F.lit(" KZT"))),
        (F.col("broadcasts") > 0, F.concat(F.lit("Веерная отправка одинаковых сумм: "), n("broadcasts"), F.lit(" паттернов"))),
        (F.col("round_ratio") > 0.3, F.concat(F.lit("Высокая доля круглых сумм: "), F.format_string("%.0f", F.rint(F.col("round_ratio") * 100)), F.lit("% ("), n("round_count"), F.lit(" транзакций)"))),
        (F.col("runs") > 0, F.concat(F.lit("Серии круглых сумм подряд: "), n("runs"), F.lit(" серий"))),
        (F.col("oversized") > 0, F.concat(F.lit("Транзакции превышающие норму для профиля: "), n("oversized"), F.lit(" операций"))),
        (F.col("unexpected") > 0, F.concat(F.lit("Нехарактерная активность для типа аккаунта: "), n("unexpected"), F.lit(" случаев"))),
        (F.col("income_anomalies") > 0, F.concat(F.lit("Аномальные поступления: "), n("income_anomalies"), F.lit(" операций"))),
    ]
    texts = F.array(*[F.when(cond, F.struct(F.lit(i + 1).alias("ord"), text.alias("flag"))) for i, (cond, text) in enumerate(rows)])
    return d.select(KEY, F.explode(F.filter(texts, lambda x: x.isNotNull())).alias("f")).select(KEY, "f.ord", "f.flag")


def pattern_flags(patterns: DataFrame, reasons: DataFrame) -> DataFrame:
    """Flag lines of the schemes found with confidence of one half or more."""
    name = F.create_map(*[F.lit(x) for kv in L.PATTERN_TITLES.items() for x in kv])
    d = patterns.filter("confidence >= 0.5").join(reasons, [KEY, "pattern", "seq"])
    return d.select(KEY, "seq", F.concat(F.lit("["), name[F.col("pattern")], F.lit("] "), "reason").alias("flag"), "confidence")


def recommendations(scored: DataFrame, counts: DataFrame, hits: DataFrame, patterns: DataFrame) -> DataFrame:
    """(account_id, ord, advice): fixed advice first, then a line for every sure scheme, the surest first."""
    gambling = hits.filter("level = 'high' and category = 'gambling'").select(KEY).distinct().withColumn("gambling", F.lit(True))
    d = scored.join(counts, KEY).join(gambling, KEY, "left")
    rows = [
        (F.col("risk_level").isin("high", "critical"), L.ADVICE[0]), (F.col("gambling"), L.ADVICE[1]), (F.col("splits") > 0, L.ADVICE[2]),
        (F.col("pairs") > 0, L.ADVICE[3]), (F.col("night_transactions") >= 30, L.ADVICE[4]), (F.col("duplicates") >= 3, L.ADVICE[5]),
        (F.col("broadcasts") > 0, L.ADVICE[6]), (F.col("round_amounts") >= 30, L.ADVICE[7]), (F.col("oversized") > 0, L.ADVICE[8]), (F.col("unexpected") > 0, L.ADVICE[9]),
    ]
    fixed = F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in rows]), lambda x: x.isNotNull())
    sure = patterns.filter("confidence >= 0.7")
    d = d.select(KEY, fixed.alias("fixed")).join(sure.groupBy(KEY).agg(F.count("*").alias("sure")), KEY, "left")
    told = d.withColumn("fixed", F.when((F.size("fixed") == 0) & F.col("sure").isNull(), F.array(F.lit(L.NO_FINDINGS))).otherwise(F.col("fixed")))
    lines = told.select(KEY, F.posexplode("fixed").alias("pos", "advice")).select(KEY, (F.col("pos") + 1).cast("long").alias("ord"), "advice")
    place = F.element_at(F.create_map(*[x for i, k in enumerate(L.PATTERN_TITLES) for x in (F.lit(k), F.lit(i))]), F.col("pattern"))
    ref = F.create_map(*[F.lit(x) for k in L.PATTERN_TITLES for x in (k, f"Сообщить в ПОД/ФТ согласно {L.PATTERN_REFERENCE[k]} (схема: {L.PATTERN_TITLES[k]})")])
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("confidence"), place, "seq"))
    more = sure.select(KEY, rank.alias("r"), ref[F.col("pattern")].alias("advice")).join(told.select(KEY, F.size("fixed").alias("n")), KEY)
    return lines.unionByName(more.select(KEY, (F.col("n") + F.col("r")).cast("long").alias("ord"), "advice"))


def module_breakdown(scored: DataFrame, prof: DataFrame) -> DataFrame:
    """(account_id, module, score, weight, contribution) of every module."""
    w = weights(prof)
    long = scored.select(KEY, F.explode(F.array(*[F.struct(F.lit(m).alias("module"), F.col(m).alias("score")) for m in MODULES])).alias("m")).select(KEY, "m.*")
    return long.join(w, [KEY, "module"]).select(KEY, "module", "score", "weight", B.py_round(F.col("score") * F.col("weight"), 2).alias("contribution"))


def scheme_breakdown(scored: DataFrame, patterns: DataFrame, reasons: DataFrame, articles: DataFrame) -> DataFrame:
    """(account_id, pattern, seq, confidence, reason, counter_evidence, articles): schemes with the verified articles."""
    key = [KEY, "pattern", "seq"]
    listed = articles.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(F.concat("code", F.lit(" ст. "), "number"))), "; ").alias("articles"))
    d = patterns.join(scored.select(KEY, "account_type"), KEY).join(reasons, key).join(listed, key, "left")
    return d.select(*key, "confidence", "reason", pattern_counter().alias("counter_evidence"), F.coalesce("articles", F.lit("")).alias("articles"))


def txn_flags(evidence: dict) -> DataFrame:
    """Rows named in any evidence, with the modules that named them."""
    out = None
    for module, df in evidence.items():
        p = df.select(KEY, "seq", F.lit(module).alias("module"))
        out = p if out is None else out.unionByName(p)
    return out.filter("seq is not null").groupBy(KEY, "seq").agg(F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules"))


def _list(df: DataFrame, name: str, k: int, order: str = "rank_in_account") -> DataFrame:
    """At most ``k`` evidence rows per account as an ordered array."""
    cols = [c for c in df.columns if c not in (KEY, order)]
    return df.filter(F.col(order) <= k).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(order, *cols))).alias(name))


def assemble_report(scored: DataFrame, prof: DataFrame, lists: dict) -> DataFrame:
    """One JSON document per account; every list is cut to its display limit beforehand."""
    out = scored.join(prof.drop("account_type"), KEY)
    for name, (df, k) in lists.items():
        out = out.join(_list(df, name, k), KEY, "left")
    body = F.struct("composite_score", "risk_level", F.struct("account_type", "avg_monthly_income", "avg_monthly_expense", "income_regularity", "pass_through_ratio").alias("account_profile"),
                    F.struct(*MODULES).alias("module_scores"), *lists)
    return out.select(KEY, "composite_score", "risk_level", F.to_json(body).alias("report"))


def case_facts(scored: DataFrame, prof: DataFrame, counts: DataFrame) -> DataFrame:
    """Facts a written conclusion may use, with the numbers already formatted."""
    d = scored.join(prof.drop("account_type"), KEY).join(counts, KEY)
    return d.select(KEY, "risk_level", F.format_number("composite_score", 1).alias("score"), "account_type",
                    _money("avg_monthly_income").alias("monthly_income"), _money("avg_monthly_expense").alias("monthly_expense"),
                    "patterns", "bursts", "splits", "pairs", "large", "duplicates", F.format_number("high_risk_pct", 1).alias("high_risk_pct"))
