"""Enrichment: counterparty classes, salary by behaviour, categories, contacts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import keywords as K
from ..config import names as NM
from ..functions import names as N
from . import base as B
from .base import KEY


def _key():
    return F.trim(B.cp_desc())


def classify(names: DataFrame, lookup: DataFrame) -> DataFrame:
    """Class of each distinct name: operation words, sole trader, mask tag, reference table,
    rule. Names are made distinct first, so the rules run once per name."""
    d = names.select("name").distinct().join(lookup, "name", "left").withColumn("r", N.classify_rule("name"))
    rule = F.col("r")
    known = F.struct(F.col("known_kind").alias("kind"), F.col("known_name").alias("merchant_name"), F.col("known_type").alias("merchant_type"),
                     F.lit(0.9).alias("confidence"), F.lit("cache").alias("source"))
    nothing = F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("merchant_name"), F.lit(None).cast("string").alias("merchant_type"),
                       F.lit(0.0).alias("confidence"), F.lit("rule").alias("source"))
    out = (F.when(N.is_operation_description("name"), nothing)
           .when(N.is_sole_trader("name") & (rule["kind"] != "unknown"), rule)
           .when(rule["source"] == "anonymizer", rule)
           .when(F.col("known_kind").isNotNull() & (F.col("known_kind") != "person"), known).otherwise(rule))
    return d.select("name", out.alias("o")).select("name", "o.*")


def apply_classification(txn: DataFrame, classes: DataFrame) -> DataFrame:
    """Fill empty fields only; what the statement says stays. Classes may come with a category."""
    given = F.col("category") if "category" in classes.columns else F.lit(None).cast("string")
    c = classes.select(F.col("name").alias("_key"), "kind", F.col("merchant_name").alias("_mn"), F.col("merchant_type").alias("_mt"), given.alias("_ct"))
    d = txn.withColumn("_key", _key()).join(c, "_key", "left")
    kind = F.when((F.col("counterparty_type") == "unknown") & F.col("kind").isNotNull(), F.col("kind")).otherwise(F.col("counterparty_type"))
    d = d.withColumn("counterparty_type", kind).withColumn("merchant_name", F.coalesce(B.blank_to_null("merchant_name"), F.col("_mn")))
    kept = B.blank_to_null("merchant_type") if "merchant_type" in txn.columns else F.lit(None).cast("string")
    category = B.blank_to_null("category") if "category" in txn.columns else F.lit(None).cast("string")
    return d.withColumn("merchant_type", F.coalesce(kept, F.col("_mt"))).withColumn("category", F.coalesce(category, F.col("_ct"))).drop("_key", "kind", "_mn", "_mt", "_ct")


def names_by_turnover(txn: DataFrame, k: int = 60) -> DataFrame:
    g = txn.groupBy(KEY, _key().alias("name")).agg(B.total(F.abs("amount")).alias("turnover")).filter("name <> ''")
    return B.topk(g, [KEY], [F.desc("turnover"), "name"], k)


def generic_source(name):
    """The name describes how money came in, not who paid."""
    c = N.squeeze(F.lower(F.translate(F.coalesce(name, F.lit("")), "Əə", "Әә")))
    parts = F.transform(F.split(c, "/"), lambda p: F.trim(p))
    exact = c.isin(*K.GENERIC_SOURCES) | F.arrays_overlap(parts, F.array(*[F.lit(m) for m in K.GENERIC_SOURCES]))
    starts = c.rlike("^(?:%s)" % B.word_pattern([m + " " for m in K.GENERIC_SOURCES]))
    return exact | starts | B.has_any(c, [m for m in K.GENERIC_SOURCES if len(m) >= 12])


def salary_sources(txn: DataFrame) -> DataFrame:
    """Payers that behave like an employer."""
    inc = txn.filter("amount > 0").withColumn("source", B.cp_salary()).filter("source <> ''").filter(~generic_source(F.col("source")))
    a = F.col("amount")
    m = inc.groupBy(KEY, "source", B.month().alias("m")).agg(
        F.min(F.dayofmonth("ts")).alias("d"), F.count("*").alias("n"), F.sum(a).alias("s"), F.sum(a * a).alias("q"),
        F.max((F.col("counterparty_type") == "person") | F.col("is_pension_benefit")).alias("bad"))
    g = m.groupBy(KEY, "source").agg(
        F.count("*").alias("months"), F.sum("n").alias("a_n"), F.sum("s").cast("double").alias("a_s"), F.sum("q").cast("double").alias("a_q"),
        *B.moments("d", "d"), F.max("bad").alias("bad"), F.median("d").alias("md"))
    g = g.withColumn("day_stdev", B.std_samp("d")).withColumn("amount_cv", B.std_samp("a") / B.mean_of("a"))
    g = g.filter("not bad and a_n >= 3 and months >= 3").filter((F.col("a_n") / F.col("months") <= 3) & (F.col("day_stdev") <= 8) & (F.col("amount_cv") <= 0.6))
    med = B.exact_median(inc.join(g.select(KEY, "source"), [KEY, "source"], "left_semi"), [KEY, "source"], "amount", "median_amount")
    return g.join(med, [KEY, "source"]).select(KEY, "source", F.col("a_n").alias("payments"), "months", "median_amount",
                                               F.rint("md").cast("int").alias("day_of_month"), "day_stdev", "amount_cv")


def mark_salary(txn: DataFrame, sources: DataFrame) -> DataFrame:
    s = sources.select(KEY, "source", F.lit(True).alias("_hit"))
    d = txn.withColumn("source", B.cp_salary()).join(s, [KEY, "source"], "left")
    return d.withColumn("is_salary", F.col("is_salary") | ((F.col("amount") > 0) & F.coalesce("_hit", F.lit(False)))).drop("source", "_hit")


# ---- categories
def statement_label():
    arms = None
    for t, label in K.STATEMENT_LABELS.items():
        cond = F.col("type") == t
        arms = F.when(cond, label) if arms is None else arms.when(cond, label)
    return arms.otherwise("Разное")


def _desc():
    return F.coalesce("description", F.lit(""))


def contact_name():
    skip = B.has_any(F.lower(_desc()), [w.lower() for w in K.CONTACT_SKIP])
    found = F.trim(F.regexp_extract(_desc(), K.CONTACT_REGEX, 1))
    return F.when(~skip, B.blank_to_null(found))


def contact_frequency(txn: DataFrame) -> DataFrame:
    d = txn.withColumn("label", statement_label()).filter(F.col("label").isin("Перевод", "Пополнение")).withColumn("contact", contact_name())
    g = d.filter("contact is not null").groupBy(KEY, "contact").agg(F.count("*").alias("n"))
    return g.withColumn("is_frequent", F.col("n") >= 5)


def _first_rule(text, rules, fold):
    """First (category, word) whose word occurs; the list order decides."""
    every = [fold(w) for _, ws in rules for w in ws]
    pick = F.lit(None)
    for cat, ws in reversed(rules):
        names = F.create_map(*[F.lit(x) for w in reversed(ws) for x in (fold(w), w)])
        word = B.first_word(text, [fold(w) for w in ws])
        pick = F.when(B.has_any(text, [fold(w) for w in ws]), F.struct(F.lit(cat).alias("category"), names[word].alias("sub"))).otherwise(pick)
    return F.when(B.has_any(text, every), pick)


def categorise(txn: DataFrame) -> DataFrame:
    """Category and subcategory of every row, frequent contacts included."""
    freq = contact_frequency(txn).filter("is_frequent").select(KEY, "contact", F.lit(True).alias("_freq"))
    d = txn.withColumn("label", statement_label()).withColumn("contact", contact_name()).join(freq, [KEY, "contact"], "left")
    low, often = F.lower(_desc()), F.coalesce("_freq", F.lit(False))

    def pair(cat, sub):
        cat = F.lit(cat) if isinstance(cat, str) else cat
        return F.struct(cat.alias("category"), (F.lit(sub) if isinstance(sub, str) else sub).alias("sub"))

    def contact(yes, no):
        return F.when(F.col("contact").isNotNull(), pair(F.when(often, yes).otherwise(no), F.col("contact")))

    head = F.substring(_desc(), 1, 30)
    buy = F.coalesce(_first_rule(F.upper(_desc()), K.EXPENSE_CATEGORIES, str.upper), pair("Прочие покупки", "Другое"))
    send = F.coalesce(_first_rule(low, K.TRANSFER_CATEGORIES, str.lower), contact("Частые контакты", "Остальные контакты"), pair("Перевод", head))
    get = F.coalesce(_first_rule(low, K.INCOME_CATEGORIES, str.lower), contact("От частых контактов", "От остальных"), pair("Пополнение", head))
    misc = (F.when(low.contains("комиссия"), pair("Банковские услуги", "Комиссия"))
            .when(low.contains("страхов"), pair("Страхование", "Страховка")).otherwise(pair("Разное", "Другое")))
    out = (F.when(F.col("label") == "Покупка", buy).when(F.col("label") == "Перевод", send).when(F.col("label") == "Пополнение", get)
           .when(F.col("label") == "Снятие", pair("Снятие наличных", "Снятие")).otherwise(misc))
    d = d.withColumn("_c", out).withColumn("category", F.col("_c.category")).withColumn("subcategory", F.col("_c.sub"))
    return d.drop("_c", "_freq")


def case_contacts(txn: DataFrame) -> DataFrame:
    rows = txn.filter(F.col("type").isin("transfer_in", "transfer_out"))
    d = rows.withColumn("contact", F.regexp_extract(_desc(), NM.CASE_CONTACT_REGEX, 1)).filter("contact <> ''")
    return d.groupBy(KEY, "contact").agg(F.count("*").alias("n")).withColumn("is_frequent", F.col("n") >= 3)
