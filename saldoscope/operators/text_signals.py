"""Signals in transaction descriptions and the audit of numbers in prose."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import keywords as K
from ..config import language as L
from . import base as B
from .base import KEY


def _low():
    return F.lower(F.trim(F.coalesce("description", F.lit(""))))


def keyword_rows(txn: DataFrame, words) -> DataFrame:
    """One row per (transaction, keyword found in it)."""
    listed = F.array(*[F.lit(w) for w in words])
    d = txn.select(KEY, "seq", _low().alias("text")).filter(B.has_any(F.col("text"), words))
    return d.select(KEY, "seq", F.explode(F.filter(listed, lambda w: F.contains(F.col("text"), w))).alias("keyword"))


def critical_keywords(txn: DataFrame) -> DataFrame:
    g = keyword_rows(txn, K.TEXT_CRITICAL).groupBy(KEY, "keyword").agg(F.count("*").alias("hits"))
    return g.withColumn("impact", F.col("hits") * 15.0)


def medium_keywords(txn: DataFrame) -> DataFrame:
    """Counted always; only the first two rows of a keyword score."""
    g = keyword_rows(txn, K.TEXT_MEDIUM).groupBy(KEY, "keyword").agg(F.count("*").alias("hits"))
    return g.withColumn("impact", F.least(F.col("hits"), F.lit(2)) * 5.0)


def medium_scoring_rows(txn: DataFrame) -> DataFrame:
    return B.topk(keyword_rows(txn, K.TEXT_MEDIUM), [KEY, "keyword"], ["seq"], 2)


def copy_paste(txn: DataFrame) -> DataFrame:
    d = txn.select(KEY, _low().alias("text"), F.trim(F.coalesce("counterparty", F.lit(""))).alias("cp")).filter(F.length("text") > 5)
    g = d.groupBy(KEY, "text", "cp").agg(F.count("*").alias("n")).groupBy(KEY, "text").agg(F.count("*").alias("counterparties"), F.sum("n").alias("n"))
    return g.filter("counterparties >= 3").withColumn("impact", F.least(F.lit(15.0), F.col("counterparties") * 2.5))


def wording_mismatch(txn: DataFrame) -> DataFrame:
    t, a = F.lower("type"), F.col("amount")
    one = B.has_any(_low(), K.TEXT_INCOME_WORDS) & (a < 0) & t.contains("transfer")
    two = B.has_any(_low(), K.TEXT_EXPENSE_WORDS) & (a > 0) & (t.contains("income") | t.contains("transfer_in"))
    return txn.select(KEY, "seq", F.when(one, "income words on an outgoing row").when(two, "spending words on an incoming row").alias("reason")).filter("reason is not null").withColumn("impact", F.lit(8.0))


def serial_rows(txn: DataFrame) -> DataFrame:
    pattern = "(?iu)(" + K.SERIAL_REGEX.replace(r"(\d{3,})", "").replace(r"\s*", "") + r"\s*)(\d{3,})"
    text = F.coalesce("description", F.lit(""))
    d = txn.select(KEY, "seq", F.regexp_extract_all(text, F.lit(pattern), 1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("n"))
    d = d.filter(F.size("p") > 0).select(KEY, "seq", F.explode(F.arrays_zip("p", "n")).alias("z"))
    return d.select(KEY, "seq", F.lower(F.trim("z.p")).alias("prefix"), F.expr("try_cast(z.n as decimal(38,0))").alias("number")).filter("number is not null")


def serial_numbers(txn: DataFrame, least: int = 3) -> DataFrame:
    """Longest run of numbers growing by one, per prefix. A repeated number ends a run and
    starts the next one."""
    keys = [KEY, "prefix"]
    rows = serial_rows(txn)
    nums = rows.groupBy(*keys, F.col("number").alias("t")).agg(F.count("*").alias("n"))
    d = B.islands(nums, keys, 1, 65536)
    d = B.sliced_cumsum(d, keys, "t", ["t"], {"rep": F.when(F.col("n") > 1, 1).otherwise(0)}, 65536)
    d = d.withColumn("part", F.col("rep") - F.when(F.col("n") > 1, 1).otherwise(0))
    seg = d.groupBy(*keys, "run", "part").agg(F.count("*").alias("len"), F.min("t").alias("first"))
    seg = seg.withColumn("len", F.col("len") + F.when(F.col("first") > F.col("run"), 1).otherwise(0))
    top = seg.groupBy(*keys).agg(F.max("len").alias("longest")).join(nums.groupBy(*keys).agg(F.sum("n").alias("rows")), keys)
    return top.filter((F.col("longest") >= least) & (F.col("rows") >= 3)).withColumn("impact", F.least(F.lit(15.0), F.col("longest") * 2.0))


def mixed_rows(txn: DataFrame) -> DataFrame:
    text = F.trim(F.coalesce("description", F.lit("")))
    cyr, lat = F.length(F.regexp_replace(text, "[^а-яА-ЯёЁ]", "")), F.length(F.regexp_replace(text, "[^a-zA-Z]", ""))
    return txn.select(KEY, "seq", F.length(text).alias("len"), cyr.alias("cyr"), lat.alias("lat")).filter("len >= 10 and cyr > 0 and lat > 0").filter(
        F.least("cyr", "lat") / (F.col("cyr") + F.col("lat")) > 0.2)


def language_mixing(txn: DataFrame) -> DataFrame:
    return B.counts(mixed_rows(txn), "n").filter("n >= 3").withColumn("impact", F.lit(3.0))


def text_score(txn: DataFrame, templates: DataFrame) -> DataFrame:
    """Sum of all impacts; ``templates`` are the flagged template clusters."""
    parts = [critical_keywords(txn), medium_keywords(txn), templates, copy_paste(txn), wording_mismatch(txn), serial_numbers(txn), language_mixing(txn)]
    all_ = None
    for p in parts:
        x = p.select(KEY, F.col("impact").cast("decimal(18,2)").alias("impact"))
        all_ = x if all_ is None else all_.unionByName(x)
    return all_.groupBy(KEY).agg(F.least(F.lit(100.0), F.sum("impact").cast("double")).alias("risk_score"), F.count("*").alias("findings"))


def suspicious_rows(txn: DataFrame, template_texts: DataFrame) -> DataFrame:
    """Distinct rows named by any finding; ``template_texts`` are the texts of flagged template clusters."""
    paste = copy_paste(txn).select(KEY, "text").union(template_texts.select(KEY, "text"))
    pasted = txn.withColumn("text", _low()).join(paste, [KEY, "text"], "left_semi").select(KEY, "seq")
    mixed = mixed_rows(txn).join(language_mixing(txn).select(KEY), KEY, "left_semi")
    runs = serial_numbers(txn).select(KEY, "prefix", "longest")
    serial = serial_rows(txn).join(runs, [KEY, "prefix"])
    serial = B.sliced_cumsum(serial, [KEY, "prefix"], "number", ["number", "seq"], {"c": F.lit(1)}, 65536).filter("c <= longest")
    parts = [keyword_rows(txn, K.TEXT_CRITICAL), medium_scoring_rows(txn), pasted, wording_mismatch(txn), serial, B.topk(mixed, [KEY], ["seq"], 10)]
    out = None
    for p in parts:
        x = p.select(KEY, "seq")
        out = x if out is None else out.unionByName(x)
    return out.distinct().groupBy(KEY).agg(F.count("*").alias("n_suspicious"))


# ---- numbers in prose
def _plain(raw):
    c = F.regexp_replace(raw, r"\s", "")
    c = F.replace(F.regexp_replace(c, r",(?=\d{3}(?:\D|$))", ""), F.lit(","), F.lit("."))
    return c.try_cast("double")


def _shown(v):
    return F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(F.format_string("%.2f", v))


def _numbers(text):
    return F.regexp_extract_all(text, F.lit(f"({L.NUMBER})"), 1)


def audit_numbers(texts: DataFrame) -> DataFrame:
    """Numbers of ``text`` that do not occur in ``facts``; small ones, dates and list
    numbers are left out."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), L.LIST_MARKER, " "), L.DATE, " ")
    known = F.transform(_numbers(F.coalesce("facts", F.lit(""))), lambda n: _shown(_plain(n)))
    d = texts.withColumn("known", known).withColumn("said", _numbers(body))
    odd = F.filter("said", lambda n: _plain(n).isNotNull() & (F.abs(_plain(n)) > 3) & ~F.array_contains(F.col("known"), _shown(_plain(n))))
    return d.withColumn("invented", odd).drop("known", "said")


def foreign_script(text):
    """Fragments in scripts a report never uses."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsArabic}\p{IsThai}]+)"), 1)))
