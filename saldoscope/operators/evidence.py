"""What stands behind a flag: the rows of each scheme, reasons in words, and articles that apply."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import legal as L
from . import base as B
from . import patterns as P
from . import statutes as ST
from .base import KEY


def number(c) -> Column:
    """Whole number with commas between thousands."""
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def percent(c: Column) -> Column:
    return F.format_string("%.0f", F.rint(c * 100))


def filled(template: str, *values: Column) -> Column:
    """A template with its {} replaced, in order."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, text in zip(values, parts[1:]):
        out += [v.cast("string"), F.lit(text)]
    return F.concat(*out)


def scheme_rows(txn: DataFrame, lim: DataFrame, found: dict[str, DataFrame], hours: int = 72) -> DataFrame:
    """(account_id, pattern, part, seq): every row that belongs to a scheme; ``part`` tells chains of one account apart.

    ``found`` holds the schemes by name. Layering rows are the incomes and all payments within
    72 hours of one; the last income before a payment decides, so no pairs are formed.
    """
    named = lambda df, name, part=None: df.select(KEY, F.lit(name).alias("pattern"), (part if part is not None else F.lit(None)).cast("long").alias("part"), "seq")
    width = hours * B.HOUR_US
    incomes = found["money_laundering_layering"].select(KEY, "seq", F.col("seq").alias("income"))
    at = txn.join(incomes.select(KEY, "seq"), [KEY, "seq"], "left_semi").select(KEY, B.us().alias("t")).distinct()
    outs = txn.where("amount < 0").join(incomes.select(KEY).distinct(), KEY, "left_semi").select(KEY, "seq", B.us().alias("t"), F.lit(None).cast("long").alias("mark"))
    line = outs.unionByName(at.select(KEY, F.lit(None).cast("long").alias("seq"), "t", F.col("t").alias("mark")))
    near = B.carry_last(line, [KEY], "t", F.col("mark"), "last", B.DAY_US).where(F.col("seq").isNotNull() & (F.col("t") - F.col("last") <= width))
    layered = named(near, "money_laundering_layering").unionByName(named(incomes, "money_laundering_layering"))
    t, out = F.col("threshold"), F.abs(B.dbl("amount"))
    in_scheme = lambda df, name: df.join(found[name].select(KEY).distinct(), KEY, "left_semi")
    under = in_scheme(txn.where("amount < 0").join(lim.select(KEY, "threshold"), KEY).where((out >= t * 0.90) & (out < t)), "structuring")
    small = txn.where((F.col("amount") < 0) & (F.abs("amount") < 10000) & P.foreign_currency().isNotNull()).select(KEY, "seq", B.us().alias("t"))
    runs = B.islands(small.select(KEY, "t").distinct(), [KEY], 2 * B.HOUR_US)
    firsts = small.join(runs, [KEY, "t"])
    chains = found["carding"].select(KEY, F.col("seq").alias("first")).join(firsts.select(KEY, F.col("seq").alias("first"), "run"), [KEY, "first"]).select(KEY, "run", "first")
    carded = firsts.join(chains, [KEY, "run"])
    totals = found["pyramid_scheme"].select(KEY, "total_in")
    people = txn.where(P.is_person()).join(totals, KEY)
    payers = people.where("(amount > 0 and amount < 200000) or -amount > total_in * 0.5")
    paid = in_scheme(txn.where((F.col("amount") < 0) & F.abs("amount").between(10000, 100000) & P.is_person()), "human_trafficking_payments")
    cash = in_scheme(txn.where((F.col("amount") > 0) & P.is_cash()), "tax_evasion_cash")
    out = layered.unionByName(named(under, "structuring")).unionByName(named(carded, "carding", F.col("first"))).unionByName(named(payers, "pyramid_scheme"))
    return out.unionByName(named(paid, "human_trafficking_payments")).unionByName(named(cash, "tax_evasion_cash")).distinct()


def scheme_evidence(patterns: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(account_id, pattern, seq, evidence): numbers of the first rows behind a scheme.

    A layering or pyramid scheme is told by the one row it is named after.
    """
    single = ("money_laundering_layering", "pyramid_scheme")
    first = B.topk(rows.where(~F.col("pattern").isin(*single)), [KEY, "pattern", "part"], ["seq"], k, "_r")
    lists = first.groupBy(KEY, "pattern", "part").agg(F.array_join(F.array_sort(F.collect_list("seq")), ",").alias("evidence")).withColumnsRenamed({KEY: "_a", "pattern": "_p"})
    d = patterns.select(KEY, "pattern", "seq")
    same = (F.col(KEY) == F.col("_a")) & (F.col("pattern") == F.col("_p")) & (F.col("part").isNull() | (F.col("part") == F.col("seq")))
    return d.join(lists, same, "left").select(KEY, "pattern", "seq", F.coalesce("evidence", F.col("seq").cast("string")).alias("evidence"))


def scheme_reasons(found: dict[str, DataFrame], lim: DataFrame) -> DataFrame:
    """(account_id, pattern, seq, reason): why each scheme was named, with its numbers."""
    text = L.PATTERN_REASONS
    layered = found["money_laundering_layering"]
    under = found["structuring"].join(lim.select(KEY, "threshold"), KEY)
    cash = found["tax_evasion_cash"]
    values = {
        "money_laundering_layering": (layered, number("income_amount"), F.col("destinations"), percent(F.col("total_out") / F.col("income_amount")), F.col("outflows")),
        "structuring": (under, F.col("n"), number(F.col("threshold") * 0.90), number("threshold"), number("threshold")),
        "carding": (found["carding"], F.col("n"), F.col("merchants")),
        "pyramid_scheme": (found["pyramid_scheme"], F.col("payers"), number("total_in"), number("outflow")),
        "human_trafficking_payments": (found["human_trafficking_payments"], F.col("recipients"), F.col("n"), number("total_amount")),
        "tax_evasion_cash": (cash, number("cash"), percent(F.col("cash") / (F.col("electronic") + 1)), number("electronic")),
    }
    out = None
    for name, (df, *cols) in values.items():
        p = df.select(KEY, F.lit(name).alias("pattern"), "seq", filled(text[name], *cols).alias("reason"))
        out = p if out is None else out.unionByName(p)
    return out


def module_reasons() -> dict[str, Column]:
    """Reason of each module's flag from the counts of its evidence."""
    text, c = L.MODULE_REASONS, F.col
    values = {
        "velocity": (c("bursts"),), "structuring": (c("splits"),), "merchant_risk": (c("high_words"),), "cross_reference": (c("pairs"),),
        "night_transactions": (c("night_count"), c("large")), "duplicate_payments": (c("duplicates"), number("duplicate_amount")),
        "round_amounts": (c("round_count"), percent(c("round_ratio"))), "profile_mismatch": (c("mismatches"),),
    }
    return {m: filled(text[m], *v) for m, v in values.items()}


def scheme_articles(patterns: DataFrame, articles: DataFrame) -> DataFrame:
    """(account_id, pattern, seq, code, number, title, excerpt): articles a scheme refers to, as far as they are verified."""
    spark = patterns.sparkSession
    refs = spark.createDataFrame(list(L.PATTERN_REFERENCE.items()), "text_id string, text string")
    cited = ST.parse_citations(refs).select(F.col("text_id").alias("pattern"), "code", "number").distinct()
    known = ST.annotate(cited, articles).where("verified").select("pattern", "code", "number", "title", "excerpt")
    return patterns.select(KEY, "pattern", "seq").join(known, "pattern")
