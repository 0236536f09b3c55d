"""Queries over rows changed by a rule, where the tables as they are hold nothing that an operator looks for.

The checking SQL is that of the plain query, with the changed rows in place of the others.
"""

from ..operators import analytics as A
from ..operators import base as B
from ..operators import habits as H
from ..operators import patterns as P
from ..operators import profile as PR
from ..operators import text_signals as TS
from ..sources import statements as R
from . import oracle as O
from .cases import printed
from .registry import query

F = P.F


def instead(name, **other):
    """SQL of a query with other fragments in place of those it reads."""
    sql = O.FRAGMENTS[name]
    for old, new in other.items():
        assert f"{{{{{old}}}}}" in sql, (name, old)
        sql = sql.replace(f"{{{{{old}}}}}", f"{{{{{new}}}}}")
    return sql


def changed(df, **exprs):
    return df.withColumns({c: F.expr(e).cast(df.schema[c].dataType) for c, e in exprs.items()})


def changed_sql(source, **exprs):
    return f"select * replace ({', '.join(f'{e} as {c}' for c, e in exprs.items())}) from {{{{{source}}}}}"


# half of the accounts have no rows
O.fragment("txn_half", "select * from {{txn}} where not ends_with(account_id, '7')")
query("empty_statements_half", instead("empty_statements", txn="txn_half"))(lambda b: A.empty_statements(b.account, b.txn.where("not endswith(account_id, '7')")))

# every account is a business
O.fragment("profile_business", "select * replace ('business_owner' as account_type) from {{profile}}")
query("payroll_days_of_businesses", instead("payroll_days", profile="profile_business"))(lambda b: PR.payroll_days(b.txn, b.profile.withColumn("account_type", F.lit("business_owner"))))

# a threshold that many payments come close to
O.fragment("limits_low", "select * replace (60000.0::double as threshold) from {{structuring_limits}}")
low = lambda b: b.structuring_limits.withColumn("threshold", F.lit(60000.0))
query("structuring_pattern_low", instead("structuring_pattern", structuring_limits="limits_low"))(lambda b: P.structuring_pattern(b.txn, low(b)))
query("structuring_evidence_low", instead("structuring_evidence", structuring_limits="limits_low"))(lambda b: P.structuring_evidence(b.txn, low(b)))

# incomes are a hundredth: many small payers, then large payments
SMALL = {"amount": "(case when amount > 0 then cast(amount / 100 as decimal(15,2)) else amount end)"}
O.fragment("txn_small", changed_sql("txn", **SMALL))
query("pyramid_small_payers", instead("pyramid", txn="txn_small"))(lambda b: P.pyramid(changed(b.txn, **SMALL)))

# only what is cash keeps its amount
CASH = {"amount": "(case when amount > 0 and not is_cash_operation then cast(amount / 10000 as decimal(15,2)) else amount end)"}
O.fragment("txn_cash", changed_sql("txn", **CASH))
query("untraced_cash_only", instead("untraced_cash", txn="txn_cash"))(lambda b: P.untraced_cash(changed(b.txn, **CASH)))

# money flows the other way than the words say
TURNED = {"amount": "(-amount)", "type": "(case when amount > 0 then 'transfer_out' else 'transfer_in' end)"}
O.fragment("txn_turned", changed_sql("txn", **TURNED))
query("wording_mismatch_turned", instead("wording_mismatch", txn="txn_turned"))(
    lambda b: TS.wording_mismatch(b.txn.withColumn("type", F.expr(TURNED["type"])).withColumn("amount", (-F.col("amount")).cast("decimal(15,2)"))))

# unusual payments of accounts of three types
ODD = {"amount": "cast(amount * 40 as decimal(15,2))", "type": "(case seq % 4 when 0 then 'crypto_buy' when 1 then 'crypto_sell' when 2 then 'transfer_out' else type end)", "counterparty_type": "(case when seq % 5 = 0 then 'atm' else counterparty_type end)"}
KIND = "(case length(account_id) % 3 when 0 then 'pensioner' when 1 then 'student' else 'salary_employee' end)"
O.fragment("clean_odd", changed_sql("clean", **ODD))
O.fragment("profile_odd", f"select * replace ({KIND} as account_type) from {{{{profile}}}}")
query("unexpected_activity_odd", instead("unexpected_activity", clean="clean_odd", profile="profile_odd"))(
    lambda b: H.unexpected_activity(changed(b.clean, **ODD), b.limits.withColumn("account_type", F.expr(KIND))).join(
        b.clean.groupBy("account_id").agg(F.count("*").alias("_n")).where("_n >= 5").select("account_id"), "account_id", "left_semi"))

# payments of equal size on dates a month apart
MONTHLY = {"ts": "(timestamp '2024-01-01 10:00:00' + make_interval(0, 0, 0, cast(30 * (seq % 5) as int)))"}
O.fragment("dups_monthly", """select account_id, seq, timestamp '2024-01-01 10:00:00' + to_days((30 * (seq % 5))::int) ts, cast(50000 as decimal(15,2)) a, 'p' || (seq // 40)::varchar cp from {{dups}}""")
for _name, _least in (("recurring_keys", 2), ("recurring_keys_from_one_gap", 1)):
    query(f"{_name}_monthly", instead(_name, dups="dups_monthly"))(lambda b, least=_least: H.recurring_keys(b.dups.select(
        "account_id", "seq", F.expr(MONTHLY["ts"]).alias("ts"), F.lit(50000).cast("decimal(15,2)").alias("amount"), F.expr("concat('p', seq div 40)").alias("cp")), least)
        .withColumn("amount", F.col("amount").cast("double")))

# sheets of four shapes: with a header, without one, with the date in the third column, with most dates broken
SHAPE = "ascii(right(account_id, 1)) % 4"


def shapes(b):
    t = b.txn.withColumn("k", F.expr(SHAPE))
    date = F.date_format("ts", "dd.MM.yyyy")
    cp = F.coalesce("counterparty", F.lit(""))
    usual = F.array(F.when((F.col("k") == 3) & (F.col("seq") % 3 != 0), "н/д").otherwise(date), printed(F.col("amount")), cp, F.coalesce("description", F.lit("")))
    rows = t.select("account_id", (F.col("seq") * 2 + 2).alias("row_idx"), F.when(F.col("k") == 2, F.array(cp, F.lit("x"), date, printed(F.col("amount")))).otherwise(usual).alias("cells"))
    head = t.where("k in (0, 3)").select("account_id").distinct().select("account_id", F.lit(1).cast("long").alias("row_idx"), F.array(*map(F.lit, ("Дата", "Сумма", "Контрагент", "Детали"))).alias("cells"))
    return rows, head


O.fragment("shaped", f"select *, {SHAPE} k, seq * 2 + 2 row_idx from {{{{txn}}}}")
query("find_header_shapes", "select account_id, case when k in (0, 3) then 1 when k = 1 then min(row_idx) end::bigint header_row, k in (0, 3) has_names from {{shaped}} group by account_id, k")(
    lambda b: (lambda s: R.find_header(s[0].unionByName(s[1])))(shapes(b)))
query("infer_layout_shapes", """select account_id, case when k = 2 then 2 else 0 end::int date_col, case when k = 2 and not regexp_matches(arg_min(coalesce(counterparty, ''), row_idx), '[\\d\\s]') then 2 else 0 end::int amount_col
  from {{shaped}} where k <> 3 or seq % 3 = 0 group by account_id, k""")(lambda b: (lambda s: R.infer_layout(s[0].unionByName(s[1])))(shapes(b)))
query("validate_layout_shapes", """select account_id, case k when 2 then false when 3 then count(case when seq % 3 = 0 then 1 end) / count(*) >= 0.5 else true end date_ok, k <> 2 amount_ok from {{shaped}} group by account_id, k""")(
    lambda b: R.validate_layout(shapes(b)[0], {"date": 0, "amount": 1}))
# numbers in the text and another sum before the amount
query("text_to_txn_decoys", f"select account_id, seq, {O.day()} as day, amount::double amount from {{{{txn}}}} where amount <> 0")(
    lambda b: R.text_to_txn(b.txn.select("account_id", "seq", F.concat_ws(" ", F.date_format("ts", "dd.MM.yyyy"), "description", F.lit("остаток 7,77"), F.translate(printed(F.col("amount")), " ", "")).alias("line"))).select(
        "account_id", "seq", B.day().alias("day"), B.dbl("amount").alias("amount")))
