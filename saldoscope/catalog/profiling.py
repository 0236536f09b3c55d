"""Profile, whitelist."""

from ..config import keywords as K
from ..operators import base as B
from ..operators import profile as P
from ..sources.book import TXN_ORACLE_SQL
from . import oracle as O
from .registry import query

O.fragment("txn", TXN_ORACLE_SQL)


def spread(n, s, q):
    return f"greatest({q} - {s} * {s} / {n}, 0.0)"


def std_pop(n, s, q):
    return f"sqrt({spread(n, s, q)} / {n})"


def std_samp(n, s, q):
    return f"(case when {n} > 1 then sqrt({spread(n, s, q)} / ({n} - 1)) end)"


O.fragment("month_flow", f"""select account_id, {O.month()} m,
  sum(case when amount > 0 then amount end) inc, sum(case when amount < 0 then -amount end) exp
  from {{{{txn}}}} group by 1, 2""")
O.fragment("flow_sums", """select account_id, count(inc) inc_n, sum(inc)::double inc_s, sum(inc*inc)::double inc_q,
  count(exp) exp_n, coalesce(sum(exp)::double, 0.0) exp_s from {{month_flow}} group by 1""")
O.fragment("flows", f"""select account_id,
  case when inc_n > 0 then coalesce(inc_s,0.0)/inc_n else 0.0 end avg_monthly_income,
  case when exp_n > 0 then exp_s/exp_n else 0.0 end avg_monthly_expense,
  case when inc_n > 1 and inc_s > 0 then {std_pop('inc_n','inc_s','inc_q')}/(inc_s/inc_n) else 0.0 end monthly_income_cv,
  case when inc_s > 0 then least(1.0, exp_s/inc_s) else 0.0 end pass_through_ratio from {{{{flow_sums}}}}""")
O.fragment("name_flags", f"""select account_id,
  count(distinct case when amount > 0 and nm <> '' then nm end) income_source_count,
  count(distinct case when amount < 0 and nm <> '' then nm end) expense_destination_count,
  bool_or(amount > 0 and (is_salary or {O.any_of('nm', K.SALARY)} or {O.any_of("upper(coalesce(description,''))", K.SALARY)})) has_salary_flag,
  bool_or(amount > 0 and {O.any_of('nm', K.GOVERNMENT)}) has_pension_flag,
  bool_or({O.any_of('nm', K.CRYPTO)}) has_crypto_activity
  from (select *, upper({O.CP_PROFILE}) nm from {{{{txn}}}} where amount <> 0) group by 1""")

query("income_regularity", f"""select account_id, case when n < 2 then 0.5::double else greatest(0.0::double, 1.0 - {std_pop('n','s','q')}/15.0::double) end income_regularity
  from (select account_id, count(*) n, sum(d)::double s, sum(d*d)::double q from
    (select account_id, {O.month()} m, min(day(ts)) d from {{{{txn}}}} where amount > 0 group by 1,2) group by 1)""")(
    lambda b: P.income_regularity(b.txn))

O.fragment("profile", """select f.*, coalesce(income_source_count,0) income_source_count, coalesce(expense_destination_count,0) expense_destination_count,
  coalesce(has_salary_flag,false) has_salary_flag, coalesce(has_pension_flag,false) has_pension_flag,
  coalesce(has_crypto_activity,false) has_crypto_activity, coalesce(income_regularity,0.0) income_regularity,
  coalesce(expense_destination_count,0) > 20 has_business_activity,
  case when has_pension_flag and avg_monthly_income < 300000 then 'pensioner'
    when has_crypto_activity and pass_through_ratio > 0.6 then 'trader'
    when has_salary_flag and income_source_count <= 8 and income_regularity >= 0.5 and monthly_income_cv <= 0.35 then 'salary_employee'
    when income_source_count > 10 and expense_destination_count > 30 and avg_monthly_income > 2000000 then 'business_owner'
    when income_source_count >= 3 and monthly_income_cv > 0.30 and not has_salary_flag then 'freelancer'
    when avg_monthly_income < 150000 then 'student' else 'unknown' end account_type
  from {{flows}} f left join {{name_flags}} using (account_id) left join {{income_regularity}} using (account_id)""")
query("account_profile", "select * from {{profile}}")(lambda b: b.profile)
query("account_type", "select account_id, account_type from {{profile}}")(lambda b: b.profile.select("account_id", "account_type"))

NOT_FAMILY = K.MERCHANT + K.UTILITY + K.INSURANCE + K.TRANSPORT + K.MORTGAGE
query("family_transfers", f"""select account_id, cp, months, n payments, {std_pop('n','s','q')}/(s/n) amount_cv from
  (select account_id, {O.CP_STRICT} cp, count(distinct {O.month()}) as months, count(*) n, sum(-amount)::double s, sum(amount*amount)::double q
   from {{{{txn}}}} where amount < 0 and {O.CP_STRICT} <> '' and not {O.any_of('trim(upper(' + O.CP_STRICT + '))', NOT_FAMILY)} group by 1,2)
  where months >= 3 and n >= 3 and {std_pop('n','s','q')}/(s/n) < 0.20""")(lambda b: P.family_counterparties(b.txn))

O.fragment("marked", f"""select t.*, case
  when amount > 0 and (is_salary or {O.any_of('up', K.SALARY)} or (has_salary_flag and income_regularity > 0.5)) then 'salary'
  when amount < 0 and {O.any_of('up', K.UTILITY + K.MORTGAGE + K.INSURANCE)} then 'utility'
  when amount < 0 and {O.any_of('up', K.TRANSPORT)} then 'transport'
  when amount < 0 and f.cp is not null then 'family' end whitelist_reason
  from (select *, {O.CP_STRICT} cps, upper({O.CP_STRICT}) || ' ' || upper(trim(coalesce(description,''))) up from {{{{txn}}}}) t
  join (select account_id, has_salary_flag, income_regularity from {{{{profile}}}}) p using (account_id)
  left join {{{{family_transfers}}}} f on f.account_id = t.account_id and f.cp = t.cps""")
O.fragment("clean", "select * exclude (cps, up, whitelist_reason) from {{marked}} where whitelist_reason is null")

query("whitelist_rows", "select account_id, seq, whitelist_reason from {{marked}} where whitelist_reason is not null")(
    lambda b: P.whitelist_reasons(b.txn, b.profile).filter("whitelist_reason is not null").select("account_id", "seq", "whitelist_reason"))
for reason in ("salary", "utility", "transport"):
    query(f"whitelist_{reason}", f"select account_id, count(*) n, sum(amount)::double amount from {{{{marked}}}} where whitelist_reason = '{reason}' group by 1")(
        lambda b, r=reason: P.whitelist_reasons(b.txn, b.profile).filter(f"whitelist_reason = '{r}'").groupBy("account_id").agg(
            B.F.count("*").alias("n"), B.total("amount").alias("amount")))
query("apply_whitelist", "select account_id, count(*) n, sum(amount)::double amount from {{clean}} group by 1")(
    lambda b: b.clean.groupBy("account_id").agg(B.F.count("*").alias("n"), B.total("amount").alias("amount")))
query("looks_like_merchant", f"select distinct {O.CP_STRICT} as cp, {O.any_of('trim(upper(' + O.CP_STRICT + '))', NOT_FAMILY)} as merchant from {{{{txn}}}}")(
    lambda b: b.txn.select(B.cp_strict().alias("cp")).distinct().withColumn("merchant", P.looks_like_merchant(B.F.col("cp"))))
query("investment_rows", """select account_id, count(*) n, sum(amount)::double amount from {{txn}} join (select account_id, account_type, avg_monthly_income from {{profile}}) using (account_id)
  where account_type = 'trader' or (avg_monthly_income > 0 and abs(amount::double)/avg_monthly_income < 0.10) group by 1""")(
    lambda b: P.investment_rows(b.txn, b.profile).groupBy("account_id").agg(B.F.count("*").alias("n"), B.total("amount").alias("amount")))
query("payroll_days", f"""select account_id, {O.day()} as day, count(distinct {O.CP_STRICT}) payees from {{{{txn}}}}
  where amount < 0 and {O.CP_STRICT} <> '' and account_id in (select account_id from {{{{profile}}}} where account_type = 'business_owner')
  group by 1,2 having count(distinct {O.CP_STRICT}) >= 3""")(lambda b: P.payroll_days(b.txn, b.profile))
query("cashflow_expenses", f"""select account_id, seq, amount::double amount, (epoch_us(ts) - li) / 3600000000.0::double gap_hours from
  (select *, max(case when amount > 0 then epoch_us(ts) end) over (partition by account_id order by ts range between unbounded preceding and current row) li from {{{{txn}}}})
  where amount < 0 and {O.any_of('upper(' + O.CP_STRICT + ')', K.CASHFLOW_PAYEE)} and epoch_us(ts) - li <= 172800000000""")(
    lambda b: P.cashflow_expenses(b.txn))
