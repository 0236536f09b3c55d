"""Velocity and structuring."""

from ..config import keywords as K
from ..operators import base as B
from ..operators import structuring as S
from ..operators import velocity as V
from . import oracle as O
from .profiling import std_samp
from .registry import query

F = B.F


def gate(n, source="clean"):
    return f"account_id in (select account_id from {{{{{source}}}}} group by 1 having count(*) >= {n})"


def greedy(name: str, cand: str, width: int, k: int = 10) -> None:
    """First k windows, each opening after the end of the one before."""
    O.fragment(name, f"""select account_id, min(t) t, 1 as rank_in_account from {{{{{cand}}}}} group by 1
      union all select g.account_id, min(c.t), any_value(g.rank_in_account) + 1 from {{{{{name}}}}} g join {{{{{cand}}}}} c
      on c.account_id = g.account_id and c.t > g.t + {width} where g.rank_in_account < {k} group by g.account_id""")


HOUR = B.HOUR_US
for suffix, threshold in (("", None), ("_low", 6)):
    lim = O.by_type("burst_rows") if threshold is None else str(threshold)
    O.fragment(f"burst_cand{suffix}", f"""select * from (select account_id, t, sum(n) over w n_w, sum(s) over w s_w from
      (select account_id, epoch_us(ts) t, count(*) n, sum(abs(amount)) s from {{{{clean}}}} group by 1,2)
      window w as (partition by account_id order by t range between current row and {2 * HOUR} following))
      join (select account_id, account_type from {{{{profile}}}}) using (account_id) where n_w >= {lim}""")
    greedy(f"burst_pick{suffix}", f"burst_cand{suffix}", 2 * HOUR)
BURST_SQL = f"""select account_id, rank_in_account, {O.stamp('make_timestamp(t)')} started_at, n_w::bigint transaction_count, s_w::double total_amount
  from {{{{burst_pick@}}}} join {{{{burst_cand@}}}} using (account_id, t) where {gate(5)}"""
query("velocity_bursts", BURST_SQL.replace("@", ""))(lambda b: V.velocity_bursts(b.clean, b.limits).drop("t"))
query("velocity_bursts_from_six_rows", BURST_SQL.replace("@", "_low"))(
    lambda b: V.velocity_bursts(b.clean, b.limits.withColumn("burst_rows", F.lit(6))).drop("t"))


def spikes_sql(z, factor, floor):
    return f"""select account_id, rank_in_account, day, transaction_count, total_amount, z_score, {O.rnd('avg_daily', 1)} avg_daily from (
    select *, row_number() over (partition by account_id order by z_score desc, day) rank_in_account from (
      select *, {O.rnd('(transaction_count - avg_daily)/sd', 2)} z_score, (transaction_count - avg_daily)/sd z from (
        select *, s/n avg_daily, {std_samp('n', 's', 'q')} sd from (
          select *, count(*) over w n, (sum(transaction_count) over w)::double s, (sum(transaction_count*transaction_count) over w)::double q from (
            select account_id, {O.day()} as day, count(*) transaction_count, sum(abs(amount))::double total_amount from {{{{clean}}}} group by 1,2)
          window w as (partition by account_id)))
      where n >= 7 and sd > 0)
    where z > {z} and transaction_count >= greatest(avg_daily*{factor}, {float(floor)}))
  where rank_in_account <= 10 and {gate(5)}"""


query("daily_spikes", spikes_sql(3.0, 4.0, 15))(lambda b: V.daily_spikes(b.clean))
query("daily_spikes_mild", spikes_sql(1.0, 1.2, 2))(lambda b: V.daily_spikes(b.clean, 1.0, 1.2, 2))

O.fragment("clean_income", f"""select account_id, sum(s)::double / count(*) seen from (select account_id, {O.month()} m, sum(amount) s from {{{{clean}}}} where amount > 0 group by 1,2) group by 1""")
for suffix, share in (("", None), ("_low", 0.05)):
    O.fragment(f"out_lim{suffix}", f"""select *, greatest(inc*share, 100000.0) lim from (select account_id,
      case when avg_monthly_income > 0 then avg_monthly_income else seen end inc, {O.by_type('outflow_share') if share is None else share}::double share
      from {{{{profile}}}} left join {{{{clean_income}}}} using (account_id)) where inc > 0""")
    O.fragment(f"out_cand{suffix}", f"""select * from (select account_id, t, sum(s) over w s_w from
      (select account_id, epoch_us(ts) t, sum(-amount) s from {{{{clean}}}} where amount < 0 group by 1,2)
      window w as (partition by account_id order by t range between current row and {24 * HOUR} following))
      join {{{{out_lim{suffix}}}}} using (account_id) where s_w::double >= lim""")
    greedy(f"out_pick{suffix}", f"out_cand{suffix}", 24 * HOUR)
OUT_SQL = f"""select account_id, rank_in_account, {O.stamp('make_timestamp(t)')} started_at, s_w::double amount_24h, s_w::double/inc*100.0::double pct_of_monthly_income
  from {{{{out_pick@}}}} join {{{{out_cand@}}}} using (account_id, t) where {gate(5)}"""
query("outflow_24h", OUT_SQL.replace("@", ""))(lambda b: V.outflow_24h(b.clean, b.limits))
query("outflow_24h_five_percent", OUT_SQL.replace("@", "_low"))(lambda b: V.outflow_24h(b.clean, b.limits, share=0.05))

query("counterparty_churn", f"""select account_id, sum(new)::bigint total_unique, max(avg_new) avg_new_per_day, max(new) max_new_per_day,
  count(case when new > greatest(avg_new*4, 5.0) then 1 end) high_churn_days from (
    select *, (sum(new) over (partition by account_id))::double / count(*) over (partition by account_id) avg_new from (
      select account_id, {O.day('ts')} as day, count(*) new from (
        select account_id, {O.CP_DESC} cp, min(ts) ts from {{{{clean}}}} where {O.CP_DESC} <> '' group by 1,2) group by 1,2))
  where {gate(5)} group by 1""")(lambda b: V.counterparty_churn(b.clean))


def steps(x, arms):
    return "case " + " ".join(f"when {x} {op} {v} then {p}" for op, v, p in arms) + " else 0 end"


def per(source, expr="count(*)", name="n", where="true"):
    return f"(select account_id, {expr} {name} from {{{{{source}}}}} where {where} group by 1)"


O.fragment("accounts", "select distinct account_id from {{txn}}")
query("velocity_score", f"""select account_id, coalesce(bu.n,0) bursts, coalesce(sp.n,0) spikes, coalesce(ou.n,0) outflows,
  least(100, {steps('coalesce(bu.n,0)', [('>=', 8, 30), ('>=', 5, 15), ('>=', 2, 5)])} + {steps('coalesce(ex.n,0)', [('>=', 3, 25), ('>=', 1, 10)])}
  + {steps('coalesce(hi.n,0)', [('>=', 5, 15), ('>=', 3, 8)])} + {steps('coalesce(ou.n,0)', [('>=', 5, 20), ('>=', 3, 10), ('>=', 1, 3)])}
  + {steps('coalesce(ch.high_churn_days,0)', [('>=', 5, 15), ('>=', 2, 5)])})::double score
  from {{{{accounts}}}} left join {per('velocity_bursts')} bu using (account_id) left join {per('daily_spikes')} sp using (account_id)
  left join {per('daily_spikes', where='z_score > 4.0')} ex using (account_id) left join {per('daily_spikes', where='z_score > 3.0 and z_score <= 4.0')} hi using (account_id)
  left join {per('outflow_24h')} ou using (account_id) left join {{{{counterparty_churn}}}} ch using (account_id)""")(
    lambda b: b.velocity_score)

# structuring
O.fragment("str_kept", f"""select * from (select *, trim({O.CP_DESC}) cp, epoch_us(ts) t from {{{{clean}}}})
  where not {O.any_of("upper(coalesce(description,'') || ' ' || coalesce(counterparty,''))", K.STRUCTURING_REGULAR)}""")
O.fragment("recurring_points", f"""select distinct account_id, cp, t, v from (
  select account_id, cp, t, (abs(amount)*100)::bigint v from {{{{str_kept}}}} where cp <> '' and amount <> 0) a where exists (
  select 1 from {{{{str_kept}}}} b where b.account_id = a.account_id and b.cp = a.cp and (
    (b.t - a.t >= {25 * B.DAY_US} and b.t - a.t < {36 * B.DAY_US} and abs((abs(b.amount)*100)::bigint - a.v)*100 <= 3*a.v) or
    (a.t - b.t >= {25 * B.DAY_US} and a.t - b.t < {36 * B.DAY_US} and b.amount <> 0 and abs((abs(b.amount)*100)::bigint - a.v)*100 <= 3*(abs(b.amount)*100)::bigint)))""")
query("structuring_regular_rows", "select account_id, count(*) n from {{str_kept}} group by 1")(
    lambda b: B.counts(S.exclude_regular(b.clean), "n"))
query("recurring_rows", "select account_id, cp, t as at_us, v as cents from {{recurring_points}}")(
    lambda b: S.recurring_points(S.exclude_regular(b.clean)).select("account_id", "cp", F.col("t").alias("at_us"), F.col("v").alias("cents")))
O.fragment("str_rows", """select k.* from {{str_kept}} k anti join {{recurring_points}} r
  on r.account_id = k.account_id and r.cp = k.cp and r.t = k.t and r.v = (abs(k.amount)*100)::bigint""")
query("structuring_limits", """select account_id, account_type, avg_monthly_income,
  case when account_type = 'salary_employee' then 1000000.0::double else greatest(1000000.0::double, avg_monthly_income*0.8::double) end threshold,
  greatest(100000.0::double, avg_monthly_income*0.1::double) min_significant from {{profile}}""")(lambda b: b.structuring_limits)


def str_family(tag, lim_sql, pick):
    O.fragment(f"lim{tag}", lim_sql)
    query(f"just_under{tag}", f"""select account_id, seq, {O.stamp()} at_time, abs(amount)::double amount, threshold,
      {O.rnd('abs(amount)::double/threshold*100.0::double', 1)} pct_of_threshold, {O.CP_DESC} counterparty
      from {{{{str_rows}}}} join {{{{lim{tag}}}}} using (account_id) where abs(amount)::double >= threshold*0.95::double and abs(amount)::double < threshold and {gate(5)}""")(
        lambda b: V.big_enough(S.just_under(b.structuring_rows, pick(b)), b.clean, 5))
    query(f"split_groups{tag}", f"""select * from (select account_id, row_number() over (partition by account_id order by total_amount desc, day, counterparty) rank_in_account,
      counterparty, day, transaction_count, total_amount, total_amount >= threshold exceeds_threshold from (
        select account_id, {O.CP_DESC} counterparty, {O.day()} as day, count(*) transaction_count, sum(-amount)::double total_amount from {{{{str_rows}}}} where amount < 0 group by 1,2,3)
      join {{{{lim{tag}}}}} using (account_id) where transaction_count >= 3 and total_amount >= threshold*0.8::double) where rank_in_account <= 10 and {gate(5)}""")(
        lambda b: V.big_enough(S.split_groups(b.structuring_rows, pick(b)), b.clean, 5))
    query(f"smurfing{tag}", f"""select * from (select account_id, row_number() over (partition by account_id order by r*n desc, r) rank_in_account,
      r amount, n occurrence_count, u unique_counterparties, span date_span_days, r*n total_amount from (
        select account_id, round_even(abs(amount)::double/100.0::double, 0)*100.0::double r, count(*) n, count(distinct {O.CP_DESC}) u,
          (epoch_us(max(ts)) - epoch_us(min(ts))) // {B.DAY_US} span from {{{{str_rows}}}} where amount < 0 group by 1,2)
      join {{{{lim{tag}}}}} using (account_id) where r >= min_significant and n >= 6 and u >= 6) where rank_in_account <= 5 and {gate(5)}""")(
        lambda b: V.big_enough(S.smurfing(b.structuring_rows, pick(b)), b.clean, 5))


str_family("", "select * from {{structuring_limits}}", lambda b: b.structuring_limits)
# the same tests for accounts without a known income
str_family("_no_income", """select account_id, 1000000.0::double threshold, 100000.0::double min_significant from {{profile}}""",
           lambda b: S.structuring_limits(b.profile.withColumn("avg_monthly_income", F.lit(0.0))))
query("split_members", f"""select account_id, rank_in_account, seq, -amount::double amount from (select *, {O.CP_DESC} cpd, {O.day()} dd from {{{{str_rows}}}} where amount < 0) r
  join {{{{split_groups_no_income}}}} g using (account_id) where g.counterparty = r.cpd and g.day = r.dd""")(
    lambda b: S.split_members(b.structuring_rows, V.big_enough(S.split_groups(
        b.structuring_rows, S.structuring_limits(b.profile.withColumn("avg_monthly_income", F.lit(0.0)))), b.clean, 5)))
query("structuring_score", f"""select account_id, coalesce(u.n,0) under, coalesce(s.n,0) splits, coalesce(m.n,0) smurfs,
  (case when coalesce(c.n,0) >= 5 then least(70, least(30, coalesce(u.n,0)*10) + least(40, coalesce(s.n,0)*15) + least(30, coalesce(m.n,0)*15)) else 0 end)::double score
  from {{{{accounts}}}} left join {per('just_under')} u using (account_id) left join {per('split_groups')} s using (account_id)
  left join {per('smurfing')} m using (account_id) left join {per('clean')} c using (account_id)""")(lambda b: b.structuring_score)
