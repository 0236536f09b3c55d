"""Cross-reference, merchants, graph, night, duplicates, round amounts, mismatch, behaviour."""

from ..config import keywords as K
from ..operators import base as B
from ..operators import flows as W
from ..operators import habits as H
from ..operators.velocity import big_enough
from . import oracle as O
from .profiling import std_pop
from .registry import query
from .speed import gate, per, steps

F = B.F
HOUR, DAY = B.HOUR_US, B.DAY_US
UPD = "upper(coalesce(description,''))"
UPT = "upper(coalesce(description,'') || ' ' || coalesce(counterparty,''))"

# cross-reference
query("income_expense_ratio", f"""select *, case when expense > 0 then {O.rnd('income/expense', 3)} else 0.0::double end ratio from (
  select account_id, coalesce(sum(case when amount > 0 then amount end)::double, 0.0) income, coalesce(sum(case when amount < 0 then -amount end)::double, 0.0) expense from {{{{clean}}}} group by 1)""")(
    lambda b: W.income_expense_ratio(b.clean))
O.fragment("pt_rows", f"""select c.account_id, epoch_us(ts) t, seq, amount::double a, {O.CP_DESC} cp from {{{{clean}}}} c join {{{{profile}}}} p using (account_id)
  where abs(amount) >= 200000 and not (amount < 0 and account_type in ('freelancer','business_owner') and {O.any_of('upper(' + O.CP_DESC + ')', K.PASS_THROUGH_MERCHANT)})""")
O.fragment("pt_cand", f"""select i.account_id, i.t, i.seq, i.a, i.rn, e.t t2, e.seq seq2, -e.a a2 from
  (select *, row_number() over (partition by account_id order by t, seq) rn from {{{{pt_rows}}}} where a > 0) i
  join {{{{pt_rows}}}} e on e.account_id = i.account_id and e.a < 0 and e.t between i.t and i.t + {24 * HOUR} and -e.a/i.a between 1 - 0.05::double and 1 + 0.05::double""")
O.fragment("pt_next", "select account_id, rn, min(t2) from {{pt_cand}} group by 1, 2")
# incomes in order; each takes the first expense nobody before it took
O.fragment("pt_walk", """select account_id, 0::bigint rn, []::bigint[] used, null::bigint took from {{accounts}} union all
  select w.account_id, w.rn + 1, case when n.seq2 is null then w.used else list_append(w.used, n.seq2) end, n.seq2
  from {{pt_walk}} w join (select account_id, max(rn) top from {{pt_cand}} group by 1) m on m.account_id = w.account_id and w.rn < m.top
  left join lateral (select c.seq2 from {{pt_cand}} c where c.account_id = w.account_id and c.rn = w.rn + 1 and not list_contains(w.used, c.seq2) order by c.t2, c.seq2 limit 1) n on true""")
O.fragment("pt_pairs", "select c.* from {{pt_walk}} w join {{pt_cand}} c on c.account_id = w.account_id and c.rn = w.rn and c.seq2 = w.took")
query("pass_through_pairs", f"select account_id, t, seq, a amount, t2, seq2, a2 amount2 from {{{{pt_pairs}}}} where {gate(5)}")(lambda b: b.pass_pairs)
query("pass_through", f"""select account_id, rank_in_account, {O.stamp('make_timestamp(t)')} income_at, a income_amount, s.cp income_source, {O.stamp('make_timestamp(t2)')} expense_at,
  a2 expense_amount, d.cp expense_dest, {O.rnd('a2/a', 3)} match_ratio, {O.rnd(f'(t2-t)/{HOUR}.0::double', 1)} time_gap_hours from
  (select * from (select *, row_number() over (partition by account_id order by a desc, t, seq) rank_in_account from {{{{pt_pairs}}}}) where rank_in_account <= 10) p
  join (select account_id, seq, cp from {{{{pt_rows}}}}) s using (account_id, seq) join (select account_id, seq seq2, cp from {{{{pt_rows}}}}) d using (account_id, seq2) where {gate(5)}""")(
    lambda b: b.pass_through)
query("source_dest_map", f"""select * from (select account_id, side, name, amount, row_number() over (partition by account_id, side order by amount desc, name) rank_in_side from (
  select account_id, case when amount > 0 then 'source' else 'destination' end side, {O.CP_DESC} as name, sum(abs(amount))::double amount from {{{{clean}}}} group by 1,2,3)) where rank_in_side <= 10""")(
    lambda b: W.source_dest_map(b.clean))
query("peer_turnover", f"""select account_id, pi peer_income, case when pi > base*36 then 25 when pi > base*24 then 15 else 0 end points from (
  select account_id, pi, case when avg_monthly_income = 0 then 1.0 else avg_monthly_income end base from (
    select account_id, sum(amount)::double pi from {{{{clean}}}} where amount > 0 and not {O.any_of(UPD, K.NOT_PEER_INCOME)} group by 1) join {{{{profile}}}} using (account_id)
  where account_type in ('salary_employee','pensioner','student','unknown'))""")(lambda b: W.peer_income(b.clean, b.profile))
query("cross_reference_score", f"""select account_id, coalesce(n.n,0) pairs, (case when coalesce(c.n,0) >= 5 then least(100,
  (case when coalesce(ratio,0) < 0.6 and coalesce(expense,0) > 1000000 then 20 else 0 end) + coalesce(points,0) +
  (case when coalesce(n.n,0) > 8 then least(30,(n.n-8)*8) when coalesce(n.n,0) > 3 then least(15,(n.n-3)*3) else 0 end)) else 0 end)::double score
  from {{{{accounts}}}} left join {per('clean')} c using (account_id) left join {per('pass_through')} n using (account_id)
  left join {{{{income_expense_ratio}}}} using (account_id) left join {{{{peer_turnover}}}} using (account_id)""")(lambda b: b.cross_score)


# merchants
def listing(groups, what):
    arms = []
    for g, words in groups.items():
        for w in words:
            arms.append(f"when contains(u, '{w}') then '{w if what == 'word' else g}'")
    return "case " + " ".join(arms) + " end"


query("merchant_hits", f"""select account_id, case when hw is not null then 'high' else 'medium' end as level, coalesce(hw, mw) as name, coalesce(hg, mg) category,
  sum(-amount)::double amount, count(*) n from (select account_id, amount, {listing(K.HIGH_RISK, 'word')} hw, {listing(K.HIGH_RISK, 'group')} hg,
  {listing(K.MEDIUM_RISK, 'word')} mw, {listing(K.MEDIUM_RISK, 'group')} mg from (select *, {UPD} u from {{{{clean}}}} where amount < 0)) where coalesce(hw, mw) is not null group by all""")(
    lambda b: b.merchant_hits)
LEGAL = " or ".join(f"starts_with(u, '{p}') or contains(u, '\"{p}') or contains(u, '«{p}')" for p in K.LEGAL_PREFIXES)
query("shell_companies", f"""select account_id, u as name, sum(-amount)::double amount, count(*) n from (select *, {UPD} u from {{{{clean}}}} where amount < 0)
  where ({LEGAL}) and {O.any_of('u', K.SHELL_WORDS)} group by 1,2""")(lambda b: b.shells)
query("merchant_totals", f"""select *, high + shell high_risk_amount, case when expense > 0 then {O.rnd('(high+shell)/expense*100.0::double', 2)} else 0.0::double end high_risk_pct from (
  select account_id, coalesce(expense,0.0) expense, coalesce(high,0.0) high, coalesce(crypto,0.0) crypto, coalesce(gambling,0.0) gambling, coalesce(shell,0.0) shell,
    coalesce(high_words,0) high_words, coalesce(shell_count,0) shell_count from {{{{accounts}}}}
  left join (select account_id, sum(-amount)::double expense from {{{{clean}}}} where amount < 0 group by 1) using (account_id)
  left join (select account_id, sum(amount::decimal(18,2))::double high, count(*) high_words, sum(case when category='crypto' then amount::decimal(18,2) end)::double crypto,
     sum(case when category='gambling' then amount::decimal(18,2) end)::double gambling from {{{{merchant_hits}}}} where level = 'high' group by 1) using (account_id)
  left join (select account_id, sum(amount::decimal(18,2))::double shell, count(*) shell_count from {{{{shell_companies}}}} group by 1) using (account_id))""")(lambda b: b.merchant_totals)
PCT = lambda c: f"(case when expense > 0 then {c}/expense*100.0::double else 0.0 end)"
query("merchant_score", f"""select account_id, high_words, high_risk_pct, least(100,
  (case when crypto <= 0 then 0 when account_type = 'trader' then (case when crypto > (case when avg_monthly_income = 0 then 1.0 else avg_monthly_income end)*5 then 30 else 0 end)
     else {steps(PCT('crypto'), [('>', 30, 40), ('>', 15, 20), ('>', 5, 10)])} end)
  + (case when gambling <= 0 then 0 when avg_monthly_income > 0 then {steps('gambling/(avg_monthly_income*12)*100.0::double', [('>', 20, 50), ('>', 10, 30), ('>', 3, 10)])}
     else {steps(PCT('gambling'), [('>', 20, 50), ('>', 10, 30), ('>', 5, 15)])} end)
  + (case when high_risk_amount-crypto-gambling-shell > 0 then {steps(PCT('(high_risk_amount-crypto-gambling-shell)'), [('>', 20, 30), ('>', 10, 15), ('>', 5, 8)])} else 0 end)
  + {steps('shell_count', [('>=', 5, 40), ('>=', 3, 25), ('>=', 1, 10)])}
  + (case when shell_count > 0 then {steps(PCT('shell'), [('>', 30, 25), ('>', 15, 15), ('>', 5, 8)])} else 0 end))::double score
  from {{{{merchant_totals}}}} join (select account_id, account_type, avg_monthly_income from {{{{profile}}}}) using (account_id)""")(lambda b: b.merchant_score)

# graph
query("graph_edges", f"""select account_id, case when amount < 0 then 'OWNER' else cp end source, case when amount < 0 then cp else 'OWNER' end target,
  sum(abs(amount))::double weight, count(*) n, {O.day('min(ts)')} first_day, {O.day('max(ts)')} last_day from (select *, {O.CP_GRAPH} cp from {{{{clean}}}}) where length(cp) >= 2 group by 1,2,3""")(
    lambda b: b.edges)
query("graph_nodes", """select *, in_volume + out_volume total_volume from (select account_id, id, id = 'OWNER' is_owner, sum(i)::double in_volume, sum(o)::double out_volume,
  sum(di + dx)::bigint connections, sum(di) > 0 and sum(dx) > 0 is_bidirectional from (
  select account_id, source id, 0::decimal(18,2) i, weight::decimal(18,2) o, 0 di, 1 dx from {{graph_edges}} union all
  select account_id, target, weight::decimal(18,2), 0, 1, 0 from {{graph_edges}}) group by 1,2)""")(lambda b: b.nodes)
query("edge_export", "select account_id, source, target, weight, n as count from {{graph_edges}}")(
    lambda b: b.edges.select("account_id", "source", "target", "weight", F.col("n").alias("count")))
query("graph_hubs", """select * exclude (is_owner) from (select *, row_number() over (partition by account_id order by total_volume desc, id) rank_in_account from {{graph_nodes}}
  where not is_owner and total_volume > 0) where rank_in_account <= 15""")(lambda b: b.hubs)
query("betweenness_star", f"""select account_id, 'OWNER' as id, case when n > 2 then {O.rnd('(payers*payees - both_ways)::double/((n-1)*(n-2))', 4)} else 0.0::double end betweenness from (
  select account_id, count(distinct id) n, count(distinct case when target='OWNER' then source end) payers, count(distinct case when source='OWNER' then target end) payees,
  count(distinct case when bi then id end) both_ways from {{{{graph_edges}}}} e join (select account_id, id, is_bidirectional and not is_owner bi from {{{{graph_nodes}}}}) using (account_id)
  group by 1)""")(lambda b: W.betweenness_star(W.node_roles(b.edges, b.nodes)))
query("communities_star", """select account_id, 1 as community, id as member, count(*) over (partition by account_id) size from {{graph_nodes}}""")(lambda b: W.communities_star(b.nodes))
query("star_cycles", """select a.account_id, a.source, a.target, 3 as length, a.weight total_flow from {{graph_edges}} a join {{graph_edges}} b on a.account_id = b.account_id and a.target = b.source
  join {{graph_edges}} c on c.account_id = a.account_id and b.target = c.source and c.target = a.source where a.source <> b.source and b.source <> c.source and a.source <> c.source""")(
    lambda b: W.star_cycles(b.edges))
query("graph_score", f"""select account_id, coalesce(nn.n,0) nodes, coalesce(both_n,0) bidirectional, least(100,
  (case when coalesce(both_max,0) > lim then 10 else 0 end) + (case when coalesce(top,0) > lim*3 then 15 else 0 end)
  + {steps('coalesce(both_n,0)', [('>=', 15, 30), ('>=', 10, 15), ('>=', 8, 8)])}
  + (case when account_type in ('salary_employee','pensioner','student') then {steps('coalesce(nn.n,0)', [('>', 30, 15), ('>', 20, 8)])} else 0 end))::double score
  from {{{{accounts}}}} left join (select account_id, count(case when is_bidirectional then 1 end) both_n, max(case when is_bidirectional then connections end) both_max, max(connections) top
  from {{{{graph_hubs}}}} group by 1) using (account_id) left join {per('graph_nodes')} nn using (account_id)
  left join (select account_id, account_type, {O.by_type('bidirectional_hub')} lim from {{{{profile}}}}) using (account_id)""")(lambda b: b.graph_score)

# night
query("time_data_guard", """select account_id, count(*) as "rows", count(case when hour(ts)=0 and minute(ts)=0 and second(ts)=0 then 1 end) midnight,
  count(case when hour(ts)=0 and minute(ts)=0 and second(ts)=0 then 1 end)/count(*) < 0.5 has_time from {{clean}} group by 1""")(lambda b: b.times)
O.fragment("night", f"""select * from {{{{clean}}}} where (hour(ts) >= 23 or hour(ts) < 6) and amount <= 0 and not {O.any_of(UPT, K.AUTOPAY)}
  and account_id in (select account_id from {{{{time_data_guard}}}} where has_time and "rows" >= 5)""")
query("night_rows", """select account_id, count(*) night_count, sum(abs(amount))::double night_total_amount, count(*)/max("rows") night_ratio from {{night}} join {{time_data_guard}} using (account_id) group by 1""")(
    lambda b: H.night_summary(b.night, b.times))
query("large_night", f"""select account_id, seq, {O.stamp()} at_time, hour(ts)::int as hour, abs(amount)::double amount, coalesce(nullif(counterparty,''), 'неизвестен') counterparty from {{{{night}}}} where amount <= -200000""")(
    lambda b: b.large_night)
query("night_clusters", f"""select account_id, {O.stamp('min(ts)')} started_at, {O.stamp('max(ts)')} ended_at, count(*) n, sum(abs(amount))::double total_amount from (
  select *, sum(brk) over (partition by account_id order by ts, seq) run from (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by account_id order by ts, seq) <= {2 * HOUR} then 0 else 1 end brk from {{{{night}}}}))
  group by account_id, run having count(*) >= 2""")(lambda b: b.night_clusters)
query("night_score", f"""select account_id, coalesce(night_count,0) night_count, coalesce(l.n,0) large, coalesce(c.n,0) clusters, least(100,
  {steps('coalesce(night_ratio,0)', [('>', 0.5, 20), ('>', 0.3, 10)])} + {steps('coalesce(l.n,0)', [('>=', 5, 25), ('>=', 3, 15), ('>=', 1, 5)])}
  + {steps('coalesce(longest,0)', [('>=', 5, 25), ('>=', 3, 15)])} + least(30, coalesce(m.n,0)*15))::double score
  from {{{{accounts}}}} left join {{{{night_rows}}}} using (account_id) left join {per('large_night')} l using (account_id) left join {per('large_night', where='amount >= 1000000')} m using (account_id)
  left join (select account_id, count(*) n, max(n) longest from {{{{night_clusters}}}} group by 1) c using (account_id)""")(lambda b: b.night_score)

# duplicates
O.fragment("dups", f"""select account_id, seq, ts, -amount a, {O.CP_DUP} cp from {{{{clean}}}} where amount <= -50000 and not {O.any_of(UPD, K.DUPLICATE_REGULAR)}""")
query("dup_candidates", "select account_id, count(*) n, sum(a)::double amount from {{dups}} group by 1")(
    lambda b: b.dups.groupBy("account_id").agg(F.count("*").alias("n"), B.total("amount").alias("amount")))


def recurring_sql(least):
    return f"""select account_id, cp, a::double amount, count(g)::bigint gaps, count(case when abs(g//{DAY} - 30) <= 5 then 1 end) monthly from (
      select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by account_id, cp, a order by ts, seq) g from {{{{dups}}}}) group by 1,2,a
      having count(g) >= {least} and count(case when abs(g//{DAY} - 30) <= 5 then 1 end)/count(g) >= 0.5"""


query("recurring_keys", recurring_sql(2))(lambda b: H.recurring_keys(b.dups).withColumn("amount", B.dbl("amount")))
query("recurring_keys_from_one_gap", recurring_sql(1))(lambda b: H.recurring_keys(b.dups, 1).withColumn("amount", B.dbl("amount")))


def dup_sql(least, hours):
    return f"""select account_id, cp counterparty, a::double amount, n, a::double*(n-1) duplicate_amount, {O.stamp('ts')} started_at from (
      select *, row_number() over (partition by account_id, cp, a order by ts, seq) k from (
        select account_id, cp, a, ts, seq, count(*) over (partition by account_id, cp, a order by epoch_us(ts) range between current row and {hours * HOUR} following) n from {{{{dups}}}} d
        where not exists (select 1 from {{{{recurring_keys}}}} r where r.account_id = d.account_id and r.cp = d.cp and r.amount = d.a::double)) where n >= {least}) where k = 1"""


query("exact_duplicates", dup_sql(3, 24))(lambda b: b.exact_duplicates)
query("exact_duplicates_in_a_week", dup_sql(3, 168))(lambda b: H.exact_duplicates(b.dups, hours=168))


def cast_sql(hours, least):
    return f"""select account_id, a::double amount, count(distinct cp) recipient_count, count(*) total_count, {O.rnd(f'(epoch_us(max(ts))-epoch_us(min(ts)))/{HOUR}.0::double', 1)} time_span_hours
      from {{{{dups}}}} group by account_id, a having count(distinct cp) >= {least} and epoch_us(max(ts))-epoch_us(min(ts)) <= {hours * HOUR}"""


query("amount_broadcast", cast_sql(48, 5))(lambda b: b.broadcasts)
query("amount_broadcast_any_span", cast_sql(24 * 4000, 3))(lambda b: H.amount_broadcast(b.dups, hours=24 * 4000, least=3))
query("duplicate_score", f"""select account_id, coalesce(g.d,0)::bigint duplicates, coalesce(da,0.0) duplicate_amount, coalesce(c.n,0) broadcasts, least(100, coalesce(p,0) + coalesce(q,0))::double score from {{{{accounts}}}}
  left join (select account_id, sum(20 + case when amount >= 500000 then 10 when amount >= 100000 then 5 else 0 end) p, sum(n-1) d, sum(duplicate_amount::decimal(18,2))::double da from {{{{exact_duplicates}}}} group by 1) g using (account_id)
  left join (select account_id, count(*) n, sum(case when recipient_count >= 10 then 35 else 20 end) q from {{{{amount_broadcast}}}} group by 1) c using (account_id)""")(lambda b: b.duplicate_score)

# round amounts
LEVEL = "case when a < 50000 then 0 when a % 100000 = 0 then 3 when a % 50000 = 0 then 2 when a % 10000 = 0 then 1 else 0 end"
O.fragment("rounds_all", f"""select account_id, seq, ts, a, {LEVEL} lv from (select *, -amount a from {{{{clean}}}} where amount <= -50000 and not (is_salary or is_pension_benefit or is_deposit_operation or is_atm or is_cash_operation)
  and type not in ('expense','fee') and not {O.any_of(UPT, K.ROUND_REGULAR)})""")
O.fragment("rounds", f"select * from {{{{rounds_all}}}} where account_id in (select account_id from {{{{rounds_all}}}} group by 1 having count(*) >= 3) and {gate(5)}")
query("round_relevant", "select account_id, count(*) n, sum(a)::double amount from {{rounds}} group by 1")(
    lambda b: b.rounds.groupBy("account_id").agg(F.count("*").alias("n"), B.total("amount").alias("amount")))
query("roundness_levels", "select account_id, lv as roundness_level, count(*) n from {{rounds}} group by 1,2")(
    lambda b: b.rounds.groupBy("account_id", "roundness_level").agg(F.count("*").alias("n")))
query("amount_distribution", """select account_id, case when a >= 10000000 then '10M+' when a >= 5000000 then '5M-10M' when a >= 1000000 then '1M-5M' when a >= 500000 then '500K-1M'
  when a >= 100000 then '100K-500K' else '50K-100K' end bucket, count(*) n from {{rounds}} where lv > 0 group by 1,2""")(lambda b: H.amount_distribution(b.rounds))
query("consecutive_rounds", f"""select account_id, {O.stamp('min(ts)')} started_at, {O.stamp('max(ts)')} ended_at, count(*) n, sum(a)::double total from (
  select *, row_number() over (partition by account_id order by ts, seq) - row_number() over (partition by account_id, lv >= 2 order by ts, seq) run from {{{{rounds}}}}) where lv >= 2
  group by account_id, run having count(*) >= 3""")(lambda b: b.round_runs)
query("round_score", f"""select account_id, coalesce(rc,0) round_count, case when coalesce(n,0) > 0 then rc/n else 0.0 end round_ratio, coalesce(rt,0.0) round_total, coalesce(r.runs,0) runs, least(60,
  {steps('(case when coalesce(n,0) > 0 then rc/n else 0.0 end)', [('>', 0.85, 20), ('>', 0.75, 12), ('>', 0.60, 5)])} + {steps('coalesce(mil,0)', [('>=', 5, 20), ('>=', 3, 10)])}
  + {steps('coalesce(perf,0)', [('>=', 10, 15), ('>=', 5, 8)])} + {steps('coalesce(longest,0)', [('>=', 7, 15), ('>=', 5, 8)])})::double score from {{{{accounts}}}}
  left join (select account_id, count(*) n, count(case when lv > 0 then 1 end) rc, sum(case when lv > 0 then a end)::double rt, count(case when lv > 0 and a >= 1000000 then 1 end) mil, count(case when lv = 3 then 1 end) perf
  from {{{{rounds}}}} group by 1) using (account_id) left join (select account_id, count(*) runs, max(n) longest from {{{{consecutive_rounds}}}} group by 1) r using (account_id)""")(lambda b: b.round_score)

# mismatch
query("oversized", f"""select account_id, seq, amount::double amount, lim threshold, {O.rnd('abs(amount::double)/lim', 2)} excess_ratio from {{{{clean}}}} join (
  select account_id, case when avg_monthly_income > 0 then least({O.by_type('single_cap')}::double, avg_monthly_income*3) else {O.by_type('single_cap')}::double end lim from {{{{profile}}}}) using (account_id)
  where abs(amount::double) > lim and {gate(5)}""")(lambda b: b.oversized)
query("unexpected_activity", f"""select * from (select account_id, seq, amount::double amount, case
  when account_type = 'pensioner' and type in ('crypto_buy','crypto_sell') then 'Крипто-операция от пенсионера'
  when account_type = 'pensioner' and counterparty_type = 'atm' and abs(amount) >= 500000 then 'Крупное снятие наличных пенсионером'
  when account_type = 'student' and abs(amount) >= 500000 and type = 'transfer_out' then 'Крупный исходящий перевод от студента'
  when account_type = 'student' and type = 'crypto_buy' and abs(amount) >= 200000 then 'Студент покупает крипту на крупную сумму'
  when account_type = 'salary_employee' and type in ('crypto_buy','crypto_sell') and abs(amount) >= 500000 then 'Крупная крипто-операция от зарплатника'
  when is_atm and abs(amount)::double >= greatest(500000.0::double, avg_monthly_income*0.7::double) and account_type not in ('business_owner','freelancer') then 'Крупное снятие наличных через банкомат' end reason
  from {{{{clean}}}} join (select account_id, account_type, avg_monthly_income from {{{{profile}}}}) using (account_id)) where reason is not null and {gate(5)}""")(lambda b: b.unexpected)
query("income_anomalies", f"""select account_id, seq, amount::double amount, {O.rnd('amount::double/avg_monthly_income', 2)} excess_ratio from {{{{clean}}}} join (select account_id, avg_monthly_income from {{{{profile}}}}) using (account_id)
  where amount > 0 and not is_salary and not is_pension_benefit and avg_monthly_income > 0 and amount::double > avg_monthly_income*2 and {gate(5)}""")(lambda b: b.income_anomalies)
query("mismatch_list", """select account_id, kind, rank_in_account::int rank_in_account, seq, amount from (select account_id, 'oversized' kind, row_number() over (partition by account_id order by abs(amount) desc, seq) rank_in_account, seq, amount from {{oversized}} union all
  select account_id, 'unexpected', row_number() over (partition by account_id order by seq), seq, amount from {{unexpected_activity}} union all
  select account_id, 'income_anomaly', row_number() over (partition by account_id order by amount desc, seq), seq, amount from {{income_anomalies}}) where rank_in_account <= 5""")(
    lambda b: H.mismatch_list(b.oversized, b.unexpected, b.income_anomalies))
query("mismatch_score", f"""select account_id, coalesce(o.n,0) oversized, coalesce(u.n,0) unexpected, coalesce(i.n,0) income_anomalies, least(100,
  {steps('coalesce(worst,0)', [('>=', 10, 35), ('>=', 5, 25), ('>=', 3, 15)])} + {steps('coalesce(o.n,0)', [('>=', 5, 15), ('>=', 3, 10)])} + least(25, coalesce(u.n,0)*8) + least(20, coalesce(i.n,0)*10))::double score
  from {{{{accounts}}}} left join (select account_id, count(*) n, max(excess_ratio) worst from {{{{oversized}}}} group by 1) o using (account_id)
  left join {per('unexpected_activity')} u using (account_id) left join {per('income_anomalies')} i using (account_id)""")(lambda b: b.mismatch_score)

# behaviour
query("weekday_baseline", f"""select a.account_id, d.i::int day_index, coalesce(s/n, 0.0::double) mean_spend from (select distinct account_id from {{{{clean}}}}) a cross join (select unnest(range(7)) i) d
  left join (select account_id, isodow(ts)-1 i, sum(-amount)::double s, count(*) n from {{{{clean}}}} where amount < 0 group by 1,2) x on x.account_id = a.account_id and x.i = d.i where a.{gate(10)}""")(
    lambda b: big_enough(H.weekday_baseline(b.clean), b.clean, 10))
query("spending_trend", f"""select account_id, case when n < 3 then 'insufficient_data' when {std_pop('n', 's', 'q')}/(s/n) > {O.by_type('volatile_cv')} then 'volatile'
  when s2/n2 > s1/n1*1.3 then 'increasing' when s2/n2 < s1/n1*0.7 then 'decreasing' else 'stable' end trend from (
  select account_id, count(*) n, sum(v)::double s, sum(v*v)::double q, sum(case when i <= c//2 then v end)::double s1, count(case when i <= c//2 then 1 end) n1,
    sum(case when i > c//2 then v end)::double s2, count(case when i > c//2 then 1 end) n2 from (
    select *, row_number() over (partition by account_id order by m) i, count(*) over (partition by account_id) c from (
      select account_id, {O.month()} m, sum(-amount) v from {{{{clean}}}} where amount < 0 group by 1,2)) group by 1)
  join (select account_id, account_type from {{{{profile}}}}) using (account_id) where {gate(10)}""")(lambda b: b.trend)


def cat_sql(z):
    return f"""select account_id, rank_in_account, seq, category, amount, z_score, category_mean from (select *, row_number() over (partition by account_id order by z_score desc, ts, seq) rank_in_account from (
      select account_id, seq, ts, category, -amount::double amount, {O.rnd('(-amount::double - mean)/sd', 2)} z_score, mean category_mean from (select * from {{{{clean}}}} where amount < 0 and category <> '')
      join (select account_id, category, s/n mean, {std_pop('n', 's', 'q')} sd from (select account_id, category, count(*) n, sum(-amount)::double s, sum(amount*amount)::double q, min(amount) lo, max(amount) hi
        from {{{{clean}}}} where amount < 0 and category <> '' group by 1,2) where n >= 3 and hi > lo) using (account_id, category) where (-amount::double - mean)/sd > {z})) where rank_in_account <= 10 and {gate(10)}"""


query("category_anomalies", cat_sql(3))(lambda b: b.category_odd)
query("behavioral_score", f"""select account_id, coalesce(trend,'insufficient_data') trend, coalesce(n.n,0) category_anomalies,
  ((case trend when 'volatile' then 20 when 'increasing' then 10 else 0 end) + least(30, coalesce(n.n,0)*10))::double score
  from {{{{accounts}}}} left join {{{{spending_trend}}}} using (account_id) left join {per('category_anomalies')} n using (account_id)""")(lambda b: b.behavioral_score)
