"""Schemes, weights, composite, flags, report."""

from ..config import keywords as K
from ..config import legal as L
from ..config.limits import effective_weights
from ..operators import base as B
from ..operators import patterns as P
from ..operators import scoring as S
from . import oracle as O
from .registry import query

F = B.F
FOREIGN = "(case when original_currency <> '' and original_currency not in ('KZT','KZT ') then original_currency when currency <> '' and currency not in ('KZT','₸') then currency end)"
CPU = f"upper({O.CP_STRICT})"
PERSON = f"({O.CP_STRICT} <> '' and not {O.any_of(CPU, K.NOT_A_PERSON)} and case when counterparty_type is not null then lower(counterparty_type) in ('person','individual','физлицо') else len(list_filter(string_split_regex({CPU}, '\\s+'), lambda x: x <> '')) <= 4 end)"

query("person_test", f"select account_id, count(case when {PERSON} then 1 end) persons, count(case when {FOREIGN} is not null then 1 end) foreign_rows from {{{{txn}}}} group by 1")(
    lambda b: b.txn.groupBy("account_id").agg(F.count(F.when(P.is_person(), 1)).alias("persons"), F.count(F.when(P.foreign_currency().isNotNull(), 1)).alias("foreign_rows")))
query("layering", f"""select account_id, seq, {O.stamp()} income_at, inc income_amount, n outflows, u destinations, tot total_out, {O.rnd('raw', 2)} confidence, {O.rnd('raw*85', 1)} contribution from (
  select *, least(0.90::double, 0.50::double + tot/inc*0.40::double) - (case account_type when 'business_owner' then 0.35::double when 'freelancer' then 0.30::double when 'salary_employee' then 0.20::double else 0.0::double end)
    - (case when u < 5 then 0.15::double else 0.0::double end) raw from (
    select i.account_id, i.seq, i.ts, i.amount::double inc, count(*) n, count(distinct nullif(cp,'')) u, sum(-o.amount)::double tot from (select * from {{{{txn}}}} where amount >= 500000) i
    join (select *, {O.CP_STRICT} cp from {{{{txn}}}} where amount < 0) o on o.account_id = i.account_id and o.ts between i.ts and i.ts + interval 72 hour group by 1,2,3,4)
  join (select account_id, account_type from {{{{profile}}}}) using (account_id) where n >= 3 and u >= 3 and tot/inc >= 0.70) where raw >= 0.15""")(lambda b: b.layering)
query("structuring_pattern", f"""select account_id, seq, n, {O.rnd('least(0.85::double, n*0.15::double)', 2)} confidence, {O.rnd('least(0.85::double, n*0.15::double)*70', 1)} contribution from (
  select account_id, count(*) n, min(seq) seq from {{{{txn}}}} join {{{{structuring_limits}}}} using (account_id) where amount < 0 and -amount::double >= threshold*0.9::double and -amount::double < threshold group by 1) where n >= 2""")(lambda b: b.structuring_pattern)
query("structuring_evidence", """select * from (select account_id, row_number() over (partition by account_id order by seq) rank_in_account, seq, -amount::double amount from {{txn}} join {{structuring_limits}} using (account_id)
  where amount < 0 and -amount::double >= threshold*0.9::double and -amount::double < threshold) where rank_in_account <= 10""")(lambda b: P.structuring_evidence(b.txn, b.structuring_limits))
O.fragment("card_rows", f"""select *, {O.CP_STRICT} cp, sum(brk) over (partition by account_id order by ts, seq) run from (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by account_id order by ts, seq) <= {2 * B.HOUR_US} then 0 else 1 end brk
  from {{{{txn}}}} where amount < 0 and amount > -10000 and {FOREIGN} is not null)""")
query("carding", f"""select account_id, seq, started_at, n, merchants, total_amount, {O.rnd('least(0.85::double, 0.40::double + n*0.04::double)', 2)} confidence, {O.rnd('least(0.85::double, 0.40::double + n*0.04::double)*75', 1)} contribution from (
  select account_id, min(seq) seq, {O.stamp('min(ts)')} started_at, count(*) n, count(distinct cp) merchants, sum(-amount)::double total_amount from {{{{card_rows}}}} group by account_id, run) where n >= 5""")(lambda b: b.carding)
query("pyramid", f"""select account_id, arg_min(o.seq, o.seq) seq, payers, total_in, arg_min(-o.amount::double, o.seq) outflow, {O.rnd('least(0.75::double, 0.35::double + payers*0.04::double)', 2)} confidence,
  {O.rnd('least(0.75::double, 0.35::double + payers*0.04::double)*65', 1)} contribution from (
  select account_id, count(distinct {O.CP_STRICT}) payers, sum(amount)::double total_in from {{{{txn}}}} where amount > 0 and amount < 200000 and {PERSON} group by 1) join (select * from {{{{txn}}}} where amount < 0 and {PERSON}) o using (account_id)
  where payers >= 5 and -o.amount::double > total_in*0.5::double group by account_id, payers, total_in""")(lambda b: b.pyramid)
query("many_payouts", f"""select account_id, seq, n, recipients, total_amount, {O.rnd('least(0.70::double, 0.25::double + recipients*0.04::double)', 2)} confidence, {O.rnd('least(0.70::double, 0.25::double + recipients*0.04::double)*60', 1)} contribution from (
  select account_id, min(seq) seq, count(*) n, count(distinct {O.CP_STRICT}) recipients, sum(-amount)::double total_amount from {{{{txn}}}} where amount between -100000 and -10000 and {PERSON}
  and account_id in (select account_id from {{{{profile}}}} where account_type <> 'business_owner') group by 1) where n >= 10 and recipients >= 5""")(lambda b: b.many_payouts)
CASH = f"(is_atm or is_cash_operation or contains({CPU}, 'БАНКОМАТ') or contains({CPU}, 'ATM') or contains(upper(coalesce(description,'')), 'НАЛИЧН'))"


def cash_sql(tail):
    return f"""select account_id, seq, n, cash, electronic, {O.rnd('least(0.80::double, 0.25::double + ratio*0.25::double)', 2)} confidence, {O.rnd('least(0.80::double, 0.25::double + ratio*0.25::double)*60', 1)} contribution from (
  select *, cash/(electronic+1) ratio from (select account_id, coalesce(sum(case when {CASH} then amount end)::double, 0.0) cash, coalesce(sum(case when not (is_atm or is_cash_operation) then amount end)::double, 0.0) electronic,
  count(case when {CASH} then 1 end) n, min(case when {CASH} then seq end) seq from {{{{txn}}}} where amount > 0 group by 1)) {tail}"""


query("untraced_cash", cash_sql("where cash >= 500000 and ratio >= 0.5"))(lambda b: b.untraced_cash)
O.fragment("patterns", " union all ".join(
    f"select account_id, '{n}' pattern, seq, confidence, contribution from {{{{{q}}}}}" for n, q in zip(P.NAMES, ["layering", "structuring_pattern", "carding", "pyramid", "many_payouts", "untraced_cash"])))
query("all_patterns", "select * from {{patterns}}")(lambda b: b.patterns)

WT = {}
for kind, mod, w in effective_weights():
    WT.setdefault(mod, []).append(f"when '{kind}' then {w!r}::double")
WEIGHT = {m: "(case account_type " + " ".join(a) + " end)" for m, a in WT.items()}
query("weights", " union all ".join(f"select account_id, '{m}' as module, {O.rnd(WEIGHT[m], 4)} weight from {{{{profile}}}}" for m in S.MODULES))(lambda b: S.weights(b.profile))
SOURCES = {"velocity": "velocity_score", "graph": "graph_score", "behavioral": "behavioral_score", "structuring": "structuring_score", "cross_reference": "cross_reference_score", "merchant_risk": "merchant_score",
           "night_transactions": "night_score", "duplicate_payments": "duplicate_score", "round_amounts": "round_score", "profile_mismatch": "mismatch_score"}
cols = ", ".join("least(100.0::double, coalesce(ps.c, 0.0)) pattern_detector" if m == "pattern_detector" else f"coalesce({m}.score, 0.0) {m}" for m in S.MODULES)
query("module_scores", f"select account_id, {cols}, coalesce(ps.n, 0) patterns, coalesce(ps.top, 0.0) top_confidence from {{{{accounts}}}} "
      + " ".join(f"left join {{{{{q}}}}} {m} using (account_id)" for m, q in SOURCES.items())
      + " left join (select account_id, count(*) n, max(confidence) top, sum(contribution::decimal(18,1))::double c from {{patterns}} group by 1) ps using (account_id)")(lambda b: b.module_scores)
base = "0.0::double + " + " + ".join(f"{m}*{WEIGHT[m]}" for m in S.MODULES)
high = " + ".join(f"(case when {m} >= 60 then 1 else 0 end)" for m in S.MODULES)
sure = "least(1.0::double, top_confidence + (case when patterns >= 100 then 0.35::double when patterns >= 50 then 0.25::double when patterns >= 10 then 0.15::double when patterns >= 5 then 0.1::double else 0.0::double end))"
query("composite", f"""select *, case when composite_score >= 75 then 'critical' when composite_score >= 55 then 'high' when composite_score >= 30 then 'medium' else 'low' end risk_level from (
  select * exclude (hi), {O.rnd(f"least(100.0::double, greatest({base} + (case when hi > 1 then (hi-1)*3 else 0 end), case when patterns > 0 and {sure} >= 0.7 then {sure}*70 else 0.0::double end))", 1)} composite_score
  from (select *, {high} hi from {{{{module_scores}}}} join (select account_id, account_type from {{{{profile}}}}) using (account_id)))""")(lambda b: b.scored)
query("risk_levels", """select risk_level, case when composite_score >= 60 then 'high' when composite_score >= 30 then 'medium' else 'low' end band, least(10, floor(composite_score/10)::int) legacy_score, count(*) n
  from {{composite}} group by all""")(lambda b: b.scored.groupBy(
      "risk_level", S.risk_band_dashboard(F.col("composite_score")).alias("band"), S.legacy_risk_score(F.col("composite_score")).alias("legacy_score")).agg(F.count("*").alias("n")))

O.fragment("evidence_counts", """select account_id, v.bursts, v.spikes, v.outflows, s.under, s.splits, s.smurfs, m.high_words, m.high_risk_pct, c.pairs, n.night_count, n.large, n.clusters, d.duplicates, d.duplicate_amount, d.broadcasts,
  r.round_count, r.round_ratio, r.runs, p.oversized, p.unexpected, p.income_anomalies, least(p.oversized,5)+least(p.unexpected,5)+least(p.income_anomalies,5) mismatches, b.trend
  from {{velocity_score}} v join {{structuring_score}} s using (account_id) join {{merchant_score}} m using (account_id) join {{cross_reference_score}} c using (account_id) join {{night_score}} n using (account_id)
  join {{duplicate_score}} d using (account_id) join {{round_score}} r using (account_id) join {{mismatch_score}} p using (account_id) join {{behavioral_score}} b using (account_id)""")


def said(template, *values):
    parts = template.split("{}")
    return " || ".join([f"'{parts[0]}'"] + [f"({v})::varchar || '{t}'" for v, t in zip(values, parts[1:])])


def whole(c):
    return f"format('{{{{:,.0f}}}}', ({c})::double)".replace("{{", "{").replace("}}", "}")


def pct(c):
    return f"printf('%.0f', ({c})*100.0::double)"


WHY = {
    "velocity": ("bursts",), "structuring": ("splits",), "merchant_risk": ("high_words",), "cross_reference": ("pairs",), "night_transactions": ("night_count", "large"),
    "duplicate_payments": ("duplicates", whole("duplicate_amount")), "round_amounts": ("round_count", pct("round_ratio")), "profile_mismatch": ("mismatches",),
}
SCHEME_WHY = {
    "money_laundering_layering": ("{{layering}}", whole("income_amount"), "destinations", pct("total_out/income_amount"), "outflows"),
    "structuring": ("{{structuring_pattern}} join {{structuring_limits}} using (account_id)", "n", whole("threshold*0.9::double"), whole("threshold"), whole("threshold")),
    "carding": ("{{carding}}", "n", "merchants"),
    "pyramid_scheme": ("{{pyramid}}", "payers", whole("total_in"), whole("outflow")),
    "human_trafficking_payments": ("{{many_payouts}}", "recipients", "n", whole("total_amount")),
    "tax_evasion_cash": ("{{untraced_cash}}", whole("cash"), pct("cash/(electronic+1)"), whole("electronic")),
}
O.fragment("scheme_why", " union all ".join(f"select account_id, '{k}' pattern, seq, {said(L.PATTERN_REASONS[k], *v)} reason from {src}" for k, (src, *v) in SCHEME_WHY.items()))
query("scheme_reasons", "select * from {{scheme_why}}")(lambda b: b.scheme_reasons)
UNDER = "amount < 0 and -amount::double >= threshold*0.9::double and -amount::double < threshold"
O.fragment("rows_of_schemes", f"""select distinct o.account_id, 'money_laundering_layering' pattern, null::bigint part, o.seq from {{{{layering}}}} l join {{{{txn}}}} i using (account_id, seq) join {{{{txn}}}} o on o.account_id = i.account_id
    and o.amount < 0 and o.ts between i.ts and i.ts + interval 72 hour
  union select account_id, 'money_laundering_layering', null, seq from {{{{layering}}}}
  union all select account_id, 'structuring', null, seq from {{{{txn}}}} join {{{{structuring_limits}}}} using (account_id) where {UNDER} and account_id in (select account_id from {{{{structuring_pattern}}}})
  union all select account_id, 'carding', min(seq) over (partition by account_id, run), seq from (select *, count(*) over (partition by account_id, run) c from {{{{card_rows}}}}) where c >= 5
  union all select account_id, 'pyramid_scheme', null, t.seq from (select * from {{{{txn}}}} where {PERSON}) t join (select account_id, total_in from {{{{pyramid}}}}) p using (account_id)
    where (amount > 0 and amount < 200000) or -amount::double > total_in*0.5::double
  union all select account_id, 'human_trafficking_payments', null, seq from {{{{txn}}}} where amount between -100000 and -10000 and {PERSON} and account_id in (select account_id from {{{{many_payouts}}}})
  union all select account_id, 'tax_evasion_cash', null, seq from {{{{txn}}}} where amount > 0 and {CASH} and account_id in (select account_id from {{{{untraced_cash}}}})""")
query("scheme_rows", "select account_id, pattern, part, seq from {{rows_of_schemes}}")(lambda b: b.scheme_rows)
O.fragment("why_rows", """select p.account_id, p.pattern, p.seq, coalesce(e.evidence, p.seq::varchar) evidence from {{patterns}} p left join (
  select account_id, pattern, part, string_agg(seq, ',' order by seq) evidence from (select *, row_number() over (partition by account_id, pattern, part order by seq) k from {{rows_of_schemes}}
  where pattern not in ('money_laundering_layering', 'pyramid_scheme')) where k <= 5 group by 1, 2, 3) e on e.account_id = p.account_id and e.pattern = p.pattern and (e.part is null or e.part = p.seq)""")


def flag_sql(module, needs, bound):
    counter = " ".join(f"when '{k}' then '{t}'" for (m, k), t in L.COUNTER_EVIDENCE.items() if m == module)
    counter = f"case account_type {counter} else '' end" if counter else "''"
    sev = f"case when {module} >= {bound} then 'critical' else 'warning' end" if bound else "'warning'"
    share = O.rnd(f"{module}*{O.rnd(WEIGHT[module], 4)}", 2)
    return f"select account_id, '{module}' as module, {sev} severity, {said(L.MODULE_REASONS[module], *WHY[module])} reason, '' evidence, least(1.0::double, {module}/100) confidence, {share} contribution, {counter} counter_evidence from {{{{composite}}}} join {{{{evidence_counts}}}} using (account_id) where {module} > 0 and {needs} > 0"


pc = "case " + " ".join(f"when pattern = '{k}' and account_type in ('business_owner', 'freelancer') then '{v}'" for k, v in L.PATTERN_COUNTER_BUSINESS.items()) + " ".join(
    f" when pattern = '{k}' then '{v}'" for k, v in L.PATTERN_COUNTER.items()) + " end"
query("explained_flags", " union all ".join(flag_sql(m, *v) for m, v in S.FLAG_MODULES.items())
      + f" union all select account_id, 'pattern_detector', case when confidence >= 0.8 then 'critical' else 'warning' end, reason, evidence, confidence, {O.rnd('contribution', 2)}, {pc} from {{{{patterns}}}} join (select account_id, account_type from {{{{composite}}}}) using (account_id)"
        " join {{scheme_why}} using (account_id, pattern, seq) join {{why_rows}} using (account_id, pattern, seq)")(lambda b: b.explained_flags.drop("seq"))
pairs = [(m, k, t) for (m, k), t in L.COUNTER_EVIDENCE.items()]
query("counter_evidence", " union all ".join(f"select account_id, '{m}' as module, '{t}' as counter_evidence from {{{{profile}}}} where account_type = '{k}'" for m, k, t in pairs))(
    lambda b: b.profile.select("account_id", F.explode(F.filter(F.array(*[F.when(F.col("account_type") == k, F.struct(F.lit(m).alias("module"), F.lit(t).alias("counter_evidence"))) for m, k, t in pairs]),
                                                              lambda x: x.isNotNull())).alias("e")).select("account_id", "e.*"))
RED = [
    ("bursts > 0", "'Обнаружены серии быстрых транзакций (' || bursts || ' случаев)'"), ("spikes > 0", "'Дни с аномальной активностью: ' || spikes"),
    ("under > 0", "'Суммы близкие к порогу отчётности: ' || under"), ("splits > 0", "'Возможное дробление операций: ' || splits || ' групп'"), ("pairs > 0", "'Транзитные операции: ' || pairs"),
    ("high_words > 0", "'Высокорисковые мерчанты: ' || coalesce(names, '')"), ("high_risk_pct > 10", f"printf('%.1f', {O.rnd('high_risk_pct', 1)}) || '% расходов — высокорисковые операции'"),
    ("trend = 'volatile'", "'Нестабильный паттерн расходов'"), ("large > 0", "'Крупные ночные переводы (23:00-06:00): ' || large || ' операций'"), ("clusters > 0", "'Серии ночных транзакций: ' || clusters || ' кластеров'"),
    ("duplicates > 0", f"'Дублирующие платежи: ' || duplicates || ' повторов на сумму ' || {whole('duplicate_amount')} || ' KZT'"), ("broadcasts > 0", "'Веерная отправка одинаковых сумм: ' || broadcasts || ' паттернов'"),
    ("round_ratio > 0.3", f"'Высокая доля круглых сумм: ' || {pct('round_ratio')} || '% (' || round_count || ' транзакций)'"), ("runs > 0", "'Серии круглых сумм подряд: ' || runs || ' серий'"),
    ("oversized > 0", "'Транзакции превышающие норму для профиля: ' || oversized || ' операций'"), ("unexpected > 0", "'Нехарактерная активность для типа аккаунта: ' || unexpected || ' случаев'"),
    ("income_anomalies > 0", "'Аномальные поступления: ' || income_anomalies || ' операций'"),
]
O.fragment("risky_names", """select account_id, string_agg(name, ', ' order by k) names from (select account_id, name, row_number() over (partition by account_id order by amount desc, name) k
  from {{merchant_hits}} where level = 'high') where k <= 3 group by 1""")
query("red_flags", " union all ".join(f"select account_id, {i}::int ord, {text} flag from {{{{evidence_counts}}}} left join {{{{risky_names}}}} using (account_id) where {cond}" for i, (cond, text) in enumerate(RED, 1)))(
    lambda b: S.red_flags(b.scored, b.evidence_counts, b.merchant_hits))
TITLE = "(case pattern " + " ".join(f"when '{k}' then '{v}'" for k, v in L.PATTERN_TITLES.items()) + " end)"
query("pattern_flags", f"select account_id, seq, '[' || {TITLE} || '] ' || reason flag, confidence from {{{{patterns}}}} join {{{{scheme_why}}}} using (account_id, pattern, seq) where confidence >= 0.5")(
    lambda b: S.pattern_flags(b.patterns, b.scheme_reasons))
TESTS = ["risk_level in ('high', 'critical')", "account_id in (select account_id from {{merchant_hits}} where level = 'high' and category = 'gambling')", "splits > 0", "pairs > 0", "night_transactions >= 30", "duplicates >= 3",
         "broadcasts > 0", "round_amounts >= 30", "oversized > 0", "unexpected > 0"]
O.fragment("advice_fixed", " union all ".join(f"select account_id, {i} k, '{t}' advice from {{{{composite}}}} join {{{{evidence_counts}}}} using (account_id) where {c}" for i, (c, t) in enumerate(zip(TESTS, L.ADVICE))))
PLACE = "(case pattern " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(L.PATTERN_TITLES)) + " end)"
REPORT = "(case pattern " + " ".join(f"when '{k}' then 'Сообщить в ПОД/ФТ согласно {L.PATTERN_REFERENCE[k]} (схема: {v})'" for k, v in L.PATTERN_TITLES.items()) + " end)"
query("recommendations", f"""select account_id, row_number() over (partition by account_id order by k, confidence desc, p, seq)::bigint ord, advice from (
  select account_id, k, 0.0::double confidence, 0 p, 0 seq, advice from {{{{advice_fixed}}}}
  union all select account_id, 99, confidence, {PLACE}, seq, {REPORT} from {{{{patterns}}}} where confidence >= 0.7
  union all select account_id, 0, 0, 0, 0, '{L.NO_FINDINGS}' from {{{{composite}}}} where account_id not in (select account_id from {{{{advice_fixed}}}}) and account_id not in (select account_id from {{{{patterns}}}} where confidence >= 0.7))""")(
    lambda b: S.recommendations(b.scored, b.evidence_counts, b.merchant_hits, b.patterns))
query("module_breakdown", " union all ".join(f"select account_id, '{m}' as module, {m}::double score, {O.rnd(WEIGHT[m], 4)} weight, {O.rnd(f'{m}*{O.rnd(WEIGHT[m], 4)}', 2)} contribution from {{{{composite}}}}" for m in S.MODULES))(
    lambda b: S.module_breakdown(b.scored, b.profile))
query("txn_flags", f"""select account_id, seq, string_agg(module, ',' order by module) modules from (
  select account_id, seq, 'structuring' as module from {{{{just_under}}}} union
  select account_id, seq, 'structuring' from (select *, {O.CP_DESC} cpd, {O.day()} dd from {{{{str_rows}}}} where amount < 0) r join {{{{split_groups}}}} g using (account_id) where g.counterparty = r.cpd and g.day = r.dd union select account_id, seq, 'night_transactions' from {{{{large_night}}}} union select account_id, seq, 'profile_mismatch' from {{{{oversized}}}}
  union select account_id, seq, 'profile_mismatch' from {{{{unexpected_activity}}}} union select account_id, seq, 'profile_mismatch' from {{{{income_anomalies}}}} union select account_id, seq, 'cross_reference' from {{{{pass_through_pairs}}}}
  union select account_id, seq2, 'cross_reference' from {{{{pass_through_pairs}}}} union select account_id, seq, 'merchant_risk' from {{{{clean}}}} where amount < 0 and {O.any_of("upper(coalesce(description,''))", [w for ws in K.HIGH_RISK.values() for w in ws])}
  union select account_id, seq, 'pattern_detector' from {{{{rows_of_schemes}}}}) group by 1,2""")(lambda b: b.txn_flags)
query("assemble_report")(lambda b: b.report)
query("case_facts")(lambda b: S.case_facts(b.scored, b.profile, b.evidence_counts))
