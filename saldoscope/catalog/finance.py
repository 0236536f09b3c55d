"""Enrichment, categories, analytics, checks."""

from ..config import keywords as K
from ..config import names as NM
from ..functions import names as N
from ..operators import analytics as A
from ..operators import base as B
from ..operators import enrich as E
from ..sources.book import ACCOUNT_SQL, TABLES
from . import oracle as O
from .profiling import std_samp
from .registry import query

F = B.F
DAY = B.DAY_US
O.fragment("account", ACCOUNT_SQL.format(**{t: t for t in TABLES}))
KEYNAME = f"trim({O.CP_DESC})"
O.fragment("names", f"select distinct {KEYNAME} as name from {{{{txn}}}} where {KEYNAME} <> ''")


def names(b):
    return b.txn.select(F.trim(B.cp_desc()).alias("name")).distinct().filter("name <> ''")


def q(w):
    return w.replace("'", "''")


# name functions
def squeeze(c):
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def norm_sql(c):
    x = f"translate({squeeze(c)}, '{NM.TRANSLIT_FROM}', '{NM.TRANSLIT_TO}')"
    for a, b in NM.TRANSLIT_PAIRS.items():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace(lower(trim(regexp_replace(strip_accents({x}), '[^a-zA-Z0-9\\s]', '', 'g'))), '\\s+', '_', 'g')"
    return f"(case when {x} = '' then 'unknown' else {x} end)"


def padded(c):
    return f"(' ' || regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ')"


def words_any(c, words):
    return O.any_of(padded(c), [f" {w} " for w in words])


WORDS = "len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"


def org_sql(c):
    return (f"(case when {c} = '' then false when {words_any(f'upper({c})', NM.ORG_MARKERS)} or {O.any_of(f'upper({c})', NM.ORG_BRANDS)} then true "
            f"when regexp_matches({c}, '(^|[^\\p{{L}}\\p{{N}}_])[А-ЯA-Z]\\.\\s*$') then false "
            f"when {WORDS.format(c=c)} between 2 and 4 and len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '' and not regexp_matches(w, '^\\p{{Lu}}'))) = 0 "
            f"and not {O.any_of(f'upper({c})', NM.ORG_MARKERS)} and not regexp_matches({c}, '[0-9]') then false else true end)")


def subject_sql(c):
    return (f"(case when {words_any(f'upper({c})', NM.SUBJECT_MARKERS)} then 'legal_entity' when regexp_matches(trim({c}), '^[А-ЯЁA-Z][а-яёa-z]+\\s+[А-ЯЁA-Z]\\.?$') then 'individual' "
            f"when contains({c}, ' ') and {WORDS.format(c=c)} <= 4 and not regexp_matches({c}, '\\d') then 'individual' else 'legal_entity' end)")


FORM = ("(case list_filter(string_split_regex(upper({c}), '[\\s\"«»,.]+'), lambda w: w in (" + ", ".join(f"'{w}'" for w in NM.LEGAL_FORMS) + "))[1] "
        + " ".join(f"when '{a}' then '{b}'" for a, b in NM.LEGAL_FORMS.items()) + " end)")
query("normalize_name", f"select name, {norm_sql('name')} normalized from {{{{names}}}}")(lambda b: names(b).withColumn("normalized", N.normalize_name("name")))
query("is_organization", f"select name, {org_sql('name')} organization from {{{{names}}}}")(lambda b: names(b).withColumn("organization", N.is_organization("name")))
O.fragment("idents", f"select name, {norm_sql('name')} || '_' || (case when {org_sql('name')} then 'organization' else 'individual' end) identifier from {{{{names}}}}")
query("subject_identifier", "select * from {{idents}}")(lambda b: names(b).withColumn("identifier", N.subject_identifier("name")))
query("parse_subject_identifier", """select identifier, case when regexp_full_match(identifier, '[A-Z]{2}[0-9A-Z]+') then 'account_owner' when ends_with(identifier, '_individual') then 'individual' else 'organization' end kind,
  regexp_replace(identifier, '_(individual|organization)$', '') as name from {{idents}}""")(
    lambda b: names(b).select(N.subject_identifier("name").alias("identifier")).withColumn("kind", N.identifier_kind("identifier")).withColumn("name", N.identifier_name("identifier")))
query("subject_display_name")(lambda b: names(b).select(N.subject_identifier("name").alias("identifier")).withColumn("shown", N.display_name("identifier")))
query("persisted_subject", f"""select name, {subject_sql('name')} subject_type, substr(regexp_replace(trim(regexp_replace(lower({squeeze('name')}), '[^a-zA-Zа-яА-ЯёЁ0-9\\s]', '', 'g')), '\\s+', '_', 'g'), 1, 150) || '_' || {subject_sql('name')} unique_identifier from {{{{names}}}}""")(
    lambda b: names(b).withColumn("subject_type", N.subject_type("name")).withColumn("unique_identifier", N.unique_identifier("name")))
query("legal_form", f"select name, {FORM.format(c='name')} form from {{{{names}}}}")(lambda b: names(b).withColumn("form", N.legal_form("name")))
PACK = "regexp_replace(replace(lower(translate({c}, 'Əə', 'Әә')), 'ё', 'е'), '[^а-яёәғқңөұүіһa-z0-9]+', '', 'g')"
SPACED = "(' ' || regexp_replace(lower({c}), '[^а-яёәғқңөұүіһa-z0-9]+', ' ', 'g') || ' ')"


def operation_sql(c):
    p = PACK.format(c=c)
    glued = " or ".join(f"(starts_with({p}, '{m}') and length({p}) > {len(m) + 2})" for m in NM.LEGAL_FORM_MARKERS)
    return f"(case when {p} = '' then false when {O.any_of(p, NM.CHANNEL_MARKERS)} then true when {O.any_of(SPACED.format(c=c), [f' {m} ' for m in NM.LEGAL_FORM_MARKERS])} or {glued} then false else {O.any_of(p, NM.OPERATION_MARKERS)} end)"


O.fragment("texts", f"select distinct name from (select name from {{{{names}}}} union all select trim(description) from {{{{txn}}}} where trim(description) <> '')")


def texts(b):
    return names(b).unionByName(b.txn.select(F.trim("description").alias("name")).filter("name <> ''")).distinct()


query("operation_description", f"select name, {operation_sql('name')} operation from {{{{texts}}}}")(lambda b: texts(b).withColumn("operation", N.is_operation_description("name")))
TRADER = "regexp_matches(upper({c}), '^(ИП|ЖК|И\\.П\\.|IP)\\s*[.\\-—:]?\\s*.+$')"
TRADER_P = "(" + TRADER + f" and regexp_matches(trim(regexp_extract(upper({{c}}), '^(ИП|ЖК|И\\.П\\.|IP)\\s*[.\\-—:]?\\s*(.+)$', 2)), '^[\"«'']?\\s*[{NM.CYR}]'))"


def rule_cols(c):
    trader, org, form = TRADER_P.format(c=c), org_sql(c), FORM.format(c=c)
    ini = f"(regexp_matches({c}, '^[{NM.CYR}]{{2,}}\\s+[{NM.CYR}]\\.(?:\\s*[{NM.CYR}]\\.)?$') or regexp_matches({c}, '^[{NM.CYR}]{{2,}}(?:\\s+[{NM.CYR}]{{2,}}){{1,2}}$'))"
    m = f"({form} is not null or {org})"
    return (f"case when {trader} then 'person' when {m} then 'merchant' when {ini} then 'person' else 'unknown' end kind, case when not {trader} and {m} then {c} end merchant_name, "
            f"case when {trader} then 'ИП' when {m} then {form} end merchant_type, case when {trader} then 0.6::double when {m} or {ini} then 0.5::double else 0.0::double end confidence, 'rule' as source")


O.fragment("ruled", f"select name, {rule_cols('name')} from {{{{texts}}}}")
query("classify_rule", "select * from {{ruled}}")(lambda b: texts(b).withColumn("o", N.classify_rule("name")).select("name", "o.*"))
O.fragment("lookup", "select s_name as name, 'merchant' known_kind, s_name || ' LLP' known_name, 'ТОО' known_type from supplier")
query("classify_cascade", f"""select name, case when op then 'unknown' when tr and kind <> 'unknown' then kind when known_kind is not null then known_kind else kind end kind,
  case when op then null when tr and kind <> 'unknown' then merchant_name when known_kind is not null then known_name else merchant_name end merchant_name,
  case when op then null when tr and kind <> 'unknown' then merchant_type when known_kind is not null then known_type else merchant_type end merchant_type,
  case when op then 0.0::double when tr and kind <> 'unknown' then confidence when known_kind is not null then 0.9::double else confidence end confidence,
  case when op then 'rule' when tr and kind <> 'unknown' then 'rule' when known_kind is not null then 'cache' else 'rule' end source
  from (select *, {operation_sql('name')} op, {TRADER.format(c='name')} tr from {{{{ruled}}}} left join {{{{lookup}}}} using (name) where name in (select name from {{{{names}}}}))""")(lambda b: b.classes)
KIND_NAME = "case kind when 'merchant' then 'trade' when 'person' then 'people' when 'bank' then 'bank' end"
query("apply_categories", f"""select account_id, coalesce(nullif(category, ''), {KIND_NAME}) category, count(*) n from {{{{txn}}}} t left join {{{{classify_cascade}}}} c on c.name = {KEYNAME} group by 1,2""")(
    lambda b: E.apply_classification(b.txn, b.classes.withColumn("category", F.expr(KIND_NAME))).groupBy("account_id", "category").agg(F.count("*").alias("n")))
query("apply_classification", f"""select account_id, case when counterparty_type = 'unknown' and kind is not null then kind else counterparty_type end counterparty_type, count(*) n,
  count(coalesce(nullif(t.merchant_name,''), c.merchant_name)) named from {{{{txn}}}} t left join {{{{classify_cascade}}}} c on c.name = {KEYNAME} group by 1,2""")(
    lambda b: E.apply_classification(b.txn, b.classes).groupBy("account_id", "counterparty_type").agg(F.count("*").alias("n"), F.count("merchant_name").alias("named")))
query("names_by_turnover", f"""select * from (select account_id, name, turnover, row_number() over (partition by account_id order by turnover desc, name) rank_in_account from (
  select account_id, {KEYNAME} as name, sum(abs(amount))::double turnover from {{{{txn}}}} where {KEYNAME} <> '' group by 1,2)) where rank_in_account <= 60""")(lambda b: E.names_by_turnover(b.txn))
query("classify_stats", "select source, kind, count(*) n, sum(count(*)) over ()::bigint total from {{classify_cascade}} group by 1,2")(
    lambda b: b.classes.groupBy("source", "kind").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(B.Window.partitionBy())))
GEN = squeeze("lower(translate({c}, 'Əə', 'Әә'))")


def generic_sql(c):
    g = GEN.format(c=c)
    lst = ", ".join(f"'{m}'" for m in K.GENERIC_SOURCES)
    starts = " or ".join(f"starts_with({g}, '{m} ')" for m in K.GENERIC_SOURCES)
    return f"({g} in ({lst}) or list_has_any(list_transform(string_split({g}, '/'), lambda p: trim(p)), [{lst}]) or {starts} or {O.any_of(g, [m for m in K.GENERIC_SOURCES if len(m) >= 12])})"


query("generic_source", f"select name, {generic_sql('name')} generic from {{{{texts}}}}")(lambda b: texts(b).withColumn("generic", E.generic_source(F.col("name"))))
O.fragment("salary_in", f"select *, {O.CP_SALARY} source from {{{{txn}}}} where amount > 0 and {O.CP_SALARY} <> '' and not {generic_sql(O.CP_SALARY)}")
query("salary_sources", f"""select account_id, source, n payments, months, med/100.0::double median_amount, round_even(md, 0)::int day_of_month, {std_samp('months', 'ds', 'dq')} day_stdev, {std_samp('n', 's', 'q')}/(s/n) amount_cv from (
  select account_id, source, count(*) as months, sum(n)::bigint n, sum(s)::double s, sum(q)::double q, sum(d)::double ds, sum(d*d)::double dq, bool_or(bad) bad, median(d)::double md from (
    select account_id, source, {O.month()} m, min(day(ts)) d, count(*) n, sum(amount) s, sum(amount*amount) q, bool_or(counterparty_type = 'person' or is_pension_benefit) bad from {{{{salary_in}}}} group by 1,2,3) group by 1,2)
  join (select account_id, source, median((amount*100)::bigint) med from {{{{salary_in}}}} group by 1,2) using (account_id, source)
  where not bad and n >= 3 and months >= 3 and n/months <= 3 and {std_samp('months', 'ds', 'dq')} <= 8 and {std_samp('n', 's', 'q')}/(s/n) <= 0.6""")(lambda b: b.salary_sources)
query("mark_salary", f"""select account_id, count(case when is_salary or (amount > 0 and s.source is not null) then 1 end) salary_rows from (select *, {O.CP_SALARY} src from {{{{txn}}}}) t
  left join {{{{salary_sources}}}} s on s.account_id = t.account_id and s.source = t.src group by 1""".replace("select account_id, count(case", "select t.account_id, count(case"))(
    lambda b: E.mark_salary(b.txn, b.salary_sources).groupBy("account_id").agg(F.count(F.when(F.col("is_salary"), 1)).alias("salary_rows")))

# categories
LABEL = "(case type " + " ".join(f"when '{t}' then '{v}'" for t, v in K.STATEMENT_LABELS.items()) + " else 'Разное' end)"
DESC = "coalesce(description,'')"
CONTACT = f"(case when not {O.any_of(f'lower({DESC})', [w.lower() for w in K.CONTACT_SKIP])} then nullif(trim(regexp_extract({DESC}, '{K.CONTACT_REGEX}', 1)), '') end)"
O.fragment("labelled", f"select *, {LABEL} as label, {CONTACT} contact from {{{{txn}}}}")
query("statement_label", "select label, type, count(*) n from {{labelled}} group by 1,2")(lambda b: b.labelled.groupBy("label", "type").agg(F.count("*").alias("n")))
query("contact_name", "select contact, count(*) n from {{labelled}} where contact is not null group by 1")(
    lambda b: b.labelled.withColumn("contact", E.contact_name()).filter("contact is not null").groupBy("contact").agg(F.count("*").alias("n")))
query("contact_frequency", "select account_id, contact, count(*) n, count(*) >= 5 is_frequent from {{labelled}} where label in ('Перевод','Пополнение') and contact is not null group by 1,2")(lambda b: E.contact_frequency(b.txn))


def rules_sql(text, rules, fold, what):
    return "case " + " ".join(f"when contains({text}, '{q(fold(w))}') then '{q(w if what else cat)}'" for cat, ws in rules for w in ws) + " end"


def cat_cols(what):
    buy = f"coalesce({rules_sql(f'upper({DESC})', K.EXPENSE_CATEGORIES, str.upper, what)}, '{'Другое' if what else 'Прочие покупки'}')"
    low, head = f"lower({DESC})", f"substr({DESC}, 1, 30)"
    c = lambda yes, no: "contact" if what else f"case when contact is not null then (case when f.is_frequent then '{yes}' else '{no}' end) end"
    send = f"coalesce({rules_sql(low, K.TRANSFER_CATEGORIES, str.lower, what)}, {c('Частые контакты', 'Остальные контакты')}, {head if what else repr('Перевод')})"
    get = f"coalesce({rules_sql(low, K.INCOME_CATEGORIES, str.lower, what)}, {c('От частых контактов', 'От остальных')}, {head if what else repr('Пополнение')})"
    misc = f"case when contains({low}, 'комиссия') then '{'Комиссия' if what else 'Банковские услуги'}' when contains({low}, 'страхов') then '{'Страховка' if what else 'Страхование'}' else '{'Другое' if what else 'Разное'}' end"
    return f"case label when 'Покупка' then {buy} when 'Перевод' then {send} when 'Пополнение' then {get} when 'Снятие' then '{'Снятие' if what else 'Снятие наличных'}' else {misc} end"


O.fragment("cats", f"""select t.account_id, t.seq, t.amount, t.ts, {cat_cols(False)} category, {cat_cols(True)} subcategory from {{{{labelled}}}} t
  left join (select account_id, contact, is_frequent from {{{{contact_frequency}}}} where is_frequent) f using (account_id, contact)""")
query("categorise", "select account_id, category, subcategory, count(*) n, sum(amount)::double amount from {{cats}} group by 1,2,3")(
    lambda b: b.cats.groupBy("account_id", "category", "subcategory").agg(F.count("*").alias("n"), B.total("amount").alias("amount")))
query("case_contacts", f"""select account_id, contact, n, n >= 3 is_frequent from (select account_id, regexp_extract({DESC}, '{NM.CASE_CONTACT_REGEX}', 1) contact, count(*) n from {{{{txn}}}} where type in ('transfer_in','transfer_out') group by 1,2) where contact <> ''""")(
    lambda b: E.case_contacts(b.txn))

# analytics
DAYS = f"greatest((epoch_us(max(ts))-epoch_us(min(ts)))//{DAY}, 1)"
O.fragment("totals", f"""select account_id, count(*) n, coalesce(sum(case when amount > 0 then amount end)::double,0.0) inc, coalesce(sum(case when amount < 0 then -amount end)::double,0.0) exp,
  count(case when amount > 0 then 1 end) n_in, count(case when amount < 0 then 1 end) n_out, {DAYS} as days, median((abs(amount)*100)::bigint)/100.0::double med from {{{{txn}}}} group by 1""")
div = lambda a, b: f"(case when {b} > 0 then ({a})/({b}) else 0.0::double end)"
query("general_stats", f"""select account_id, n total_transactions, inc total_income, exp total_expense, inc-exp net_flow, balance_start::double balance_start, balance_end::double balance_end,
  {O.rnd('exp/(case when n >= 2 then days else 30 end)', 2)} avg_daily_expense, med median_transaction, {div('inc', 'n_in')} avg_income, {div('exp', 'n_out')} avg_expense, n_in income_transactions, n_out expense_transactions
  from {{{{totals}}}} left join {{{{account}}}} using (account_id)""")(lambda b: A.general_stats(b.txn, b.account))
MONTHS = "['" + "','".join(K.MONTHS_RU) + "']"
query("monthly_breakdown", f"""select *, income-expense balance, {MONTHS}[substr("month",6,2)::int] || ' ' || substr("month",1,4) month_name from (select account_id, {O.month()} as "month", coalesce(sum(case when amount > 0 then amount end)::double,0.0) income,
  coalesce(sum(case when amount <= 0 then -amount end)::double,0.0) expense, count(*) transaction_count from {{{{txn}}}} group by 1,2)""")(lambda b: A.monthly_breakdown(b.txn))
query("category_breakdown", """select account_id, side, category, a::double amount, n, case when w > 0 then a::double/w*100.0::double else 0.0 end percentage from (select *, (sum(a) over (partition by account_id, side))::double w from (
  select account_id, case when amount < 0 then 'expense' else 'income' end side, category, sum(abs(amount)) a, count(*) n from {{cats}} group by 1,2,3))""")(lambda b: A.category_breakdown(b.cats))
query("top_merchants", """select *, amount/n avg_transaction from (select account_id, merchant, amount, n, row_number() over (partition by account_id order by amount desc, merchant) rank_in_account from (
  select account_id, substr(description,1,40) merchant, sum(-amount)::double amount, count(*) n from {{labelled}} where label = 'Покупка' and amount < 0 group by 1,2)) where rank_in_account <= 10""")(lambda b: A.top_merchants(b.labelled))
query("top_contacts", f"""select account_id, rank_in_account, name, sent, received, received-sent balance, n from (select *, row_number() over (partition by account_id order by vol desc, name) rank_in_account from (
  select account_id, trim(regexp_extract({DESC}, '{K.CONTACT_REGEX}', 1)) as name, coalesce(sum(case when amount < 0 then -amount end)::double,0.0) sent, coalesce(sum(case when amount >= 0 then amount end)::double,0.0) received,
  sum(abs(amount))::double vol, count(*) n from {{{{labelled}}}} where label in ('Перевод','Пополнение') group by 1,2) where name <> '') where rank_in_account <= 10""")(lambda b: A.top_contacts(b.labelled))
RKEY = f"substr(trim(regexp_replace(regexp_replace(upper({DESC}), '(^|[^\\p{{L}}\\p{{N}}_])\\d{{6,}}($|[^\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '\\s+\\d+$', '')), 1, 30)"
query("recurring_payments", f"""select account_id, rank_in_account, name, n, total total_amount, total/n avg_amount, frequency, avg_i avg_interval_days, {O.stamp('last')} last_payment from (
  select *, row_number() over (partition by account_id order by total desc, name) rank_in_account from (
  select *, case when avg_i between 25 and 35 then 'monthly' when avg_i between 6 and 8 then 'weekly' when avg_i between 13 and 16 then 'bi-weekly' when avg_i <= 3 then 'frequent' else 'unknown' end frequency from (
  select account_id, name, count(*) n, count(distinct amount) kinds, sum(-amount)::double total, max(ts) as last, coalesce(sum(g),0)::double/(count(*)-1) avg_i from (
    select *, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by account_id, name order by ts, seq))//{DAY} g from (select *, {RKEY} as name from {{{{txn}}}} where amount < 0)) group by 1,2 having count(*) >= 2) where kinds <= 3)
  where frequency <> 'unknown' or n >= 3) where rank_in_account <= 20""")(lambda b: A.recurring_payments(b.txn))
query("anomalies", f"""select * from (select *, row_number() over (partition by account_id order by amount desc, kind, at_time, seq) rank_in_account from (
  select account_id, 'large_transaction' kind, {O.stamp()} at_time, seq, -amount::double amount, case when sd > 0 then (-amount::double-mean)/sd else 0.0 end deviation, 1::bigint n from {{{{txn}}}} join (
    select account_id, s/c mean, coalesce({std_samp('c', 's', 'q')}, 0.0) sd from (select account_id, count(*) c, sum(-amount)::double s, sum(amount*amount)::double q from {{{{txn}}}} where amount < 0 group by 1)) using (account_id)
  where amount < 0 and -amount::double > mean + sd*2.0::double union all
  select account_id, 'high_frequency_day', {O.day()}, 0, 0.0, 0.0, count(*) from {{{{txn}}}} group by 1,3 having count(*) >= 10)) where rank_in_account <= 20""")(lambda b: A.anomalies(b.txn))
query("foreign_currency", f"""select *, {div('total_kzt', 'total_original')} avg_exchange_rate from (select account_id, original_currency currency, count(*) n, sum(abs(coalesce(original_amount,0)))::double total_original, sum(abs(amount))::double total_kzt
  from {{{{txn}}}} where original_currency <> '' and original_currency <> 'KZT' group by 1,2)""")(lambda b: A.foreign_currency(b.txn))
ESS, NON = ", ".join(f"'{c}'" for c in K.ESSENTIAL), ", ".join(f"'{c}'" for c in K.NON_ESSENTIAL)
query("financial_health", f"""select account_id, {div('inc-exp', 'inc')} savings_rate, coalesce(ess,0.0) essential_expenses, coalesce(non,0.0) non_essential_expenses, {div('coalesce(ess,0.0)', 'exp')} essential_ratio,
  case when months < 2 then 'stable' when (lastb-firstb)/greatest(abs(firstb),abs(lastb),1.0) > 0.10 then 'growing' when (lastb-firstb)/greatest(abs(firstb),abs(lastb),1.0) < -0.10 then 'declining' else 'stable' end balance_trend,
  months, inc/months monthly_avg_income, exp/months monthly_avg_expense, case when exp > 0 then coalesce(balance_end::double,0.0)/(exp/(case when n >= 2 then days else 30 end)) else 0.0 end financial_buffer_days
  from {{{{totals}}}} left join (select account_id, sum(case when category in ({ESS}) then -amount end)::double ess, sum(case when category in ({NON}) then -amount end)::double non from {{{{cats}}}} where amount < 0 group by 1) using (account_id)
  left join (select account_id, count(*) as months, arg_min(balance, "month") firstb, arg_max(balance, "month") lastb from {{{{monthly_breakdown}}}} group by 1) using (account_id) left join {{{{account}}}} using (account_id)""")(
    lambda b: A.financial_health(b.txn, b.cats, b.account))
DAYS_RU = "['" + "','".join(K.WEEKDAYS_RU) + "']"
query("weekday_analysis", f"""select a.account_id, d.i::int day_index, {DAYS_RU}[d.i+1] as "day", coalesce(s,0.0) amount, coalesce(n,0) n, {div('coalesce(s,0.0)', 'coalesce(n,0)')} avg_transaction from {{{{accounts}}}} a cross join (select unnest(range(7)) i) d
  left join (select account_id, isodow(ts)-1 i, sum(-amount)::double s, count(*) n from {{{{txn}}}} where amount < 0 group by 1,2) x on x.account_id = a.account_id and x.i = d.i""")(lambda b: A.weekday_analysis(b.txn))
query("daily_patterns", f"""select account_id, "day", income, expense, (coalesce(balance_start,0) + sum(net) over (partition by account_id order by "day"))::double balance from (
  select account_id, {O.day()} as "day", coalesce(sum(case when amount > 0 then amount end)::double,0.0) income, coalesce(sum(case when amount <= 0 then -amount end)::double,0.0) expense, sum(amount) net from {{{{txn}}}} group by 1,2)
  left join {{{{account}}}} using (account_id)""")(lambda b: A.daily_patterns(b.txn, b.account))

# checks
query("reconcile", """select account_id, coalesce(n,0) total_transactions, coalesce(n,0) > 0 is_valid, st+i-e calculated_end, abs(st+i-e-en) difference, greatest(1.0::double,(i+e)*1e-5::double) tolerance,
  case when st <> 0 or en <> 0 then abs(st+i-e-en) <= greatest(1.0::double,(i+e)*1e-5::double) end balance_reconciled from (
  select account_id, n, coalesce(inc,0.0) i, coalesce(exp,0.0) e, balance_start::double st, balance_end::double en from {{account}} left join {{totals}} using (account_id))""")(lambda b: A.reconcile(b.txn, b.account))
query("summary_basic", "select account_id, n total_transactions, inc total_income, exp total_expense, inc-exp net_flow, (inc+exp)/n avg_transaction from {{totals}}")(lambda b: A.summary_basic(b.txn))
query("summary", f"""select account_id, inc total_income, exp total_expense, {O.rnd('exp/days', 2)} avg_daily_expense, v/100.0::double median_high from {{{{totals}}}} join (
  select account_id, (abs(amount)*100)::bigint v, row_number() over (partition by account_id order by abs(amount)) k, count(*) over (partition by account_id) c from {{{{txn}}}}) using (account_id) where k = c//2 + 1""")(lambda b: A.summary(b.txn))
query("empty_statements", "select account_id, owner from {{account}} where account_id not in (select account_id from {{txn}})")(lambda b: A.empty_statements(b.account, b.txn))
query("field_completeness", """select account_id, count(case when description <> '' then 1 end)/count(*)*100.0::double description, count(case when counterparty <> '' then 1 end)/count(*)*100.0::double counterparty,
  count(case when merchant_name <> '' then 1 end)/count(*)*100.0::double merchant_name, count(case when counterparty_type <> 'unknown' then 1 end)/count(*)*100.0::double classified,
  count(case when is_salary or is_atm or is_cash_operation then 1 end)/count(*)*100.0::double flagged from {{txn}} group by 1""")(lambda b: A.field_completeness(b.txn))
# a second reading of the rows: texts in other fields, spelled otherwise, damaged; some rows lost, some read twice
READ_AGAIN = f"""select {O.day()} as day, amount, case when seq % 7 = 0 then '?' when seq % 7 = 1 then upper(description) when seq % 7 = 2 then 'операция' else strftime(ts, '%d.%m.%Y') || '  ' || description end description,
  case when seq % 7 = 2 then description end party from {{{{txn}}}} where seq % 11 <> 0 union all select {O.day()}, amount, 'строка', null from {{{{txn}}}} where seq % 13 = 0"""


def read_again(b):
    x = F.col("seq") % 7
    d = b.txn.withColumn("day", B.day())
    text = F.when(x == 0, "?").when(x == 1, F.upper("description")).when(x == 2, "операция").otherwise(F.concat(F.date_format("ts", "dd.MM.yyyy"), F.lit("  "), F.col("description")))
    once = d.where("seq % 11 <> 0").select("day", "amount", text.alias("description"), F.when(x == 2, F.col("description")).alias("counterparty"))
    return once.unionByName(d.where("seq % 13 = 0").select("day", "amount", F.lit("строка").alias("description"), F.lit(None).cast("string").alias("counterparty")))


SMALL = "lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"
O.fragment("true_texts", f"select {O.day()} as day, amount, {SMALL.format(c='description')} want, count(*) t from {{{{txn}}}} group by 1, 2, 3")
O.fragment("read_texts", f"select day, amount, concat_ws(' ', nullif({SMALL.format(c='description')}, ''), nullif({SMALL.format(c='party')}, '')) have, count(*) p from ({READ_AGAIN}) group by 1, 2, 3")
# a text may stand in several: each day and amount is walked in order of the true texts
O.fragment("text_edges", "select day, amount, want, have, t, p, row_number() over (partition by day, amount order by want, have) k from {{true_texts}} join {{read_texts}} using (day, amount) where contains(have, want)")
O.fragment("text_walk", """select distinct day, amount, 0 k, map {'': 0::bigint} used, 0::bigint took from {{text_edges}} union all
  select day, amount, k + 1, map_concat(used, map {'w' || want: coalesce(used['w' || want], 0) + n, 'h' || have: coalesce(used['h' || have], 0) + n}), took + n
  from (select w.*, e.want, e.have, least(e.t - coalesce(w.used['w' || e.want], 0), e.p - coalesce(w.used['h' || e.have], 0)) n from {{text_walk}} w join {{text_edges}} e on e.day = w.day and e.amount = w.amount and e.k = w.k + 1)""")
query("match_truth", """select expected, parsed, recovered, (select sum(m) from (select max(took) m from {{text_walk}} group by day, amount))::bigint fully_correct, parsed - recovered spurious from (
  select sum(t)::bigint expected, sum(p)::bigint parsed, sum(least(t, p))::bigint recovered from (select coalesce(a.t, 0) t, coalesce(b.p, 0) p from (select day, amount, sum(t) t from {{true_texts}} group by 1, 2) a
  full join (select day, amount, sum(p) p from {{read_texts}} group by 1, 2) b using (day, amount)))""")(
    lambda b: A.match_truth(b.txn.select(B.day().alias("day"), "amount", F.col("description").alias("text")), read_again(b)))
query("class_metrics", """select label, support, predicted, hits, pr "precision", rc recall, case when pr+rc > 0 then 2*pr*rc/(pr+rc) else 0.0 end f1 from (
  select *, case when predicted > 0 then hits/predicted else 0.0 end pr, case when support > 0 then hits/support else 0.0 end rc from (
  select label, sum(e)::bigint support, sum(p)::bigint predicted, sum(h)::bigint hits from (
    select quality as label, 1 e, 0 p, (quality = toxic)::int h from labels union all select toxic, 0, 1, 0 from labels) group by 1))""")(
    lambda b: A.class_metrics(b.table("labels").select(F.col("quality").alias("expected"), F.col("toxic").alias("predicted"))))



def judged(b):
    return b.table("labels").select("doc_id", F.col("quality").alias("expected"), F.col("toxic").alias("predicted"))


query("overall_metrics", f"""select sum(support)::bigint cases, sum(hits)::bigint correct, {O.rnd('sum(hits)/sum(support)*100.0::double', 6)} accuracy, {O.rnd('avg(f1)', 6)} macro_f1 from {{{{class_metrics}}}}""")(lambda b: A.overall_metrics(judged(b)))
query("group_accuracy", """select coalesce(lang, '—') as "group", count(case when quality = toxic then 1 end) correct, count(*) cases from labels left join documents using (doc_id) group by 1""")(
    lambda b: A.group_accuracy(judged(b).join(b.table("documents").select("doc_id", F.col("lang").alias("group")), "doc_id", "left")))
