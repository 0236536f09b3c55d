"""Case and portfolio queries, time-driven queries, readers and sinks."""

import uuid

from ..config import language as LN
from ..config import layouts as Y
from ..config import legal as LG
from ..operators import base as B
from ..operators import casework as C
from ..operators import evidence as EV
from ..operators import scoring as S
from ..session import checkpoint_dir
from ..sources import csv_files as CF
from ..sources import sinks as SK
from ..sources import statements as R
from ..sources.book import ANALYSIS_SQL, LOGIN_SQL, TABLES
from . import language as LA
from . import oracle as O
from .finance import subject_sql, squeeze
from .registry import query
from .scores import pc as PC

F = B.F
names = {t: t for t in TABLES}
CITE = LN.CITATION.replace("(?iu)", "(?i)")
O.fragment("analyses", ANALYSIS_SQL.format(**names))
O.fragment("logins", LOGIN_SQL.format(**names))

query("query_transactions", f"""select account_id, seq, amount, rank_in_account, found, total_amount, found > 50 truncated from (select account_id, seq, amount::double amount, row_number() over (partition by account_id order by seq) rank_in_account,
  count(*) over (partition by account_id) found, (sum(amount) over (partition by account_id))::double total_amount from {{{{txn}}}} where ts >= '1995-01-01' and abs(amount) >= 30000 and amount < 0 and contains(lower({O.CP_DESC}), 'supplier')) where rank_in_account <= 50""")(
    lambda b: C.query_transactions(b.txn, date_from="1995-01-01", min_amount=30000, direction="expense", name="Supplier"))
query("summarise_counterparties", f"""select * from (select *, row_number() over (partition by account_id order by abs(total_amount) desc, name) rank_in_account from (select account_id, coalesce(nullif({O.CP_DESC},''),'—') as name,
  count(*) operations, sum(amount)::double total_amount, arg_min(counterparty_type, seq) "type" from {{{{txn}}}} group by 1,2)) where rank_in_account <= 20""")(lambda b: C.summarise_counterparties(b.txn))
query("period_totals", f"""select account_id, coalesce(m,'total') period, count(*) n, coalesce(sum(case when amount > 0 then amount end)::double,0.0) income, coalesce(sum(case when amount <= 0 then -amount end)::double,0.0) expense,
  coalesce(sum(case when amount > 0 then amount end)::double,0.0)-coalesce(sum(case when amount <= 0 then -amount end)::double,0.0) net_flow from (select *, {O.month()} m from {{{{txn}}}}) group by grouping sets ((account_id, m), (account_id))""")(
    lambda b: C.period_totals(b.txn))
query("risk_breakdown", "select account_id, composite_score, risk_level, account_type, velocity, structuring, merchant_risk, cross_reference, pattern_detector, patterns from {{composite}}")(
    lambda b: b.scored.select("account_id", "composite_score", "risk_level", "account_type", "velocity", "structuring", "merchant_risk", "cross_reference", "pattern_detector", "patterns"))
O.fragment("scheme_refs", " union all ".join(f"select '{k}' pattern, regexp_extract_all('{v}', '{CITE}', 1) c, regexp_extract_all('{v}', '{CITE}', 2) n" for k, v in LG.PATTERN_REFERENCE.items()))
# a code carries on to later bare numbers
O.fragment("scheme_cited", """select distinct pattern, code, n as number from (select pattern, n, last_value(nullif(c, '') ignore nulls) over (partition by pattern order by i) code from (
  select pattern, generate_subscripts(n, 1) i, unnest(c) c, unnest(n) n from {{scheme_refs}})) where code is not null""")
# two codes have an article for every document, the third that schemes refer to has none
O.fragment("two_codes", "select unnest(['ЗРК О ПОД/ФТ', 'УК РК']) code, doc_id::varchar as number, title, text from {{articles}}")


def two_codes(b):
    d = LA.articles(b).withColumn("number", F.col("doc_id").cast("string"))
    return d.withColumn("code", F.explode(F.array(F.lit("ЗРК О ПОД/ФТ"), F.lit("УК РК"))))


query("case_articles", """select account_id, p.pattern, p.seq, r.code, r.number, title, trim(substr(text, 1, 500)) || case when length(text) > 500 then '…' else '' end excerpt
  from {{patterns}} p join {{scheme_cited}} r using (pattern) join {{two_codes}} a on a.code = r.code and a.number = r.number""")(lambda b: EV.scheme_articles(b.patterns, two_codes(b)))
query("scheme_breakdown", f"""select account_id, pattern, seq, confidence, reason, {PC} counter_evidence, coalesce(listed, '') articles from {{{{patterns}}}} join (select account_id, account_type from {{{{composite}}}}) using (account_id)
  join {{{{scheme_why}}}} using (account_id, pattern, seq) left join (select pattern, string_agg(r.code || ' ст. ' || r.number, '; ' order by r.code || ' ст. ' || r.number) listed from {{{{scheme_cited}}}} r
  join {{{{two_codes}}}} a on a.code = r.code and a.number = r.number group by 1) using (pattern)""")(
    lambda b: S.scheme_breakdown(b.scored, b.patterns, b.scheme_reasons, EV.scheme_articles(b.patterns, two_codes(b))))
query("list_transactions", f"select account_id, seq, {O.stamp()} at_time, amount::double amount, type from {{{{txn}}}} where type = 'transfer_out' order by ts desc, seq desc, account_id limit 100 offset 20")(
    lambda b: C.list_transactions(b.txn, 20, 100, tx_type="transfer_out"))
O.fragment("subject_rows", f"""select unique_identifier, subject_type, min(name) as name from (select name, {subject_sql('name')} subject_type, substr(regexp_replace(trim(regexp_replace(lower({squeeze('name')}), '[^a-zA-Zа-яА-ЯёЁ0-9\\s]', '', 'g')), '\\s+', '_', 'g'), 1, 150) || '_' || {subject_sql('name')} unique_identifier
  from (select distinct trim({O.CP_STRICT}) as name from {{{{txn}}}} where {O.CP_STRICT} <> '')) group by 1,2""")
query("subjects", "select * from {{subject_rows}}")(lambda b: b.subjects)
query("list_subjects", "select * from {{subject_rows}} where subject_type = 'individual' and (contains(lower(name),'и') or contains(lower(unique_identifier),'и'))")(
    lambda b: C.list_subjects(b.subjects, b.txn, needle="и", subject_type="individual"))
BAND = "case when composite_score is null then risk_score > 6 else composite_score > 60 end"
query("list_analyses", f"""select analysis_id, name, composite_score, risk_score from {{{{analyses}}}} where {BAND} and created_at >= '1996-01-01' and created_at <= '1999-12-31 23:59:59' and name ilike '%urgent%' order by risk_score desc, analysis_id limit 100""")(
    lambda b: C.list_analyses(b.analyses, band="high", date_from="1996-01-01", date_to="1999-12-31", search="urgent", sort="risk_score").select("analysis_id", "name", "composite_score", "risk_score"))
query("portfolio_stats", f"""select count(*) total_analyses, count(case when status='completed' then 1 end) completed, count(case when status='completed' and (composite_score <= 30 or composite_score is null) then 1 end) low_risk,
  count(case when status='completed' and composite_score > 30 and composite_score <= 60 then 1 end) medium_risk, count(case when status='completed' and composite_score > 60 then 1 end) high_risk, count(case when status='failed' then 1 end) failed,
  count(case when status='pending' then 1 end) pending, count(case when status in ('parsing','analyzing','in_progress','processing') then 1 end) in_progress, sum(composite_score::decimal(18,2))::double/count(composite_score) avg_composite,
  sum(transaction_count)::bigint transactions, sum(total_amount)::double total_amount, {O.rnd("count(case when status='completed' then 1 end)/count(*)*100.0::double", 2)} completion_rate, (select count(*) from {{{{subject_rows}}}}) total_subjects from {{{{analyses}}}}""")(
    lambda b: C.portfolio_stats(b.analyses, b.subjects))
query("monthly_chart", f"""select {O.month('created_at')} as "month", count(*) total, count(case when status='completed' then 1 end) completed, count(case when composite_score > 60 then 1 end) high_risk,
  {O.rnd('coalesce(sum(composite_score::decimal(18,2))::double/count(composite_score), 0.0)', 1)} avg_risk from {{{{analyses}}}} where created_at >= date_trunc('month', timestamp '1999-08-15') - interval 180 day group by 1""")(
    lambda b: C.monthly_chart(b.analyses, "1999-08-15"))
query("analysis_stats", """select account_id, count(*) n, count(case when amount > 0 then 1 end) incoming, count(case when amount < 0 then 1 end) outgoing, count(case when starts_with(type,'transfer') then 1 end) transfers,
  coalesce(sum(case when amount > 0 then amount end)::double,0.0) incoming_amount, coalesce(sum(case when amount < 0 then -amount end)::double,0.0) outgoing_amount from {{txn}} group by 1""")(lambda b: C.analysis_stats(b.txn))
query("analyst_stats", """select user_id, count(*) total, count(case when status='completed' then 1 end) completed, count(case when status='pending' then 1 end) pending, count(case when status='processing' then 1 end) processing,
  count(case when status='failed' then 1 end) failed, sum(case when status='completed' then composite_score::decimal(18,2) end)::double/count(case when status='completed' then composite_score end) avg_risk from {{analyses}} group by 1""")(
    lambda b: C.analyst_stats(b.analyses))
query("transaction_view", """select * from (select account_id, row_number() over (partition by account_id order by abs(amount) desc, seq) rank_in_account, seq, amount::double amount from {{txn}}
  where contains(lower(coalesce(description,'') || ' ' || coalesce(counterparty,'')), 'то') and amount < 0) where rank_in_account <= 50""")(lambda b: C.transaction_view(b.txn, "то", "out"))
query("close_sessions", f"""select login_id, user_id, {O.stamp('login_at')} login_at, coalesce(stayed, -1) stayed, case when stayed is not null then 'closed' when epoch_us(timestamp '{C.AS_OF}') - epoch_us(login_at) > {7 * B.DAY_US} then 'expired' else 'active' end state from {{{{logins}}}}""")(
    lambda b: C.close_sessions(b.logins, C.AS_OF))
query("online_time", "select user_id, coalesce(sum(stayed),0)::bigint seconds_online, count(stayed) sessions from {{logins}} group by 1")(lambda b: C.online_time(b.logins))
query("prune_notifications", f"""select * from (select user_id, note_id, is_read, row_number() over (partition by user_id order by created_at desc, note_id desc) rank from (
  select user_id % 20 user_id, login_id note_id, login_at created_at, event_type <> 'click' is_read from {{{{logins}}}}) where not (is_read and created_at < timestamp '2024-02-20' - interval 30 day)) where rank <= 100""")(
    lambda b: C.prune_notifications(b.logins.select((F.col("user_id") % 20).alias("user_id"), F.col("login_id").alias("note_id"), F.col("login_at").alias("created_at"), (F.col("event_type") != "click").alias("is_read")), "2024-02-20").drop("created_at"))


def hits(b):
    return b.logins.select(F.concat(F.lit("U"), (F.col("user_id") % 8).cast("string")).alias("account_id"), F.col("login_id").alias("seq"), F.col("login_at").alias("ts"))


O.fragment("hits", "select 'U' || (user_id % 8) account_id, login_id seq, epoch_us(login_at) t, row_number() over (partition by user_id % 8 order by login_at, login_id) rn from {{logins}}")
# one hit after the other: the times let through so far decide the next one
O.fragment("rate_walk", """select account_id, 0 rn, []::bigint[] passed, null::bigint seq, true allowed, 0::bigint retry_after from (select distinct account_id from {{hits}}) union all
  select w.account_id, w.rn + 1, case when len(f) < 3 then list_append(f, h.t) else f end, h.seq, len(f) < 3, case when len(f) < 3 then 0 else greatest(trunc((3600000000 - (h.t - f[1]))/1000000.0)::bigint, 1) end
  from (select w.*, h.t ht, list_filter(w.passed, lambda p: h.t - p < 3600000000) f from {{rate_walk}} w join {{hits}} h on h.account_id = w.account_id and h.rn = w.rn + 1) w join {{hits}} h on h.account_id = w.account_id and h.rn = w.rn + 1""")
query("rate_limit", "select account_id, seq, allowed, retry_after from {{rate_walk}} where rn > 0")(lambda b: C.rate_limit(hits(b), 3, 3600))
query("presence", f"""select user_id, {O.stamp('min(login_at)')} online_from, {O.stamp('max(login_at) + interval 5 minute')} offline_at, count(*) n from (select *, sum(brk) over (partition by user_id order by login_at, login_id) run from (
  select *, case when epoch_us(login_at) - lag(epoch_us(login_at)) over (partition by user_id order by login_at, login_id) <= 300000000 then 0 else 1 end brk from {{{{logins}}}})) group by user_id, run""")(
    lambda b: C.presence(b.logins.withColumnRenamed("login_at", "ts")))
query("latest_progress", f"select user_id session_id, arg_max(event_type, (login_at, login_id)) step, {O.stamp('max(login_at)')} at_time from {{{{logins}}}} group by 1")(
    lambda b: C.latest_progress(b.logins.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("step"), F.col("login_at").alias("ts"), F.col("login_id").alias("seq"))))

# ---- readers: statements printed from the book and read back
DAYCOL = "date_trunc('day', ts)"


def printed(c):
    """'- 1 400,00 ₸'"""
    return F.concat(F.when(c < 0, "- ").otherwise("+ "), F.translate(F.format_number(F.abs(c), 2), ",.", " ,"))


def simple_cells(b):
    t = b.txn
    return t.select("account_id", "seq", F.array(F.date_format("ts", "dd.MM.yyyy"), F.concat(printed(F.col("amount")), F.lit(" ₸")), F.coalesce("counterparty", F.lit("—")), F.coalesce("description", F.lit(""))).alias("cells"))


HEADER = ["Күні", "Сомасы", "Қарсы агент", "Толығырақ"]
LOWTX = f"lower({O.text('description')})"
TYPE_SQL = f"case when {O.any_of(LOWTX, Y.TRANSFER_WORDS)} then (case when amount > 0 then 'transfer_in' else 'transfer_out' end) when {O.any_of(LOWTX, Y.INCOME_WORDS)} then 'income' when {O.any_of(LOWTX, Y.EXPENSE_WORDS)} then 'expense' when amount > 0 then 'income' else 'expense' end"
OWNER = "Шот"
#: How folders name an account that is null.
NO_ACCOUNT = "__HIVE_DEFAULT_PARTITION__"


def csv_folder(b):
    """Statements of the book as CSV files with a column for the account: four delimiters, cells with quotes and line ends.

    An account stands in one file as a whole; a file of its own for each would make as many files as there are accounts.
    """
    cells = [F.date_format("ts", "dd.MM.yyyy"), F.col("amount").cast("string"), F.coalesce("counterparty", F.lit("")), two_lines(), F.coalesce("account_id", F.lit(NO_ACCOUNT))]
    t = b.txn.select("seq", *[c.alias(h) for c, h in zip(cells, [*HEADER, OWNER])]).dropna(subset=HEADER[:2])
    path = f"{checkpoint_dir(b.spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    for i, sep in enumerate(CF.DELIMITERS):
        some = t.where(F.crc32(F.col(OWNER).cast("binary")) % 4 == i).repartition(OWNER).sortWithinPartitions(OWNER, F.col("seq").asc_nulls_last()).drop("seq")
        some.write.options(sep=sep, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/{i}")
    return path


def two_lines():
    text = F.coalesce("description", F.lit(""))
    return F.when(F.col("seq") % 5 == 0, F.concat(text, F.lit('\n"второй" ряд; с, знаками|'))).otherwise(text)


def csv_statements(b):
    txn, rejects = CF.read_statements_csv(b.spark, csv_folder(b), OWNER)
    rows = txn.select("account_id", "seq", B.day().alias("day"), B.dbl("amount").alias("amount"), "description", "counterparty", "type")
    # places in the file, from 1 on: the rows before are counted by slices
    return B.sliced_cumsum(rows, ["account_id"], "seq", ["seq"], {"place": F.lit(1)}, CF.SLICE_LINES).drop("seq").unionByName(
        rejects.select("account_id", F.lit("").alias("day"), F.lit(0.0).alias("amount"), F.lit("").alias("description"), F.lit("").alias("counterparty"), F.col("reason").alias("type"), F.lit(0).cast("long").alias("place")))


query("csv_statements", f"""select account_id, {O.day()} as day, amount::double amount, trim(description) as description, nullif(counterparty, '') counterparty, {TYPE_SQL} as "type", row_number() over (partition by account_id order by seq)::bigint place
  from (select account_id, seq, ts, amount, counterparty, coalesce(description, '') || case when seq % 5 = 0 then chr(10) || '"второй" ряд; с, знаками|' else '' end description from {{{{txn}}}}) where amount <> 0
  union all select account_id, '', 0.0, '', '', 'no date or amount in the row', 0 from {{{{txn}}}} where amount = 0""")(csv_statements)
query("rows_to_txn", f"select account_id, seq, {O.day()} as day, amount::double amount, description, counterparty, {TYPE_SQL} as \"type\" from {{{{txn}}}} where amount <> 0")(
    lambda b: R.rows_to_txn(simple_cells(b), R.resolve_layout(HEADER)).select("account_id", "seq", B.day().alias("day"), B.dbl("amount").alias("amount"), "description", "counterparty", "type"))


def split_cells(b):
    a = F.col("amount")
    num = F.translate(F.format_number(F.abs(a), 2), ",", "")
    return b.txn.select("account_id", "seq", F.array(F.date_format("ts", "yyyy-MM-dd"), F.coalesce("description", F.lit("")), F.when(a > 0, num).otherwise(""), F.when(a < 0, num).otherwise(""), F.lit("0")).alias("cells"))


query("rows_to_txn_split_amounts", f"select account_id, seq, {O.day()} as day, amount::double amount from {{{{txn}}}} where amount <> 0")(
    lambda b: R.rows_to_txn(split_cells(b), R.resolve_layout(["Дата", "Описание", "Приход", "Расход", "Остаток"])).select("account_id", "seq", B.day().alias("day"), B.dbl("amount").alias("amount")))
query("infer_tx_type", f"select account_id, seq, {TYPE_SQL} as \"type\" from {{{{txn}}}}")(lambda b: b.txn.select("account_id", "seq", R.infer_tx_type(F.col("description"), F.col("amount")).alias("type")))
query("text_to_txn", f"select account_id, seq, {O.day()} as day, amount::double amount from {{{{txn}}}} where amount <> 0")(
    lambda b: R.text_to_txn(b.txn.select("account_id", "seq", F.concat_ws(" ", F.date_format("ts", "dd.MM.yyyy"), F.regexp_replace("description", r"\d", ""), F.translate(printed(F.col("amount")), " ", "")).alias("line"))).select(
        "account_id", "seq", B.day().alias("day"), B.dbl("amount").alias("amount")))
query("infer_account", f"select account_id, {O.stamp('min(ts)')} period_start, {O.stamp('max(ts)')} period_end, arg_min(amount, seq)::double balance_end from {{{{txn}}}} group by 1")(
    lambda b: R.infer_account(b.txn.withColumn("balance_after", F.col("amount"))).select("account_id", B.stamp("period_start").alias("period_start"), B.stamp("period_end").alias("period_end"), B.dbl("balance_end").alias("balance_end")))


def sheet(b):
    """Title, header and rows of every statement as cells; every ninth row has a note below."""
    rows = b.txn.select("account_id", (F.col("seq") * 2 + 2).alias("row_idx"), F.array(F.date_format("ts", "dd.MM.yyyy"), printed(F.col("amount")), "counterparty", "description").alias("cells"))
    note = F.when(F.col("seq") % 18 == 0, "Сумма заблокирована").otherwise("продолжение")
    notes = b.txn.filter("seq % 9 = 0").select("account_id", (F.col("seq") * 2 + 3).alias("row_idx"), F.array(F.lit(""), F.lit(""), F.lit(""), note).alias("cells"))
    acc = b.txn.select("account_id").distinct()
    head = acc.select("account_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("row_idx"), F.array(F.lit("Выписка"), F.lit("")).alias("cells")),
                                                     F.struct(F.lit(1).cast("long").alias("row_idx"), F.array(F.lit("Дата"), F.lit("Сумма"), F.lit("Контрагент"), F.lit("Детали")).alias("cells")))).alias("h")).select("account_id", "h.*")
    return rows, notes, head


query("find_header", "select account_id, 1::bigint header_row, true has_names from {{accounts}}")(lambda b: (lambda s: R.find_header(s[0].unionByName(s[2])))(sheet(b)))
query("infer_layout", "select account_id, 0 date_col, 0 amount_col from {{accounts}}")(lambda b: (lambda s: R.infer_layout(s[0].unionByName(s[2])))(sheet(b)))
query("validate_layout", "select account_id, true date_ok, true amount_ok from {{accounts}}")(lambda b: R.validate_layout(sheet(b)[0], {"date": 0, "amount": 1}))
query("attach_continuations", """select account_id, seq*2+2 tx_row, seq % 18 = 0 is_blocked, case when seq % 9 = 0 then 2 else 1 end::bigint "rows" from {{txn}}""")(
    lambda b: (lambda s: R.attach_continuations(s[0].unionByName(s[1])))(sheet(b)))

ALIASES = {"Покупка": ["Покупка", "Сатып алу", "Purchase"], "Перевод": ["Перевод", "Аударым", "Transfer"], "Пополнение": ["Пополнение", "Толықтыру", "Replenishment"], "Снятие": ["Снятие", "Ақша алу", "Withdrawal"], "Разное": ["Разное", "Басқа", "Other"]}


def card_rows(b):
    spoken = F.create_map(*[F.lit(x) for k, v in ALIASES.items() for x in (k, "|".join(v))])
    op = F.get(F.split(spoken[F.col("label")], r"\|"), (F.col("seq") % 3).cast("int"))
    fx = F.when(F.col("original_amount").isNotNull(), F.concat(F.lit("\n("), printed(-F.col("original_amount")), F.lit(" "), F.col("original_currency"), F.lit(")"))).otherwise("")
    return b.labelled.select("account_id", "seq", F.array(F.date_format("ts", "dd.MM.yy"), F.concat(printed(F.col("amount")), F.lit(" ₸"), fx), op, F.coalesce("description", F.lit(""))).alias("cells"))


LOWD = "lower(coalesce(description,''))"
PERS = r"(regexp_matches(trim(description), '^[А-ЯЁӘҒҚҢӨҰҮІҺа-яёәғқңөұүіһəƏ][а-яёәғқңөұүіһəƏА-ЯЁ]+\s+[А-ЯЁӘҒҚҢӨҰҮІҺа-яёәғқңөұүіһəƏ]\.$') or regexp_matches(trim(description), '^[А-ЯЁӘҒҚҢӨҰҮІҺəƏ][а-яёәғқңөұүіһəƏ]+\s+[А-ЯЁӘҒҚҢӨҰҮІҺəƏ][а-яёәғқңөұүіһəƏ]+$'))"
RULE = f"case when {O.any_of(LOWD, Y.CARD_DEPOSIT)} then 'deposit' when {O.any_of(LOWD, Y.CARD_PENSION)} then 'pension' when {O.any_of(LOWD, Y.CARD_SALARY)} then 'salary' when {O.any_of(LOWD, Y.CARD_ATM)} then 'atm' when {O.any_of(LOWD, Y.CARD_BANK)} then 'bank' when label in ('Перевод','Пополнение') and {PERS} then 'person' when label = 'Покупка' then 'merchant' when label = 'Снятие' then 'cash' else 'none' end"
query("map_rows_card", f"""select account_id, seq, {O.day()} as day, amount::double amount, case when label = 'Перевод' then (case when amount > 0 then 'transfer_in' else 'transfer_out' end) when label = 'Покупка' then 'expense' when label = 'Пополнение' then 'income' when label = 'Снятие' then 'withdrawal' else 'other' end "type",
  -original_amount::double original_amount, original_currency, {O.rnd('abs(amount::double/original_amount::double)', 4)} exchange_rate,
  case when r = 'deposit' then 'deposit' when r in ('pension','salary') then 'government' when r in ('atm','cash') then 'atm' when r = 'bank' then 'bank' when r = 'person' then 'person' when r = 'merchant' or label = 'Пополнение' then 'merchant' else 'unknown' end counterparty_type,
  r = 'salary' is_salary, r = 'atm' is_atm, r in ('atm','cash') is_cash_operation from (select *, {RULE} r from {{{{labelled}}}})""")(
    lambda b: R.map_rows_card(card_rows(b)).select("account_id", "seq", B.day().alias("day"), B.dbl("amount").alias("amount"), "type", B.dbl("original_amount").alias("original_amount"), "original_currency",
                                                   "exchange_rate", "counterparty_type", "is_salary", "is_atm", "is_cash_operation"))


def totals_sheet(b):
    s = b.labelled.groupBy("account_id", "label").agg(F.sum("amount").alias("v"))
    rows = s.select("account_id", F.lit(5).cast("long").alias("row_idx"), F.array("label", F.concat(printed(F.col("v")), F.lit(" ₸"))).alias("cells"))
    a = b.account
    pick = lambda i, label, c: F.struct(F.lit(i).cast("long").alias("row_idx"), F.array(F.lit(label), printed(c)).alias("cells"))
    edge = a.select("account_id", F.explode(F.array(pick(1, "Доступно на 01.01.24", F.col("balance_start")), pick(9, "Доступно на 31.01.24", F.col("balance_end")),
                                                    pick(20, "Другие пополнения", F.col("balance_end")), pick(21, "Итого", F.col("balance_start")))).alias("h")).select("account_id", "h.*")
    return rows.unionByName(edge)


O.fragment("label_sums", "select account_id, label, abs(sum(amount))::double v from {{labelled}} group by 1,2")
query("read_totals", """select account_id, a.balance_start::double balance_start, a.balance_end::double balance_end, max(case when label='Пополнение' then v end) deposits, max(case when label='Перевод' then v end) transfers,
  max(case when label='Покупка' then v end) purchases, max(case when label='Снятие' then v end) withdrawals, max(case when label='Разное' then v end) other, abs(a.balance_end)::double other_deposits_limit, abs(a.balance_start)::double total_cash_limit
  from {{account}} a left join {{label_sums}} using (account_id) group by all""")(
    lambda b: R.read_totals(totals_sheet(b)).drop("salary_money_limit").select("account_id", *[B.dbl(c).alias(c) for c in (
        "balance_start", "balance_end", "deposits", "transfers", "purchases", "withdrawals", "other", "other_deposits_limit", "total_cash_limit")]))


def ledger_cells(b):
    a = F.col("amount")
    plain = F.translate(F.format_number(F.abs(a), 2), ",.", " ,")
    text = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("Поступлениенасчет"), F.col("description"))).when(F.col("seq") % 4 == 1, F.concat(F.lit("Оплатауслуг "), F.col("description"))).otherwise(F.col("description"))
    fee = F.col("seq") % 10 == 7
    return b.txn.select("account_id", "seq", F.array(F.date_format("ts", "dd.MM.yyyy"), F.date_format("ts", "dd.MM.yyyy"), text, plain, F.lit("KZT"), F.when((a > 0) & ~fee, plain).otherwise("0,00"),
                                                     F.when((a < 0) & ~fee, F.concat(F.lit("-"), plain)).otherwise("0,00"), F.when(fee, F.concat(F.when(a < 0, "-").otherwise(""), plain)).otherwise("0,00"), F.lit("KZ01")).alias("cells"))


LT = "case when seq % 4 = 0 then 'Поступление на счет ' || description when seq % 4 = 1 then 'Оплата услуг ' || description else description end"
WORDS = " ".join(f"when {O.any_of('lower(tx)', ws)} then '{k}'" for k, ws in Y.LEDGER_TYPES)
query("map_rows_ledger", f"""select account_id, seq, {O.day()} as day, amount::double amount, case when seq % 10 = 7 then 'fee' {WORDS} when amount > 0 then 'income' else 'expense' end "type",
  case when starts_with(tx, 'Поступление на счет ') then trim(substr(tx, 21)) when starts_with(tx, 'Оплата услуг ') then trim(substr(tx, 14)) when contains(tx, 'на другую карту') then 'Карточный перевод' when contains(lower(tx), 'комиссия') then 'Halyk Bank' else tx end counterparty,
  contains(lower(tx), 'зарплат') is_salary from (select *, trim(regexp_replace({LT}, '([a-z])([A-Z])', '\\1 \\2', 'g')) tx from {{{{txn}}}}) where amount <> 0""")(
    lambda b: R.map_rows_ledger(ledger_cells(b)).select("account_id", "seq", B.day().alias("day"), B.dbl("amount").alias("amount"), "type", "counterparty", "is_salary"))
query("read_totals_ledger", """select account_id, coalesce(sum(case when amount > 0 then amount end)::double,0.0) deposits, coalesce(sum(case when amount < 0 then -amount end)::double,0.0) withdrawals, 0.0::double commission from {{txn}} group by 1""")(
    lambda b: R.read_totals_ledger(b.txn.groupBy("account_id").agg(F.coalesce(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), F.lit(0)).alias("i"), F.coalesce(F.sum(F.when(F.col("amount") < 0, F.col("amount"))), F.lit(0)).alias("o")).select(
        "account_id", F.lit(9).cast("long").alias("row_idx"), F.array(F.lit("Всего"), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.translate(F.format_number("i", 2), ",.", " ,"), F.translate(F.format_number("o", 2), ",.", " ,"), F.lit("0,00")).alias("cells"))).select(
        "account_id", *[B.dbl(c).alias(c) for c in ("deposits", "withdrawals", "commission")]))
OPS = list(Y.EXCHANGE_TYPES) + ["P2P Trading order", "Unknown thing"]
OPLIST = "['" + "','".join(OPS) + "']"


def exchange_rows(b):
    op = F.element_at(F.array(*[F.lit(o) for o in OPS]), (F.col("seq") % len(OPS)).cast("int") + 1)
    return b.txn.select("account_id", "seq", F.date_format("ts", "yy-MM-dd HH:mm:ss").alias("time"), op.alias("operation"), F.lit("USDT").alias("coin"), F.col("amount").cast("string").alias("change"), F.lit("").alias("remark"))


EXACT = "case op " + " ".join(f"when '{k}' then '{v}'" for k, v in Y.EXCHANGE_TYPES.items()) + " else (case " + " ".join(f"when contains(op, '{k}') then '{v}'" for k, v in Y.EXCHANGE_TYPES.items()) + " else 'other' end) end"
SIGNED = ", ".join(f"'{o}'" for o in Y.EXCHANGE_SIGNED)
CATS = "case " + " ".join(f"when {O.any_of('op', ws)} then '{n}'" for n, ws in Y.EXCHANGE_CATEGORIES) + " else 'Other' end"
query("map_rows_exchange", f"""select account_id, seq, strftime(ts, '%Y-%m-%d %H:%M:%S') at_time, amount::double amount, case when contains(op,'transfer') and contains(op,'wallet') then (case when amount > 0 then 'transfer_in' else 'transfer_out' end)
  when op in ({SIGNED}) then (case when amount > 0 then 'income' else 'expense' end) when contains(op,'p2p') then (case when amount > 0 then 'transfer_in' else 'transfer_out' end) else {EXACT} end "type", {CATS} category,
  case when contains(op,'p2p') or contains(op,'c2c') then 'person' when contains(op,'deposit') or contains(op,'withdraw') then 'bank' when {O.any_of('op', ['buy', 'sell', 'convert', 'merchant'])} then 'merchant' when contains(op,'transfer') then 'bank' else 'unknown' end counterparty_type
  from (select *, lower({OPLIST}[(seq % {len(OPS)})::int + 1]) op from {{{{txn}}}})""")(
    lambda b: R.map_rows_exchange(exchange_rows(b)).select("account_id", "seq", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at_time"), "amount", "type", "category", "counterparty_type"))


def issuer_sql():
    cols = []
    for i, (name, (words, accounts, hints)) in enumerate(Y.ISSUERS.items()):
        pts = [f"(case when contains(lower(tx), '{w.lower()}') then 15 else 0 end)" for w in words] + [f"(case when regexp_matches(tx, '{p}') then 25 else 0 end)" for p in accounts]
        pts += [f"(case when contains(lower(tx), '{h.lower()}') then 10 else 0 end)" for h in hints]
        cols.append(f"select account_id, {i} o, '{name}' issuer, least({' + '.join(pts)}, 100) p from texts_by_account")
    return " union all ".join(cols)


query("detect_issuer", f"""with texts_by_account as (select distinct description || ' ' || counterparty account_id, description || ' ' || counterparty tx from {{{{txn}}}})
  select account_id doc_id, case when p < 20 then 'unknown' else issuer end issuer, p/100.0::double confidence from (select *, row_number() over (partition by account_id order by p desc, o) k from ({issuer_sql()})) where k = 1""")(
    lambda b: R.detect_issuer(b.txn.select(F.concat_ws(" ", "description", "counterparty").alias("text")).distinct().withColumn("doc_id", F.col("text"))))

# every other text comes from a CSV file
query("detect_issuer_of_files", "select doc_id, case when length(doc_id) % 2 = 0 then 'unknown' else issuer end issuer, case when length(doc_id) % 2 = 0 then 0.0::double else confidence end confidence from {{detect_issuer}}")(
    lambda b: R.detect_issuer(b.txn.select(F.concat_ws(" ", "description", "counterparty").alias("text")).distinct().withColumn("doc_id", F.col("text"))
                              .withColumn("file_type", F.when(F.length("text") % 2 == 0, "CSV").otherwise("pdf"))))

# ---- sinks
query("analyses_with_modules", f"select account_id analysis_id, composite_score, risk_level, least(10, floor(composite_score/10)::int) risk_score, account_type, patterns, {', '.join(S.MODULES)} from {{{{composite}}}}")(
    lambda b: SK.analyses_rows(b.report, b.scored).drop("report"))
query("analyses_rows", "select account_id analysis_id, composite_score, risk_level, least(10, floor(composite_score/10)::int) risk_score from {{composite}}")(lambda b: SK.analyses_rows(b.report).drop("report"))
query("upsert_subjects", "select unique_identifier, subject_type, min(name) as name from {{subject_rows}} group by 1,2")(
    lambda b: SK.upsert_subjects(b.subjects, b.subjects.filter("subject_type = 'individual'")))
query("dedupe_subjects", """select c_mktsegment unique_identifier, min(c_custkey) id, arg_min(c_name, c_custkey) as name from customer group by 1""")(
    lambda b: SK.dedupe_subjects(b.table("customer").select(F.col("c_mktsegment").alias("unique_identifier"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))))
