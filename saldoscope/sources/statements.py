"""Statement readers: rows already in CSV, cell or text form become canonical ``txn`` rows.

One job reads a folder of statements. Layouts come from the header row, which the driver
resolves once per group of files; the rows themselves never leave the executors.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import layouts as Y
from ..operators import base as B


#: Amounts as statements print them; wider than the canonical rows, so that nothing vanishes on the way.
MONEY = "decimal(30,2)"


def resolve_layout(header) -> dict:
    """Column position of every role; balance is tested before amount."""
    roles: dict = {}
    for i, cell in enumerate(header):
        text = str(cell or "").lower()
        role = next((r for r, words in Y.COLUMN_ALIASES if r not in roles and any(w in text for w in words)), None)
        if text.strip() and role:
            roles[role] = i
    if "amount" not in roles and {"credit", "debit"} <= roles.keys():
        roles["amount_split"] = True
    return roles


def resolve_extras(header) -> dict:
    out: dict = {}
    for i, cell in enumerate(header):
        text = str(cell or "").strip().lower()
        for role, words in Y.EXTRA_COLUMNS:
            if text and role not in out and any(w in text for w in words):
                out[role] = i
    return out


def two_digit_year(ts: Column) -> Column:
    """Years 69 to 99 belong to the last century."""
    return F.when(F.year(ts) > 2068, ts - F.expr("interval 100 years")).otherwise(ts)


def date_head(c: Column) -> Column:
    """The date a text begins with, in one of three shapes, else an empty text."""
    return F.regexp_extract(F.replace(F.trim(c), F.lit("/"), F.lit(".")), r"^(\d{2}\.\d{2}\.\d{4}|\d{2}\.\d{2}\.\d{2}|\d{4}-\d{2}-\d{2})", 1)


def read_head(head: Column) -> Column:
    """Instant of a ``date_head``; the pattern follows from the shape, since one that fails costs an exception."""
    long, _, iso = Y.DATE_FORMATS
    year = F.substring(head, 7, 2)
    short = F.concat(F.substring(head, 1, 6), F.when(year > "68", "19").otherwise("20"), year)
    read = F.when(F.substring(head, 5, 1) == "-", F.try_to_timestamp(head, F.lit(iso))).when(F.length(head) == 10, F.try_to_timestamp(head, F.lit(long)))
    return F.coalesce(read, F.when(F.substring(head, 3, 1) == ".", F.try_to_timestamp(short, F.lit(long))))


def parse_date_any(c: Column) -> Column:
    return read_head(date_head(c))


def parse_amount_any(c: Column) -> Column:
    """Sign from a minus or from words; a comma is decimal unless a point is there as well."""
    text = F.coalesce(c, F.lit(""))
    low = F.lower(text)
    minus = text.contains("-") | low.contains("списан") | low.contains("расход")
    digits = F.regexp_replace(text, r"[^\d,.]", "")
    both = digits.contains(",") & digits.contains(".")
    v = F.concat(F.when(minus, "-").otherwise(""), F.replace(digits, F.lit(","), F.when(both, "").otherwise(".")))
    return F.coalesce(F.when(digits != "", v).try_cast(MONEY), F.lit(0).cast(MONEY))  # a cast of nothing costs an exception


def infer_tx_type(text: Column, amount: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.when(B.has_any(low, Y.TRANSFER_WORDS), F.when(amount > 0, "transfer_in").otherwise("transfer_out"))
            .when(B.has_any(low, Y.INCOME_WORDS), "income").when(B.has_any(low, Y.EXPENSE_WORDS), "expense")
            .when(amount > 0, "income").otherwise("expense"))


def project_rows(raw: DataFrame, at: dict[str, Column], split: Column, extras: dict[str, Column], keep=()) -> DataFrame:
    """(account_id, seq, cells) -> canonical columns of every row; unreadable dates are null, amounts 0.

    ``at`` and ``extras`` give the position of each role, ``split`` whether credit and debit have columns of
    their own. Positions may differ from row to row and are null where a layout has no such column.
    """
    cell = lambda i: F.trim(F.coalesce(F.get("cells", i), F.lit("")))
    amount = F.when(F.col("_split"), F.when(F.col("_credit") != 0, F.col("_credit")).otherwise(-F.abs("_debit"))).otherwise(F.col("_amount"))
    cp = cell(at["counterparty"])
    cp = F.when(cp.isin("—", "-", ""), F.lit(None)).otherwise(cp)
    operation = cell(at["type"])
    used = F.array(at["date"], at["counterparty"], at["balance"], F.when(split, at["credit"]).otherwise(at["amount"]), F.when(split, at["debit"]))
    kept = F.filter("cells", lambda x, i: ~F.coalesce(F.array_contains(F.array_compact(used), i), F.lit(False)) & (x != ""))
    text = F.when(at["description"].isNotNull(), cell(at["description"])).otherwise(F.array_join(F.transform(kept, lambda x: F.trim(x)), " "))
    if "payment_purpose" in extras:
        text = F.coalesce(B.blank_to_null(text), cell(extras["payment_purpose"]))
    text = F.coalesce(B.blank_to_null(text), F.trim(F.concat_ws(" ", B.blank_to_null(operation), cp)))
    d = raw.select("account_id", "seq", date_head(cell(at["date"])).alias("_date"), *[parse_amount_any(cell(at[r])).alias(f"_{r}") for r in ("credit", "debit", "amount")], split.alias("_split"),
                   text.alias("description"), cp.alias("counterparty"), operation.alias("operation"),
                   *[B.blank_to_null(cell(i)).alias(r) for r, i in extras.items() if r != "counterparty"], *keep)
    d = B.read_once(d, ts=read_head(F.col("_date")), amount=amount).drop("_date", "_credit", "_debit", "_amount", "_split")
    d = d.select("account_id", "seq", "ts", "amount", *[c for c in d.columns if c not in ("account_id", "seq", "ts", "amount")])
    return d.withColumn("type", infer_tx_type(F.concat_ws(" ", B.blank_to_null("operation"), F.col("description")), F.col("amount"))).drop("operation")


def rows_to_txn(raw: DataFrame, roles: dict, extras: dict | None = None) -> DataFrame:
    """(account_id, seq, cells) of one layout -> canonical rows; rows without date or amount drop out."""
    roles = {"date": 0, "amount": 1} | roles
    at = {r: F.lit(roles.get(r)).cast("int") for r, _ in Y.COLUMN_ALIASES}
    return project_rows(raw, at, F.lit("amount_split" in roles), {r: F.lit(i) for r, i in (extras or {}).items()}).filter("ts is not null and amount <> 0")


def text_to_txn(lines: DataFrame) -> DataFrame:
    """(account_id, seq, line): the amount is the last money figure after the date."""
    d = lines.select("account_id", "seq", F.trim("line").alias("line")).withColumn("_d", F.regexp_extract("line", Y.DATE_REGEX, 1))
    d = d.withColumn("_tail", F.substring("line", F.instr("line", F.col("_d")) + F.length("_d"), F.length("line")))
    d = d.withColumn("_money", F.try_element_at(F.regexp_extract_all("_tail", F.lit(Y.MONEY_REGEX), 1), F.lit(-1)))
    d = B.read_once(d, amount=parse_amount_any(F.col("_money")), _date=date_head(F.col("_d"))).filter("_date <> '' and amount <> 0")
    return d.select("account_id", "seq", read_head(F.col("_date")).alias("ts"), "amount", infer_tx_type(F.col("line"), F.col("amount")).alias("type"),
                    F.trim("_tail").alias("description"))


def infer_account(txn: DataFrame) -> DataFrame:
    bal = F.col("balance_after")
    return txn.groupBy("account_id").agg(F.min("ts").alias("period_start"), F.max("ts").alias("period_end"),
                                         F.min_by(F.when(bal != 0, bal), F.when(bal != 0, F.col("seq"))).alias("balance_end"))


# ---- sheets of cells: (account_id, row_idx, cells)
def find_header(sheet: DataFrame) -> DataFrame:
    """First row with a date word and an amount or operation word, else first row that starts
    with a date."""
    low = F.lower(F.array_join("cells", " "))
    named = B.has_any(low, dict(Y.COLUMN_ALIASES)["date"]) & (B.has_any(low, dict(Y.COLUMN_ALIASES)["amount"]) | B.has_any(low, dict(Y.COLUMN_ALIASES)["type"]))
    dated = F.trim(F.get("cells", F.lit(0))).rlike("^" + Y.DATE_REGEX)
    g = sheet.groupBy("account_id").agg(F.min(F.when(named, F.col("row_idx"))).alias("named"), F.min(F.when(dated, F.col("row_idx"))).alias("dated"))
    return g.select("account_id", F.coalesce("named", "dated").alias("header_row"), F.col("named").isNotNull().alias("has_names"))


def infer_layout(sheet: DataFrame) -> DataFrame:
    """Date and amount columns from the first row that holds a date."""
    dated = F.exists("cells", lambda c: F.trim(c).rlike("^" + Y.DATE_REGEX))
    first = sheet.filter(dated).groupBy("account_id").agg(F.min_by("cells", "row_idx").alias("cells"))
    cells = first.select("account_id", F.posexplode("cells").alias("pos", "cell"))
    is_date = F.trim("cell").rlike("^" + Y.DATE_REGEX)
    number = F.col("cell").rlike(r"[+-]?\s*[\d\s]+[,.]?\d*\s*[₸₽$€¥£]?")
    return cells.groupBy("account_id").agg(F.max(F.when(is_date, F.col("pos"))).alias("date_col"), F.min(F.when(number, F.col("pos"))).alias("amount_col"))


def validate_layout(sheet: DataFrame, roles: dict) -> DataFrame:
    """A role survives when half or more of its non-blank values look right."""
    date = F.trim(F.get("cells", F.lit(roles["date"])))
    num = F.trim(F.get("cells", F.lit(roles["amount"])))
    share = lambda ok, c: F.count(F.when(ok & (c != ""), 1)) / F.count(F.when(c != "", 1))
    g = sheet.groupBy("account_id").agg(share(date.rlike("^" + Y.DATE_REGEX), date).alias("date_share"), share(num.rlike(r"\d"), num).alias("amount_share"))
    return g.select("account_id", (F.col("date_share") >= 0.5).alias("date_ok"), (F.col("amount_share") >= 0.5).alias("amount_ok"))


def attach_continuations(sheet: DataFrame, slice_rows: int = 1 << 16) -> DataFrame:
    """A row that does not start with a date belongs to the row before that does; a marker in
    it blocks that transaction."""
    d = sheet.withColumn("is_tx", F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))).rlike(r"^\d{2}\.\d{2}\.\d{2}"))
    d = B.carry_last(d, ["account_id"], "row_idx", F.when(F.col("is_tx"), F.col("row_idx")), "tx_row", slice_rows)
    blocked = ~F.col("is_tx") & B.has_any(F.lower(F.array_join("cells", " ")), Y.BLOCKED_MARKERS)
    return d.filter("tx_row is not null").groupBy("account_id", "tx_row").agg(F.max(blocked).alias("is_blocked"), F.count("*").alias("rows"))


def canon_operation(c: Column) -> Column:
    pairs = [(a, canon) for canon, aliases in Y.OPERATION_ALIASES.items() for a in aliases]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])[F.lower(F.trim(F.translate(c, "Əə", "Әә")))]


def numeric(c: Column) -> Column:
    """Digits of '1 400,00 ₸' as a decimal."""
    return F.coalesce(F.replace(F.regexp_replace(c, r"[^\d,.]", ""), F.lit(","), F.lit(".")).try_cast(MONEY), F.lit(0).cast(MONEY))


def split_fx_amount(c: Column) -> Column:
    """'- 9 999,00 ₸\\n(- 20,00 USD)' -> amount, original amount, currency."""
    fx = r"\(([+-])\s*([0-9\s]+(?:[.,]\d{2})?)\s*([A-Z]{3})\)"
    sign, num, cur = (F.regexp_extract(c, fx, i) for i in (1, 2, 3))
    head = F.element_at(F.split(c, "\n"), 1)
    v = numeric(head)
    orig = F.when(cur != "", F.when(sign == "-", -numeric(num)).otherwise(numeric(num)))
    return F.struct(F.when(head.contains("-"), -F.abs(v)).otherwise(v).alias("amount"), orig.alias("original_amount"), B.blank_to_null(cur).alias("original_currency"))


def map_rows_card(rows: DataFrame) -> DataFrame:
    """Card statement rows [date, amount, operation, details] in Russian, Kazakh or English."""
    c = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    d = rows.select("account_id", "seq", two_digit_year(F.try_to_timestamp(F.regexp_extract(c(0), r"^(\d{2}\.\d{2}\.\d{2})", 1), F.lit("dd.MM.yy"))).alias("ts"),
                    split_fx_amount(c(1)).alias("a"), canon_operation(c(2)).alias("op"), c(3).alias("details"))
    d = d.filter("ts is not null and op is not null").select("account_id", "seq", "ts", "a.*", "op", "details")
    low, op = F.lower(F.translate("details", "Əə", "Әә")), F.col("op")
    person = F.trim("details").rlike(r"^[А-ЯЁӘҒҚҢӨҰҮІҺа-яёәғқңөұүіһəƏ][а-яёәғқңөұүіһəƏА-ЯЁ]+\s+[А-ЯЁӘҒҚҢӨҰҮІҺа-яёәғқңөұүіһəƏ]\.$") | F.trim("details").rlike(
        r"^[А-ЯЁӘҒҚҢӨҰҮІҺəƏ][а-яёәғқңөұүіһəƏ]+\s+[А-ЯЁӘҒҚҢӨҰҮІҺəƏ][а-яёәғқңөұүіһəƏ]+$")
    rule = (F.when(B.has_any(low, Y.CARD_DEPOSIT), "deposit").when(B.has_any(low, Y.CARD_PENSION), "pension").when(B.has_any(low, Y.CARD_SALARY), "salary")
            .when(B.has_any(low, Y.CARD_ATM), "atm").when(B.has_any(low, Y.CARD_BANK), "bank").when(op.isin("Перевод", "Пополнение") & person, "person")
            .when(op == "Покупка", "merchant").when(op == "Снятие", "cash").otherwise("none"))
    d = d.withColumn("rule", rule)
    r = F.col("rule")
    kind = (F.when(r == "deposit", "deposit").when(r.isin("pension", "salary"), "government").when(r.isin("atm", "cash"), "atm").when(r == "bank", "bank")
            .when(r == "person", "person").when((r == "merchant") | (op == "Пополнение"), "merchant").otherwise("unknown"))
    tx = (F.when(op == "Перевод", F.when(F.col("amount") > 0, "transfer_in").otherwise("transfer_out")).when(op == "Покупка", "expense")
          .when(op == "Пополнение", "income").when(op == "Снятие", "withdrawal").otherwise("other"))
    prefix, name = F.lit(None).cast("string"), F.col("details")
    for p in reversed(Y.ENTITY_PREFIXES):
        hit = F.upper("details").startswith(p.upper())
        prefix = F.when(hit, p.strip().strip('"')).otherwise(prefix)
        name = F.when(hit, F.trim(F.substr("details", F.lit(len(p) + 1)))).otherwise(name)
    rate = F.when(F.col("original_amount") != 0, B.py_round(F.abs(B.dbl("amount") / B.dbl("original_amount")), 4))
    return d.select("account_id", "seq", "ts", "amount", tx.alias("type"), F.col("details").alias("description"), "original_amount", "original_currency", rate.alias("exchange_rate"),
                    F.col("details").alias("counterparty"), kind.alias("counterparty_type"), name.alias("merchant_name"), prefix.alias("merchant_type"),
                    (r == "deposit").alias("is_deposit_operation"), (r == "pension").alias("is_pension_benefit"), (r == "salary").alias("is_salary"),
                    (r == "bank").alias("is_bank_transfer"), (r == "atm").alias("is_atm"), r.isin("atm", "cash").alias("is_cash_operation"))


def read_totals(sheet: DataFrame) -> DataFrame:
    """Opening and closing balance, printed totals and cash limits of each statement."""
    label, value = F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))), F.coalesce(F.get("cells", F.lit(1)), F.lit(""))
    low = F.lower(F.translate(label, "Əə", "Әә"))
    d = sheet.withColumn("low", low).withColumn("op", canon_operation(label)).withColumn("v", F.when(value.contains("-"), -numeric(value)).otherwise(numeric(value)))
    avail = B.has_any(F.col("low"), Y.AVAILABLE_LABELS)
    take = lambda cond: F.max(F.when(cond, F.abs(F.col("v"))))
    g = d.groupBy("account_id").agg(
        F.min_by(F.when(avail, F.col("v")), F.when(avail, F.col("row_idx"))).alias("balance_start"), F.max_by(F.when(avail, F.col("v")), F.when(avail, F.col("row_idx"))).alias("balance_end"),
        *[take(F.col("op") == op).alias(name) for op, name in (("Пополнение", "deposits"), ("Перевод", "transfers"), ("Покупка", "purchases"), ("Снятие", "withdrawals"), ("Разное", "other"))],
        take(B.has_any(F.col("low"), Y.LIMIT_SALARY)).alias("salary_money_limit"), take(B.has_any(F.col("low"), Y.LIMIT_OTHER)).alias("other_deposits_limit"),
        take(B.has_any(F.col("low"), Y.LIMIT_TOTAL)).alias("total_cash_limit"))
    return g


def fix_glued(c: Column) -> Column:
    for bad, good in Y.GLUED_WORDS.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    return F.trim(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"))


def map_rows_ledger(rows: DataFrame) -> DataFrame:
    """Nine columns: date, processed, text, amount, currency, credit, debit, commission, card."""
    c = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    bare = lambda i: F.replace(F.regexp_replace(c(i), r"[₸$€\s ]", ""), F.lit(","), F.lit("."))
    money = lambda i: F.coalesce(B.blank_to_null(bare(i)).try_cast(MONEY), F.lit(0).cast(MONEY))
    ts = F.when(F.length(c(0)) == 8, two_digit_year(F.try_to_timestamp(c(0), F.lit("dd.MM.yy")))).when(c(0) != "", F.try_to_timestamp(c(0), F.lit("dd.MM.yyyy")))
    d = rows.select("account_id", "seq", ts.alias("ts"),
                    fix_glued(F.replace(c(2), F.lit("\n"), F.lit(" "))).alias("description"), F.coalesce(B.blank_to_null(c(4)), F.lit("KZT")).alias("currency"),
                    money(5).alias("credit"), money(6).alias("debit"), money(7).alias("commission"), c(8).alias("reference"))
    fee = (F.col("commission") != 0) & (F.col("credit") == 0) & (F.col("debit") == 0)
    amount = F.when(fee, F.col("commission")).when(F.col("credit") > 0, F.col("credit")).otherwise(F.col("debit"))
    d = B.read_once(d.withColumnRenamed("ts", "_ts"), ts=F.col("_ts"), amount=amount).drop("_ts").filter("ts is not null and amount <> 0")
    low, text = F.lower("description"), F.col("description")
    by_word = F.lit(None).cast("string")
    for kind, words in reversed(Y.LEDGER_TYPES):
        by_word = F.when(B.has_any(low, words), kind).otherwise(by_word)
    tx = F.when(fee, "fee").otherwise(F.coalesce(by_word, F.when(F.col("credit") > 0, "income").otherwise("expense")))
    cp = text
    cp = F.when(low.contains("комиссия"), "Halyk Bank").otherwise(cp)
    cp = F.when(text.contains("на другую карту"), "Карточный перевод").otherwise(cp)
    for p in reversed(["Поступление на счет ", "Перевод на счет ", "Оплата услуг "]):
        cp = F.when(text.startswith(p), F.trim(F.substr(text, F.lit(len(p) + 1)))).otherwise(cp)
    kind = (F.when(B.has_any(low, ["ао ", "нао ", "тоо ", "ип "]), "merchant").when(B.has_any(low, ["банк", "комисси"]), "bank").when(B.has_any(low, ["банкомат", "наличн"]), "atm")
            .when(B.has_any(low, ["пенси", "пособи"]), "government").when(low.contains("перевод"), "person").otherwise("unknown"))
    return d.select("account_id", "seq", "ts", "amount", tx.alias("type"), "description", "currency", cp.alias("counterparty"), kind.alias("counterparty_type"),
                    B.first_word(text, ["АО", "НАО", "ТОО", "ИП"]).alias("merchant_type"), "reference", low.contains("зарплат").alias("is_salary"),
                    B.has_any(low, ["пенси", "пособи"]).alias("is_pension_benefit"))


def read_totals_ledger(sheet: DataFrame) -> DataFrame:
    """Totals row of the nine-column statement."""
    row = sheet.filter(F.lower(F.array_join(F.slice("cells", 1, 3), " ")).rlike("всего|барлығы|total"))
    v = lambda i: numeric(F.get("cells", F.lit(i)))
    return row.select("account_id", v(5).alias("deposits"), v(6).alias("withdrawals"), v(7).alias("commission"))


def parse_dt_multi(c: Column) -> Column:
    text = F.trim(c)
    formats = [(r"^\d{2}-", "yy-MM-dd HH:mm:ss"), (r"^\d{4}-", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}-.*T", "yyyy-MM-dd'T'HH:mm:ss"), (r"^\d{4}-", "yyyy-MM-dd"),
               (r"^\d{2}-", "yy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy HH:mm:ss"), (r"^\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy"), (r"^\d{2}\.\d{2}\.\d{2}$", "dd.MM.yy")]
    read = [F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f))) for p, f in formats]
    return F.coalesce(*[two_digit_year(r) if "yyyy" not in f else r for r, (_, f) in zip(read, formats)])


def parse_amount_sci(c: Column) -> Column:
    """'+11.04', '-0.00001234', '1e-5'; null when it is no number."""
    x = F.replace(F.regexp_replace(F.trim(c), r"[^\d.,+\-eE]", ""), F.lit(","), F.lit("."))
    return F.regexp_replace(x, r"\.(?=.*\.)", "").try_cast("double")


def map_rows_exchange(rows: DataFrame) -> DataFrame:
    """(account_id, seq, time, operation, coin, change, remark) of an exchange ledger."""
    op = F.lower(F.trim(F.coalesce("operation", F.lit(""))))
    exact = F.create_map(*[F.lit(x) for kv in Y.EXCHANGE_TYPES.items() for x in kv])
    d = rows.withColumn("op", op).withColumn("ts", parse_dt_multi(F.col("time"))).withColumn("amount", parse_amount_sci(F.col("change"))).filter("ts is not null and amount is not null")
    o, up = F.col("op"), F.col("amount") > 0
    base = F.coalesce(exact[o], exact[B.first_word(o, list(Y.EXCHANGE_TYPES))], F.lit("other"))
    tx = (F.when(o.contains("transfer") & o.contains("wallet"), F.when(up, "transfer_in").otherwise("transfer_out")).when(o.isin(*Y.EXCHANGE_SIGNED), F.when(up, "income").otherwise("expense"))
          .when(o.contains("p2p"), F.when(up, "transfer_in").otherwise("transfer_out")).otherwise(base))
    cat = F.lit("Other")
    for name, words in reversed(Y.EXCHANGE_CATEGORIES):
        cat = F.when(B.has_any(o, words), name).otherwise(cat)
    kind = (F.when(B.has_any(o, ["p2p", "c2c"]), "person").when(B.has_any(o, ["deposit", "withdraw"]), "bank").when(B.has_any(o, ["buy", "sell", "convert", "merchant"]), "merchant")
            .when(o.contains("transfer"), "bank").otherwise("unknown"))
    text = F.trim(F.concat_ws(" ", F.coalesce(B.blank_to_null("operation"), F.lit("Unknown")), B.blank_to_null("coin"), B.blank_to_null("remark")))
    return d.select("account_id", "seq", "ts", "amount", tx.alias("type"), text.alias("description"), cat.alias("category"), F.coalesce(B.blank_to_null("coin"), F.lit("USDT")).alias("currency"),
                    F.coalesce(B.blank_to_null("remark"), B.blank_to_null("operation"), F.lit("Binance")).alias("counterparty"), kind.alias("counterparty_type"))


def detect_issuer(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> issuer with the highest score; listed order breaks ties. A CSV file (column
    file_type, if there is one) says nothing of its issuer. The pattern table is fixed, so it is
    part of the expression and no join is needed."""
    low = F.lower("text")
    point = lambda cond, w: F.when(cond, w).otherwise(0)
    scores = []
    for i, (name, (words, accounts, hints)) in enumerate(Y.ISSUERS.items()):
        s = F.lit(0)
        for w in words:
            s = s + point(low.contains(w.lower()), 15)
        for p in accounts:
            s = s + point(F.col("text").rlike(p), 25)
        for h in hints:
            s = s + point(low.contains(h.lower()), 10)
        scores.append(F.struct(F.least(s, F.lit(100)).alias("points"), F.lit(-i).alias("order"), F.lit(name).alias("issuer")))
    best = F.array_max(F.array(*scores))
    d = docs.withColumn("b", best)
    csv = F.coalesce(F.lower("file_type") == "csv", F.lit(False)) if "file_type" in docs.columns else F.lit(False)
    return d.select("doc_id", F.when(csv | (F.col("b.points") < 20), "unknown").otherwise(F.col("b.issuer")).alias("issuer"), F.when(csv, 0.0).otherwise(F.col("b.points") / 100.0).alias("confidence"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Statute corpus in JSON lines; broken lines and lines without a text are skipped."""
    schema = "code string, number string, title string, text string, url string, fetched_at string, title_kk string, url_kk string, _bad string"
    d = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    need = [F.col(c).isNotNull() for c in ("code", "number", "title", "text", "url")]
    ok = F.col("_bad").isNull()
    for c in need:
        ok = ok & c
    return d.filter(ok).drop("_bad").na.fill("", ["fetched_at", "title_kk", "url_kk"])
