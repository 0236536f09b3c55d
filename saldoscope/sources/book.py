"""The book of accounts: canonical ``txn`` rows of every account in one DataFrame.

The driver tables stand in for bank statements. ``events`` gives eight busy accounts with
time of day, ``orders`` and ``lineitem`` give many accounts with dates only. The mapping is
one SQL text that both Spark and the checking database can run.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_EVENT_NAMES = [
    "Айгерим С.", "Ержан А.", "Иванов Иван", "NURLAN B.", "Петрова Анна", "Сауле К.",
    "Бекзат Т.", "Дана М.", "Олжас Р.", "Мадина Ж.", "Тимур Л.", "Асель Н.",
    "ТОО Silk Road Trade", "MAGNUM", "ИП Ахметов Даулет", "АО Народный Банк", "BINANCE",
    "1XBET", "ТОО ПромСтрой", "YANDEX.GO",
]
_LEDGER_TEXTS = [
    "Покупка MAGNUM", "Аптека №5", "Kaspi Магазин", "Коммунальные услуги",
    "Аренда квартиры", "YANDEX TAXI", "ТОО Golden Group", "Договор № ",
]

_NAME_CASE = f"split_part('{'|'.join(_EVENT_NAMES)}', '|', k % 20 + 1)"
_TEXT_CASE = f"split_part('{'|'.join(_LEDGER_TEXTS)}', '|', cast(l_partkey % 8 as int) + 1)"

#: Eight busy accounts hold all events: the case of very hot keys.
FOLDED = "user_id % 8"

EVENT_TXN_SQL = f"""
select
  concat('U', cast({FOLDED} as string)) as account_id,
  event_id as seq,
  cast(ts as timestamp) as ts,
  cast(case
    when event_type = 'signup' then v * 2000
    when event_type = 'view' then v * 4000
    when event_type = 'error' then -(v * 8000)
    when k % 3 = 1 then -(v * 90)
    when event_type = 'click' then -(floor(v) * 10000)
    else -(v * 10000) end as decimal(15,2)) as amount,
  case event_type when 'signup' then 'income' when 'view' then 'transfer_in'
    when 'click' then 'transfer_out' when 'error' then 'withdrawal' else 'expense' end as type,
  case
    when event_type = 'signup' and k % 20 = 12 then 'Зарплата'
    when event_type = 'signup' then 'Поступление средств'
    when event_type = 'error' then 'Снятие в банкомате'
    when event_type = 'view' and k % 10 = 3 then concat('Возврат аванса ', {_NAME_CASE})
    when event_type = 'view' then concat('От ', {_NAME_CASE})
    when event_type = 'click' and k % 10 = 4 then concat('Оплата по договору № ', cast(1000 + k as string))
    when event_type = 'click' and k % 10 = 6 then 'обналичка через кэш'
    when event_type = 'click' then concat('Для ', {_NAME_CASE})
    else {_NAME_CASE} end as description,
  {_NAME_CASE} as counterparty,
  case when event_type = 'error' then 'atm' when k % 20 < 12 then 'person'
    else 'merchant' end as counterparty_type,
  case when event_type in ('purchase', 'click') then concat('cat', cast(k % 4 as string)) end as category,
  'KZT' as currency,
  case when k % 3 = 1 and event_type in ('purchase', 'click') then 'USD' end as original_currency,
  case when k % 3 = 1 and event_type in ('purchase', 'click') then cast(v / 5 as decimal(15,2)) end as original_amount,
  case when k % 11 = 0 then concat('Shop ', cast(k as string)) end as merchant_name,
  event_type = 'signup' and k % 20 = 12 as is_salary,
  event_type = 'error' as is_atm,
  event_type = 'view' and k % 25 = 8 as is_cash_operation,
  false as is_pension_benefit,
  false as is_deposit_operation
from (select event_id, ts, user_id, event_type, cast(value as decimal(10,2)) as v,
        cast(regexp_extract(props, '[0-9]+', 0) as int) as k from {{events}}) e
"""

_LEDGER_TAIL = """
  'KZT' as currency, cast(null as string) as original_currency,
  cast(null as decimal(15,2)) as original_amount, cast(null as string) as merchant_name,
  false as is_salary, false as is_atm, false as is_cash_operation,
  false as is_pension_benefit, false as is_deposit_operation
"""

LEDGER_INCOME_SQL = f"""
select concat('C', cast(o_custkey as string)) as account_id, o_orderkey * 10000000000 as seq,
  cast(o_orderdate as timestamp) as ts, cast(o_totalprice as decimal(15,2)) as amount,
  'income' as type, concat('Поступление ', o_orderpriority) as description,
  case when o_orderkey % 3 = 0 then 'Фонд Дружба'
    else concat('ТОО Работодатель ', cast(o_orderkey % 2 as string)) end as counterparty,
  'unknown' as counterparty_type, cast(null as string) as category, {_LEDGER_TAIL}
from {{orders}}
"""

LEDGER_EXPENSE_SQL = f"""
select concat('C', cast(o_custkey as string)) as account_id,
  ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as seq,
  cast(l_shipdate as timestamp) as ts,
  cast(case when l_partkey % 10 = 0 then -(50000 + cast(l_quantity as decimal(10,2)) * 100)
    else -cast(l_extendedprice as decimal(15,2)) end as decimal(15,2)) as amount,
  case when l_partkey % 5 = 2 then 'transfer_out' else 'expense' end as type,
  case when l_partkey % 8 = 7 then concat({_TEXT_CASE}, cast(100 + l_suppkey as string))
    else {_TEXT_CASE} end as description,
  case when l_partkey % 10 = 0 then 'Мама Гульнара' else s_name end as counterparty,
  case when l_partkey % 10 = 0 then 'person' else 'unknown' end as counterparty_type,
  concat('flag_', l_returnflag) as category, {_LEDGER_TAIL}
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{supplier}} on l_suppkey = s_suppkey
"""

# The same three parts as one text for the checking database.
TXN_ORACLE_SQL = " union all ".join(
    part.format(**{t: t for t in TABLES})
    for part in (EVENT_TXN_SQL, LEDGER_INCOME_SQL, LEDGER_EXPENSE_SQL))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input comes in fewer pieces than there are cores.

    A large folder has many splits and is left as it is, so no shuffle is added there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _part(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def event_txn(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    return _part(spark, sf_dir, EVENT_TXN_SQL.replace(FOLDED, "user_id") if by_user else EVENT_TXN_SQL, "events")


def ledger_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    income = _part(spark, sf_dir, LEDGER_INCOME_SQL, "orders")
    expense = _part(spark, sf_dir, LEDGER_EXPENSE_SQL, "lineitem", "orders", "supplier")
    return income.unionByName(expense)


def load_txn(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """Canonical rows of all accounts; ``by_user`` gives each user an account of their own."""
    tune(spark)
    txn = event_txn(spark, sf_dir, by_user).unionByName(ledger_txn(spark, sf_dir))
    return txn.withColumn("ts", F.col("ts").cast("timestamp"))

ACCOUNT_SQL = """
select concat('C', cast(c_custkey as string)) as account_id, c_name as owner,
  cast(c_acctbal as decimal(15,2)) as balance_start,
  cast(case when c_custkey % 3 = 0 then 0 else c_acctbal + c_custkey end as decimal(15,2)) as balance_end from {customer}
union all
select distinct concat('U', cast(user_id % 8 as string)), 'Иванов Иван Иванович', cast(100000 as decimal(15,2)),
  cast(250000 as decimal(15,2)) from {events}
"""
ANALYSIS_SQL = """
select o_orderkey as analysis_id, o_custkey % 5 as user_id, concat('Statement ', o_orderpriority) as name,
  cast(o_orderdate as timestamp) as created_at,
  case o_orderstatus when 'F' then 'completed' when 'P' then 'processing' else 'pending' end as status,
  case when o_orderstatus = 'F' then cast(cast(floor(o_totalprice) as bigint) % 101 as double) end as composite_score,
  cast(cast(floor(o_totalprice) as bigint) % 11 as int) as risk_score,
  cast(o_orderkey % 40 as bigint) as transaction_count, cast(o_totalprice as decimal(15,2)) as total_amount
from {orders}
"""
#: Payments between customers: what the graph across accounts is made of. Customer 7 gets a third of them.
TRANSFER_SQL = """
select concat('C', cast(o_custkey as string)) as account_id, o_orderkey as seq, cast(o_orderdate as timestamp) as ts,
  cast(case when o_orderkey % 4 = 1 then o_totalprice else -o_totalprice end as decimal(15,2)) as amount, c_name as counterparty
from {orders} join {customer} on c_custkey = case when o_orderkey % 3 = 0 then 7 else 1 + o_orderkey % 500 end
"""
LOGIN_SQL = """
select event_id as login_id, user_id, cast(ts as timestamp) as login_at, event_type,
  case when event_type <> 'error' then cast(floor(cast(value as decimal(10,2)) * 60) as bigint) end as stayed
from {events}
"""


def load_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, ACCOUNT_SQL, "customer", "events")


def load_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, TRANSFER_SQL, "orders", "customer")


def load_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, ANALYSIS_SQL, "orders")


def load_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, LOGIN_SQL, "events")
