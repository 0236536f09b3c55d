"""Fixed values for reading statements: header words, aliases, operation maps, issuers."""

COLUMN_ALIASES = [
    ("balance", ["баланс", "остаток", "қалдық", "қалдығы", "balance"]),
    ("date", ["дата", "күні", "date", "время", "уақыт"]),
    ("credit", ["приход", "кіріс", "credit", "зачисление"]),
    ("debit", ["расход", "шығыс", "debit", "списание"]),
    ("amount", ["сумма", "сомасы", "amount", "sum"]),
    ("counterparty", ["контрагент", "қарсы агент", "counterparty", "получатель", "плательщик", "payee", "payer"]),
    ("description", ["описание", "детали", "сипаттама", "description", "details", "назначение", "толығырақ"]),
    ("type", ["вид операции", "операция түрі", "тип", "type", "операция", "категория"]),
]
EXTRA_COLUMNS = [
    ("counterparty", ["контрагент", "counterparty", "получатель", "плательщик", "payee", "payer"]),
    ("counterparty_iin_bin", ["иин", "бин", "iin", "bin", "iin_bin", "иин_бин"]),
    ("counterparty_account", ["счет", "счёт", "account", "iban"]),
    ("counterparty_bank", ["банк", "bank"]),
    ("payment_purpose", ["назначение", "purpose", "основание"]),
]
DATE_FORMATS = ["dd.MM.yyyy", "dd.MM.yy", "yyyy-MM-dd"]
DATE_REGEX = r"(\d{2}\.\d{2}\.\d{4}|\d{2}\.\d{2}\.\d{2}|\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}/\d{2}/\d{2})"
MONEY_REGEX = r"([+-]?\d[\d   ]*[.,]\d{2}(?!\d))"
INCOME_WORDS = [
    "пополнение", "зачисление", "поступление", "входящий", "возврат", "deposit", "credit", "incoming", "salary",
    "зарплата", "пенсия", "cashback", "кэшбэк", "начисление",
]
EXPENSE_WORDS = [
    "покупка", "списание", "оплата", "платёж", "платеж", "расход", "purchase", "payment", "debit", "withdrawal",
    "снятие", "комиссия",
]
TRANSFER_WORDS = ["перевод", "transfer", "p2p", "отправка", "получение"]

OPERATION_ALIASES = {
    "Покупка": ["покупка", "покупки", "зат сатып алу", "сатып алу", "purchase", "purchases"],
    "Перевод": ["перевод", "переводы", "аударым", "аударымдар", "transfer", "transfers"],
    "Пополнение": ["пополнение", "пополнения", "толықтыру", "толықтырулар", "replenishment", "replenishments"],
    "Снятие": ["снятие", "снятия", "қолма-қол ақша алу", "ақша алу", "қолма-қол ақша", "withdrawal", "withdrawals", "cash withdrawal"],
    "Разное": ["разное", "әртүрлі", "басқа", "басқалары", "өзге", "өзгелері", "other", "others", "miscellaneous"],
}
CARD_DEPOSIT = [
    "на kaspi депозит", "с kaspi депозита", "kaspi депозит", "kaspi депозитке", "kaspi депозитінен", "kaspi депозиті",
    "to kaspi deposit", "from kaspi deposit", "kaspi deposit",
]
CARD_PENSION = [
    "пенсия", "пособие", "пенсия/пособие", "зейнетақы", "жәрдемақы", "зейнетақы/жәрдемақы", "pension", "allowance", "benefit",
]
CARD_SALARY = ["зарплата", "зарп.", "жалақы", "еңбекақы", "salary", "payroll", "wage"]
CARD_ATM = ["банкомат", "atm", "банкоматында", "банкоматта"]
CARD_BANK = [
    "карты другого банка", "другого банка", "басқа банктің картасынан", "басқа банк", "басқа банктен",
    "card of other bank", "other banks", "another bank",
]
ENTITY_PREFIXES = ["ИП ", "ТОО ", "АО ", "ОО ", "TOO ", 'ТОО"']
BLOCKED_MARKERS = ["заблокирована", "бұғатталған", "blocked"]
AVAILABLE_LABELS = ["доступно на", "қолжетімді", "card balance", "available"]
LIMIT_SALARY = ["зарплатн", "жалақы", "salary"]
LIMIT_OTHER = ["другие пополнения", "толықтырулар", "other deposits"]
LIMIT_TOTAL = ["итого", "барлығы", "жиыны", "жиынтығы", "total"]

GLUED_WORDS = {
    "Ежемесячнаякомиссияза": "Ежемесячная комиссия за ", "Переводмеждусвоимисчетами": "Перевод между своими счетами",
    "Переводсосчетанасчет": "Перевод со счета на счет", "Переводнадругуюкарту": "Перевод на другую карту",
    "Поступлениенасчет": "Поступление на счет ", "Поступлениеперевода": "Поступление перевода",
    "Зачислениезарплаты": "Зачисление зарплаты", "Зачислениепенсии": "Зачисление пенсии",
    "Зачислениепособия": "Зачисление пособия", "Снятиеналичных": "Снятие наличных", "Покупкатовара": "Покупка товара",
    "Оплатауслуг": "Оплата услуг", "Возвратсредств": "Возврат средств", "Финансовыйцентр": "Финансовый центр",
    "обслуживаниекарточки": "обслуживание карточки", "КАТИУимС": "КАТИУ им. С.",
}
LEDGER_TYPES = [
    ("income", ["поступление", "зачисление", "возврат"]), ("transfer_out", ["перевод на другую", "перевод между"]),
    ("transfer_in", ["поступление перевода"]), ("withdrawal", ["снятие наличных"]), ("expense", ["покупка", "оплата"]),
    ("fee", ["комиссия"]),
]

EXCHANGE_TYPES = {
    "p2p trading": "transfer_out", "p2p": "transfer_out", "buy": "crypto_buy", "sell": "crypto_sell",
    "small assets exchange buy": "crypto_buy", "large otc trading": "crypto_buy", "commission rebate": "income",
    "cashback voucher": "income", "deposit": "income", "withdraw": "expense", "fiat deposit": "income",
    "fiat withdraw": "expense", "simple earn flexible interest": "income", "simple earn locked rewards": "income",
    "savings interest": "income", "staking rewards": "income", "staking purchase": "expense",
    "staking redemption": "income", "launchpool interest": "income", "eth 2.0 staking": "expense",
    "eth 2.0 staking rewards": "income", "transaction fee": "fee", "fee": "fee", "transaction related": "fee",
    "transfer between main and funding wallet": "transfer_out", "transfer between main account/futures": "transfer_out",
    "transfer between spot account and funding account": "transfer_out", "main and funding account transfer": "transfer_out",
    "main and sub account transfer": "transfer_out", "crypto box": "income", "binance pay": "income",
    "merchant payment": "expense", "c2c transfer": "transfer_out", "send": "transfer_out", "receive": "transfer_in",
    "realized profit and loss": "other", "funding fee": "fee", "insurance fund": "fee", "transaction sold": "crypto_sell",
    "transaction revenue": "income", "transaction buy": "crypto_buy", "transaction spend": "expense",
    "simple earn flexible subscription": "expense", "simple earn flexible redemption": "income",
    "simple earn locked subscription": "expense", "simple earn locked redemption": "income", "binance convert": "crypto_buy",
    "merchant acquiring": "income", "referral kickback": "income", "distribution": "income", "airdrop": "income",
    "airdrop assets": "income", "asset recovery": "other", "token swap - redenomination/rebranding": "other",
    "token swap": "other", "crypto box refund": "income", "convert": "crypto_buy", "auto-invest": "crypto_buy",
}
EXCHANGE_SIGNED = [
    "convert", "binance convert", "large otc trading", "binance pay", "merchant payment", "merchant acquiring",
    "realized profit and loss", "crypto box",
]
EXCHANGE_CATEGORIES = [
    ("P2P Trading", ["p2p"]), ("Futures/Margin", ["transaction buy", "transaction spend"]),
    ("Futures/Margin", ["transaction sold", "transaction revenue"]), ("Futures/Margin", ["realized profit"]),
    ("Crypto Buy", ["buy", "convert", "auto-invest", "binance convert"]), ("Crypto Sell", ["sell"]),
    ("Deposit", ["deposit", "fiat deposit"]), ("Withdrawal", ["withdraw"]),
    ("Staking/Earn", ["interest", "staking", "earn", "reward", "subscription", "redemption"]),
    ("Fee", ["fee", "commission", "funding fee", "insurance"]), ("Internal Transfer", ["transfer"]),
    ("Crypto Box", ["crypto box"]), ("Binance Pay", ["merchant", "binance pay", "acquiring"]),
    ("Asset Recovery", ["asset recovery"]), ("Airdrop", ["airdrop", "distribution"]), ("Send", ["send"]), ("Receive", ["receive"]),
]

# issuer -> keywords (0.15 each), account patterns (0.25 each), structure hints (0.10 each)
ISSUERS = {
    "kaspi": (["kaspi", "каспи", "kaspi.kz", "kaspi gold", "kaspi bank", "АО «Kaspi Bank»", "Kaspi Pay", "KaspiPay", "Gold карта", "Kaspi Депозит"],
              [r"KZ\d{2}722C\d{12}", r"\*\d{4}"], ["Доступно на", "Пополнения", "Покупки", "Переводы", "Снятие наличных"]),
    "halyk": (["halyk", "халык", "halykbank", "народный банк", "АО «Народный Банк Казахстана»", "Halyk Bank", "homebank", "хоум банк",
               "Народный Банк Казахстана", "Справка о наличии счета"], [r"KZ\d{2}601\d{13}"],
              ["Выписка по счету", "Народный Банк", "Справка о наличии счета", "Описаниеоперации", "Приходввалютесчета"]),
    "sberbank": (["сбербанк", "sberbank", "сбер", "ПАО Сбербанк", "СберБанк Казахстан", "сбербанк онлайн"], [r"KZ\d{2}914\d{13}"],
                 ["Выписка по карте", "Операции по счету"]),
    "jusan": (["jusan", "джусан", "jusan bank", "АТФБанк", "First Heartland Jusan Bank"], [r"KZ\d{2}826\d{13}"], []),
    "forte": (["forte", "форте", "fortebank", "АО «ForteBank»"], [r"KZ\d{2}141\d{13}"], []),
    "binance": (["binance", "бинанс", "binance.com", "BNB", "USDT", "spot trading", "P2P", "криптовалюта"], [],
                ["Trading History", "Deposit/Withdraw", "Spot Order History"]),
    "freedom": (["freedom", "фридом", "freedom finance", "АО «Freedom Finance»", "tradernet"], [], ["Брокерский отчет", "Инвестиционный счет"]),
}
