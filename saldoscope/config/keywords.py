"""Keyword lists. Results depend on the exact words and, where the first
match wins, on their order."""

SALARY = ["ЗАРПЛАТА", "SALARY", "ОКЛАД", "ЗП", "ЖАЛАҚЫ"]
GOVERNMENT = [
    "ПЕНСИЯ", "ПОСОБИЕ", "БЮДЖЕТ", "EGOVPAYMENT", "МСЗН",
    "ЕНПФ", "ГЦВП", "ЗЕЙНЕТАҚЫ", "ЖӘРДЕМАҚЫ", "ENBEK",
]
CRYPTO = [
    "BINANCE", "BYBIT", "OKEX", "HUOBI", "KUCOIN", "MEXC", "GATE.IO", "COINBASE",
    "KRAKEN", "BITGET", "OKXBROKER", "BITMEX", "PHEMEX", "CRYPTO", "BITCOIN", "USDT",
]

# whitelist of everyday payments
UTILITY = [
    "АЛМАТЫЭНЕРГОСБЫТ", "ГОРГАЗ", "КАЗТЕЛЕКОМ", "KCELL", "ALTEL", "BEELINE", "TELE2",
    "КОММУНАЛ", "ЖКХ", "КСК", "SNABKAZ", "ASTANAGAS", "ENERGO", "SVЕТ", "ВОД", "КАНАЛ",
    "ТЕПЛОСЕТЬ", "ЖЫЛУ", "СУ", "ЭЛЕКТР",
]
MORTGAGE = [
    "ИПОТЕКА", "ЖИЛСТРОЙСБЕРБАНК", "ЖССБ", "MORTGAGE", "HALYK MORTGAGE",
    "HOME CREDIT MORTGAGE", "ТҰРҒЫН ҮЙ", "ЖИЛИЩНЫЙ КРЕДИТ", "БАСПАНА",
]
INSURANCE = [
    "СТРАХОВА", "INSURANCE", "NOMAD LIFE", "JUSAN LIFE", "ХАЛЫК СТРАХОВАНИЕ",
    "КАЗКОММЕРЦ LIFE", "СИГМА", "INTERTEACH", "САҚТАНДЫРУ",
]
TRANSPORT = [
    "AVTOBYS", "АВТОБУС", "METRO", "МЕТРО", "ТРАНСПОРТ", "UBER", "YANDEX TAXI",
    "INDRIVE", "BOLT",
]
MERCHANT = [
    "ТОО", "АО ", "ИП ", "ООО", "ЗАО", "ОАО", "BANK", "БАНК", "KASPI", "ХАЛЫК",
    "МАГНУМ", "MAGNUM", "SMALL", "GLOVO", "WOLT", "ТЕХНОДОМ", "SULPAK", "MECHTA",
    "МЕЧТА", "METRO", "SPAR", "WILDBERRIES", "OZON", "LAMODA", "ALIEXPRESS", "AMAZON",
    "GOOGLE", "APPLE", "SPOTIFY", "NETFLIX", "YOUTUBE", "UBER", "YANDEX", "INDRIVE",
    "BOLT", "PHARMACIE", "АПТЕКА", "PHARMA", "FREEDOM", "JUSAN",
]
MERCHANT_PREFIXES = ["ТОО ", "АО ", "ИП ", "ООО ", "ЗАО ", "ОАО "]
CASHFLOW_PAYEE = ["ТОО", "АО ", "ИП ", "ООО", "BANK", "БАНК", "KASPI"]

# merchant risk: groups in order, words in order
HIGH_RISK = {
    "gambling": [
        "1XBET", "MOSTBET", "MELBET", "FONBET", "PARIMATCH", "OLIMPBET", "BETBOOM",
        "PINNACLE", "CASINO", "POKER", "SLOTS", "ЛОТЕРЕЯ", "КАЗИНО", "СТАВКИ",
    ],
    "crypto": [
        "BINANCE", "BYBIT", "OKEX", "HUOBI", "KUCOIN", "MEXC", "GATE.IO", "COINBASE",
        "KRAKEN", "BITGET",
    ],
    "pawnshop": ["ЛОМБАРД", "PAWNSHOP", "ЗАЛОГ"],
    "money_transfer": [
        "WESTERN UNION", "CONTACT", "ЗОЛОТАЯ КОРОНА", "MONEY GRAM", "UNISTREAM",
    ],
}
MEDIUM_RISK = {
    "gaming": [
        "SENET", "CODASHOP", "STEAM", "EPIC GAMES", "XBOX", "PLAYSTATION", "NINTENDO",
        "RIOT", "BLIZZARD", "TOP GAME", "GOLD GAME",
    ],
    "adult": ["ONLYFANS", "18+"],
    "fast_loans": ["ЗАЙМ", "МИКРОКРЕДИТ", "БЫСТРЫЕ ДЕНЬГИ"],
}
SHELL_WORDS = [
    "КОНСАЛТ", "CONSULT", "CONSULTING", "GROUP", "ГРУП", "INVEST", "ИНВЕСТ", "TRADE",
    "ТРЕЙД", "TRADING", "ЛОГИСТИК", "LOGISTIC", "SOLUTIONS", "PREMIUM", "STANDARD",
    "IMPERIAL", "GLOBAL", "PRIME", "SILK ROAD", "GOLDEN", "CENTRAL ASIA", "EURASIA",
    "BUSINESS GROUP", "CAPITAL", "HOLDING", "ENTERPRISE",
]
LEGAL_PREFIXES = ["ТОО", "ИП ", "АО ", "ООО", "ЗАО"]

# per-detector exclusions
STRUCTURING_REGULAR = ["АРЕНДА", "ИПОТЕКА", "КРЕДИТ", "СТРАХОВ", "ЗАРПЛАТА", "ПЕНСИЯ"]
DUPLICATE_REGULAR = [
    "АРЕНДА", "ЗАРПЛАТА", "ЖКХ", "КОММУНАЛ", "СТРАХОВ", "ИПОТЕКА", "КРЕДИТ", "АБОНЕНТ",
]
AUTOPAY = ["КОММУНАЛ", "ЖКХ", "АВТОПЛАТЕЖ", "AUTO", "АБОНЕНТ", "ПОДПИСКА"]
ROUND_REGULAR = [
    "ДЕПОЗИТ", "DEPOSIT", "АРЕНДА", "RENT", "ИПОТЕКА", "MORTGAGE", "КРЕДИТ", "CREDIT",
    "СТРАХОВ", "INSURANCE", "ЖКХ", "КОММУНАЛ", "БАНКОМАТ", "ATM", "KASPI ДЕПОЗИТ",
]
PASS_THROUGH_MERCHANT = [
    "ТОО", "АО ", "ИП ", "ООО", "ЗАО", "ОАО", "BANK", "БАНК", "KASPI",
]
NOT_PEER_INCOME = [
    "ЗАРПЛАТА", "SALARY", "КЭШБЭК", "CASHBACK", "ПЕНСИЯ", "ПОСОБИЕ", "ДЕПОЗИТ",
]
NOT_A_PERSON = [
    "ТОО", "АО ", "ИП ", "ООО", "ГКП", "BANK", "БАНК", "KASPI", "HALYK", "МАГНУМ",
    "MAGNUM", "MARKET",
]

# descriptions
TEXT_CRITICAL = [
    "обнал", "обналичка", "обналичивание", "наличка", "кэш", "конверт", "откат",
    "взятка", "подкуп", "серая", "серую", "чёрная", "чёрную", "левая", "левую", "отмыв",
    "отмывание", "отмыть", "обход", "уход от налогов", "фиктивн", "подставн", "липов",
    "хавала", "hawala", "mixer", "миксер", "tumbler", "тумблер", "tornado",
    "laundering", "launder",
]
TEXT_MEDIUM = [
    "возврат предоплаты", "возврат аванса", "перерасчёт", "беспроцентный займ",
    "займ без процентов", "по устной", "устная договорённость", "материальная помощь",
    "благотворительн", "пожертвование", "donation", "инвестици", "invest",
    "криптовалют", "crypto", "bitcoin", "btc", "usdt", "p2p", "peer",
    "без назначения", "без комментари",
]
TEXT_INCOME_WORDS = ["зарплата", "salary", "пенсия", "пособие", "стипендия", "доход"]
TEXT_EXPENSE_WORDS = ["покупка", "оплата", "purchase", "payment", "расход"]
SERIAL_REGEX = r"(?:договор|счёт|счет|invoice|contract|№|#)\s*(\d{3,})"

# channel names that pose as an income source
GENERIC_SOURCES = [
    "с карты другого банка", "с карты", "пополнение", "перевод", "входящий перевод",
    "зачисление", "поступление", "пенсия", "пособие", "выплата пособия",
    "пенсия/пособие", "басқа банк картасынан", "басқа банктің картасынан", "толықтыру",
    "аударым", "түсім", "зейнетақы", "жәрдемақы", "зейнетақы/жәрдемақы",
    "from another bank", "from card of other banks", "top up", "topup",
    "incoming transfer", "deposit", "replenishment", "pension", "allowance",
    "pension/allowance",
]

# purchase categories in order: first category with a matching word wins
EXPENSE_CATEGORIES = [
    ("Транспорт", [
        "YANDEX.GO", "ЯНДЕКС.GO", "YANDEX.DELIVERY", "ЯНДЕКС.ДОСТАВКА", "YANDEX ВПЕРЁД",
        "ЯНДЕКС ВПЕРЁД", "Автобыс", "Парковка", "BOLT", "UBER", "INDRIVER", "Такси",
        "АЗС", "БЕНЗИН"]),
    ("Еда и продукты", [
        "Salem Duken", "Family", "Асхана", "Durum", "овощной", "Рахмет магазин",
        "Береке", "ARCADA", "Hello food", "Рассвет", "Мама Маркет", "маг жайлау",
        "Континенталь", "Био", "ЭконоМаркет", "МЕЧТА МАРКЕТ", "Манас", "Бегемот",
        "Big Ben", "магазин Нур", "Рахат минимаркет", "A7 market", "Magnum", "SMALL",
        "Продукты", "Овощи", "Фрукты", "Супермаркет", "Минимаркет", "Бакалея"]),
    ("Игры и развлечения", [
        "SENET", "CODASHOP", "Steam", "TOP GAME", "Gold Game", "Underground",
        "Меркурий", "SUPERCELL", "FS *SUPERCELL", "Xsolla", "Арена", "Чаплин",
        "Soul Tennis", "PlayStation", "XBOX", "Nintendo", "Epic Games", "Riot",
        "Blizzard", "Кинотеатр", "Боулинг", "Бильярд"]),
    ("Подписки и сервисы", [
        "APPLE.COM", "APPLE COM", "Spotify", "CLAUDE", "CLAUDE.AI", "YANDEX.PLUS",
        "ЯНДЕКС.ПЛЮС", "Altel", "Netflix", "YouTube", "OpenAI", "ChatGPT",
        "Amazon Prime", "iCloud", "Подписка"]),
    ("Шоппинг", [
        "Intertop", "Интертоп", "Qazaq Republic", "URBAN OUTFIT", "INTERSPORT",
        "GOLDAPPLE", "NOMADICA", "Arba.kz", "Jakx.kz", "Tshopkz", "MNM FUTURE",
        "BEATRICE", "Bambino", "МҰСТАФА", "Керуен", "R77", "ZARA", "H&M", "LC Waikiki",
        "Bershka"]),
    ("Доставка еды", [
        "YANDEX.EDA", "ЯНДЕКС.ЕДА", "WOLT", "Glovo", "Chocofood", "YANDEX.LAVKA",
        "ЯНДЕКС.ЛАВКА", "Delivery Club"]),
    ("Почта и доставка", ["Яна Пост", "Jana Post", "Казпочта", "СДЭК", "DHL", "FedEx"]),
    ("Здоровье", [
        "PHARMACY", "EUROPHARMA", "GalamatPharm", "Love Dent", "Nur Clinic",
        "Медицинский центр", "Аптека", "Стоматология", "Клиника", "Лаборатория",
        "Анализы"]),
    ("Связь и коммуналка", [
        "Живая Вода", "Коммунальн", "Электричество", "Газ", "Вода", "Интернет",
        "Beeline", "Kcell", "Tele2", "Activ"]),
    ("Онлайн-покупки", [
        "PINDUODUO", "FFT*PINDUODUO", "TVLAND", "verytrendyus", "КАСПИ МАГАЗИН",
        "Kaspi Магазин", "AliExpress", "Wildberries", "OZON", "ШМУЛЬКО"]),
    ("Рестораны", [
        "Restaurant", "Ресторан", "Doner", "BEER GOOD", "REZEPT", "Ranch Social",
        "Shashlych", "Janzeto", "Sardar", "SMALL", "Durum K27", "Кафе", "Бар", "Паб",
        "Столовая", "I'm Restaurants"]),
    ("Банковские услуги", ["Комиссия", "Обслуживание", "Перевыпуск", "Страховка карты"]),
    ("Страхование", ["ОСМС", "обязательное соц", "страхование", "ЕНПФ"]),
    ("Благотворительность", ["Фонд", "Благотворител", "Человек в маске", "Пожертвование"]),
]
TRANSFER_CATEGORIES = [
    ("Депозит", ["Kaspi Депозит", "На Kaspi Депозит", "С Kaspi Депозит"]),
    ("Межбанк", ["другого банка", "другой банк"]),
]
INCOME_CATEGORIES = [
    ("Пенсия/пособие", ["Пенсия", "пособие", "ГЦВП", "соцвыплат"]),
    ("С депозита", ["С Kaspi Депозит"]),
    ("Межбанк", ["С карты другого банка"]),
]
CONTACT_SKIP = ["Kaspi Депозит", "другого банка", "Пенсия", "пособие"]
CONTACT_REGEX = r"([А-ЯЁа-яёӘәҒғҚқҢңӨөҰұҮүІіҺһəƏ]+\s+[А-ЯЁа-яёƏə]\.?)"
ESSENTIAL = ["Здоровье", "Связь и коммуналка", "Страхование", "Еда и продукты"]
NON_ESSENTIAL = ["Игры и развлечения", "Шоппинг", "Рестораны", "Подписки и сервисы"]
MONTHS_RU = ["Янв", "Фев", "Мар", "Апр", "Май", "Июн", "Июл", "Авг", "Сен", "Окт", "Ноя", "Дек"]
WEEKDAYS_RU = ["Пн", "Вт", "Ср", "Чт", "Пт", "Сб", "Вс"]
# universal type -> label used on statements
STATEMENT_LABELS = {
    "income": "Пополнение", "expense": "Покупка", "transfer_in": "Перевод",
    "transfer_out": "Перевод", "withdrawal": "Снятие", "deposit": "Пополнение",
    "fee": "Разное", "refund": "Пополнение", "crypto_buy": "Покупка",
    "crypto_sell": "Пополнение", "other": "Разное",
}
