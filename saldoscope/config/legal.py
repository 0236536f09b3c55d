"""Fixed texts of reports: scheme titles, legal references, counter-arguments, advice."""

PATTERN_TITLES = {
    "money_laundering_layering": "Подозрение на отмывание денег — этап расслоения",
    "structuring": "Структурирование — дробление сумм ниже порога отчётности",
    "carding": "Признаки кардинга — тестирование карт",
    "pyramid_scheme": "Признаки участия в финансовой пирамиде",
    "human_trafficking_payments": "Систематические выплаты многим физическим лицам",
    "tax_evasion_cash": "Возможное уклонение от налогов — налично-кассовые операции",
}
PATTERN_REFERENCE = {
    "money_laundering_layering": "УК РК ст. 218 (легализация (отмывание) денег и (или) иного имущества, полученных преступным путём); ЗРК О ПОД/ФТ ст. 4, п. 1; FATF Recommendation 1",
    "structuring": "ЗРК О ПОД/ФТ ст. 11; FATF Recommendation 10",
    "carding": "УК РК ст. 232 (изготовление или сбыт поддельных платёжных карточек); ст. 190 (мошенничество); FATF R.15",
    "pyramid_scheme": "УК РК ст. 217 (создание и руководство финансовой (инвестиционной) пирамидой)",
    "human_trafficking_payments": "УК РК ст. 128 (торговля людьми); ЗРК О ПОД/ФТ ст. 4",
    "tax_evasion_cash": "НК РК ст. 321 (доходы, включаемые в годовой доход физического лица); ЗРК О ПОД/ФТ ст. 11 (обязательный финансовый мониторинг)",
}
PATTERN_COUNTER = {
    "money_laundering_layering": "групповой сбор средств (свадьба, лечение), возврат долгов нескольким людям.",
    "structuring": "Суммы могут случайно приближаться к порогу: ипотечный платёж, оплата крупной покупки, аренда.",
    "carding": "туристические мелкие покупки, тестирование нескольких сервисов, подписки в разных сервисах.",
    "pyramid_scheme": "краудфандинг, групповой сбор на подарок/лечение, возврат займа организатору поездки.",
    "human_trafficking_payments": "выплата фрилансерам, погашение нескольких личных займов, субаренда жилья.",
    "tax_evasion_cash": "продажа личного имущества (авто, недвижимость), займ от родственников, ранее накопленные наличные сбережения.",
}
# for business owners and freelancers
PATTERN_COUNTER_BUSINESS = {
    "money_laundering_layering": "выплата зарплат сотрудникам, расчёты с подрядчиками, возврат займов нескольким кредиторам, групповая покупка или инвестиция.",
}
COUNTER_EVIDENCE = {
    ("velocity", "business_owner"): "Высокая скорость транзакций норма для бизнеса",
    ("velocity", "trader"): "Трейдеры совершают множество операций в день",
    ("merchant_risk", "trader"): "Крипто-операции являются основным видом деятельности трейдера",
    ("cross_reference", "freelancer"): "Фрилансеры перечисляют полученные средства субподрядчикам",
    ("cross_reference", "business_owner"): "Перечисление поставщикам — стандартный бизнес cash-flow",
    ("graph", "business_owner"): "Бизнес по определению имеет много контрагентов",
    ("behavioral", "freelancer"): "Нерегулярный доход — характеристика фриланса",
    ("night_transactions", "business_owner"): "Бизнес часто проводит платежи в нерабочее время (автоматические списания)",
    ("night_transactions", "trader"): "Трейдеры торгуют 24/7, ночные операции нормальны",
    ("night_transactions", "student"): "Студенты часто активны в ночное время",
    ("duplicate_payments", "business_owner"): "Бизнес может делать регулярные одинаковые платежи (аренда, ЗП)",
    ("duplicate_payments", "trader"): "Повторные сделки одинакового объёма — стандарт для трейдинга",
    ("round_amounts", "business_owner"): "Бизнес-платежи часто бывают круглыми (аренда, закупки)",
    ("round_amounts", "trader"): "Крипто-операции часто совершаются круглыми суммами",
    ("profile_mismatch", "business_owner"): "Бизнес-аккаунты имеют гибкий профиль расходов",
    ("profile_mismatch", "freelancer"): "Фрилансеры могут получать нерегулярные крупные платежи от проектов",
}
ADVICE = [
    "Рекомендуется углублённая проверка (Enhanced Due Diligence)",
    "Проверить источники средств для игорной деятельности",
    "Проверить дробление операций на предмет обхода порогов",
    "Проверить транзитные операции — возможная схема отмывания",
    "Проверить ночные переводы — возможен несанкционированный доступ",
    "Проверить повторные платежи — возможное дублирование или обнал",
    "Проверить веерные переводы — признак массового вывода средств",
    "Обратить внимание на круглые суммы переводов — возможно обналичивание",
    "Проверить крупные операции, не соответствующие профилю клиента",
    "Запросить пояснения по нехарактерной активности аккаунта",
]
NO_FINDINGS = "Признаков значимых нарушений не обнаружено"
# reasons: fixed texts, the braces take the numbers in order
PATTERN_REASONS = {
    "money_laundering_layering": "Поступление {} ₸ перераспределено на {} получателей в течение 72 часов ({}% суммы). Всего исходящих транзакций: {}.",
    "structuring": "{} транзакций в диапазоне {}–{} ₸ (90–100% от порога отчётности {} ₸).",
    "carding": "{} мелких покупок в иностранной валюте у {} мерчантов за 2 часа.",
    "pyramid_scheme": "Поступления от {} физических лиц общей суммой {} ₸, затем крупный перевод {} ₸ одному получателю.",
    "human_trafficking_payments": "Регулярные выплаты {} разным физическим лицам, итого {} переводов на {} ₸.",
    "tax_evasion_cash": "Наличные поступления {} ₸ составляют {}% от прослеживаемого электронного дохода {} ₸.",
}
MODULE_REASONS = {
    "velocity": "Burst транзакций: {}",
    "structuring": "Дробление: {} групп",
    "merchant_risk": "Высокорисковых мерчантов: {}",
    "cross_reference": "Транзитных: {}",
    "night_transactions": "Ночных транзакций: {}, крупных: {}",
    "duplicate_payments": "Дублей: {}, сумма: {} KZT",
    "round_amounts": "Круглых: {} ({}%)",
    "profile_mismatch": "Несоответствий профилю: {}",
}
