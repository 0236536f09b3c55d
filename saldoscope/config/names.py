"""Fixed values for name handling: letters, legal forms, brands, operation words."""

# single letters by position; digraphs separately
TRANSLIT_FROM = "абвгдеёзийклмнопрстуфхыэАБВГДЕЁЗИЙКЛМНОПРСТУФХЫЭӘҒҚҢӨҰҮҺІәғқңөұүһі"
TRANSLIT_TO = "abvgdeeziyklmnoprstufhyeABVGDEEZIYKLMNOPRSTUFHYEAGQNOUUHIagqnouuhi"
TRANSLIT_PAIRS = {
    "ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya",
    "Ж": "Zh", "Ц": "Ts", "Ч": "Ch", "Ш": "Sh", "Щ": "Shch", "Ъ": "", "Ь": "", "Ю": "Yu", "Я": "Ya",
}
ACCENTS_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
ACCENTS_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

ORG_MARKERS = [
    "ТОО", "АО", "ООО", "ЗАО", "ПАО", "НАО", "ОАО", "ИП", "ЧП", "КХ", "ГП", "МП", "УП",
    "LLC", "LTD", "INC", "CORP", "CO", "CORPORATION", "LIMITED", "COMPANY", "JSC", "OJSC",
    "CJSC", "GMBH", "AG", "SA", "BV", "NV", "SPA", "SRL", "ЖШС", "АҚ", "ҚҚ",
]
ORG_BRANDS = [
    "YANDEX", "KASPI", "HALYK", "FORTE", "EURASIAN", "BANK", "БАНК", "МАРКЕТ", "MARKET",
    "SERVICE", "СЕРВИС", "GROUP", "ГРУППА",
]
SUBJECT_MARKERS = ["ТОО", "АО", "ОАО", "ЗАО", "ПАО", "НАО", "ИП", "ООО", "LLC", "LTD", "INC", "CORP"]
LEGAL_FORMS = {
    "ТОО": "ТОО", "АО": "АО", "ИП": "ИП", "ЖШС": "ТОО", "АҚ": "АО", "ЖК": "ИП", "ПК": "ПК", "КХ": "КХ",
    "ОФ": "ОФ", "РГП": "РГП", "ГУ": "ГУ", "КГП": "КГП", "LLP": "ТОО", "LLC": "ТОО",
}
CYR = "А-ЯЁӘҒҚҢӨҰҮІҺа-яёәғқңөұүіһƏə"
OPERATION_MARKERS = [
    "комисси", "commission", "transactionfee", "withdrawfee", "servicefee", "regularcharge",
    "feeforcard", "feeisincluded", "перевод", "transfer", "аударым", "аудару", "аударғаны",
    "картағааударым", "зачислен", "replenish", "толықтыру", "конверт", "convert",
    "обменвалют", "аппаратсамообслуживания", "банкомат", "терминалсамообслуживания",
    "betweenspot", "betweenmain", "betweenum", "fundingwallet", "futuresaccount",
    "withdrawfeeisincluded", "binanceconvert", "жалақы",
]
CHANNEL_MARKERS = [
    "скарты", "скартыдругого", "fromcard", "ofotherbank", "otherbanks", "картасынан",
    "басқабанк", "другогобанка", "накартудр", "anothercard",
]
LEGAL_FORM_MARKERS = [
    "тоо", "ао", "жшс", "ақ", "ип", "жк", "llp", "llc", "ltd", "товарищество",
    "акционерное", "филиал", "банк", "bank",
]
CASE_CONTACT_REGEX = "([А-ЯЁӘҒҚҢӨҰҮІҺəƏA-Z][а-яёәғқңөұүіһəƏa-z]+\\s+[А-ЯЁӘҒҚҢӨҰҮІҺəƏA-Z]\\.?)"
