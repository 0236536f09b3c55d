"""Column functions over counterparty names."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import names as N
from ..operators import base as B

# explicit Unicode word edges: the meaning of \b differs between Java versions
_L, _R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _c(name) -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(name) -> Column:
    """Latin, lower case, underscores; ``unknown`` when nothing is left."""
    c = F.translate(squeeze(_c(name)), N.TRANSLIT_FROM, N.TRANSLIT_TO)
    c = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), N.TRANSLIT_PAIRS.items(), c)
    c = F.translate(c, N.ACCENTS_FROM, N.ACCENTS_TO)
    c = F.lower(F.trim(F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")))
    c = F.regexp_replace(c, r"\s+", "_")
    return F.when(c == "", F.lit("unknown")).otherwise(c)


def is_organization(name) -> Column:
    c = _c(name)
    up = F.upper(c)
    marked = up.rlike(f"{_L}(?:{'|'.join(N.ORG_MARKERS)}){_R}")
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    n = F.size(words)
    capital = F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    full_name = n.between(2, 4) & capital & ~B.has_any(up, N.ORG_MARKERS) & ~c.rlike("[0-9]")
    initial = c.rlike(_L + r"[А-ЯA-Z]\.\s*$")
    return F.when(c == "", False).when(marked | B.has_any(up, N.ORG_BRANDS), True).when(initial | full_name, False).otherwise(True)


def subject_identifier(name, account=None, is_owner=None) -> Column:
    kind = F.when(is_organization(name), "organization").otherwise("individual")
    out = F.concat_ws("_", normalize_name(name), kind)
    if account is None:
        return out
    return F.when(is_owner & (_c(account) != ""), F.regexp_replace(F.upper(_c(account)), r"\s+", "")).otherwise(out)


def identifier_kind(ident) -> Column:
    c = _c(ident)
    return F.when(c.rlike("^[A-Z]{2}[0-9A-Z]+$"), "account_owner").when(c.endswith("_individual"), "individual").otherwise("organization")


def identifier_name(ident) -> Column:
    c = _c(ident)
    return F.when(identifier_kind(c) == "account_owner", c).otherwise(F.regexp_replace(c, "_(individual|organization)$", ""))


def display_name(ident, original=None) -> Column:
    kind, name = identifier_kind(ident), identifier_name(ident)
    shown = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    out = (F.when(kind == "account_owner", F.concat(F.lit("Владелец счета "), name))
           .when(kind == "individual", F.concat(shown, F.lit(" (физ. лицо)"))).otherwise(F.concat(shown, F.lit(" (организация)"))))
    return out if original is None else F.coalesce(B.blank_to_null(original), out)


def subject_type(name) -> Column:
    """Type of a stored subject; differs from ``is_organization`` on purpose."""
    c = _c(name)
    legal = F.upper(c).rlike(f"{_L}(?:{'|'.join(N.SUBJECT_MARKERS)}){_R}")
    person = F.trim(c).rlike(r"^[А-ЯЁA-Z][а-яёa-z]+\s+[А-ЯЁA-Z]\.?$")
    few = c.contains(" ") & (F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) <= 4) & ~c.rlike(r"\d")
    return F.when(legal, "legal_entity").when(person | few, "individual").otherwise("legal_entity")


def unique_identifier(name) -> Column:
    c = F.regexp_replace(F.lower(squeeze(_c(name))), r"[^a-zA-Zа-яА-ЯёЁ0-9\s]", "")
    c = F.substring(F.regexp_replace(F.trim(c), r"\s+", "_"), 1, 150)
    return F.concat_ws("_", c, subject_type(name))


def legal_form(name) -> Column:
    """First token that names a legal form, in its Russian spelling."""
    forms = F.create_map(*[F.lit(x) for kv in N.LEGAL_FORMS.items() for x in kv])
    tokens = F.filter(F.split(F.upper(_c(name)), r'[\s"«»,.]+'), lambda w: w.isin(*N.LEGAL_FORMS))
    return forms[F.try_element_at(tokens, F.lit(1))]


def _packed(c: Column) -> Column:
    c = F.replace(F.lower(F.translate(c, "Əə", "Әә")), F.lit("ё"), F.lit("е"))
    return F.regexp_replace(c, "[^а-яёәғқңөұүіһa-z0-9]+", "")


def is_operation_description(name) -> Column:
    """The text describes an operation or a channel, not a party."""
    raw = F.trim(_c(name))
    packed = _packed(raw)
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(raw), "[^а-яёәғқңөұүіһa-z0-9]+", " "), F.lit(" "))
    as_word = B.has_any(spaced, [f" {m} " for m in N.LEGAL_FORM_MARKERS])
    glued = reduce(lambda a, b: a | b, [packed.startswith(m) & (F.length(packed) > len(m) + 2) for m in N.LEGAL_FORM_MARKERS])
    return (F.when(packed == "", False).when(B.has_any(packed, N.CHANNEL_MARKERS), True)
            .when(as_word | glued, False).otherwise(B.has_any(packed, N.OPERATION_MARKERS)))


SOLE_TRADER = r"(?i)^(ИП|ЖК|И\.П\.|IP)\s*[.\-—:]?\s*(.+)$"


def is_sole_trader(name) -> Column:
    return F.trim(_c(name)).rlike("(?u)" + SOLE_TRADER)


def is_sole_trader_person(name) -> Column:
    rest = F.trim(F.regexp_extract(F.trim(_c(name)), "(?u)" + SOLE_TRADER, 2))
    return is_sole_trader(name) & rest.rlike(rf'^["«\']?\s*[{N.CYR}]')


def classify_rule(name) -> Column:
    """Struct of kind, merchant name and type, confidence, source."""
    c = F.trim(_c(name))
    none = F.lit(None).cast("string")

    def out(kind, merchant, form, conf, source="rule"):
        return F.struct(F.lit(kind).alias("kind"), merchant.alias("merchant_name"), form.alias("merchant_type"), F.lit(conf).alias("confidence"), F.lit(source).alias("source"))

    initials = c.rlike(rf"^[{N.CYR}]{{2,}}\s+[{N.CYR}]\.(?:\s*[{N.CYR}]\.)?$")
    full = c.rlike(rf"^[{N.CYR}]{{2,}}(?:\s+[{N.CYR}]{{2,}}){{1,2}}$")
    return (F.when(c == "", out("unknown", none, none, 0.0))
            .when(c.rlike(r"^\[(?:PERSON|CUSTOMER)(?:[_-]\d+)?\]$"), out("person", none, none, 1.0, "anonymizer"))
            .when(c.rlike(r"^\[[A-Z]+(?:[_-]\d+)?\]$"), out("unknown", none, none, 0.0, "anonymizer"))
            .when(is_sole_trader_person(c), out("person", none, F.lit("ИП"), 0.6))
            .when(legal_form(c).isNotNull() | is_organization(c), out("merchant", c, legal_form(c), 0.5))
            .when(initials | full, out("person", none, none, 0.5))
            .otherwise(out("unknown", none, none, 0.0)))
