"""Bulk de-identification of a transaction table."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import language as L
from ..config import names as NM
from ..functions import names as N
from ..session import durable
from . import base as B
from .base import KEY

CUSTOMER = "[CUSTOMER]"
SEQ_SLICE = 1 << 20


def strip_markup(c, limit: int | None = L.MAX_NAME):
    """No control markup of chat templates, one line, at most ``limit`` characters.

    The limit is for single values that go into a prompt; whole tables pass None.
    """
    out = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), L.CONTROL_MARKUP, " "), r"\s+", " "))
    if limit is None:
        return out
    return F.when(F.length(out) > limit, F.concat(F.rtrim(F.substring(out, 1, limit)), F.lit("…"))).otherwise(out)


def is_person(c):
    name = F.trim(F.coalesce(c, F.lit("")))
    initial = name.rlike(rf"^[{NM.CYR}]{{2,}}\s+[{NM.CYR}]\.?$")
    return (name != "") & (initial | ~N.is_organization(name))


def trader_name(c):
    """Bare name behind the sole-trader prefix, null when it is a brand or no trader."""
    rest = F.trim(F.regexp_extract(F.trim(c), "(?u)" + N.SOLE_TRADER, 2))
    return F.when(N.is_sole_trader_person(c), F.regexp_replace(rest, r'^["«»\'“” ]+|["«»\'“” ]+$', ""))


def person_tags(txn: DataFrame, owners: DataFrame) -> DataFrame:
    """People of an account numbered by first appearance; the first spelling is kept.

    The owner of the account has a tag of their own and gets no number. Numbers are running
    totals along the row order, taken slice by slice, so an account with very many people is
    not numbered in one task. Every distinct spelling is read once, not every row.
    """
    spelled = B.read_once(txn.select("counterparty").distinct(), raw=strip_markup(F.col("counterparty"), None))
    spelled = B.read_once(spelled, trader=trader_name(F.col("raw")))
    name = F.when(F.col("trader").isNotNull(), F.col("trader")).when(is_person(F.col("raw")), F.trim("raw"))
    spelled = B.read_once(spelled, name=name).filter("name is not null and name <> ''")
    spelled = durable(spelled.select("counterparty", "name", F.upper("raw").alias("whole")))
    own = owners.select(KEY, F.upper("variant").alias("whole")).distinct()
    d = txn.groupBy(KEY, "counterparty").agg(F.min("seq").alias("seq")).join(spelled, "counterparty").join(own, [KEY, "whole"], "left_anti")
    # the numbering reads it twice
    d = durable(d.groupBy(KEY, F.upper("name").alias("person")).agg(F.min("seq").alias("first_seq"), F.min_by("name", "seq").alias("display")))
    d = B.sliced_cumsum(d, [KEY], "first_seq", ["first_seq", "person"], {"k": F.lit(1)}, SEQ_SLICE)
    return d.select(KEY, "person", "display", F.concat(F.lit("[PERSON_"), F.col("k").cast("string"), F.lit("]")).alias("tag"))


def owner_variants(account: DataFrame) -> DataFrame:
    """Spellings of the owner's name, longest first."""
    p = F.filter(F.split(F.col("owner"), r"\s+"), lambda w: F.length(w) > 1)
    a, b, c = (F.try_element_at(F.col("_p"), F.lit(i)) for i in (1, 2, 3))
    d = account.filter("owner <> ''").select(KEY, "owner").distinct().withColumn("_p", p)
    first = lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))
    sp = lambda *xs: F.concat_ws(" ", *xs)
    two = F.when(F.size("_p") >= 2, F.array(sp(a, b), sp(a, first(b)), sp(b, first(a)))).otherwise(F.array().cast("array<string>"))
    three = F.when(F.size("_p") >= 3, F.array(sp(a, b, c))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.array("owner"), two, three, F.filter("_p", lambda w: F.length(w) >= 4)))
    d = d.select(KEY, F.explode(F.filter(every, lambda v: F.length(v) >= 4)).alias("variant"))
    return d.withColumn("length", F.length("variant"))


def _counterparties(txn: DataFrame, tags: DataFrame, owners: DataFrame) -> DataFrame:
    """``txn`` with the cleaned counterparty (_raw), its mask where it is owner or person
    (_who), and else the organisation's name (_org)."""
    own = owners.select(KEY, F.upper("variant").alias("_u"), F.lit(True).alias("_own")).distinct()
    t = tags.select(KEY, F.col("person").alias("_p"), "tag")
    d = txn.withColumn("_raw", strip_markup(F.col("counterparty"), None))
    d = d.withColumn("_trader", trader_name(F.col("_raw"))).withColumn("_u", F.upper("_raw"))
    d = d.withColumn("_p", F.upper(F.coalesce("_trader", F.when(is_person(F.col("_raw")), F.trim("_raw")))))
    d = d.join(own, [KEY, "_u"], "left").join(t, [KEY, "_p"], "left")
    form = F.upper(F.regexp_extract("_raw", "(?u)" + N.SOLE_TRADER, 1))
    form = F.when(form.isin("И.П.", "IP"), "ИП").otherwise(form)
    who = (F.when(F.col("_raw") == "", "").when(F.col("_own"), CUSTOMER).when(F.col("_trader").isNotNull(), F.concat_ws(" ", form, F.col("tag")))
           .when(F.col("tag").isNotNull(), F.col("tag")))
    d = d.withColumn("_who", who).withColumn("_org", F.when(F.col("_who").isNull(), F.col("_raw")))
    return d.drop("_trader", "_u", "_p", "_own", "tag")


def mask_counterparty(txn: DataFrame, tags: DataFrame, owners: DataFrame) -> DataFrame:
    """Owner, sole trader, person; an organisation's name stays, cleaned of personal data."""
    return mask_table(txn.withColumn("description", F.lit("")), tags, owners).rows.drop("description_masked")


KINDS = [("IBAN", L.IBAN), ("CARD", L.CARD), ("PHONE", L.PHONE), ("IIN", L.IIN)]
PERSON_IN_TEXT = rf"[{NM.CYR}]{{2,}}\s+[{NM.CYR}]\.\s*(?:[{NM.CYR}]\.)?"
#: Kinds in the order they are looked for, and a sign that stands for a find meanwhile.
PASSES = [(kind, pattern, chr(0x11 + i)) for i, (kind, pattern) in enumerate([*KINDS, ("PERSON", PERSON_IN_TEXT)])]
#: Part of what every find of a kind holds, without looks behind: a text that lacks it needs no pass.
SIGNS = {"IBAN": r"[A-Z]{2}\d{2}[A-Z0-9]{11}", "CARD": r"\d{4}[\s*-]{0,3}\d{4}|\*\d{4}", "PHONE": r"[78][\s-]?\(?\d{3}\)?[\s-]?\d{3}", "IIN": r"\d{12}", "PERSON": r"[^\x00-\x7F]\s+[^\x00-\x7F]\."}
WORD = r"[\p{L}\p{N}_]+"
#: Accounts of texts up to which names of other accounts are left out beforehand.
FEW_ACCOUNTS = 100_000


def literal(c):
    """Pattern of a name as it stands, in any case, not inside a longer word."""
    quoted = F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), quoted, F.lit(r"\E(?![\p{L}\p{N}_])"))


def _folded(c):
    """Text in which letters that a pattern takes for equal in any case are the same."""
    return F.translate(F.lower(F.upper(c)), "ς", "σ")


def _of_accounts(names: DataFrame, texts: DataFrame) -> DataFrame:
    """The names of accounts that have texts; where these are few, others leave before words are formed."""
    accounts = durable(texts.select(KEY).distinct())
    if accounts.count() > FEW_ACCOUNTS:
        return names
    return durable(names.join(F.broadcast(accounts), KEY, "left_semi"))


def _without_names(texts: DataFrame, tags: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct texts of each account (first_seq, first_field), with names replaced (named).

    A name is looked up by its first word and then compared as a whole, so names may have any
    number of words, hyphens and dots; owners come first, longer names before shorter ones.
    """
    d = texts.groupBy(KEY, "text").agg(F.min(F.struct("seq", "field")).alias("f")).select(KEY, "text", F.col("f.seq").alias("seq"), F.col("f.field").alias("field"))
    names = owners.select(KEY, F.upper("variant").alias("name"), F.lit(CUSTOMER).alias("tag"), F.lit(1).alias("first"))
    names = names.unionByName(tags.select(KEY, F.col("person").alias("name"), "tag", F.lit(0).alias("first")))
    names = _of_accounts(names, texts).withColumn("word", F.regexp_extract("name", WORD, 0)).where("word <> ''")
    # words travel with a number of their text; texts that share one meet each other's names and refuse them
    d = d.withColumn("_h", F.xxhash64("text"))
    seen = d.select(KEY, "_h", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(WORD), F.lit(0)))).alias("word"))
    hits = seen.join(names, [KEY, "word"]).select(KEY, "_h", "first", "name", "tag")
    met = d.join(hits, [KEY, "_h"], "left")
    # a quick look spares most patterns
    there = F.contains(_folded("text"), _folded("name")) & F.rlike("text", literal(F.col("name")))
    told = F.when(F.col("name").isNotNull() & there, F.struct("first", F.length("name").alias("len"), "name", "tag"))
    d = met.groupBy(KEY, "_h", "text").agg(F.first("seq").alias("seq"), F.first("field").alias("field"), F.collect_set(told).alias("names")).drop("_h")
    d = d.withColumn("names", F.when(F.size("names") > 0, F.sort_array("names", asc=False)))
    marks = "".join(mark for _, _, mark in PASSES)
    blank = F.when(F.rlike("text", F.lit(f"[{marks}]")), F.translate("text", marks, " " * len(PASSES))).otherwise(F.col("text"))
    return d.withColumn("named", F.when(F.col("names").isNull(), blank).otherwise(F.aggregate("names", blank, lambda t, x: F.regexp_replace(t, literal(x["name"]), x["tag"]))))


def _finds(named: DataFrame) -> DataFrame:
    """``named`` with ``rest`` (finds replaced by the sign of their kind) and the finds by kind.

    The passes go one after the other, so a find never takes part of an earlier one.
    """
    d = named.withColumn("rest", F.col("named"))
    for kind, pattern, mark in PASSES:
        d = d.withColumn("_sign", F.rlike("rest", F.lit(SIGNS[kind])))
        d = d.withColumn(kind, F.when(F.col("_sign"), F.regexp_extract_all("rest", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        d = d.withColumn("rest", F.when(F.size(kind) > 0, F.regexp_replace("rest", pattern, mark)).otherwise(F.col("rest")))
    return d.drop("_sign")


def _numbered(found: DataFrame, tags: DataFrame) -> DataFrame:
    """Tag per account, kind and value, numbered by first appearance; people that are known
    by name keep their tag, others are counted on."""
    # written, since it is read three times and the texts behind it should be worked on once
    g = durable(found.groupBy(KEY, "kind", "id").agg(F.min(F.struct("seq", "field", "i", "found")).alias("f")).select(KEY, "kind", "id", "f.*"))
    known = tags.select(KEY, F.lit("PERSON").alias("kind"), F.col("person").alias("id"), F.col("tag").alias("given"))
    g = g.join(known, [KEY, "kind", "id"], "left")
    people = tags.groupBy(KEY).agg(F.count("*").alias("people"))
    new = B.sliced_cumsum(g.where("given is null"), [KEY, "kind"], "seq", ["seq", "field", "i"], {"k": F.lit(1)}, SEQ_SLICE).join(people, KEY, "left")
    k = F.col("k") + F.when(F.col("kind") == "PERSON", F.coalesce("people", F.lit(0))).otherwise(0)
    new = new.select(KEY, "kind", "id", F.col("found").alias("display"), F.concat(F.lit("["), F.col("kind"), F.lit("_"), k.cast("string"), F.lit("]")).alias("tag"), F.lit(True).alias("new"))
    return new.unionByName(g.where("given is not null").select(KEY, "kind", "id", F.col("found").alias("display"), F.col("given").alias("tag"), F.lit(False).alias("new")))


def _found(finds: DataFrame) -> DataFrame:
    def told(kind):
        return F.transform(kind, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), v.alias("found")))

    each = [told(kind) for kind, _, _ in PASSES]
    d = finds.select(KEY, "text", "seq", "field", F.explode(F.concat(*each)).alias("x")).select(KEY, "text", "seq", "field", "x.*")
    return d.withColumn("id", F.upper(F.when(F.col("kind") == "PERSON", F.trim(F.regexp_replace("found", r"\s+", " "))).otherwise(F.regexp_replace("found", r"[\s*-]", ""))))


def identifier_tags(texts: DataFrame, tags: DataFrame, owners: DataFrame) -> DataFrame:
    """Tag per account, kind (IBAN, CARD, PHONE, IIN, and PERSON for names that stand in texts
    only) and value."""
    return _numbered(_found(_finds(_without_names(_fielded(texts), tags, owners))), tags).where("new").drop("new")


def _fielded(texts: DataFrame) -> DataFrame:
    return texts if "field" in texts.columns else texts.withColumn("field", F.lit(0))


class Masked(NamedTuple):
    """Masked rows and the tags given out: ``ids`` has those of identifiers and late names,
    ``customers`` the accounts whose owner was masked."""

    rows: DataFrame
    ids: DataFrame
    customers: DataFrame


def mask_text(texts: DataFrame, tags: DataFrame, owners: DataFrame) -> Masked:
    """Owner, registered names, identifiers, and names met for the first time, as tags.

    Every distinct text of an account is worked on once.
    """
    finds = durable(_finds(_without_names(_fielded(texts), tags, owners)).drop("named"))
    any_find = F.greatest(*[F.size(kind) for kind, _, _ in PASSES]) > 0
    busy = finds.where(any_find)
    found = _found(busy)
    ids = durable(_numbered(found, tags))
    told = found.join(ids, [KEY, "kind", "id"]).groupBy(KEY, "text").agg(F.sort_array(F.collect_list(F.struct("kind", "i", "tag"))).alias("told"))
    d = busy.join(told, [KEY, "text"], "left")
    def tags_of(kind):
        return F.transform(F.filter("told", lambda x: x["kind"] == kind), lambda x: x["tag"])

    out = F.col("rest")
    for kind, _, mark in PASSES:
        given = tags_of(kind)
        out = F.when(F.size(kind) == 0, out).otherwise(F.array_join(F.zip_with(F.split(out, mark, -1), given, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    # texts without a find are done, and those that stay as they are need not travel back to their rows
    done = d.select(KEY, "text", out.alias("masked")).unionByName(finds.where(~any_find & (F.col("rest") != F.col("text"))).select(KEY, "text", F.col("rest").alias("masked")))
    customers = finds.where(F.exists("names", lambda x: x["first"] == 1)).select(KEY).distinct()
    rows = texts.join(done.withColumn("_changed", F.lit(True)), [KEY, "text"], "left")
    rows = rows.withColumn("masked", F.when(F.col("_changed"), F.col("masked")).when(F.col(KEY).isNotNull(), F.col("text"))).drop("_changed")
    return Masked(rows, ids.where("new").drop("new"), customers)


def mask_table(txn: DataFrame, tags: DataFrame, owners: DataFrame) -> Masked:
    """``txn`` with description_masked and counterparty_masked."""
    d = _counterparties(txn, tags, owners).withColumn("_text", strip_markup(F.col("description"), None))
    texts = d.select(KEY, "seq", F.explode(F.array(F.struct(F.lit(0).alias("field"), F.col("_text").alias("text")), F.struct(F.lit(1).alias("field"), F.col("_org").alias("text")))).alias("x"))
    texts = texts.select(KEY, "seq", "x.field", "x.text").where("text is not null and text <> ''")
    made = mask_text(texts, tags, owners)
    masked = durable(made.rows.select(KEY, "text", "masked").distinct())
    d = d.join(masked.select(KEY, F.col("text").alias("_text"), F.col("masked").alias("_d")), [KEY, "_text"], "left")
    d = d.join(masked.select(KEY, F.col("text").alias("_org"), F.col("masked").alias("_o")), [KEY, "_org"], "left")
    own = d.where(F.col("_who") == CUSTOMER).select(KEY).distinct()
    out = d.withColumn("description_masked", F.coalesce("_d", F.lit(""))).withColumn("counterparty_masked", F.coalesce("_who", "_o", F.lit("")))
    return Masked(out.drop("_raw", "_who", "_org", "_text", "_d", "_o"), made.ids, made.customers.union(own).distinct())


def unmask_text(masked: DataFrame, tags: DataFrame, ids: DataFrame, account: DataFrame) -> DataFrame:
    """Put the original spellings back; unknown tags stay."""
    t = tags.select(KEY, "tag", "display").unionByName(ids.select(KEY, "tag", "display")).unionByName(
        account.select(KEY, F.lit(CUSTOMER).alias("tag"), F.col("owner").alias("display")).distinct())
    seen = masked.select(KEY, "seq", F.explode(F.array_distinct(F.regexp_extract_all("masked", F.lit(r"(\[[A-Z]+(?:_\d+)?\])"), 1))).alias("tag")).join(t, [KEY, "tag"])
    back = seen.groupBy(KEY, "seq").agg(F.collect_set(F.struct("tag", "display")).alias("back"))
    d = masked.join(back, [KEY, "seq"], "left")
    out = F.when(F.col("back").isNull(), F.col("masked")).otherwise(F.aggregate("back", F.col("masked"), lambda s, x: F.replace(s, x["tag"], x["display"])))
    return d.withColumn("restored", out).drop("back")


def leaks(c, variants=None):
    """Classes of identifiers still present in a text; ``variants``: spellings of the owner."""
    flags = [F.when(c.rlike(p), F.lit(k)) for k, p in (("IIN", L.IIN), ("IBAN", L.IBAN), ("CARD", L.CARD), ("PHONE", L.PHONE))]
    if variants is not None:
        flags.append(F.when(F.exists(variants, lambda v: F.rlike(c, literal(v))), F.lit("OWNER_NAME")))
    name = F.when(c.rlike(rf"(?<![\p{{L}}\p{{N}}_])[{NM.CYR}]{{2,}}\s+[{NM.CYR}]\."), F.lit("PERSON_NAME"))
    return F.array_join(F.filter(F.array(*flags, name), lambda x: x.isNotNull()), ",")


def mask_report(tags: DataFrame, ids: DataFrame, customers: DataFrame) -> DataFrame:
    """Per account: whether the owner was masked, masked values by class, and their total."""
    t = tags.select(KEY, F.lit("PERSON").alias("kind")).unionByName(ids.select(KEY, "kind")).unionByName(customers.select(KEY, F.lit("CUSTOMER").alias("kind")))
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return t.groupBy(KEY).agg(
        (of("CUSTOMER") > 0).alias("customer_masked"), of("PERSON").alias("counterparties_masked"), of("IIN").alias("iins_masked"), of("IBAN").alias("ibans_masked"),
        of("CARD").alias("cards_masked"), of("PHONE").alias("phones_masked"), F.count("*").alias("total_replacements"))
