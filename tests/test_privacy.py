"""Masking on a small hand-made book: names of any length, identifiers, unseen names, owners."""

import re

import pytest
from pyspark.sql import functions as F

from saldoscope.operators import privacy as PV

ROWS = [
    (1, "Для Салтыков-Щедрин М.", "Салтыков-Щедрин М."),
    (2, "Платёж Оспанова Айжан Болаткызы Нур Дана Зере за услуги", "ИП Оспанова Айжан Болаткызы Нур Дана Зере"),
    (3, "Перевод Ержан О. по договору", "ТОО Альфа +7 701 123 45 67"),
    (4, "Самому себе Иванов И., карта 4111 1111 1111 1111", "Иванов Иван"),
    (5, "ИИН 950101300123, счёт KZ86125KZT5004100100", "MAGNUM"),
    (6, "снова 4111-1111-1111-1111 и *1234", 'ИП "КОНДРАТОВА А.Н."'),
    (7, "Ержан О. вернул", "Ержан О."),
    (8, "Перевод Зауре К. повторно " + "x" * 200 + " Зауре К.", "KASPI"),
    (9, None, None),
    (9, "", ""),
]


@pytest.fixture(scope="module")
def masked(spark):
    txn = spark.createDataFrame([("A", *r) for r in ROWS], "account_id string, seq long, description string, counterparty string")
    account = spark.createDataFrame([("A", "Иванов Иван Иванович")], "account_id string, owner string")
    owners = PV.owner_variants(account)
    tags = PV.person_tags(txn, owners)
    return tags, owners, PV.mask_table(txn, tags, owners)


def test_owner_is_not_numbered(masked):
    tags = {r.person: r.tag for r in masked[0].collect()}
    assert tags == {"САЛТЫКОВ-ЩЕДРИН М.": "[PERSON_1]", "ОСПАНОВА АЙЖАН БОЛАТКЫЗЫ НУР ДАНА ЗЕРЕ": "[PERSON_2]", "КОНДРАТОВА А.Н.": "[PERSON_3]", "ЕРЖАН О.": "[PERSON_4]"}


def test_names_and_identifiers_are_masked(masked):
    got = {r.seq: (r.description_masked, r.counterparty_masked) for r in masked[2].rows.collect()}
    assert got[1] == ("Для [PERSON_1]", "[PERSON_1]")
    assert got[2] == ("Платёж [PERSON_2] за услуги", "ИП [PERSON_2]")
    assert got[3] == ("Перевод [PERSON_4] по договору", "ТОО Альфа [PHONE_1]")
    assert got[4] == ("Самому себе [CUSTOMER], карта [CARD_1]", "[CUSTOMER]")
    assert got[5] == ("ИИН [IIN_1], счёт [IBAN_1]", "MAGNUM")
    assert got[6] == ("снова [CARD_1] и [CARD_2]", "ИП [PERSON_3]")
    # a name that is no counterparty is counted on, with the blank behind it; nothing is cut off
    assert got[8][0] == "Перевод [PERSON_5]повторно " + "x" * 200 + " [PERSON_5]"
    assert got[9] == ("", "")


def test_no_leak_is_left(masked):
    _, owners, made = masked
    variants = F.array(*[F.lit(r.variant) for r in owners.collect()])
    text = F.concat_ws(" | ", "description_masked", "counterparty_masked")
    assert {r.l for r in made.rows.select(PV.leaks(text, variants).alias("l")).collect()} == {""}
    raw = F.concat_ws(" | ", "description", "counterparty")
    found = {k for r in made.rows.select(PV.leaks(raw, variants).alias("l")).collect() for k in r.l.split(",") if k}
    assert found == {"IIN", "IBAN", "CARD", "PHONE", "OWNER_NAME", "PERSON_NAME"}


def test_report_counts(masked):
    tags, _, made = masked
    r = PV.mask_report(tags, made.ids, made.customers).first()
    assert (r.customer_masked, r.counterparties_masked, r.iins_masked, r.ibans_masked, r.cards_masked, r.phones_masked, r.total_replacements) == (True, 5, 1, 1, 2, 1, 11)


def test_the_names_can_be_put_back(masked, spark):
    tags, _, made = masked
    account = spark.createDataFrame([("A", "Иванов Иван Иванович")], "account_id string, owner string")
    back = PV.unmask_text(made.rows.select("account_id", "seq", F.col("description_masked").alias("masked")), tags, made.ids, account)
    assert {r.seq: r.restored for r in back.collect()}[2] == ROWS[1][1]


def test_words_travel_without_their_text(spark):
    """A long text must not be copied for each of its words; texts of one number keep their own names."""
    long = "Перевод Зауре К. " + " ".join(f"слово{i}" for i in range(3000))
    texts = spark.createDataFrame([("A", 1, long, 0), ("A", 1, "Для Ержан О.", 0), (None, 2, "Для Ержан О.", 0), ("B", 3, "Для ЕРЖАН О.", 0), ("A", 4, "Ержанов О.", 0)],
                                  "account_id string, seq long, text string, field int")
    tags = spark.createDataFrame([("A", "ЕРЖАН О.", "Ержан О.", "[PERSON_1]"), ("A", "ЗАУРЕ К.", "Зауре К.", "[PERSON_2]")], "account_id string, person string, display string, tag string")
    owners = spark.createDataFrame([], "account_id string, variant string")
    d = PV._without_names(texts, tags, owners)
    plan = d._jdf.queryExecution().executedPlan().toString()
    kept = re.findall(r"Generate explode\(.*\), \[([^\]]*)\], (?:true|false), \[word#", plan)
    assert kept and not any("text#" in columns for columns in kept)
    got = {(r[0], r[1][:12]): r[2][:20] for r in d.select("account_id", "text", "named").collect()}
    assert got == {("A", long[:12]): long.replace("Зауре К.", "[PERSON_2]")[:20], ("A", "Для Ержан О."): "Для [PERSON_1]", (None, "Для Ержан О."): "Для Ержан О.",
                   ("B", "Для ЕРЖАН О."): "Для ЕРЖАН О.", ("A", "Ержанов О."): "Ержанов О."}


def test_names_are_read_once_and_only_for_accounts_with_texts(spark, monkeypatch):
    written, durable = [], PV.durable

    def watch(df, *by):
        out = durable(df, *by)
        written.append((set(out.columns), out))
        return out

    monkeypatch.setattr(PV, "durable", watch)
    names = ["Ержан О.", "ИП Зауре К.", "MAGNUM", "<|x|> Ержан  О.", None, ""]
    txn = spark.createDataFrame([(a, i, names[i % 6]) for a in "AB" for i in range(6, 300)] + [(None, 7, "Ержан О.")], "account_id string, seq long, counterparty string")
    owners = spark.createDataFrame([], "account_id string, variant string")
    tags = PV.person_tags(txn, owners)
    assert [out.count() for columns, out in written if "whole" in columns] == [3]  # spellings of people, not 589 rows
    first, second = ("ЕРЖАН О.", "Ержан О.", "[PERSON_1]"), ("ЗАУРЕ К.", "Зауре К.", "[PERSON_2]")
    assert {(r.account_id, r.person, r.display, r.tag) for r in tags.collect()} == {("A", *first), ("A", *second), ("B", *first), ("B", *second), (None, *first)}
    texts = spark.createDataFrame([("A", 1, "Для Ержан О. 4111 1111 1111 1111"), ("A", 2, "просто текст"), ("A", 3, "знак \x12 тут"), (None, 4, "Ержан О."), ("A", 5, None), ("C", 6, "ИИН 950101300123"), ("A", 7, "Для Ержан О.")],
                                  "account_id string, seq long, text string")
    made = PV.mask_text(texts, tags, owners)
    known = [out for columns, out in written if "first" in columns and "text" not in columns]
    assert len(known) == 1 and {r.account_id for r in known[0].collect()} == {"A"}
    finds = [columns for columns, out in written if "rest" in columns]
    assert len(finds) == 1 and "named" not in finds[0]
    assert {r.seq: r.masked for r in made.rows.collect()} == {1: "Для [PERSON_1] [CARD_1]", 2: "просто текст", 3: "знак   тут", 4: None, 5: None, 6: "ИИН [IIN_1]", 7: "Для [PERSON_1]"}


def test_a_find_always_has_the_sign_of_its_kind(spark):
    import random
    rng = random.Random(5)
    parts = ["KZ86125KZT5004100100", "4111 1111 1111 1111", "8 701 123 45 67", "Иванов И.", "4111", "*", " ", "-", "1111", "+7", "8", "(701)", "123", "45", "67", "950101300123", "Иванов", "Әлі", "И", ".", "ІҢ.", "\t", "x", "_"]
    texts = spark.createDataFrame([(" ".join(rng.choices(parts, k=6)) if i % 2 else "".join(rng.choices(parts, k=9)),) for i in range(4000)] + [(None,)], "text string")
    kinds = [kind for kind, _, _ in PV.PASSES]
    d = texts.withColumn("named", F.col("text"))
    rest, got = F.col("named"), PV._finds(d)
    plain = d
    for kind, pattern, mark in PV.PASSES:
        plain = plain.withColumn(kind, F.coalesce(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")))
        rest = F.regexp_replace(rest, pattern, mark)
    plain = plain.withColumn("rest", rest)
    rows = lambda x: sorted(map(str, x.select("text", "rest", *kinds).collect()))
    assert rows(got) == rows(plain)
    assert all(got.where(F.size(kind) > 0).count() > 20 for kind in kinds)
