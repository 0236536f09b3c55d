"""Matching of parsed rows to true ones, and metrics of a classifier, against plain loops."""

import random
from collections import Counter, defaultdict

import pytest

from saldoscope.operators import analytics as A


def plain_match(truth, parsed):
    norm = lambda s: " ".join((s or "").split()).lower()
    want, have = defaultdict(list), defaultdict(list)
    for day, amount, text in truth:
        want[(day, round(amount * 100))].append(norm(text))
    for day, amount, *parts in parsed:
        have[(day, round(amount * 100))].append(" ".join(norm(x) for x in parts if norm(x)))
    recovered = fully = 0
    for key, texts in want.items():
        left = sorted(have[key])
        recovered += min(len(texts), len(left))
        for t in sorted(texts):
            hit = next((x for x in left if t in x), None)
            if hit is not None:
                left.remove(hit)
                fully += 1
    return len(truth), len(parsed), recovered, fully, len(parsed) - recovered


@pytest.mark.parametrize("seed", range(3))
def test_truth_matching(spark, seed):
    rng = random.Random(seed)
    texts = ["a", "ab", "abc", "abcd", "bcd", "магнит", "магнит на углу", "угл", "", None, "  AB  c ", "xyz", "zzz"]
    truth = [(f"d{rng.randrange(3)}", rng.choice([1.0, 2.5]), rng.choice(texts)) for _ in range(60)]
    parsed = [(f"d{rng.randrange(3)}", rng.choice([1.0, 2.5, 2.504, 9.0]), rng.choice([*texts, "01.02 магнит на углу 2.50", "abcd xyz", "?"]), rng.choice(texts), None) for _ in range(60)]
    got = A.match_truth(spark.createDataFrame(truth, "day string, amount double, text string"), spark.createDataFrame(parsed, "day string, amount double, description string, counterparty string, merchant_name string")).first()
    assert (got.expected, got.parsed, got.recovered, got.fully_correct, got.spurious) == plain_match(truth, parsed)
    none = spark.createDataFrame([], "day string, amount double, description string")
    empty = A.match_truth(spark.createDataFrame(truth, "day string, amount double, text string"), none).first()
    assert (empty.expected, empty.parsed, empty.recovered, empty.fully_correct, empty.spurious) == (60, 0, 0, 0, 0)


def true_and_read(spark, rows=60, seed=5):
    rng = random.Random(seed)
    texts = ["a", "ab", "abc", "bcd", "договор № 1", "договор № 11", "договор № 112", "", None, "  AB  c "]
    truth = [(rng.choice(["d0", "d1", "d2", None]), rng.choice([1.0, 2.5, None]), rng.choice(texts)) for _ in range(rows)]
    parsed = [(rng.choice(["d0", "d1", None]), rng.choice([1.0, 2.504, None]), rng.choice([*texts, "01.02  договор № 112"])) for _ in range(rows)]
    return (truth, parsed), spark.createDataFrame(truth, "day string, amount double, text string"), spark.createDataFrame(parsed, "day string, amount double, description string")


def met_only(truth, parsed):
    """The plain count, where a row without a day or an amount meets none."""
    whole = [[r for r in rows if r[0] is not None and r[1] is not None] for rows in (truth, parsed)]
    _, _, recovered, fully, _ = plain_match(*whole)
    return len(truth), len(parsed), recovered, fully, len(parsed) - recovered


def test_few_texts_of_a_day_and_amount_are_not_cut_into_pieces(spark, monkeypatch):
    rows, truth, parsed = true_and_read(spark)

    def cut(*_):
        raise AssertionError("texts were cut into pieces")

    monkeypatch.setattr(A, "_carried", cut)
    got = A.match_truth(truth, parsed).first()
    assert (got.expected, got.parsed, got.recovered, got.fully_correct, got.spurious) == met_only(*rows)


@pytest.mark.parametrize("few", [0, 40])
def test_crowded_days_and_amounts_match_alike(spark, monkeypatch, few):
    rows, truth, parsed = true_and_read(spark, 150)
    monkeypatch.setattr(A, "FEW_PAIRS", few, raising=False)
    got = A.match_truth(truth, parsed).first()
    assert (got.expected, got.parsed, got.recovered, got.fully_correct, got.spurious) == met_only(*rows)


def test_macro_f1_and_groups(spark):
    rows = [("p", "p", "easy"), ("p", "m", "hard"), ("m", "m", "easy"), ("b", "m", None), ("b", "x", "hard")]
    frame = spark.createDataFrame(rows, "expected string, predicted string, group string")
    f1 = []
    for label in sorted({x for r in rows for x in r[:2]}):
        tp, sup, pred = sum(e == p == label for e, p, _ in rows), sum(e == label for e, _, _ in rows), sum(p == label for _, p, _ in rows)
        f1.append(2 * tp / (sup + pred) if sup + pred else 0.0)
    got = A.overall_metrics(frame).first()
    assert (got.cases, got.correct, got.accuracy) == (5, 2, 40.0) and got.macro_f1 == pytest.approx(sum(f1) / len(f1), abs=1e-6)
    groups = Counter(g or "—" for _, _, g in rows)
    assert {r["group"]: (r.correct, r.cases) for r in A.group_accuracy(frame).collect()} == {g: (sum(e == p for e, p, h in rows if (h or "—") == g), n) for g, n in groups.items()}
