"""Search that skips common terms and matching in order of time, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from saldoscope.config import language as L
from saldoscope.operators import flows, statutes


def plain_scores(articles, terms, code):
    """(code, number) -> score, by adding up every term."""
    docs = {(a["code"], a["number"]): Counter(a["title"].split() * 3 + a["title_kk"].split() * 3 + a["text"].split()) for a in articles}
    n, total = len(docs), sum(sum(c.values()) for c in docs.values())
    out = Counter()
    for t in set(terms):
        df = sum(t in c for c in docs.values())
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        for key, c in docs.items():
            if t in c and (code is None or key[0] == code):
                w = idf * c[t] * (L.BM25_K1 + 1) / (c[t] + L.BM25_K1 * (1 - L.BM25_B + L.BM25_B * sum(c.values()) / (total / n)))
                out[key] += w * L.DERIVED_PENALTY if "-" in key[1] else w
    return out


@pytest.mark.parametrize("with_code", [False, True])
def test_skipping_search_equals_adding_up_everything(spark, with_code):
    rng = random.Random(6)
    words = [f"zz{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    articles = [{"code": rng.choice("XY"), "number": f"{i}{'-1' if i % 9 == 0 else ''}", "title": " ".join(rng.choices(words, weights, k=rng.randint(0, 3))), "title_kk": "",
                 "text": " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))} for i in range(150)]
    articles += [dict(articles[3], number="900"), dict(articles[3], number="901")]
    asked = [(q, " ".join(rng.choices(words, weights, k=rng.randint(1, 9))), rng.choice("XYQ")) for q in range(40)] + [(99, "unknownword", "X"), (98, None, "X")]
    frame = spark.createDataFrame([tuple(a.values()) for a in articles], "code string, number string, title string, title_kk string, text string")
    queries = spark.createDataFrame(asked, "query_id long, query string, code string")
    got = {}
    for r in statutes.bm25(frame, queries if with_code else queries.drop("code"), 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.code, r.number, r.score))
    titles = {(a["code"], a["number"]): len(a["title"]) for a in articles}
    for q, text, code in asked:
        scores = plain_scores(articles, (text or "").split(), code if with_code else None)
        best = max(scores.values(), default=0)
        want = sorted(((-round(s / best, 6), "-" in key[1], titles[key], *key) for key, s in scores.items()))[:4]
        assert [(c, n) for _, c, n, _ in sorted(got.get(q, []))] == [(c, n) for *_, c, n in want], q
        assert [s for *_, s in sorted(got.get(q, []))] == pytest.approx([-w[0] for w in want], abs=2e-6)


def test_search_writes_no_pair_of_query_and_article(spark, monkeypatch):
    """All articles share the words of all queries: only the best of a block may travel, also where scores tie."""
    rng = random.Random(3)
    words = [f"zz{chr(97 + i)}" for i in range(8)]
    articles = [("X", str(i), "", "", " ".join(words + rng.choices(words, k=rng.randint(1, 30)))) for i in range(200)] + [("X", f"c{i}", "", "", " ".join(words * 3)) for i in range(100)]
    frame = spark.createDataFrame([*articles, (None, "n", "", "", "zza"), articles[7]], "code string, number string, title string, title_kk string, text string")
    asked = [(q, " ".join(rng.sample(words, 6))) for q in range(150)] + [(q, " ".join(words)) for q in range(150, 300)] + [(0, words[0]), (None, words[1])]
    written, durable = [], statutes.durable

    def watch(df, *by):
        out = durable(df, *by)
        written.append(out.count())
        return out

    monkeypatch.setattr(statutes, "durable", watch)
    monkeypatch.setattr(statutes, "BLOCK_POSTINGS", 900, raising=False)
    monkeypatch.setattr(statutes, "BLOCK_QUERIES", 100, raising=False)
    monkeypatch.setattr(statutes, "FEW_TERMS", 3, raising=False)
    got = {}
    for r in statutes.bm25(frame, spark.createDataFrame(asked, "query_id long, query string"), 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.code, r.number, r.score))
    assert max(written) < 300 * 301 / 4 and None not in got and len(got) == 300
    twice = [dict(zip(("code", "number", "title", "title_kk", "text"), a)) for a in articles]
    twice[7] = dict(twice[7], text=f"{twice[7]['text']} {twice[7]['text']}")  # rows of one article are one article
    n, total = 302, sum(len(a["text"].split()) for a in twice) + 1
    docs = {(a["code"], a["number"]): Counter(a["text"].split()) for a in twice}
    df = {t: sum(t in c for c in docs.values()) + (t == "zza") for t in words}
    for q in (0, 5, 200):
        ts = Counter(t for i, text in asked if i == q for t in set(text.split()))
        raw = {key: sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / (total / n))) for t, m in ts.items()) for key, c in docs.items()}
        best = max(raw.values())
        rows = [key for key in docs for _ in range(2 if key == ("X", "7") else 1)]
        want = sorted(rows, key=lambda key: (-round(raw[key] / best, 6), *key))[:4]
        assert [(c, m) for _, c, m, _ in sorted(got[q])] == want, q


def slow_match(pdf, window, tol):
    rows = pdf.sort_values(["t", "seq"])
    inc = [(t, s, a) for t, s, a in zip(rows["t"], rows["seq"], rows["amount"]) if a > 0]
    used, out = set(), []
    for t, s, a in zip(rows["t"], rows["seq"], rows["amount"]):
        for i, (t1, s1, a1) in enumerate(inc):
            if a < 0 and i not in used and t1 <= t <= t1 + window and 1 - tol <= -a / a1 <= 1 + tol:
                used.add(i)
                out.append((s1, s))
                break
    return out


def slice_of(seed, n, amounts):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"account_id": "A", "slice": 0, "t": rng.integers(0, flows.SLICE_US, n), "seq": np.arange(n), "amount": rng.choice(amounts, n) * rng.choice([-1.0, 1.0], n)})


@pytest.mark.parametrize("seed", range(6))
def test_matching_equals_a_plain_loop(seed):
    amounts = [np.array([100.0, 95, 105, 99.75, 95.0001, 94.99]), np.arange(1, 400) / 7, np.array([10.0])][seed % 3]
    pdf = slice_of(seed, 300, amounts)
    window = flows.SLICE_US // [2, 20][seed % 2]
    got = flows._match_slice(window, 0.05)(pdf)
    done = got[got["what"] == "done"]
    assert list(zip(done["seq"], done["seq2"])) == slow_match(pdf, window, 0.05)
    assert len(flows._match_slice(window, 0.05)(pdf[pdf["amount"] < 0])) == 0


def test_matching_a_large_slice_is_quick():
    import time
    pdf = slice_of(1, 100_000, np.arange(200_000, 260_000) / 1.0)
    at = time.process_time()
    flows._match_slice(flows.SLICE_US // 2, 0.05)(pdf)
    assert time.process_time() - at < 30
