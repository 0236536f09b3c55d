"""Components, cycles, communities and template clusters against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from saldoscope.operators import entities, templates
from saldoscope.operators.components import components


def plain_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 80)] + [(200, i) for i in range(201, 250)],
    [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)],
    [(random.Random(i).randint(0, 90), random.Random(i + 1000).randint(0, 90)) for i in range(70)] + [(3, 3), (None, 5), (7, None), (8, 9), (9, 8)],
    [],
])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == plain_components(edges)


def test_components_of_structs(spark):
    edges = spark.createDataFrame([("a", 1, "a", 2), ("b", 1, "b", 2), ("a", 3, "a", 2)], "k string, x long, l string, y long")
    got = components(edges.select(F.struct("k", F.col("x").alias("i")).alias("src"), F.struct(F.col("l").alias("k"), F.col("y").alias("i")).alias("dst"))).collect()
    assert {(r.node.k, r.node.i): (r.component.k, r.component.i) for r in got} == {("a", 1): ("a", 1), ("a", 2): ("a", 1), ("a", 3): ("a", 1), ("b", 1): ("b", 1), ("b", 2): ("b", 1)}


def digraph(seed, nodes=14, m=60):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(nodes):02}", f"n{rng.randrange(nodes):02}"): rng.randint(1, 999) for _ in range(m)}
    return edges | {("n00", f"n{i:02}"): 5 for i in range(nodes)} | {(f"n{i:02}", "n00"): 7 for i in range(0, nodes, 2)}  # a hub


def test_cycles_of_three_and_four(spark):
    edges = digraph(4)
    frame = spark.createDataFrame([(a, b, 1, w) for (a, b), w in edges.items()], "src string, dst string, n long, flow long")
    want = {}
    for k in (3, 4):
        for p in permutations(sorted({x for e in edges for x in e}), k):
            if p[0] == min(p) and all((a, b) in edges for a, b in zip(p, p[1:] + p[:1])):
                want[" > ".join(p)] = (k, sum(edges[e] for e in zip(p, p[1:] + p[:1])) / 100)
    got = entities.entity_cycles(frame).collect()
    assert len(got) == len(want) > 50 and {r.path: (r.length, r.flow) for r in got} == want
    assert entities.entity_cycles(frame.limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_communities(spark, rounds):
    edges = digraph(9, 20, 30)
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    labels = {x: x for x in near}
    for _ in range(rounds):
        labels = {x: min(Counter(labels[y] for y in near[x]).items(), key=lambda kv: (-kv[1], kv[0]))[0] for x in near}
    frame = spark.createDataFrame([(a, b, 1, w) for (a, b), w in edges.items()], "src string, dst string, n long, flow long")
    assert {r.node: r.community for r in entities.entity_communities(frame, rounds).collect()} == labels


def test_edges_between_owners(spark):
    accounts = spark.createDataFrame([("A1", "Ann Lee"), ("A2", "Ann  LEE"), ("B", "Bob Ray"), ("C", None)], "account_id string, owner string")
    rows = [("A1", -10.0, "bob ray"), ("A2", -5.5, "Bob  Ray"), ("A1", 2.0, "BOB RAY"), ("B", -1.0, "Nobody"), ("B", 0.0, "Ann Lee"), ("A1", -9.0, "Ann Lee"), ("A1", -9.0, None)]
    txn = spark.createDataFrame(rows, "account_id string, amount double, counterparty string").withColumn("amount", F.col("amount").cast("decimal(15,2)"))
    got = {(r.src, r.dst): (r.n, r.flow) for r in entities.entity_edges(txn, accounts).collect()}
    ann, bob = "ann_lee_individual", "bob_ray_individual"
    assert got == {(ann, bob): (2, 1550), (bob, ann): (1, 200)}
    assert entities.entity_edges(txn, accounts, least=15.0).count() == 1


def plain_templates(rows):
    """Clusters of (seq, description) rows: a dense matrix and a walk from row to row."""
    rows = sorted((s, d.strip().lower()) for s, d in rows if d and d.strip())
    if len(rows) < 5:
        return {}
    terms = []
    for _, d in rows:
        w = re.findall(r"\w\w+", d)
        terms.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    n, df, often = len(rows), Counter(), Counter()
    for t in terms:
        df.update(t.keys())
        often.update(t)
    kept = sorted((t for t in df if df[t] >= 2 and df[t] <= 0.95 * n), key=lambda t: (-often[t], t))[:500]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in kept}
    vecs = []
    for t in terms:
        v = {k: c * idf[k] for k, c in t.items() if k in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        vecs.append({k: x / size for k, x in v.items()})
    near = [[j for j in range(n) if j == i or sum(x * vecs[j].get(k, 0) for k, x in vecs[i].items()) >= 0.85 - 1e-9] for i in range(n)]
    core = [len(x) >= 3 for x in near]
    label = {}
    for i in range(n):
        if core[i] and i not in label:
            stack = [i]
            label[i] = rows[i][0]
            while stack:
                k = stack.pop()
                for j in near[k] if core[k] else []:
                    if j not in label:
                        label[j] = rows[i][0]
                        stack.append(j)
    return {rows[i][0]: c for i, c in label.items()}


def test_template_clusters(spark):
    rng = random.Random(2)
    words = ["оплата", "по", "договору", "счет", "услуги", "за", "аренда", "invoice", "ref", "a1"]
    rows = []
    for account in ("A", "B", "C", "few"):
        for i in range(4 if account == "few" else 90):
            text = " ".join(rng.choices(words, k=rng.randint(1, 7))) if rng.random() < 0.5 else f"Оплата по договору {rng.randint(1, 6)}{rng.randint(0, 3)}"
            rows.append((account, i * 3, rng.choice([text, text.upper(), f"  {text} "]), f"cp{rng.randint(0, 4)}"))
    rows += [("A", 1001, None, "x"), ("A", 1002, "", "x"), ("B", 1003, "x" * 5000, None), ("D", 1, "same text here", "p"), *[("E", k, "одно и то же", f"p{k}") for k in range(8)]]
    txn = spark.createDataFrame(rows, "account_id string, seq long, description string, counterparty string").withColumn("id", F.lit("i")).withColumn("first", F.lit(0)).withColumn("rows", F.lit(1))
    members = templates.template_members(txn)
    want = {}
    for account in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == account]
        label = plain_templates([(r[1], r[2]) for r in mine])
        for r in mine:
            if r[1] in label:
                want[(account, r[2].strip().lower())] = label[r[1]]
    assert {(r.account_id, r.text): r.cluster for r in members.collect()} == want
    assert len({(a, c) for (a, _), c in want.items()}) > 3 and not any(a in ("few", "D") for a, _ in want)
    sizes = defaultdict(list)
    for a, s, d, cp in rows:
        if d and (a, d.strip().lower()) in want:
            sizes[(a, want[(a, d.strip().lower())])].append((cp or "").strip())
    big = {k: (len(v), len(set(v)), min(20.0, 5 + 1.5 * len(set(v)))) for k, v in sizes.items() if len(v) >= 5 and len(set(v)) >= 3}
    assert big and {(r.account_id, r.cluster): (r.rows, r.counterparties, r.impact) for r in templates.template_clusters(txn, members).collect()} == big
    assert templates.template_members(txn.limit(0)).count() == 0
