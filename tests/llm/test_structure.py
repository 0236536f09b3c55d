"""Spelling variants, sharding and conversation repair against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from saldoscope.llm import queries as Q
from saldoscope.llm import line_dedup, minhash, pii, repair, shards, spelling

from . import brute

SF = "/root/testdata/sf0.001"
WS = "\t\n\x0b\x0c\r "
TURNS = "conv_id long, turn long, role string, text string"


# -- conversations

def plain_repair(rows):
    """Cheapest, then least audit of (initial, fault) rows by a table of all rows and states."""
    nxt, close = (2, 2, 3, 2), {0: "", 1: "II", 2: "I", 3: ""}
    best = {0: (0, "")}
    for initial, fault in rows:
        new = {}

        def put(state, cost, audit):
            if state not in new or (cost, audit) < new[state]:
                new[state] = (cost, audit)
        for state, (cost, audit) in best.items():
            for _ in range(3):
                put(state, cost + 2, audit + "D")
                if fault not in ("blank", "duplicate"):
                    extra = 5 if fault == "truncated" else 0
                    kept = {"s": 1, "u": 2, "a": 3}.get(initial)
                    if kept and (kept == nxt[state] or kept == 1 and state == 0):
                        put(kept, cost + extra, audit + "K")
                    put(nxt[state], cost + 1 + extra, audit + "R")
                state, cost, audit = nxt[state], cost + 5, audit + "I"
        best = new
    return min((c + 5 * len(close[s]), a + close[s]) for s, (c, a) in best.items())


def plain_conversation(rows):
    """What repair() says of (turn, role, text) rows in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    seen, marked = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role[:1], fault))
    cost, audit = plain_repair(marked)
    out, i, led = [], 0, False
    for letter in audit:
        if letter != "I":
            _, role, text = rows[i]
            i += 1
        if letter == "D":
            continue
        if letter == "K":
            led = led or not out and role[:1] == "s"
        else:
            role = "assistant" if (len(out) - led) % 2 else "user"
        out.append(f"{role}:{'' if letter == 'I' else text}")
    turns = [t for t, _, _ in rows if t is not None]
    kinds = Counter(f for _, f in marked)
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marked, marked[1:]))
    return (audit, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, cost,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_rows(rng, n):
    texts = ["Yes.", "No", "", " \n", "What?", "more", None, "Go!\n", "ün."]
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}{rng.choice(['.', '', '!'])}") for _ in range(n)]


def test_meeting_in_the_middle_equals_the_whole_table():
    rng = random.Random(1)
    ahead = repair._inserted(list(repair.ACCEPT))
    kinds = {"": 0, "truncated": 1, "blank": 2}
    for _ in range(3000):
        rows = [(rng.choice("suax"), rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randint(0, 14))]
        audit, state = repair.solve(bytes(repair.symbol(i, kinds[f]) for i, f in rows), 0, ahead)
        assert audit + repair.closing(state) == plain_repair(rows)[1], rows


def in_order(spark, frame):
    """Rows of each conversation in the operator's order."""
    out = defaultdict(list)
    ordered = frame.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(" ")))).withColumn("r", F.coalesce("role", F.lit(" ")))
    for r in ordered.orderBy("conv_id", F.col("turn").asc_nulls_first(), "r", "h").collect():
        out[r.conv_id].append((r.turn, r.role, r.text))
    return out


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_repair_of_odd_conversations(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(c, rng.choice([None, *range(n + 2)]), *x) for c in range(60) for n in [rng.randint(1, 9)] for x in random_rows(rng, n)]
    rows += rows[:40] + [(None, 1, "user", "Hello."), (None, 2, "assistant", "Bye."), (77, None, None, None), (78, 3, "user", "x" * 200_000 + ".")]
    rows += [(99, i, *x) for i, x in enumerate(random_rows(rng, 700))] + [(99, 5, "user", "Again.")] * 300
    frame = spark.createDataFrame(rows, TURNS).withColumn("mark", F.lit(1)).withColumn("h", F.lit("h")).withColumn("block", F.lit(2))
    want = {c: plain_conversation(r) for c, r in in_order(spark, frame.select("conv_id", "turn", "role", "text")).items()}
    got = {r.conv_id: tuple(r)[1:] for r in repair.audits(frame, block_rows=block_rows).collect()}
    assert got == {c: w[:6] for c, w in want.items()}
    if block_rows == 4096:
        whole = {r.conv_id: tuple(r)[1:] for r in repair.repair(frame).collect()}
        assert whole == want
        turns = defaultdict(list)
        for r in repair.repaired_turns(frame).orderBy("conv_id", "position").collect():
            turns[r.conv_id].append(f"{r.role}:{r.text}")
        assert {c: hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() for c in want} == {c: w[7] for c, w in want.items()}


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.repair(none).count() == 0 and repair.repaired_turns(none).count() == 0 and repair.damage(none).count() == 0


def test_op13_against_plain_version(spark):
    rows = defaultdict(list)
    every = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    for r in sorted(every, key=lambda r: (r["conv_id"], r["turn"])):
        how = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if how == 1 else "".join(c for c in r["text"] if c not in ".!?") if how == 2 else r["text"]
        if how:
            rows[r["conv_id"]] += [(r["turn"], "user" if how == 4 else r["role"], text)] * (2 if how == 3 else 1)
    got = {r.conv_id: r for r in Q.op13_conversation_repair(spark, SF).collect()}
    assert set(got) == {r["conv_id"] for r in every}
    for c, r in got.items():
        audit, blank, duplicate, truncated, illegal, gaps, cost, sha = plain_conversation(rows[c]) if rows[c] else ("", 0, 0, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest())
        assert (r.audit, r.blank, r.duplicate, r.truncated, r.illegal, r.gaps, r.cost, r.repaired_sha256) == (audit, blank, duplicate, truncated, illegal, gaps, cost, sha)


# -- shards

def test_op12_slots_shards_and_numbers(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = Q.op12_slot_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held, places, slots = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        held[r.shard] += r["size"]
        places[r.shard].append(r.slot)
        slots[r.virtual_slot].add(r.shard)
    assert set(held) == set(range(8)) and max(held.values()) - min(held.values()) <= max(len(t.encode()) + 1 for t in docs.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(len(s) == 1 for s in slots.values()) and {r.map_version for r in got} == {2}


def test_maps_are_edited_not_remade():
    rng = random.Random(3)
    for sizes in ([rng.randint(0, 1000) for _ in range(shards.SLOTS)], [0] * shards.SLOTS, [10**9] + [1] * (shards.SLOTS - 1)):
        first = shards.first_map(8)
        second = shards.rebalanced(first, sizes, 8)
        total = shards._totals(second, sizes, 8)
        assert max(total) - min(total) <= max(max(sizes), 1)
        assert max(total) <= max(shards._totals(first, sizes, 8))
        third = shards.grown(second, sizes, 8)
        assert all(b == a or b == 8 for a, b in zip(second, third))
        assert abs(shards._totals(third, sizes, 9)[8] - sum(sizes) / 9) <= max(sizes)
    even = [100] * shards.SLOTS
    moved = shards.rebalanced(shards.first_map(8), [100] * (shards.SLOTS - 1) + [150], 8)
    assert sum(a != b for a, b in zip(moved, shards.first_map(8))) <= 2 and shards.rebalanced(shards.first_map(8), even, 8) == shards.first_map(8)


def test_shards_of_odd_documents(spark, tmp_path):
    rows = [(None, "null id"), (None, "other"), (1, None), (2, ""), (3, "é" * 9), (4, "same"), (4, "same"), (4, "other text"), (5, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("s")).withColumn("piece", F.lit(1)).withColumn("slot", F.lit(0))
    folder = str(tmp_path / "map")
    got = shards.shard_documents(docs, 3, folder=folder).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    sizes = shards.slot_bytes(shards.measure(docs))
    old = [r.shard for r in shards.load_map(spark, folder).orderBy("slot").collect()]
    shards.save_map(spark, folder, 3, shards.grown(old, sizes, 3), sizes)
    assert {r.version for r in shards.load_map(spark, folder).collect()} == {3}
    assert [r.shard for r in shards.load_map(spark, folder, 2).orderBy("slot").collect()] == old
    plain = docs.select("doc_id", "text")
    shards.write_shards(plain, shards.load_map(spark, folder), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, plain.collect()))
    assert shards.shard_documents(docs.limit(0), 3).count() == 0


# -- spelling

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = [n, len(near), best if best and counts[best] >= 10 * n else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row += [counts[row[2]] if row[2] else None, root]
    return {w: tuple(r) for w, r in out.items()}


@pytest.mark.parametrize("letters", ["ab", "abc", "abÿz"])
def test_walk_over_a_sorted_list(letters):
    rng = random.Random(letters)
    words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(500)})
    group = np.array(sorted(rng.randint(0, 3) for _ in words))
    i, j = spelling.near_pairs(words, group)
    want = {(x, y) for x in range(len(words)) for y in range(x + 1, len(words)) if group[x] == group[y] and one_edit(words[x], words[y])}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def test_walk_behind_long_prefixes():
    head = "p" * 300
    words = sorted({head + w for w in ("", "a", "ab", "b", "ba", "bab", "cab", "ccc")} | {"p" * 299 + "q", "p" * 150 + "x" + "p" * 149})
    i, j = spelling.near_pairs(words, np.zeros(len(words), int))
    assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(len(words)) for y in range(x + 1, len(words)) if one_edit(words[x], words[y])}


@pytest.mark.parametrize("limit", [4, 2048])
def test_variants_against_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "GROUP", limit)  # small: groups are split again and again
    rng = random.Random(5)
    counts = {"".join(rng.choices("abÿ", k=rng.randint(7, 9))): rng.choice([2, 3, 20, 200, 2500]) for _ in range(400)}
    counts |= {"z" * 5000: 40, "z" * 2500 + "y" + "z" * 2499: 3, "z" * 5001: 500}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {r.word: tuple(r)[1:] for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()} == plain_variants(counts)


def test_vocabulary_of_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "Wörtchen WÖRTCHEN wörtchen"), (None, "abcdefgh-abcdefgh short"), (4, "abcdefghĀabcdefghi"), (4, "abcdefghi " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1))
    plain = Counter({"wörtchen": 2, "abcdefgh": 3, "abcdefghi": 10})
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == plain
    want = Counter()
    for d, t in rows:
        for w in spelling_runs(t or ""):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            want[w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] += 1
    assert {r.word: r.n for r in spelling.vocabulary(docs, spoil=True).collect()} == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0


def spelling_runs(text):
    import re
    lower = {c: c + 32 for c in range(65, 91)}
    return [r.translate(lower) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]


# -- disclosing terms

def test_disclosing_terms_against_dictionaries(spark):
    rng = random.Random(11)
    common = [f"word{i}" for i in range(60)]
    texts = []
    for i in range(260):
        body = rng.choices(common, k=rng.randint(5, 60))
        who = rng.randint(0, 11)
        if i % 3 == 0:
            value = f"person{who}@mail.example.org" if who < 8 else f"10.0.0.{who}"
            body.insert(rng.randint(0, len(body)), value)
            body.insert(rng.randint(0, len(body)), rng.choice([f"Surname{who}", f"Стрит{who}", f"alias{who % 3}"]))
            if who % 4 == 0:
                body += [f"far{who}"] + rng.choices(common, k=40)
        elif rng.random() < 0.05:
            body.append(f"Surname{who}")
        texts.append(" ".join(body))
    texts += texts[:20] + [None, "", "person1@mail.example.org"]
    docs = spark.createDataFrame([(i % 250, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("term", F.lit("t")).withColumn("terms", F.lit(1)).withColumn("base", F.lit("b"))
    found = pii.find_base(docs)
    got = {r.term: r.disclosure for r in pii.disclosing_terms(docs, found).collect()}
    want = brute.disclosures(texts)
    assert len(want) >= 5 and got == pytest.approx(want)
    spans = pii.find_spans(docs).select("doc_id", "key", pii.listed("spans").alias("l"))
    assert spans.count() == len(texts)
    plain = Counter()
    for t in texts:
        base = brute.base_spans(t)
        extra = [(m.start(), 4, "term", m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", t or "") if m.group().lower() in want]
        alone = [x for x in extra if not any(a < x[3] and x[0] < b for a, _, _, b in base)]
        plain[",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base + alone))] += 1
    assert Counter(r.l for r in spans.collect()) == plain
    assert pii.find_spans(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


# -- near-duplicates around a common text

def boilerplate(n, seed, copies=True):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    common = [[word() for _ in range(70)] for _ in range(3)]
    out = []
    for i in range(n):
        kind = i % 6
        if kind < 3 or not out:
            out.append(common[kind % 3] + [word() for _ in range(60)])
        elif kind == 3 and copies:  # an edited copy of an earlier text
            t = list(rng.choice(out))
            t[rng.randrange(len(t))] = word()
            out.append(t)
        elif kind == 4:  # a sliding chain: neighbours are alike, ends are not
            out.append(out[-1][3:] + [word() for _ in range(3)])
        else:  # parts of two boilerplates
            out.append(common[0][:40] + common[1][:40] + [word() for _ in range(rng.randrange(40))])
    return [" ".join(t) for t in out]


def test_groups_around_boilerplate_against_all_pairs(spark):
    texts = boilerplate(240, 3)
    sets = [brute.shingles(t) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent=80)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: top(i) for i in range(len(texts))}


def test_lines_divided_by_other_white_space(spark):
    ten = [f"word{i}" for i in range(10)]
    texts = [" ".join(ten), "first\n" + "\t".join(ten), "  ".join(ten) + "\r\nnext", "a  b   c    d", "a  b   c    d", "\t \r\n\x0c" + "\x0b".join(ten), "a b c\nd e f\ng h", "x\na\tb c\r\nd  e f\n g h \ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(docs).collect()}
    assert got == brute.line_dedup(list(enumerate(texts)))
    assert got[1] == "first" and got[2] == "next" and got[4] == texts[4] and got[7] == "x\ny"
