"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import gzip
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from saldoscope.llm import base, chat, components, decontaminate, line_dedup, merkle, minhash, pieces, pii, quality, token_counts, warc

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(4000)]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)


ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, prose(1, 30)), (5, prose(1, 30)), (5, prose(1, 30)), (None, prose(1, 30)), (6, "x" * 300_000), (7, prose(2, 60_000)), (8, "é" * 50 + " ▁ \u0000 ő 日本 😀")]


@pytest.fixture(scope="module")
def odd(spark):
    # columns whose names the operators use inside
    return frame(spark, ODD).withColumn("items", F.lit(1)).withColumn("key", F.lit("k")).withColumn("uid", F.lit(2)).withColumn("label", F.lit("l"))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- shared pieces ---------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\t,é.", max_size=30), max_size=6))
def test_words_and_hashes(texts):
    buf, offsets = base.flat(pa.array(texts, pa.string()), after="\n")
    starts, ends, hashes = base.words(buf, minhash.word_bytes(), base.lower_ascii())
    plain = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", brute.lower(t))]
    found = [buf[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert [brute.lower(w) for w in found] == plain
    assert len(set(zip(plain, hashes.tolist()))) == len(set(plain)) == len(set(hashes.tolist()))


def test_words_across_blocks(monkeypatch):
    text = prose(3, 3000) + " " + "z" * 5000 + " end"
    whole = base.words(*(base.flat(pa.array([text]), after="\n")[0], minhash.word_bytes(), base.lower_ascii()))
    monkeypatch.setattr(base, "BLOCK_BYTES", 100)
    cut = base.words(*(base.flat(pa.array([text]), after="\n")[0], minhash.word_bytes(), base.lower_ascii()))
    assert all((a == b).all() for a, b in zip(whole, cut))


# -- 1 ---------------------------------------------------------------------------------------


def test_base_patterns_with_traps(spark):
    texts = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 999.1.1.1 256.0.0.1 0001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (386) 555-3733 +49 30 123456 78", "x" * 50_000 + "@", "1" * 50_000,
             "a." * 20_000 + "@" + "b." * 20_000 + "c", "é+7 701 123 45 67 ü user.name%x@mail.example.com.", "+1+2 12345678901", None, ""]
    got = by_id(pii.find_base(frame(spark, list(enumerate(texts)))).withColumn("l", pii.listed("base")))
    for i, t in enumerate(texts):
        assert got[i].l == ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute.base_spans(t)), i


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab1234567890@.+-() _é", max_size=60), min_size=20, max_size=40))
def test_base_patterns_on_random_texts(spark, texts):
    got = by_id(pii.find_base(frame(spark, list(enumerate(texts)))).withColumn("l", pii.listed("base")))
    assert all(got[i].l == ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute.base_spans(t)) for i, t in enumerate(texts))


def test_disclosing_terms_are_found_and_sanitised(spark):
    told = [(i, f"{prose(i, 40)} Zebulon uses zeb@mail.example.com since {prose(50 + i, 30)}") for i in range(4)]
    others = [(100 + i, f"{prose(100 + i, 60)} since uses {prose(200 + i, 10)}") for i in range(40)]
    docs = frame(spark, told + others + [(900, f"only Zebulon {prose(7, 20)}"), (901, None)])
    got = by_id(pii.find_spans(docs).withColumn("l", pii.listed("spans")))
    for i, t in told:
        at = t.index("Zebulon")
        assert f"term:{at}:{at + 7}" in got[i].l.split(",") and f"email:{t.index('zeb@')}:{t.index('zeb@') + 20}" in got[i].l.split(",")
    assert all(got[i].l == "" for i, _ in others) and got[901].l == ""
    clean = by_id(pii.sanitise(docs))
    assert "Zebulon" not in clean[0].text and "[email]" in clean[0].text and clean[100].text == others[0][1] and clean[901].text is None


# -- 2 ---------------------------------------------------------------------------------------


def test_separator_scan_over_tiny_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 3)
    docs = frame(spark, ODD[:6] + [(20 + i, prose(i, i)) for i in range(40)]).repartition(3)
    with open(token_counts.RANKS_PATH, "rb") as f:
        enc = token_counts.encoding(f.read())
    blocks, names = token_counts.write_flat(docs, block_tokens=7)
    got = {r.doc_id: r.n_tokens for r in names.join(token_counts.scan(blocks), ["file", "ordinal"]).collect()}
    assert got == {r.doc_id: len(enc.encode_ordinary(r.text or "")) for r in docs.collect()}
    assert token_counts.open_ends(blocks).count() == 0
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def test_raw_token_files(spark, tmp_path):
    np.array([5, 6, 50256, 50256, 7, 50256, 8, 9, 10], "<u2").tofile(tmp_path / "a.bin")
    blocks = token_counts.read_flat(spark, str(tmp_path), block_tokens=2)
    assert sorted((r.ordinal, r.start, r.n_tokens) for r in token_counts.scan(blocks).collect()) == [(0, 0, 2), (1, 3, 0), (2, 4, 1)]
    assert [r.n_tokens for r in token_counts.open_ends(blocks).collect()] == [3]


# -- 3 ---------------------------------------------------------------------------------------


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (3, 0, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    space = quality.fit(odd, labels)
    got = quality.score(odd, space).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def test_quality_tells_texts_of_one_shape_by_their_words(spark):
    """Good and junk texts with equal lengths of words, signs and capitals."""
    words = {q: ["".join(random.Random(f"{q} {i}").choices("abcdefghij", k=6)) for i in range(300)] for q in (0, 1)}
    texts = [(i, " ".join(random.Random(i).choices(words[i % 2], k=40))) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    docs = frame(spark, texts)
    got = by_id(quality.score(docs, quality.fit(docs, labels)))
    assert sum((got[i].score >= 0.5) == (i % 2 == 1) for i in range(160, 240)) >= 76
    again = by_id(quality.score(docs.repartition(5), quality.fit(docs.repartition(7), labels)))
    assert all(abs(again[i].score - got[i].score) < 1e-5 for i, _ in texts)


def test_slices_are_bounded_by_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array([""] * 5000 + ["x" * 100] * 7)})
    sizes = [b.num_rows for b in base.gathered(iter([batch] * 3), "text", rows=500)]
    assert sum(sizes) == 3 * 5007 and max(sizes) < 1000
    assert [b.num_rows for b in base.gathered(iter([batch]), "text")] == [5007]


# -- 4 ---------------------------------------------------------------------------------------


def test_pieces_like_the_public_library():
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb
    with open(pieces.MODEL_PATH, "rb") as f:
        raw = f.read()
    model = pieces.PieceModel.parse(raw)
    proto = pb.ModelProto()
    proto.ParseFromString(raw)
    proto.trainer_spec.model_type = 1
    for p, s in zip(proto.pieces, model.scores):
        p.score = float(s)
    lib = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = ["Hello world, this  is a test.", "héé zz 日本語 😀\n\tx", "   many   blanks   ", "a" * 300, "Thatble eroure ndin erontihe anheblewh ingesst"]
    ids, offsets = model.encode(pa.array(texts))
    for i, t in enumerate(texts):
        mine, theirs = ids[offsets[i]:offsets[i + 1]], lib.encode(t)
        worth = lambda x: sum(model.scores[j] if j not in model.byte_ids else 0 for j in x)
        assert list(mine) == theirs or abs(worth(mine) - worth(theirs)) < 1e-3  # equally likely


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_pieces_round_trip(texts):
    model = test_pieces_round_trip.__dict__.setdefault("model", None) or pieces.PieceModel.load()
    test_pieces_round_trip.__dict__["model"] = model
    ids, offsets = model.encode(pa.array(texts, pa.string()))
    assert [model.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])] == texts


def test_pieces_of_odd_rows(spark, odd):
    back = pieces.decode(pieces.encode(odd)).collect()
    assert all(r.decoded == r.text and (r.ids is None) == (r.text is None) for r in back)
    assert pieces.decode(pieces.encode(odd.limit(0))).count() == 0


# -- 5 ---------------------------------------------------------------------------------------


def test_lines_on_fixture(spark):
    p = [prose(i, 60) for i in range(6)]
    short = ["a b", "c d", "e f g h"]
    texts = [(0, "\n".join([p[0], p[1], *short])), (1, "\n".join([p[2], p[1], "", p[3]])), (2, "\n".join([*short, p[4]])), (3, p[1]), (4, "a b\nc d"), (5, p[5] + "\n" + p[5]), (6, None), (7, ""), (8, f" {p[0]} ")]
    want = {0: texts[0][1], 1: f"{p[2]}\n\n{p[3]}", 2: p[4], 3: "", 4: "a b\nc d", 5: p[5], 6: None, 7: "", 8: ""}
    docs = frame(spark, texts)
    got = by_id(line_dedup.deduplicate_lines(docs))
    assert {d: r.text for d, r in got.items()} == want
    assert set(by_id(line_dedup.deduplicate_lines(docs, drop_empty=True))) == {0, 1, 2, 4, 5, 6, 7}


@pytest.mark.parametrize("most", [2, 5, 12])
def test_lines_like_plain_version(spark, most):
    r = random.Random(most)
    lines = [prose(i, r.randint(1, most)) for i in range(25)]
    texts = [(d, "\n".join(r.choices(lines, k=r.randint(0, 14)))) for d in range(60)]
    got = by_id(line_dedup.deduplicate_lines(frame(spark, texts)))
    assert {d: r.text for d, r in got.items()} == brute.line_dedup(texts)


def test_lines_of_odd_rows(spark, odd):
    out = line_dedup.deduplicate_lines(odd)
    assert out.count() == len(ODD) and line_dedup.deduplicate_lines(odd.limit(0)).count() == 0
    got = [r.text for r in out.where("doc_id = 5").collect()]
    assert got == ["", ""] or got == [ODD[4][1]] * 2 or got == [None, None]


# -- 6 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("compressed", [True, False])
def test_archive_round_trip_and_salvage(spark, tmp_path, compressed):
    pages = [(1, "u", "same"), (2, "u\r\nx", "same"), (3, None, None), (4, "v", ""), (5, "w", "é" * 200_000), (6, "w", "WARC/1.1\r\nnot a record\r\n\r\n"), (6, "w", "WARC/1.1\r\nnot a record\r\n\r\n"), (7, "x", "tail")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(warc.plan_records(df).coalesce(1).sortWithinPartitions("page_id"), str(tmp_path / "a"), compressed)
    got = warc.read_archives(spark, path)
    assert got.where("gap is not null").count() == 0
    back = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()}
    assert back == brute.warc_rows([(p, h) for p, _, h in pages]) and got.count() == len(pages)
    # damage one record in the middle: the others are recovered, the gap is logged
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "a").glob("part-*")))
    good = [x for x in warc.salvage(data) if x[2]]
    at = good[2][0] + 30
    broken = data[:at] + b"#" * 40 + data[at + 40:]
    found = list(warc.salvage(broken))
    gaps = [x for x in found if x[2] is None]
    assert len([x for x in found if x[2]]) == len(good) - 1 and len(gaps) == 1 and gaps[0][0] <= at < gaps[0][1]
    cut = list(warc.salvage(data[:-30]))
    assert cut[-1][2] is None and len([x for x in cut if x[2]]) == len(good) - 1
    mixed = list(warc.salvage(b"noise" + data + b"\0" * 9 + gzip.compress(warc.record(9, "z", b"late", None))))
    assert [x[4] is None for x in mixed].count(True) == len(good) + 1


def test_records_of_a_damaged_member():
    """One gzip member for all records: a damaged record, damaged bytes, a lost tail, a wrong checksum."""
    rows = [(i, f"http://x/{i}", prose(i, 3000), None if i % 5 else 7) for i in range(1, 61)]
    made = [warc.record(p, u, h.encode(), r) for p, u, h, r in rows]
    ids = lambda data: [int(x[2]["warc-record-id"][10:-1]) for x in warc.salvage(data) if x[2]]
    gaps = lambda data: [x for x in warc.salvage(data) if x[2] is None]
    whole = gzip.compress(b"".join(made), 6, mtime=0)
    assert ids(whole) == list(range(1, 61)) and not gaps(whole)
    # a record that was damaged before it was packed
    packed = gzip.compress(b"".join([*made[:20], made[20].replace(b"WARC/1.1", b"WARX/1.1"), *made[21:30], made[30][:-900], *made[31:]]))
    assert ids(packed) == [i for i in range(1, 61) if i not in (21, 31)] and len(gaps(packed)) == 2
    assert all(0 <= a < b <= len(packed) for a, b, *_ in gaps(packed))
    # bytes damaged afterwards: all before them are there, and the member behind
    at = len(whole) // 2
    broken = whole[:at] + b"#" * 40 + whole[at + 40:] + gzip.compress(warc.record(99, "z", b"late", None))
    found = ids(broken)
    assert found[:25] == list(range(1, 26)) and found[-1] == 99 and len(gaps(broken)) >= 1 and len(set(found)) == len(found)
    assert all(a < b for a, b, *_ in gaps(broken))
    texts = {p: h.encode() for p, _, h, _ in rows} | {99: b"late"}
    assert all(x[3] == texts[int(x[2]["warc-record-id"][10:-1])] for x in warc.salvage(broken) if x[2] and x[2]["warc-type"] == "response")
    # a lost tail, and a wrong checksum
    found = ids(whole[:-len(whole) // 3])
    assert found == list(range(1, len(found) + 1)) and 35 <= len(found) < 60 and gaps(whole[:-len(whole) // 3])[-1][1] == len(whole) - len(whole) // 3 - 1
    assert ids(whole[:-8] + b"\0" * 8) == list(range(1, 61)) and len(gaps(whole[:-8] + b"\0" * 8)) == 1


def test_long_urls_come_back(spark, tmp_path):
    long = "http://x/" + "a b" * 34_000
    pages = [(1, long, "one"), (2, "u", "two"), (3, long + " " * 100_000 + "WARC/1.1", "one"), (4, "é" * 70_000, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id for r in warc.round_trip(df).collect()} == {1, 2, 3, 4}
    for compressed in (True, False):
        got = warc.read_archives(spark, warc.write_archives(warc.plan_records(df), str(tmp_path / str(compressed)), compressed))
        assert {(r.gap, r.page_id, r.url) for r in got.collect()} == {(None, p, u) for p, u, _ in pages}
    # headers without an end stop at the next version line
    found = list(warc.salvage(b"WARC/1.1\r\nWARC-Type: response\r\n" + warc.record(5, long, b"five", None)))
    assert [(x[2] or {}).get("warc-record-id") for x in found] == [None, "<urn:page:5>"] and found[0][4] == "no end of headers"


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# -- 7 ---------------------------------------------------------------------------------------


def edited(text, seed, n):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def test_near_duplicates_on_families(spark):
    """Families where copies are alike only along chains, and copies of an original that is gone."""
    texts, n = [], 0
    for f in range(6):
        root = prose(f, 160)
        chain = root
        for i in range(12):
            texts.append((n := n + 1, edited(root, 100 * f + i, i % 5)))
            chain = edited(chain, 1000 * f + i, 1)
            texts.append((n := n + 1, chain))
    texts += [(n + 1 + i, t) for i, t in enumerate(["", None, "a b", "A B", "a b c", prose(0, 160).upper().replace("W", "w")])]
    got = by_id(minhash.near_duplicates(frame(spark, texts).repartition(3)))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.near_duplicates(texts)


def test_rest_links_without_pivot(spark, monkeypatch):
    """Small groups and blocks, so that links come from pairs of blocks too."""
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 400)
    root = prose(9, 120)
    texts = [(i, edited(edited(root, 7 * (i // 3), 6), i, 1)) for i in range(60)]
    got = by_id(minhash.near_duplicates(frame(spark, texts)))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.near_duplicates(texts)


def test_near_duplicates_at_other_thresholds(spark):
    """Pairs between 0.80 and 0.85: linked by the stage and at 80, not at the query's 85."""
    texts = []
    for f in range(40):
        root = prose(3000 + f, 100 + f)
        texts += [(3 * f, root), (3 * f + 1, edited(root, f, 2)), (3 * f + 2, edited(root, 500 + f, 4))]
    docs = frame(spark, texts)
    want = {p: brute.near_duplicates(texts, p) for p in (80, 85, 90)}
    assert want[80] != want[85] != want[90]
    for p in want:
        got = by_id(minhash.near_duplicates(docs, percent=p))
        assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want[p]
    kept = set(by_id(corpus_pipeline.near_duplicate_stage(spark, docs, "")))
    assert kept == {d for d, (_, c) in want[80].items() if d == c}
    assert minhash.band_count(85) == 24 and minhash.band_count(80) == 35 and minhash.sure_places(85) == 80


def test_near_duplicates_of_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (4, 5)} == {(4, 4), (5, 4)}
    assert all(r.kept for r in got if r.doc_id not in (5, None)) and minhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in list(up)}


# -- 8 ---------------------------------------------------------------------------------------


def test_contamination_with_slices_of_the_benchmark(spark, odd):
    items = [(i, prose(500 + i, n)) for i, n in enumerate([1, 5, 12, 13, 14, 40])] + [(50, None), (51, ""), (52, "!!!"), (0, prose(500, 1))]
    texts = [(i, f"{prose(i, 30)} {t} {prose(i + 1, 30 * (i + 1))}") for i, (_, t) in enumerate(items[:6])] + [(20, items[4][1].upper()), (21, None), (22, ""), (22, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(texts, [(i, t) for i, t in items])
    for most in (1_000_000, 20):
        hits = decontaminate.judge(decontaminate.find_hits(frame(spark, texts), bench, max_windows=most)).collect()
        assert len(hits) == len(texts)
        for r in hits:
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == want[r.doc_id]
    hits = decontaminate.find_hits(frame(spark, texts), bench)
    assert all(not x.n_hit or x.n_hit < 13 for x in decontaminate.judge(decontaminate.find_hits(decontaminate.remove_spans(hits).select("doc_id", "text"), bench)).collect())
    assert decontaminate.find_hits(odd, bench).count() == len(ODD)
    assert decontaminate.find_hits(odd, bench.limit(0)).count() == len(ODD)


# -- 9 ---------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[/ROLE] x"]), st.lists(st.sampled_from(["[INST]", " [/INST]", "</s>", "<s>", "<a>", "\\", "[", "<", " ", "a", "é", "\n", "[ROLE]"]), max_size=6).map("".join)), max_size=6))
def test_chat_template_is_reversible(turns):
    made = chat.assemble(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    assert [(r.decode(), t.decode()) for r, t, _ in chat.parse("".join(made.to_pylist()).encode())] == turns


def test_chats_of_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 2, None, "x"), (2, 0, "assistant", "y" * 300_000), (None, 0, "user", "z"), (1, 0, "user", "hi")] + [(7, i, "assistant", f"t{i} ") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    formatted = chat.format_chats(df)
    got = by_id(chat.read_back(formatted), "conv_id")
    want = brute.chats([(c, t, r or "", x) for c, t, r, x in rows])
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    assert {c: r.formatted_chars for c, r in got.items()} == {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    spans = chat.loss_spans(formatted.where("conv_id = 1")).collect()
    assert sum(len(r.loss_spans) for r in spans) == 1
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


# -- 10 --------------------------------------------------------------------------------------


def test_trees(spark, odd):
    got = merkle.compare_with_next(odd).collect()
    assert len(got) == len(ODD)
    roots = {}
    for r in got:
        roots.setdefault(r.text, set()).add(r.root)
    assert all(len(x) == 1 for x in roots.values()) and len({x for s in roots.values() for x in s}) == len(roots)
    distinct = [(d, t) for d, t in ODD if d not in (5, None)] + [(5, ODD[5][1])]
    want = brute.edited_texts(distinct)
    assert all(r.edited == want[r.doc_id] for r in got if r.doc_id is not None)
    assert merkle.compare_with_next(odd.limit(0)).count() == 0
    one = merkle.compare_with_next(frame(spark, [(3, "abcdefgh")])).collect()[0]
    assert one.edited == "abcdefab"


def test_edits_are_located(spark):
    old = [prose(i, 20) for i in range(30)]
    new = [*old]
    new[13] = "changed"
    df = spark.createDataFrame([("\n".join(old), "\n".join(new))], "a string, b string")
    both = merkle.with_likeness(merkle.with_tree(merkle.with_tree(df, "a"), "b", "edited_"), "", "edited_", "n", "e").first()
    assert both.e == [13] and 0.9 < both.n < 1


def test_likeness_survives_insertions(spark):
    line = prose(3, 400)
    lines = [prose(i, 12) for i in range(60)]
    pairs = [(line, "inserted " + line), (line, line.replace(" ", " inserted ", 1)), ("\n".join(lines), "\n".join(["new line", *lines])), ("ha " * 2000, "ha " * 1000 + "x " + "ha " * 1000),
             (line, line), (line, ""), ("", ""), (None, "a"), ("\n\n", "\n"), (prose(1, 50), prose(2, 50)), ("x" * 100_000, "x" * 100_000 + "y")]
    rng = random.Random(8)
    for _ in range(40):
        a = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 30))) for _ in range(rng.randint(1, 40))]
        b = [x if rng.random() < 0.9 else x + " z" for x in a]
        pairs.append(("\n".join(a), "\n".join(b[rng.randint(0, 1):])))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").withColumns({"x": F.coalesce("a", F.lit("")), "y": F.coalesce("b", F.lit(""))})
    got = {r.i: r for r in merkle.with_likeness(merkle.with_tree(merkle.with_tree(df, "x"), "y", "edited_"), "", "edited_", "n", "e").collect()}
    for i, (a, b) in enumerate(pairs):
        near, edited = brute.tree_likeness(a, b)
        assert got[i].n == pytest.approx(near) and got[i].e == edited, i
        assert (got[i].root == got[i].edited_root) == ((a or "") == (b or ""))
    assert all(got[i].n > 0.9 for i in range(3)) and got[3].n >= 0.5


# -- pipeline --------------------------------------------------------------------------------


def test_stages_take_odd_and_empty_tables(spark, odd, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(4, 1, 0), (7, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(2, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() <= len(ODD)
        assert stage(spark, docs.limit(0), folder).count() == 0
