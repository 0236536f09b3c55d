"""Registered queries over whole small tables against plain versions, and against their SQL."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from saldoscope.llm import queries as Q
from saldoscope.llm.token_counts import RANKS_PATH, encoding

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"]) for r in table("documents")]


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in Q.QUERIES[name](spark, SF).collect()}


def test_op1_base_spans(spark, docs):
    got = rows(spark, "op1_pii_disclosure")
    assert len(got) == len(docs)
    for d, text in docs:
        spans = brute.base_spans(text)
        listed = [f"{k}:{a}:{b}" for a, _, k, b in spans]
        assert got[d].base_sha256 == brute.sha(",".join(listed))
        assert (got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone) == tuple(sum(k == kind for _, _, k, _ in spans) for kind in ("email", "ip", "card", "phone"))
        assert set(listed) <= set(got[d].spans.split(","))


def test_op2_token_counts(spark, docs):
    with open(RANKS_PATH, "rb") as f:
        enc = encoding(f.read())
    got = rows(spark, "op2_token_counts")
    assert {d: len(enc.encode_ordinary(t or "")) for d, t in docs} == {d: r.n_tokens for d, r in got.items()}


def test_op3_held_out_accuracy(spark, docs):
    got = rows(spark, "op3_quality_knn")
    assert len(got) == len(docs)
    assert all(r.held_out == brute.held_out(d) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    labels = {r["doc_id"]: r["quality"] for r in table("labels")}
    sure = [got[d].predicted == q for d, q in labels.items() if d in got and got[d].held_out]
    assert sum(sure) >= 0.85 * len(sure)


def test_op4_round_trip(spark, docs):
    got = rows(spark, "op4_sentencepiece")
    for d, text in docs:
        assert got[d].round_trip and got[d].decoded_sha256 == brute.sha(text) and got[d].n_pieces == len(got[d].ids)


def test_op5_lines(spark, docs):
    got = rows(spark, "op5_line_winnowing")
    assert {d: r.text_sha256 for d, r in got.items()} == {d: brute.sha(t) for d, t in brute.line_dedup(docs).items()}


def test_op6_archive(spark):
    got = rows(spark, "op6_warc_salvage", "page_id")
    want = brute.warc_rows([(r["page_id"], r["html"]) for r in table("pages")])
    assert {p: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for p, r in got.items()} == want


def test_op7_near_duplicates(spark, docs):
    got = rows(spark, "op7_minhash")
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.near_duplicates(docs)
    assert all(r.kept == (r.component_id == d) for d, r in got.items())


def test_op8_contamination(spark, docs):
    got = rows(spark, "op8_decontamination")
    want = brute.contamination(docs, [(r["item_id"], r["text"]) for r in table("benchmark")])
    for d, (n, hit, items, bad) in want.items():
        assert tuple(got[d])[1:] == (n, hit, len(items), brute.sha(",".join(sorted(map(str, items)))), bad)


def test_op9_chats(spark):
    text = "</s>[INST] ok [/INST]"
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")] + [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    got = rows(spark, "op9_chat_format", "conv_id")
    assert {c: tuple(r)[1:5] for c, r in got.items()} == brute.chats(turns)


def test_op10_edits(spark, docs):
    got = rows(spark, "op10_merkle")
    want = brute.edited_texts(docs)
    assert {d: r.edited_sha256 for d, r in got.items()} == {d: brute.sha(t) for d, t in want.items()}
    by_root = {}
    for d, text in docs:
        by_root.setdefault(got[d].fingerprint, set()).add(text)
    assert all(len(texts) == 1 for texts in by_root.values()) and len(by_root) == len({t for _, t in docs})
    texts, order = dict(docs), sorted(d for d, _ in docs)
    for d, after in zip(order, order[1:] + order[:1]):
        near, edited = brute.tree_likeness(texts[d], want[d])
        assert got[d].near_edited == pytest.approx(near) and list(got[d].edited_paragraphs) == edited
        assert got[d].near_next == pytest.approx(brute.tree_likeness(texts[d], texts[after])[0])
    long = [r for r in got.values() if r.n_chars > 200]
    # the next document may be a copy, and a text of one repeated word has few distinct leaves
    assert sum(r.near_edited > r.near_next and 0.5 < r.near_edited <= 1 for r in long) >= 0.9 * len(long)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    want = con.execute(f"select {columns} from ({Q.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect()))) == sorted(map(repr, want))


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "line dedup":
            every = brute.line_dedup(list(before.items()))
            assert {d: r.text for d, r in after.items()} == {d: t for d, t in every.items() if t.strip() or t == before[d]}
        if name == "MinHash near-dedup":
            assert set(after) == {d for d, (_, c) in brute.near_duplicates(list(before.items())).items() if c == d}
        if name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in table("benchmark")]
            assert set(after) == {d for d, x in brute.contamination(list(before.items()), items).items() if not x[3]}
        if name == "SentencePiece":
            assert all(r.round_trip for r in after.values()) and set(after) == set(before)
        else:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
