"""Statute corpus: splitting pages, BM25 search for a table of queries, citation checks."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import language as L
from ..session import durable
from . import base as B


def clean_html(c):
    out = F.regexp_replace(c, r"(?i)<br\s*/?>|</p>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for a, b in L.ENTITIES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def split_articles(pages: DataFrame) -> DataFrame:
    """(code, url, html) pages cut at article headings; the first body of 40 characters or
    more wins per number."""
    mark = "\u0001"
    d = pages.withColumn("cut", F.split(F.regexp_replace("html", L.ARTICLE_HEADING, f"{mark}$1\u0002$2\u0002$3\u0002"), mark))
    d = d.select("code", "url", F.posexplode(F.slice("cut", 2, F.size("cut"))).alias("pos", "part")).withColumn("f", F.split("part", "\u0002", 4))
    d = d.select("code", F.concat("url", F.lit("#"), F.col("f")[0]).alias("url"), "pos", F.col("f")[1].alias("number"), clean_html(F.col("f")[2]).alias("title"), clean_html(F.col("f")[3]).alias("text"))
    d = d.filter(F.length("text") >= 40)
    return B.topk(d, ["code", "number"], ["pos", "url"], 1, "_r").drop("_r", "pos")


def attach_titles(articles: DataFrame, titles: DataFrame) -> DataFrame:
    """Second-language titles by article number."""
    return articles.join(titles.select("code", "number", "title_kk"), ["code", "number"], "left").withColumn("title_kk", F.coalesce("title_kk", F.lit("")))


def tokens(c):
    """Word stems without stop words, in order."""
    low = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е"))
    words = F.regexp_extract_all(low, F.lit(f"({L.WORD})"), 1)
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*L.STOPWORDS))
    # the leftmost match of the tail is the longest suffix that leaves four letters
    cut = lambda suffixes: "(?<=.{4})(?:" + "|".join(suffixes) + ")$"
    # most words end in no last letter of a suffix and need no pattern
    ends = F.lit("".join(sorted({x[-1] for x in (*L.RU_SUFFIXES, *L.KK_SUFFIXES)})))
    return F.transform(kept, lambda w: F.when(~F.contains(ends, F.right(w, F.lit(1))), w).when(w.rlike(f"[{L.KK_LETTERS}]"), F.regexp_replace(w, cut(L.KK_SUFFIXES), "")).otherwise(F.regexp_replace(w, cut(L.RU_SUFFIXES), "")))


def postings(articles: DataFrame) -> DataFrame:
    """Term counts per article: title words count three times."""
    title, kk = tokens(F.col("title")), tokens(F.col("title_kk"))
    terms = F.concat(title, title, title, kk, kk, kk, tokens(F.col("text")))
    d = articles.select("code", "number", F.explode(terms).alias("term"))
    return d.groupBy("code", "number", "term").agg(F.count("*").alias("tf"))


#: Terms of queries up to which the postings of all other terms are left out before they travel.
FEW_TERMS = 100_000
#: Postings in one block of articles, and queries that meet a block at a time; results depend on neither.
BLOCK_POSTINGS, BLOCK_QUERIES = 2_000_000, 200_000
#: Scores are compared to six digits of the best one; what is nearer than that must not be cut.
SCORE_STEP = 2e-6
PART = "uid long, code string, number string, _len int, raw double"


def packed_postings(articles: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(code, number, _len, dl, terms, tfs): one row per article, so a posting never travels alone.

    ``dl`` counts all terms; ``terms``: the only ones that are listed, few enough to be broadcast.
    """
    title, kk = tokens(F.col("title")), tokens(F.col("title_kk"))
    every = F.concat(title, title, title, kk, kk, kk, tokens(F.col("text")))
    # dealt by article before words are counted: neither count needs another shuffle
    d = articles.select("code", "number", "title", "title_kk", "text").repartition("code", "number")
    d = d.select("code", "number", F.coalesce(F.length("title"), F.lit(-1)).alias("_len"), F.explode_outer(every).alias("term"))
    d = d.groupBy("code", "number", "term").agg(F.count("term").cast("int").alias("tf"), F.min("_len").alias("_len"))
    listed = F.col("term").isNotNull()
    if terms is not None:
        d = d.join(F.broadcast(terms.select("term", F.lit(True).alias("_asked"))), "term", "left")
        listed = F.col("_asked")
    d = d.groupBy("code", "number").agg(F.min("_len").alias("_len"), F.sum("tf").alias("dl"), F.collect_list(F.when(listed, F.struct("term", "tf"))).alias("p"))
    return d.select("code", "number", "_len", "dl", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Elements of a list column, and the number of the row that each belongs to."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _numbers(values, kind="float64") -> np.ndarray:
    return np.asarray(values.to_numpy(zero_copy_only=False) if isinstance(values, pa.Array) else values.to_numpy(), dtype=kind)


def _best_of_block(k: int, mean_length: float):
    """Best ``k`` articles of a block for each query of a slice, by adding up all of its terms.

    Articles stand in the order that decides between equal scores; of articles with the very same score
    only the first k can be among the best, and what is so near that rounding may make it equal stays.
    """
    def run(articles: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({c: pa.array([], t) for c, t in (("uid", pa.int64()), ("code", pa.string()), ("number", pa.string()), ("_len", pa.int32()), ("raw", pa.float64()))})
        if not len(articles) or not len(queries):
            return none
        articles = articles.append_column("_d", pc.match_substring(articles["number"], "-"))
        articles = articles.take(pc.sort_indices(articles, [(c, "ascending") for c in ("_d", "_len", "code", "number")]))
        asked, asker = _flat(queries["terms"])
        found, doc = _flat(articles["terms"])
        if not len(found):
            return none
        found = found.dictionary_encode()
        place = pc.fill_null(pc.index_in(asked, value_set=found.dictionary), -1).to_numpy(zero_copy_only=False)
        rarity = _numbers(_flat(queries["idfs"])[0])
        idf = np.full(len(found.dictionary), np.nan)
        idf[place[place >= 0]] = rarity[place >= 0]
        code, tf = found.indices.to_numpy(zero_copy_only=False), _numbers(_flat(articles["tfs"])[0])
        order = np.flatnonzero(~np.isnan(idf[code]))
        order = order[np.argsort(code[order], kind="stable")]
        code, doc, tf = code[order], doc[order], tf[order]
        w = idf[code] * (tf * (L.BM25_K1 + 1)) / (tf + L.BM25_K1 * (1 - L.BM25_B + L.BM25_B * _numbers(articles["dl"])[doc] / mean_length))
        w = np.where(_numbers(articles["_d"], "bool")[doc], w * L.DERIVED_PENALTY, w)
        edge = np.searchsorted(code, np.arange(len(idf) + 1))
        scopes, scope = _flat(queries["withins"])[0], articles["code"].combine_chunks()
        scope = (scope.combine_chunks() if isinstance(scope, pa.ChunkedArray) else scope).dictionary_encode()
        inside = pc.fill_null(pc.index_in(scopes, value_set=scope.dictionary), -1).to_numpy(zero_copy_only=False)
        anywhere, scope = scopes.is_null().to_numpy(zero_copy_only=False), scope.indices.to_numpy(zero_copy_only=False)
        times = _numbers(_flat(queries["times"])[0])
        first = np.searchsorted(asker, np.arange(len(queries) + 1))
        slack = np.bincount(asker, rarity * times, len(queries)) * (L.BM25_K1 + 1) * SCORE_STEP
        sums, whose, rows, raws = np.zeros(len(articles)), [], [], []
        for q in range(len(queries)):
            for i in range(first[q], first[q + 1]):
                if place[i] >= 0:
                    these = slice(edge[place[i]], edge[place[i] + 1])
                    at, add = doc[these], w[these]
                    if not anywhere[i]:
                        same = scope[at] == inside[i]
                        at, add = at[same], add[same]
                    sums[at] += add * times[i] if times[i] != 1 else add
            hit = np.flatnonzero(sums)
            if not len(hit):
                continue
            raw = sums[hit]
            sums[hit] = 0.0
            if len(hit) > k:
                near = raw >= np.partition(raw, len(raw) - k)[len(raw) - k] - slack[q]
                hit, raw = hit[near], raw[near]
            by = np.argsort(-raw, kind="stable")
            hit, raw = hit[by], raw[by]
            if len(hit) > k:
                starts = np.flatnonzero(np.r_[True, raw[1:] != raw[:-1]])
                early = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)])) < k
                hit, raw = hit[early], raw[early]
            whose.append(np.full(len(hit), q))
            rows.append(hit)
            raws.append(raw)
        if not rows:
            return none
        best = articles.select(["code", "number", "_len"]).take(pa.array(np.concatenate(rows)))
        return pa.table({"uid": queries["uid"].take(pa.array(np.concatenate(whose))), **{c: best[c] for c in best.column_names}, "raw": np.concatenate(raws)}).cast(none.schema)
    return run


def bm25(articles: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` articles for every query of a table (query_id, query and, optionally, code).

    A query with a code gets articles of that code only. Articles lie in blocks of bounded size; each
    block meets the queries, adds up all terms and gives its best, of which the best of all are
    taken. Queries with the same terms are answered once.
    """
    spark = articles.sparkSession
    within = F.col("code") if "code" in queries.columns else F.lit(None).cast("string")
    asked = queries.where("query_id is not null").select("query_id", within.alias("_within"), F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    asked = asked.groupBy("query_id", "_within", "term").agg(F.count("*").alias("m"))
    asked = asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "_within", "m"))).alias("asks"))
    asks = durable(asked)
    uniq = durable(asks.select("asks").distinct().withColumn("uid", F.monotonically_increasing_id()))
    ids = asks.join(uniq, "asks").select("query_id", "uid")
    terms = uniq.select(F.explode("asks.term").alias("term")).distinct()
    post = durable(packed_postings(articles, terms if terms.count() <= FEW_TERMS else None))
    n_docs = articles.count()
    size = post.agg(F.sum("dl").alias("dl"), F.sum(F.size("terms")).alias("n")).first()
    blocks = max(-(-(size["n"] or 0) // BLOCK_POSTINGS), min(spark.sparkContext.defaultParallelism, -(-n_docs // 100)), 1)
    parts = max(-(-uniq.count() // BLOCK_QUERIES), 1)
    n, df = F.lit(n_docs), F.col("df")
    rare = post.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
    known = uniq.select("uid", F.explode("asks").alias("x")).select("uid", "x.*").join(rare, "term")
    known = known.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("term", "_within", "m", "idf"))).alias("x"))
    known = known.select("uid", F.col("x.term").alias("terms"), F.col("x._within").alias("withins"), F.col("x.m").alias("times"), F.col("x.idf").alias("idfs"))
    known = durable(known)
    each = lambda c, many: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(c)
    left = post.where("code is not null and number is not null and size(terms) > 0").withColumn("block", F.pmod(F.xxhash64("code", "number"), F.lit(blocks)).cast("int")).select("*", each("part", parts))
    right = known.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")).select("*", each("block", blocks))
    best = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_best_of_block(k, (size["dl"] or 0) / n_docs if n_docs else 0.0), PART)
    best = durable(best)
    top = best.groupBy("uid").agg(F.max("raw").alias("best"))
    score = B.py_round(F.col("raw") / F.col("best"), 6)
    s = best.join(top, "uid").select("uid", "code", "number", "_len", score.alias("score"), F.col("number").contains("-").alias("_d"))
    s = B.topk(s, ["uid"], [F.desc("score"), "_d", "_len", "code", "number"], k, "_r").select("uid", "code", "number", "score", "_d")
    s = s.join(ids, "uid").drop("uid").join(articles.select("code", "number", F.length("title").alias("_len")), ["code", "number"])
    s = s.select("code", "number", "query_id", "score", "_len", "_d")
    return B.topk(s, ["query_id"], [F.desc("score"), "_d", "_len", "code", "number"], k, "rank").drop("_d", "_len")


def retrieval_metrics(hits: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """hit@k, MRR, precision@k and recall@k, by query language."""
    good = hits.join(qrels.select("query_id", "code", "number"), ["query_id", "code", "number"], "left_semi")
    per = good.groupBy("query_id").agg(F.min("rank").alias("first"), F.count("*").alias("found"))
    want = qrels.groupBy("query_id", "lang").agg(F.count("*").alias("expected"))
    d = want.join(per, "query_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("queries"), (F.count("first") / F.count("*")).alias("hit_at_k"), B.py_round(F.sum(F.coalesce(1.0 / F.col("first"), F.lit(0.0))) / F.count("*"), 6).alias("mrr"),
                                 B.py_round(F.sum(B.n0("found") / k) / F.count("*"), 6).alias("precision_at_k"), B.py_round(F.sum(B.n0("found") / F.col("expected")) / F.count("*"), 6).alias("recall_at_k"))


def get_article(refs: DataFrame, articles: DataFrame) -> DataFrame:
    return refs.join(articles, ["code", "number"])


def parse_citations(texts: DataFrame) -> DataFrame:
    """(text_id, text) -> cited articles; a code carries on to later bare numbers."""
    codes, nums = F.regexp_extract_all("text", F.lit(L.CITATION), 1), F.regexp_extract_all("text", F.lit(L.CITATION), 2)
    d = texts.select("text_id", F.posexplode(F.arrays_zip(codes.alias("c"), nums.alias("n"))).alias("pos", "z"))
    spelled = F.lit(None).cast("string")
    for name in L.CODE_NAMES:
        spelled = F.when(F.upper("z.c") == name.upper(), name).otherwise(spelled)
    d = d.select("text_id", "pos", spelled.alias("code"), F.col("z.n").alias("number"))
    w = Window.partitionBy("text_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("code", F.last("code", ignorenulls=True).over(w)).filter("code is not null")


def _same(c):
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е")), "[^а-яa-z0-9әғқңөұүіһ]+", " "))


def verify_citations(refs: DataFrame, articles: DataFrame) -> DataFrame:
    """Verdict per reference (code, number, expected_title, quote).

    Without any article nothing can be said: corpus_unavailable.
    """
    there = articles.agg((F.count("*") > 0).alias("_there"))  # one row
    d = refs.join(F.broadcast(there)).join(articles.select("code", "number", "title", "text", "url"), ["code", "number"], "left")
    a, c = _same(F.col("title")), _same(F.col("expected_title"))
    title_off = (F.coalesce("expected_title", F.lit("")) != "") & ~a.contains(c) & ~c.contains(a)
    quote_off = (F.coalesce("quote", F.lit("")) != "") & ~_same(F.col("text")).contains(_same(F.col("quote")))
    return d.withColumn("verdict", F.when(~F.col("_there"), "corpus_unavailable").when(F.col("url").isNull(), "article_not_found").when(title_off, "title_mismatch").when(quote_off, "quote_not_found").otherwise("verified")).drop("text", "_there")


def annotate(refs: DataFrame, articles: DataFrame, excerpt: int = 500) -> DataFrame:
    """References with the official titles (both languages, where the articles have them) and,
    for verified ones, the start of the text."""
    more = [c for c in ("title_kk", "url_kk") if c in articles.columns]
    blank = refs.withColumn("expected_title", F.lit("")).withColumn("quote", F.lit(""))
    d = verify_citations(blank, articles).drop("expected_title", "quote", "title", "url").join(articles.select("code", "number", "title", "url", "text", *more), ["code", "number"], "left")
    ok = F.col("verdict") == "verified"
    cut = F.concat(F.trim(F.substring("text", 1, excerpt)), F.when(F.length("text") > excerpt, "…").otherwise(""))
    return d.select(*[c for c in refs.columns], "verdict", ok.alias("verified"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.when(ok, cut).otherwise("").alias("excerpt"), *[F.coalesce(c, F.lit("")).alias(c) for c in more])


def annotation_counts(annotated: DataFrame) -> DataFrame:
    """Per text: citations, and how many of them are verified."""
    return annotated.groupBy("text_id").agg(F.count("*").alias("citations"), F.count(F.when(F.col("verified"), 1)).alias("verified"), F.count(F.when(~F.col("verified"), 1)).alias("unverified"))


def unknown_citations(cited: DataFrame, known: DataFrame) -> DataFrame:
    return cited.join(known, ["code", "number"], "left_anti")
