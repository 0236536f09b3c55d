"""Personal data, and terms that give it away: information-theoretic sanitisation.

Base spans (e-mail, IP address, card number, phone number) are protected entities c. The
corpus estimates how strongly a term t reveals one: with df counts of documents,

    IC(c) = -log2(df(c) / N)                       what knowing c is worth
    PMI(c; t) = log2(N * df(c, t) / (df(c) * df(t)))    what t tells about c
    disclosure(c, t) = PMI(c; t) / IC(c)           1: t occurs nowhere without c

All counts are of whole documents, a repeated row as often as it stands. Pairs (c, t) to look at
are named by contexts: t must stand near c (``CONTEXT`` characters on either side) in
``MIN_CONTEXTS`` different contexts, so copies of one text prove nothing. Before df(c, t) is
counted, pairs go that cannot reach ``GENERALISE_AT`` since t stands in too many documents, or in too many
without any protected entity; what is counted then does not hold the common words.
A term whose largest disclosure reaches ``REMOVE_AT`` is removed wherever it stands; from
``GENERALISE_AT`` on it is generalised to its kind (a capitalised word, a word, a number),
which as a class discloses next to nothing.

Everything is DataFrame functions. Spans come from ``split`` and ``regexp_extract_all`` with
the same pattern: lengths of what stands between matches and of matches give positions. The
patterns are written so that each text is read in linear time: runs are possessive, and a
match starts at the beginning of a run or where the last match ended.

Terms are counted as distinct terms per document, combined before the shuffle, and counts are
joined to pairs as one row a term; contexts exist only around base spans. Only the final
disclosing terms meet the terms of all documents: they are sent to all tasks while there are
``SEND_TERMS`` or fewer, and joined by a shuffle beyond that.

Defined results: null and empty texts have no spans. Term spans that touch a base span are
left out. Rows with the same doc_id and text get the same answer. An empty table gives no rows;
other columns of the input take no part.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, tune

KINDS = ("email", "ip", "card", "phone")
#: Same matches as the plain patterns of the contract, leftmost and non-overlapping (fixed values).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]++"
CONTEXT = 80
MIN_CONTEXTS = 3
GENERALISE_AT, REMOVE_AT = 0.9, 1.0
SEND_TERMS = 100_000
_CUT_WORD = r"[^\s]*+"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: every second one from the right counts double."""
    turned = F.reverse(digits)

    def weighed(s, i):
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weighed) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """Whether a match of the pattern is personal data of its kind."""
    if kind == "ip":
        def small(part):
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


_SPAN = "struct<start:bigint,rank:int,stop:bigint,kind:string,value:string,near:string>"


def _with_spans(rows: DataFrame, text: str, pattern: Column, kind: str, rank: int, may: Column, out: str, near: bool = True, ok=None) -> DataFrame:
    """``rows`` with the matches of a pattern in ``text`` that pass (``ok``, or the rule of the kind): sorted, with positions."""
    ok = ok or (lambda value: passes(kind, value))
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("_found", F.when(may, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none))
    rows = rows.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    items = F.transform("_found", lambda m, i: F.struct(m.alias("m"), F.get(F.col("_gaps"), i).alias("a"), F.get(F.col("_gaps"), i + 1).alias("b")))

    def step(acc, x):
        start = acc["at"] + F.length(x["a"])
        stop = start + F.length(x["m"])
        around = F.concat(F.regexp_replace(F.right(x["a"], F.lit(CONTEXT)), F.when(F.length(x["a"]) > CONTEXT, "^" + _CUT_WORD).otherwise("^$"), ""), F.lit(" "),
                          F.regexp_replace(F.left(x["b"], F.lit(CONTEXT)), F.when(F.length(x["b"]) > CONTEXT, r"(?<!\S)\S*+$").otherwise("^$"), "")) if near else F.lit(None).cast("string")
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"), x["m"].alias("value"), around.alias("near")).cast(_SPAN)
        return F.struct(stop.alias("at"), F.when(ok(x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.expr(f"named_struct('at', cast(0 as bigint), 'out', cast(array() as array<{_SPAN}>))")
    return rows.withColumn(out, F.aggregate(items, start, step, lambda acc: acc["out"])).drop("_found", "_gaps")


def find_base(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key (hash of the text), base: array of spans by start and kind; terms of documents with spans."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")
    may = {"email": F.contains(t, F.lit("@")), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": F.lit(True), "phone": F.contains(t, F.lit("+"))}
    for rank, kind in enumerate(KINDS):
        rows = _with_spans(rows, "text", F.lit(PATTERNS[kind]), kind, rank, may[kind], kind)
    some = reduce(or_, [F.size(k) > 0 for k in KINDS])
    return rows.select("doc_id", F.xxhash64("text").alias("key"), F.array_sort(F.concat(*KINDS)).alias("base"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.when(some, _terms(t)).alias("terms"))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["value"])


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(term, disclosure): the strongest disclosure of any protected entity, if high enough."""
    n = found.count()
    held = found.where("terms is not null").select("base", "terms", F.array_distinct(F.transform("base", _entity)).alias("entities"))
    often = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("df_c")).where(f"df_c >= {MIN_CONTEXTS} and df_c < {n}")
    # other personal data in a context is protected itself and is no term
    bare = F.col("near")
    for kind in KINDS:
        bare = F.regexp_replace(bare, PATTERNS[kind], " ")
    spans = held.select(F.explode("base").alias("s")).select(_entity(F.col("s")).alias("entity"), "s.near")
    near = spans.join(often, "entity").select("entity", "df_c", F.xxhash64("near").alias("ctx"), F.explode(_terms(bare)).alias("term"))
    pairs = near.groupBy("entity", "term", "df_c").agg(F.countDistinct("ctx").alias("contexts")).where(f"contexts >= {MIN_CONTEXTS}")
    # explode() would make Spark extract the terms a second time, to filter out empty arrays first
    every = docs.select(F.explode_outer(_terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    df_t = every.groupBy("term").agg(F.count("*").alias("df_t"))
    df_e = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df_e"))
    # least df(c, t) that is enough; t stands with c in df(c) documents at most, and only where there is some entity
    least = F.col("df_t") * F.pow(F.col("df_c") / F.lit(float(n)), F.lit(1 - GENERALISE_AT)) * (1 - 1e-9)
    hopeful = cut(pairs.join(df_t, "term").join(df_e, "term").where((F.col("df_e") >= least) & (F.col("df_c") >= least)).select("entity", "term", "df_c", "df_t"))
    met = held.select("entities", F.explode("terms").alias("term")).join(hopeful, "term").where(F.array_contains("entities", F.col("entity")))
    told = met.groupBy("entity", "term", "df_c", "df_t").agg(F.count("*").alias("df_ct"))
    told = told.withColumn("disclosure", 1 + F.log2(F.col("df_ct") / F.col("df_t")) / F.log2(F.lit(float(n)) / F.col("df_c")))
    return cut(told.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(f"disclosure >= {GENERALISE_AT}"))


def _among(rows: DataFrame, terms: DataFrame, count: int) -> DataFrame:
    """Rows whose term is in ``terms``; the terms are broadcast only while they are few."""
    return rows.join(F.broadcast(terms) if count <= SEND_TERMS else terms, "term")


def find_terms(docs: DataFrame, found: DataFrame, terms: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, extra): spans of disclosing terms outside base spans, for documents that have some."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count = terms.count()
    if not count:
        return found.select("doc_id", "key", F.expr(f"cast(array() as array<{_SPAN}>)").alias("extra")).where("false")
    keyed = rows.select("doc_id", F.xxhash64("text").alias("key"), F.explode_outer(_terms(F.col("text"))).alias("term"))
    listed = cut(_among(keyed, terms.select("term"), count).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("term")).alias("listed")))
    base = found.select("doc_id", "key", "base").dropDuplicates(["doc_id", "key"])
    held = rows.withColumn("key", F.xxhash64("text")).join(listed.join(base, ["doc_id", "key"]), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    spans = _with_spans(held, "text", F.lit(TERM), "term", len(KINDS), F.lit(True), "extra", near=False, ok=lambda word: F.array_contains("listed", F.lower(word)))
    alone = F.filter("extra", lambda s: ~F.exists("base", lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"])))
    return spans.select("doc_id", "key", alone.alias("extra"))


def find_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, key, n_email, n_ip, n_card, n_phone, base and spans (base and terms)."""
    found = cut(find_base(docs, text, doc_id))
    terms = disclosing_terms(docs, found, text)
    extra = find_terms(docs, found, terms, text, doc_id)
    joined = found.join(extra.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "extra"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.expr(f"cast(array() as array<{_SPAN}>)"))))
    return joined.select("doc_id", "key", *[f"n_{k}" for k in KINDS], "base", spans.alias("spans"))


def listed(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with base spans replaced by their kind, and disclosing terms generalised or removed."""
    found = cut(find_base(docs, text, doc_id))
    terms = disclosing_terms(docs, found, text)
    extra = find_terms(docs, found, terms, text, doc_id)
    gone = extra.select("doc_id", "key", F.explode("extra").alias("s")).withColumn("term", F.lower("s.value")).join(terms, "term")
    shape = (F.when(F.col("disclosure") >= REMOVE_AT, F.lit("")).when(F.col("s.value").rlike(r"^\p{N}+$"), F.lit("[number]"))
             .when(F.col("s.value").rlike(r"^\p{Lu}"), F.lit("[name]")).otherwise(F.lit("[word]")))
    put = gone.select("doc_id", "key", F.struct("s.start", "s.stop", shape.alias("by")).alias("p"))
    base = found.select("doc_id", "key", F.explode("base").alias("s")).select("doc_id", "key", F.struct("s.start", "s.stop", F.concat(F.lit("["), "s.kind", F.lit("]")).alias("by")).alias("p"))
    edits = put.union(base).distinct().groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("p")).alias("edits"))
    edits = edits.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("edits").alias("__edits"))
    whole = docs.join(edits, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__key")), "left")
    t = F.col(text)

    def step(acc, e):
        part = F.when(e["start"] >= acc["at"], F.concat(F.substring(t, (acc["at"] + 1).cast("int"), (e["start"] - acc["at"]).cast("int")), e["by"])).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], e["stop"]).alias("at"), F.concat(acc["out"], F.array(part)).alias("out"))

    start = F.expr("named_struct('at', cast(0 as bigint), 'out', cast(array() as array<string>))")
    done = F.aggregate("__edits", start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(t, (acc["at"] + 1).cast("int"), F.length(t)))), ""))
    return whole.withColumn(text, F.coalesce(done, t)).drop("__id", "__key", "__edits")
