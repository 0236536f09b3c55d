"""Text signals, privacy, statutes."""

from ..config import keywords as K
from ..config import language as L
from ..config import names as NM
from ..operators import base as B
from ..operators import privacy as PV
from ..operators import statutes as ST
from ..operators import text_signals as TS
from . import oracle as O
from .finance import TRADER_P, org_sql
from .registry import query

F = B.F
LOW = "lower(trim(coalesce(description,'')))"


def listed(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


for tag, words in (("crit", K.TEXT_CRITICAL), ("med", K.TEXT_MEDIUM)):
    O.fragment(f"kw_{tag}", f"select account_id, seq, keyword from (select account_id, seq, {LOW} tx, unnest({listed(words)}) keyword from {{{{txn}}}}) where contains(tx, keyword)")
query("critical_keywords", "select account_id, keyword, count(*) hits, count(*)*15.0::double impact from {{kw_crit}} group by 1,2")(lambda b: TS.critical_keywords(b.txn))
query("medium_keywords", "select account_id, keyword, count(*) hits, least(count(*),2)*5.0::double impact from {{kw_med}} group by 1,2")(lambda b: TS.medium_keywords(b.txn))
query("copy_paste", f"""select account_id, tx as text, count(distinct cp) counterparties, count(*) n, least(15.0::double, count(distinct cp)*2.5::double) impact from (
  select account_id, {LOW} tx, trim(coalesce(counterparty,'')) cp from {{{{txn}}}}) where length(tx) > 5 group by 1,2 having count(distinct cp) >= 3""")(lambda b: TS.copy_paste(b.txn))
query("wording_mismatch", f"""select account_id, seq, reason, 8.0::double impact from (select account_id, seq, case
  when {O.any_of(LOW, K.TEXT_INCOME_WORDS)} and amount < 0 and contains(lower(type),'transfer') then 'income words on an outgoing row'
  when {O.any_of(LOW, K.TEXT_EXPENSE_WORDS)} and amount > 0 and (contains(lower(type),'income') or contains(lower(type),'transfer_in')) then 'spending words on an incoming row' end reason from {{{{txn}}}}) where reason is not null""")(
    lambda b: TS.wording_mismatch(b.txn))
SER = r"(?i)((?:договор|счёт|счет|invoice|contract|№|#)\s*)(\d{3,})"
O.fragment("serial_rows", f"""select account_id, seq, lower(trim(p)) prefix, try_cast(n as hugeint) as number from (select account_id, seq, unnest(regexp_extract_all(coalesce(description,''), '{SER}', 1)) p,
  unnest(regexp_extract_all(coalesce(description,''), '{SER}', 2)) n from {{{{txn}}}}) where try_cast(n as bigint) is not null""")
query("serial_numbers", """select account_id, prefix, max(len) longest, max(total)::bigint as "rows", least(15.0::double, max(len)*2.0::double) impact from (select account_id, prefix, run, count(*) len, max(total) total from (
  select *, sum(brk) over (partition by account_id, prefix order by number, seq) run, count(*) over (partition by account_id, prefix) total from (
    select *, case when number - lag(number) over (partition by account_id, prefix order by number, seq) = 1 then 0 else 1 end brk from {{serial_rows}})) group by 1,2,3)
  group by 1,2 having max(len) >= 3 and max(total) >= 3""")(lambda b: TS.serial_numbers(b.txn))
O.fragment("mixed", """select account_id, seq from (select account_id, seq, length(tx) len, length(regexp_replace(tx,'[^а-яА-ЯёЁ]','','g')) c, length(regexp_replace(tx,'[^a-zA-Z]','','g')) l from (
  select account_id, seq, trim(coalesce(description,'')) tx from {{txn}})) where len >= 10 and c > 0 and l > 0 and least(c,l)/(c+l) > 0.2""")
query("language_mixing", "select account_id, count(*) n, 3.0::double impact from {{mixed}} group by 1 having count(*) >= 3")(lambda b: TS.language_mixing(b.txn))
query("text_score", """select account_id, least(100.0::double, sum(i::decimal(18,2))::double) risk_score, count(*) findings from (select account_id, impact i from {{critical_keywords}} union all select account_id, impact from {{medium_keywords}}
  union all select account_id, impact from {{copy_paste}} union all select account_id, impact from {{wording_mismatch}} union all select account_id, impact from {{serial_numbers}} union all select account_id, impact from {{language_mixing}}
  union all select account_id, impact from {{template_clusters}}) group by 1""")(
    lambda b: TS.text_score(b.txn, b.template_clusters))
query("suspicious_rows", f"""select account_id, count(distinct seq) n_suspicious from (select account_id, seq from {{{{kw_crit}}}} union all
  select account_id, seq from (select *, row_number() over (partition by account_id, keyword order by seq) k from {{{{kw_med}}}}) where k <= 2 union all
  select t.account_id, t.seq from (select *, {LOW} tx from {{{{txn}}}}) t join {{{{copy_paste}}}} c on c.account_id = t.account_id and c.text = t.tx union all
  select t.account_id, t.seq from (select *, {LOW} tx from {{{{txn}}}}) t join {{{{template_members}}}} m on m.account_id = t.account_id and m.text = t.tx join {{{{template_clusters}}}} c on c.account_id = m.account_id and c.cluster = m.cluster union all
  select account_id, seq from {{{{wording_mismatch}}}} union all
  select account_id, seq from (select *, row_number() over (partition by account_id, prefix order by number, seq) k from {{{{serial_rows}}}}) join {{{{serial_numbers}}}} using (account_id, prefix) where k <= longest union all
  select account_id, seq from (select *, row_number() over (partition by account_id order by seq) k from {{{{mixed}}}} where account_id in (select account_id from {{{{language_mixing}}}})) where k <= 10) group by 1""")(
    lambda b: TS.suspicious_rows(b.txn, b.template_members.join(b.template_clusters, ["account_id", "cluster"], "left_semi")))


def turns(b):
    c = b.table("conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("facts"))
    return c.join(before, ["conv_id", "turn"], "left")


NUM = r"(\d{1,3}(?:[\s,]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)"
query("audit_numbers")(lambda b: TS.audit_numbers(turns(b)).select("conv_id", "turn", F.array_join("invented", " | ").alias("invented")))
query("foreign_script")(lambda b: b.table("conversations").select("conv_id", "turn", F.array_join(TS.foreign_script(F.col("text")), " | ").alias("fragments")))

# ---- privacy
CM = r"(?im)<\|[^|>]{0,64}\|>|\[/?INST\]|<</?SYS>>|^\s*#{1,6}\s*(?:system|assistant|user)\s*:"


def strip_sql(c):
    x = bare_sql(c)
    return f"(case when length({x}) > 160 then rtrim(substr({x}, 1, 160)) || '…' else {x} end)"


def bare_sql(c):
    return f"trim(regexp_replace(regexp_replace(coalesce({c},''), '{CM}', ' ', 'g'), '\\s+', ' ', 'g'))"


def person_sql(c):
    return f"({c} <> '' and (regexp_matches({c}, '^[{NM.CYR}]{{2,}}\\s+[{NM.CYR}]\\.?$') or not {org_sql(c)}))"


query("strip_markup", f"select conv_id, turn, {strip_sql('text')} clean from conversations")(
    lambda b: b.table("conversations").select("conv_id", "turn", PV.strip_markup(F.col("text")).alias("clean")))
O.fragment("raw_names", f"select account_id, seq, raw, case when {TRADER_P.format(c='raw')} then trim(regexp_extract(raw, '(?i)^(ИП|ЖК|И\\.П\\.|IP)\\s*[.\\-—:]?\\s*(.+)$', 2), '\"«»''“” ') end trader from (select account_id, seq, {bare_sql('counterparty')} raw from {{{{txn}}}})")
O.fragment("person_names", f"select account_id, seq, raw, trader, coalesce(trader, case when {person_sql('trim(raw)')} then trim(raw) end) nm from {{{{raw_names}}}}")
OWN = ["Иванов Иван Иванович", "Иванов Иван", "Иванов И.", "Иван И.", "Иванов", "Иван", "Иванович"]
OWNED = f"(starts_with(account_id, 'U') and upper(raw) in ({', '.join(repr(v.upper()) for v in OWN)}))"
query("person_tags", f"""select account_id, person, display, '[PERSON_' || row_number() over (partition by account_id order by first_seq, person) || ']' tag from (
  select account_id, upper(nm) person, min(seq) first_seq, arg_min(nm, seq) display from {{{{person_names}}}} where nm <> '' and not {OWNED} group by 1,2)""")(lambda b: b.person_tags)
query("owner_variants", "select 'C' || c_custkey account_id, c_name variant, length(c_name)::int as length from customer union all select distinct account_id, variant, length(variant)::int from (select distinct account_id from {{txn}} where starts_with(account_id, 'U')), (select unnest([" + ", ".join(repr(v) for v in OWN) + "]) variant) where length(variant) >= 4")(
    lambda b: b.owner_variants)
query("mask_sole_trader", """select account_id, trader, tag, count(*) n from {{person_names}} p join {{person_tags}} t using (account_id) where t.person = upper(p.trader) group by 1,2,3""")(
    lambda b: b.txn.select("account_id", PV.trader_name(PV.strip_markup(F.col("counterparty"))).alias("trader")).filter("trader is not null").groupBy("account_id", "trader").agg(F.count("*").alias("n"))
    .withColumn("person", F.upper("trader")).join(b.person_tags.select("account_id", "person", "tag"), ["account_id", "person"]).drop("person"))
query("mask_counterparty", f"""select account_id, masked, count(*) n from (select p.account_id, case when raw = '' then '' when starts_with(p.account_id,'U') and upper(raw) in ({', '.join("'" + v.upper() + "'" for v in OWN)}) then '[CUSTOMER]'
  when trader is not null then 'ИП ' || tag when tag is not null then tag else raw end masked from {{{{person_names}}}} p left join {{{{person_tags}}}} t on t.account_id = p.account_id and t.person = upper(p.nm)) group by 1,2""")(
    lambda b: PV.mask_counterparty(b.txn, b.person_tags, b.owner_variants).groupBy("account_id", F.col("counterparty_masked").alias("masked")).agg(F.count("*").alias("n")))
EDGE_A, EDGE_Z = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
LEAKS = [("IIN", EDGE_A + r"\d{12}" + EDGE_Z), ("IBAN", EDGE_A + r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}" + EDGE_Z),
         ("CARD", EDGE_A + r"(?:\d{4}[\s*-]{0,3}){3}\d{4}" + EDGE_Z + r"|\*\d{4}" + EDGE_Z), ("PHONE", L.PHONE), ("PERSON_NAME", EDGE_A + f"[{NM.CYR}]{{2,}}\\s+[{NM.CYR}]\\.")]
query("leak_scan", "select doc_id, concat_ws(',', " + ", ".join(f"case when regexp_matches(text, '{p}') then '{k}' end" for k, p in LEAKS) + ") leaks from documents")(
    lambda b: b.table("documents").select("doc_id", PV.leaks(F.col("text")).alias("leaks")))


def doc_texts(b):
    return b.table("documents").select(F.col("source").alias("account_id"), F.col("doc_id").alias("seq"), "text")


def doc_masked(b):
    return PV.mask_text(doc_texts(b), b.person_tags, b.owner_variants)


# documents hold no names of the book: identifiers only, by one pass for each kind
ID_PASSES = [("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"), ("CARD", r"\b(?:\d{4}[\s*-]{0,3}){3}\d{4}\b|\*\d{4}\b"), ("PHONE", L.PHONE), ("IIN", r"\b\d{12}\b")]
before = "select source account_id, doc_id seq, text rest0 from documents"
for i, (_, pattern) in enumerate(ID_PASSES):
    before = f"select *, regexp_extract_all(rest{i}, '{pattern}') f{i}, regexp_replace(rest{i}, '{pattern}', chr({0x11 + i}), 'g') rest{i + 1} from ({before})"
O.fragment("id_passes", before)
O.fragment("id_finds", " union all ".join(f"select account_id, seq, '{k}' kind, generate_subscripts(f{i}, 1) i, unnest(f{i}) found from {{{{id_passes}}}}" for i, (k, _) in enumerate(ID_PASSES)))
O.fragment("id_tags", r"""select account_id, kind, id, '[' || kind || '_' || row_number() over (partition by account_id, kind order by s, i) || ']' tag from (
  select account_id, kind, upper(regexp_replace(found, '[\s*-]', '', 'g')) id, min(seq) s, arg_min(i, (seq, i)) i from {{id_finds}} group by 1, 2, 3)""")
query("identifier_tags", "select account_id, kind, tag from {{id_tags}}")(lambda b: PV.identifier_tags(doc_texts(b), b.person_tags, b.owner_variants).drop("display", "id"))
masked = f"rest{len(ID_PASSES)}"
for i, (k, _) in enumerate(ID_PASSES):
    masked = f"case when len(f{i}) = 0 then {masked} else list_reduce(list_transform(range(1, len(f{i}) + 2), lambda j: string_split({masked}, chr({0x11 + i}))[j] || coalesce(t{i}[j], '')), lambda a, b: a || b) end"
given = " ".join(f"left join (select account_id, seq, list(tag order by i) t{i} from {{{{id_finds}}}} f join {{{{id_tags}}}} using (account_id, kind) where kind = '{k}' and id = upper(regexp_replace(found, '[\\s*-]', '', 'g')) group by 1, 2) using (account_id, seq)" for i, (k, _) in enumerate(ID_PASSES))
query("mask_text", f"select account_id, seq, {masked} masked from {{{{id_passes}}}} {given}")(lambda b: doc_masked(b).rows.select("account_id", "seq", "masked"))
query("masked_leaks", "select account_id, seq, '' leaks from {{txn}}")(lambda b: (lambda v: masked_txn(b).rows.join(v, "account_id", "left").select(
    "account_id", "seq", PV.leaks(F.concat_ws(" | ", "description_masked", "counterparty_masked"), F.coalesce("variants", F.expr("cast(array() as array<string>)"))).alias("leaks")))(
    b.owner_variants.groupBy("account_id").agg(F.collect_set("variant").alias("variants"))))


def masked_txn(b):
    return PV.mask_table(b.txn, b.person_tags, b.owner_variants)


query("mask_report")(lambda b: (lambda m: PV.mask_report(b.person_tags, m.ids, m.customers))(masked_txn(b)))
query("masked_txn")(lambda b: masked_txn(b).rows.select("account_id", "seq", B.stamp().alias("at_time"), B.dbl("amount").alias("amount"), "currency", "type", F.coalesce("category", F.lit("")).alias("category"),
                                                        F.col("description_masked").alias("description"), F.col("counterparty_masked").alias("counterparty")))
# putting the names back must give the text that went in, with the owner's name in full
query("unmask_text", f"select account_id, seq, case when starts_with(account_id, 'U') then replace({bare_sql('description')}, 'Иванов Иван', 'Иванов Иван Иванович') else {bare_sql('description')} end restored from {{{{txn}}}}")(
    lambda b: (lambda m: PV.unmask_text(m.rows.select("account_id", "seq", F.col("description_masked").alias("masked")), b.person_tags, m.ids, b.account).select("account_id", "seq", "restored"))(masked_txn(b)))

# ---- statutes: documents stand in for articles
CODES = L.CODE_NAMES
ART = f"""select {listed(CODES)}[(doc_id % 5)::int + 1] code, doc_id::varchar || case when doc_id % 10 = 0 then '-1' else '' end as number, trim(regexp_replace(substr(text,1,60), '\\s+', ' ', 'g')) title, text,
  'https://law.example/' || doc_id::varchar url, doc_id, lang from documents"""
O.fragment("articles", ART)


def articles(b):
    d = b.table("documents")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("doc_id") % 5).cast("int") + 1)
    number = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 0, "-1").otherwise(""))
    return d.select(code.alias("code"), number.alias("number"), F.trim(F.regexp_replace(F.substring("text", 1, 60), r"\s+", " ")).alias("title"), "text",
                    F.concat(F.lit("https://law.example/"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("title_kk"), "doc_id", "lang")


def toks(c):
    low = f"replace(lower(coalesce({c},'')), 'ё', 'е')"
    ru, kk = "|".join(L.RU_SUFFIXES), "|".join(L.KK_SUFFIXES)
    return (f"list_transform(list_filter(regexp_extract_all({low}, '{L.WORD}'), lambda w: length(w) > 2 and w not in ({', '.join(repr(s) for s in L.STOPWORDS)})), "
            f"lambda w: case when regexp_matches(w, '[{L.KK_LETTERS}]') then regexp_replace(w, '^(.{{4,}}?)(?:{kk})$', '\\1') else regexp_replace(w, '^(.{{4,}}?)(?:{ru})$', '\\1') end)")


query("tokens", f"select doc_id, term, count(*) n from (select doc_id, unnest({toks('text')}) term from documents) group by 1,2")(
    lambda b: b.table("documents").select("doc_id", F.explode(ST.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n")))
O.fragment("postings", f"""select code, number, term, count(*) tf from (select code, number, unnest(list_concat({toks('title')}, {toks('title')}, {toks('title')}, {toks('text')})) term from {{{{articles}}}}) group by 1,2,3""")
query("search_index", "select term, count(*) df, sum(tf)::bigint tf from {{postings}} group by 1")(
    lambda b: ST.postings(articles(b)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")))


def bm25_sql(q):
    return f"""select query_id, code, number, score, rank_ as "rank" from (select *, row_number() over (partition by query_id order by score desc, d, len, code, number) rank_ from (
      select query_id, code, number, {O.rnd('raw/max(raw) over (partition by query_id)', 6)} score, contains(number,'-') d, length(title) len from (
        select query_id, code, number, sum(ln(1 + (n - df + 0.5)/(df + 0.5)) * (tf*2.5) / (tf + 1.5*(1 - 0.75 + 0.75*dl/avgdl))) * (case when contains(number,'-') then 0.9 else 1 end) raw from
          (select distinct query_id, unnest({toks('query')}) term from ({q})) join {{{{postings}}}} using (term) join (select term, count(*) df from {{{{postings}}}} group by 1) using (term)
          join (select code, number, sum(tf)::double dl from {{{{postings}}}} group by 1,2) using (code, number) cross join (select count(*)::double n from {{{{articles}}}}) cross join (select sum(tf)::double/(select count(*) from {{{{articles}}}}) avgdl from {{{{postings}}}})
        group by 1,2,3) join {{{{articles}}}} using (code, number))) where rank_ <= 5"""


query("bm25", bm25_sql("select item_id query_id, text as query from benchmark"))(
    lambda b: ST.bm25(articles(b), b.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))))
O.fragment("title_hits", bm25_sql("select doc_id query_id, title as query from {{articles}} where doc_id in (select doc_id from labels)"))
query("retrieval_metrics", f"""select lang, count(*) queries, count(r)/count(*) hit_at_k, {O.rnd('sum(coalesce(1.0::double/r, 0.0::double))/count(*)', 6)} mrr, {O.rnd('sum(case when r is null then 0.0::double else 1/5.0::double end)/count(*)', 6)} precision_at_k,
  {O.rnd('sum(case when r is null then 0.0::double else 1.0::double end)/count(*)', 6)} recall_at_k from (select a.doc_id, a.lang, h."rank" r from (select * from {{{{articles}}}} where doc_id in (select doc_id from labels)) a
  left join {{{{title_hits}}}} h on h.query_id = a.doc_id and h.code = a.code and h.number = a.number) group by 1""")(
    lambda b: (lambda asked: ST.retrieval_metrics(ST.bm25(articles(b), asked.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))),
                                                  asked.select(F.col("doc_id").alias("query_id"), "code", "number", "lang")))(
        articles(b).join(b.table("labels").select("doc_id"), "doc_id", "left_semi")))


def law_pages(b):
    """Statute pages: every document becomes two articles under portal headings."""
    n = F.col("doc_id").cast("string")
    head = lambda k: F.concat(F.lit('<h3 id="z'), n, F.lit(f'{k}">Статья '), n, F.lit(f"-{k}. Глава {k}</h3>"))
    half = F.floor(F.length("text") / 2).cast("int")
    html = F.concat(head(1), F.lit("<p>"), F.expr("substr(text, 1, cast(floor(length(text) / 2) as int))"), F.lit("</p>"), head(2), F.lit("<p>"), F.expr("substr(text, cast(floor(length(text) / 2) as int) + 1)"), F.lit("</p>"))
    return b.table("documents").select(F.lit("УК РК").alias("code"), F.concat(F.lit("https://law.example/"), n).alias("url"), html.alias("html")), half


query("split_articles")(lambda b: ST.split_articles(law_pages(b)[0]))
query("clean_html")(lambda b: b.table("pages").select("page_id", ST.clean_html(F.col("html")).alias("text")))
query("attach_titles", "select code, number, coalesce(b.text, '') title_kk from {{articles}} a left join benchmark b on b.item_id = a.doc_id")(
    lambda b: ST.attach_titles(articles(b).drop("title_kk"), articles(b).select("code", "number", "doc_id").join(
        b.table("benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("title_kk")), "doc_id")).select("code", "number", "title_kk"))
CITED = r"(?i)(?:(ЗРК О ПОД/ФТ|УК РК|НК РК|ГК РК|КоАП РК)\s*)?ст(?:атья|\.)\s*(\d+(?:-\d+)?)"
# texts that cite: a bare number before any code, the article of the document, and one that may not exist
CITING = "'ст. 5, ' || code || ' ст. ' || \"number\" || ', статья ' || (doc_id * 7 % 1500)::varchar || '; ' || text"
O.fragment("cited", f"""select text_id, pos, code, number from (select text_id, pos::int pos, last_value(nullif(c,'') ignore nulls) over (partition by text_id order by pos rows unbounded preceding) code, n as number from (
  select text_id, generate_subscripts(cs, 1) - 1 pos, unnest(cs) c, unnest(ns) n from (select text_id, regexp_extract_all(tx, '{CITED}', 1) cs, regexp_extract_all(tx, '{CITED}', 2) ns from (select doc_id text_id, {CITING} tx from {{{{articles}}}})))) where code is not null""")


def cited(b):
    a = articles(b)
    text = F.concat(F.lit("ст. 5, "), "code", F.lit(" ст. "), "number", F.lit(", статья "), (F.col("doc_id") * 7 % 1500).cast("string"), F.lit("; "), "text")
    return ST.parse_citations(a.select(F.col("doc_id").alias("text_id"), text.alias("text")))


query("parse_citations", "select * from {{cited}}")(lambda b: cited(b))
query("get_article", "select text_id, code, number, title from {{cited}} join {{articles}} using (code, number)")(
    lambda b: ST.get_article(cited(b).drop("pos"), articles(b)).select("text_id", "code", "number", "title"))
query("annotate_patterns", """select text_id, pos, c.code, c.number, case when a.url is null then 'article_not_found' else 'verified' end verdict, a.url is not null verified, coalesce(title,'') title, coalesce(url,'') url,
  case when a.url is null then '' else trim(substr(text,1,500)) || case when length(text) > 500 then '…' else '' end end excerpt, '' title_kk from {{cited}} c left join {{articles}} a on a.code = c.code and a.number = c.number""")(
    lambda b: ST.annotate(cited(b), articles(b)))
query("annotation_counts", """select text_id, count(*) citations, count(a.url) verified, count(*) - count(a.url) unverified from {{cited}} c left join {{articles}} a on a.code = c.code and a.number = c.number group by 1""")(
    lambda b: ST.annotation_counts(ST.annotate(cited(b), articles(b))))
# claims about articles: the right title, a wrong one, a quote that may be missing, a number that does not exist
CLAIM = """select code, case when doc_id % 4 = 3 then number || '9' else number end as number, case when doc_id % 4 = 1 then 'иное название нормы' else substr(title, 1, 20) end expected_title,
  case when doc_id % 4 = 2 then 'нет такой цитаты' else substr(text, 5, 30) end quote from {{articles}}"""
O.fragment("claims", CLAIM)
SAME = "trim(regexp_replace(replace(lower(coalesce({c},'')), 'ё', 'е'), '[^а-яa-z0-9әғқңөұүіһ]+', ' ', 'g'))"
query("verify_citations", f"""select code, number, case when url is null then 'article_not_found' when expected_title <> '' and not contains({SAME.format(c='title')}, {SAME.format(c='expected_title')}) and not contains({SAME.format(c='expected_title')}, {SAME.format(c='title')}) then 'title_mismatch'
  when quote <> '' and not contains({SAME.format(c='text')}, {SAME.format(c='quote')}) then 'quote_not_found' else 'verified' end verdict from {{{{claims}}}} left join {{{{articles}}}} using (code, number)""")(
    lambda b: (lambda a: ST.verify_citations(a.select(
        "code", F.when(F.col("doc_id") % 4 == 3, F.concat("number", F.lit("9"))).otherwise(F.col("number")).alias("number"),
        F.when(F.col("doc_id") % 4 == 1, "иное название нормы").otherwise(F.substring("title", 1, 20)).alias("expected_title"),
        F.when(F.col("doc_id") % 4 == 2, "нет такой цитаты").otherwise(F.substring("text", 5, 30)).alias("quote")), a).select("code", "number", "verdict"))(articles(b)))
query("unknown_citations", "select distinct code, number from {{cited}} where (code, number) not in (select code, number from {{articles}})")(
    lambda b: ST.unknown_citations(cited(b).select("code", "number").distinct(), articles(b).select("code", "number")))
