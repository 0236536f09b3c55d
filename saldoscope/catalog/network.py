"""The graph across accounts, and template clusters of descriptions."""

from ..operators import base as B
from ..operators import entities as E
from ..operators import templates as T
from ..sources.book import ACCOUNT_SQL, TABLES, TRANSFER_SQL
from . import oracle as O
from .finance import squeeze, subject_sql
from .language import LOW
from .registry import query

F = B.F
names = {t: t for t in TABLES}
STRONG = E.STRONG


def uid(c):
    return f"substr(regexp_replace(trim(regexp_replace(lower({squeeze(c)}), '[^a-zA-Zа-яА-ЯёЁ0-9\\s]', '', 'g')), '\\s+', '_', 'g'), 1, 150) || '_' || {subject_sql(c)}"


O.fragment("transfers", TRANSFER_SQL.format(**names))
O.fragment("owners", f"select account_id, owner, {uid('owner')} me from ({ACCOUNT_SQL.format(**names)})")
O.fragment("paid_edges", f"""select case when amount < 0 then me else other end src, case when amount < 0 then other else me end dst, count(*) n, sum(abs(amount))::double flow
  from (select *, {uid('counterparty')} other from {{{{transfers}}}}) join {{{{owners}}}} using (account_id) where amount <> 0 and other in (select me from {{{{owners}}}}) and other <> me group by 1, 2""")
query("entity_edges", "select * from {{paid_edges}}")(lambda b: b.entity_edges.withColumn("flow", F.col("flow") / 100.0))
query("entity_cycles", """select 3 as length, a.src || ' > ' || b.src || ' > ' || c.src as path, (a.flow + b.flow + c.flow)::decimal(18,2)::double flow
  from {{paid_edges}} a join {{paid_edges}} b on b.src = a.dst and a.src < b.src join {{paid_edges}} c on c.src = b.dst and c.dst = a.src and a.src < c.src
  union all select 4, a.src || ' > ' || b.src || ' > ' || c.src || ' > ' || d.src, (a.flow + b.flow + c.flow + d.flow)::decimal(18,2)::double
  from {{paid_edges}} a join {{paid_edges}} b on b.src = a.dst and a.src < b.src join {{paid_edges}} c on c.src = b.dst and a.src < c.src
  join {{paid_edges}} d on d.src = c.dst and d.dst = a.src and a.src < d.src and d.src <> b.src""")(lambda b: E.entity_cycles(b.entity_edges))
O.fragment("entity_links", "select src node, dst other from {{paid_edges}} union select dst, src from {{paid_edges}}")
before = "select node as node, node as label from {{entity_links}} group by 1"
for k in (1, 2, 3):
    O.fragment(f"label_round{k}", f"""select node, label from (select node, label, row_number() over (partition by node order by count(*) desc, label) r
      from {{{{entity_links}}}} join (select node other, label from ({before})) using (other) group by 1, 2) where r = 1""")
    before = f"select node, label from {{{{label_round{k}}}}}"
query("entity_communities", "select node, label community from {{label_round3}}")(lambda b: E.entity_communities(b.entity_edges, 3))
O.fragment("strong_links", f"select src a, dst b from {{{{paid_edges}}}} where flow >= {STRONG} union select dst, src from {{{{paid_edges}}}} where flow >= {STRONG}")
O.fragment("strong_reach", "select a, b from {{strong_links}} union select r.a, l.b from {{strong_reach}} r join {{strong_links}} l on r.b = l.a")
query("entity_components", "select a node, min(b) component from {{strong_reach}} group by 1")(lambda b: E.entity_components(b.strong_edges))

# ---- template clusters: all pairs of texts of an account
O.fragment("tpl_texts", f"""select * from (select *, sum("rows") over (partition by account_id) all_rows from (select account_id, {LOW} as text, count(*) as "rows", min(seq) as first
  from {{{{txn}}}} where {LOW} <> '' group by 1, 2)) where all_rows >= {T.LEAST_ROWS}""")
O.fragment("tpl_tf", f"""select account_id, first, "rows", all_rows, term, count(*) tf from (select account_id, first, "rows", all_rows, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) term
  from (select *, regexp_extract_all(text, '{T._WORD}') w from {{{{tpl_texts}}}})) group by all""")
O.fragment("tpl_used", f"""select account_id, term, ln((1.0 + all_rows) / (1.0 + df)) + 1.0 idf from (select *, row_number() over (partition by account_id order by often desc, term) k from (
  select account_id, term, all_rows, sum("rows") df, sum("rows" * tf) often from {{{{tpl_tf}}}} group by 1, 2, 3 having sum("rows") >= {T.MIN_ROWS_OF_TERM} and sum("rows") <= {T.MAX_SHARE_OF_TERM} * all_rows)) where k <= {T.FEATURES}""")
O.fragment("tpl_w", """select account_id, first, "rows", term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by account_id, first)) w from {{tpl_tf}} join {{tpl_used}} using (account_id, term)""")
O.fragment("tpl_near", f"""select a.account_id, a.first a, b.first b, any_value(b."rows") as "rows" from {{{{tpl_w}}}} a join {{{{tpl_w}}}} b using (account_id, term) group by 1, 2, 3 having sum(a.w * b.w) >= {T.SIMILAR} - 1e-9""")
O.fragment("tpl_core", f"select account_id, a from {{{{tpl_near}}}} group by 1, 2 having sum(\"rows\") >= {T.CORE}")
O.fragment("tpl_reach", """select account_id, a, a b from {{tpl_core}} union select r.account_id, r.a, n.b from {{tpl_reach}} r join {{tpl_near}} n on n.account_id = r.account_id and n.a = r.b
  join {{tpl_core}} c on c.account_id = n.account_id and c.a = n.b""")
O.fragment("tpl_inner", "select account_id, a as first, min(b) as cluster from {{tpl_reach}} group by 1, 2")
O.fragment("tpl_member", """select account_id, first, cluster from {{tpl_inner}} union all select n.account_id, n.b, min(i.cluster) from {{tpl_near}} n join {{tpl_inner}} i on i.account_id = n.account_id and i.first = n.a
  where not exists (select 1 from {{tpl_core}} c where c.account_id = n.account_id and c.a = n.b) group by 1, 2""")
query("template_members", "select account_id, text, first, cluster from {{tpl_texts}} join {{tpl_member}} using (account_id, first)")(lambda b: b.template_members)
query("template_clusters", f"""select account_id, cluster, count(*) as "rows", count(distinct party) as counterparties, arg_min(text, first) as sample, case when count(distinct party) >= 5 then 'high' else 'medium' end severity,
  least(20.0::double, 5 + count(distinct party) * 1.5::double) impact from (select account_id, {LOW} as text, trim(coalesce(counterparty, '')) party from {{{{txn}}}})
  join {{{{template_members}}}} using (account_id, text) group by 1, 2 having count(*) >= {T.LEAST_CLUSTER} and count(distinct party) >= {T.LEAST_PARTIES}""")(lambda b: b.template_clusters)
