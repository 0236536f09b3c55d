"""Template clusters: descriptions of an account that say nearly the same, as term vectors.

Terms are words and pairs of words with TF-IDF weights; the vocabulary of an account are its
``FEATURES`` most frequent terms. Rows are neighbours from a cosine of ``SIMILAR`` on, and rows
with ``CORE`` neighbours (themselves included) form clusters by density.

All work is on distinct vectors with a number of rows, so equal texts cost one row and form
no pairs. Similar vectors are found without comparing all: terms are ordered rarest first,
and the prefix of a vector ends where the rest is shorter than ``SIMILAR``; two similar vectors have their
first common term in both prefixes, where they are joined and compared exactly.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .base import KEY, topk
from .components import components

#: Settings of the vectors and of the clustering (fixed values).
FEATURES, MIN_ROWS_OF_TERM, MAX_SHARE_OF_TERM, SIMILAR, CORE = 500, 2, 0.95, 0.85, 3
LEAST_ROWS, LEAST_PARTIES, LEAST_CLUSTER = 5, 3, 5
#: Sums of squares in another order differ by less.
_NOISE = 1e-9
_WORD = r"[\p{L}\p{N}_]{2,}"


def _terms(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def _texts(txn: DataFrame) -> DataFrame:
    """(account_id, text, rows, first): distinct descriptions; accounts of a few rows have none."""
    rows = txn.select(KEY, "seq", F.lower(F.trim(F.coalesce("description", F.lit("")))).alias("text")).where("text <> ''")
    texts = rows.groupBy(KEY, "text").agg(F.count("*").alias("rows"), F.min("seq").alias("first"))
    enough = texts.groupBy(KEY).agg(F.sum("rows").alias("all_rows")).where(F.col("all_rows") >= LEAST_ROWS)
    return texts.join(enough, KEY)


def term_vectors(txn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(account_id, text, first, id) of every text with a vector, and (account_id, id, rows, vec) of the distinct vectors.

    ``vec`` lists (ord, w): terms by how rare they are in the account, weights of length one.
    """
    texts = durable(_texts(txn))
    counted = texts.select(KEY, "first", "rows", "all_rows", F.explode(_terms(F.col("text"))).alias("term")).groupBy(KEY, "first", "rows", "all_rows", "term").agg(F.count("*").alias("tf"))
    used = counted.groupBy(KEY, "term").agg(F.sum("rows").alias("df"), F.sum(F.col("rows") * F.col("tf")).alias("often"), F.first("all_rows").alias("all_rows"))
    used = used.where((F.col("df") >= MIN_ROWS_OF_TERM) & (F.col("df") <= MAX_SHARE_OF_TERM * F.col("all_rows")))
    used = topk(used, [KEY], [F.desc("often"), "term"], FEATURES, "_rank").drop("_rank")
    idf = F.log((1.0 + F.col("all_rows")) / (1.0 + F.col("df"))) + 1.0
    used = used.select(KEY, "term", idf.alias("idf"), F.row_number().over(Window.partitionBy(KEY).orderBy("df", "term")).alias("ord"))
    raw = counted.join(used, [KEY, "term"]).groupBy(KEY, "first", "rows").agg(F.array_sort(F.collect_list(F.struct("ord", (F.col("tf") * F.col("idf")).alias("w")))).alias("raw"))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    vec = raw.withColumn("length", length).withColumn("vec", F.transform("raw", lambda x: F.struct(x["ord"].alias("ord"), (x["w"] / F.col("length")).alias("w")))).drop("raw", "length")
    vec = durable(vec)
    kept = durable(vec.groupBy(KEY, "vec").agg(F.min("first").alias("id"), F.sum("rows").alias("rows")))
    members = vec.join(kept.select(KEY, "vec", "id"), [KEY, "vec"]).select(KEY, "id", "first")
    return texts.join(members, [KEY, "first"]).select(KEY, "text", "first", "id"), kept.select(KEY, "id", "rows", "vec")


def similar_pairs(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(account_id, a, b): ids of vectors with a cosine of ``similar`` or more, a before b, each pair once."""
    bound = similar - _NOISE
    rest = lambda i: F.aggregate(F.slice("vec", i + 1, F.greatest(F.size("vec"), F.lit(1))), F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    prefix = F.filter("vec", lambda x, i: rest(i) >= bound * bound)
    spread = vectors.select(KEY, "id", "vec", F.transform("vec", lambda x: x["ord"]).alias("ords"), F.explode(F.transform(prefix, lambda x: x["ord"])).alias("ord"))
    a = spread.select(KEY, "ord", F.col("id").alias("a"), F.col("vec").alias("va"), F.col("ords").alias("oa"))
    b = spread.select(KEY, "ord", F.col("id").alias("b"), F.map_from_entries("vec").alias("mb"), F.col("ords").alias("ob"))
    met = a.join(b, [KEY, "ord"]).where("a < b").where(F.element_at(F.array_intersect("oa", "ob"), 1) == F.col("ord"))
    cosine = F.aggregate("va", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.col("mb")[x["ord"]], F.lit(0.0)))
    return met.where(cosine >= bound).select(KEY, "a", "b")


def density_clusters(vectors: DataFrame, pairs: DataFrame, core: int = CORE) -> DataFrame:
    """(account_id, id, cluster): clusters by density, named after their first core vector.

    A vector is core if it and its neighbours have ``core`` rows; core vectors that are
    neighbours share a cluster, and another vector joins the first cluster it touches.
    """
    near = pairs.union(pairs.select(KEY, F.col("b"), F.col("a")))
    around = near.join(vectors.select(KEY, F.col("id").alias("b"), "rows"), [KEY, "b"]).groupBy(KEY, F.col("a").alias("id")).agg(F.sum("rows").alias("around"))
    cores = durable(vectors.join(around, [KEY, "id"], "left").where(F.col("rows") + F.coalesce("around", F.lit(0)) >= core).select(KEY, "id"))
    from_core = near.join(cores.withColumnRenamed("id", "a"), [KEY, "a"], "left_semi")
    mark = cores.select(KEY, F.col("id").alias("b"), F.lit(True).alias("both"))
    reach = durable(from_core.join(mark, [KEY, "b"], "left"))
    node = lambda c: F.struct(KEY, F.col(c).alias("id"))
    joined = components(reach.where("both").select(node("a").alias("src"), node("b").alias("dst")))
    named = joined.select(F.col("node.account_id").alias(KEY), F.col("node.id").alias("id"), F.col("component.id").alias("c"))
    inner = durable(cores.join(named, [KEY, "id"], "left").select(KEY, "id", F.coalesce("c", "id").alias("cluster")))
    border = reach.where("both is null").join(inner.select(KEY, F.col("id").alias("a"), "cluster"), [KEY, "a"]).groupBy(KEY, F.col("b").alias("id")).agg(F.min("cluster").alias("cluster"))
    return inner.unionByName(border)


def template_members(txn: DataFrame) -> DataFrame:
    """(account_id, text, first, cluster): every description that lies in a cluster."""
    texts, vectors = term_vectors(txn)
    clusters = density_clusters(vectors, similar_pairs(vectors))
    return texts.join(clusters, [KEY, "id"]).select(KEY, "text", "first", "cluster")


def template_clusters(txn: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters of at least five rows from three counterparties: their first text, sizes, severity and impact."""
    rows = txn.select(KEY, F.lower(F.trim(F.coalesce("description", F.lit("")))).alias("text"), F.trim(F.coalesce("counterparty", F.lit(""))).alias("party"))
    seen = rows.groupBy(KEY, "text", "party").agg(F.count("*").alias("n")).join(members, [KEY, "text"])
    parties = seen.groupBy(KEY, "cluster", "party").agg(F.sum("n").alias("n"), F.min(F.struct("first", "text")).alias("at"))
    out = parties.groupBy(KEY, "cluster").agg(F.sum("n").alias("rows"), F.count("*").alias("counterparties"), F.min("at")["text"].alias("sample"))
    out = out.where((F.col("rows") >= LEAST_CLUSTER) & (F.col("counterparties") >= LEAST_PARTIES))
    return out.withColumn("severity", F.when(F.col("counterparties") >= 5, "high").otherwise("medium")).withColumn("impact", F.least(F.lit(20.0), 5.0 + F.col("counterparties") * 1.5))
