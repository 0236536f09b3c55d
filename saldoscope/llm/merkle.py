"""Document fingerprints: a Merkle tree over paragraphs and sections.

All cuts are made by content, so an insertion moves few of them: a leaf is a run of words up to
one whose hash is divisible by ``LEAF_WORDS`` (``LONGEST`` words at most), a paragraph is a line,
a section is a run of paragraphs up to one whose hash is divisible by ``SECTION_LINES``. A
paragraph's hash covers its leaves, a section's hash its paragraphs, the root all sections. Nodes have
two 64-bit hashes with different seeds, the root is the SHA-256 of those of the sections: equal
roots mean equal texts. The fingerprint is the tree; the root is what is printed of it.

Trees are compared by descending. Where roots differ, the sections that the other tree lacks
are opened, and of those the paragraphs that the other tree lacks: these are the edited
paragraphs. Their leaves that the other tree lacks are lost; likeness is the share of the
distinct leaves of both trees that are not lost.

Defined results: a null text is the empty text: one empty paragraph, no leaves. Two trees
without leaves have likeness 1. All is DataFrame functions. Opening tests each section or
paragraph against the list of those that differ, which takes (lines of a text) x (differing ones)
comparisons of numbers at most, and none where all or nothing differs.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut, tune

LEAF_WORDS, LONGEST, SECTION_LINES = 4, 16, 8
WORD = r"\S++\s*+|\s++"


def with_tree(rows: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``rows`` with the tree of a text: <prefix>sections (h, first, n), paragraphs (hashes), leaves
    (numbers, for each paragraph), all_leaves (distinct), root."""
    p, s, v = f"{prefix}paragraphs", f"{prefix}sections", f"{prefix}leaves"
    rows = rows.withColumn("__lines", F.split(F.col(text), "\n", -1))
    rows = rows.withColumn("__words", F.transform("__lines", lambda l: F.regexp_extract_all(l, F.lit(WORD), F.lit(0))))
    none = F.expr("cast(array() as array<int>)")
    rows = rows.withColumn("__ends", F.transform("__words", lambda w: F.when(F.size(w) == 0, none).otherwise(
        F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == F.size(w)) | (F.xxhash64(F.get(w, i - 1)) % LEAF_WORDS == 0)))))

    def leaf(w, start, length, k):
        return (F.xxhash64(F.slice(w, start + 1 + k * LONGEST, F.least(F.lit(LONGEST), length - k * LONGEST))) % 2147483647).cast("int")

    def leaves_of(w, ends):
        def run(end, j):
            start = F.coalesce(F.get(ends, j - 1), F.lit(0))
            return F.transform(F.sequence(F.lit(0), F.floor((end - start - 1) / LONGEST).cast("int")), lambda k: leaf(w, start, end - start, k))
        return F.flatten(F.transform(ends, run))

    rows = rows.withColumn(v, F.zip_with("__words", "__ends", leaves_of)).drop("__words", "__ends")
    rows = rows.withColumn(p, F.transform(v, lambda x: F.xxhash64(x))).withColumn("__wide", F.transform("__lines", lambda l: F.xxhash64(F.lit(1), l)))
    rows = rows.withColumn("__cuts", F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: (i == F.size(p)) | (F.get(p, i - 1) % SECTION_LINES == 0)))

    def section(end, j):
        first = F.coalesce(F.get("__cuts", j - 1), F.lit(0)) + 1
        n = end - first + 1
        return F.struct(F.xxhash64(F.slice(p, first, n)).alias("h"), F.xxhash64(F.lit(1), F.slice("__wide", first, n)).alias("w"), first.alias("first"), n.alias("n"))

    rows = rows.withColumn(s, F.transform("__cuts", section))
    rows = rows.withColumn(f"{prefix}all_leaves", F.array_distinct(F.flatten(v)))
    root = F.sha2(F.concat_ws(",", F.size(p).cast("string"), F.array_join(F.transform(s, lambda x: F.concat(F.hex(x["h"]), F.hex(x["w"]))), ",")), 256)
    return rows.withColumn(f"{prefix}root", root).drop("__lines", "__wide", "__cuts")


def _chosen(items: Column, hashes: Column, every: Column, of) -> Column:
    """Items whose hash is among ``hashes``, which are all different ones of ``every``."""
    return F.when(F.size(hashes) == 0, F.slice(items, 1, 0)).when(F.size(hashes) == F.size(F.array_distinct(every)), items).otherwise(F.filter(items, lambda x: F.array_contains(hashes, of(x))))


def with_edits(rows: DataFrame, old: str, new: str, out: str) -> DataFrame:
    """``rows`` with <out>: numbers, from 0 on, of the paragraphs of tree ``new`` that tree ``old`` lacks."""
    hashes = lambda side: F.transform(f"{side}sections", lambda x: x["h"])
    rows = rows.withColumn("__mine", hashes(new)).withColumn("__open", F.array_except(F.col("__mine"), hashes(old)))
    opened = _chosen(F.col(f"{new}sections"), F.col("__open"), F.col("__mine"), lambda x: x["h"])
    rows = rows.withColumn("__at", F.flatten(F.transform(opened, lambda x: F.sequence(x["first"] - 1, x["first"] + x["n"] - 2))))
    rows = rows.withColumn("__mine", F.transform("__at", lambda i: F.get(f"{new}paragraphs", i))).withColumn("__open", F.array_except(F.col("__mine"), F.col(f"{old}paragraphs")))
    return rows.withColumn(out, _chosen(F.col("__at"), F.col("__open"), F.col("__mine"), lambda i: F.get(f"{new}paragraphs", i))).drop("__mine", "__open", "__at")


def with_likeness(rows: DataFrame, a: str, b: str, out: str, edits: str | None = None) -> DataFrame:
    """``rows`` with the likeness of two trees, and the edited paragraphs of ``b`` if a name is given."""
    rows = with_edits(with_edits(rows, b, a, "__gone"), a, b, edits or "__new")
    lost = lambda side, at, other: F.size(F.array_except(F.flatten(F.transform(at, lambda i: F.get(f"{side}leaves", i))), F.col(f"{other}all_leaves")))
    total = F.size(f"{a}all_leaves") + F.size(f"{b}all_leaves")
    share = 1 - (lost(a, "__gone", b) + lost(b, edits or "__new", a)) / total
    return rows.withColumn(out, F.when(total == 0, 1.0).otherwise(share).cast("double")).drop("__gone", "__new")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the tree of every text; ``root`` is the fingerprint."""
    tune(docs.sparkSession)
    return with_tree(docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))), "__text").drop("__text")


def neighbours(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): each id with the next larger one; the largest with the smallest.

    Ids are dealt by range, so no task holds all: each range finds its own neighbours, and
    the last of a range takes the first of the next.
    """
    width = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the table is written once, so that the ranges are drawn once
    ranged = cut(ids.select("doc_id").distinct().repartitionByRange(width, "doc_id").select("doc_id", F.spark_partition_id().alias("part")))
    near = ranged.withColumn("next_id", F.lead("doc_id").over(W.partitionBy("part").orderBy("doc_id")))
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))  # one row per range
    after = firsts.withColumn("after", F.coalesce(F.lead("first").over(W.orderBy("part")), F.min("first").over(W.partitionBy(F.lit(1))))).select("part", "after")
    return near.join(F.broadcast(after), "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def compare_with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document, its edited text and the next document, compared by their trees.

    The edited text has the last quarter of the code points replaced by the first as many of
    the next document by doc_id (after the largest comes the smallest). Of rows that share a
    doc_id, the one whose text has the smallest hash is the next document of its predecessor. Rows without
    doc_id have no next document: nothing replaces their last quarter, near_next is 0.

    Texts are shuffled by doc_id once. Of a next document only the head that is needed and its
    tree travel to its predecessor.
    """
    tune(docs.sparkSession)
    # an id that needs no cast gets no alias: Spark shares a shuffle only between equal plans
    plain = doc_id == "doc_id" and dict(docs.dtypes)[doc_id] == "bigint"
    rows = docs.select(F.col(doc_id) if plain else F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = cut(rows.where("doc_id is not null").select("doc_id", F.length("text").cast("long").alias("n"), F.xxhash64("text").alias("h"))
                .groupBy("doc_id").agg(F.floor(F.max("n") / 4).alias("k"), F.min("h").alias("h")))
    order = neighbours(known)
    asked = (order.join(known.select("doc_id", "k"), "doc_id").select(F.col("next_id").alias("id"), F.col("doc_id").alias("for_id"), "k")
             .join(known.select(F.col("doc_id").alias("id"), "h"), "id"))
    asked = cut(asked)
    # both joins read the same rows by doc_id, so that they share one shuffle of the texts
    present, absent = rows.where("doc_id is not null"), rows.where("doc_id is null")
    # (a comparison by bits is no join key, so the shuffle stays one by doc_id)
    nexts = present.join(asked, present.doc_id == asked.id).where(F.xxhash64("text").bitwiseXOR(F.col("h")) == 0)
    tree = ["sections", "paragraphs", "leaves", "all_leaves"]
    heads = with_tree(nexts, "text").select("for_id", F.left("text", F.col("k").cast("int")).alias("head"), *[F.col(c).alias(f"next_{c}") for c in tree])
    heads = heads.dropDuplicates(["for_id"])
    paired = present.join(heads, present.doc_id == heads.for_id, "left").select("doc_id", "text", "head", *[f"next_{c}" for c in tree])
    both = paired.unionByName(absent, allowMissingColumns=True).withColumn("n_chars", F.length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - k), F.left(F.coalesce("head", F.lit("")), k))
    both = with_tree(with_tree(both.withColumn("edited", edited), "text"), "edited", "edited_")
    both = with_likeness(both, "", "edited_", "near_edited", "edited_at")
    return with_likeness(both, "", "next_", "near_next").withColumn("near_next", F.coalesce("near_next", F.lit(0.0)))
