"""Repeated passages by winnowing over line hashes.

A document is its non-blank lines, each with a hash (of its words, with one blank between) and
their number; words are divided by white space of any kind, so tabs, repeated blanks and a
carriage return at the end make no difference. The window from a line is the shortest run of lines from there with
``MIN_WORDS`` words or more; the line with the smallest hash of each window is a fingerprint
(the first of equals). Every repeated run of MIN_WORDS words holds a whole window, so both of
its places have the same fingerprints.

Fingerprints are joined by hash with their first place in the collection, by (doc_id, line).
From there a match is extended line by line both ways, until MIN_WORDS words are passed:
neighbouring fingerprints are never further apart, so the extensions of a run's fingerprints
cover it. A match of MIN_WORDS words or more is a later repeated run, its lines are deleted.

A short line may have its first place elsewhere than the run it ends. So windows of several
(short) lines are looked up as a whole, too, from each line on and up to each line. Together
this deletes exactly the lines of all runs of MIN_WORDS words or more that stood earlier.

The first place of each hash is found by an aggregate that combines before the shuffle; the
join with it is one row to many and may be split where a line is very common. No pairs of
later places are formed.

Defined results: blank lines stay. A document all of whose words are deleted is dropped when
``drop_empty`` is set. Null texts stay null; documents with fewer than MIN_WORDS words are
never changed. Rows with the same doc_id and text are one place. All is DataFrame functions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, tune

MIN_WORDS = 8
REACH = MIN_WORDS  # lines: each has a word at least


def bare(text: Column) -> Column:
    """A text with one blank for each other white space within its lines; most texts are left as they are."""
    return F.when(text.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)


def line_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key (hash of the text), lines: array of (h, w) of the non-blank lines."""
    lines = F.transform(F.split("__bare", "\n", -1), lambda l: F.struct(F.xxhash64(F.trim(l)).alias("h"), F.size(F.split(F.trim(l), " ", -1)).alias("w"), (F.trim(l) != "").alias("full")))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), bare(F.col(text)).alias("__bare"))
    rows = docs.select("doc_id", "key", F.filter(lines, lambda x: x["full"]).alias("lines"))
    return rows.where("size(lines) > 0").select("doc_id", "key", F.transform("lines", lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"))).alias("lines"))


_POSITIONS = "if(size(lines) > 0, sequence(0, size(lines) - 1), cast(array() as array<int>))"


def _shortest(side: str, finish: str) -> str:
    """SQL: fold of the shortest start of ``side`` with MIN_WORDS words; ``acc`` has n, w and
    the first of the smallest hashes with its place."""
    return f"""aggregate({side}, named_struct('n', 0, 'w', 0, 'h', cast(null as bigint), 'at', 0),
        (acc, x) -> if(acc.w >= {MIN_WORDS}, acc, named_struct('n', acc.n + 1, 'w', acc.w + x.w,
            'h', if(acc.h is null or x.h < acc.h, x.h, acc.h), 'at', if(acc.h is null or x.h < acc.h, acc.n, acc.at))),
        acc -> {finish})"""


def fingerprints(runs: DataFrame) -> DataFrame:
    """doc_id, key, at, h, w and, on either side, the nearest lines (h, w), nearest first, as
    many as it takes to have MIN_WORDS words."""
    window = _shortest(f"slice(lines, i + 1, {REACH})", f"if(acc.w >= {MIN_WORDS}, i + acc.at, -1)")
    at = F.array_distinct(F.filter(F.expr(f"transform({_POSITIONS}, i -> {window})"), lambda x: x >= 0))
    # explode() would make Spark compute the windows a second time, to filter out empty arrays first
    chosen = runs.select("doc_id", "key", "lines", F.explode_outer(at).alias("at")).where("at is not null")
    chosen = chosen.withColumn("b", F.reverse(F.slice("lines", F.greatest(F.col("at") + 1 - REACH, F.lit(1)), F.least(F.col("at"), F.lit(REACH)))))
    chosen = chosen.withColumn("a", F.slice("lines", F.col("at") + 2, F.lit(REACH))).withColumn("here", F.get("lines", F.col("at"))).drop("lines")
    for side in ("b", "a"):
        chosen = chosen.withColumn(side, F.expr(f"slice({side}, 1, {_shortest(side, 'acc.n')})"))
    return chosen.select("doc_id", "key", "at", F.col("here.h").alias("h"), F.col("here.w").alias("w"), *[F.col(f"{side}.{x}").alias(f"{x}{side}") for side in ("b", "a") for x in ("h", "w")])


def windows(runs: DataFrame) -> DataFrame:
    """doc_id, key, h, first, last: windows of two lines or more, from each line on and up to
    each line; h covers all of the window's lines."""
    fore = _shortest(f"slice(lines, i + 1, {REACH})", f"if(acc.w >= {MIN_WORDS} and acc.n > 1, named_struct('first', i, 'last', i + acc.n - 1), null)")
    back = _shortest(f"reverse(slice(lines, greatest(i + 2 - {REACH}, 1), least(i + 1, {REACH})))", f"if(acc.w >= {MIN_WORDS} and acc.n > 1, named_struct('first', i - acc.n + 1, 'last', i), null)")
    every = F.expr(f"array_distinct(filter(concat(transform({_POSITIONS}, i -> {fore}), transform({_POSITIONS}, i -> {back})), x -> x is not null))")
    out = runs.select("doc_id", "key", "lines", F.explode_outer(every).alias("x")).where("x is not null")
    return out.select("doc_id", "key", F.xxhash64(F.slice("lines", F.col("x.first") + 1, F.col("x.last") - F.col("x.first") + 1)).alias("h"), "x.first", "x.last")


def _equal_lines(a: str, b: str):
    """How many elements agree from the start of two arrays."""
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), False)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key, first, last: runs of non-blank lines (counted from 0) that stood earlier."""
    tune(docs.sparkSession)
    lines = line_runs(docs, text, doc_id)
    prints = cut(fingerprints(lines))
    place = F.struct("doc_id", "key", "at", "hb", "ha")
    origin = prints.groupBy("h").agg(F.min(place).alias("o"), F.count("*").alias("n")).where("n > 1").select("h", "o")
    later = prints.join(origin, "h").where(F.struct("doc_id", "key", "at") > F.struct("o.doc_id", "o.key", "o.at"))
    up, down = _equal_lines("hb", "o.hb"), _equal_lines("ha", "o.ha")
    total = lambda side, n: F.aggregate(F.slice(side, F.lit(1), n), F.lit(0), lambda s, x: s + x)
    run = later.withColumn("up", up).withColumn("down", down)
    run = run.where(F.col("w") + total("wb", F.col("up")) + total("wa", F.col("down")) >= MIN_WORDS)
    found = run.select("doc_id", "key", (F.col("at") - F.col("up")).alias("first"), (F.col("at") + F.col("down")).alias("last"))
    # exact check of short lines: their windows as a whole, each with its own first place
    short = cut(windows(lines))
    first = short.groupBy("h").agg(F.min(F.struct("doc_id", "key", "first")).alias("o"), F.count("*").alias("n")).where("n > 1").select("h", "o")
    again = short.join(first, "h").where(F.struct("doc_id", "key", "first") > F.struct("o.doc_id", "o.key", "o.first"))
    return found.union(again.select("doc_id", "key", "first", "last"))


def deduplicate_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", drop_empty: bool = False) -> DataFrame:
    """``docs`` without later repeated runs, with n_deleted: how many lines were deleted."""
    runs = repeated_runs(docs, text, doc_id)
    gone = runs.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "__gone")
    rows = docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key")), "left")
    rows = rows.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split(F.col(text), "\n", -1)))
    spaced = F.split(F.when(F.col("__gone").isNotNull(), bare(F.col(text))), "\n", -1)
    full = F.filter(F.transform(spaced, lambda l, i: F.when(F.trim(l) != "", i)), lambda i: i.isNotNull())
    rows = rows.withColumn("__full", full)
    dropped = F.transform("__gone", lambda k: F.get("__full", k))
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), dropped)
    left = F.array_join(F.transform(keep, lambda i: F.get("__lines", i)), "\n")
    out = rows.withColumn("n_deleted", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    out = out.withColumn("n_deleted", F.when(F.col("__gone").isNull(), 0).otherwise(F.col("n_deleted")).cast("long"))
    if drop_empty:
        out = out.where(F.col("__gone").isNull() | (F.size("__gone") < F.size("__full")))
    return out.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left)).drop("__id", "__key", "__gone", "__lines", "__full")
