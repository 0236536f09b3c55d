"""Groups of spelling variants: dynamic programming over sorted lists of words.

Two words are near if one inserted, deleted or replaced code point turns one into the other. A
word's form is its most frequent near word, if that is at least ``RATIO`` times as frequent; the
root is where the forms end.

Near words are found in groups. A single edit leaves the first or the second half of the shorter
word as it is, so near words share a head or a tail of half that length. A group of more than
``GROUP`` words is split again: the part not yet known to be equal is halved, and near words
share its first or its second half, too. That ends with one free place, of which an alphabet
allows few words; groups are therefore bounded and no pair is lost.

Inside a group the words are sorted (backwards, if they share a tail). Every word walks through
the list behind it and keeps the rows of its edit matrix, three cells around the diagonal, for
the word it stands at: the next word reuses the rows of the prefix it shares with the last one
(their LCP). Where all three cells exceed one edit, all words with that prefix are skipped. All
words of a batch of groups walk at the same time, as numpy arrays.

Defined results: a null or empty text has no words; a null id is an empty string in the rule for
spoilt words; repeated rows count again; words of any length are compared whole; ties go to the
smallest word in code point order; an empty table gives no rows. Other columns take no part.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, tune

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Words of a group that is not split further, and words that walk at the same time.
GROUP, BATCH = 2048, 16_384
#: Prefix lengths with a table of where to go on after a skip; behind longer ones the walk goes step by step.
_TABLED = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]"


def spoilt(run: Column, doc_id: Column) -> Column:
    """One in 31 runs without one of its letters; the checksum of id and run decides."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", spoil: bool = False) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, that are long and frequent enough."""
    tune(docs.sparkSession)
    # outer: explode() would extract the runs a second time, to filter out empty arrays first
    runs = docs.select(F.col(doc_id).alias("id"), F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(RUN + "{%d,}+" % MIN_LENGTH), F.lit(0))).alias("run")).where("run is not null")
    runs = runs.withColumn("word", F.translate("run", _UPPER, _LOWER))
    if spoil:
        runs = runs.withColumn("word", spoilt(F.col("word"), F.col("id"))).where(F.length("word") >= MIN_LENGTH)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _key() -> Column:
    """Group of a word: class, and the equal head and tail."""
    return F.xxhash64("s", "head", "tail", F.left("word", F.col("head")), F.right("word", F.col("tail")))


def _split(rows: DataFrame) -> DataFrame:
    """Every word twice: with one more half of its free part equal from the left, or from the right."""
    free = F.col("s") - F.col("head") - F.col("tail")
    half = F.floor(free / 2).cast("int")
    ways = F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("tail") + free - half).alias("tail")))
    out = rows.select("word", "n", "s", F.explode(ways).alias("w")).select("word", "n", "s", "w.head", "w.tail")
    return out.withColumn("key", _key())


def grouped(words: DataFrame) -> DataFrame:
    """(word, n, s, head, tail, key): every word in its groups, each of a bounded number of words.

    ``s`` is the length of the shorter words of a group; the others are as long or longer by one.
    """
    size = F.length("word")
    start = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("s")).select("*", F.lit(0).alias("head"), F.lit(0).alias("tail")).where(F.col("s") >= MIN_LENGTH)
    done, rest = [], _split(start)
    while True:
        rest = cut(rest)
        big = rest.groupBy("key").agg(F.count("*").alias("_c"), F.max(F.col("s") - F.col("head") - F.col("tail")).alias("_f")).where(f"_c > {GROUP} and _f > 1").select("key")
        big = cut(big)
        if big.isEmpty():
            done.append(rest)
            break
        done.append(rest.join(big, "key", "left_anti").select(rest.columns))
        rest = _split(rest.join(big, "key", "left_semi"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and the offsets of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def _shared(codes: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """LCP of each word with the one before; -1 for the first of a group, and behind the last word."""
    n = len(at) - 1
    lengths = np.diff(at)
    lcp = np.full(n + 1, -1, np.int64)
    alive = np.flatnonzero(group[1:] == group[:-1]) + 1
    lcp[alive] = 0
    depth = 0
    while len(alive):
        alive = alive[np.minimum(lengths[alive], lengths[alive - 1]) > depth]
        alive = alive[codes[at[alive] + depth] == codes[at[alive - 1] + depth]]
        depth += 1
        lcp[alive] = depth
    return lcp


def near_pairs(words: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of words one edit apart, within groups; words are sorted in each group."""
    n = len(words)
    codes, at = _codes(words)
    lengths = np.diff(at)
    lcp = _shared(codes, at, group)
    padded = np.concatenate([codes, np.zeros(2, np.uint32)])
    # where to go on behind all words that share the first d + 1 letters with word j
    every = np.arange(n)
    behind = np.empty((int(min(lcp.max(initial=0), _TABLED)) + 1, n), np.int64)
    for d in range(len(behind)):
        low = np.flatnonzero(lcp <= d)
        behind[d] = low[np.searchsorted(low, every, "right")]
    # rows of the edit matrix by walker and depth; a word against itself has 1, 0, 1
    base = at[:-1] + 3 * every
    rows = np.tile(np.array([1, 0, 1], np.uint8), (int(at[-1]) + 3 * n + 1, 1))
    rows[base, 0] = 9
    q = every[lcp[1:] >= 0]
    j = q + 1
    d = lcp[j]
    left, right = [], []
    while len(q):
        start, size = at[q], lengths[q]
        old = rows[base[q] + d]
        x = padded[at[j] + d]
        whole = d >= lengths[j]  # the next word is this one and more: nothing to add, all rows are there

        def differs(k):
            inside = (k >= 0) & (k < size)
            return ~inside | (padded[start + np.where(inside, k, 0)] != x)

        a = np.minimum(old[:, 0] + differs(d - 1), old[:, 1] + 1)
        b = np.minimum(np.minimum(old[:, 1] + differs(d), old[:, 2] + 1), a + 1)
        c = np.minimum(old[:, 2] + differs(d + 1), b + 1)
        alive = (np.minimum(np.minimum(a, b), c) <= 1) & ~whole
        k = np.flatnonzero(alive)
        rows[base[q[k]] + d[k] + 1] = np.stack([a[k], b[k], c[k]], axis=1)
        end = alive & (d + 1 == lengths[j])
        cell = size - lengths[j] + 1
        cost = np.where(cell == 0, a, np.where(cell == 1, b, np.where(cell == 2, c, 9)))
        hit = end & (cost == 1)
        left.append(q[hit])
        right.append(j[hit])
        # the next word: one letter deeper, the next in the list, or the next without this prefix
        skip = np.where(d < len(behind), behind[np.minimum(d, len(behind) - 1), j], j + 1)
        go = np.where(end | whole, j + 1, np.where(alive, j, skip))
        depth = np.where(alive & ~end, d + 1, lcp[go])
        late = ~alive & ~whole & (depth > d)
        while late.any():  # behind long prefixes
            go[late] += 1
            depth[late] = lcp[go[late]]
            late &= depth > d
        keep = depth >= 0
        q, j, d = q[keep], go[keep], depth[keep]
    return np.concatenate(left) if left else every[:0], np.concatenate(right) if right else every[:0]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (a, n_a, b, n_b), a before b, of rows sorted by group and word."""
    held: list[tuple] = []

    def solved() -> pa.RecordBatch:
        key, form, n, s, back = zip(*held)
        group = np.cumsum([0, *[x != y for x, y in zip(key[1:], key)]])
        i, j = near_pairs(list(form), group)
        out = [[], [], [], []]
        for x, y in zip(i.tolist(), j.tolist()):
            if min(len(form[x]), len(form[y])) > s[x]:
                continue  # both longer: found among words of their own length
            pair = sorted(((form[k][::-1] if back[k] else form[k]), n[k]) for k in (x, y))
            for column, value in zip(out, (pair[0][0], pair[0][1], pair[1][0], pair[1][1])):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["a", "n_a", "b", "n_b"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "form", "n", "s", "back"))):
            if len(held) >= BATCH and row[0] != held[-1][0]:
                yield solved()
                held.clear()
            held.append(row)
    if held:
        yield solved()


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words one edit apart once, a before b."""
    rows = grouped(words)
    back = F.col("tail") > F.col("head")
    width = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forms = rows.select("key", F.when(back, F.reverse("word")).otherwise(F.col("word")).alias("form"), "n", "s", back.alias("back"))
    pairs = forms.repartition(width, "key").sortWithinPartitions("key", "form").mapInArrow(_walk, "a string, n_a long, b string, n_b long")
    return pairs.distinct()


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of a vocabulary."""
    words = cut(words)
    pairs = cut(near_words(words))  # read from both ends
    both = pairs.select(F.col("a").alias("_word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("_word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    rows = words.join(best, F.col("word") == F.col("_word"), "left")
    far = -F.col("best.m") >= RATIO * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n")))
    # forms are RATIO times as frequent each time, so a chain has few links
    links = rows.where("form is not null").select(F.col("word").alias("_from"), F.col("form").alias("_to"))
    roots = links.withColumnsRenamed({"_from": "_word", "_to": "_root"})
    while True:
        more = roots.join(links, F.col("_root") == F.col("_from"), "left")
        roots = cut(more.select("_word", F.coalesce("_to", "_root").alias("_root"), F.col("_to").isNotNull().alias("_moved")))
        if roots.where("_moved").isEmpty():
            break
        roots = roots.drop("_moved")
    return rows.join(roots.drop("_moved"), F.col("word") == F.col("_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("_root", "word").alias("root"))
