"""Near-duplicate documents: universal hash minima, banding, verification, components.

1. A document's set is its distinct 5-word shingles (A-Z lower-cased); documents with equal
   sets form one class, and the class goes on as its smallest doc_id.
2. Multiply-add-shift minima of each set, in bands of 5: as many bands as it takes for two sets
   at the threshold s to share none with a probability, (1 - s**5)**bands, of less than one in
   a million. That is 24 bands (120 minima) at 0.85 and 35 bands (175 minima) at 0.8.
3. In each band's bucket one central member is the pivot, and every other member is paired
   with it: as many pairs as rows, whatever the size of the bucket. Pairs whose signatures
   agree in too few places are dropped (``sure_places``: more than five standard deviations below
   the threshold), the rest are verified on full sets.
4. Members that are alike without being like the pivot: where a pivot and its mates are in more than one
   verified component, these go through an exact prefix join. Only shingles that stand in
   two components or more can join them; a set that holds n shingles must share ceil(s * n) of those. Of
   its shared shingles, rarest first, all but ceil(s * n) - 1 form the prefix, and two
   sets that are alike share a shingle of both prefixes. Documents around a common boilerplate
   have no prefix at all. Holders of a prefix shingle are cut into blocks of bounded bytes by
   set size, and only blocks of compatible sizes are compared, on full sets, in one task per
   pair of blocks; a task returns a spanning forest of the links that it finds, never all pairs.
   So no link between components is lost.
5. Components of all verified links by large-star and small-star.

Sets are never gathered by bucket: for verification each document's set is computed from its
text again and sent to the few pivots or blocks that need it, in groups of bounded bytes.

Defined results: null, empty and blank texts have empty sets and link with nothing. Rows with
the same doc_id and the same set are one document. A row with a null doc_id links with
nothing and is kept.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import by_slice, cut, flat, grams, lower_ascii, mix, tune, words
from .components import components

SHINGLE = 5
#: Default threshold; callers may ask for another one.
PERCENT = 85
ROWS = 5
MISSED = 1e-6
GROUP_SHINGLES = 1 << 16


def band_count(percent: int) -> int:
    """Bands of ROWS minima: two sets at the threshold share none less often than MISSED."""
    return math.ceil(math.log(MISSED) / math.log1p(-(percent / 100) ** ROWS)) if percent < 100 else 1


def sure_places(percent: int) -> int:
    """Of all minima, how many must agree: 5.6 deviations less than agree on average at the
    threshold. At 0.85, 102 of 120 agree, with a deviation of 3.9; at 0.8, 140 of 175 with 5.3."""
    n, s = band_count(percent) * ROWS, percent / 100
    return max(math.floor(n * s - 5.6 * math.sqrt(n * s * (1 - s))), 0)


def word_bytes() -> np.ndarray:
    table = np.ones(256, bool)
    table[0x20] = False
    table[0x09:0x0E] = False
    return table


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than k words has one."""
    buf, offsets = flat(texts, after="\n")
    starts, _, hashes = words(buf, word_bytes(), lower_ascii())
    first = np.searchsorted(starts, offsets).tolist()
    g = grams(hashes, k)
    out = []
    for a, b in zip(first, first[1:]):
        out.append(np.unique(g[a:b - k + 1]) if b - a >= k else grams(hashes[a:b], b - a) if b > a else g[:0])
    return out


def coefficients(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n hash functions h(x) = (a * x + b mod 2**64) >> 32."""
    draw = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed << 32))
    return draw[:n] | np.uint64(1), draw[n:]


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Smallest value of each hash function over each non-empty set: sets x functions, uint32."""
    out = np.full((len(sets), len(a)), 0xFFFFFFFF, np.uint32)
    sizes = np.array([len(s) for s in sets])
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return out
    low = (np.concatenate([sets[i] for i in rows]) >> np.uint64(32))
    ends = np.cumsum(sizes[rows])
    begins = ends - sizes[rows]
    work = np.empty(block, np.uint64)
    for at in range(0, len(low), block):
        end = min(at + block, len(low))
        i, j = np.searchsorted(ends, at, side="right"), np.searchsorted(begins, end)
        cuts = np.maximum(begins[i:j], at) - at
        x, buf = low[at:end], work[:end - at]
        for f in range(len(a)):
            np.multiply(x, a[f], out=buf)
            np.add(buf, b[f], out=buf)
            least = (np.minimum.reduceat(buf, cuts) >> np.uint64(32)).astype(np.uint32)
            out[rows[i:j], f] = np.minimum(out[rows[i:j], f], least)
    return out


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest of the set, low 16 bits of the minima, and a key per band."""
    tune(docs.sparkSession)
    bands = band_count(percent)
    a, b = coefficients(bands * ROWS)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"))
        m = minima(sets, a, b)
        keys = np.zeros((len(sets), bands), np.uint64)
        for r in range(ROWS):
            keys = mix(keys + m[:, r::ROWS] + np.arange(1, bands + 1, dtype=np.uint64))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        sigs = np.ascontiguousarray(m.astype(np.uint16))
        flat_keys = pa.array(keys.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat_keys) + 1, bands, dtype=np.int32)), flat_keys)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
             pa.array([r.tobytes() for r in sigs], pa.binary()), lists],
            names=["doc_id", "n_shingles", "digest", "sig", "bands"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(by_slice(one, "text"), "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>")


def _agree(batches: Iterator[pa.RecordBatch], sure: int) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose signatures agree in ``sure`` places or more."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            enough = pa.array((x == y).sum(axis=1) >= sure)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("pivot")], names=["uid", "pivot"]).filter(enough)


def alike(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, for sorted distinct values."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[place] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (p := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up.setdefault(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def links_of_group(left: list, right: list | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join different components. Members are (uid, component, set).

    With ``right`` None, all of ``left`` are compared with each other. For each member the
    counts of shared values with all candidates come from one pass over their joined sets.
    """
    forest, found = _Forest(), []
    others = left if right is None else right
    joined = np.concatenate([s for _, _, s in others])
    sizes = np.array([len(s) for _, _, s in others])
    begins = np.cumsum(sizes) - sizes
    for i, (uid, comp, s) in enumerate(left):
        low, high = percent * len(s) / 100, 100 * len(s) / percent
        open_ = (sizes >= low) & (sizes <= high)
        if right is None:
            open_[:i + 1] = False
        open_ &= np.array([forest.top(c) != forest.top(comp) for _, c, _ in others])
        if not open_.any():
            continue
        place = np.minimum(np.searchsorted(s, joined), len(s) - 1)
        both = np.add.reduceat((s[place] == joined).astype(np.int64), begins)
        for j in np.flatnonzero(open_ & (100 * both >= percent * (len(s) + sizes - both))).tolist():
            if forest.join(comp, others[j][1]):
                found.append((uid, others[j][0]))
    return found


def _check_groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group; each group is of bounded bytes and is compared when complete.

    side 0 and 1: the two sides to compare; side 2: members to compare with each other.
    """
    sides: dict[int, list] = {}
    at = None

    def close():
        if 2 in sides:
            return links_of_group(sides[2], None, percent)
        return links_of_group(sides[0], sides[1], percent) if len(sides) == 2 else []

    found: list[tuple[int, int]] = []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("grp", "blk", "side", "uid", "comp", "items")]
        for grp, blk, side, uid, comp, items in zip(*cols):
            if (grp, blk) != at:
                found += close() if sides else []
                sides, at = {}, (grp, blk)
            sides.setdefault(side, []).append((uid, comp, np.frombuffer(items, np.uint64)))
        if len(found) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
            found = []
    found += close() if sides else []
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _verified(docs: DataFrame, work: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the groups in ``work`` (uid, comp, grp, blk, side), on full sets."""
    sent = work.groupBy("uid").agg(F.first("comp").alias("comp"), F.collect_list(F.struct("grp", "blk", "side")).alias("to"))
    rows = docs.join(sent, docs.doc_id == sent.uid).select("uid", "text", "comp", "to")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s.tobytes() for s in shingle_sets(batch.column("text"))]
        names = ["uid", "comp", "to", "items"]
        return pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("comp"), batch.column("to"), pa.array(sets, pa.binary())], names=names)

    sets = rows.mapInArrow(by_slice(one, "text"), "uid long, comp long, to array<struct<grp:long,blk:long,side:int>>, items binary")
    dealt = sets.select("uid", "comp", "items", F.explode("to").alias("t")).select("uid", "comp", "items", "t.*")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(width, "grp", "blk").sortWithinPartitions("grp", "blk").mapInArrow(lambda batches: _check_groups(batches, percent), "a long, b long")


def _pivot_pairs(reps: DataFrame) -> DataFrame:
    """(uid, pivot): each member of each bucket with its bucket's most central member.

    Central is who shares buckets with most others: in a group of edited copies, the original.
    """
    rows = reps.select(F.col("doc_id").alias("uid"), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    member = cut(rows.join(shared, "key"))
    weight = member.groupBy("uid").agg(F.sum("n").alias("w"))
    weighed = member.join(weight, "uid")
    pivot = weighed.groupBy("key").agg(F.max(F.struct("w", (-F.col("uid")).alias("u"))).alias("p")).select("key", (-F.col("p.u")).alias("pivot"))
    return cut(member.join(pivot, "key").where("uid != pivot").select("uid", "pivot").distinct())


def near_links(docs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links between class representatives that connect all that is alike."""
    sizes = reps.select(F.col("doc_id").alias("uid"), "n_shingles")
    pairs = _pivot_pairs(reps)
    # the texts that may be needed for verification, written once
    members = pairs.select("uid").union(pairs.select("pivot")).distinct()
    docs = cut(docs.join(members, docs.doc_id == members.uid, "left_semi"))
    sig = reps.select("doc_id", "sig")
    signed = (pairs.join(sig.select(F.col("doc_id").alias("uid"), F.col("sig").alias("sa")), "uid")
              .join(sig.select(F.col("doc_id").alias("pivot"), F.col("sig").alias("sb")), "pivot"))
    places = sure_places(percent)
    sure = cut(signed.select("uid", "pivot", "sa", "sb").mapInArrow(lambda batches: _agree(batches, places), "uid long, pivot long"))
    # groups of a pivot and members of bounded bytes
    weighed = sure.join(sizes, "uid")
    blocks = weighed.groupBy("pivot").agg(F.ceil(F.sum("n_shingles") / GROUP_SHINGLES).alias("k"))
    dealt = weighed.join(blocks, "pivot").select("uid", F.col("pivot").alias("grp"), F.pmod(F.xxhash64("uid"), "k").alias("blk"))
    work = (dealt.select("uid", "grp", "blk", F.lit(1).alias("side"))
            .union(dealt.select(F.col("grp").alias("uid"), "grp", "blk", F.lit(0).alias("side")).distinct())
            .withColumn("comp", F.col("uid")))
    links = cut(_verified(docs, work.select("uid", "comp", "grp", "blk", "side"), percent))
    return links.union(_rest(docs, sizes, components(links), pairs, percent))


def _open(done: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, comp): pivots and their mates, where they are not all in one verified component."""
    mine, its = (done.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("uid", "cu"), ("pivot", "cp")))
    known = pairs.join(mine, "uid", "left").join(its, "pivot", "left").select("uid", "pivot", F.coalesce("cu", "uid").alias("cu"), F.coalesce("cp", "pivot").alias("cp"))
    known = cut(known)
    mixed = known.join(known.where("cu != cp").select("pivot").distinct(), "pivot", "left_semi")
    return cut(mixed.select("uid", F.col("cu").alias("comp")).union(mixed.select("pivot", "cp")).distinct())


def _prefixes(docs: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """(uid, comp, fam): members in groups of those that share a shingle of their prefixes, where these are in two components or more."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"))
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("comp"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["uid", "comp", "items"])

    sets = cut(docs.join(member, docs.doc_id == member.uid).select("uid", "comp", "text").mapInArrow(by_slice(one, "text"), "uid long, comp long, items array<long>"))
    rows = sets.select("uid", "comp", F.size("items").alias("n"), F.explode("items").alias("fam"))
    shared = rows.groupBy("fam").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("fam", "df")
    held = rows.join(shared, "fam")
    least = F.floor((F.col("n") * percent + 99) / 100)
    enough = held.groupBy("uid").agg(F.count("*").alias("s"), F.first("n").alias("n")).where(F.col("s") >= least).select("uid", (F.col("s") - least + 1).alias("k"))
    rank = F.row_number().over(Window.partitionBy("uid").orderBy("df", "fam"))
    first = cut(held.join(enough, "uid").withColumn("r", rank).where("r <= k").select("uid", "comp", "fam"))
    mixed = first.groupBy("fam").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("uid").alias("anchor")).where("lo != hi").select("fam", "anchor")
    # the shingles of alike sets have nearly the same holders: those with the same smallest holder are one group
    return first.join(mixed, "fam").select("uid", "comp", F.col("anchor").alias("fam")).distinct()


def _rest(docs: DataFrame, sizes: DataFrame, done: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links between verified components, found by comparing blocks of those that share a prefix shingle."""
    member = _prefixes(docs, _open(done, pairs), percent).select("uid", "fam", "comp").join(sizes, "uid")
    # sizes of alike sets differ by one class at most
    member = cut(member.withColumn("cls", F.floor(F.log("n_shingles") / F.lit(float(np.log(100 / percent))))))
    comps = member.groupBy("fam", "comp").agg(F.count("*").alias("n"))
    main = comps.groupBy("fam").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("c")).where("c > 1").select("fam", F.col("m.comp").alias("big"))
    open_ = member.join(main, "fam").withColumn("rest", (F.col("comp") != F.col("big")).cast("int"))
    shape = open_.groupBy("fam", "cls", "rest").agg(F.ceil(F.sum("n_shingles") / GROUP_SHINGLES).alias("k"))
    block = shape.select("fam", "cls", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("b")).withColumn("id", F.xxhash64("fam", "cls", "rest", "b"))
    other = block.select("fam", *[F.col(c).alias(f"{c}2") for c in ("cls", "rest", "b", "id")])
    order = F.struct("cls", "rest", "b"), F.struct(F.col("cls2"), F.col("rest2"), F.col("b2"))
    two = (block.join(other, "fam").where((F.col("cls2").between(F.col("cls"), F.col("cls") + 1)) & (F.col("rest") + F.col("rest2") > 0) & (order[0] <= order[1]))
           .select(F.xxhash64("id", "id2").alias("grp"), F.xxhash64("id2", "id", F.lit(1)).alias("blk"), "id", "id2"))
    same, differ = two.where("id = id2"), two.where("id != id2")
    sides = (same.select("id", "grp", "blk", F.lit(2).alias("side"))
             .union(differ.select("id", "grp", "blk", F.lit(0).alias("side"))).union(differ.select(F.col("id2").alias("id"), "grp", "blk", F.lit(1).alias("side"))))
    placed = (open_.join(shape, ["fam", "cls", "rest"]).withColumn("id", F.xxhash64("fam", "cls", "rest", F.pmod(F.xxhash64("uid"), "k")))
              .select("uid", "comp", "id"))
    work = cut(placed.join(sides, "id").select("uid", "comp", "grp", "blk", "side"))
    return cut(_verified(docs, work, percent))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, class_id, component_id, kept; linked from ``percent`` on."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sigs = cut(signatures(rows, percent=percent))
    filled = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    reps = cut(filled.join(classes, "digest").where("doc_id = class_id").dropDuplicates(["doc_id", "digest"]).select("doc_id", "n_shingles", "sig", "bands"))
    linked = components(near_links(rows, reps, percent))
    ids = sigs.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    out = ids.withColumn("class_id", F.coalesce(own, "doc_id")).join(linked, F.col("class_id") == F.col("node"), "left")
    component = F.coalesce("component", "class_id")
    return out.select("doc_id", "n_shingles", "class_id", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
