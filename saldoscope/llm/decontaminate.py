"""Benchmark decontamination: a broadcast set of test n-grams against training windows.

Every test item is cut into windows of 13 normalised words (an item with fewer words is one
window). Their hashes are broadcast; training texts are scanned window by window with numpy,
hits are verified by comparing the words themselves, and the hit words of a document are the
union of all occurrences.

The broadcast is bounded: the items are dealt into slices of about ``max_windows`` windows and
``SLICE_TEXT`` bytes at most. A slice is a handful of arrays: sorted hashes, the word each window begins
with, and the words of all items in one buffer, about 30 bytes a window. With more than one slice
the texts are scanned by one after the other, and each adds to the hits that a row brings along:
nothing is shuffled, and a benchmark of any size is handled in full.

Nulls and empty texts have no words and no hits. Items without words or without item id are never found.
Repeated documents are answered row by row; item ids that repeat count once. Columns of the
input that have the name of a result column are replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import by_slice, cut, flat, grams, lower_ascii, ranges, tune, words

N = 13
MAX_WINDOWS = 1_000_000
SLICE_TEXT = 1 << 25
_FILTER_BITS = 22


def word_bytes() -> np.ndarray:
    """Bytes of words after lower-casing: digits, a to z, and all of non-ASCII characters."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


class WindowSet:
    """Windows of test items by length, as arrays; a bit table stands in front of the sorted hashes."""

    def __init__(self, rows: list[tuple[int, str]], n: int = N):
        fold = lower_ascii()
        self.ids = np.array([item for item, _ in rows], np.int64)
        buf, offsets = flat(pa.array([text for _, text in rows], pa.string()), after="\n")
        starts, ends, hashes = words(buf, word_bytes(), fold)
        self.first = np.searchsorted(starts, offsets)
        count = np.diff(self.first)
        # all words, lower-cased, with one blank behind each: a window is one piece of it
        lengths = ends - starts
        self.place = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.spelled = np.full(int(self.place[-1]), 0x20, np.uint8)
        self.spelled[ranges(self.place[:-1], lengths)] = fold[buf[ranges(starts, lengths)]]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.minimum(count, n)
        for size in np.unique(sizes[sizes > 0]).tolist():
            mine = np.flatnonzero(sizes == size)
            at = ranges(self.first[mine], count[mine] - size + 1)
            keys = grams(hashes, size)[at]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.tables[size] = keys, at[order].astype(np.int32), bits

    def items_of(self, size: int, h: int, spelled: bytes) -> set[int]:
        """Items with a window of this hash and these words."""
        keys, at, _ = self.tables[size]
        out = set()
        for w in at[np.searchsorted(keys, h, "left"):np.searchsorted(keys, h, "right")].tolist():
            if self.spelled[self.place[w]:self.place[w + size] - 1].tobytes() == spelled:
                out.add(int(self.ids[np.searchsorted(self.first, w, "right") - 1]))
        return out


def spell(buf, starts, ends, at: int, size: int, fold) -> bytes:
    return b" ".join(fold[buf[starts[i]:ends[i]]].tobytes() for i in range(at, at + size))


SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_from", T.ArrayType(T.LongType())),
    T.StructField("hit_to", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.LongType())),
])


def _lists(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int64()))


def scan(texts: pa.Array, known: WindowSet, before: list[tuple] | None = None) -> tuple[list, list, list, list]:
    """Per text: number of words, merged spans of hit words (from, to), and item ids; ``before``
    has the spans and items that other slices have found."""
    fold, inside = lower_ascii(), word_bytes()
    buf, offsets = flat(texts, after="\n")
    starts, ends, hashes = words(buf, inside, fold)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    for size, (keys, _, bits) in known.tables.items():
        g = grams(hashes, size)
        hit = np.flatnonzero(bits[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(hit):
            continue
        place = np.minimum(np.searchsorted(keys, g[hit]), len(keys) - 1)
        hit = hit[keys[place] == g[hit]]
        doc = np.searchsorted(first, hit, side="right") - 1
        whole = hit + size <= first[doc + 1]
        for at, d in zip(hit[whole].tolist(), doc[whole].tolist()):
            if ids := known.items_of(size, g[at], spell(buf, starts, ends, at, size, fold)):
                spans.setdefault(d, []).append((at - int(first[d]), at + size - int(first[d])))
                items.setdefault(d, set()).update(ids)
    for d, (a, b, ids) in enumerate(before or ()):
        if a:
            spans.setdefault(d, []).extend(zip(a, b))
            items.setdefault(d, set()).update(ids)
    frm, to = [[] for _ in count], [[] for _ in count]
    for d, found in spans.items():
        for a, b in sorted(found):
            if to[d] and a <= to[d][-1]:
                to[d][-1] = max(to[d][-1], b)
            else:
                frm[d].append(a)
                to[d].append(b)
    return count.tolist(), frm, to, [sorted(items.get(d, ())) for d in range(len(count))]


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
              n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with n_words, hit_from, hit_to (spans of hit words) and items of every document."""
    spark = tune(docs.sparkSession)
    out = docs.drop(*[f for f in SCHEMA.fieldNames() if f != text])
    known = (benchmark.where(F.col(item_text).isNotNull() & F.col(item).isNotNull())
             .select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("words"), F.size(F.split(item_text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("w")))
    total = known.agg(F.sum("w").alias("w"), F.sum(F.octet_length("words")).alias("b")).first()
    parts = max(1, -(-(total.w or 0) // max_windows), -(-(total.b or 0) // SLICE_TEXT))
    for k in range(parts):
        rows = known.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k).select("item", "words")
        out = _scan_with(out, spark.sparkContext.broadcast(WindowSet([tuple(r) for r in rows.toLocalIterator()], n)), text)
        if k % 2 and k < parts - 1:
            out = cut(out)  # else each task would hold a process for every slice
    return out


def _scan_with(docs: DataFrame, sent, text: str) -> DataFrame:
    plain = [f for f in docs.schema.fields if f.name not in SCHEMA.fieldNames() or f.name == text]
    again = len(plain) < len(docs.schema.fields)
    names = [f.name for f in plain]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        before = list(zip(*(batch.column(c).to_pylist() for c in ("hit_from", "hit_to", "items")))) if again else None
        count, frm, to, ids = scan(batch.column(text), sent.value, before)
        more = [pa.array(count, pa.int64()), _lists(frm), _lists(to), _lists(ids)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *more], names=[*names, *SCHEMA.names])

    return docs.mapInArrow(by_slice(one, text), T.StructType(plain + SCHEMA.fields))


def judge(hits: DataFrame) -> DataFrame:
    """Adds n_hit (hit words) and contaminated: at least a twentieth of the words is hit."""
    n_hit = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return hits.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_spans(hits: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose hit words, and what stands between them, are cut out of the text."""
    fold, inside = lower_ascii(), word_bytes()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, frm, to in zip(batch.column(text).to_pylist(), batch.column("hit_from").to_pylist(), batch.column("hit_to").to_pylist()):
            if frm:
                raw = t.encode()
                starts, ends, _ = words(np.frombuffer(raw + b"\n", np.uint8), inside, fold)
                at, kept = 0, []
                for a, b in zip(frm, to):
                    kept.append(raw[at:starts[a]])
                    at = int(ends[b - 1])
                t = b"".join([*kept, raw[at:]]).decode()
            out.append(t)
        place = batch.schema.get_field_index(text)
        return batch.set_column(place, batch.schema.field(text), pa.array(out, batch.schema.field(text).type))

    return hits.mapInArrow(by_slice(one, text), hits.schema)
