"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is described by its terms (words without signs, A-Z lower-cased, hashed to ``TERMS``
places) and by its shape: counts of three-byte sequences of character kinds (letters, capitals,
digits, blanks, each common sign), its length, and words that repeat the word before. All are
weighted by rarity and damped by a square root. The leading singular directions of labelled
texts make the latent space. The labelled vectors are broadcast; every document's exact cosines
with all of them are computed block by block as matrix products, and the labels of the ``k``
nearest vote, weighted by a power of their similarity. ``k``, the power and the weight of the terms
are those of ``CHOICES`` and ``SHARES`` with the least log loss over five folds of the labelled
rows; nothing else is used to choose them.

Labelled rows are bounded: the ``max_labelled`` rows with the smallest hash of their doc_id
among those allowed for learning (documented bound, 5,000 by default: 2 MB broadcast).
Everything else covers all rows.

Defined results: null and empty texts have a vector of their own (length zero) and get a
score like any other. Labels that are null are left out; a doc_id with several labels counts
with their mean. Without any label every score is 0.5.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import by_slice, flat, lower_ascii, tune, words
from .minhash import word_bytes

THRESHOLD = 0.3
#: Neighbours and power of the similarity to choose from; of equals, the first.
CHOICES = [(k, power) for k in (5, 10, 25) for power in (16, 4, 1)]
DIMENSIONS = 48
MAX_LABELLED = 5000
BLOCK = 256
FOLDS = 5
#: Rows whose features are held at once, however short their texts.
SLICE_ROWS = 500
#: Signs that stand for themselves; every other sign is one kind.
SIGNS = b".,!?*|#"
KINDS = 13


def kinds() -> np.ndarray:
    """Kind of each byte: other sign, blank, line end, small, capital, digit, non-ASCII, SIGNS."""
    table = np.zeros(256, np.int64)
    table[[0x20, 0x09]] = 1
    table[[0x0A, 0x0D]] = 2
    table[ord("a"):ord("z") + 1] = 3
    table[ord("A"):ord("Z") + 1] = 4
    table[ord("0"):ord("9") + 1] = 5
    table[0x80:] = 3  # part of a letter
    for i, sign in enumerate(SIGNS[:KINDS - 6]):
        table[sign] = 6 + i
    return table


LENGTHS = 24
TERMS = 4096
SHAPES = KINDS ** 3 + LENGTHS + 1
WIDTH = SHAPES + TERMS
#: Weights of the terms beside the shape to choose from.
SHARES = (0.1, 0.3, 1.0)


def term_bytes() -> np.ndarray:
    """Letters, digits and bytes of non-ASCII characters."""
    table = np.zeros(256, bool)
    for low, high in ("az", "AZ", "09"):
        table[ord(low):ord(high) + 1] = True
    table[0x80:] = True
    return table


def features(texts: pa.Array) -> np.ndarray:
    """Share of each sequence of three kinds, the length on a log scale, the share of words that
    repeat the word before, and the share of each place of hashed terms: texts x WIDTH."""
    buf, offsets = flat(texts, after="\n\n", before="\n")
    code = kinds()[buf]
    three = (code[:-2] * KINDS + code[1:-1]) * KINDS + code[2:]
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        counts = np.bincount(three[a:b - 2], minlength=KINDS ** 3)
        out[i, :KINDS ** 3] = counts / max(b - a - 2, 1)
    size = np.log2(np.diff(offsets) - 2)
    out[np.arange(len(texts)), KINDS ** 3 + np.minimum(size, LENGTHS - 1).astype(int)] = 0.02
    starts, _, hashes = words(buf, word_bytes(), np.arange(256, dtype=np.uint8))
    first = np.searchsorted(starts, offsets)
    again = np.concatenate([[0, 0], np.cumsum(hashes[1:] == hashes[:-1])])
    a, b = first[:-1], first[1:]
    out[:, SHAPES - 1] = 0.2 * (again[b] - again[np.minimum(a + 1, b)]) / np.maximum(b - a, 1)
    starts, _, hashes = words(buf, term_bytes(), lower_ascii())
    place = (hashes % np.uint64(TERMS)).astype(np.int64)
    first = np.searchsorted(starts, offsets).tolist()
    for i, (a, b) in enumerate(zip(first, first[1:])):
        out[i, SHAPES:] = np.bincount(place[a:b], minlength=TERMS) / max(b - a, 1)
    return np.sqrt(out, out=out)


class Space:
    """Weights, directions, labelled unit vectors and their labels.

    ``x`` may be 16-bit; it is read in blocks, so the driver holds little beside it. The
    leading directions come from subspace iteration; no cross-product matrix is formed.
    """

    def __init__(self, x: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        self.labels = labels.astype(np.float32)
        self.mean = float(labels.mean()) if len(labels) else 0.5
        self.k, self.power = CHOICES[0]
        if not len(labels):
            self.weights, self.directions, self.vectors = np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32)
            return
        blocks = [slice(at, at + BLOCK) for at in range(0, len(x), BLOCK)]
        seen = sum((x[b] > 0).sum(axis=0) for b in blocks)
        rarity = (np.log((1 + len(x)) / (1 + seen)) + 1).astype(np.float32)
        best = None
        for share in SHARES:
            weights = rarity.copy()
            weights[SHAPES:] *= share
            directions = self.leading(x, blocks, weights, dimensions)
            vectors = np.concatenate([self.unit((x[b].astype(np.float32) * weights) @ directions) for b in blocks])
            loss, k, power = self.choice(vectors)
            if best is None or loss < best:
                best, self.weights, self.directions, self.vectors, self.k, self.power = loss, weights, directions, vectors, k, power

    @staticmethod
    def leading(x: np.ndarray, blocks: list[slice], weights: np.ndarray, dimensions: int) -> np.ndarray:
        """The leading directions of the weighted rows."""
        def turned(basis: np.ndarray) -> np.ndarray:
            """The weighted cross-product matrix times ``basis``."""
            out = np.zeros_like(basis)
            for b in blocks:
                w = x[b].astype(np.float32) * weights
                out += w.T @ (w @ basis)
            return out

        basis = np.random.default_rng(1).standard_normal((WIDTH, dimensions + 16)).astype(np.float32)
        for _ in range(8):
            basis = np.linalg.qr(turned(basis))[0]
        _, turn = np.linalg.eigh(basis.T @ turned(basis))
        return np.ascontiguousarray(basis @ turn[:, ::-1][:, :dimensions])

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def choice(self, vectors: np.ndarray) -> tuple[float, int, int]:
        """Log loss, neighbours and power of the choice that foretells labels best over folds."""
        fold, most = np.arange(len(vectors)) % FOLDS, max(k for k, _ in CHOICES)
        loss = np.zeros(len(CHOICES))
        for f in range(FOLDS):
            mine, others = vectors[fold == f], fold != f
            if not len(mine) or not others.any():
                continue
            for at in range(0, len(mine), BLOCK):
                cos, labels = self.nearest(mine[at:at + BLOCK], vectors[others], self.labels[others], most)
                truth = self.labels[fold == f][at:at + BLOCK]
                for i, (k, power) in enumerate(CHOICES):
                    said = np.clip(self.vote(cos[:, :k], labels[:, :k], power), 0.01, 0.99)
                    loss[i] -= (truth * np.log(said) + (1 - truth) * np.log(1 - said)).sum()
        i = int(np.argmin(np.round(loss, 3)))
        return round(float(loss[i]), 3), *CHOICES[i]

    @staticmethod
    def nearest(mine: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and labels of the k nearest vectors of each row, nearest first."""
        cos = mine @ vectors.T
        k = min(k, len(vectors))
        near = np.argpartition(cos, -k, axis=1)[:, -k:]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(cos, near, axis=1), axis=1), axis=1)
        return np.take_along_axis(cos, near, axis=1), labels[near]

    def vote(self, cos: np.ndarray, labels: np.ndarray, power: int) -> np.ndarray:
        w = np.maximum(cos, 0).astype(np.float64) ** power
        return np.clip(((w * labels).sum(axis=1) + 0.01 * self.mean) / (w.sum(axis=1) + 0.01), 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Weighted vote of the k labelled vectors with the largest cosines, 0 to 1."""
        if not len(self.vectors):
            return np.full(len(x), 0.5)
        out = np.empty(len(x))
        for at in range(0, len(x), BLOCK):
            mine = self.unit((x[at:at + BLOCK] * self.weights) @ self.directions)
            out[at:at + BLOCK] = self.vote(*self.nearest(mine, self.vectors, self.labels, self.k), self.power)
        return np.round(out, 6)


def labelled_rows(docs: DataFrame, labels: DataFrame, allowed: Column | None, text: str, doc_id: str, max_labelled: int) -> DataFrame:
    """(text, label) of at most ``max_labelled`` documents: those with the smallest hash."""
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("label")).where("_id is not null and label is not null")
             .groupBy("_id").agg(F.avg("label").alias("label")))
    learn = known if allowed is None else known.where(allowed)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text"))
    few = rows.select("_id").join(learn, "_id").dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    return rows.join(few.hint("broadcast"), "_id").select("text", "label")  # max_labelled pairs of numbers


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, text: str = "text", doc_id: str = "doc_id",
        max_labelled: int = MAX_LABELLED) -> Space:
    """The latent space of the labelled documents.

    Feature vectors are computed on the executors; the driver receives ``max_labelled`` of
    them at most, as packed 16-bit floats (mostly zeros). They are sorted, so that folds and
    sums do not depend on the order in which tasks end.
    """
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column("text")).astype(np.float16)
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary()), batch.column("label")], names=["x", "label"])

    tune(docs.sparkSession)
    rows = labelled_rows(docs, labels, allowed, text, doc_id, max_labelled).mapInArrow(by_slice(one, "text", rows=SLICE_ROWS), "x binary, label double")
    held = sorted((row.x, row.label) for row in rows.collect())[:max_labelled]  # bounded: max_labelled rows
    x = np.zeros((len(held), WIDTH), np.float16)
    for i, (packed, _) in enumerate(held):
        x[i] = np.frombuffer(zlib.decompress(packed), np.float16)
    return Space(x, np.array([label for _, label in held]))


def score(docs: DataFrame, space: Space, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a quality score of 0 to 1 for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(space)  # bounded by max_labelled and DIMENSIONS
    schema = T.StructType([f for f in docs.schema.fields if f.name != column] + [T.StructField(column, T.DoubleType())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = pa.array(sent.value.score(features(batch.column(text))), pa.float64())
        return pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, column])

    return docs.select(*[f"`{f.name}`" for f in docs.schema.fields if f.name != column]).mapInArrow(by_slice(one, text, rows=SLICE_ROWS), schema)
