"""Token counts from flat, unindexed token files by a separator scan.

``write_flat`` encodes texts with a public byte-level vocabulary and lays the tokens of each
input partition out as one flat file of 16-bit ids, in which every document ends with the
end-of-document id and nothing says where a document starts. The file is stored as blocks of
a fixed number of tokens, cut without regard to documents.

``scan`` finds the separators of each block with one vectorised comparison, in any order and
on any executor. What crosses blocks is stitched by a prefix scan over one summary row per
block: running number of separators (the ordinal of the first document that ends in the
block), and the running maximum of separator positions (where the open document began). The
scan runs in two levels, blocks within a stretch of 1,024 and then stretches, so a single file
of any length is no single task.

Defined results: a null or empty text has 0 tokens; the separator itself is not counted;
tokens after the last separator of a file are an unfinished document and are reported by
``open_ends`` only. The text of the separator inside a document is ordinary text.
"""

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut, gathered, tune

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EOD = 50256
BLOCK_TOKENS = 1 << 19
STRETCH = 1024
#: Splits a text into pieces before merging; part of the vocabulary's definition (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODINGS: dict[str, object] = {}


def encoding(ranks: bytes):
    """The encoder of a rank file; built once in each worker."""
    key = f"{len(ranks)}:{hash(ranks)}"
    if key not in _ENCODINGS:
        import tiktoken
        pairs = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(a): int(b) for a, b in pairs}
        _ENCODINGS[key] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def write_flat(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ranks_path: str = RANKS_PATH, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(blocks: file, block, data; names: file, ordinal, doc_id), written to the shared folder.

    ``names`` lists the documents of a file in their order, without positions or lengths.
    """
    spark = tune(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a vocabulary: under 1 MB, whatever the input

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file = encoding(sent.value), TaskContext.get().partitionId()
        rest, block, ordinal = np.zeros(0, np.uint16), 0, 0

        def row(data: bytes | None, at: int, ids: pa.Array | None) -> pa.RecordBatch:
            names = pa.array([None if ids is None else ids.to_pylist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([at], pa.int64()), pa.array([data], pa.binary()), names], names=["file", "block", "data", "doc_ids"])

        for batch in gathered(batches, "text"):
            parts = [rest]
            for t in batch.column("text").to_pylist():
                parts.append(np.array(enc.encode_ordinary(t or ""), np.uint16))
                parts.append(np.array([EOD], np.uint16))
            rest = np.concatenate(parts)
            while len(rest) >= block_tokens:
                yield row(rest[:block_tokens].tobytes(), block, None)
                rest, block = rest[block_tokens:], block + 1
            yield row(None, ordinal, batch.column("doc_id"))
            ordinal += batch.num_rows
        if len(rest):
            yield row(rest.tobytes(), block, None)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stored = cut(rows.mapInArrow(lay_out, "file int, block long, data binary, doc_ids array<long>"))
    blocks = stored.where("data is not null").select("file", "block", "data")
    names = stored.where("data is null").select("file", "block", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("block") + F.col("i")).alias("ordinal"), "doc_id")
    return blocks, names


def read_flat(spark, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of token files (little-endian 16-bit ids) below ``path``; a file is read as one row."""
    size = 2 * block_tokens
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content")
    cuts = files.select("file", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("length", F.lit(1)) - 1) / size))).alias("block"))
    return cuts.select("file", "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("data"))


def _separators(eod: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, tokens = [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                found.append(np.flatnonzero(ids == eod))
                tokens.append(len(ids))
            count = np.array([len(f) for f in found], np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            ends = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).astype(np.int64) if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(tokens, pa.int64()), ends], names=["file", "block", "tokens", "ends"])
    return run


def scan(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document that ends in a flat file."""
    return _stitched(_summaries(blocks, eod)).select(
        "file", F.col("before").alias("base"), "opened", "origin", F.posexplode("ends").alias("i", "end"), "ends").select(
        "file", (F.col("base") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("opened")).otherwise(F.col("origin") + F.expr("get(ends, i - 1)") + 1).alias("start"),
        (F.col("origin") + F.col("end")).alias("stop")).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))


def open_ends(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """(file, n_tokens) of what follows the last separator of each file, if anything does."""
    s = _summaries(blocks, eod)
    total = s.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.max(F.when(F.size("ends") > 0, F.struct("block", F.col("tokens") - F.array_max("ends") - 1))).alias("last"))
    after = s.join(total.select("file", F.col("last.block").alias("b"), F.col("last.col2").alias("tail")), "file").where("b is null or block > b")
    return (after.groupBy("file", "tail").agg(F.sum("tokens").alias("t")).select("file", (F.coalesce("tail", F.lit(0)) + F.col("t")).alias("n_tokens"))
            .union(total.join(after.select("file").distinct(), "file", "left_anti").select("file", "last.col2")).where("n_tokens > 0"))


def _summaries(blocks: DataFrame, eod: int) -> DataFrame:
    kind = dict(blocks.dtypes)["file"]
    tune(blocks.sparkSession)
    return cut(blocks.select("file", "block", "data").mapInArrow(_separators(eod), f"file {kind}, block long, tokens long, ends array<long>"))


def _stitched(summary: DataFrame) -> DataFrame:
    """Each block with: origin (its first token's position), before (separators so far), opened
    (where the document open at its start began)."""
    narrow = summary.select("file", "block", F.floor(F.col("block") / STRETCH).alias("stretch"), "tokens", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    inner = W.partitionBy("file", "stretch").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    near = (narrow.withColumn("origin1", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
            .withColumn("before1", F.coalesce(F.sum("n").over(inner), F.lit(0)))
            .withColumn("last1", F.max(F.col("origin1") + F.col("last")).over(inner)))
    whole = near.groupBy("file", "stretch").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"), F.max(F.col("origin1") + F.col("last")).alias("last"))
    outer = W.partitionBy("file").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    far = (whole.withColumn("origin2", F.coalesce(F.sum("tokens").over(outer), F.lit(0)))
           .withColumn("before2", F.coalesce(F.sum("n").over(outer), F.lit(0)))
           .withColumn("last2", F.max(F.col("origin2") + F.col("last")).over(outer)).select("file", "stretch", "origin2", "before2", "last2"))
    opened = F.coalesce(F.col("origin2") + F.col("last1") + 1, F.col("last2") + 1, F.lit(0))
    scanned = near.join(far, ["file", "stretch"]).select(
        "file", "block", (F.col("origin1") + F.col("origin2")).alias("origin"), (F.col("before1") + F.col("before2")).alias("before"), opened.alias("opened"))
    return summary.join(scanned, ["file", "block"])


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ranks_path: str = RANKS_PATH) -> DataFrame:
    """doc_id and n_tokens of every row of ``docs``, counted in flat files written from it."""
    blocks, names = write_flat(docs, text, doc_id, ranks_path)
    return names.join(scan(blocks), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
