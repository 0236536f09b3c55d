"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its id: there are ``SLOTS`` of them, whatever the number of records
or shards. Bytes are summed per slot, and a small table says which shard holds a slot. Shards
are made equal by editing that table: slots move from the fullest to the emptiest shard until
no move or exchange helps. A new shard takes slots from the others and nothing moves between
those. Every edit is a new version in the map's folder; old versions stay readable, and rows
only need to be moved where two versions differ.

The law that holds is ``bytes``: shards have nearly equal sizes. Only sums per slot, a fixed
number of rows, reach the driver. Rows of a shard are numbered without gaps by numbering them
within ``PARTS`` pieces of each slot and adding the counts of the pieces before, so no task
sees a whole shard. Equal texts are not kept together: a group of copies of any size loads all
shards alike.

Defined results: a null text has no bytes and checksum 0, and a size of 1; rows with a null id
are spread by their text's checksum; rows of one id lie in one slot; an empty table gives no rows and a map of equal
slot counts. Other columns of the input take no part.
"""

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .base import cut, tune

SLOTS = 4096
PARTS = 16
#: Shards are equal enough when the fullest and the emptiest differ by this part of the mean.
NEAR = 1e-4

#: slot -> shard
Placed = list[int]


def slot_of(doc_id: Column, crc: Column) -> Column:
    """Place of a record in ``SLOTS * PARTS`` pieces; the slot is the piece // PARTS."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), crc.cast("string")))), F.lit(SLOTS * PARTS)).cast("int")


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, piece) of every record; the text is read once."""
    tune(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    return rows.withColumn("piece", slot_of(F.col("doc_id"), F.col("text_crc32")))


def slot_bytes(measured: DataFrame) -> list[int]:
    """Bytes of each slot."""
    out = [0] * SLOTS
    for r in measured.groupBy((F.col("piece") / PARTS).cast("int").alias("slot")).agg(F.sum("size").alias("bytes")).collect():  # SLOTS rows at most
        out[r["slot"]] = r["bytes"]
    return out


def first_map(shards: int) -> Placed:
    return [slot % shards for slot in range(SLOTS)]


def _totals(placed: Placed, sizes: list[int], shards: int) -> list[int]:
    out = [0] * shards
    for slot, shard in enumerate(placed):
        out[shard] += sizes[slot]
    return out


def rebalanced(placed: Placed, sizes: list[int], shards: int) -> Placed:
    """``placed`` edited until the fullest and the emptiest shard cannot be brought nearer.

    Each edit moves one slot from the fullest to the emptiest shard, or exchanges two, so that
    their difference shrinks most.
    """
    placed, total = list(placed), _totals(placed, sizes, shards)
    held = [[s for s in range(SLOTS) if placed[s] == shard] for shard in range(shards)]
    for _ in range(4 * SLOTS):
        full, empty = max(range(shards), key=lambda x: (total[x], -x)), min(range(shards), key=lambda x: (total[x], x))
        gap = total[full] - total[empty]
        if gap <= NEAR * sum(total) / shards:
            break
        # what moves over: a slot, or a slot less one that comes back; best is half the gap
        give = sorted((sizes[s], s) for s in held[full])
        take = [(0, -1), *sorted((sizes[s], s) for s in held[empty])]
        best, i = None, 0
        for got, back in take:
            while i + 1 < len(give) and give[i + 1][0] - got <= gap / 2:
                i += 1
            for amount, slot in give[i:i + 2]:
                moved = amount - got
                if 0 < moved < gap and (best is None or abs(moved - gap / 2) < best[0]):
                    best = abs(moved - gap / 2), moved, slot, back
        if best is None:
            break
        _, moved, slot, back = best
        for s, a, b in ((slot, full, empty), (back, empty, full)):
            if s >= 0:
                placed[s] = b
                held[a].remove(s)
                held[b].append(s)
        total[full] -= moved
        total[empty] += moved
    return placed


def grown(placed: Placed, sizes: list[int], shards: int) -> Placed:
    """The map with one more shard: it takes slots from the fullest ones until it has its share."""
    placed, total = list(placed), _totals(placed, sizes, shards)
    want, got = sum(total) / (shards + 1), 0
    rest = {shard: sorted(((sizes[s], s) for s in range(SLOTS) if placed[s] == shard)) for shard in range(shards)}
    queue = [(-t, shard) for shard, t in enumerate(total)]
    heapq.heapify(queue)
    while queue:
        negative, shard = heapq.heappop(queue)
        room = min(want - got, -negative - want)
        fits = [k for k, (b, _) in enumerate(rest[shard]) if b <= room]
        if not fits:
            continue
        amount, slot = rest[shard].pop(fits[-1])
        placed[slot] = shards
        got += amount
        heapq.heappush(queue, (negative + amount, shard))
    return placed


def save_map(spark: SparkSession, folder: str, version: int, placed: Placed, sizes: list[int]) -> None:
    """Add a version to a map's folder; versions are never overwritten."""
    rows = [(slot, shard, sizes[slot]) for slot, shard in enumerate(placed)]
    spark.createDataFrame(rows, "slot int, shard int, bytes long").coalesce(1).write.mode("error").parquet(f"{folder.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(version, slot, shard, bytes) of one version, the newest if none is named."""
    every = spark.read.parquet(folder)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version)


def place(measured: DataFrame, slots: DataFrame) -> DataFrame:
    """``measured`` with virtual_slot, map_version and shard; the map has ``SLOTS`` rows and is broadcast."""
    small = slots.select(F.col("slot").alias("virtual_slot"), F.col("version").alias("map_version"), F.col("shard").cast("int").alias("shard"))
    return measured.withColumn("virtual_slot", (F.col("piece") / PARTS).cast("int")).join(F.broadcast(small), "virtual_slot")


def numbered(placed: DataFrame) -> DataFrame:
    """``placed`` with ``slot``: the row's place in its shard, from 0 without gaps."""
    from pyspark.sql import Window
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    # one row for each piece, SLOTS * PARTS at most
    before = counts.select(F.col("piece").alias("_piece"), (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("piece").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("_inside", inside).join(before, F.col("piece") == F.col("_piece")).withColumn("slot", F.col("_before") + F.col("_inside")).drop("_piece", "_before", "_inside")


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, virtual_slot, map_version of every record.

    Version 1 of the map deals slots in turn, version 2 makes the shards equal; both are kept in
    ``folder`` (below the shared folder if not given).
    """
    spark = docs.sparkSession
    measured = cut(measure(docs, text, doc_id))
    sizes = slot_bytes(measured)
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/slots-{uuid.uuid4().hex}"
    first = first_map(shards)
    save_map(spark, folder, 1, first, sizes)
    save_map(spark, folder, 2, rebalanced(first, sizes, shards), sizes)
    return numbered(place(measured, load_map(spark, folder))).drop("piece")


def write_shards(docs: DataFrame, slots: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write whole records, one folder for each shard; a slot is written by one task, never a shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    piece = slot_of(F.col(doc_id), F.crc32(body.cast("binary")))
    rows = docs.withColumn("_slot", (piece / PARTS).cast("int")).join(F.broadcast(slots.select(F.col("slot").alias("_slot"), "shard")), "_slot")
    rows.repartition("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)
