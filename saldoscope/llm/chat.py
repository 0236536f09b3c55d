"""Chat formatting by columnar byte assembly.

Every turn becomes three segments: a header for its role, its text, and an end. For a slice of
turns the lengths of all segments are known at once; their running sum gives the place of each
segment in one preallocated buffer, and headers, texts and ends are scattered there by index
arrays. The buffer is the data of the Arrow column of formatted turns.

Template (an own one, with the usual control strings)::

    user       [INST] text [/INST]
    assistant  <a> text</s>
    any other  [ROLE] role [/ROLE] text</s>

A control string inside a text, and the escape sign, get an escape sign in front; taking every
escape sign away gives the text back. Formatted parts therefore can be read back without
knowing where turns begin.

A conversation is sorted by (turn, role, text) and cut into parts of bounded bytes; rows are
dealt by range of (conversation, turn), so one conversation may spread over many tasks.
Defined results: a null text or role is empty; null turns come first; a null conversation id
is a conversation of its own. Rows that repeat stay, each as a turn.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import flat, gathered, ranges, tune

#: Control strings of the template, and the escape sign, as a pattern (fixed values).
_CONTROL = r"\\|\[/?INST\]|\[/?ROLE\]|<a>|</?s>"
_UNESCAPED = re.compile(rb"\\(.)", re.S)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, f"({_CONTROL})", r"\\\1")


def headers(roles: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Header and end of each turn."""
    user, reply = pc.equal(roles, "user"), pc.equal(roles, "assistant")
    wide = pa.large_string()
    other = pc.binary_join_element_wise(pa.scalar("[ROLE] ", wide), escape(roles), pa.scalar(" [/ROLE] ", wide), pa.scalar("", wide))
    head = pc.if_else(user, pa.scalar("[INST] ", wide), pc.if_else(reply, pa.scalar("<a> ", wide), other))
    return head, pc.if_else(user, pa.scalar(" [/INST]", wide), pa.scalar("</s>", wide))


def assemble(roles: pa.Array, texts: pa.Array) -> pa.Array:
    """The formatted string of each turn, built in one buffer."""
    roles, texts = (pc.fill_null(x.cast(pa.large_string()), "") for x in (roles, texts))
    parts = [flat(x) for x in (headers(roles)[0], escape(texts), headers(roles)[1])]
    lengths = np.stack([np.diff(o) for _, o in parts], axis=1)
    place = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(int(place[-1]), np.uint8)
    for k, (data, _) in enumerate(parts):
        out[ranges(place[k:-1:3], lengths[:, k])] = data
    offsets = np.ascontiguousarray(place[::3])
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, formatted): parts of each conversation, in order.

    ``part`` numbers the parts in order; a conversation's numbers need not be contiguous.
    """
    spark = tune(turns.sparkSession)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40  # partitions are in the order of their ranges
        for batch in gathered(batches, "text"):
            made = assemble(batch.column("role"), batch.column("text"))
            ids = batch.column("conv_id").to_pylist()
            bounds = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            data, offsets = flat(made)
            cut = offsets[bounds].astype(np.int32)
            whole = pa.Array.from_buffers(pa.string(), len(cut) - 1, [None, pa.py_buffer(np.ascontiguousarray(cut)), pa.py_buffer(np.ascontiguousarray(data))])
            first = batch.take(pa.array(bounds[:-1]))
            parts = pa.array(range(part, part + len(first)), pa.int64())
            part += len(first)
            yield pa.RecordBatch.from_arrays([first.column("conv_id"), parts, pa.array(np.diff(bounds), pa.int64()), whole], names=["conv_id", "part", "n_turns", "formatted"])

    return dealt.mapInArrow(run, "conv_id long, part long, n_turns long, formatted string")


_TURN = re.compile(
    rb"\[INST\] (?P<user>(?:[^\\\[ ]++|\\.| (?!\[/INST\])|\[)*+) \[/INST\]"
    rb"|<a> (?P<reply>(?:[^\\<]++|\\.|<(?!/s>))*+)</s>"
    rb"|\[ROLE\] (?P<role>(?:[^\\\[ ]++|\\.| (?!\[/ROLE\] )|\[)*+) \[/ROLE\] (?P<other>(?:[^\\<]++|\\.|<(?!/s>))*+)</s>", re.S)


def parse(formatted: bytes) -> Iterator[tuple[bytes, bytes, tuple[int, int]]]:
    """(role, text, span of the text in ``formatted``) of each turn."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at byte {at}")
        kind = "user" if m["user"] is not None else "reply" if m["reply"] is not None else "other"
        role = {"user": b"user", "reply": b"assistant"}.get(kind) or _UNESCAPED.sub(rb"\1", m["role"] or b"")
        yield role, _UNESCAPED.sub(rb"\1", m[kind]), m.span(kind)
        at = m.end()


def loss_spans(chats: DataFrame) -> DataFrame:
    """Formatted parts with the byte spans of assistant texts: where the loss is taken."""
    def run(batches):
        for batch in batches:
            spans = [[list(s) for role, _, s in parse(f.as_buffer().to_pybytes()) if role == b"assistant"] for f in batch.column("formatted")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[*batch.schema.names, "loss_spans"])

    return chats.mapInArrow(run, chats.select("*", F.lit(None).cast("array<array<bigint>>").alias("loss_spans")).schema)


def read_back(chats: DataFrame) -> DataFrame:
    """Per conversation, from its formatted parts: number of turns and digests of turns and loss.

    A digest needs the texts of a conversation one after the other, so the parts of a
    conversation meet in one task, as a stream of bounded pieces.
    """
    width = int(chats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chats.repartition(width, "conv_id").sortWithinPartitions("conv_id", "part")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, done = None, False, []
        n = chars = total = 0
        turns = loss = None
        for batch in batches:
            for conv, formatted in zip(batch.column("conv_id").to_pylist(), batch.column("formatted")):
                if not started or conv != now:
                    if started:
                        done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))
                    now, started, n, chars, total, turns, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                raw = formatted.as_buffer().to_pybytes()
                total += len(raw.decode())
                for role, text, _ in parse(raw):
                    n += 1
                    turns.update(role + b"\n" + text + b"\n")
                    if role == b"assistant":
                        loss.update(text)
                        chars += len(text.decode())
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                done = []
        if started:
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
