"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

``PieceModel.load`` reads a public ``.model`` file. The log score of a piece is the file's
score for a unigram model. A model of merges only ranks its pieces (score = -rank); its ranks
are turned into log scores by Zipf's law, log p = -log(rank + 1) - log(H), a fixed rule, so
nothing is trained.

A text is cut into chunks before every run of blanks. No piece holds a blank behind another
character (``load`` checks it and otherwise takes whole texts as chunks), so the best
segmentation of a text is that of its chunks, and each distinct chunk of a slice is solved
once. The trie is walked from all positions of all distinct chunks at once, the Viterbi steps
run over all chunks side by side.

The whitespace marker stands for the blank, and a text gets one marker in front, which
decoding removes. A character that no piece covers is spelled in byte pieces; a literal
marker character in a text is spelled so, too, so decoding gives back every text exactly.
Null gives null ids, the empty text gives none. Very long texts without blanks are one long
chunk, which costs time but the same memory per byte.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .base import by_slice, flat, give_back, ranges, tune

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Larger slices repeat more chunks, and each distinct chunk is solved once.
SLICE_BYTES = 1 << 20
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes):
    """(number, value) of each field of a serialised message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at:at + size]
            at += size


def read_pieces(data: bytes) -> tuple[list[tuple[str, float, int]], int]:
    """(piece, score, type) of a model file, and its model type (1 unigram, 2 merges)."""
    pieces, kind = [], 1
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), np.float32)[0]), f.get(3, NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, 1)
    return pieces, kind


def zipf_scores(pieces: list[tuple[str, float, int]]) -> np.ndarray:
    """Log scores by rank: the best-ranked normal piece is the likeliest."""
    scores = np.array([s for _, s, _ in pieces])
    normal = np.array([t in (NORMAL, USER) for _, _, t in pieces])
    rank = np.zeros(len(pieces))
    order = np.flatnonzero(normal)[np.argsort(-scores[normal], kind="stable")]
    rank[order] = np.arange(1, len(order) + 1)
    return np.where(normal, -np.log(rank + 1) - np.log(np.log(len(order) + 2)), 0).astype(np.float32)


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie over byte strings: child = base[node] + byte + 1."""
    children: list[dict[int, int]] = [{}]
    value: dict[int, int] = {}
    for k, key in enumerate(keys):
        node = 0
        for byte in key:
            nxt = children[node].get(byte)
            if nxt is None:
                nxt = children[node][byte] = len(children)
                children.append({})
            node = nxt
        value[node] = k
    size = 2 * len(children) + 1024
    base, check, out = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0] = True
    place, free = {0: 0}, 1
    queue = [0]
    for node in queue:
        out[place[node]] = value.get(node, -1)
        kids = children[node]
        if not kids:
            continue
        need = np.array(sorted(kids)) + 1
        while used[free]:
            free += 1
        at = max(free - int(need[0]), 0)
        step = 1 if len(need) == 1 else 16
        while True:  # the first free base, tried some at a time
            if at + step + 257 >= len(base):
                more = len(base)
                base, check, out = np.append(base, np.zeros(more, np.int32)), np.append(check, np.full(more, -1, np.int32)), np.append(out, np.full(more, -1, np.int32))
                used = np.append(used, np.zeros(more, bool))
            taken = used[at + need[0]:at + need[0] + step].copy()
            for byte in need[1:].tolist():
                taken |= used[at + byte:at + byte + step]
            if not taken.all():
                at += int(np.argmin(taken))
                break
            at, step = at + step, min(4 * step, 4096)
        base[place[node]] = at
        for byte, kid in kids.items():
            place[kid] = at + byte + 1
            used[at + byte + 1] = True
            check[at + byte + 1] = place[node]
        queue.extend(kids.values())
    return base, check, out


@dataclass
class PieceModel:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    unknown_score: float
    byte_ids: np.ndarray
    spelled: list[bytes]
    splits: bool

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> "PieceModel":
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> "PieceModel":
        pieces, kind = read_pieces(data)
        scores = np.array([s for _, s, _ in pieces], np.float32) if kind == 1 else zipf_scores(pieces)
        spelled, keys, ids, byte_ids = [], [], [], np.full(256, -1, np.int32)
        for i, (piece, _, t) in enumerate(pieces):
            raw = piece.replace(MARKER, " ").encode()
            if t == BYTE:
                byte_ids[int(piece[3:5], 16)] = i
                raw = bytes([int(piece[3:5], 16)])
            elif t in (NORMAL, USER):
                keys.append(raw)
                ids.append(i)
            spelled.append(raw if t in (BYTE, NORMAL, USER) else b"")
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        base, check, value = double_array(keys)
        value = np.where(value >= 0, np.array(ids, np.int32)[value], -1)
        splits = not any(b" " in k.lstrip(b" ") for k in keys)
        lowest = float(scores[ids].min()) - UNKNOWN_PENALTY
        return cls(base, check, value, scores, lowest, byte_ids, spelled, splits)

    # -- encoding -----------------------------------------------------------------------

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offsets of each text."""
        empty = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)) == 0
        buf, offsets = flat(texts, before=" ")
        starts = np.zeros(len(buf), bool)
        if self.splits:
            blank = buf == 0x20
            starts[1:] = blank[1:] & ~blank[:-1]
        starts[offsets[:-1]] = True
        at = np.flatnonzero(starts)
        bounds = np.append(at, len(buf))
        raw = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = raw.dictionary_encode()
        which = np.asarray(coded.indices)
        ids, ends = self._solve(*flat_binary(coded.dictionary))
        first = np.concatenate([[0], ends])
        sizes = np.diff(first)
        dropped = np.searchsorted(at, offsets[:-1])[empty]
        count = sizes[which]
        count[dropped] = 0
        total = np.concatenate([[0], np.cumsum(count)])
        return ids[ranges(first[which], count)], total[np.searchsorted(at, offsets)]

    def _edges(self, buf: np.ndarray, ends: np.ndarray):
        """All pieces in the chunks: (position, length, id), by lock-step walks of the trie."""
        pos = np.flatnonzero((buf & 0xC0) != 0x80).astype(np.int32)
        limit, state = ends[pos].astype(np.int32), np.zeros(len(pos), np.int32)
        out, depth = [], 0
        while len(pos):
            inside = pos + depth < limit
            pos, limit, state = pos[inside], limit[inside], state[inside]
            nxt = self.base[state] + buf[pos + depth] + np.int32(1)
            ok = self.check[nxt] == state
            pos, limit, state = pos[ok], limit[ok], nxt[ok]
            depth += 1
            v = self.value[state]
            hit = v >= 0
            out.append((pos[hit], np.full(int(hit.sum()), depth, np.int32), v[hit]))
        return (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int32) for i in range(3))

    def _solve(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of each chunk: ids one after the other, and where each chunk ends."""
        n = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        offsets = offsets.astype(np.int64 if len(buf) + n >= 1 << 31 else np.int32)
        chunk = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        pos, size, piece = self._edges(buf, offsets[1:][chunk])
        score = self.scores[piece]
        # a character that is no piece of its own may be spelled in bytes
        lead = np.flatnonzero((buf & 0xC0) != 0x80).astype(np.int32)
        width = np.diff(np.append(lead, np.int32(len(buf))))
        single = np.zeros(len(buf), bool)
        width_at = np.zeros(len(buf), np.int32)
        width_at[lead] = width
        single[pos[size == width_at[pos]]] = True
        bare = ~single[lead]
        pos, size = np.append(pos, lead[bare]), np.append(size, width[bare])
        piece, score = np.append(piece, np.full(int(bare.sum()), -1, piece.dtype)), np.append(score, np.full(int(bare.sum()), self.unknown_score, np.float32))
        rel = pos - offsets[chunk[pos]]
        order = np.argsort(rel.astype(np.uint16) if rel.max() < 1 << 16 else rel, kind="stable")
        steps = np.concatenate([[0], np.cumsum(np.bincount(rel))])
        node = pos + chunk[pos]
        node, size, piece, score = node[order], size[order], piece[order], score[order].astype(np.float32)
        del pos, rel, order, single
        best = np.full(len(buf) + n, -np.inf, np.float32)
        best[offsets[:-1] + np.arange(n)] = 0
        back, got = np.zeros(len(buf) + n, np.int32), np.full(len(buf) + n, -1, np.int32)
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            if a == b:
                continue
            to = node[a:b] + size[a:b]
            offered = best[node[a:b]] + score[a:b]
            better = offered > best[to]
            to = to[better]
            best[to], back[to], got[to] = offered[better], size[a:b][better], piece[a:b][better]
        # walk back from all ends at once
        at, start, owner = offsets[1:] + np.arange(n), offsets[:-1] + np.arange(n), np.arange(n)
        walked, first, who = [], [], []
        while len(at):
            go = at > start
            at, start, owner = at[go], start[go], owner[go]
            if not len(at):
                break
            walked.append(got[at])
            at = at - back[at]
            first.append(at - owner)
            who.append(owner)
        del node, size, piece, score, best, back, got
        ids, first, who = np.concatenate(walked), np.concatenate(first), np.concatenate(who)
        spot = np.full(len(buf), -1, np.int64)
        spot[first] = np.arange(len(first))
        order = spot[spot >= 0]
        ids, first, who = ids[order], first[order], who[order]
        unknown = ids < 0
        if unknown.any():
            times = np.where(unknown, width_at[first], 1)
            spot = ranges(first, times)
            ids, who, unknown = np.repeat(ids, times), np.repeat(who, times), np.repeat(unknown, times)
            ids = np.where(unknown, self.byte_ids[buf[spot]], ids)
        return ids, np.cumsum(np.bincount(who, minlength=n))

    # -- decoding -----------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no valid text become replacement characters."""
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids]).removeprefix(b" ").decode(errors="replace")


def flat_binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[:offsets[-1]], offsets


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """``docs`` with the piece ids of each text as array<int>; null for null."""
    return _with_model(docs, text, model_path, [T.StructField(ids, T.ArrayType(T.IntegerType()))], _encoded)


def _encoded(model: PieceModel, texts: pa.Array) -> list[pa.Array]:
    ids, offsets = model.encode(texts)
    offsets = pa.array(offsets.astype(np.int32), mask=np.append(np.asarray(texts.is_null()), False))
    return [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))]


def decode(docs: DataFrame, ids: str = "ids", decoded: str = "decoded", model_path: str = MODEL_PATH) -> DataFrame:
    """``docs`` with the text of each array of ids; null for null."""
    def texts_of(model: PieceModel, lists: pa.Array) -> list[pa.Array]:
        # one text's ids at a time become Python numbers
        return [pa.array([model.decode(x.values.to_pylist()) if x.is_valid else None for x in lists], pa.string())]

    return _with_model(docs, ids, model_path, [T.StructField(decoded, T.StringType())], texts_of, by_bytes=False)


def _with_model(docs: DataFrame, column: str, model_path: str, fields: list, fn, by_bytes: bool = True) -> DataFrame:
    spark = tune(docs.sparkSession)
    sent = spark.sparkContext.broadcast(PieceModel.load(model_path))  # a vocabulary: a few MB, whatever the input

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, *fn(sent.value, batch.column(column))], names=[*batch.schema.names, *(f.name for f in fields)])

    def plain(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                yield one(batch.slice(at, 50))
        give_back()

    schema = T.StructType([f for f in docs.schema.fields if f.name not in {x.name for x in fields}] + fields)
    kept = docs.select(*[f"`{f.name}`" for f in docs.schema.fields if f.name not in {x.name for x in fields}])
    return kept.mapInArrow(by_slice(one, column, SLICE_BYTES) if by_bytes else plain, schema)
