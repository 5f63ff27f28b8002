"""Byte-level BPE: encoding by merge ranks and decoding.

A text is cut by the vocabulary's pattern and each match is encoded alone: a match that is a token as it stands
becomes that token, any other starts as single bytes, and the adjacent pair of lowest rank, the leftmost of
equals, is merged until no pair has a rank. The pairs' ranks sit in a segment tree over byte positions that knows
the leftmost minimum; a merge changes at most three positions, the pair itself, its left and its right neighbour,
each in logarithmic time, so a match of a million bytes takes about a million times twenty steps. Repeated
matches come from a table of bounded size, which changes speed only.

Edge cases: a null or empty text has no tokens. Repeated rows are encoded alike; an empty table gives an empty
result. Lone bytes need no care: every byte is a token. Other columns are not touched. Decoding gives bytes, which
are the text's UTF-8 for ids that came from a text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: Bytes of matches and ids kept per worker process, in two generations of this size.
CACHED = 32 << 20
#: Bytes of text that are encoded and decoded before their rows leave the task; one longer text is taken alone.
SLICE = 2 << 20
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1
    while width < n - 1:
        width *= 2
    rank_of = ranks.get
    # Leaf p holds rank * n + p of the pair that starts at byte p; the root is the leftmost pair of lowest rank.
    tree = [_NONE] * (2 * width)
    for p in range(n - 1):
        rank = rank_of(piece[p:p + 2])
        if rank is not None:
            tree[width + p] = rank * n + p
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    last = n - 1
    while (low := tree[1]) != _NONE:
        p = low % n
        gone = following[p]
        after = following[p] = following[gone]
        before = previous[p]
        changes = []
        if gone < last:
            changes.append((gone, _NONE))
        if after < n:
            previous[after] = p
            rank = rank_of(piece[p:following[after]])
            changes.append((p, _NONE if rank is None else rank * n + p))
        else:
            changes.append((p, _NONE))
        if before >= 0:
            rank = rank_of(piece[before:after])
            changes.append((before, _NONE if rank is None else rank * n + before))
        for position, value in changes:
            i = width + position
            if tree[i] == value:
                continue
            tree[i] = value
            while i > 1:  # up to the root, or to where the minimum stays
                other = tree[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
                if tree[i] == value:
                    break
                tree[i] = value
    ids, p = [], 0
    while p < n:
        ids.append(ranks[piece[p:following[p]]])
        p = following[p]
    return ids


class Codec:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def forget(self) -> None:
        self.known, self.older, self.held = {}, {}, 0

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        add, get = out.extend, known.get
        for match in self.find(text):
            ids = get(match)
            if ids is None:
                ids = self.older.get(match) or tuple(merge(match.encode(), self.ranks))
                if len(match) <= 64:
                    self.held += 200 + 5 * len(match) + 8 * len(ids)  # about what an entry takes
                    if self.held >= CACHED:  # what was seen lately stays, the rest goes
                        self.older, self.known, self.held = known, {}, 0
                        known = self.known
                        get = known.get
                    known[match] = ids
            add(ids)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[int, Codec] = {}


def _codec_of(shared: Broadcast) -> Codec:
    """One codec per worker process; its table of matches outlives a task."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else shared._path
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*shared.value)
    return _CODECS[key]


def _slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``SLICE`` bytes of text each."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
        if held and held + n > SLICE:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(text):
        yield start, len(text)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *arrays])))


class Tokenizer:
    """Encoder and decoder of one vocabulary; its ranks, a table of fixed size, are broadcast once."""

    def __init__(self, spark, path: str, pattern: str):
        shared = spark.sparkContext.broadcast((read_ranks(path), pattern))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec_of(shared)
            for batch in batches:
                for a, b in _slices(batch.column(1)):
                    part = batch.slice(a, b - a)
                    ids = [np.array(codec.encode(t.as_py() or ""), np.int32) for t in part.column(1)]
                    back = pa.array([codec.decode(i.tolist()) for i in ids], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids), back], names=["_row", "ids", "decoded"])
            codec.forget()  # the worker process outlives the task
            pa.default_memory_pool().release_unused()

        @F.arrow_udf("binary")
        def decode(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = _codec_of(shared)
            for array in lists:
                yield pa.array([codec.decode(ids.values.to_numpy().tolist()) for ids in array], pa.binary())

        self.run, self._decode = run, decode

    def decode(self, ids: Column) -> Column:
        """The bytes of a column of token ids."""
        return self._decode(ids)


def tokenized(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents with ``ids``, their token ids, and ``decoded``, the bytes that the ids stand for. One pass encodes and
    decodes slices of the text, so that a task holds the ids and bytes of a slice only."""
    own = [c for c in docs.columns if c not in ("ids", "decoded") and (keep_text or c != text)]
    row = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(None).cast("int").alias("_"))
    rows = docs.select(row.alias("_row"), F.col(f"`{text}`").alias("_text"))
    done = rows.mapInArrow(tokenizer.run, StructType([StructField("_row", rows.schema["_row"].dataType),
                                                      StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())]))
    return done.select(*[F.col("_row")[c].alias(c) for c in own], "ids", "decoded")


def with_digests(rows: DataFrame) -> DataFrame:
    """Add n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256."""
    return rows.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256),
        "decoded_sha256": F.sha2("decoded", 256)})
