"""Line deduplication by range-partitioned line hashes.

Each document sends one small row per distinct line key (128-bit hash, document, line numbers), never text.
The rows are range-partitioned and sorted by (hash, document), so equal lines meet in order and one pass
streams them with a buffer of fewer than ``min_docs`` rows. A key that is so common that it covers several
partitions, or just crosses a border, is summed from its partial counts: at most two per partition.
What comes back per document is a compressed bitmap of the lines to keep.

Definitions: text is split at ``\\n``; a null or empty text is one empty line. A key is the line without
space and control characters 09 to 0D at both ends, A-Z lower-cased; an empty key is never removed. Rows
repeated with the same id and text count as one document and get the same answer. Every row with a null id is a
document of its own in the count; with ``keep="first"`` those of equal text keep the same lines. Extra columns are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lurewatch.llm.common import NO_ID, ids_of, materialize, string_of

STRIP = b" \t\n\x0b\x0c\r"
_ROWS = "h1 long, h2 long, doc long, txt long, pos binary"
_ROW_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("txt", pa.int64()),
                        ("pos", pa.binary())])


def _key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()  # on bytes, lower() changes A-Z only


def _positions(numbers: list[int]) -> bytes:
    """Line numbers as text bytes; most keys have one."""
    return b",".join(b"%d" % n for n in numbers)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, txt, text) to one row per distinct line key of the document."""
    digest = xxhash.xxh3_128_intdigest
    low = (1 << 64) - 1
    for batch in batches:
        docs, txts = batch.column("doc").to_pylist(), batch.column("txt").to_pylist()
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, txt, text in zip(docs, txts, batch.column("text").cast(pa.binary())):
            found: dict[bytes, list[int]] = {}
            for n, line in enumerate(text.as_py().split(b"\n")):
                if key := _key(line):
                    found.setdefault(key, []).append(n)
            for key, numbers in found.items():
                h = digest(key)
                for column, value in zip(out, (_signed(h >> 64), _signed(h & low), doc, txt, _positions(numbers))):
                    column.append(value)
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _ROW_ARROW.types)], schema=_ROW_ARROW)
                out = ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _ROW_ARROW.types)], schema=_ROW_ARROW)


_PASS = "kind byte, h1 long, h2 long, n long, doc long, txt long, pos binary"
_EDGE, _OPEN, _DROP = 0, 1, 2


def _stream(min_docs: int, keep_first: bool):
    """One pass over a sorted partition. Emits three kinds of rows: the count and first document of the
    partition's first and last key (edge); rows of those keys that the partition alone cannot decide (open);
    rows of lines to drop (drop)."""
    types = [pa.int8(), *[pa.int64()] * 5, pa.binary()]
    names = ["kind", "h1", "h2", "n", "doc", "txt", "pos"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, member, n, first, held, at_start = None, None, 0, None, [], True
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "doc", "txt", "pos"))):
                if row[:2] != key:  # what is held of the key before has too few documents
                    if key is not None and at_start:
                        out.append((_EDGE, *key, n, *first, b""))
                        at_start = False
                    at_start = at_start and key is None
                    key, member, n, first, held = row[:2], None, 0, row[2:4], []
                if row[2:4] == member and row[2] != NO_ID:
                    continue  # a repeated row
                member, n = row[2:4], n + 1
                if at_start:
                    out.append((_OPEN, *key, 0, *row[2:]))
                    continue
                held.append(row)
                if n >= min_docs:
                    out.extend((_DROP, *key, 0, *r[2:4], _rest(r[4]) if keep_first and r[2:4] == first else r[4])
                               for r in held)
                    held = []
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if key is not None:
            out.append((_EDGE, *key, n, *first, b""))
            out.extend((_OPEN, *key, 0, *r[2:]) for r in held)
        yield batch_of(out)

    return run


def _rest(pos: bytes) -> bytes:
    return pos.partition(b",")[2]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents with ``_doc`` and ``_txt``, a null-safe identity of the row, and ``_text``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       ids_of(f"`{doc_id}`").alias("_doc"), F.xxhash64(F.col(f"`{text}`")).alias("_txt"),
                       string_of(f"`{text}`").alias("_text"))


def dropped_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none", doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """(doc, txt, pos): the lines whose key is in at least ``min_docs`` documents.

    ``keep`` is ``none`` (all lines of such a key go) or ``first`` (the first occurrence by document and line
    stays). The result of the pass is written to the shared folder, since its edge counts and rows are both read.
    """
    if keep not in ("none", "first"):
        raise ValueError(keep)
    base = keyed(docs, doc_id, text).select(F.col("_doc").alias("doc"), F.col("_txt").alias("txt"),
                                            F.col("_text").alias("text"))
    order = ["h1", "h2", "doc", "txt"]
    rows = base.mapInArrow(_line_rows, _ROWS)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    passed = materialize(ranged.mapInArrow(_stream(min_docs, keep == "first"), _PASS), "line-pass")
    edges = passed.where(F.col("kind") == _EDGE)  # at most two rows per partition
    first = F.min(F.struct("doc", "txt"))
    hot = edges.groupBy("h1", "h2").agg(F.sum("n").alias("_n"), first.alias("_first")).where(F.col("_n") >= min_docs)
    late = passed.where(F.col("kind") == _OPEN).join(F.broadcast(hot), ["h1", "h2"])
    if keep == "first":
        is_first = F.struct("doc", "txt") == F.col("_first")
        rest = F.regexp_replace(F.col("pos").cast("string"), "^[0-9]+,?", "").cast("binary")
        late = late.withColumn("pos", F.when(is_first, rest).otherwise(F.col("pos")))
    return passed.where(F.col("kind") == _DROP).select("doc", "txt", "pos").unionByName(late.select("doc", "txt", "pos"))


def _bitmap(lists: pd.Series) -> pd.Series:
    def pack(parts) -> bytes:
        gone = {int(n) for part in parts for n in part.split(b",") if n}
        if not gone:
            return b""
        bits = np.ones(max(gone) // 8 * 8 + 8, dtype=bool)
        bits[list(gone)] = False
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes())

    return lists.map(pack)


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, txt, keep): per document with dropped lines a compressed bitmap, bit n set when line n stays.
    Lines past its end stay."""
    pack = F.pandas_udf(_bitmap, "binary")
    return dropped.groupBy("doc", "txt").agg(F.collect_list("pos").alias("_pos")).select(
        "doc", "txt", pack("_pos").alias("keep"))


def kept_text(text: str, keep: bytes | None) -> tuple[int, int, str]:
    """(lines, dropped lines, text of the lines that stay) for one document."""
    lines = text.split("\n")
    if not keep:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little").tolist()[:len(lines)]
    kept = [line for line, bit in zip(lines, bits) if bit] + lines[len(bits):]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def _apply(texts: pd.Series, keeps: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kept_text(t, k) for t, k in zip(texts, keeps)], columns=["n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none", doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``_row`` (the input row as a struct), ``n_lines``, ``n_dropped`` and ``kept``, the text that stays."""
    bitmaps = keep_bitmaps(dropped_lines(docs, min_docs, keep, doc_id, text))
    bitmaps = materialize(bitmaps, "line-bitmaps").toDF("_doc", "_txt", "_keep")
    # How many documents lose lines has no bound: always a sort-merge join, also where the planner would broadcast.
    joined = keyed(docs, doc_id, text).join(bitmaps.hint("merge"), ["_doc", "_txt"], "left")
    apply = F.pandas_udf(_apply, "n_lines long, n_dropped long, kept string")
    return joined.select("_row", apply("_text", "_keep").alias("_a")).select("_row", "_a.*")


def cleaned(docs: DataFrame, min_docs: int = 10, keep: str = "none", doc_id: str = "doc_id", text: str = "text",
            length: str = "n_chars") -> DataFrame:
    """The documents, same columns, with the lines that stay as text and ``length``, if there, brought up to date.
    A null text stays null."""
    rows = dedup_lines(docs, min_docs, keep, doc_id, text)
    new = {text: F.when(F.col("_row")[text].isNotNull(), F.col("kept"))}
    if length in docs.columns:
        new[length] = F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema[length].dataType)).otherwise(F.col("_row")[length])
    return rows.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])
