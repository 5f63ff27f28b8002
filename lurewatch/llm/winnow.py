"""Benchmark decontamination by winnowing.

A text is a run of words: A-Z lower-cased, word characters are 0-9, a-z and everything beyond ASCII. A window is
``window`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document
word is hit if it lies inside any occurrence of any window.

1. Winnowing keeps, in every run of w consecutive k-grams, the one of least hash, the rightmost of equals. With
   k + w - 1 = window two texts that share ``window`` words keep the same k-gram of them, so no shared span of that
   length is missed. Items shorter than a window have a class of their own per length, with a smaller k and w.
2. A bitmap of the benchmark's fingerprints (bounded size, see ``bitmaps``) lets a task drop nearly all of a
   document's fingerprints at once. What passes carries its surroundings: the words that a window around it can
   reach, at most window - k on either side. Fingerprints of both sides are joined.
3. Hits are extended: each window of the surroundings that covers the fingerprint is looked up, as text, among the
   distinct windows of the benchmark. That join gives one row per document window at most, however many items share
   a passage. Windows that are in the same items share one item set; documents with the same sets share one list.

Results belong to texts, so exact copies are worked out once; a document's text is identified by 128 hash bits.
Windows are compared as text. Hashes only choose candidates, so a collision never adds or hides a hit.

Edge cases: a null or empty text has no words, no hits and no items. Items without words are never found; items with
a null id mark words as hit but are not listed; rows of one item id count as one item. Ids are listed as strings in
UTF-8 order. Repeated documents get the same answer each; an empty table gives an empty result, an empty benchmark
no hits. Extra columns are carried along unless they have the name of a result column. The document's text is not
carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from lurewatch.llm.bitmaps import bitmap_of, bits_for, maybe
from lurewatch.llm.common import materialize

RESULTS = ["n_words", "n_hit", "n_items", "items", "hits"]
#: Bytes of text that a task works on at a time; one longer text is taken alone, and hashed in pieces of this size.
PIECE = 1 << 20
_FPS = "array<struct<cls:int,h:long,pos:int,lead:int,ctx:string>>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        _POWERS = _powers(_BASE, max(n, PIECE + 1)), _powers(_INVERSE, max(n, PIECE + 1))
    return _POWERS


def word_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of lower-cased bytes; equal words have equal hashes."""
    starts, ends, hashes, at = [], [], [], 0
    while at < len(text):
        piece = text[at:at + PIECE]
        inside = _IS_WORD[piece]
        if at + len(piece) < len(text) and inside[-1]:  # a piece ends where no word is cut
            gaps = np.flatnonzero(~inside)
            if len(gaps):
                piece, inside = piece[:gaps[-1] + 1], inside[:gaps[-1] + 1]
            else:
                more = np.flatnonzero(~_IS_WORD[text[at:]])
                piece = text[at:at + (int(more[0]) + 1 if len(more) else len(text) - at)]
                inside = _IS_WORD[piece]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers_to(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[:len(piece)], out=total[1:])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(_mixed((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
        at += len(piece)
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def shape(length: int) -> tuple[int, int]:
    """(k, w) that find every shared span of ``length`` words: k + w - 1 = length."""
    k = (length + 1) // 2
    return k, length - k + 1


def winnowed(hashes: np.ndarray, text_of: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values) of the k-grams kept for spans of ``length`` words; ``text_of`` numbers each word's text."""
    k, w = shape(length)
    n = len(hashes) - length + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        grams = grams * _STEP + hashes[j:j + len(grams)]
    grams = _mixed(grams)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        lower = grams[j:j + n] <= best
        best[lower] = grams[j:j + n][lower]
        at[lower] = np.flatnonzero(lower) + j
    at = np.unique(at[text_of[:n] == text_of[length - 1:]])
    return at, grams[at]


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about a piece of text each."""
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > PIECE:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def _words_of_rows(texts: list[bytes]):
    """The words of some texts: buffer, starts, ends, hashes and the number of each word's text."""
    buffer = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    starts, ends, hashes = word_spans(buffer)
    first_byte = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return buffer.tobytes(), starts, ends, hashes, np.searchsorted(first_byte, starts, side="right") - 1


def _item_fingerprints(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(0)]
            for a, b in _slices(np.array([len(t) for t in texts])):
                _, _, _, hashes, text_of = _words_of_rows(texts[a:b])
                sizes = np.bincount(text_of, minlength=b - a) if len(text_of) else np.zeros(b - a, int)
                for cls in sorted(set(np.minimum(sizes, window).tolist()) - {0}):
                    own = np.minimum(sizes, window)[text_of] == cls  # only whole texts go, so words stay adjacent
                    _, values = winnowed(hashes[own], text_of[own], cls)
                    values = np.unique(values).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), cls, np.int32)), pa.array(values)], names=["cls", "h"])
    return run


def _document_rows(classes: list[int], shared, window: int):
    """Rows (_row, text) to (_row, d1, d2, n_words, fps); fps are the fingerprints that the bitmap lets pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            for a, b in _slices(lengths):
                part = batch.slice(a, b - a)
                texts = part.column("text").to_pylist()
                digests = np.array([divmod(xxhash.xxh3_128_intdigest(t), 1 << 64) for t in texts], np.uint64).reshape(-1, 2)
                buffer, starts, ends, hashes, text_of = _words_of_rows(texts)
                sizes = np.bincount(text_of, minlength=len(texts)).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(sizes)])
                found: list[list[tuple]] = [[] for _ in texts]
                for cls in classes:
                    at, values = winnowed(hashes, text_of, cls)
                    some = maybe(bitmap, values)
                    reach = cls - shape(cls)[0]
                    for p, h in zip(at[some].tolist(), values[some].view(np.int64).tolist()):
                        row = int(text_of[p])
                        lo, hi = max(int(first[row]), p - reach), min(int(first[row + 1]), p + cls)
                        context = b" ".join(buffer[s:e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist()))
                        found[row].append((cls, h, p - int(first[row]), p - lo, context.decode()))
                flat = [f for fs in found for f in fs]
                cls, h, pos, lead, ctx = zip(*flat) if flat else ((),) * 5
                structs = pa.StructArray.from_arrays(
                    [pa.array(cls, pa.int32()), pa.array(h, pa.int64()), pa.array(pos, pa.int32()), pa.array(lead, pa.int32()), pa.array(ctx, pa.string())],
                    names=["cls", "h", "pos", "lead", "ctx"])
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(digests[:, 0].view(np.int64)), pa.array(digests[:, 1].view(np.int64)), pa.array(sizes),
                     pa.ListArray.from_arrays(pa.array(offsets), structs)], names=["_row", "d1", "d2", "n_words", "fps"])
    return run


def words(text: str):
    """The words of a text column, by the same rule as the tasks, as a native expression."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), upper, lower),
                                F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def item_windows(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(win, item): the windows of every item as text; repeated ones once."""
    df = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), words(text).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    df = df.select("item", "w", size.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
    return df.select(F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("win"), "item").distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """The documents' other columns with n_words, n_hit, n_items, ``items`` (ids, sorted) and ``hits``, the hit word
    ranges [start, end) in order. ``n_hit > 0`` says that a document holds benchmark text."""
    spark = docs.sparkSession
    source = benchmark.select(F.coalesce(F.col(f"`{item_text}`"), F.lit("")).cast("binary").alias("t"))
    prints = materialize(source.mapInArrow(_item_fingerprints(window), "cls int, h long").distinct(), "test-fingerprints")
    sizes = {r["cls"]: r["count"] for r in prints.groupBy("cls").count().collect()}  # one row per class, at most window
    bitmap = spark.sparkContext.broadcast(bitmap_of(prints, "h", bits_for(sum(sizes.values()))))

    others = [c for c in docs.columns if c != text and c not in RESULTS]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("_"))
    base = docs.select(row.alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    schema = StructType([base.schema["_row"], *StructType.fromDDL("d1 long, d2 long, n_words long, fps " + _FPS).fields])
    scanned = materialize(base.mapInArrow(_document_rows(sorted(sizes), bitmap, window), schema), "document-fingerprints")

    # Training and test fingerprints meet; then every window around a hit that covers it.
    candidates = scanned.where(F.size("fps") > 0).select("d1", "d2", F.inline("fps"))
    near = candidates.join(prints, ["cls", "h"], "left_semi").withColumn("w", F.split("ctx", " ")).where("size(w) >= cls")
    near = near.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("cls"))))
    start = F.col("pos") - F.col("lead") + F.col("i")
    spans = near.select("d1", "d2", start.alias("start"), (start + F.col("cls")).alias("end"),
                        F.array_join(F.slice("w", F.col("i") + 1, F.col("cls")), " ").alias("win"))

    # Windows in the same items share one item set.
    by_window = item_windows(benchmark, window, item_id, item_text).groupBy("win").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    by_window = materialize(by_window.withColumn("set", F.sha2(F.to_json("items"), 256)), "test-windows")
    sets = by_window.select("set", F.explode("items").alias("item")).distinct()
    found = materialize(spans.join(by_window.select("win", "set"), "win").select(
        "d1", "d2", "start", "end", "set").distinct(), "document-windows")
    own = found.groupBy("d1", "d2").agg(F.sort_array(F.collect_set("set")).alias("sets"))
    own = own.withColumn("combo", F.sha2(F.array_join("sets", ","), 256))
    combos = own.select("combo", "sets").distinct().select("combo", F.explode("sets").alias("set"))
    lists = combos.join(sets, "set").select("combo", "item").distinct().groupBy("combo").agg(
        F.sort_array(F.collect_list("item")).alias("items"))
    # Windows that overlap or touch become one range of words.
    in_text = W.partitionBy("d1", "d2").orderBy("start", "end")
    reached = F.max("end").over(in_text.rowsBetween(W.unboundedPreceding, -1))
    ranges = found.select("d1", "d2", "start", "end").withColumn("gap", F.coalesce(F.col("start") > reached, F.lit(True)))
    ranges = ranges.withColumn("range", F.sum(F.col("gap").cast("long")).over(in_text.rowsBetween(W.unboundedPreceding, 0)))
    ranges = ranges.groupBy("d1", "d2", "range").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy(
        "d1", "d2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"))
    answers = ranges.join(own.select("d1", "d2", "combo"), ["d1", "d2"]).join(lists, "combo", "left").drop("combo")
    out = scanned.select("_row", "d1", "d2", "n_words").join(answers, ["d1", "d2"], "left")
    hits = F.coalesce("hits", F.expr("array_repeat(struct(0 AS start, 0 AS end), 0)"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return out.select(*[F.col("_row")[c].alias(c) for c in others], "n_words", n_hit.alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"), items.alias("items"), hits.alias("hits"))
