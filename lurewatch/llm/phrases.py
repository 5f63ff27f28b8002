"""Phrase collocation mining by direct-address tiling.

A text, A-Z lower-cased, is split into pieces at ``.,;:!?`` and the controls 0A to 0D, a piece into words at spaces and
tabs. Everything is counted per language. Candidates are phrases of 2 to ``longest`` words found ``min_count`` times.

* Level by level: the phrases of L words that are frequent get numbers by falling frequency, and a phrase of L + 1 words
  is a pair of overlapping numbered phrases. A phrase that is frequent has only frequent parts, so nothing else
  is looked at; frequent pairs are thus numbered again and paired recursively.
* A task counts the pairs of a piece of text (about ``PIECE`` bytes). The table of pairs of numbers is cut into tiles of
  TILE x TILE cells. Numbers go by frequency, so the first tiles are full: a tile with many pairs is counted by one dense
  ``bincount`` with the cell as address; the pairs of all other tiles are sorted as coordinates and counted by runs.
* Only the ``HEAD`` most frequent phrases of a level, of at most ``HEAD_BYTES`` bytes each, are sent to the tasks with
  their numbers; that bounds the broadcast. All other frequent phrases, in any number, are let through by a bitmap of
  bounded size and get numbers of their own within a piece of text. What passes it wrongly is infrequent, and so is
  every phrase that holds it: it drops out when counts are added up. So the bounds change speed only. A pair of
  head phrases leaves its task as two numbers, any other as text.
* Tasks send counts, Spark adds them up. A language or word that holds a third of all rows is combined
  within each task first.

``collocations`` scores every cut of a candidate, keeps the lowest, drops candidates that live inside a longer one and
ranks per language. Products use decimals of 38 digits.

Edge cases: a null text is empty and has no words; a null language counts as ``und``. Repeated rows count each. An
empty table gives an empty result. Extra columns are ignored. Very long texts are a piece of text of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from lurewatch.llm.bitmaps import bitmap_of, bits_for, maybe
from lurewatch.llm.common import materialize, release

TILE = 2048
DENSE = TILE * TILE // 16  # pairs from which on a tile is counted densely
PIECE = 8 << 20
HEAD, HEAD_BYTES = 131_072, 64
TURN = 17  # bits by which the hash of each further word is turned
_TOKENS = re.compile(rb"[.,;:!?\n-\r]|[^ \t.,;:!?\n-\r]+")
_BREAKS = [bytes([b]) for b in b".,;:!?\n\x0b\x0c\r"]
_COUNTS = "lang string, left int, right int, phrase string, n long"
_HASH = (f"aggregate(transform(split(phrase, ' '), (w, i) -> shiftleft(xxhash64(w), {TURN} * i) | "
         f"shiftrightunsigned(xxhash64(w), 64 - {TURN} * i)), xxhash64(lang), (x, y) -> x ^ y)")


def _hash(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, seed=42)  # Spark's xxhash64


class _Words(dict):
    """Word to number, -1 for what cannot be frequent. The first numbers are those of the head; words that the
    bitmap lets through get the following ones as they turn up in this piece of text. ``hashes`` goes by number."""

    def __init__(self, head: dict[bytes, int], bitmap: np.ndarray, salt: int):
        super().__init__(dict.fromkeys(_BREAKS, -1))
        self.update(head)
        self.bitmap, self.mask, self.salt = bitmap.tobytes(), len(bitmap) * 8 - 1, salt
        self.hashes = [_hash(w) for w in head]

    def __missing__(self, word: bytes) -> int:
        h = _hash(word)
        low = (h ^ self.salt) & self.mask
        if self.bitmap[low >> 3] >> (low & 7) & 1:
            number = len(self.hashes)
            self.hashes.append(h)
        else:
            number = -1
        self[word] = number
        return number


def pair_counts(left: np.ndarray, right: np.ndarray, dense: int = DENSE, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """(position, count) of every distinct pair; the position is one where it stands."""
    if not len(left):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    across = int(max(left.max(), right.max())) // tile + 1
    tile_of = (left // tile) * across + right // tile
    full = np.flatnonzero(np.bincount(tile_of) >= dense)
    at, n = [], []
    for t in full.tolist():
        own = np.flatnonzero(tile_of == t)
        cell = (left[own] % tile) * tile + right[own] % tile
        count, place = np.bincount(cell, minlength=tile * tile), np.empty(tile * tile, np.int64)
        place[cell] = own
        used = np.flatnonzero(count)
        at.append(place[used])
        n.append(count[used])
    rest = np.flatnonzero(~np.isin(tile_of, full))
    if len(rest):
        key = left[rest] * (int(right.max()) + 1) + right[rest]
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        at.append(rest[order[start]])
        n.append(np.diff(np.append(start, len(rest))))
    return np.concatenate(at), np.concatenate(n)


def _pairs(u: np.ndarray) -> np.ndarray:
    """Where a numbered phrase is followed by another."""
    return np.flatnonzero((u[:-1] >= 0) & (u[1:] >= 0)) if len(u) > 1 else np.empty(0, np.int64)


def _renumbered(u: np.ndarray, tokens: list[bytes], width: int, head: dict[bytes, int], bitmap: np.ndarray,
                hashes: np.ndarray, salt: int) -> np.ndarray:
    """Numbers of phrases of ``width`` words from those of ``width`` - 1; ``hashes`` are those of the words by position."""
    out, at = np.full(len(u), -1, np.int64), _pairs(u)
    h = np.full(len(at), salt, np.uint64)
    for j in range(width):
        word, turn = hashes[at + j], np.uint64(TURN * j % 64)
        h ^= word if not turn else (word << turn) | (word >> (np.uint64(64) - turn))
    at = at[maybe(bitmap, h)]
    if not len(at):
        return out
    _, first, which = np.unique(u[at] * (int(u.max()) + 1) + u[at + 1], return_index=True, return_inverse=True)
    new = np.array([head.get(b" ".join(tokens[p:p + width]), -1) for p in at[first].tolist()], np.int64)
    tail = np.flatnonzero(new < 0)
    new[tail] = len(head) + np.arange(len(tail))
    out[at] = new[which]
    return out


def _counter(level: int, shared):
    """Rows (lang, text) to counts of the phrases of ``level`` words whose parts may all be frequent. For level 1
    these are all words, and a row without phrase carries the number of words."""
    def count(lang: str, texts: list[bytes]):
        """(left, right, n) of head pairs and (phrases, n) of the others."""
        tokens = _TOKENS.findall(b"\n".join(texts).lower())  # on bytes, lower() changes A-Z only
        none = np.empty(0, np.int64)
        if level == 1:
            found = Counter(tokens)
            for b in _BREAKS:
                found.pop(b, None)
            return none, none, none, [None, *found], [sum(found.values()), *found.values()]
        salt = _hash(lang.encode())
        head, bitmap = shared.value[0][0].get(lang, {}), shared.value[0][1]
        words = _Words(head, bitmap, salt)
        u = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        if level > 2:
            hashes = np.array([*words.hashes, 0], np.uint64)[u]
        for width in range(2, level):
            head, bitmap = shared.value[width - 1][0].get(lang, {}), shared.value[width - 1][1]
            u = _renumbered(u, tokens, width, head, bitmap, hashes, salt)
        both = _pairs(u)
        at, n = pair_counts(u[both], u[both + 1])
        at = both[at]
        plain = (u[at] < len(head)) & (u[at + 1] < len(head))
        return u[at[plain]], u[at[plain] + 1], n[plain], [b" ".join(tokens[p:p + level]) for p in at[~plain].tolist()], n[~plain].tolist()

    def batch(lang, left, right, phrases, n) -> pa.RecordBatch:
        size, null = len(n), lambda t: pa.nulls(len(n), t)
        return pa.RecordBatch.from_arrays([
            pa.DictionaryArray.from_arrays(np.zeros(size, np.int32), pa.array([lang])).cast(pa.string()),
            null(pa.int32()) if left is None else pa.array(left.astype(np.int32)), null(pa.int32()) if right is None else pa.array(right.astype(np.int32)),
            null(pa.string()) if phrases is None else pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
            names=["lang", "left", "right", "phrase", "n"])

    def rows(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            left, right, n, phrases, m = count(lang, texts)
            for i in range(0, len(n), 100_000):
                yield batch(lang, left[i:i + 100_000], right[i:i + 100_000], None, n[i:i + 100_000])
            for i in range(0, len(m), 100_000):
                yield batch(lang, None, None, phrases[i:i + 100_000], m[i:i + 100_000])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = text.as_py()
                if size and size + len(text) > PIECE:
                    yield from rows(held)
                    held, size = {}, 0
                held.setdefault(lang, []).append(text)
                size += len(text)
        if held:
            yield from rows(held)

    return run


def _head_and_bitmap(level: DataFrame, head: int) -> tuple[DataFrame, dict[str, dict[bytes, int]], np.ndarray]:
    """Numbers of the most frequent phrases per language, ``head`` in all at most, as a table and as a lookup, and a
    bitmap of all phrases of the level.

    Counts fall into at most 512 classes; the head takes whole classes from the top, so no task sorts the level.
    """
    short = F.octet_length("phrase") <= HEAD_BYTES
    cls = F.floor(F.log2("a") * 8).cast("int")
    classes = level.groupBy(cls.alias("c")).agg(F.count_if(short).alias("n"), F.count(F.lit(1)).alias("all")).collect()
    least, held = 1 << 30, 0
    for r in sorted(classes, key=lambda r: -r["c"]):
        if held + r["n"] > head:
            break
        least, held = r["c"], held + r["n"]
    order = W.partitionBy("lang").orderBy(F.desc("a"), "phrase")  # of at most ``head`` short rows
    table = materialize(level.where(short & (cls >= least)).select(
        "lang", "phrase", (F.row_number().over(order) - 1).alias("number")), "phrase-numbers")
    heads: dict[str, dict[bytes, int]] = {}
    for r in sorted(table.collect(), key=lambda r: r["number"]):
        heads.setdefault(r["lang"], {})[r["phrase"].encode()] = r["number"]
    every = level.select(F.expr(_HASH).alias("h"))
    return table, heads, bitmap_of(every, "h", bits_for(sum(r["all"] for r in classes)))


def phrase_counts(docs: DataFrame, min_count: int = 30, longest: int = 4, lang: str = "lang", text: str = "text",
                  head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """((lang, n) words per language, (lang, phrase, words, a) phrases of up to ``longest`` words found ``min_count`` times)."""
    source = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"),
                         F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    spark, known, levels, totals, table = docs.sparkSession, [], [], None, None
    for level in range(1, longest + 1):
        shared = spark.sparkContext.broadcast(known)
        parts = source.mapInArrow(_counter(level, shared), _COUNTS).groupBy("lang", "left", "right", "phrase").agg(F.sum("n").alias("a"))
        if level == 1:
            kept = materialize(parts.where((F.col("a") >= min_count) | F.col("phrase").isNull()).select("lang", "phrase", "a"), "phrases-1")
            totals = kept.where("phrase IS NULL").select("lang", F.col("a").alias("n"))
            kept = kept.where("phrase IS NOT NULL")
        else:  # numbers back to words
            frequent = materialize(parts.where(F.col("a") >= min_count), "phrase-pairs")
            named = frequent.where("phrase IS NULL").join(table.select("lang", F.col("number").alias("left"), F.col("phrase").alias("p")), ["lang", "left"])
            named = named.join(table.select("lang", F.col("number").alias("right"), F.col("phrase").alias("q")), ["lang", "right"])
            named = named.select("lang", F.concat_ws(" ", "p", F.substring_index("q", " ", -1)).alias("phrase"), "a")
            kept = materialize(frequent.where("phrase IS NOT NULL").select("lang", "phrase", "a").unionByName(named), f"phrases-{level}")
            release(frequent, table)
        levels.append(kept.select("lang", "phrase", F.lit(level).alias("words"), "a"))
        if level < longest:
            table, heads, bitmap = _head_and_bitmap(kept, head)
            known = [*known, (heads, bitmap)]
    out = levels[0]
    for other in levels[1:]:
        out = out.unionByName(other)
    return totals, out


def collocations(docs: DataFrame, min_count: int = 30, longest: int = 4, top: int = 2000, scale: int = 2_000_000, inside: int = 80,
                 lang: str = "lang", text: str = "text", head: int = HEAD) -> DataFrame:
    """The ``top`` phrases per language: lang, rank, phrase, a, l, r, n, score.

    The score is floor(scale * a / (l + r)) of the cut where it is lowest, ties to the shortest first part. A phrase goes
    if a longer candidate that holds it, kept or not, has ``inside`` percent of its count.
    """
    totals, counts = phrase_counts(docs, min_count, longest, lang, text, head)
    pick = counts.select("lang", F.col("phrase").alias("part"), "a")
    phrases = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    cut = phrases.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                     F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    cut = cut.join(pick.withColumnsRenamed({"part": "first", "a": "l"}), ["lang", "first"])
    cut = cut.join(pick.withColumnsRenamed({"part": "rest", "a": "r"}), ["lang", "rest"])
    score = F.expr(f"CAST({scale} AS DECIMAL(38,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    # The largest count of a longer candidate around each phrase.
    sizes = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m")
    parts = phrases.where("words > 2").select("lang", "w", "words", "a", sizes)
    parts = parts.select("lang", "w", "m", "a", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    around = parts.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    wide = F.lit(100).cast("decimal(38,0)") * F.col("longer").cast("decimal(19,0)") >= F.lit(inside).cast("decimal(38,0)") * F.col("a").cast("decimal(19,0)")
    kept = lowest.join(around, ["lang", "phrase"], "left").where(~F.coalesce(wide, F.lit(False)))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ranked.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
