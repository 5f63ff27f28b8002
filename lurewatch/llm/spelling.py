"""Spelling variant grouping: words of a vocabulary that differ in one code point, found in a bidirectional FM-index.

``vocabulary`` counts words natively. ``variants`` finds, for each word, all words that differ from it by exactly
one inserted, deleted or replaced code point:

* A search scheme of two searches. A word is cut into halves; with one error one of them is intact. Search 1 matches
  the left half exactly, from the delimiter before it, and goes on to the right allowing one error; search 2 matches the
  right half exactly, from the delimiter behind it, and goes on to the left. A word that search 1 finds is left
  out of search 2, so both together count each near word once.
* The index covers a block of words joined by delimiters. Its text and its reversed text are each kept as the
  sorted list of (character, rank of the preceding suffix), so that one binary search narrows an interval of suffix ranks
  by one character. Search 1 runs in the reversed text's index and search 2 in the text's; as each goes in one
  direction only, the two intervals need not be kept in step. All searches of a block advance together as numpy arrays.
* Words have ``min_length`` of six code points or more, so a half has three. A word and its near word thus share the first
  three code points (search 1) or the last three (search 2): vocabulary and searches are dealt by that key. Small keys
  are bundled by hash; a key with more than ``BLOCK`` words is cut into blocks, and every pair of an index block and a
  search block is a group of its own. No group holds more than about two blocks. Only a count and the best near word
  leave a task, never pairs.

``rooted`` follows each word's form to the last by pointer doubling. A form has five times the word's count, so
chains are shorter than the logarithm of the largest count.

Edge cases: a null or empty text has no words; a null document id counts as an empty text in the hash. Repeated rows
count each. Ties between near words of equal count go to the smaller in code-point order. An empty table gives an
empty result. Extra columns are ignored. A word of any length is handled; the index is as long as its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lurewatch.llm.common import materialize, release

BLOCK = 16_384
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5, typo_every: int = 199, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """(word, n). Runs of letters, A-Z lower-cased; a run whose crc32 with its document's id is divisible by
    ``typo_every`` loses one code point, which plants misspellings (0 plants none)."""
    # Deleting never makes a run longer, so shorter runs need not be looked at.
    runs = F.regexp_extract_all(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER),
                                F.lit(rf"[a-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    df = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.col("run")
    if typo_every:
        df = df.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = F.pmod("h", F.length("run")).cast("int")
        word = F.when(F.pmod("h", F.lit(typo_every)) == 0, F.concat(
            F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length("run")))).otherwise(word)
    words = df.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes by prefix doubling; the text ends with a character found nowhere else."""
    rank, step, n = text.astype(np.int64), 1, len(text)
    while True:
        second = np.zeros(n, np.int64)
        second[:max(n - step, 0)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search in one text. ``narrow`` prepends a character to what the intervals match."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.suffixes, self.n, self.sigma = suffix_array(text), len(text), sigma
        self.before = text[self.suffixes - 1]  # the character before each suffix, in suffix order
        self.steps = np.sort(self.before * self.n + np.arange(self.n))

    def narrow(self, lo: np.ndarray, hi: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = char * self.n
        return np.searchsorted(self.steps, base + lo), np.searchsorted(self.steps, base + hi)

    def branches(self, lo: np.ndarray, hi: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which interval, letter): the letters that can come next. Short intervals are read, long ones probed."""
        size = hi - lo
        short = np.flatnonzero(size <= len(letters))
        long = np.flatnonzero(size > len(letters))
        owner = np.repeat(short, size[short])
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size[short]) - size[short], size[short]) + lo[owner]
        key = np.unique(owner * self.sigma + self.before[at])
        key = np.concatenate([key, (long[:, None] * self.sigma + letters).ravel()])
        char = key % self.sigma
        some = char >= 2  # delimiter and end are no letters
        return key[some] // self.sigma, char[some]


def near_in_block(words: list[str], is_index: np.ndarray, is_query: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, near): pairs of row numbers found by one of the two searches, each pair once.

    ``side`` 0 keeps the left half, 1 the right half. A reversed word makes the right half a left half, so search 2
    is search 1 over reversed words, read in the text's own index.
    """
    if not is_index.any() or not is_query.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    alphabet = np.unique(code)
    code = np.searchsorted(alphabet, code) + 2
    sigma = len(alphabet) + 2
    letters = np.arange(2, sigma)
    size = np.array([len(w) for w in words])
    first = np.cumsum(size) - size
    indexed = np.flatnonzero(is_index)
    # Delimited vocabulary: 1 w1 1 w2 1 ... 1 0, reversed for the search that goes to the right.
    pieces = [np.concatenate([[1], code[first[i]:first[i] + size[i]]]) for i in indexed]
    text = np.concatenate([*pieces, [1]])
    word_at = np.cumsum(size[indexed] + 1) - size[indexed] - 1  # the delimiter before each word
    if side == 0:
        text = text[::-1]
    index = FMIndex(np.concatenate([text, [0]]), sigma)
    queries = np.flatnonzero(is_query)
    length = size[queries]
    longest = int(length.max())
    # Characters in the order in which they are matched.
    j = np.arange(longest)
    where = first[queries][:, None] + (j if side == 0 else length[:, None] - 1 - j)
    inside = j < length[:, None]
    pattern = np.where(inside, code[np.where(inside, where, 0)], 0)
    exact = length // 2 if side == 0 else length - length // 2

    one = np.ones(len(queries), np.int64)
    lo, hi = index.narrow(0 * one, index.n * one, one)  # the delimiter
    q, done, found_q, found_lo = np.arange(len(queries)), 0 * one, [], []
    late_q, late_j, late_lo, late_hi = [], [], [], []  # searches that have had their error
    while len(q):
        # One error is allowed once the exact half is matched; both kinds that use a letter share its interval.
        open_ = done >= exact[q]
        at, char = index.branches(lo[open_], hi[open_], letters)
        oq, oj = q[open_][at], done[open_][at]
        l, h = index.narrow(lo[open_][at], hi[open_][at], char)
        some = h > l
        oq, oj, l, h, char = oq[some], oj[some], l[some], h[some], char[some]
        swap = (oj < length[oq]) & (char != pattern[oq, np.minimum(oj, longest - 1)])
        skip = open_ & (done < length[q])
        late_q += [oq, oq[swap], q[skip]]
        late_j += [oj, oj[swap] + 1, done[skip] + 1]
        late_lo += [l, l[swap], lo[skip]]
        late_hi += [h, h[swap], hi[skip]]
        go = done < length[q]
        q, done, lo, hi = q[go], done[go], lo[go], hi[go]
        lo, hi = index.narrow(lo, hi, pattern[q, done])
        go = hi > lo
        q, done, lo, hi = q[go], done[go] + 1, lo[go], hi[go]
    q, done, lo, hi = (np.concatenate(x) for x in (late_q, late_j, late_lo, late_hi))
    while len(q):
        end = done == length[q]
        l, h = index.narrow(lo[end], hi[end], np.ones(int(end.sum()), np.int64))
        some = h > l
        found_q.append(q[end][some])
        found_lo.append(l[some])
        q, done, lo, hi = q[~end], done[~end], lo[~end], hi[~end]
        lo, hi = index.narrow(lo, hi, pattern[q, done])
        go = hi > lo
        q, done, lo, hi = q[go], done[go] + 1, lo[go], hi[go]
    fq, fl = np.concatenate(found_q), np.concatenate(found_lo)
    # A whole word with both delimiters is in the index once: its suffix rank gives its place.
    place = index.suffixes[fl]
    if side == 0:
        place = len(text) - 1 - place  # of the delimiter behind the word, in reading order
        hit = np.searchsorted(word_at, place) - 1
    else:
        hit = np.searchsorted(word_at, place)
    pair = np.unique(fq * len(words) + indexed[hit])
    a, b = queries[pair // len(words)], pair % len(words)
    keep = a != b
    return a[keep], b[keep]


def _near(rows: pa.Table) -> pa.Table:
    """One group: (side, word, n, is_index, is_query) to (word, n_near, best_n, best) of its searches."""
    words = rows.column("word").to_pylist()
    n = rows.column("n").to_numpy()
    is_index = rows.column("is_index").to_numpy(zero_copy_only=False)
    is_query = rows.column("is_query").to_numpy(zero_copy_only=False)
    side = rows.column("side")[0].as_py()
    a, b = near_in_block(words, is_index, is_query, side)
    if side == 1:  # those that the first search finds as well: the left half is the same
        own = np.array([words[y].startswith(words[x][:len(words[x]) // 2]) for x, y in zip(a.tolist(), b.tolist())], bool)
        a, b = a[~own], b[~own]
    by_word = np.argsort(np.array(words, object), kind="stable")  # strings compare by code point
    rank = np.empty(len(words), np.int64)
    rank[by_word] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    count = np.diff(np.append(start, len(a)))
    return pa.table({"word": pa.array([words[i] for i in a[start].tolist()], pa.string()), "n_near": pa.array(count.astype(np.int64)),
                     "best_n": pa.array(n[b[start]].astype(np.int64)), "best": pa.array([words[i] for i in b[start].tolist()], pa.string())})


def variants(words: DataFrame, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n) for a stored vocabulary (word, n) of words of six code points or more. ``form`` is the
    near word of largest count if that is at least ``ratio`` times the word's own, else null."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, 3).alias("key")),
                   F.struct(F.lit(1).alias("side"), F.expr("right(word, 3)").alias("key")))
    keyed = words.select("word", "n", F.inline(ends))
    bundles = -(-words.count() // block) or 1
    sizes = keyed.groupBy("side", "key").agg(F.count(F.lit(1)).alias("size"))
    keyed = keyed.join(sizes, ["side", "key"])
    blocks = F.ceil(F.col("size") / block).cast("int")
    keyed = keyed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    small = F.col("blocks") == 1
    keyed = keyed.withColumn("group", F.when(small, F.pmod(F.xxhash64("key"), F.lit(bundles)).cast("string")).otherwise(
        F.concat(F.lit("="), F.col("key"))))
    # A word is in the index of its own block against every search block, and searches every index block.
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    as_index = keyed.select("side", "group", F.col("own").alias("i"), everywhere.alias("j"), "own", "word", "n")
    as_query = keyed.where("blocks > 1").select("side", "group", everywhere.alias("i"), F.col("own").alias("j"), "own", "word", "n").where("i <> j")
    rows = as_index.withColumn("is_index", F.lit(True)).withColumn("is_query", F.col("j") == F.col("own"))
    rows = rows.unionByName(as_query.withColumn("is_index", F.lit(False)).withColumn("is_query", F.lit(True)))
    found = rows.drop("own").groupBy("side", "group", "i", "j").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("form"))).alias("b"))
    out = words.join(near, "word", "left")
    large = -F.col("b.m") >= F.lit(ratio) * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("b.form")).alias("form"),
                      F.when(large, -F.col("b.m")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """Add ``root``: the last of word, form, form of the form and so on; the word itself if it has none."""
    stored = materialize(forms, "spelling-forms")
    to = materialize(stored.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                   F.col("next").isNotNull().alias("moved")), "spelling-roots")
        release(to)
        to = joined
        if not to.where("moved").take(1):
            break
    return stored.join(to.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped_spellings(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, typo_every: int = 0,
                      doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of a corpus."""
    if min_length < 6:
        raise ValueError("words of fewer than six code points have halves too short for the key of three")
    words = materialize(vocabulary(docs, min_length, min_count, typo_every, doc_id, text), "vocabulary")
    return rooted(variants(words, ratio, block))
