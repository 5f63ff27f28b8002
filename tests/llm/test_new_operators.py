"""Winnowing, spelling variants and collocations against plain Python, on edge rows and small limits."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import bitmaps, phrases, spelling, winnow

DOCS = "doc_id long, text string, lang string, win string, `n_hit` int, h long, `odd name` int"
BENCH = "item_id long, text string, cls string"
LONG = " ".join(f"w{i % 389}x{i % 7}" for i in range(30_000))


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("alpha Beta gamma-delta ÉTÉ x1 99".split()) for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 30])))) for i in range(12)]
    rows += [(40, LONG[500:900]), (41, LONG[500:900]), (None, "null id item here"), (42, None), (43, " .,\t"), (44, "Short ITEM"), (44, "another text of it")]
    return rows


def winnow_docs(items):
    rng = random.Random(4)
    texts = [None, "", " ... ", "alpha", LONG, LONG[:495], "short item", "a short, item!", "null ID item here", "another TEXT of it and short item"]
    for _, t in items:
        ws = (t or "").split()
        texts += [" ".join(ws[:9]), " ".join(["lead", *ws, "tail"]), "\n".join(ws[1:]), " ".join(ws[:7] + ["cut"] + ws[7:]), "é".join(ws)]
    texts += [" ".join(rng.choice("alpha beta gamma delta été x1 99".split()) for _ in range(60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (None, LONG[300:1300]), (3, texts[20]), (3, texts[20])]
    return rows


def expected_winnow(docs, items, window):
    wins = {}
    for i, t in items:
        ws = plain(t)
        for k in range(len(ws) - min(len(ws), window) + 1 if ws else 0):
            wins.setdefault(tuple(ws[k:k + min(len(ws), window)]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        ws, hit, its = plain(t), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                own = wins.get(tuple(ws[k:k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    its |= own
        out.append((d, len(ws), len(hit), tuple(sorted(str(i) for i in its if i is not None)), tuple(sorted(hit))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [10, 4])
def test_winnowing_like_brute_force(spark, items, window):
    rows = winnow_docs(items)
    docs = spark.createDataFrame([(*r, "en", "w", 1, 2, 3) for r in rows], DOCS).repartition(3)
    bench = spark.createDataFrame([(*r, "c") for r in items], BENCH).repartition(2)
    got = winnow.decontaminated(docs, bench, window)
    assert {"lang", "win", "h", "odd name"} < set(got.columns) and got.columns.count("n_hit") == 1
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(i for s in r.hits for i in range(s.start, s.end))) for r in got.collect()), key=repr)
    assert got == expected_winnow(rows, items, window)
    assert sum(g[2] > 0 for g in got) > 20


def test_winnowing_of_empty_tables(spark, items):
    docs = spark.createDataFrame([(1, "some text", "en", "w", 1, 2, 3)], DOCS)
    bench = spark.createDataFrame([(*r, "c") for r in items], BENCH)
    assert winnow.decontaminated(docs.limit(0), bench).count() == 0
    row = winnow.decontaminated(docs, bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row.n_items, row["items"], row.hits) == (2, 0, 0, [], [])


def test_winnowing_keeps_a_gram_of_every_shared_span():
    rng = np.random.default_rng(1)
    for length in (1, 2, 3, 7, 10):
        a, b = rng.integers(0, 2 ** 63, 200).astype(np.uint64), rng.integers(0, 2 ** 63, 200).astype(np.uint64)
        b[50:50 + length] = a[120:120 + length]
        one = np.zeros(200, np.int64)
        assert set(winnow.winnowed(a, one, length)[1].tolist()) & set(winnow.winnowed(b, one, length)[1].tolist())


def test_words_do_not_depend_on_pieces(monkeypatch):
    text = winnow._LOWER[np.frombuffer(("One two,  " + "x" * 300 + " two-ÉTÉ 99 " + "y" * 64 + " one").encode(), np.uint8)]
    starts, ends, hashes = winnow.word_spans(text)
    assert [text[a:b].tobytes().decode() for a, b in zip(starts, ends)] == plain(text.tobytes().decode())
    assert hashes[0] == hashes[-1] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == len(hashes) - 2
    for piece in (1, 7, 64, 100):
        monkeypatch.setattr(winnow, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(winnow.word_spans(text), (starts, ends, hashes)))


def test_bitmap_says_no_only_when_sure(spark):
    values = [0, 1, -1, 2 ** 62, 32_767, 32_768, 65_535, -(2 ** 63)]
    bitmap = bitmaps.bitmap_of(spark.createDataFrame([(v,) for v in values], "h long"), "h", 1 << 17)
    assert bitmaps.maybe(bitmap, np.array(values, np.int64).view(np.uint64)).all()
    others = np.arange(100, 30_000, dtype=np.uint64)
    assert not bitmaps.maybe(bitmap, others).any()


# ---- spelling -------------------------------------------------------------------------------

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected_spelling(rows, every):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out = {}
    for w, c in n.items():
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= 5 * c else None
        out[w] = [form, c, len(others), n[form] if form else None]
    rows = []
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, *rest))
    return sorted(rows)


@pytest.mark.parametrize("block", [4, 30, 10_000])
def test_spelling_variants_like_brute_force(spark, block):
    rng = random.Random(7)
    stems = ["colour", "colours", "favourite", "Étéàçé", "aaaaaa", "aaaaaaa", "prefixone", "prefixtwo", "prefixten", "xprefixone", "×÷letters"]
    words = []
    for s in stems:
        words += [s] * rng.choice([6, 40, 300])
        for _ in range(12):
            i = rng.randrange(len(s))
            words += [rng.choice([s[:i] + s[i + 1:], s[:i] + "q" + s[i:], s[:i] + "ë" + s[i + 1:]])] * rng.choice([3, 5, 9])
    words += [f"prefix{a}{b}" for a, b in itertools.product("abcdefgh", repeat=2) for _ in range(5)]
    rng.shuffle(words)
    rows = [(i % 50 if i % 9 else None, " ".join(words[i * 20:i * 20 + 20])) for i in range(len(words) // 20 + 1)]
    rows += [(1, None), (2, ""), (3, "short w0rds5only"), rows[0], (4, "z" * 5000), (4, ("y" * 3000 + " ") * 6)]
    docs = spark.createDataFrame([(*r, "en", "w", 1, 2, 3) for r in rows], DOCS).repartition(3)
    got = spelling.grouped_spellings(docs, typo_every=7, block=block).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == expected_spelling(rows, 7)
    assert spelling.grouped_spellings(docs.limit(0)).count() == 0


def test_suffix_array_and_search():
    text = np.array([1, 3, 2, 3, 1, 3, 2, 3, 2, 1, 0])
    index = spelling.FMIndex(text, 4)
    assert index.suffixes.tolist() == sorted(range(11), key=lambda i: text[i:].tolist())
    lo, hi = index.narrow(np.array([0]), np.array([11]), np.array([2]))
    lo, hi = index.narrow(lo, hi, np.array([3]))
    assert sorted(index.suffixes[lo[0]:hi[0]].tolist()) == [1, 5, 7]


# ---- collocations ---------------------------------------------------------------------------

def expected_phrases(rows, least, longest, top):
    total, f = Counter(), Counter()
    for t, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if c < "\x80" else c for c in t or "")):
            ws = re.findall("[^ \t]+", piece)
            total[lang] += len(ws)
            for m in range(1, longest + 1):
                f.update((lang, *ws[i:i + m]) for i in range(len(ws) - m + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in cand.items():
        cuts = [(2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if any(q[0] == lang and len(q) > len(w) + 1 and 100 * b >= 80 * a
               and any(list(q[1:])[i:i + len(w)] == w for i in range(len(q) - len(w))) for q, b in cand.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, rows in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("head,piece", [(131_072, 8 << 20), (5, 300), (0, 1 << 20)])
def test_collocations_like_brute_force(spark, monkeypatch, head, piece):
    monkeypatch.setattr(phrases, "PIECE", piece)
    rng = random.Random(5)
    vocabulary = ["the", "of", "New", "york", "city", "hall", "é", "a" * 100, "x y", "rare"]
    rows = []
    for i in range(150):
        ws = rng.choices(vocabulary, [9, 8, 3, 3, 3, 2, 2, 2, 2, .2], k=rng.randrange(40))
        ws += ["new york city hall"] * rng.randrange(3)
        rows.append((rng.choice([" ", "  ", "\t", ". ", "\n"]).join(ws), rng.choice(["en", "en", "en", "fr", None])))
    rows += [(None, "en"), ("", None), (" .,!\n", "de"), rows[0], (" ".join(vocabulary * 400), "en")]
    docs = spark.createDataFrame([(i, t, lang, "w", 1, 2, 3) for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    got = phrases.collocations(docs, min_count=8, longest=4, top=25, head=head)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == expected_phrases(rows, 8, 4, 25)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_pairs_are_counted_alike_in_full_and_sparse_tiles():
    rng = np.random.default_rng(0)
    left, right = rng.zipf(1.4, 5000) % 900, rng.zipf(1.4, 5000) % 900
    expected = Counter(zip(left.tolist(), right.tolist()))
    for dense, tile in ((1, 16), (40, 16), (10 ** 9, 16), (1, 2048)):
        at, n = phrases.pair_counts(left, right, dense, tile)
        assert dict(zip(zip(left[at].tolist(), right[at].tolist()), n.tolist())) == expected and len(at) == len(expected)
    assert [len(x) for x in phrases.pair_counts(left[:0], right[:0])] == [0, 0]


def test_scores_beyond_64_bits(spark):
    big = F.lit(9_000_000_000_000_000_000).cast("long")
    row = spark.range(1).select(big.alias("a"), big.alias("l"), big.alias("r")).select(F.expr(
        "CAST(2000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))").alias("s")).first()
    assert row.s == 1_000_000

