"""Every operator on edge rows: nulls, empty and very long texts, repeated rows, extra columns, empty tables."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
import zstandard
import public_tokenizers
from pyspark.sql import functions as F

from lurewatch.llm import bpe, langid, lines, mixing, neardup, quality, sharding, simhash, urlgraph, warc
from lurewatch.llm import queries as Q
import corpus_pipeline

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, size int, `key` string, shard long"
LONG = " ".join(f"word{i % 977} tail{i}" for i in range(60_000))
TEXTS = [None, "", " \n\t\n", "x", "one two three four five six seven eight nine ten", "B A\nb a\n  b A  \r\n\nc d",
         "ÄÖ ßü " * 30 + "\u0130\u00a0z", LONG, "a" * 5000, "αβγ δε\n" * 40, "!!! ### 123"]


def edge_rows():
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s", "t"][i % 3], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[4]] * 3 + [rows[7]] + [(None, "one two three four five six seven eight nine ten", "en", "s", 1),
                                         (None, None, None, None, None)]
    rows += [(100 + i, "B A\nunique line %d" % i, "en", "s", 5) for i in range(12)]
    return [(*r, "r", 3, "k", 9) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


# ---- quality --------------------------------------------------------------------------------

def expected_measures(text):
    ws, text = words(text), text or ""
    grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    ls = [x for x in text.split("\n") if words(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(covered))


def test_quality_measures_and_policies(docs, empty):
    rows = quality.ledger(docs).collect()
    assert len(rows) == docs.count() and {"_row", "size"} <= set(rows[0].asDict())
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected_measures(r.text)
        assert bool(r.fail_bits & quality.bit("few_words")) == (r.n_words < 10)
    kept = quality.apply_policy(docs, "web-2")
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.fail_bits == 0 for r in rows)
    assert quality.ledger(empty).count() == 0 and quality.apply_policy(empty, "web-2").count() == 0
    for r in quality.ablation(quality.ledger(docs), "web-2").collect():
        b = quality.bit(r.rule)
        assert r.n_failed == sum(bool(x.fail_bits & b) for x in rows)
        assert r.n_only == sum(x.fail_bits == b for x in rows)
    kept = quality.stored(docs)
    assert set(docs.columns) - {"text"} <= set(kept.columns) and quality.with_sole_rule(quality.stored(empty), "web-1").count() == 0
    for policy in quality.POLICIES:
        found = quality.with_sole_rule(kept, policy).collect()
        assert len(found) == len(rows)
        for r in found:
            failed = [x for x in quality.POLICIES[policy] if r.fail_bits & quality.bit(x)]
            assert r.sole_rule == (failed[0] if len(failed) == 1 else None)
            assert r.n_sole == (sum(x.sole_rule == r.sole_rule for x in found) if len(failed) == 1 else None)


# ---- lines ----------------------------------------------------------------------------------

def ascii_key(line):
    return line.encode().strip(b" \t\n\x0b\x0c\r").lower()


def expected_lines(rows, min_docs, keep):
    """rows: distinct (id, text). Text that stays, per row."""
    where = {}
    order = sorted(rows, key=lambda r: (-(2 ** 63) if r[0] is None else r[0]))
    for r in order:
        for n, line in enumerate((r[1] or "").split("\n")):
            if key := ascii_key(line):
                where.setdefault(key, []).append((r, n))
    gone = set()
    for key, found in where.items():
        if len({r for r, _ in found}) >= min_docs:
            gone |= set(found[1:] if keep == "first" else found)
    return {r: "\n".join(x for n, x in enumerate((r[1] or "").split("\n")) if (r, n) not in gone) for r in rows}


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("min_docs,parts", [(2, 7), (10, 3), (1, 40)])
def test_lines(spark, docs, keep, min_docs, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))  # keys that cross borders of partitions
    try:
        got = lines.dedup_lines(docs, min_docs, keep).select("_row.*", "n_lines", "n_dropped", "kept").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    # ids are unique here but for repeated rows and two null ids, which sort by a hash of the text
    exp = expected_lines({(r.doc_id, r.text) for r in got if r.doc_id is not None}, min_docs, keep) if keep == "first" else (
        expected_lines({(r.doc_id, r.text) for r in got}, min_docs, keep))
    assert len(got) == docs.count()
    for r in got:
        assert r.n_lines == len((r.text or "").split("\n"))
        if (r.doc_id, r.text) in exp and (keep == "none" or not any(x.doc_id is None and x.text and ascii_key(x.text.split("\n")[0])
                                                                    == ascii_key((r.text or "").split("\n")[0]) for x in got)):
            assert r.kept == exp[(r.doc_id, r.text)], (r.doc_id, keep)


@pytest.mark.parametrize("parts", [1, 6])
def test_lines_of_rows_without_id(spark, parts):
    """Every row without an id is a document; rows that repeat id and text are one."""
    rows = [(None, "Shared\n other ")] * 12 + [(None, "nine\ntimes")] * 9 + [(7, "again\nand again")] * 12 + [
        (i, "tenth\nnine of ten") for i in range(20, 29)] + [(None, "TENTH\nown")]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 10)
        got = got.select("_row.doc_id", "_row.text", "kept", "n_dropped").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len(rows)
    kept = {(r.doc_id, r.text): (r.kept, r.n_dropped) for r in got}
    assert kept[None, "Shared\n other "] == ("", 2) and kept[None, "nine\ntimes"] == ("nine\ntimes", 0)
    assert kept[7, "again\nand again"] == ("again\nand again", 0) and kept[None, "TENTH\nown"] == ("own", 1)
    assert all(kept[i, "tenth\nnine of ten"] == ("nine of ten", 1) for i in range(20, 29))


def test_lines_of_one_hot_key(spark):
    rows = [(i, f"hot line\nown {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.kept for r in lines.dedup_lines(df, 10).select("_row.doc_id", "kept").collect()}
    assert got == {i: f"own {i}" for i in range(3000)}
    first = {r.doc_id: r.kept for r in lines.dedup_lines(df, 2, "first").select("_row.doc_id", "kept").collect()}
    assert first == {i: (f"hot line\nown {i}" if i == 0 else f"own {i}") for i in range(3000)}


def test_lines_cleaned_keeps_columns(docs, empty):
    out = lines.cleaned(docs, 10)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == docs.count()
    assert out.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert lines.cleaned(empty, 10).count() == 0


# ---- simhash --------------------------------------------------------------------------------

def expected_fingerprint(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i:i + 3]), seed=42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_fingerprints(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            assert r.fp % 2 ** 64 == expected_fingerprint(text[r.doc_id])
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {0}
    assert simhash.near_duplicates(empty).count() == 0
    one = simhash.representatives(docs)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted({r.component_id for r in got})
    assert simhash.representatives(empty).count() == 0


def test_one_representative_per_component(spark):
    text = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcdef"]
    rows = [(None, text[0], 1), (None, text[1], 1), (None, text[1], 2), (None, text[2], 1), (4, text[2], 1), (4, text[3], 1),
            (4, text[4], 1), (9, text[4], 1), (None, text[4], 1), (5, text[5], 1), (5, text[5], 1), (7, None, 1), (None, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int").repartition(5)
    got = sorted(((r.doc_id, r.text) for r in simhash.representatives(df).collect()), key=str)
    assert got == sorted([(None, text[0]), (None, text[1]), (4, text[2]), (4, text[3]), (4, text[4]), (5, text[5]), (7, None)], key=str)


def test_simhash_links_are_exact(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    points = [int(b) for b in base]
    for b in base:  # chains of one and two flipped bits, many of them for one point
        x = int(b)
        for _ in range(6):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            points.append(x)
    points += [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(45) for j in range(i + 1, 45)]  # a crowded bucket
    points = np.array(sorted(set(points)), np.uint64)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    from lurewatch.llm.components import components
    got = {r.node: r.component for r in components(simhash.links(df, 2), "a", "b").collect()}
    label = np.arange(len(points))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    while True:
        new = np.where(near, label[None, :], len(points)).min(axis=1)
        if (new == label).all():
            break
        label = new
    group = {}
    for p, x in zip(points.view(np.int64).tolist(), label.tolist()):
        group.setdefault(x, []).append(p)
    exp = {p: min(g) for g in group.values() if len(g) > 1 for p in g}
    assert got == exp


# ---- mixing ---------------------------------------------------------------------------------

def expected_targets(sizes, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    fixed, open_ = {}, set(names)
    while open_:
        level = (share * sum(sizes.values()) - sum(fixed.values())) / sum(weight[n] for n in open_)
        over = [n for n in open_ if level * weight[n] > 2 * sizes[n]]
        if not over:
            fixed |= {n: level * weight[n] for n in open_}
            break
        for n in over:
            fixed[n] = 2.0 * sizes[n]
            open_.discard(n)
    return fixed


def check_mix(rows, slack=1.0):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    targets = expected_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], abs=1e-6)
    for s, n in taken.items():
        assert abs(n - targets[s]) <= slack
    return sizes


def test_mix_edges(docs, empty):
    rows = mixing.Mix(mixing.sized(docs)).taken().collect()
    assert len(rows) == docs.count()
    check_mix(rows)
    by_text = {r.doc_id: len(words(r.text)) for r in docs.collect() if r.doc_id is not None}
    assert all(r.size == by_text[r.doc_id] for r in rows if r.doc_id is not None)
    assert mixing.Mix(mixing.sized(empty)).taken().count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert mixing.Mix(mixing.sized(docs.where("text IS NULL"))).taken().where("taken = 0").count() == 2


def test_mix_repeats_and_reruns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = mixing.Mix(mixing.sized(docs))
    rows = mix.taken().collect()
    check_mix(rows)
    again = mixing.Mix(mixing.sized(docs.repartition(7))).taken().collect()
    assert sorted(rows) == sorted(again)
    # pieces fill slots without gaps, a pass takes no word twice, and shards hold what the slots say
    pieces = mix.pieces.collect()
    seen = set()
    for p in pieces:
        for w in range(p.from_word, p.to_word):
            assert (p.source, p.start, w, p.pass_no) not in seen
            seen.add((p.source, p.start, w, p.pass_no))
    per_slot = {}
    for p in pieces:
        per_slot[(p.source, p.slot)] = per_slot.get((p.source, p.slot), 0) + p.to_word - p.from_word
    assert per_slot == {(r.source, r.slot): r.words for r in mix.slots.collect()}
    counts = mixing.shard_counts(mix.slots).agg(F.sum("words")).first()[0]
    assert counts == sum(r.taken for r in rows)


def test_shards_hold_what_their_places_draw(spark):
    """Places against a plain walk over the same draws: own slots in order, surplus places to the sources left short."""
    sizes = {"a": 5000, "b": 3000, None: 700, "d": 40}
    sources = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    run, mixing.RUN = mixing.RUN, 50
    try:
        got = mixing.slots(sources, 16, 8).collect()
        n, upto = len(got), []
        per = {r.source: 0 for r in got}
        for r in got:
            per[r.source] += 1
        names = ["a", "b", "d", None]
        for s in names:
            upto.append((upto or [0])[-1] + per[s])
        runs = spark.range((n + 49) // 50).select(F.col("id").alias("_run"), F.lit(n).cast("long").alias("_n"), F.array(*[F.lit(u).cast("long") for u in upto]).alias("_upto"))
        drawn = [r._no for r in sorted(mixing.draws(runs).collect(), key=lambda r: r.place)]
    finally:
        mixing.RUN = run
    seen, exp, surplus = [0] * 4, {}, {k: [] for k in range(4)}
    for place, k in enumerate(drawn):
        if seen[k] < per[names[k]]:
            exp[place] = (names[k], seen[k])
        else:
            surplus[k].append(place)
        seen[k] += 1
    short = [(names[k], i) for k in range(4) for i in range(seen[k], per[names[k]])]
    exp.update(zip([p for k in range(4) for p in surplus[k]], short, strict=True))
    assert short and {r.place: (r.source, r.slot) for r in got} == exp
    assert all(r.shard == r.place * 8 // n for r in got)
    assert {r.source: r.w for r in mixing.shard_counts(spark.createDataFrame(got)).groupBy("source").agg(F.sum("words").alias("w")).collect()} == {
        r.source: round(r.target) for r in sources.collect()}
    words_of_shard = {(r.shard, r.source): r.slots for r in mixing.shard_counts(spark.createDataFrame(got)).collect()}
    assert len({words_of_shard.get((s, "a"), 0) for s in range(8)}) > 1  # a draw, not an even deal


def test_mixed_documents_of_equal_id_and_text_in_two_sources(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(None, text, "a"), (None, text, "b"), (7, text, None)], "doc_id long, text string, source string")
    out = mixing.mixed_documents(df).collect()
    taken = {r.source: r.taken for r in mixing.Mix(mixing.sized(df)).taken().collect()}
    got = {}
    for r in out:
        assert len(set(r.text.split())) == len(r.text.split()) <= 200  # no word twice in a row
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == taken and {r.doc_id for r in out if r.source is None} == {7}


def test_mixed_documents_hold_the_taken_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.Mix(mixing.sized(docs)).taken().collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got, text = {}, {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text) and set(words(r.text)) <= set(words(text[r.doc_id]))
    assert got == {k: v for k, v in taken.items() if v}


def test_mix_null_source_and_caps(spark):
    rows = [(i, "w " * (i % 7), None if i % 5 == 0 else "abc"[i % 3]) for i in range(300)] + [(1000, "x " * 9000, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = check_mix(mixing.Mix(mixing.sized(df), block=16).taken().collect())
    assert None in sizes


def test_permutation(spark):
    for n in (1, 2, 3, 17, 500):
        p = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s"))).collect()]
        assert sorted(p) == list(range(n))


# ---- tokens ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_like_tiktoken(spark, docs, empty, ranks):
    reference = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.with_digests(bpe.tokenized(docs, tokenizer)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = reference.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.tokenized(empty, tokenizer).count() == 0


def test_merge_takes_the_leftmost_lowest_pair():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258, b"aaaa": 259}
    assert bpe.merge(b"aaa", ranks) == [256, 97]
    assert bpe.merge(b"aaab", ranks) == [256, 257]
    assert bpe.merge(b"aaaaa", ranks) == [259, 97]
    assert bpe.merge(b"z", ranks) == [122]


# ---- language -------------------------------------------------------------------------------

def test_language(spark, docs, empty):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = Q.op4_language_by_compression(spark, "/root/testdata/sf0.01").join(data.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    model = langid.fit(docs)
    assert set(model.languages) == {"en", "de"}
    got = langid.identified(docs, model).collect()
    assert len(got) == docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    assert {(r.lang_pred, r.score) for r in langid.identified(docs, langid.fit(empty)).collect()} == {("und", 0.0)}
    assert langid.identified(empty, model).count() == 0


def test_language_like_plain_zstandard(spark):
    """Totals, winner and margin against one fresh compressor for every block and language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + ["x", "ÄÖ ßü " * 400]
    got = langid.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        data = (texts[r.doc_id] or "").lower().encode()
        if not any(c.isalpha() for c in data.decode()):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        totals = []
        for body in model.dictionaries:
            words = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=langid.LEVEL)
            totals.append(sum(len(zstandard.ZstdCompressor(
                dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data[i:i + langid.BLOCK]))
                for i in range(0, len(data), langid.BLOCK)))
        best, second = sorted(totals)[:2]
        assert r.lang_pred == model.languages[totals.index(best)] and abs(r.score - (1 - best / second)) < 1e-12


def test_language_of_many_languages(spark, monkeypatch):
    """More languages than ``PIECES`` allows full samples for: all are learned, from fewer texts each."""
    monkeypatch.setattr(langid, "PIECES", 1200)
    names = [f"l{i:03d}" for i in range(600)]
    rows = [(k * 600 + i, f"{x}a {x}b {x}c word {x}d" * 3, x) for k in range(3) for i, x in enumerate(names)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert model.languages == tuple(names) and all(d.decode().count("\n") == 1 for d in model.dictionaries)
    classifier = langid.Classifier(model)
    assert all(classifier.predict(f"{names[i]}a {names[i]}b {names[i]}c word {names[i]}d")[0] == names[i] for i in (0, 77, 501, 599))


# ---- shards ---------------------------------------------------------------------------------


def test_shards_like_plain_longest_first(spark):
    """Every group goes, by size, to the shard that has the least so far; no two groups here have equal bytes."""
    groups = {f"{i:03d}" + "é" * (7 * i): 1 + i * i % 13 for i in range(90)}
    rows = [t for t, n in groups.items() for _ in range(n)]
    bytes_of = {t: n * (len(t.encode()) + 16) for t, n in groups.items()}
    assert len(set(bytes_of.values())) > 80
    order = sorted({b for b in bytes_of.values() if list(bytes_of.values()).count(b) == 1}, reverse=True)
    rows = [t for t in rows if bytes_of[t] in order]
    loads, expect = [0] * 7, {}
    by_bytes = {b: t for t, b in bytes_of.items()}
    for b in order:
        shard = min(range(7), key=lambda s: (loads[s], s))
        loads[shard] += b
        expect[by_bytes[b]] = shard
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = sharding.sharded(df, 7).collect()
    assert len(got) == len(rows) and {(rows[r.doc_id], r.shard) for r in got} == set(expect.items())


def test_shards(docs, empty):
    rows = sharding.sharded(docs, 4).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    slots, groups = {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        if r.doc_id is not None:
            body = (text[r.doc_id] or "").encode()
            assert r.size == len(body) + 16 and r.text_crc32 == zlib.crc32(body)
            groups.setdefault(body, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.sharded(empty, 4).count() == 0


def test_shards_are_even(spark):
    got = Q.op9_balanced_shards(spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("n")).collect()
    loads = [r.n for r in got]
    assert len(loads) == 40 and max(loads) - min(loads) < 0.02 * max(loads)
    assert sharding.longest_first([(1, 5), (2, 4), (3, 3), (4, 3)], 2) == {1: 0, 2: 1, 3: 1, 4: 0}


# ---- urls -----------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, _row int"


def test_urls(spark):
    rows = [(1, "http://a.org/x/", '<a href="http://b.org/q"><a href=/local>'), (2, "http://b.org/y", '<a href="//c.org">'),
            (3, "http://bad.net/es/1", ""), (4, "http://d.org/", '<a href="http://BAD.net/">'), (5, None, None), (6, "nope", ""),
            (7, "HTTP://WWW.Example.com/en/?q#f", ""), (8, "http://x.example.com/en/a", ""), (9, "http://b.com", ""),
            (10, "x://a.com/P/q?r=://z", ""), (3, "http://bad.net/es/1", ""), (None, "http://m.bad.net/fr/", None)]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], PAGES)
    got = urlgraph.filtered(df, Q.URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[7] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert by[8] == ("x.example.com", "/en/a", "example.com/en/", "block")
    assert by[9] == ("b.com", "", None, "allow") and by[10] == ("a.com", "/P/q", "com/", "allow")
    assert by[5] == by[6] == ("", "", None, "allow") and by[3][2:] == ("net/es/", "block")
    assert by[None][2:] == ("net/fr/", "block")
    assert urlgraph.filtered(df.limit(0), Q.URL_RULES).count() == 0


def test_propagation_alone_blocks(spark):
    """Hosts that no rule touches: one that links to blocked hosts, one beside them under their domain, one far away."""
    rows = [(i, f"http://x{i % 3}.bad.net/es/{i}", "") for i in range(30)] + [(100 + i, f"http://good{i % 5}.com/{i}", "") for i in range(40)]
    rows += [(200, "http://clean.bad.net/de/", ""), (300, "http://linker.org/", '<a href="http://x1.bad.net/"><a href="//x2.bad.net/q">'),
             (400, "http://far.org/", '<a href="http://good1.com/">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    on = {r.page_id: r for r in urlgraph.filtered(df, Q.URL_RULES).collect()}
    off = {r.page_id: r for r in urlgraph.filtered(df, Q.URL_RULES, damping=0.0).collect()}
    assert all(on[i].rule is None for i in (200, 300, 400))
    assert [on[i].verdict for i in (200, 300, 400)] == ["block", "block", "allow"]
    assert [off[i].verdict for i in (200, 300, 400)] == ["allow"] * 3 and off[300].distrust == 0
    edges = {(r.src, r.dst): r.weight for r in urlgraph.domain_edges(
        spark.createDataFrame([("a.b.c.org", 2), ("b.c.org", 3), ("x.c.org", 4), ("localhost", 5), ("", 6)], "host string, pages long")).collect()}
    up = {("a.b.c.org", "b.c.org"): 2.0, ("b.c.org", "c.org"): 5.0, ("x.c.org", "c.org"): 4.0}
    assert edges == {**up, **{(b, a): w for (a, b), w in up.items()}}


def test_propagation_like_power_iteration(spark):
    links = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("d", "a", 1.0), ("b", "e", 1.0)]
    edges = spark.createDataFrame([("allow", *x) for x in links], "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("allow", "a", 0.75), ("allow", "d", 0.25)], "kind string, host string, score double")
    got = {r.host: r.score for r in urlgraph.propagate(edges, seeds, tolerance=1e-6).collect()}
    names = "abcde"
    m, s = np.zeros((5, 5)), np.array([0.75, 0, 0, 0.25, 0])
    for a, b, w in links:
        m[names.index(b), names.index(a)] = w
    out = m.sum(axis=0)
    m = np.divide(m, out, where=out > 0, out=np.zeros_like(m))
    x = s
    for _ in range(300):
        y = 0.85 * m @ x
        x = y + (1 - y.sum()) * s  # what leaves at e goes back to the seeds
    assert all(got.get(n, 0.0) == pytest.approx(v, abs=1e-4) for n, v in zip(names, x))


# ---- archives -------------------------------------------------------------------------------

def test_archives(spark):
    rows = [(1, "http://a/", "same"), (5, "http://b/ c\n", "same"), (3, None, "same"), (7, "u", None), (9, "u", ""), (None, "u", ""),
            (2, "u", "é" * 300_000), (4, "u", "one\r\n\r\ntwo"), (4, "u", "one\r\n\r\ntwo"), (None, "n", "lonely")]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], PAGES).repartition(3)
    manifest = warc.archive(df)
    got = warc.read_archives(manifest).collect()
    assert manifest.agg(F.sum("records")).first()[0] == len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id is not None}
    for page_id, _, html in rows:
        if page_id is not None:
            data = (html or "").encode()
            assert by[page_id].payload_bytes == len(data)
            assert by[page_id].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert by[page_id].record_type == "revisit" or bytes(by[page_id].payload) == data
    assert {k: (r.record_type, r.refers_to) for k, r in by.items()} == {
        1: ("revisit", 5), 5: ("response", None), 3: ("revisit", 5), 7: ("revisit", 9), 9: ("response", None),
        2: ("response", None), 4: ("response", None)}
    assert warc.read_archives(warc.archive(df.limit(0))).count() == 0


def test_broken_archives():
    import io
    good = warc.make_record(1, "http://a/", b"payload", None, False)
    assert [r.payload for r in warc.read_records(io.BytesIO(good * 2))] == [b"payload"] * 2
    assert [r.offset for r in warc.read_records(io.BytesIO(good * 2))] == [0, len(good)]
    small = list(warc.members(io.BytesIO(good * 3), chunk=7))
    assert len(small) == 3 and len({c for _, c in small}) == 1
    content = small[0][1]
    for bad in (content.replace(b"payload", b"pAyload"), content[:-5], content.replace(b"WARC/1.1", b"WORC/1.1"),
                content.replace(b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:A")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good[:-3])))


# ---- vectors --------------------------------------------------------------------------------

def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for g in range(12):
        c = rng.normal(size=24)
        for _ in range(40 if g == 0 else 5):
            rows.append((n, [float(np.float32(v)) for v in c + rng.normal(size=24) * rng.choice([0.02, 0.15])], g % 2))
            n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(700)]  # copies
    n += 700
    nan = float("nan")
    odd = [None, [], [0.0] * 24, [nan] * 24, [None] * 24, [float("inf")] * 24, [1.0, 2.0]]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)] + [(n + 10, rows[0][1], None), (n + 11, rows[0][1], 7), rows[1]]
    df = spark.createDataFrame([(*r, 1) for r in rows + [(None, rows[0][1], 0)]],
                               "vec_id long, embedding array<float>, label int, node int").repartition(5)
    got = {}
    for r in neardup.near_duplicates(df).collect():
        got[r.vec_id] = (r.n_links, r.component_id, r.kept)
    assert got[None] == (0, None, False)
    for i in [*(n + k for k in range(7)), n + 10, n + 11]:
        assert got[i] == (0, i, True)
    good = [r for r in rows if r[0] < n]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab, ids = np.array([r[2] for r in good]), np.array([r[0] for r in good])
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    comp = ids.copy()
    while True:
        new = np.where(near, comp[None, :], 10 ** 9).min(axis=1)
        if (new == comp).all():
            break
        comp = new
    for k, r in enumerate(good):
        assert got[r[0]] == (int(near[k].sum()) - 1, int(comp[k]), bool(comp[k] == r[0])), r[0]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = neardup.hadamard(x) / 4
    assert np.allclose((y * y).sum(1), (x * x).sum(1)) and np.allclose(neardup.hadamard(y) / 4, x)


# ---- pipeline -------------------------------------------------------------------------------

def test_pipeline_on_edges(spark, docs, empty):
    for rows in (docs, empty):
        out = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns, name
        assert "ids" in corpus_pipeline.STAGES[-1][1](spark, out, SF).columns


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in quality.apply_policy(docs, corpus_pipeline.POLICY).collect()}
    assert set(kept) == {r.doc_id for r in quality.ledger(docs).collect() if r.fail_bits == 0} and kept.items() <= rows.items()
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r.doc_id for r in out} <= set(kept)
    tokenizer = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    assert all(hashlib.sha256(tokenizer.decode(r.ids)).hexdigest() == r.decoded_sha256 for r in out)


def test_pipeline_lines_and_tokens_like_plain_python(spark):
    """Line dedup on copies of 2, 12 and 100 and edited copies; tokens of the mix against the public library."""
    rng = np.random.default_rng(5)
    body = lambda g, n: [f"line {k} of text {g} with {rng.integers(10 ** 6)} and more" for k in range(n)]
    texts = []
    for g, (copies, n) in enumerate(((2, 4), (12, 5), (100, 3), (1, 6), (1, 2))):
        base = body(g, n)
        texts += ["\n".join(base)] * copies + ["\n".join([*base[:-1], f"edited {g} {k}"]) for k in range(3)]
    texts = [t + "\n  Common Footer" * (i % 4) for i, t in enumerate(texts)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    cleaned = corpus_pipeline.line_dedup(spark, df, SF)
    expect = expected_lines({(i, t) for i, t in enumerate(texts)}, 10, "first")
    assert {(r.doc_id, r.text, r.n_chars) for r in cleaned.collect()} == {(i, expect[i, t], len(expect[i, t])) for i, t in enumerate(texts)}
    mixed = corpus_pipeline.mix_sources(spark, corpus_pipeline.near_dedup(spark, cleaned, SF), SF)
    mixed = mixing.materialize(mixed, "mixed").collect()
    codec = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bpe.read_ranks(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    out = corpus_pipeline.tokenize(spark, spark.createDataFrame(mixed, df.schema), SF).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in out) == sorted((r.doc_id, codec.encode_ordinary(r.text)) for r in mixed)


def test_pipeline_near_dedup_like_brute_force(spark):
    """The stage keeps the smallest id of every group of fingerprints that link at two bits or fewer."""
    rng = np.random.default_rng(11)
    texts = [None, "", " \n", "A b", "a  B", "a b c", LONG]
    for g in range(12):
        base = [f"w{g}x{k}" for k in rng.integers(0, 400, rng.integers(20, 900))]
        for edits in (0, 0, 1, 1, 2, *([0] * 98 if g == 0 else [0] * 10 if g == 1 else [])):
            copy = list(base)
            for at in rng.choice(len(base), edits, replace=False):
                copy[at] = f"edit{rng.integers(10 ** 9)}"
            texts.append(" ".join(copy))
    prints = [simhash.fingerprint(t, 3) & (2 ** 64 - 1) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(prints):
        for j in range(i):
            if root[i] != root[j] and (a ^ prints[j]).bit_count() <= 2:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[3]), (None, "a text without id")], "doc_id long, text string")
    out = corpus_pipeline.near_dedup(spark, df.repartition(5), SF).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(set(root))
    assert [r.text for r in out if r.doc_id is None] == ["a text without id"]


def test_pipeline_keeps_one_of_many_copies(spark):
    copy = "\n".join(f"the {w} line of a clean text that many documents hold" for w in ("first", "second", "third"))
    rows = [(i, copy, "en", "s", len(copy)) for i in range(5, 17)] + [(i, f"own text number {i} of one document", "en", "s", 35) for i in (1, 30)]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
        out = stage(spark, out, SF)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert [k for k, v in got.items() if v[0] == copy] == [5] and got[5][1] == len(copy)
    assert sorted(v[0] for k, v in got.items() if k != 5) == ["", rows[12][1], rows[13][1]]
