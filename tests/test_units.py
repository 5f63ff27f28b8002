"""Literal URLs with known values, edge rows and published identities."""

import math

import pytest
from pyspark.sql import functions as F

from lurewatch import workspace
from lurewatch.fixed import seeds
from lurewatch.fixed.words import FEATURES, LOGIN_KEYWORDS, SHORTENERS, SPOOFED_BRANDS, TLD_RISK, TOP_BRANDS
from lurewatch.fixed.words import TRUSTED_DOMAINS
from lurewatch.operators import evaluate as E, features as C, hybrid as H, mutate as MU, prep as P, rules as R
from lurewatch.sources import urls as U
from lurewatch.streaming import jobs as J

#: Checksums of the fixed values; a wanted change of a list changes the line here too.
FIXED = {"rules": "fef6bc4bfcefeaac", "texts": "3606785cf9fad45c", "words": "6d8d52c3140484c4"}


def table(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "url_id bigint, url string")


def feature(spark, url):
    return C.url_features(table(spark, [url])).first().asDict()


def test_list_sizes():
    assert [len(x) for x in (SHORTENERS, LOGIN_KEYWORDS, SPOOFED_BRANDS, TOP_BRANDS, TLD_RISK, TRUSTED_DOMAINS, FEATURES)] == [
        20, 57, 29, 83, 62, 30, 24]
    assert len(seeds.ATTACK_SEEDS) == 20 and len(seeds.CURATED_LEGITIMATE) == 123


@pytest.mark.parametrize("url,expected", [
    ("https://evil.com/login", {"recursive_decode_depth": 0, "has_login_keyword": 1}),
    ("https://evil.com%2Flogin", {"recursive_decode_depth": 1}),
    ("https://evil.com%252Flogin", {"recursive_decode_depth": 2}),
    ("https://evil.com%25252Flogin", {"recursive_decode_depth": 3}),
    ("https://evil.com%" + "25" * 12 + "2F", {"recursive_decode_depth": 10}),
    ("http://a.com/100%", {"recursive_decode_depth": 0}),
    ("http://a.com/%zz%41", {"recursive_decode_depth": 1}),
    ("http://a.com/a+b%20c", {"recursive_decode_depth": 1}),
    ("https://paypa1.com/login", {"levenshtein_min": 1}),
    ("https://g00gle.com", {"levenshtein_min": 2}),
    ("https://paypal.com", {"levenshtein_min": 0, "has_login_keyword": 1}),
    ("https://fox.com", {"levenshtein_min": 1}),
    ("https://xn--pypal-4ve.com/login", {"idn_homograph_flag": 1}),
    ("https://bit.ly/3xK9pQz", {"has_shortener": 1}),
    ("http://192.168.1.1/admin", {"is_ip": 1, "has_https": 0}),
    ("http://999.999.999.999/", {"is_ip": 1}),
    ("http://[::1]/x", {"is_ip": 1}),
    ("http://[::1/x", {"is_ip": 0, "domain_length": 0, "levenshtein_min": 99, "tld_risk_score": 0.5}),
    ("http://0x7f.0x0.0x0.0x1/", {"is_ip": 1}),
    ("https://evil.com/paypal/login/verify", {"brand_in_path_not_domain": 1}),
    ("https://evil.com/pay?pal", {"brand_in_path_not_domain": 1}),
    ("https://a.b.co.uk/p;x=paypal", {"brand_in_path_not_domain": 0, "tld_risk_score": 0.0}),
    ("https://x.com.my/", {"domain_length": 3, "tld_risk_score": 0.0}),
    ("http://my.id/", {"tld_risk_score": 0.05}),
    ("HTTPS://WWW.Example.COM/", {"has_https": 1, "domain_length": 7}),
    ("http://legit.com@evil.com/p", {"qty_at": 1}),
    ("aaaa", {"url_entropy": 0.0, "char_continuation_rate": 0.0, "tld_length": 0}),
    ("aabb", {"url_entropy": 1.0}),
    ("a1-b", {"char_continuation_rate": 0.75, "digit_ratio": 0.25, "alpha_ratio": 0.5}),
    ("x", {"url_length": 1, "char_continuation_rate": 0.0}),
    ("http://é.com/²", {"url_length": 14, "alpha_ratio": round(8 / 14, 4), "digit_ratio": round(1 / 14, 4)}),
    ("h" * 6000, {"url_length": 6000, "url_entropy": 0.0}),
])
def test_feature_values(spark, url, expected):
    got = feature(spark, url)
    assert {k: got[k] for k in expected} == expected


@pytest.mark.parametrize("url", [None, ""])
def test_empty_gives_zero_vector(spark, url):
    got = feature(spark, url)
    assert all(got[f] == 0 for f in FEATURES)


def _brute(url):
    """Plain-Python restatement of a few columns for random texts."""
    from urllib.parse import unquote
    kind = lambda c: 0 if c.isalpha() else 1 if c.isdigit() else 2
    n = len(url)
    depth, cur = 0, url
    while depth < 10 and unquote(cur) != cur:
        cur, depth = unquote(cur), depth + 1
    return {
        "url_length": n,
        "url_entropy": round(-sum(url.count(c) / n * math.log2(url.count(c) / n) for c in set(url)), 4) if n else 0.0,
        "char_continuation_rate": round(sum(kind(a) != kind(b) for a, b in zip(url, url[1:])) / n, 4) if n > 1 else 0.0,
        "recursive_decode_depth": depth, "qty_percent": url.count("%"), "qty_slash": url.count("/"),
    }


def test_random_texts_against_brute_force(spark):
    import random
    rng = random.Random(7)
    alphabet = "abcXYZ019-._~:/?#[]@!$&'()*+,;=%%%2555éß漢 "
    urls = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    rows = C.url_features(table(spark, urls)).collect()
    for r in rows:
        got, want = r.asDict(), _brute(r.url)
        for k, v in want.items():
            assert abs(got[k] - v) <= 1.01e-4, (r.url, k, got[k], v)


def test_url_parts_against_urlparse(spark):
    from urllib.parse import urlparse
    from lurewatch.functions.urlparts import with_url_parts
    urls = ["http://u:p@h.com:80/a/b;x=1?q=1&r#f?g", "//h/p", "mailto:a@b.c", "HTTP://H/P", "x", "http://h?q", "http://h#f",
            "http://h/p;a/b;c", "a:b:c", "http:///x", "1http://h/", "ftp://f/;t=a", "http://h/?", "http://h/#", "foo://h/a;b"]
    for r in with_url_parts(table(spark, urls)).collect():
        p = urlparse(r.url)
        assert (r._netloc, r._path, r._params, r._query, r._fragment) == (
            p.netloc, p.path, p.params, p.query, p.fragment), r.url


def test_mutations_against_urlparse(spark):
    from urllib.parse import urlparse
    urls = seeds.ATTACK_SEEDS + ["https://www.a.com/x/;p=login?q=1#f", "http://h", "http://h?", "http://h/login/auth/"]
    for r in MU.mutations(table(spark, urls)).collect():
        p = urlparse(r.url)
        assert r.https_laundering == p._replace(scheme="https").geturl()
        base = p.netloc[4:] if p.netloc.startswith("www.") else p.netloc
        assert r.subdomain_padding in {p._replace(netloc=f"{s}.{base}").geturl() for s in MU.BENIGN_SUBDOMAINS}
        assert r.path_dilution in {p._replace(path=p.path.rstrip("/") + "/" + a + "/" + b).geturl()
                                   for a in MU.BENIGN_PATHS for b in MU.BENIGN_PATHS if a != b}
        path = p.path
        for w in MU.REMOVED_KEYWORDS:
            path = path.replace(w, "page")
        assert r.keyword_removal == p._replace(path=path).geturl()


@pytest.mark.parametrize("url,verdict,rules", [
    ("http://192.168.1.1/login", "HIGH_RISK", ["ip_url", "ip_with_login"]),
    ("https://m365-login.suspicious.tk/auth", "HIGH_RISK", ["aitm_pattern"]),
    ("https://evil.tk/paypal/login", "HIGH_RISK", ["brand_spoof_sus_tld"]),
    ("http://legitimate.com@evil.com/path", "SUSPICIOUS", ["embedded_credentials"]),
    ("https://www.google.com", "CLEAN", []),
    ("https://www.paypal.com", "CLEAN", []),
    ("https://docs.python.org/3/library/urllib.parse.html", "CLEAN", []),
])
def test_rules(spark, url, verdict, rules):
    r = R.rule_hits(C.url_features(table(spark, [url]))).first()
    assert (r.layer1_verdict, r.rules) == (verdict, rules)


@pytest.mark.parametrize("url,p,score,verdict,escalated", [
    ("https://www.google.com/maps/@3.1,101.6,14z", 0.2, 0.55, "MEDIUM", True),
    ("https://www.google.com/maps/@3.1,101.6,14z", 0.6, 0.65, "MEDIUM", False),
    ("https://www.google.com/", 0.9, 0.15, "SAFE", False),
    ("https://www.google.com/", 0.25, 0.25, "LOW", False),
    ("https://other.org/", 0.9, 0.9, "CRITICAL", False),
    ("http://a@b.org/", 0.97, 1.0, "CRITICAL", False),
    ("http://10.0.0.1/", 0.0, 1.0, "CRITICAL", False),
    ("   ", 0.9, 0.0, "SAFE", False),
    (None, 0.9, 0.0, "SAFE", False),
])
def test_hybrid(spark, url, p, score, verdict, escalated):
    hits = R.rule_hits(C.url_features(table(spark, [url]))).withColumn("layer2", F.lit(p))
    r = H.hybrid_score(hits).first()
    assert (r.score, r.verdict, r.escalated) == (score, verdict, escalated)


def test_mcnemar_published_values(spark):
    """(b, c) pairs with known statistics: 0.125, 1.5625, 2.0417."""
    for b, c, chi, p in ((3, 5, 0.125, 0.723674), (11, 5, 1.5625, 0.2113), (16, 8, 2.0417, 0.1530)):
        rows = [(1, 1, 0)] * b + [(1, 0, 1)] * c + [(1, 1, 1)] * 50
        r = E.mcnemar(spark.createDataFrame(rows, "label int, x int, y int"), [("x", "x", "y", "y")]).first()
        assert r.chi_squared == chi and abs(r.p_value - p) < 6e-5 and not r.significant
    same = E.mcnemar(spark.createDataFrame([(1, 1, 1)], "label int, x int, y int"), [("x", "x", "y", "y")]).first()
    assert (same.chi_squared, same.p_value) == (0.0, 1.0)


def test_confusion_to_published_metrics(spark):
    rows = [(0, 0, 26965), (0, 1, 5), (1, 0, 90), (1, 1, 20014)]
    pred = spark.createDataFrame(rows, "label int, pred int, k int").select("label", "pred", F.explode(F.sequence(F.lit(1), "k"))) \
        .withColumn("model", F.lit("m"))
    r = E.metrics(pred, ["model"]).first()
    assert (r.accuracy, r.precision, r.recall, r.f1, r.mcc) == (0.998, 0.9998, 0.9955, 0.9976, 0.9959)


def test_auc_against_brute_force_with_ties_and_saturation(spark):
    import random
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.4), rng.choice([0.0, 1.0, 0.5, rng.random() ** 8])) for _ in range(1500)]
    rows = [(y, min(1.0, s + 0.1 * y)) for y, s in rows]
    pred = spark.createDataFrame(rows, "label int, proba double").withColumn("model", F.lit("m"))
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert E.roc_auc(pred, ["model"], 9).first()["roc_auc"] == pytest.approx(want, abs=1e-9)


def test_split_is_exact_and_hot_urls_are_kept_whole(spark):
    rows = [(i, "http://hot.com/" if i % 3 == 0 else f"http://s{i}.com/", int(i % 5 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "url_id bigint, url string, label int")
    kept = workspace.materialize(P.dedupe_first(df), "kept")
    assert kept.count() == 2001 and kept.where("url = 'http://hot.com/'").first().url_id == 0
    sizes = {(r.split, r.label): r.n for r in P.stratified_split(kept).groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    n1 = kept.where("label = 1").count()
    assert sum(v for (s, _), v in sizes.items() if s == "test") == math.ceil(2001 * 0.2)
    assert abs(sizes[("test", 1)] - 0.2 * n1) < 1
    folds = [r.n for r in P.stratified_folds(kept, 5).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))
             .where("label = 1").collect()]
    assert len(folds) == 5 and max(folds) - min(folds) <= 1


def test_leakage_with_one_hot_vector(spark):
    from pyspark.sql import Row
    zero = {f: 0 for f in FEATURES}
    rows = [Row(split="train" if i % 4 else "test", **{**zero, "url_length": 7 if i % 3 == 0 else i}) for i in range(300)]
    df = spark.createDataFrame(rows)
    r = E.leakage(df).first()
    hot_test = sum(1 for i in range(300) if i % 3 == 0 and i % 4 == 0)
    in_train = {7 if i % 3 == 0 else i for i in range(300) if i % 4}
    leaked = sum(1 for i in range(300) if i % 4 == 0 and (7 if i % 3 == 0 else i) in in_train)
    assert r.leaked_test_rows == leaked >= hot_test
    assert E.collision_free(df).count() == r.test_rows - leaked


def test_cache_does_not_change_features(spark):
    df = table(spark, seeds.ATTACK_SEEDS + seeds.CURATED_LEGITIMATE)
    cache = C.brand_distance_cache(df.limit(10), max_labels=5)
    assert cache.count() <= 5
    assert C.url_features(df, cache=cache).exceptAll(C.url_features(df)).count() == 0


def test_suffix_table_route_equals_literal_route(spark):
    df = table(spark, seeds.CURATED_LEGITIMATE)
    suffixes = C.suffix_dimension(spark)
    a, b = C.host_parts(df, suffixes=suffixes), C.host_parts(df)
    assert a.select(b.columns).exceptAll(b).count() == 0


@pytest.mark.parametrize("rules, host, suffix, left", [
    (["*.ck", "!www.ck"], "a.b.ck", "b.ck", 1), (["*.ck", "!www.ck"], "b.ck", "b.ck", 0),
    (["*.ck", "!www.ck"], "www.ck", "ck", 3), (["*.ck", "!www.ck"], "x.www.ck", "ck", 3),
    (["a.b.c.d.e.f", "f"], "z.a.b.c.d.e.f", "a.b.c.d.e.f", 1), (["a.b.c.d.e.f", "f"], "b.c.d.e.f", "f", 1),
    (["uk", "co.uk", "co.uk"], "x.yy.co.uk", "co.uk", 2), ([], "x.yy.co.uk", "uk", 2), ([], "localhost", "", 9),
    (["", "*.b", "b"], "a.b", "a.b", 0), (["", "*.b", "b"], "b", "b", 0),
])
def test_suffix_rules(spark, rules, host, suffix, left):
    df = spark.createDataFrame([(f"http://{host}/",)], "url string")
    row = C.host_parts(df, suffixes=spark.createDataFrame([(r,) for r in rules], "suffix string")).first()
    assert (row.tld, row.reg_domain_length) == (suffix, left)


def test_built_in_suffix_rules_as_literals_and_as_table(spark):
    from lurewatch.sources.specimens import suffix_urls
    df = suffix_urls(spark.range(3).withColumnRenamed("id", "page_id"))
    a, b = C.host_parts(df, suffixes=C.suffix_dimension(spark)), C.host_parts(df)
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count() and a.columns == b.columns


def test_feature_contract():
    class Fake:
        columns = ["url", *FEATURES[1:], "odd"]
    assert C.check_feature_columns(Fake, ("url",)) == {"missing": [FEATURES[0]], "extra": ["odd"]}


def test_split_table_prunes_partitions(spark, tmp_path):
    df = table(spark, ["http://a.com", "http://b.com"]).withColumn("split", F.when(F.col("url_id") == 0, "train").otherwise("test"))
    U.write_splits(df, str(tmp_path / "s"))
    side = U.read_split(spark, str(tmp_path / "s"), "test")
    assert "PartitionFilters: [isnotnull(split" in side._jdf.queryExecution().toString() and side.count() == 1


def test_csv_keeps_quotes_commas_backslashes_and_line_breaks(spark, tmp_path):
    odd = ['http://b.com/\\",2,1', 'http://a.com/?q="x",y', "http://c.com/a,b\\", "http://d.com/\nnext", '"', "  http://e.com  ", None, "",
           "http://f.com/\\\\n", "plain"]
    df = spark.createDataFrame([(u, i % 2) for i, u in enumerate(odd)], "URL string, label int")
    U.write_result(df, str(tmp_path / "c"), "csv")
    for got in (U.read_labelled_csv(spark, str(tmp_path / "c")), U.read_wide_csv(spark, str(tmp_path / "c"), "url string, label int")):
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    hand = tmp_path / "h.csv"
    hand.write_text('FILENAME,URL,label\nx,"http://a.com/?q=""x"",y",1\ny,"http://b.com/\\",0\n')
    assert sorted(map(tuple, U.read_labelled_csv(spark, str(hand)).collect())) == [
        ('http://a.com/?q="x",y', 1), ("http://b.com/\\", 0)]


def test_csv_without_line_breaks_is_split(spark, tmp_path):
    df = spark.range(30_000).select(F.concat(F.lit('http://h.com/?q="a",b\\'), "id").alias("URL"), (F.col("id") % 2).cast("int").alias("label"))
    U.write_result(df.coalesce(1), str(tmp_path / "c"), "csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        whole, cut = (U.read_wide_csv(spark, str(tmp_path / "c"), "URL string, label int", line_breaks=b) for b in (True, False))
        tasks = [x.select(F.spark_partition_id()).distinct().count() for x in (whole, cut)]
        assert tasks[0] == 1 < tasks[1]
        assert cut.exceptAll(df).count() == 0 and cut.count() == whole.count() == 30_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_split_with_null_labels(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(301)], "url_id long, label int")
    n = {(r.label, r.split): r["count"] for r in P.stratified_split(rows).groupBy("label", "split").count().collect()}
    assert sum(v for (_, s), v in n.items() if s == "test") == 61
    assert all(abs(n[(c, "test")] / (n[(c, "test")] + n[(c, "train")]) - 0.2) < 0.02 for c in (None, 0, 1))
    folds = P.stratified_folds(rows, 5).groupBy("label", "fold").count().collect()
    assert len(folds) == 15 and all(19 <= r["count"] <= 21 for r in folds)


def test_ranks_in_cells_that_are_cut_again(spark, monkeypatch):
    from lurewatch.functions import ordered
    rows = spark.range(5000).select(F.col("id").alias("url_id"), (F.col("id") % 2).cast("int").alias("label"))
    whole = P.held_out(rows)
    monkeypatch.setattr(ordered, "CELL_ROWS", 0)
    cut = P.held_out(rows)
    assert rows.where(whole).exceptAll(rows.where(cut)).count() == 0 == rows.where(cut).exceptAll(rows.where(whole)).count()


def test_fixed_lists_are_as_they_were():
    import hashlib
    from lurewatch.fixed import rules, texts, words
    for module, digest in FIXED.items():
        found = {"rules": rules, "texts": texts, "words": words}[module]
        values = {k: v for k, v in vars(found).items() if k.isupper() and isinstance(v, (list, dict, str, int, float, tuple))}
        assert hashlib.sha256(repr(sorted(values.items())).encode()).hexdigest()[:16] == digest, module


def arriving(spark, tmp_path, rows):
    """Append rows of (event_id, time, url) as one arriving file and bring the recent scans up to date."""
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    df = spark.createDataFrame(rows, "event_id bigint, t string, url string").select(
        "event_id", F.to_timestamp("t").alias("ts"), "url", F.lit("SAFE").alias("verdict"),
        F.when(F.col("event_id") % 2 == 0, 0.1).alias("score"))
    df.coalesce(1).write.mode("append").parquet(src)
    J.run_recent(J.read_stream(spark, src, df.schema, max_files=1), log)
    return [tuple(r) for r in J.held_scans(spark, log).collect()]


def test_recent_scans_over_three_files_with_restarts(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", None if i == 17 else f"http://u{i}.com/" + "x" * 60) for i in range(20)]
    for a, b in ((0, 7), (7, 9), (9, 20)):
        got = arriving(spark, tmp_path, rows[a:b])
        assert [r[1] for r in got] == list(range(b - 1, b - 6, -1))
    assert got[2][2:] == (None, "SAFE", None) and got[1][2:] == (("http://u18.com/" + "x" * 60)[:60], "SAFE", 0.1)
    # Late but recent, a tie in time, a repeated event and rows without time or key.
    more = [(50, "2024-01-01 00:00:17", "late"), (51, "2024-01-01 00:00:19", "tie"), (19, rows[19][1], "again"),
            (60, None, "no time"), (None, "2024-01-01 00:00:30", "no key")]
    assert [r[1] for r in arriving(spark, tmp_path, more)] == [51, 19, 19, 18, 50]


def test_recent_scans_expire(spark, tmp_path):
    arriving(spark, tmp_path, [(i, "2024-01-01 00:00:00", "old") for i in range(100)])
    arriving(spark, tmp_path, [(200, "2024-01-03 00:00:00", "new")])
    got = arriving(spark, tmp_path, [(201, "2024-01-01 12:00:00", "too late"), (202, "2024-01-02 12:00:00", "late")])
    assert [r[1] for r in got] == [200, 202]
    state = spark.read.format("statestore").load(str(tmp_path / "log"))
    assert state.select(F.explode("value.groupState.key").alias("k")).where("k < 200").count() < 20


def test_late_rows_are_dropped(spark, tmp_path):
    src = tmp_path / "in"
    def put(name, rows):
        (spark.createDataFrame(rows, "t string, verdict string").select(F.to_timestamp("t").alias("ts"), "verdict")
         .coalesce(1).write.mode("append").parquet(str(src)))
    put("a", [("2024-01-01 00:10:00", "SAFE"), ("2024-01-01 03:00:00", "SAFE")])
    def run():
        out = J.verdict_counts(spark.readStream.schema("ts timestamp, verdict string").parquet(str(src)))
        J.run_available(out, str(tmp_path / "out"), str(tmp_path / "log"))
    run()
    put("b", [("2024-01-01 00:20:00", "SAFE"), ("2024-01-01 09:00:00", "SAFE")])  # the first is too late
    run()
    got = {(str(r.window_start), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01 00:00:00", 1), ("2024-01-01 03:00:00", 1)}


def test_stream_reads_a_file_and_a_folder(spark, tmp_path):
    import shutil
    spark.range(7).repartition(2).write.parquet(str(tmp_path / "t.parquet"))
    one = tmp_path / "one"
    spark.range(5).coalesce(1).write.parquet(str(one))
    single = tmp_path / "u.parquet"
    shutil.copy(next(one.glob("*.parquet")), single)
    for path, n in ((tmp_path / "t.parquet", 7), (single, 5)):
        out, log = tmp_path / f"o{n}", tmp_path / f"l{n}"
        J.run_available(J.read_stream(spark, str(path), "id bigint"), str(out), str(log))
        assert spark.read.parquet(str(out)).count() == n
