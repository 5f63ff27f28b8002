"""URL tables derived from a table of pages: labelled specimens and hard edge cases.

Each page gives one row per kind. Kinds are an array in the row, so the table is read once and
nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LEGITIMATE_KINDS = ["benign", "benign_dup", "encoded_once", "trusted_login"]


def _kinds(page: Column, url: Column) -> dict[str, Column]:
    text = lambda c: c.cast("string")
    swap = lambda new: F.replace(url, F.lit("://"), F.lit(new))
    return {
        "benign": url,
        "benign_dup": url,
        "encoded_once": F.concat(url, F.lit("%2Fx")),
        "trusted_login": F.concat(F.lit("https://www.maybank2u.com.my/login?p="), text(page)),
        "ip_url": F.concat(F.lit("http://"), text(page % 223 + 1), F.lit("."), text(page % 251), F.lit(".7.9/x")),
        "idn_punycode": swap("://xn--"),
        "multi_encoded": F.concat(url, F.lit("%25252Fx")),
        "aitm_pattern": swap("://m365-login."),
        "brand_spoof_sus_tld": F.concat(F.lit("http://evil"), text(page), F.lit(".tk/paypal/index")),
        "ip_with_login": F.concat(F.lit("http://10.0."), text(page % 251), F.lit(".1/login")),
        "embedded_credentials": swap("://legit.com@"),
        "typosquat": F.concat(F.lit("https://paypa1.com/p/"), text(page)),
    }


def specimens(pages: DataFrame) -> DataFrame:
    """url_id, kind, label, url: twelve labelled URLs per page."""
    kinds = _kinds(F.col("page_id"), F.col("url"))
    rows = F.array(*[F.struct(
        (F.col("page_id") * len(kinds) + i).cast("bigint").alias("url_id"), F.lit(kind).alias("kind"),
        F.lit(0 if kind in LEGITIMATE_KINDS else 1).alias("label"), url.alias("url"))
        for i, (kind, url) in enumerate(kinds.items())])
    return pages.select(F.explode(rows).alias("_s")).select("_s.*")


# Edge cases; {} is replaced by the page number.
EDGE_URLS = [
    None, "", "   ", "\t", "{}", "http://a.com/a+b%20c/{}", "http://a{}.com/100%", "http://a.com/%zz%41{}",
    "https://evil{}.com%252Flogin", "https://evil{}.com%25252Flogin", "http://legit.com@evil.com/p{}",
    "http://google.com:{}@evil.com/", "http://[::1]/x{}", "http://[::1/x{}", "http://::1]/x{}",
    "http://0x7f.0x0.0x0.0x1/{}", "HTTPS://WWW.Example{}.COM/", "https://a.b.co.uk/p;x=paypal{}",
    "https://evil.com/pay?pal{}", "https://evil.com/{};v=1/pay;w=2#pal", "https://paypal.com", "https://paypa1.com/login",
    "https://fox.com/{}", "https://www.google.com/maps/@3.1,101.6,{}z", "x", "ftp://files.example.org/{}",
    "//cdn.example.net/{}?q", "mailto:user{}@example.com", "http://bücher{}.example.de/straße", "http://999.999.999.999/{}",
    "https://bit.ly/{}", "https://www.bit.ly:8080/{}", "HTTP://WWW.t.co/", "http://sub.my.id/{}", "http://my.id/{}",
    "http://localhost/{}", "https://example.com/?u=%E4%BD%A0{}", "https://xn--pypal-4ve{}.com/login#frag?x",
    "https://okta_verify.example{}.io/APPLE-ID-signin", "  https://spaced{}.example.com/", "https://a.com/\n{}",
    "https://example.com./{}", "https://www./{}", "https://www.x{}", "https://.com/{}", "http://a.b.c.d.e{}.gov.my:1/",
]


def edge_urls(pages: DataFrame) -> DataFrame:
    """url_id, url: every edge case once per page, numbered by the page."""
    rows = F.array(*[F.struct(
        (F.col("page_id") * len(EDGE_URLS) + i).cast("bigint").alias("url_id"),
        (F.lit(None).cast("string") if u is None else
         F.replace(F.lit(u), F.lit("{}"), F.col("page_id").cast("string"))).alias("url"))
        for i, u in enumerate(EDGE_URLS)])
    return pages.select(F.explode(rows).alias("_e")).select("_e.*")


# Hosts whose endings need wildcard rules, exceptions or long rules; {} is replaced by the page number.
SUFFIX_URLS = [
    "http://shop{}.co.ck/", "http://www.ck/{}", "http://a{}.www.ck/", "http://x{}.ck/", "http://ck/{}", "http://np{}.np/",
    "https://a.b{}.c.kawasaki.jp/", "https://city.kawasaki.jp/{}", "https://v{}.city.kawasaki.jp/", "https://kawasaki.jp/{}",
    "https://w{}.kobe.jp/", "http://www.school{}.sch.uk/", "http://sch.uk/{}", "http://user@a.school{}.sch.uk:81/",
    "https://bucket{}.s3.dualstack.us-east-1.amazonaws.com/", "https://x.bucket{}.s3.dualstack.us-east-1.amazonaws.com/",
    "https://s3.dualstack.us-east-1.amazonaws.com/{}", "https://us-east-1.amazonaws.com/{}", "HTTP://A{}.WWW.CK./",
]


def suffix_urls(pages: DataFrame) -> DataFrame:
    """url_id, url: every such host once per page."""
    rows = F.array(*[F.struct(
        (F.col("page_id") * len(SUFFIX_URLS) + i).cast("bigint").alias("url_id"),
        F.replace(F.lit(u), F.lit("{}"), F.col("page_id").cast("string")).alias("url"))
        for i, u in enumerate(SUFFIX_URLS)])
    return pages.select(F.explode(rows).alias("_e")).select("_e.*")
