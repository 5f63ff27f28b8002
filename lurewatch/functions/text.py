"""Text measures as native expressions; none of them needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that count as digits: decimal digits of any script plus super- and subscript digits.
DIGITS = r"\p{Nd}²³¹⁰⁴-⁹₀-₉"
LETTERS = r"a-zA-Z\p{L}"


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def quoted(values) -> str:
    """SQL string literals, comma separated. Long lists go into SQL text because one parsed expression is
    built much faster than hundreds of Column calls."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def contains_any(text: str, words: list[str]) -> Column:
    """True if the SQL expression ``text`` contains any word. A word that contains another listed word
    cannot change the answer."""
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return F.expr(" OR ".join(f"contains({text}, {quoted([w])})" for w in needed))


def entropy(text: Column) -> Column:
    """Shannon bits per character, 4 decimals.

    Sorting the characters makes equal ones adjacent, so the repeat counts are the lengths of runs;
    characters that occur once contribute nothing beyond log2(n).
    """
    n = F.length(text)
    runs = F.regexp_extract_all(
        F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1+"), F.lit(0))
    repeats = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + F.length(r) * F.log2(F.length(r)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.log2(n) - repeats / n, 4))


def without_alphanumerics(text: Column) -> Column:
    return F.regexp_replace(text, f"[{LETTERS}0-9{DIGITS}]+", "")


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^0-9{DIGITS}]+", ""))


def class_runs(text: Column) -> Column:
    """Number of maximal runs of letters, of digits and of other characters."""
    return F.regexp_count(text, F.lit(f"[{LETTERS}]+|[0-9{DIGITS}]+|[^{LETTERS}0-9{DIGITS}]+"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 4 decimals; 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 4))


def percent_decode(text: Column) -> Column:
    """Undo one level of percent-encoding; keeps '+' and malformed escapes as they are."""
    escaped = F.replace(F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(escaped), text)


def decode_depth(text: Column, decoded: Column, limit: int = 10) -> Column:
    """How often ``text`` can be decoded before it stops changing; ``decoded`` is its first decoding.

    Nearly all URLs need at most one step, which stays in generated code. Only texts that still hold
    a percent sign after it enter the loop.
    """
    step = F.aggregate(
        F.sequence(F.lit(2), F.lit(limit)),
        F.struct(decoded.alias("cur"), percent_decode(decoded).alias("nxt"), F.lit(1).alias("depth")),
        lambda s, _: F.struct(
            s["nxt"].alias("cur"), percent_decode(s["nxt"]).alias("nxt"),
            (s["depth"] + (s["nxt"] != s["cur"]).cast("int")).alias("depth")),
        lambda s: s["depth"])
    return (F.when(~text.contains("%"), 0).when(decoded == text, 0)
            .when(~decoded.contains("%"), 1).otherwise(step))
