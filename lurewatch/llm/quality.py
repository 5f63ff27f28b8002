"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements together with one bit per
failed rule. A policy is a versioned set of rules, that is a mask; applying one, comparing two or asking
what a rule contributes never reads a text again, only the bits.

Edge cases: a null or empty text has no words and fails ``few_words``; all measurements are then 0. Repeated
rows are judged one by one. An empty table gives an empty ledger. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.llm.common import SPACES, barrier, materialize, spaced, string_of, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Rule name -> condition under which a document fails, over the measurements. The order fixes the bits.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 7 * word_chars",
    "duplicate_lines": "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_text_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "exclamations": "4 * n_exclamations > n_words",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines",
            "n_exclamations"]

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    "web-2": tuple(RULES),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words() -> Column:
    """Words inside five-word windows that occur at least twice, from ``_h``, the window hashes in order.

    Most documents repeat no window; a set size tells. For the others the windows are sorted by hash, those
    with an equal neighbour are put back in order, and each adds the words that the one before did not cover.
    """
    by_hash = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.transform(
        F.array(by_hash),
        lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, k - 1)["h"]))),
            lambda x: x["i"])))
    covered = F.aggregate(
        F.get(repeated, 0), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"])
    return F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0)).otherwise(covered).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_row``, a struct of the document's other columns, ``_text`` and the ``MEASURES``; native expressions over one row."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    row = F.struct(*others) if others else F.struct(F.lit(None).alias("_"))
    df = docs.select(row.alias("_row"), F.col(f"`{text}`").alias("_text"))
    df = barrier(df, _t=string_of("_text"), _s=spaced(F.col("_text")))
    lines = F.filter(F.split("_t", "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "")
    df = barrier(df, _w=words_of(F.col("_s")), _l=lines,
                 word_chars=F.length(_without(F.col("_s"), " ")).cast("long"),
                 n_symbols=(F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long"),
                 n_exclamations=(F.length("_t") - F.length(_without(F.col("_t"), "!"))).cast("long"))
    starts = F.when(F.size("_w") >= WINDOW, F.sequence(F.lit(0), F.size("_w") - WINDOW)).otherwise(
        F.array().cast("array<int>"))
    df = barrier(df, n_words=F.size("_w").cast("long"), n_text_lines=F.size("_l").cast("long"),
                 n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
                 _h=F.transform(starts, lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)])))
    df = df.drop("_t", "_s", "_w", "_l").withColumn("n_repeat_words", _repeat_words())
    return df.drop("_h")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their measurements and ``fail_bits``, one bit per failed rule. Input columns with the
    name of a measurement or of ``fail_bits`` give way to it."""
    df = measure(docs, text)
    df = barrier(df, n_repeat_words=F.col("n_repeat_words"))
    bits = None
    for rule, condition in RULES.items():
        one = F.when(F.expr(condition), F.lit(bit(rule))).otherwise(0).cast("long")
        bits = one if bits is None else bits.bitwiseOR(one)
    own = [F.col("_text").alias(text) if c == text else F.col("_row")[c].alias(c)
           for c in docs.columns if c not in (*MEASURES, "fail_bits")]
    return df.select(*own, *MEASURES, bits.alias("fail_bits"))


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """The ledger without the texts, written to the shared folder: what policies and ablations read."""
    return materialize(ledger(docs, text).drop(text), "quality-ledger")


def passes(policy: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: str, text: str = "text") -> DataFrame:
    """The documents, with their own columns only, that pass ``policy``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_others"),
                       F.col(f"`{text}`").alias("_body"))
    kept = ledger(rows, "_body").where(passes(policy))
    return kept.select(*[(F.col("_body") if c == text else F.col("_others")[c]).alias(c) for c in docs.columns])


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy adds: rule, n_failed, n_only (documents that no other rule of the policy rejects).

    The ledger shrinks to one row per distinct bit pattern first; the rest is bit arithmetic on those.
    """
    m = mask(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    parts = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit"))
                      for r in POLICIES[policy]])
    one = patterns.select("bits", "n", F.explode(parts).alias("r")).select("bits", "n", "r.rule", "r.bit")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return one.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"))


def with_sole_rule(rows: DataFrame, policy: str) -> DataFrame:
    """Add ``sole_rule``, the rule without which a rejected document would pass the policy (null where there is no single
    one), and ``n_sole``, how many documents of the ledger it rejects alone. Columns of these names give way."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    sole = F.coalesce(*[F.when(bits == bit(r), r) for r in POLICIES[policy]])
    alone = ablation(rows, policy).select(F.col("rule").alias("_rule"), F.col("n_only").alias("n_sole"))
    df = rows.drop("n_sole").withColumn("sole_rule", sole)
    # One row for each rule of the policy.
    return df.join(F.broadcast(alone), F.col("sole_rule") == F.col("_rule"), "left").drop("_rule")
