"""Quality rules as a bitmask ledger: every rule is evaluated once, policies choose later.

``ledger`` gives each row its measurements and one long of failure bits. A policy is a named,
versioned mask of the rules that reject; ``apply_policy`` and ``ablation`` work on the bits
alone, without the texts. All is built from DataFrame functions.

Words are runs of characters other than space and tab to carriage return. Edge cases: a null
text has no words and no lines; an empty table gives an empty ledger; repeated rows are
judged each by itself; very long texts are measured whole, and what a rule measures at its limit passes; other columns are kept, but for those named like an output column,
which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8

#: Name and failing test, over the measurements; a rule's bit is its place. Append only.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("stutter", "100 * n_stutter > 40 * n_words"),
    ("one_long_line", "n_lines = 1 and n_words > 100000"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: A policy is never changed, only followed by another version.
POLICIES: dict[str, int] = {
    "base-1": BASE,
    "web-1": BASE | BIT["short_words"] | BIT["long_words"] | BIT["symbols"] | BIT["repeated_lines"] | BIT["stutter"],
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more: windows become 64-bit hashes; only if some are equal, hashes are sorted with their places, equal neighbours kept, and their cover measured."""

    def cover(places: Column) -> Column:
        step = F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window - 1).cast("long").alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(window).cast("long"), p.cast("long") - a["last"])).alias("n"), p.cast("long").alias("last")),
        )
        return step["n"]

    def places(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = let(pairs, lambda s: F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def of(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window)))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(cover(places(w))))

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of))


def stutter(words: Column) -> Column:
    """Words equal to the word before."""
    return F.size(F.filter(words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w))).cast("long")


def measurements(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    line_part = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    word_part = let(
        F.array_remove(F.split(t, SPACE), ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).alias("repeat"), stutter(w).alias("stutter")),
    )
    symbols = F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long")
    return let(
        F.struct(word_part.alias("w"), line_part.alias("l"), symbols.alias("s")),
        lambda m: F.struct(m["w"]["n"].alias("n_words"), m["w"]["chars"].alias("word_chars"), m["s"].alias("n_symbols"), m["l"]["n"].alias("n_lines"), m["l"]["dup"].alias("n_dup_lines"), m["w"]["repeat"].alias("n_repeat_words"), m["w"]["stutter"].alias("n_stutter")),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and fail_bits (long)."""
    kept = [c for c in docs.columns if c not in (*MEASURES, "fail_bits", "_m")]
    measured = docs.select(*(F.col(f"`{c}`") for c in kept), measurements(F.col(f"`{text}`")).alias("_m"))
    measured = measured.select(*(f"`{c}`" for c in kept), *(F.col(f"_m.{m}") for m in MEASURES))
    bits = " | ".join(f"if({test}, {1 << k}L, 0L)" for k, (_, test) in enumerate(RULES))
    return measured.withColumn("fail_bits", F.expr(bits))


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """A ledger with kept (boolean) and policy (its name)."""
    mask = F.lit(POLICIES[policy]).cast("long")
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(mask) == 0).withColumn("policy", F.lit(policy))


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that it alone rejects, rows kept without it. Rows are first counted by masked bits, of which there are at most 2 to the number of rules."""
    mask = POLICIES[policy]
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    names = [(name, BIT[name]) for name, _ in RULES if BIT[name] & mask]
    rule = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in names)))
    each = counts.select("b", "n", rule.alias("r")).select("b", "n", "r.*")
    without = F.col("b").bitwiseAND(F.bitwise_not("bit")) == 0
    n_if = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("long"))
    return each.groupBy("rule").agg(n_if(F.col("b").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), n_if(F.col("b") == F.col("bit")).alias("n_only"), n_if(without).alias("n_kept_without"))
