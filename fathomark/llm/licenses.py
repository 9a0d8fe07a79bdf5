"""License scans by ordered signature rules.

A text becomes words (A-Z lowered, runs of letters, digits and whatever is not ASCII) joined by one
space. The signature rules (``license_rules``) are regular expressions over that line, each with keywords, a priority, a
label and a confidence. Rules of which the line contains a keyword are run; one of them stands in whatever a
rule matches, so that no match is lost (keywords are looked for by a stem that several share, first). Every match is an interval of words. An interval
that lies within another that is longer, or alike and of higher priority, is suppressed; the labels
of those left are the text's, along with those of the phrases asked for, which are always kept.
All is built from DataFrame functions.

Edge cases: null counts as empty; a text without a match has no labels, null places and score 0; of
hits alike in place and priority the label that sorts first stays; whole texts are scanned, however long;
repeated rows are scanned each by itself; an empty table gives an empty one; other columns are kept,
except those named like an output column.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomark.llm.license_rules import Rule, signature_rules
from fathomark.llm.quality import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def phrase_rules(phrases: dict[str, str]) -> tuple[Rule, ...]:
    return tuple(Rule(label, (phrase,), phrase, 0, 0.9) for phrase, label in phrases.items())


def lowered(text: Column) -> Column:
    """A-Z lowered, nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


_HIT = "array<struct<start:long,stop:long,priority:int,label:string,confidence:double>>"


def _places(line: Column, pattern: Column) -> Column:
    """Intervals of words (start, and stop after the last) where pattern matches whole words."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))

    def of(parts: Column) -> Column:
        gaps, matches = parts["gaps"], parts["matches"]
        zero = F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<struct<start:long,stop:long>>").alias("out"))
        step = lambda a, k: F.struct(
            (a["at"] + _spaces(F.get(gaps, k)) + _spaces(F.get(matches, k))).cast("long").alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + _spaces(F.get(gaps, k))).cast("long").alias("start"), (a["at"] + _spaces(F.get(gaps, k)) + _spaces(F.get(matches, k)) + 1).cast("long").alias("stop")))).alias("out"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step)["out"]

    found = F.struct(F.split(line, whole, -1).alias("gaps"), F.regexp_extract_all(line, whole, F.lit(0)).alias("matches"))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    return F.when(F.regexp_like(line, whole), let(found, of)).otherwise(none)


def stems_of(keywords: set[str]) -> dict[str, list[str]]:
    """Few words that cover all keywords: each keyword by a word in it, one that covers the most; words as short as "of" only where nothing else is left."""
    left, out = set(keywords), {}
    while left:
        count: dict[str, int] = {}
        for k in left:
            for w in {w for w in k.split() if len(w) > 2} or set(k.split()):
                count[w] = count.get(w, 0) + 1
        best = max(count, key=lambda w: (count[w], len(w), w))
        out[best] = sorted(k for k in left if best in k)
        left.difference_update(out[best])
    return out


def _hits(line: Column, rules: tuple[Rule, ...]) -> Column:
    table = F.from_json(F.lit(json.dumps([asdict(r) for r in rules])), "array<struct<label:string,keywords:array<string>,pattern:string,priority:int,confidence:double>>")
    stems = stems_of({w for r in rules for w in r.keywords})
    tree = F.from_json(F.lit(json.dumps([{"stem": k, "words": v} for k, v in stems.items()])), "array<struct<stem:string,words:array<string>>>")
    there = F.flatten(F.transform(F.filter(tree, lambda s: line.contains(s["stem"])), lambda s: F.filter(s["words"], lambda k: line.contains(k))))
    gated = let(there, lambda own: F.when(F.size(own) > 0, F.filter(table, lambda r: F.arrays_overlap(r["keywords"], own))).otherwise(F.filter(table, lambda r: F.lit(False))))
    each = F.transform(gated, lambda r: F.transform(_places(line, r["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence"))))
    return F.flatten(each)


def unsuppressed(hits: Column) -> Column:
    """Hits in no other: sorted by start, then the longer, then priority and label, those that reach further than all before."""
    keyed = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["stop"]).alias("less"), h["priority"].alias("priority"), h["label"].alias("label"), h["confidence"].alias("confidence"), h["stop"].alias("stop")))
    zero = F.struct(F.lit(-1).cast("long").alias("reach"), F.array().cast(_HIT).alias("kept"))

    def step(a: Column, h: Column) -> Column:
        own = F.struct(h["start"].alias("start"), h["stop"].alias("stop"), h["priority"].alias("priority"), h["label"].alias("label"), h["confidence"].alias("confidence"))
        new = h["stop"] > a["reach"]
        return F.struct(F.greatest(a["reach"], h["stop"]).alias("reach"), F.when(new, F.concat(a["kept"], F.array(own))).otherwise(a["kept"]).alias("kept"))

    return F.aggregate(F.array_sort(keyed), zero, step)["kept"]


OUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


def scan_licenses(docs: DataFrame, phrases: dict[str, str], rules: tuple[Rule, ...] | None = None, *, text: str = "text") -> DataFrame:
    """All rows of docs with the columns of OUT; detections are the unsuppressed hits of rules and phrases."""
    rules = signature_rules() if rules is None else rules
    kept = [c for c in docs.columns if c not in (*OUT, "_w", "_l", "_b", "_d")]
    words = F.array_remove(F.split(lowered(F.coalesce(F.col(f"`{text}`"), F.lit(""))), OTHER), "")
    line = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).alias("line")))

    def scanned(x: Column) -> Column:
        base = _hits(x["line"], phrase_rules(phrases))
        found = let(_hits(x["line"], (*phrase_rules(phrases), *rules)), unsuppressed)
        return F.struct(x["n"].alias("n"), base.alias("base"), found.alias("found"))

    rows = docs.select(*(F.col(f"`{c}`") for c in kept), let(line, scanned).alias("_w"))
    base, found = F.col("_w.base"), F.col("_w.found")
    named = lambda hits: F.transform(hits, lambda h: h["label"])
    labels = F.array_sort(F.array_distinct(F.concat(named(base), named(found))))
    sure = F.aggregate(found, F.lit(0.0), lambda a, h: F.greatest(a, h["confidence"]))
    return rows.select(
        *(f"`{c}`" for c in kept),
        F.col("_w.n").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["start"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named(base))), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(sure, F.when(F.size(base) > 0, 0.9).otherwise(0.0)).alias("score"),
        found.alias("detections"),
    )
