"""Each operator against its brute-force version, and on the cases that break things."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomark.llm import common, components, decontaminate, html, jaccard, langid, license_rules, licenses, packing, pieces, quality, substrings, tokens, urls, wordhash
from fathomark.llm.queries import PHRASES, URL_RULES
from tests.llm import brute

public = pytest.importorskip("public_tokenizers")


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


# quality rules


def test_quality(docs, rows, empty):
    got = quality.apply_policy(quality.ledger(docs), "base-1")
    assert got.columns.count("n_words") == 1 and got.columns.count("kept") == 1 and "lang" in got.columns
    for r in got.collect():
        want = brute.quality(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, not r.kept) == want, rows[r.doc_id]
    assert quality.ledger(empty).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_policies(docs):
    book = quality.ledger(docs)
    n = {p: quality.apply_policy(book, p).where("kept").count() for p in quality.POLICIES}
    assert n["web-1"] <= n["base-1"]
    out = {r.rule: r for r in quality.ablation(book, "base-1").collect()}
    assert set(out) == {"few_words", "repeated_words"} and out["few_words"].n_kept_without >= n["base-1"]
    few = book.where("n_words < 20").count()
    assert out["few_words"].n_failed == few and out["few_words"].n_kept_without == n["base-1"] + out["few_words"].n_only


# licenses


def test_licenses(docs, rows, empty):
    got = licenses.scan_licenses(docs, PHRASES)
    assert got.columns.count("labels") == 1
    for r in got.collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.phrases(rows[r.doc_id][1], PHRASES)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licenses(empty, PHRASES).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_license_rules(spark):
    rules = licenses.signature_rules()
    assert len(rules) > 250
    texts = {
        1: "SPDX-License-Identifier: GPL-2.0-or-later", 2: "This is released under the terms of the GNU General Public License v3.", 3: "Creative Commons Attribution-NonCommercial 4.0 International", 4: "All rights reserved.", 5: "der Hund geht mit dem Mann",
        6: "BSD 3-Clause License and the zlib license", 7: "see https://opensource.org/licenses/mit", 8: "Apache License, Version 2.0", 9: None,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(licenses.scan_licenses(df, {}), "labels")
    assert got == {1: ("gpl-2",), 2: ("gpl-3",), 3: ("cc-by-nc",), 4: ("all-rights-reserved",), 5: ("",), 6: ("bsd-3-clause,zlib",), 7: ("mit",), 8: ("apache-2",), 9: ("",)}


def _example(tree, rng):
    """A text that the parsed pattern matches."""
    out = []
    for kind, arg in tree:
        name = str(kind)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "IN":
            low, high = [(x, x) if str(k) == "LITERAL" else x for k, x in arg][0]
            out.append(chr(rng.randint(low, high)))
        elif name == "BRANCH":
            out.append(_example(rng.choice(arg[1]), rng))
        elif name == "SUBPATTERN":
            out.append(_example(arg[-1], rng))
        else:
            assert name == "MAX_REPEAT"
            out += [_example(arg[2], rng) for _ in range(rng.randint(arg[0], arg[1]))]
    return "".join(out)


WORDS_JOINED = lambda text: " " + " ".join(brute.letters(text)) + " "


def test_license_rules_one_by_one():
    assert len(license_rules.with_examples()) >= 220
    for rule, yes, no in license_rules.with_examples():
        pattern = f"(?<= )(?:{rule.pattern})(?= )"
        assert re.search(pattern, WORDS_JOINED(yes)) and not re.search(pattern, WORDS_JOINED(no)), rule


def test_license_gates_lose_nothing():
    rng = random.Random(3)
    for rule in licenses.signature_rules():
        tree = re._parser.parse(rule.pattern)
        for _ in range(40):
            line = f" {_example(tree, rng)} "
            assert re.search(f"(?<= )(?:{rule.pattern})(?= )", line), (rule, line)
            assert any(k in line for k in rule.keywords), (rule, line)


def _scanned(text, rules):
    """Labels and score of all rules in a loop, without gates."""
    line, hits = WORDS_JOINED(text), []
    for r in rules:
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
            hits.append((line[: m.start()].count(" ") - 1, line[: m.end()].count(" "), r.priority, r.label, r.confidence))
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and (b[1] - b[0] > a[1] - a[0] or (b[2], b[3], b[4]) < (a[2], a[3], a[4]))
    kept = [a for a in set(hits) if not any(inside(a, b) for b in hits)]
    return ",".join(sorted({h[3] for h in kept})), max((h[4] for h in kept), default=0.0)


def test_license_scan_by_brute_force(spark):
    rng = random.Random(8)
    examples = [t for _, yes, no in license_rules.with_examples() for t in (yes, no)]
    texts = [*examples, *(" ".join(rng.choice([*examples, "the", "word", "mit", "under", "License", "v2"]) for _ in range(rng.randrange(2, 9))) for _ in range(250))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(licenses.scan_licenses(df, {}), "labels", "score")
    for k, t in enumerate(texts):
        assert got[k] == _scanned(t, licenses.signature_rules()), t


def test_license_without_anchor(spark):
    texts = {
        "released under MIT": "mit", "distributed under the Apache 2.0": "apache-2", "available under the terms of the ISC": "isc", "Apache 2.0": "apache-2", "MPL v2.0": "mpl-2", "EPL 2.0": "epl-2", "FreeBSD": "bsd-2-clause", "the Expat license": "mit", "SPDX-License-Identifier: MIT-0": "mit-0",
        "Released under Apache 2.0": "apache-2", "simplified BSD": "bsd-2-clause", "BSD two clause": "bsd-2-clause", "published under the new BSD": "bsd-3-clause", "distributed under ISC terms": "isc", "Available under the EPL 2.0": "epl-2", "covered under zlib": "zlib",
        "provided under the terms of PostgreSQL": "postgresql", "the permit, under a limit": "", "Ich gehe mit dem Hund": "",
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert [x for _, (x,) in sorted(by_id(licenses.scan_licenses(df, {}), "labels").items())] == list(texts.values())


# urls


def test_urls(spark):
    cases = {
        "http://a.example.com/en/7x": ("a.example.com", "/en/7x", "example.com/en/7", "allow"), "https://EXAMPLE.com/en/8": ("example.com", "/en/8", "com/en/", "block"), "x://b.net/de/1?u#f": ("b.net", "/de/1", "net/de/", "allow"),
        "http://example.net/de/88": ("example.net", "/de/88", "example.net/de/8", "block"), "http://org/es/": ("org", "/es/", "org/es/", "block"), "http://myexample.net/de/8": ("myexample.net", "/de/8", "net/de/", "allow"), "http://a.com?x=/en/": ("a.com", "", None, "allow"),
        "http://a.com#/en/": ("a.com", "", None, "allow"), "a.com/en/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http:///en/": ("", "/en/", None, "allow"), "http://É.com/en/": ("É.com", "/en/", "com/en/", "block"),
    }
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, list(URL_RULES), []).collect()}
    assert got == cases
    assert urls.filter_urls(df.limit(0), list(URL_RULES), []).count() == 0


def test_mined_urls(spark):
    rng = random.Random(3)
    rows = [(f"http://{'spam-' if i % 4 == 0 else ''}h{i % 9}.example.com/{'win' if i % 2 else 'news'}/{i}", i % 4 == 0 if rng.random() < 0.95 else i % 4 != 0) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, True), ("x", None)], "url string, bad boolean")
    mined = urls.mine_rules(df)
    assert any(r.tokens == ("host:spam",) for r in mined) and all(r.confidence >= 0.6 for r in mined)
    got = urls.filter_urls(df, [], mined)
    assert got.where("verdict = 'block'").count() == 100 and got.where("mined_rule is not null and url not like '%spam%'").count() == 0
    assert urls.mine_rules(df.limit(0)) == [] and urls.mine_rules(df.where("not bad")) == []
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_mined_urls_of_four_tokens(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    paths = [(words, True)] + [([w if w != gone else "1" for w in words], False) for gone in words] + [(["1", "2", "3", "4"], False)] * 3
    rows = [(f"http://a.com/{'/'.join(path)}", bad) for path, bad in paths for _ in range(40)]
    rules = urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    assert [(r.tokens, r.confidence) for r in rules] == [(tuple(sorted(f"path:{w}" for w in words)), 1.0)]


def _rules_by_brute_force(baskets, share, confidence, lift):
    """All itemsets counted one by one; of tokens in the same baskets the first of telling kind, then by name."""
    total, n_bad = len(baskets), sum(b for _, b in baskets)
    tokens, classes = sorted({t for own, _ in baskets for t in own}, key=lambda t: (t.split(":")[0] not in urls.TELLING, t)), {}
    for t in tokens:
        at = frozenset(i for i, (own, _) in enumerate(baskets) if t in own)
        if share * total <= len(at) < total:
            classes.setdefault(at, t)
    level, rules = {(t,): at for at, t in classes.items()}, {}
    while level:
        for own, at in level.items():
            both = sum(baskets[i][1] for i in at)
            if both >= share * total and both >= confidence * len(at) and both * total >= lift * n_bad * len(at):
                rules[frozenset(own)] = both / len(at)
        level = {tuple(sorted((*a, t))): level[a] & at for a in level for at, t in classes.items() if t > a[-1] and len(level[a] & at) >= share * total}
    return {k: c for k, c in rules.items() if not any(o < k and rules[o] >= c for o in rules)}


def test_mined_rules_by_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(600):
        host, word, keys = rng.choice(["a.com", "b-c.net", "d.org"]), rng.choice(["news", "win", "cash"]), [k for k in ("q", "ref", "id") if rng.random() < 0.5]
        keys += ["ref2"] if "ref" in keys else []
        p = 0.9 if word == "win" and "q" in keys else 0.8 if host == "b-c.net" and "ref" in keys else 0.1
        rows.append((f"http://{host}/{word}?{'&'.join(f'{k}=1' for k in keys)}", rng.random() < p))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    baskets = [(frozenset(r.t), r.bad) for r in df.select(urls.url_tokens(F.col("url")).alias("t"), "bad").collect()]
    got = urls.mine_rules(df, min_support=0.02, min_rows=10)
    want = _rules_by_brute_force(baskets, 0.02, 0.6, 1.5)
    assert {frozenset(r.tokens): round(r.confidence, 9) for r in got} == {k: round(c, 9) for k, c in want.items()} and len(want) > 3
    assert not any("key:ref2" in r.tokens for r in got)


def test_templates_of_many_keys_are_bounded(spark):
    keys = [f"k{i}" for i in range(40)]
    rng = random.Random(2)
    rows = [(f"http://a.com/x?{'&'.join(f'{k}=1' for k in keys if rng.random() < 0.97)}{'&evil=1' if i % 5 == 0 else ''}", i % 5 == 0) for i in range(300)]
    got = urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), max_items=8)
    assert ("key:evil",) in [r.tokens for r in got]


@pytest.mark.parametrize("max_items", [1, 3, 5])
def test_wide_urls_are_mined_whole(spark, max_items):
    """As many tokens as FP-growth takes at once or more: always the rules of brute force."""
    rng, rows = random.Random(8), []
    for _ in range(500):
        host, keys = rng.choice(["a.com", "b-c.net"]), [k for k in ("q", "ref", "id", "u", "v", "w") if rng.random() < 0.6]
        keys += ["ref2"] if "ref" in keys else []
        p = 0.9 if {"q", "u"} <= set(keys) else 0.75 if host == "b-c.net" and "ref" in keys and "id" not in keys else 0.1
        rows.append((f"http://{host}/x?{'&'.join(f'{k}=1' for k in keys)}", rng.random() < p))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    baskets = [(frozenset(r.t), r.bad) for r in df.select(urls.url_tokens(F.col("url")).alias("t"), "bad").collect()]
    got, want = urls.mine_rules(df, min_support=0.02, min_rows=10, max_items=max_items), _rules_by_brute_force(baskets, 0.02, 0.6, 1.5)
    assert {frozenset(r.tokens): round(r.confidence, 9) for r in got} == {k: round(c, 9) for k, c in want.items()} and len(want) > 3 and max(map(len, want)) > 3


def test_rule_of_the_least_telling_tokens(spark):
    """Beside 20 more telling tokens, two that are bad only together."""
    rng, rows = random.Random(4), []
    for i in range(1000):
        own = ["a", "b"] if i % 10 == 0 else ["evil"] if i % 10 < 5 else ["a"] if i % 2 else ["b"]
        rows.append((f"http://h.com/x?{'&'.join(f'{k}=1' for k in [*own, *(f'k{n}' for n in range(20) if rng.random() < 0.99)])}", i % 10 < 5))
    got = urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    assert {(r.tokens, r.confidence) for r in got} == {(("key:evil",), 1.0), (("key:a", "key:b"), 1.0)}


def test_rows_of_a_base(spark):
    base = spark.createDataFrame([([1], 0, 1, [2, 3], 2500, 999), ([], 1, 2, [4], 0, 1000), ([], 1, 2, [5], 1001, 0)], "prefix array<int>, bar_b long, bar_n long, items array<int>, b long, g long")
    got = {(tuple(r["items"]), r.bad): r.n for r in urls._one_by_one(base).groupBy("items", "bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {((2, 3), True): 2500, ((2, 3), False): 999, ((4,), False): 1000, ((5,), True): 1001}


# decontamination

ITEMS = [(0, "w1 w2 w3"), (1, None), (2, ""), (3, "!!"), (4, "nothing that is there at all in any of these texts here"), (0, "w1 w2 w3")]


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_decontaminate(spark, docs, rows, empty, block):
    items = [*ITEMS, *((10 + k, " ".join((rows[k][1] or "").split()[3:40])) for k in range(0, 60, 7))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench, block_bytes=block)
    assert got.columns.count("n_words") == 1
    want = brute.decontaminate(rows, items)
    for r in got.collect():
        text = rows[r.doc_id][1]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id, text]
        assert sum(len(brute.letters(text[s.start : s.end])) for s in r.spans) == r.n_hit
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontaminate_items_without_id(spark, block):
    a, b = (" ".join(f"{c}{i}" for i in range(12)) for c in "ab")
    bench = spark.createDataFrame([(None, a), (None, b), (7, b), (8, None)], "item_id long, text string")
    df = spark.createDataFrame([(1, "x " + a), (2, b), (3, "x y"), (4, a + " " + b)], "doc_id long, text string")
    got = by_id(decontaminate.decontaminate(df, bench, block_bytes=block), "n_hit", "n_items", "items", "contaminated")
    assert got == {1: (12, 1, [], True), 2: (12, 2, ["7"], True), 3: (0, 0, [], False), 4: (24, 2, ["7"], True)}


def test_decontaminate_windows_by_brute_force():
    """Texts of few words, so that blocks, short items and windows meet in all ways."""
    rng = random.Random(12)
    for window in (10, 4, 3, 1):
        items = [(i if i % 5 else None, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 3 * window)))) for i in range(12)]
        windows = decontaminate.Windows(items, window)
        for _ in range(60):
            words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(1, 40))]
            want, named = set(), set()
            for i, t in items:
                own = t.encode().split()
                n = min(window, len(own))
                for j in range(len(own) - n + 1):
                    at = [k for k in range(len(words) - n + 1) if words[k : k + n] == own[j : j + n]]
                    want |= {(k, k + n) for k in at}
                    named |= {i} if at else set()
            start, end, found = windows.scan(words)
            assert set(zip(start.tolist(), end.tolist(), strict=True)) == want and found == named


# substring dedup


def test_substrings(docs, rows, empty):
    want = brute.substring_dedup(rows)
    got = substrings.dedup_substrings(docs, suffixes_each=500)
    for r in got.collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id, rows[r.doc_id][1]]
        assert sum(s.end - s.start for s in r.repeats) == r.n_removed
    assert substrings.dedup_substrings(empty).count() == 0
    replaced = substrings.dedup_substrings(docs, replace=True).where("n_removed > 0").first()
    assert len(replaced.text.split()) == replaced.n_words - replaced.n_removed


def test_maximal_repeats(docs, rows):
    want = brute.repeats(rows)
    for turns in (10**6, 60):  # one group for each partition, and many
        got = substrings.dedup_substrings(docs, suffixes_each=turns).collect()
        assert {r.doc_id: [(x.start, x.end) for x in r.repeats] for r in got} == want and any(want.values())


def test_suffix_tree():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, 600).astype(np.uint64)
    hashes = wordhash.run_hashes(wordhash.mix(words + np.uint64(7)), substrings.depths_for(4))
    hashes = {d: h[:597] for d, h in hashes.items()}
    tree = substrings.SuffixTree(substrings.labels_of(hashes), len(hashes))
    paths = [tuple(words[i : i + 4].tolist()) for i in range(597)]
    for level, depth in enumerate(substrings.depths_for(4), 1):
        count = {}
        for p in paths:
            count.setdefault(p[:depth], set()).add(p[: substrings.depths_for(4)[level]] if level < len(hashes) else None)
        first, last = tree.nodes(level)
        have = {p: [paths.index(p), paths.count(p)] for p in set(paths)}
        leaves = {paths[tree.leaves[a]][:depth]: b - a + 1 for a, b in zip(first.tolist(), last.tolist(), strict=True)}
        want = {p: sum(q[:depth] == p for q in paths) for p, then in count.items() if (len(then) > 1 if level < len(hashes) else have[p][1] > 1)}
        assert leaves == want
    doc = np.zeros(597, dtype=np.int64)
    again = tree.repeats(doc, np.arange(597))
    assert sorted(again.tolist()) == [i for i, p in enumerate(paths) if p in paths[:i]]


def test_a_passage_of_every_document_stays_apart(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"u{i}x{k}" for k in range(30))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.dedup_substrings(df, suffixes_each=2000)
    assert got.where("doc_id > 0 and n_removed <> 40").isEmpty() and got.where("doc_id = 0").first().n_removed == 0
    # a chunk sends each repeated sequence once to its subtree, and the repeats that it knows by document
    own = spark.createDataFrame(rows, "_row_key long, text string").coalesce(1)
    table = np.zeros((6, 1 << 12), dtype=np.int32)
    sent = own.mapInArrow(substrings._emit("text", 20, table, 7, 1, 16), substrings._BLOB).collect()
    leaves = sum(len(packing.unpack_places(packing.split_parts(r.data)[0])[0]) for r in sent if r.kind >= 0)
    known = [len(packing.unpack_places(r.data)[0]) for r in sent if r.kind < 0]
    assert leaves == 400 * 51 - 399 * 21 and sum(known) == 399 * 21 and len(known) == 16 and max(known) < 3 * sum(known) / 16


def test_counts_are_summed_by_a_tree(spark):
    tables = np.arange(64 * 4 * 5).reshape(5, 64, 4)
    df = spark.createDataFrame([(j, 0, bytearray(packing.squeeze(t[j], "<i8"))) for t in tables for j in range(64)], "part int, kind int, data binary").repartition(5)
    for tasks in (5, 3 * 256):
        assert common.slices_summed(df, 64, 256, tasks).tolist() == tables.sum(axis=0).reshape(-1).tolist()


def test_substrings_odd_ids(odd):
    want = brute.substring_dedup([tuple(r) for r in odd.collect()])
    got = substrings.dedup_substrings(odd).collect()
    assert len(got) == 9
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id, r.text]


def test_substrings_of_a_row_given_twice(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage + " x " + passage)] * 3 + [(2, "y " + passage)] * 2
    want = brute.substring_dedup(rows)
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(got) == 5
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id, r.text]


# Jaccard join


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard(docs, rows, width, percent):
    got = by_id(jaccard.jaccard_components(docs, width=width, percent=percent, tokens_each=2000), "n_shingles", "component_id")
    assert got == brute.jaccard(rows, width, percent)


def test_jaccard_odd_ids(odd, empty):
    got = jaccard.jaccard_components(odd).select("doc_id", "text", "component_id", "first_of_component").collect()
    assert len(got) == 9 and jaccard.jaccard_components(empty).count() == 0
    firsts = {(r.doc_id, r.text) for r in got if r.first_of_component}
    assert len({t for _, t in firsts if t}) == 3 and (3, None) in firsts
    assert all(r.component_id is None for r in got if r.text and r.text.startswith("p") and "q" not in r.text)


def test_prefixes_lose_no_link():
    """Sets over few classes, all frequent, some or none: any two that link share an entry."""
    rng = np.random.default_rng(5)
    for percent in (67, 80, 90, 95):
        for often in (0, 30, 200):
            base = np.unique(rng.integers(0, 1 << 62, 160, dtype=np.int64).astype(np.uint64))
            sets = []
            for _ in range(120):
                own = base[: rng.choice([12, 40, 80, len(base)])].copy()
                own = own[rng.random(len(own)) > rng.choice([0, 0.02, 0.05, 0.1])]
                sets.append(np.unique(np.concatenate((own, rng.integers(0, 1 << 62, rng.integers(0, 1 + len(own) // 8), dtype=np.int64).astype(np.uint64)))))
            levels = np.where(np.arange(1 << jaccard.CLASS_BITS) % 200 < often, 200, 10).astype(np.uint8)
            tokens, at = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            entry, key = jaccard.prefix_entries(tokens.copy(), at, levels, 100, percent)
            keys = [set(key[entry == i].tolist()) for i in range(len(sets))]
            linked = 0
            for i in range(len(sets)):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and not np.array_equal(sets[i], sets[j]):
                        linked += 1
                        assert keys[i] & keys[j], (percent, often, len(sets[i]), len(sets[j]), both)
            assert linked > 5


def test_jaccard_of_very_long_texts(spark):
    words = [f"w{k % 5000}x{k // 7}" for k in range(200_000)]
    rows = [(i, " ".join(words[: 200_000 - 40 * i])) for i in range(3)] + [(9, " ".join(words[100_000:]))]
    levels = np.full(1 << jaccard.CLASS_BITS, 200, dtype=np.uint8)
    own = pa.RecordBatch.from_pydict({"text": [rows[0][1]]})
    tokens, at = jaccard.shingle_sets(own, "text", 3)
    entry, _ = jaccard.prefix_entries(tokens, at, levels, 100, 90)
    assert len(entry) <= jaccard.extended(np.diff(at), 90)[0]
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), "component_id")
    assert got == {0: (0,), 1: (0,), 2: (0,), 9: (9,)}


def test_jaccard_of_large_groups(spark, monkeypatch):
    """Near copies in many blocks, chains whose ends are not alike, and hot leaders."""
    monkeypatch.setattr(jaccard, "LEAST_HOT", 5)
    monkeypatch.setattr(jaccard, "HOT", 20)
    rng = random.Random(7)
    base, rows = [f"b{k}" for k in range(120)], []
    for i in range(90):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    chain = list(base)
    for i in range(100, 160):
        chain[(i * 2) % 120] = f"c{i}"
        rows.append((i, " ".join(chain)))
    rows += [(200 + i, " ".join(base[: 60 + i])) for i in range(55)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for tokens_each in (600, 2500, 10**6):
        assert by_id(jaccard.jaccard_components(df, tokens_each=tokens_each), "n_shingles", "component_id") == brute.jaccard(rows)


def test_jaccard_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_HOT", 5)
    monkeypatch.setattr(jaccard, "HOT", 20)
    a = " ".join(f"a{k}" for k in range(40))
    rows = [(i, a) for i in range(10, 60)] + [(i, None if i % 2 else " ") for i in range(60, 90)] + [(3, a + " more"), (95, "b c d"), (96, "b c d")]
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id")
    assert got == brute.jaccard(rows)


def test_links_and_bounds():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(12)]
        sets += [np.unique(np.append(s[1:], rng.integers(0, 60, 1)).astype(np.uint64)) for s in sets[:4]]
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        root = jaccard.link_sets(np.concatenate(sets), at, 80)
        want = list(range(len(sets)))
        linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        for i in range(len(sets)):
            for j in range(i):
                if linked(sets[i], sets[j]):
                    want = [want[j] if w == want[i] else w for w in want] if want[j] < want[i] else [want[i] if w == want[j] else w for w in want]
        assert root.tolist() == want
        can = jaccard.can_link(np.diff(at), jaccard.histograms(np.concatenate(sets), at), 80)
        assert all(can[i] for i in range(len(sets)) if any(linked(sets[i], sets[j]) for j in range(len(sets)) if j != i))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}
    for a, b in links:
        for x in (a, b):
            root.setdefault(x, x)
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in x and x[0] != x[1] for x in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# tokens


def test_token_output(spark, docs, rows, empty, odd):
    import zlib

    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    more = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endoftext", "x\ty <|endoftext|>\n"]
    rows = [*rows, *((1000 + i, t) for i, t in enumerate(more))]
    start, want = 0, {}
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    # columns named like those of the result, and like the row itself
    docs = docs.unionByName(spark.createDataFrame(rows[-len(more) :], "doc_id long, text string"), allowMissingColumns=True).withColumn("start", F.lit("x")).withColumn("n_tokens", F.lit(0))
    got = tokens.token_output(docs, path, end_id=2)
    assert by_id(got, "start", "n_tokens", "ids_crc32") == want and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert tokens.token_output(empty, path, end_id=2).count() == 0
    assert tokens.token_output(odd, path, end_id=2).orderBy("start").first().doc_id is None and tokens.token_output(odd, path, end_id=2).count() == 9
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    enc = tokens.Encoder(path, special_as_text=True)
    assert [x.tolist() for x in enc.encode(pa.array(more))] == [plain.encode(t, add_special_tokens=False).ids for t in more]


def test_units_are_independent():
    """Random strings of awkward characters give the library's ids."""
    from tokenizers import Tokenizer

    path, rng = public.path("byte_bpe_50k.json"), random.Random(11)
    library, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = ["".join(rng.choice([" ", "  ", "\n", "\n\n", "\t", "a", "the", "'s", "'", "1", "23", "!", "--", "é", "ß", "日本", "🎉", "\u00a0", "\u2003", "<|endoftext|>", "_", "Wo"]) for _ in range(rng.randrange(30))) for _ in range(1500)]
    assert [x.tolist() for x in enc.encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_shards_by_bytes(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_BYTES", 4000)
    manifest = tokens.write_tokens(docs, f"file://{tmp_path}/t", public.path("byte_bpe_50k.json"), end_id=2)
    assert len(manifest) > 8 and sum(m[2] for m in manifest) == docs.count()


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17])
def test_shards(tmp_path, bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 5, 1000, 1, 0, 3000)]
    with open(tmp_path / "s", "wb") as out:
        writer = tokens.ShardWriter(out, bits, block_ids=256)
        for i, ids in enumerate(docs):
            writer.add(None if i == 3 else i, ids)
        writer.close()
    with open(tmp_path / "s", "rb") as file:
        reader = tokens.ShardReader(file, (tmp_path / "s").stat().st_size)
        assert [(d, ids.tolist()) for d, _, ids in reader.documents()] == [(None if i == 3 else i, x.tolist()) for i, x in enumerate(docs)]
        flat = np.concatenate(docs)
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
            assert reader.ids(a, b).tolist() == flat[a:b].tolist()
        assert reader.document(2).tolist() == docs[2].tolist()


# pieces


def test_pieces(docs, rows, empty):
    import sentencepiece

    model = public.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = by_id(pieces.encode_pieces(docs, model, dropout=0), "ids", "roundtrip")
    assert all(plain[d] == (library.encode(t or ""), True) for d, t in rows)
    drawn, again, other = (by_id(pieces.encode_pieces(docs, model, dropout=0.2, seed=s), "ids", "roundtrip") for s in (1, 1, 2))
    assert drawn == again != other and all(ok for _, ok in drawn.values())
    assert sum(len(i) for i, _ in drawn.values()) > sum(len(i) for i, _ in plain.values())
    codec = pieces.Codec(model, dropout=1.0, variants=1)
    for t in ("▁ x▁ ▁▁", "<s>\x00</s>", "a" * 700, "\ud83d"):
        assert codec.decode(codec.encode([t], [0])[0]) == t
    assert pieces.encode_pieces(empty, model).count() == 0


def _merged(text, model, least, key, variant, of_bytes):
    """One unit by the rules of the method: the best pair first, the leftmost of equals, no merge type that its hash skips."""
    rank = {p: r for r, p in enumerate(model)}
    width = len(model).bit_length()
    salt = int(wordhash.mix(np.array([(key + variant * 0x9E3779B97F4A7C15) % 2**64], dtype=np.uint64))[0])

    def made(a, b):
        r = rank.get(a + b)
        if r is None or a not in rank or b not in rank:
            return None
        pair = rank[a] << width | rank[b]
        return r if int(wordhash.mix(np.array([pair ^ salt], dtype=np.uint64))[0]) >= least else None

    parts = ["▁" if c == " " else "\0" + c if c == "▁" else c for c in text]
    while True:
        found = [(r, i) for i in range(len(parts) - 1) if (r := made(parts[i], parts[i + 1])) is not None]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [x for p in parts for x in ([rank[p]] if p in rank else [("byte", b) for b in p.replace("\0", "").encode()])]


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_dropout_by_brute_force(docs, rows, dropout):
    path = public.path("piece_bpe_32k.model")
    codec = pieces.Codec(path, dropout=dropout)
    p = codec.pieces
    model = [None] * len(p.rank)
    for piece, r in p.rank.items():
        model[r] = piece
    got = by_id(pieces.encode_pieces(docs, path, dropout=dropout), "variant", "ids", "n_tokens")
    known, variants = {}, set()
    for d, t in rows[::3]:
        variant, ids, n = got[d]
        variants.add(variant)
        want = []
        for unit in re.findall(" *[^ ]+| +", " " + t) if t else []:
            if (unit, variant) not in known:
                own = _merged(unit, model, codec.least, codec.key, variant, None)
                known[unit, variant] = [p.byte_id[x[1]] if isinstance(x, tuple) else p.id_of[x] for x in own]
            want += known[unit, variant]
            if len(known) > 1500:
                break
        assert ids[: len(want)] == want and n == len(ids)
    assert len(variants) > 3


def test_pieces_of_odd_rows(spark, odd):
    path = public.path("piece_bpe_32k.model")
    got = pieces.encode_pieces(odd.withColumn("variant", F.lit("x")).withColumn("extra", F.lit(1)), path).collect()
    assert len(got) == 9 and all(r.roundtrip and r.extra == 1 for r in got) and {r.variant for r in got if r.doc_id is None} == {0}
    assert all(len({tuple(r.ids) for r in got if (r.doc_id, r.text) == k}) == 1 for k in {(r.doc_id, r.text) for r in got})


# html

PAGES = {
    '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">Buy, now.</div><article><h1>Head</h1><p>One, two &amp; three.<br><p><b>Four</b> five,\n six.</article><footer>&copy; me.</footer>': "Head\n\nOne, two & three.\n\nFour five, six.",
    '<body><div id="top-menu">A B</div><div id="content"><h2>T</h2><p>Some long text, with marks, and more of it.</p><aside>Side, note.</aside><p>And again, some text, of the page.</p></div><section class="comments"><p>Nice, really nice, I think so.</p></section></body>': "T\n\nSome long text, with marks, and more of it.\n\nAnd again, some text, of the page.",
    "": "", "just text": "just text", "<p>": "", "<!-- x --><p>a &lt; b</p>": "a < b", "<p>un<i>clo</i>sed": "unclosed", "<script>x": "", '<p title="a>b">q</p>': "q", "<div hidden><p>no, no.</p></div><p>yes, yes.</p>": "yes, yes.",
}


def test_html(spark):
    for page, want in PAGES.items():
        assert html.main_text(page) == want
    df = spark.createDataFrame([(1, None, "keep"), (1, "<p>x</p>", "keep")], "page_id long, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html.extract(df).collect()) == [("", 0), ("x", 1)]
    assert html.main_text("<article>" + "<p>long, text. " * 3000).count("\n\n") == 2999
    assert html.main_text("<div>" * 3000 + "deep, text.") == "deep, text."


def test_html_named_wrappers():
    body = "".join(f"<p>Sentence {k} of the text, with marks, and long enough.</p>" for k in range(4))
    want = html.main_text(f"<body><main>{body}</main></body>")
    assert want.count("Sentence") == 4
    for wrap in ("content-sidebar-wrap", "layout has-sidebar", "post with-header", "has-comments"):
        for tag in ("main", "article"):
            assert html.main_text(f"<body><div class='{wrap}'><{tag} class='content'>{body}</{tag}><div class='sidebar'><p>Side, note.</p></div></div></body>") == want
    assert html.main_text(f"<body><div class='layout has-sidebar'><div><div class='with-header'>{body}</div></div></div><p>Stray.</p></body>").count("Sentence") == 4
    talk = "".join("<p>I think, as a reader, that it is all quite wrong, really.</p>" for _ in range(30))
    assert "reader" not in html.main_text(f"<body><div>{body}</div><section class='comments'>{talk}</section></body>")
    assert "reader" not in html.main_text(f"<body><article>{body}</article><div class='related'><article>{talk}</article></div></body>".replace("related", "comments"))


def test_html_marked_article_whole():
    long = "A sentence of the text, with marks. " * 14
    for tag in ("article", "main"):
        page = f"<body><p>Stray.</p><{tag}><h1>Title of it</h1><div class=lead><p>A lead of about forty characters, so.</p></div><div class=body>{f'<p>{long}' * 5}</div><div class=ad>Buy, now.</div><div class=end><p>The end.</p></div></{tag}></body>"
        got = html.main_text(page).split("\n\n")
        assert got[:2] == ["Title of it", "A lead of about forty characters, so."] and got[-1] == "The end." and len(got) == 8


# languages


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], 3, rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y, mask = rng.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1]), np.ones((6, 4))
    mask[4:, 1] = 0
    _, grads = net.gradients(x, y, mask, np.ones(3))
    for name in grads:
        flat = net.weights[name].reshape(-1)
        for i in rng.integers(0, len(flat), 6):
            old, out = flat[i], []
            for step in (1e-2, -1e-2):
                flat[i] = old + step
                out.append(net.gradients(x, y, mask, np.ones(3))[0])
            flat[i] = old
            assert abs((out[0] - out[1]) / 2e-2 - grads[name].reshape(-1)[i]) < 2e-3, name


def test_language_id(spark, empty):
    rng = random.Random(4)
    words = {"en": "the of and thing with".split(), "fr": "été de les où ça".split(), "de": "der die ß für über".split()}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(rng.randrange(3, 60))), g if i % 10 else None) for i, g in enumerate(rng.choices(list(words), k=300))]
    rows += [(None, "the of", "en"), (900, None, "en"), (901, "", "fr"), (902, "123 !!", "de"), (904, "½ ² ①", "de"), (905, "ª", "en"), (903, "é" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(df, rows_per_lang=80, steps=60, batch=128)
    got = langid.identify(df.withColumn("score", F.lit(9)), net)
    assert got.columns.count("score") == 1
    for r in got.collect():
        if not r.text or r.doc_id in (902, 904):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert 0 < r.score <= 1 and r.lang_pred in words
    right = got.where("doc_id < 900 and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0
    assert langid.train(df, rows_per_lang=80, steps=60, batch=128).weights["V"].tolist() == net.weights["V"].tolist()


def test_training_rows_are_bounded(spark):
    df = spark.range(20000).selectExpr("cast(id as string) as doc_id", "concat('word ', id) as text", "if(id % 10 = 0, 'b', 'a') as lang").unionAll(spark.range(500).selectExpr("'same'", "concat('x', id)", "'c'"))
    rows = langid.training_rows(df, "doc_id", "text", "lang", 100, 10).collect()
    assert {g: sum(r.lang == g for r in rows) for g in "abc"} == {"a": 100, "b": 100, "c": 1}
    keys = [r.key for r in df.where("lang = 'a'").selectExpr("xxhash64(doc_id, 17) as key").orderBy("key").limit(100).collect()]
    assert sorted(r.key for r in rows if r.lang == "a") == keys


# packing and hashes


def test_packing():
    rng = np.random.default_rng(0)
    doc = np.sort(rng.integers(-(10**12), 10**12, 500))
    place = np.concatenate([np.sort(rng.integers(0, 10**6, n)) for n in np.unique(doc, return_counts=True)[1]])
    for d, p in ((doc, place), (doc[:0], place[:0])):
        a, b = packing.unpack_places(packing.pack_places(d, p))
        assert (a == d).all() and (b == p).all()
    x = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    assert (packing.uncut_bytes(packing.cut_bytes(x, 7), 7) == x & np.uint64((1 << 56) - 1)).all()
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10**6, None, "b"] * 5})
    parts = list(packing.sized_batches(iter([batch, batch]), 10**6))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch, batch]).to_pydict() and len(parts) > 5


def test_hashes(texts):
    buf, _ = wordhash.text_bytes(pa.array(texts))
    starts, hashes = wordhash.hash_words(buf)
    words = bytes(buf).split()
    assert len(starts) == len(words) and len(set(words)) == len(set(hashes.tolist()))
    runs = wordhash.run_hashes(hashes, (1, 5, 20))
    for n, h in runs.items():
        assert len(h) == len(words) - n + 1 and len({tuple(words[i : i + n]) for i in range(len(h))}) == len(set(h.tolist()))
