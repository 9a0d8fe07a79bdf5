"""URL filters: stated rules for hosts and paths, and association rules mined by FP-growth.

A url's host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end,
with A-Z lowered; its path goes on from there up to ``?``, ``#`` or the end. A stated rule fits its
host and all subdomains where the path starts with the rule's; the longest that fits decides.

Where none fits, mined rules do. The tokens of labelled urls, with one more token on the bad ones,
are baskets for Spark's FP-growth; itemsets that hold the token make rules "these tokens, so
bad". Rules are pruned by support (a share of the baskets, and a number of them), by confidence, by
lift over the share of bad urls, and where a rule with fewer of their tokens is as confident. Rules may have any number of
tokens, and urls too: all their tokens are mined. What is left out before can't change the rules:

* ``min_support`` and ``min_rows``: a combination in a smaller share, or fewer, of the labelled urls makes no rule.
* tokens that stand in every labelled url tell nothing and are left out; of tokens that stand in just the same
  urls (the keys of a query that always come together), one speaks for all, so that they don't multiply.

Where a url has more than ``max_items`` tokens, FP-growth's first steps are made here: from the rarest token on, each token's
conditional base (the urls that have it, with their more frequent tokens) is split off, and split again, by what is rarest in it, while it holds a
url of more than ``NARROW``; one run of FP-growth mines all bases that are left. A base goes no further where that is exact: its tokens
that too few bad urls have, or all urls in it, are left out (with them, a rule is as confident as without); it ends where no url is good, and
where not even a rule that loses all good urls but those with all of its tokens would be more confident than the
rules on the way there, or than asked for. So a template of many tokens, which stand in good urls as well, ends at once. Many
tokens that come and go freely among bad urls, but hardly in good ones, still have 2 ** n combinations, and are all gone through.

An inverted index from each rule's rarest token finds the rules that can match a url; it is a literal of the plan.

All is built from DataFrame functions. Edge cases: null urls, and urls without ``://``, have empty hosts
and paths and no tokens, so that they are allowed; no labels, or none bad, give no mined rules; of mined rules of equal
confidence the last by name is reported; repeated urls are judged each by itself; urls are judged whole, however long; an
empty table gives an empty one; other columns are kept, except those named like an output column.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fathomark.llm.common import clearing, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of tokens that name something; the others are shapes.
TELLING = ("host", "path", "key")
OUT = ("host", "path", "rule", "verdict")
#: Where bases are split at all, they are until no url has more tokens: going on is cheaper than the 2 ** n itemsets of what is left.
NARROW = 6


@dataclass(frozen=True)
class Stated:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def stated(text: str) -> Stated:
    """From "block com/en/"."""
    verdict, rule = text.split(" ", 1)
    host, slash, path = rule.partition("/")
    return Stated(verdict, host.lower(), slash + path)


@dataclass(frozen=True)
class Mined:
    tokens: tuple[str, ...]
    support: float
    confidence: float
    lift: float


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, parts of host labels, words and shapes of the path, extension, query keys."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    parts = F.filter(F.split(host, "[.\\-]"), lambda x: x != "")
    words = F.filter(F.split(F.translate(path, UPPER, LOWER), "[/._\\-]"), lambda x: x.rlike("^[a-z][a-z0-9]*$"))
    keys = F.filter(F.transform(F.split(query, "[&;]"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    tagged = F.concat(
        F.transform(parts, lambda x: F.concat(F.lit("host:"), x)),
        F.transform(words, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(keys, lambda x: F.concat(F.lit("key:"), x)),
        F.array(F.concat(F.lit("scheme:"), F.translate(F.regexp_extract(url, "^([^:/?#]*)://", 1), UPPER, LOWER)), F.concat(F.lit("depth:"), F.least(F.size(F.split(path, "/")), F.lit(9)).cast("string"))),
        F.when(host.contains("-"), F.array(F.lit("host-has:-"))).otherwise(F.array().cast("array<string>")),
        F.when(path.endswith("/"), F.array(F.lit("path-ends:/"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(tagged))


def _split(rows: DataFrame, least: int, wanted: Callable[[Column, Column], Column], max_items: int) -> tuple[list[tuple[list[int], int, int]], list[DataFrame]]:
    """Conditional bases in which no url has more than max_items tokens, from rows of (items, bad) of which some have.

    Gives the sets of tokens on the way that are wanted, each with its numbers of bad and of all urls; and the bases, in rows of
    (prefix, bar_b, bar_n, items, b, g): what is mined from items belongs to the prefix, and has to be more confident than bar_b of bar_n.
    """
    passed: list[tuple[list[int], int, int]] = []
    narrow: list[DataFrame] = []
    count = lambda of: F.sum(F.when(of, 1).otherwise(0)).cast("long")
    level = rows.groupBy("items").agg(count(F.col("bad")).alias("b"), count(~F.col("bad")).alias("g"))
    level = written(level.select(F.array().cast("array<int>").alias("prefix"), F.lit(0).cast("long").alias("bar_b"), F.lit(1).cast("long").alias("bar_n"), "items", "b", "g"), "urls")
    while True:
        wide = level.groupBy("prefix").agg(F.max(F.size("items")).alias("w")).where(F.col("w") > max_items).select("prefix")
        narrow.append(level.join(wide, "prefix", "left_anti"))
        if wide.isEmpty():
            return passed, narrow
        each = level.join(wide, "prefix", "left_semi").select("prefix", "bar_b", "bar_n", "b", "g", "items", F.posexplode("items").alias("i", "t"))
        each = each.select(F.concat("prefix", F.array("t")).alias("prefix"), "bar_b", "bar_n", F.expr("slice(items, i + 2, size(items))").alias("items"), "b", "g")
        each = written(each.groupBy("prefix", "bar_b", "bar_n", "items").agg(F.sum("b").alias("b"), F.sum("g").alias("g")), "urls")
        here = each.groupBy("prefix", "bar_b", "bar_n").agg(F.sum("b").alias("n_b"), F.sum(F.col("b") + F.col("g")).alias("n")).where(F.col("n_b") >= least)
        better = wanted(F.col("n_b"), F.col("n")) & (F.col("n_b") * F.col("bar_n") > F.col("bar_b") * F.col("n"))
        here = written(here.withColumn("better", better), "urls")
        passed += [(list(r.prefix), r.n_b, r.n) for r in here.where("better").collect()]
        bar = [F.when(F.col("better"), F.col(n)).otherwise(F.col(o)).alias(o) for n, o in (("n_b", "bar_b"), ("n", "bar_n"))]
        here = here.where("n_b < n").select("prefix", *bar, "n")
        tails = each.select("prefix", "b", "g", F.explode("items").alias("t")).groupBy("prefix", "t").agg(F.sum("b").alias("t_b"), F.sum(F.col("b") + F.col("g")).alias("t_n"))
        tails = tails.join(here, "prefix").where((F.col("t_b") >= least) & (F.col("t_n") < F.col("n")))
        # the rarest here goes first, so that those which nearly all urls here have are left together
        tails = tails.groupBy("prefix", "bar_b", "bar_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_n", "t"))), lambda x: x["t"]).alias("tail"), F.max("t_b").alias("top"))
        cut = each.drop("bar_b", "bar_n").join(tails, "prefix").withColumn("items", F.array_intersect("tail", "items"))
        # no rule from here on has more bad urls than top, or fewer good ones than have the whole tail
        ends = cut.groupBy("prefix", "bar_b", "bar_n", "top").agg(F.sum(F.when(F.size("items") == F.size("tail"), F.col("g")).otherwise(0)).alias("all_g"))
        most = F.col("top") + F.col("all_g")
        on = ends.where(wanted(F.col("top"), most) & (F.col("top") * F.col("bar_n") > F.col("bar_b") * most)).select("prefix")
        level = cut.join(on, "prefix", "left_semi").where(F.size("items") > 0).groupBy("prefix", "bar_b", "bar_n", "items").agg(F.sum("b").alias("b"), F.sum("g").alias("g"))
        level = written(level.select("prefix", "bar_b", "bar_n", "items", "b", "g"), "urls")


def _one_by_one(base: DataFrame) -> DataFrame:
    """A row for each url that rows of a base stand for."""
    spark, size = base.sparkSession, 1000
    rows = base.select("*", F.explode(F.array(F.struct(F.lit(True).alias("bad"), F.col("b").alias("c")), F.struct(F.lit(False).alias("bad"), F.col("g").alias("c")))).alias("_k")).where("_k.c > 0")
    rows = rows.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_k.c - 1) div {size}")))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(size).cast("long"), F.col("_k.c") - F.col("_at") * size))))
    return rows.select("prefix", "bar_b", "bar_n", "items", "_k.bad")


def mine_rules(urls: DataFrame, *, url: str = "url", bad: str = "bad", min_support: float = 0.002, min_rows: int = 25, max_items: int = 16, min_confidence: float = 0.6, min_lift: float = 1.5) -> list[Mined]:
    """Rules from rows of a url and whether it is bad (boolean; rows with null are left out). max_items: how wide urls may be for FP-growth at once; it doesn't change the rules."""
    with clearing(urls.sparkSession):
        return _mine(urls, url, bad, min_support, min_rows, max_items, min_confidence, min_lift)


def _mine(urls: DataFrame, url: str, bad: str, min_support: float, min_rows: int, max_items: int, min_confidence: float, min_lift: float) -> list[Mined]:
    from pyspark.ml.fpm import FPGrowth

    labelled = urls.select(url_tokens(F.col(f"`{url}`")).alias("items"), F.col(f"`{bad}`").alias("bad")).where("bad is not null and size(items) > 0")
    total, n_bad = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if not n_bad or total < min_rows:
        return []
    least = max(min_rows, math.ceil(min_support * total), 1)
    wanted = lambda n_both, n: (n_both >= min_confidence * n) & (n_both * total >= min_lift * n_bad * n)
    each = labelled.select(F.explode("items").alias("t"), "bad", F.xxhash64("items", "bad").cast("decimal(38,0)").alias("h"))
    each = each.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"), F.sum("h").alias("urls"))
    # tokens that too few bad urls have for a rule go first; so do those in every url
    often = each.where((F.col("n_bad") >= least) & (F.col("n") < total)).collect()
    speaks: dict[tuple, Row] = {}
    for r in sorted(often, key=lambda r: (r.t.split(":")[0] not in TELLING, r.t)):
        speaks.setdefault((r.n, r.urls), r)
    names = [r.t for r in sorted(speaks.values(), key=lambda r: (r.n, r.t))]
    rank = F.from_json(F.lit(json.dumps({t: k for k, t in enumerate(names)})), "map<string,int>")
    items = F.array_sort(F.transform(F.filter("items", lambda t: F.map_contains_key(rank, t)), lambda t: rank[t]))
    rows = labelled.select(items.alias("items"), "bad").where(F.size("items") > 0)
    width, n_rows = rows.agg(F.max(F.size("items")), F.count(F.lit(1))).first()
    if not n_rows:
        return []
    passed: list[tuple[list[int], int, int]] = []
    if width > max_items:
        passed, bases = _split(rows, least, wanted, min(max_items, NARROW))
        rows = written(reduce(DataFrame.unionByName, map(_one_by_one, bases)), "urls")
        n_rows = rows.count()
    else:
        rows = rows.select(F.array().cast("array<int>").alias("prefix"), F.lit(0).cast("long").alias("bar_b"), F.lit(1).cast("long").alias("bar_n"), "items", "bad")
    # each base has tokens of its own: its prefix, what a rule has to be better than, and the token (-1: bad)
    marked = F.when(F.col("bad"), F.array_append("items", F.lit(-1))).otherwise(F.col("items"))
    base = F.concat_ws("|", F.concat_ws(",", F.col("prefix").cast("array<string>")), "bar_b", "bar_n")
    baskets = rows.select(F.transform(marked, lambda t: F.concat_ws("|", base, t.cast("string"))).alias("items"))
    if n_rows:
        # a half less, so that no rounding of a share asks for more than least rows
        sets = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n_rows), minConfidence=min_confidence).fit(baskets).freqItemsets
        of = F.split(F.col("items")[0], r"\|")
        tokens = F.array_sort(F.transform("items", lambda t: F.split(t, r"\|")[3].cast("int")))
        sets = sets.select(of[0].alias("prefix"), of[1].cast("long").alias("bar_b"), of[2].cast("long").alias("bar_n"), tokens.alias("tokens"), F.col("freq"))
        small = sets.withColumn("bad", F.array_contains("tokens", -1)).withColumn("tokens", F.array_remove("tokens", -1)).where(F.size("tokens") > 0)
        both = small.where("bad").select("prefix", "bar_b", "bar_n", "tokens", F.col("freq").alias("n_both")).join(small.where("not bad").select("prefix", "tokens", F.col("freq").alias("n")), ["prefix", "tokens"])
        found = written(both.where(wanted(F.col("n_both"), F.col("n"))).where(F.col("n_both") * F.col("bar_n") > F.col("bar_b") * F.col("n")), "urls")
        # most rules are no better than one with a token less, and stay in the cluster
        less = found.select("prefix", F.explode("tokens").alias("t"), "tokens", "n_both", "n").select("prefix", F.array_remove("tokens", F.col("t")).alias("less"), "tokens", "n_both", "n")
        f = found.select(F.col("prefix").alias("p"), F.col("tokens").alias("less"), F.col("n_both").alias("f_both"), F.col("n").alias("f_n"))
        worse = less.join(f, (less["prefix"] == f["p"]) & (less["less"] == f["less"])).where("n_both * f_n <= f_both * n").select("prefix", "tokens")
        kept_ = found.join(worse, ["prefix", "tokens"], "left_anti").collect()
        passed += [([*map(int, filter(None, r.prefix.split(","))), *r.tokens], r.n_both, r.n) for r in kept_]
    rules = [Mined(tuple(sorted(names[k] for k in own)), n_both / total, n_both / n, n_both / n * total / n_bad) for own, n_both, n in passed]
    kept: dict[frozenset, Mined] = {}
    for r in sorted(rules, key=lambda r: (len(r.tokens), r.tokens)):
        if not any(k < set(r.tokens) and s.confidence >= r.confidence for k, s in kept.items()):
            kept[frozenset(r.tokens)] = r
    return list(kept.values())


def mined_match(url: Column, rules: list[Mined]) -> Column:
    """The name of the most confident rule whose tokens are all in the url, or null."""
    if not rules:
        return F.lit(None).cast("string")
    often: dict[str, float] = {}
    for r in rules:
        for t in r.tokens:
            often[t] = often.get(t, 0) + r.support
    index: dict[str, list] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (often[t], t)), []).append({"tokens": list(r.tokens), "c": r.confidence, "name": " ".join(r.tokens)})
    table = F.from_json(F.lit(json.dumps(index)), "map<string,array<struct<tokens:array<string>,c:double,name:string>>>")

    def match(tokens: Column) -> Column:
        near = F.flatten(F.transform(F.filter(tokens, lambda t: F.map_contains_key(table, t)), lambda t: table[t]))
        full = F.filter(near, lambda r: F.size(F.array_except(r["tokens"], tokens)) == 0)
        return F.array_max(F.transform(full, lambda r: F.struct(r["c"].alias("c"), r["name"].alias("name"))))["name"]

    return F.transform(F.array(url_tokens(url)), match)[0]


def stated_match(host: Column, path: Column, rules: list[Stated]) -> Column:
    """The longest stated rule that fits, as struct(name, verdict), or null."""
    best = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def filter_urls(pages: DataFrame, rules: list[Stated], mined: list[Mined], *, url: str = "url") -> DataFrame:
    """All rows of pages with host, path, rule, verdict and mined_rule."""
    kept = [c for c in pages.columns if c not in (*OUT, "mined_rule")]
    u = F.col(f"`{url}`")
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), host_of(u).alias("host"), path_of(u).alias("path"), mined_match(u, mined).alias("mined_rule"))
    rows = rows.withColumn("_s", stated_match(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_s.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return rows.select(*(f"`{c}`" for c in kept), "host", "path", F.col("_s.name").alias("rule"), verdict.alias("verdict"), "mined_rule")
