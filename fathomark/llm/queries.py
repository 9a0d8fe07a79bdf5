"""The thin queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.llm import decontaminate, html, jaccard, langid, licenses, oracles, pieces, quality, substrings, tokens, urls
from fathomark.llm.common import session_batches, table


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
URL_RULES = tuple(map(urls.stated, ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    network = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), network).select("doc_id", "held_out", "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), PHRASES)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "web-1")
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality.BASE).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    marked = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    mined = urls.mine_rules(pages.join(marked, "page_id"))
    return urls.filter_urls(pages, URL_RULES, mined).select("page_id", "host", "path", "rule", "verdict")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = pieces.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
    return made.select("doc_id", "variant", "n_tokens", "ids_crc32", "roundtrip")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated phrases alone, without signature rules."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), PHRASES, rules=())
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def url_stated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated rules alone, without mined ones."""
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, []).select("page_id", "host", "path", "rule", "verdict")


def url_mined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules mined from labels that depend on the urls: those with a "page" key, and Spanish ones, are bad; with the urls that they block."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.col("url").rlike("[?&]page=") | F.col("url").contains("/es/")
    mined = urls.mine_rules(pages.withColumn("bad", bad))
    found = urls.filter_urls(pages, [], mined)
    return found.where("mined_rule is not null").groupBy(F.col("mined_rule").alias("rule")).agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("verdict") == "block").alias("n_blocked"))


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session_batches(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _query(f) for f in (op1_language_id, op2_substring_dedup, op3_license_scan, op4_token_output, op5_html_extract, op6_quality_rules, op7_url_filter, op8_sentencepiece, op9_decontaminate, op10_ngram_jaccard)}
QUERIES |= {f.__name__: _query(f) for f in (license_phrases, url_stated_rules, url_mined_rules)}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op6_quality_rules": oracles.QUALITY_RULES,
    "op9_decontaminate": oracles.DECONTAMINATE,
    "op10_ngram_jaccard": oracles.NGRAM_JACCARD,
    "license_phrases": oracles.license_phrases(PHRASES),
    "url_stated_rules": oracles.url_rules([(r.verdict, r.host, r.path) for r in URL_RULES]),
    "url_mined_rules": oracles.URL_MINED,
}
