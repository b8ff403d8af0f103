"""Queries of this subpackage and their SQL; ``__spark_entry__.py`` adds them if the subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact, jaccard, packing, sstable, substring, suffixes, toxicity, urls, wordpiece


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without windows of 35 that start anywhere else too."""
    return substring.remove_repeats(table(spark, sf_dir, "documents"), width=35, texts=False)


def op2_sorted_string_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids as they are read back from sorted shards."""
    return sstable.token_shards(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op3_pigeonhole_myers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents, one edit for every 16 characters."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_longest_match_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts by longest match."""
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op5_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts and the row of each that stays."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by five rules; a page that none fits is allowed."""
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of five-word sets with a similarity of 0.8 or more."""
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op8_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes without 50-byte strings that start in an earlier document too."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), width=50, kept=False)


def op9_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens, packed into as few sequences as the search finds."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=2, capacity=1024)


def op10_subsequence_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores by a machine trained on four fifths of the labels."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fingerprint_index, op2_sorted_string_shards, op3_pigeonhole_myers, op4_longest_match_automaton, op5_patricia_owners, op6_url_ranges, op7_chosen_path_join, op8_sparse_suffix_array, op9_bin_completion, op10_subsequence_kernel)
}

ORACLES: dict[str, str] = {
    "op5_patricia_owners": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM n""",
    "op6_url_ranges": r"""
        WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
             r(h, q, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
             m AS (SELECT page_id, max_by(h || q, strlen(h || q)) AS rule, max_by(verdict, strlen(h || q)) AS verdict
                   FROM p JOIN r ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q) GROUP BY page_id)
        SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
}
