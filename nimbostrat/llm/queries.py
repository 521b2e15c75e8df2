"""The corpus operators bound to the project's tables, and their SQL.

Null and empty texts, repeated rows, ties and empty tables are treated as each
operator's own docstring says; a query adds nothing to that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nimbostrat.llm import mixing, oracles
from nimbostrat.llm.conversation_trie import conversation_trie
from nimbostrat.llm.decontamination import find_leaks
from nimbostrat.llm.exact_dedup import exact_dedup
from nimbostrat.llm.html_text import extract
from nimbostrat.llm.language_id import languages
from nimbostrat.llm.line_dedup import drop_recurring_lines
from nimbostrat.llm.ngram_join import ngram_join
from nimbostrat.llm.quality_rules import quality_rules
from nimbostrat.llm.secrets import secret_scan
from nimbostrat.llm.token_store import token_output
from nimbostrat.llm.tokens import token_counts
from nimbostrat.llm.vector_clusters import cluster_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from labelled rows outside the held-out fold."""
    return languages(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template ten documents hold."""
    return drop_recurring_lines(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from the shards: place, number and checksum."""
    return token_output(table(spark, sf_dir, "documents"), vocabulary())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark item that covers it most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, each leaf at most twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    weights = {"domain": mixing.DOMAIN_WEIGHTS, "lang": mixing.LANG_WEIGHTS}
    return mixing.mix(docs, weights, 0.5, epochs=2.0, seed=7).select("doc_id", "domain", "lang", "source", "n_copies")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class: three-word shingles, similarity 0.9."""
    return ngram_join(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document, with linked weak ones."""
    return secret_scan(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict; cutoffs certified for each language on all labels."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid vector's cluster after three rounds from 16 seeded centroids."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations, with the sums of its subtree."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_text": op3_html_text,
    "op4_token_output": op4_token_output,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_source_mixing": op7_source_mixing,
    "op8_ngram_join": op8_ngram_join,
    "op9_secret_scan": op9_secret_scan,
    "op10_token_counts": op10_token_counts,
    "op11_quality_rules": op11_quality_rules,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": oracles.EXACT_DEDUP,
    "op7_source_mixing": oracles.source_mixing(0.5, 2.0, 7),
    "op8_ngram_join": oracles.ngram_join(),
    "op9_secret_scan": oracles.secret_scan(),
    "op11_quality_rules": oracles.quality(),
    "op12_centroid_clusters": oracles.vector_clusters(),
    "op13_conversation_trie": oracles.conversation_trie(),
}
