"""The queries of the training-data operators, by name; each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hash_ring, html_layout, lexical_search, neighbour_quality, ngram_join, order_minhash, periodic_runs, quality_rules, secret_scan, simhash, source_mixing, warc_fixity
from .common import cut, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


#: Token shares that the mixing query and the pipeline aim at, by language.
TARGETS = {"de": 0.17, "en": 0.52, "es": 0.14, "fr": 0.17}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the mixing query: labelled documents, their language as the domain."""
    own = labels.select("doc_id").where("doc_id is not null").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(own, "doc_id")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = source_mixing.fit_domains(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), sorted(TARGETS))
    profiles = cut(source_mixing.profile(docs, model))
    return source_mixing.rates(profiles, source_mixing.fit_mix(profiles, model, TARGETS))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edited(table(spark, sf_dir, "documents"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_fixity.audit(warc_fixity.records(pages), warc_fixity.records(warc_fixity.damaged(pages)))


def op6_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_ring.shard_documents(table(spark, sf_dir, "documents"))


def op7_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return neighbour_quality.score(docs, neighbour_quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The tokenizer file of the contract; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary())


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_order_minhash": op3_order_minhash,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_hash_ring": op6_hash_ring,
    "op7_neighbour_quality": op7_neighbour_quality,
    "op8_html_layout": op8_html_layout,
    "op9_simhash": op9_simhash,
    "op10_bpe": op10_bpe,
    "op11_ngram_join": op11_ngram_join,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lexical_search": op13_lexical_search,
}

#: Results that SQL can express; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op5_warc_fixity": warc_fixity.AUDIT_SQL,
    "op11_ngram_join": ngram_join.SQL,
    "op13_lexical_search": lexical_search.SQL,
}
