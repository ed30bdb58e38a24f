"""The registered queries of this subpackage and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import (
    bpe,
    chat,
    decontaminate,
    extract,
    language,
    lines,
    ngrams,
    phrases,
    quality,
    repair,
    secrets,
    simhash,
    urls,
)
from sightline.llm.common import shared_folder, table, vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scored(table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = quality.learn(documents, table(spark, sf_dir, "labels"))
    return quality.judged(documents.select("doc_id", "text"), rules).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return decontaminate.digest(found)


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def tokenization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are labels of the page's number: good is quality without toxicity."""
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"),
    )
    return urls.judged(table(spark, sf_dir, "pages"), outcomes).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = shared_folder(spark, "ledger")
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), ledger))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_added(table(spark, sf_dir, "conversations"))
    return chat.digest(chat.formatted(turns))


def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_html_extraction": main_text,
    "op3_url_reputation": url_filter,
    "op4_secret_scan": secret_scan,
    "op9_chat_format": chat_format,
    "op2_simhash_near_dedup": near_dedup,
    "op8_bpe_coding": tokenization,
    "op5_language_id": language_id,
    "op6_kneser_ney": lm_scores,
    "op7_quality_rules": quality_rules,
    "op10_decontamination": decontamination,
    "op11_structure_repair": repair.structure_repair,
    "op12_line_dedup": lines.line_dedup,
    "op13_phrase_mining": phrase_mining,
}

QUERIES["pipeline"] = pipeline

ORACLES: dict[str, str] = {
    "op3_url_reputation": urls.ORACLE,
    "op4_secret_scan": secrets.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
    "op12_line_dedup": lines.ORACLE,
    "op13_phrase_mining": phrases.ORACLE,
}
