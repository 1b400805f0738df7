"""Registered queries of the subpackage, each over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import counts, digests, divergence, language, near_duplicates, oracles, packing, pieces, pseudonyms, quality_model, quality_rules, spelling, token_files, url_rules
from .inputs import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {"op11_source_divergence": oracles.SOURCE_DIVERGENCE, "op13_url_rules": oracles.URL_RULES}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_model.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return pseudonyms.private_texts(table(spark, sf, "documents"), spark.conf.get("caseloom.pseudonym.key", "change me"))


@query
def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_digests(spark: SparkSession, sf: str) -> DataFrame:
    return digests.edits(table(spark, sf, "documents"))


@query
def op5_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf, "documents"))


@query
def op6_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.language_id(table(spark, sf, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


@query
def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))


@query
def op13_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judge(table(spark, sf, "pages"))
