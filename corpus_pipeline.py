"""Corpus pipeline: documents of unwanted language or quality go, one document of each
group of near copies stays, personal data gets pseudonyms, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of their input. Between stages ``run`` writes Parquet to the shared
folder, so a stage starts from files and a lost executor costs one stage's tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import inputs, language, near_duplicates, packing, pseudonyms, quality_model
from caseloom.session import written

#: Quality score from which a document stays.
QUALITY = 0.3
TOKENIZER = "word_bpe_49k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, NULL ones too, and those whose calibrated score is too low.

    Where no row has a lang to learn from, no text is known and all go."""
    model = language.learn(docs, ~language.folds(F.col("doc_id")))
    found = inputs.free(docs, "found")
    return language.identify(docs, model, F.col("text"), found).filter(~F.col(found)["rejected"]).drop(found)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose quality score is below ``QUALITY``; without labels all stay."""
    model = quality_model.learn(docs, inputs.table(spark, sf_dir, "labels"), ~quality_model.folds(F.col("doc_id")))
    found = inputs.free(docs, "score")
    return quality_model.score(docs, model, F.col("text"), found).filter(F.col(found) >= QUALITY).drop(found)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each class of near copies.

    Texts without words, NULL ones too, are one class. Of rows with one doc_id and
    text one stays, whichever; a class without any doc_id keeps the row of the least
    hash of its text. An empty table stays empty."""
    return near_duplicates.one_of_each(docs, docs.columns)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in ``text``; ``n_chars`` follows the new text.

    NULL texts stay NULL, rows are neither dropped nor merged. Set
    ``caseloom.pseudonym.key``: with the key that is public here a pseudonym can be
    turned back."""
    out = pseudonyms.pseudonymise(docs, spark.conf.get("caseloom.pseudonym.key", "change me"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences of 2048 tokens.

    A NULL or empty text takes one token, repeated rows are packed each, an empty
    table gives no rows."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pseudonyms", private_stage),
    ("packing", packing_stage),
]

#: Tokenizers, trained models and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = inputs.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
