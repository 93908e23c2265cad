"""The training-data pipeline: stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import exact_dedup, langid, mixing, ngram_join, sentencepiece_codec
from webloom.llm.common import Scratch, free_name, quoted
from webloom.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, and those that no language claims, go; lang becomes the language predicted.

    Null and empty texts go, as they have no letter; null ids and languages, repeated rows and very long texts
    are rows like others. Columns whose names clash with the model's pass unchanged. No rows give no rows.
    """
    names = tuple(free_name(docs.columns, c) for c in langid.ADDED)
    found = langid.identify(docs, langid.train(docs), names)
    kept = found.where(~found[names[2]])
    return kept.select(*(F.col(names[0]).alias("lang") if c == "lang" else x for c, x in zip(docs.columns, quoted(docs.columns))))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the largest doc_id stays.

    Null texts are empty ones. A null id is smaller than all others. Of rows that repeat an id and a text one
    stays. Long texts are compared whole; columns of any name pass. No rows give no rows.
    """
    return exact_dedup.drop_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join by runs of 5 words and a similarity of 80 % or more: of each group of near copies the smallest doc_id stays.

    Null and empty texts, and rows with a null id, stay. Rows that repeat an id are one document, and stay or go
    together. Long texts are compared whole; columns of any name pass. No rows give no rows.
    """
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: rows are repeated, left out, or cut at a source's exact budget.

    Null and empty texts have no words, and aren't taken. A null source is a source. Rows that repeat an id are
    rows like others; long texts count whole; columns of any name pass. No rows give no rows.
    """
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: doc_id, source, lang and the ids of each text.

    Null and empty texts have no ids; null ids and sources, repeated rows and long texts are rows like others.
    Other columns go. No rows give no rows.
    """
    return sentencepiece_codec.encode_documents(docs.select("doc_id", "source", "lang", "text"), vocabulary("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", dedup_exact),
    ("ngram_jaccard_join", dedup_near),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A learned classifier and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
            if i:
                scratch.drop(before)
    return docs
