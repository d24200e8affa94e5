"""A training corpus from the table of documents: each stage calls one operator of epistola.llm on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from epistola.llm import decontamination, language_id, mixing, ngram_join, token_ids
from epistola.llm._store import keep, table


#: Cosine with the nearest language from which on a document is kept.
LEAST_COSINE = language_id.CHANCE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: with a letter, and nearer to a language than random letters are.

    Null and empty texts, and those without a letter, go. Other columns, whatever they are called, stay as they are.
    """
    return language_id.keep_known(docs, LEAST_COSINE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group whose sets of five-word n-grams are linked by a Jaccard of 0.8 or more.

    Null, empty and blank texts are in no group and stay; equal rows leave one. A null id is the last that is chosen.
    """
    return ngram_join.keep_one(docs, ngram_join.NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none; rows that repeat are judged each."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, some more than once, so that the tokens of languages meet their target weights.

    A text without words weighs nothing and stays once; a document without lang gets its domains from its words.
    """
    return mixing.repeat_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the token files written for the corpus.

    A null text is empty and has the end id alone; rows that repeat are documents of their own, null ids first.
    """
    return token_ids.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("language_id", identify_language), ("ngram_join", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix), ("token_ids", write_tokens)]

#: No stage can be told in SQL: the first and the fourth are learned, and tokens come from a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = keep(docs, f"stage-{name}")
    return docs
