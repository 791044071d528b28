"""From raw documents to token ids: five stages, each over all rows that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() chains them over the documents table, with a reliable
checkpoint between stages. Stages but the last return the columns of documents. Labels come from the labels table.

Defined cases, beyond those of the operators: nulls in any column pass every stage as values of their own, a null text as an empty
one. Empty texts are scored as texts without evidence; the near-duplicate stage takes them as equal, so one of them stays. Repeated
rows and rows that share an id are judged one by one until that stage, which keeps one row of each group and of each id. Rows of equal
scores are treated alike; a score at a threshold is toxic, a quality at its threshold good enough. Texts of any length are read whole.
An empty table, or labels that cannot train a stage, let every row pass (mixing rates are 1). Extra columns, whatever their names, pass
through all stages but the last, which returns doc_id, n_tokens, ids and round_trip.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm import bpe, mixing, quality, simhash, toxicity
from weft.llm.parameters import LABELLED, TARGETS, VOCABULARY
from weft.session import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold of their language."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sufficient quality."""
    return quality.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are alike to 0.8 in their five-word shingles."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that expected tokens by domain match TARGETS."""
    labelled = mixing.labelled_documents(docs, table(spark, sf_dir, "labels"), LABELLED)
    return mixing.draw(docs, labelled, TARGETS, max_rows=LABELLED)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL expresses none of the stages; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
