"""The corpus pipeline: stages of the operators in sievefold.llm, each over all that the one before kept.

Documents without text count as empty texts, which stay in each stage but as copies of one another. Rows without doc_id
stay in each stage unless they are exact copies. Of rows that share a doc_id one stays after near_dedup. Very long texts are read whole; an
empty table passes through as one. All stages but the last return the columns of documents, whatever their names; the last returns
doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievefold.llm.bagminhash import drop_near_duplicates
from sievefold.llm.bpe import bpe
from sievefold.llm.common import documents, stored
from sievefold.llm.exact import drop_exact_duplicates
from sievefold.llm.queries import tokenizer_path
from sievefold.llm.tiling import drop_contaminated
from sievefold.llm.toxicity import drop_toxic
from sievefold.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", encode),
]

#: Signatures, tilings and token ids are beyond SQL; a brute-force version checks the result in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
